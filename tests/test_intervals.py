import datetime as dt
import random

from pyspark.sql import functions as F

from siltstone.functions.dates import readable_date
from siltstone.operators.intervals import continuous_periods

DAY = dt.timedelta(1)


def brute(rows):
    by = {}
    for e, s, t, *_ in rows:
        if e is not None and s is not None and t is not None and s <= t:
            by.setdefault(e, []).append((s, t))
    out = set()
    for e, iv in by.items():
        iv.sort()
        periods = []
        for s, t in iv:
            if periods and s <= periods[-1][1] + DAY:
                periods[-1][1] = max(periods[-1][1], t)
            else:
                periods.append([s, t])
        out |= {(e, "period", s, t) for s, t in periods}
        out |= {(e, "gap", a[1] + DAY, b[0] - DAY) for a, b in zip(periods, periods[1:], strict=False)}
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "entity string, s date, e date, kind string, start_day string")
    got = [tuple(r) for r in continuous_periods(df, "entity", "s", "e").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_random_intervals_with_ties_nulls_and_clashing_columns(spark):
    r = random.Random(5)
    first = dt.date(2020, 1, 1)
    rows = []
    for _ in range(600):
        s = first + dt.timedelta(r.randrange(400))
        rows.append((r.choice(["a", "b", "c", "d", None]), r.choice([s, s, s, s, None]), s + dt.timedelta(r.randrange(-2, 12)), "x", "y"))
    check(spark, rows + rows[:50])


def test_one_entity_holds_most_rows(spark):
    first = dt.date(2020, 1, 1)
    check(spark, [("hot", first + dt.timedelta(i % 90), first + dt.timedelta(i % 90), "", "") for i in range(5000) if i % 90 % 7] + [("b", first, first, "", "")])


def test_adjacent_days_continue(spark):
    d = dt.date(2020, 2, 28)
    check(spark, [("a", d, d + DAY, "", ""), ("a", d + 2 * DAY, d + 2 * DAY, "", ""), ("a", d + 4 * DAY, d + 4 * DAY, "", "")])


def test_empty(spark):
    check(spark, [("a", None, dt.date(2020, 1, 1), "", "")])


def test_dates(spark):
    cases = {
        "2019-07-01": "2019-07-01", "2019/06/30": "2019-06-30", "01/07/2018": "2018-07-01", "2022-04-01 00:00:00": "2022-04-01", "January 1, 2015": "2015-01-01", "28 Jan 2018": "2018-01-28", "1 april 2019": "2019-04-01",
        " 1 Sept 2019 ": "2019-09-01", "31.12.2019": "2019-12-31", "20200229": "2020-02-29", "31/02/2019": None, "13/13/2019": None, "n/a": None, "": None, "unknown": None, None: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, d string")
    for r in df.select("t", "d", F.date_format(readable_date(F.col("t")), "yyyy-MM-dd").alias("got")).collect():
        assert r["got"] == r["d"], r["t"]
