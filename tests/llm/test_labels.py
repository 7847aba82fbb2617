import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm.components import closest_counts, components, plan_split, split_records, star_edges
from siltstone.llm.consensus import Consensus, beta_interval, digamma, krippendorff, latest_labels

ITEM = ["s", "c", "i"]
SCHEMA = "s int, c string, i int, who int, label string, at timestamp, annotator string"


def test_components_equal_union_find(spark):
    r = random.Random(3)
    values = [(r.randrange(200), f"v{min(r.randrange(150), r.randrange(150))}") for _ in range(260)] + [(None, "v1"), (3, None), (3, "v1"), (3, "v1")]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by = {}
    for k, v in values:
        if k is not None and v is not None:
            top(k)
            by.setdefault(v, []).append(k)
    for ks in by.values():
        for k in ks:
            a, b = top(ks[0]), top(k)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for k in list(parent):
        groups.setdefault(top(k), set()).add(k)
    want = {(k, min(g)) for g in groups.values() if len(g) > 1 for k in g}
    df = spark.createDataFrame(values, "k int, v string").withColumn("u", F.lit("x"))
    assert {tuple(x) for x in components(star_edges(df, "k", "v")).collect()} == want


def test_long_path_and_hot_value(spark):
    chain = [(i, f"c{i // 2}") for i in range(1, 401)] + [(i, f"d{(i + 1) // 2}") for i in range(1, 401)]
    got = components(star_edges(spark.createDataFrame(chain, "k int, v string"), "k", "v")).collect()
    assert {x["component"] for x in got} == {1}
    hot = spark.createDataFrame([(i, "hot") for i in range(1000)], "k int, v string")
    assert star_edges(hot, "k", "v").count() == 999
    assert components(star_edges(spark.createDataFrame([], "k int, v string"), "k", "v")).count() == 0


def test_closest_counts_is_exact():
    r = random.Random(1)
    for _ in range(60):
        sizes = {s: r.randrange(1, 4) for s in r.sample(range(1, 30), r.randrange(1, 5))}
        target = r.randrange(0, 60)
        totals = {sum(s * n for s, n in zip(sizes, c, strict=True)) for c in itertools.product(*[range(n + 1) for n in sizes.values()])}
        # Whatever the bitsets look at first, the result is the closest.
        for width in (1, 4, 16, 1 << 20):
            take = closest_counts(sizes, target, width)
            assert all(0 <= n <= sizes[s] for s, n in take.items())
            assert abs(sum(s * n for s, n in take.items()) - target) == min(abs(t - target) for t in totals)


def test_plan_deals_all_groups():
    sizes = {1: 90_000, 7: 5_000, 40: 3}
    for exact in (1 << 24, 1000):
        plan = plan_split(sizes, {"a": 0.8, "b": 0.1, "c": 0.1}, exact)
        assert {s: sum(n for _, n in p) for s, p in plan.items()} == sizes
        total = sum(s * n for s, n in sizes.items())
        for k, share in (("a", 0.8), ("b", 0.1), ("c", 0.1)):
            assert abs(sum(s * n for s, p in plan.items() for x, n in p if x == k) - share * total) <= 1


def test_totals_far_beyond_the_bitsets():
    sizes = {1: 5_000_000_000, 7: 10**8, 12_345: 10**4, 10**9: 3}
    plan = plan_split(sizes, {"a": 0.8, "b": 0.1, "c": 0.1})
    total = sum(s * n for s, n in sizes.items())
    assert {s: sum(n for _, n in p) for s, p in plan.items()} == sizes
    assert sum(s * n for s, p in plan.items() for x, n in p if x == "b") == round(total / 10)
    # No total meets the target: the closest is found though it takes the widest bitsets.
    assert closest_counts({1000: 50}, 20_499, 16) == {1000: 20}


def test_split_keeps_groups(spark):
    records = spark.createDataFrame([(i,) for i in range(500)] * 2 + [(None,)], "id int").withColumn("component", F.lit(1))
    comps = spark.createDataFrame([(i, i // 10 * 10) for i in range(200)], "id int, component int")
    got = split_records(records, "id", comps, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(got) == 500
    by = {}
    for r in got:
        by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    n = {k: sum(r["split"] == k for r in got) for k in ("train", "validation", "test")}
    assert n == {"train": 400, "validation": 50, "test": 50}


def simulated(seed=2, items=1500, annotators=12):
    r = random.Random(seed)
    skill = {a: (r.uniform(0.55, 0.97), r.uniform(0.55, 0.97)) for a in range(annotators)}
    skill[0] = (0.2, 0.2)
    truth, rows = {}, []
    for i in range(items):
        truth[i] = r.random() < 0.4
        for a in [0, *r.sample(range(1, annotators), 4)]:
            ok = r.random() < skill[a][not truth[i]]
            rows.append((i, "c", 0, a, r.choice(["YES", "y", "1", " Yes "]) if truth[i] == ok else r.choice(["NO", "n", "false"]), None, "clash"))
    return truth, skill, rows


def test_consensus_on_known_truth(spark):
    truth, skill, rows = simulated()
    extra = [(0, "c", 0, None, "YES", None, ""), (None, "c", 0, 1, "YES", None, ""), (1, "c", 0, 3, " ", None, ""), (2, "c", 0, 99, "UNCLEAR", None, "")]
    c = Consensus(latest_labels(spark.createDataFrame(rows + rows[:100] + extra, SCHEMA), ITEM, "who", "label", "at"))
    got = {r["i0"]: r["consensus"] for r in c.per_item().collect()}
    hits = sum((got[i] == "YES") == t for i, t in truth.items())
    votes = {}
    for i, _, _, _, label, *_ in rows:
        votes.setdefault(i, []).append(label.strip() in ("YES", "y", "1", "Yes"))
    majority = sum((sum(v) * 2 > len(v)) == truth[i] for i, v in votes.items())
    assert hits > majority
    assert hits > 0.9 * len(truth)
    for r in c.per_annotator().collect():
        if r["annotator"] in skill:
            assert abs(r["sensitivity"] - skill[r["annotator"]][0]) < 0.08
            assert r["sens_low"] < r["sensitivity"] < r["sens_high"]
            assert abs(r["specificity"] - skill[r["annotator"]][1]) < 0.08


def test_latest_label_counts(spark):
    import datetime as dt

    t = dt.datetime
    rows = [(1, "c", 0, 5, "YES", t(2020, 1, 1), ""), (1, "c", 0, 5, "NO", t(2020, 1, 2), ""), (1, "c", 0, 5, None, t(2020, 1, 3), ""), (1, "c", 0, 6, "what", t(2020, 1, 3), ""), (1, "c", 0, 7, "NO", None, ""), (1, "c", 0, 7, "YES", None, "")]
    got = {r["annotator"]: r["label"] for r in latest_labels(spark.createDataFrame(rows, SCHEMA), ITEM, "who", "label", "at").collect()}
    assert got == {5: "NO", 7: "YES"}


def test_no_labels(spark):
    c = Consensus(latest_labels(spark.createDataFrame([], SCHEMA), ITEM, "who", "label", "at"))
    assert c.per_item().count() == 0
    assert c.per_annotator().count() == 0


def test_krippendorff(spark):
    rows = [(i, "c", 0, a, x, None, "") for i, (p, q) in enumerate([("YES", "YES"), ("NO", "NO"), ("YES", "NO"), ("NO", "NO"), ("UNCLEAR", "NO")]) for a, x in ((1, p), (2, q))] + [(9, "d", 0, a, "YES", None, "") for a in (1, 2)]
    got = {r["i1"]: r["alpha"] for r in krippendorff(latest_labels(spark.createDataFrame(rows, SCHEMA), ITEM, "who", "label", "at"), "i1").collect()}
    # Observed 2/5; expected (100 - 9 - 36 - 1) / 90.
    assert got["c"] == round(1 - 0.4 / 0.6, 6)
    assert got["d"] is None


def test_special_functions():
    assert np.allclose(digamma([1.0, 0.5, 10.0]), [-0.5772156649, -1.9635100260, 2.2517525890], atol=1e-8)
    lo, hi = beta_interval(20, 20)
    assert abs(lo - 0.3494) < 0.003
    assert abs(hi - 0.6506) < 0.003
