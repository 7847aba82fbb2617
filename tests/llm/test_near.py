import itertools
import random
import re

from pyspark.sql import functions as F

from siltstone.llm import neardup
from siltstone.llm.neardup import expanded, meeting_keys, near_pairs, sketches


def grams(t, n=12):
    t = re.sub(r"\s+", " ", t.strip()).lower()
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def brute(rows, threshold):
    sets = {i: grams(t) for i, t in rows if i is not None and t is not None and grams(t)}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if len(x & y) >= threshold * len(x | y) - 1e-9:
            out.add((a, b))
    return out


def corpus(seed=4, families=25):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 9))) for _ in range(400)]
    rows = []
    for _ in range(families):
        base = r.choices(words, k=r.choice([3, 12, 40, 200, 600]))
        for _ in range(r.randrange(1, 5)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 15) + 1)):
                k = r.randrange(len(w))
                w[k : k + r.randrange(0, 2)] = r.choices(words, k=r.randrange(0, 2))
            if r.random() < 0.3:
                k = r.randrange(len(w) + 1)
                w = w[k:] + w[:k]
            rows.append(" ".join(w))
    texts = [*rows, rows[0], rows[0].upper(), rows[1].replace(" ", "  "), None, "", "short", "  ", "exactly12chr", "exactly12chr", "日本語の文章を比べるための例文です。" * 3, "日本語の文章を比べるための例文です。" * 3 + "追加", "x" * 20_000]
    r.shuffle(texts)
    return list(enumerate(texts))


def found(spark, rows, threshold, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, a string")
    pairs, members = near_pairs(df, "id", "text", threshold, repeated_keys=True, **kw)
    return {tuple(r) for r in expanded(pairs, members).collect()}


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    for threshold in (0.6, 0.8):
        truth, got = brute(rows, threshold), found(spark, rows, threshold)
        assert got <= truth
        assert len(got) >= 0.98 * len(truth)


def test_hot_keys_and_split_groups(spark):
    rows = corpus(7, 15)
    head = "the same long opening passage stands at the head of very many of these texts " * 3
    rows = [(i, None if t is None else head + t) for i, t in rows]
    truth, got = brute(rows, 0.6), found(spark, rows, 0.6, hot=4, group=3, per_bucket=10)
    assert got <= truth
    assert len(got) >= 0.95 * len(truth)


def test_many_copies_are_stars(spark):
    rows = [(i, "one text that is delivered again and again") for i in range(300)] + [(300, "one text that is delivered again and again!")]
    df = spark.createDataFrame(rows, "id long, text string")
    pairs, members = near_pairs(df, "id", "text", 0.8)
    assert {tuple(r)[:2] for r in pairs.collect()} == {(0, 300)}
    assert members.count() == 300
    got = {tuple(r) for r in expanded(pairs, members, 100).collect()}
    assert got == {(0, i) for i in range(1, 301)}


def test_empty_and_null_keys(spark):
    assert found(spark, [], 0.6) == set()
    text = "a text that is long enough to count"
    assert found(spark, [(None, text), (1, text), (1, text), (2, text)], 0.6) == {(1, 2)}


def letters(r, n):
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def edited(t, step, first=7):
    return "".join("#" if i % step == first else c for i, c in enumerate(t))


def test_evenly_edited_copies(spark):
    r = random.Random(3)
    rows = []
    for n, step in [(400, 50), (700, 60), (1500, 60), (2500, 75), (6000, 60), (6000, 90), (20_000, 60)]:
        for _ in range(4):
            t = letters(r, n)
            rows += [t, edited(t, step)]
    rows = list(enumerate(rows))
    truth, got = brute(rows, 0.6), found(spark, rows, 0.6)
    assert len(truth) == 28
    assert got == truth


def test_edited_short_texts(spark):
    r = random.Random(5)
    rows = []
    for n in (12, 13, 20, 30, 31, 40, 50, 60, 63):
        t = letters(r, n)
        rows += [t, t + "."]
        if n >= 60:
            rows.append(t[: n // 2] + "#" + t[n // 2 + 1 :])
    rows = list(enumerate(rows))
    truth, got = brute(rows, 0.6), found(spark, rows, 0.6)
    assert len(truth) >= 10
    assert got == truth


def test_large_family_of_edited_copies(spark):
    r = random.Random(8)
    base = letters(r, 1500)
    rows = []
    for _ in range(130):
        t = list(base)
        for k in r.sample(range(len(t)), 12):
            t[k] = "#"
        rows.append("".join(t))
    rows = list(enumerate(rows))
    truth, got = brute(rows, 0.6), found(spark, rows, 0.6)
    assert got <= truth
    assert len(truth) > 7000
    assert len(got) >= 0.998 * len(truth)


def test_shared_passages_do_not_let_all_texts_meet(spark):
    r = random.Random(11)
    passage = letters(r, 400)
    counts = {}
    for n in (300, 600, 1200):
        df = spark.createDataFrame([(i, letters(r, 400) + passage + letters(r, 400)) for i in range(n)], "id long, text string")
        postings = sketches(df, 12).selectExpr("id", "explode(keys) AS key")
        met = lambda k: sum(x["n"] * (x["n"] - 1) // 2 for x in k.groupBy("key").count().withColumnRenamed("count", "n").collect())
        counts[n] = met(postings), met(meeting_keys(postings, hot=2))
    # One key at a time the meetings grow with the square; here they stay far below.
    assert counts[1200][0] > 12 * counts[300][0]
    assert counts[1200][1] < counts[1200][0] / 8


def test_texts_with_a_shared_passage_and_their_copies(spark):
    r = random.Random(12)
    passage = letters(r, 500)
    rows = []
    for _ in range(60):
        t = letters(r, 500) + passage + letters(r, 500)
        rows += [t, edited(t, 70)]
    rows = list(enumerate(rows))
    truth, got = brute(rows, 0.6), found(spark, rows, 0.6, hot=3)
    assert len(truth) == 60
    assert got == truth


def test_a_family_above_every_bound(spark):
    r = random.Random(13)
    base = letters(r, 900)
    rows = []
    for _ in range(60):
        t = list(base)
        for k in r.sample(range(len(t)), 6):
            t[k] = "#"
        rows.append("".join(t))
    rows = list(enumerate(rows))
    truth, got = brute(rows, 0.6), found(spark, rows, 0.6, hot=1)
    assert got <= truth
    assert len(got) >= 0.99 * len(truth)


def test_texts_with_one_hot_key_in_common_meet(spark, monkeypatch):
    r = random.Random(14)
    base = letters(r, 900)
    rows = [(i, edited(base, 60, i)) for i in range(40)]
    # Only one key is left of each text, and all have it: there are no pairs of keys to meet over.
    truth = brute(rows, 0.6)
    made = neardup.sketches
    monkeypatch.setattr(neardup, "sketches", lambda df, gram: made(df, gram).withColumn("keys", F.array(F.lit(7))))
    for block in (1024, 6):
        got = found(spark, rows, 0.6, hot=5, block=block)
        assert len(truth) > 50
        assert got == truth


def test_classes_of_any_size_are_expanded(spark):
    rows = [(i, "one text that is delivered again and again") for i in range(150)]
    pairs, members = near_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.8)
    assert expanded(pairs, members, None).count() == 150 * 149 // 2
