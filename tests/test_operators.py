import random

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.clusters import clusters
from siltstone.operators.context import first_context, plain_context, with_context
from siltstone.operators.match import matched
from siltstone.operators.metrics import averages, confusion, scores
from siltstone.operators.rank import ranked


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).head()["x"]


def test_abbreviations_in_one_pass(spark):
    assert one(spark, "etc. approx. y", lambda c: X.without_dots(c, X.MAY_PATTERN)) == "etc approx. y"
    assert one(spark, "See Dr. A, e.g. this. Mr. B", lambda c: X.without_dots(c, X.NEVER_PATTERN)) == "See Dr A, eg this. Mr B"
    assert one(spark, "Acme Ltd. Then", X.repaired_abbreviations) == "Acme Ltd. Then"
    assert one(spark, "Acme Pty. Limited and", X.repaired_abbreviations) == "Acme Pty Limited and"


def test_cleaned_sentence(spark):
    assert one(spark, "1.2 The  plan was “kept”.", X.cleaned_sentence) == "The plan was kept"
    assert one(spark, "A\u00a0b was “kept”.", X.cleaned_sentence) == "Ab was kept"
    assert one(spark, "2023 report", X.cleaned_sentence) == "2023 report"
    assert one(spark, "20 suppliers", X.cleaned_sentence) == "suppliers"


def test_sentences(spark):
    t = "First one. Second one\n\nHeading\n• item one\n• item two" + X.PAGE_TOKEN + "Next page. ?? . A"
    assert one(spark, t, X.sentences_of) == ["First one", "Second one", "Heading", "item one", "item two", "Next page"]
    assert one(spark, "", X.sentences_of) == []
    assert one(spark, None, X.sentences_of) is None


def test_excerpts(spark):
    assert one(spark, "a // b. // http://x // c", X.excerpt_parts) == ["a", "b", "http://x", "c"]
    assert one(spark, "fig.p3. text", X.excerpt_origin) == "infographic"
    assert one(spark, "tab.p1. text", X.without_prefix) == "text"


def test_answers_and_ids(spark):
    assert [one(spark, s, X.yes_no) for s in ("Yes.", "yes, it is", "NO", "maybe", "yesterday")] == [1, 1, 0, -1, -1]
    assert one(spark, "https://x/statements/00123/", X.id_of_link) == 123
    assert one(spark, "none", X.id_of_link) is None
    assert one(spark, "1,234", X.id_with_commas) == 1234


def reference_context(sents, i, k):
    left = (". ".join(sents[:i]) + ". ").split(" ") if i else [""]
    right = (". " + ". ".join(sents[i + 1 :])).split(" ")
    return (" ".join(left[-k // 2 :]) + " [L] " + sents[i] + " [R]" + " ".join(right[: k // 2])).strip(" ")


def test_context_equals_the_definition(spark):
    docs = [(1, ["a b c", "d", "e f g h", "i j", "k"]), (2, ["only one"]), (3, []), (4, None)]
    df = spark.createDataFrame(docs, "id int, s array<string>")
    for k in (2, 4, 6, 7, 20):
        got = {(r["id"], r["pos"]): r["context"] for r in with_context(df, "id", "s", k).collect()}
        assert got == {(i, p): reference_context(s, p, k) for i, s in docs if s for p in range(len(s))}


def test_plain_and_first_context(spark):
    s = ["a b c", "d", "e  f g h", "d", "b c"]
    df = spark.createDataFrame([(s,)], "s array<string>")
    for k in (1, 4, 6, 8, 20):
        half = max(k // 2 - 1, 0)
        want = []
        for i, x in enumerate(s):
            before, after = " ".join(". ".join(s[:i]).split()[-half:]), " ".join(". ".join(s[i + 1 :]).split()[:half])
            want.append(f"{before}.  [L] {x} [R]. {after}".strip() if half else x.strip())
        assert df.select(plain_context(F.col("s"), k).alias("c")).head()["c"] == want
    full = ". ".join(s)
    want = []
    for x in s:
        p = full.index(x)
        want.append((" ".join(full[:p].split(" ")[-2:]) + " [L] " + x + " [R]" + " ".join(full[p + len(x) :].split(" ")[:2])).strip())
    assert df.select(first_context(F.col("s"), 4).alias("c")).head()["c"] == want


def test_match_stages_and_ties(spark):
    s = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "gamma delta epsilon"), (1, 2, "alpha beta"), (2, 0, "other")], "id int, idx int, sentence string")
    e = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "delta"), (1, 2, "gamma delta epsilom"), (3, 0, "x"), (1, 3, None)], "id int, part int, excerpt string")
    got = {(r["id"], r["part"]): (r["matched_idx"], r["score"], r["stage"]) for r in matched(e, s, "id").collect()}
    assert got == {(1, 0): (0, 1.0, "exact"), (1, 1): (1, 0.999, "inside"), (1, 2): (1, round(1 - 1 / 19, 6), "near")}


def test_metrics_edges(spark):
    rows = [("a", 1, 1), ("a", 0, 1), ("a", -1, 1), ("b", 0, 0), ("b", 0, 0)]
    c = confusion(spark.createDataFrame(rows, "l string, target int, prediction int"), ["l"])
    got = {r["l"]: (r["tp"], r["fp"], r["fn"], r["tn"], r["f1"]) for r in scores(c).collect()}
    assert got == {"a": (1, 1, 0, 0, 0.666667), "b": (0, 0, 0, 2, 0.0)}
    assert averages(c).head()["f1_micro"] == 0.666667


def test_rank_of_a_hot_group(spark):
    rows = [("hot", i * 7) for i in range(2000)] + [("b", 5), (None, 1), (None, 9)]
    random.Random(1).shuffle(rows)
    got = {(r["g"], r["o"]): r["rank"] for r in ranked(spark.createDataFrame(rows, "g string, o long"), "g", "o").collect()}
    assert all(got["hot", i * 7] == i + 1 for i in range(2000))
    assert (got["b", 5], got[None, 1], got[None, 9]) == (1, 1, 2)


def test_clusters_of_overlapping_lists(spark):
    lists = [[8], [1, 2, 3], [3, 4, 5], [7, 8], [6, 7, 8], [10], [1]]
    links = [(x, y[0]) for y in lists for x in y]
    got = {}
    for r in clusters(spark.createDataFrame(links, "a int, b int")).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 4, 5], [6, 7, 8]]


def test_long_chain(spark):
    n = 300
    got = clusters(spark.createDataFrame([(i, i + 1) for i in range(n)], "a int, b int")).collect()
    assert len(got) == n + 1
    assert {r["cluster"] for r in got} == {0}
