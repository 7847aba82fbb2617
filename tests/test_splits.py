import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import arrays as V
from siltstone.functions import hooks as H
from siltstone.operators import samples as M
from siltstone.operators import splits as P
from siltstone.operators.clusters import components, star_links
from siltstone.operators.rank import ranked
from siltstone.sources import files as S


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_with_hot_keys(spark):
    r = random.Random(2)
    edges = [(0, i) for i in range(1, 400)] + [(r.randrange(400, 700), r.randrange(400, 700)) for _ in range(200)] + [(i, i + 1) for i in range(800, 860)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([*edges, (5, 5), (None, 3)], "u long, v long")
    for hot in (50, 100_000):
        assert {x["id"]: x["component"] for x in components(df, hot=hot).collect()} == roots(edges)
    assert components(df.where("u < 0")).count() == 0


def test_star_links_are_one_per_record(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(100)] + [(1, "x"), (1, "x"), (None, "x"), (2, None)], "k long, v string")
    assert sorted(tuple(x) for x in star_links(df, "k", "v").collect()) == [(i, 0) for i in range(1, 100)]


def test_linked_clusters(spark):
    rows = [(1, "A, B", "n/a"), (2, "B", ""), (3, "Inc.", "T, U"), (4, "C", "U"), (5, None, None), (6, "", "n/a"), (7, "D", "n/a"), (8, "T", None)]
    got = {r["k"]: r["cluster"] for r in P.linked_clusters(spark.createDataFrame(rows, "k int, e string, t string"), "k", "e", "t").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 3}


def members(spark, n=200):
    return spark.createDataFrame([(i, i - i % (1 + i // 50)) for i in range(n)], "id int, c int")


def test_full_split_has_no_faults(spark):
    m = members(spark)
    ids = lambda cond: m.where(cond).select("id")
    s = P.full_split(m, "c", "id", {"train": 0.7, "valid": 0.2}, 1, 40, 2, ids("id = 3"), ids("id % 2 = 0"), ids("id % 4 = 0 AND c % 2 = 0"), ids("c % 2 = 1"))
    assert {r["fault"]: r["n"] for r in P.split_faults(s, "id", m, "c").collect()}["record of no cluster"] == 0
    assert {r["n"] for r in P.split_faults(s, "id", m, "c").where("fault <> 'record twice in a subset'").collect()} == {0}
    assert s.select("id").distinct().count() == 200
    bad = s.unionByName(s.where("subset = 'train'").withColumn("subset", F.lit("test")))
    assert {r["fault"] for r in P.split_faults(bad, "id", m, "c").where("n > 0").collect()} >= {"record in several subsets", "cluster in several subsets"}


def test_reserved_and_banned(spark):
    m = members(spark)
    picked = P.reserved(m, "c", 40, 2).collect()
    assert sum(r["size"] for r in picked) >= 40 > sum(r["size"] for r in picked) - max(r["size"] for r in picked)
    one = m.where(F.col("c") == picked[0]["c"]).limit(1)
    assert P.without_banned(P.reserved(m, "c", 40, 2), m, "c", "id", one).count() == len(picked) - 1


def test_shares_are_checked(spark):
    with pytest.raises(ValueError, match="shares"):
        P.dealt(members(spark), "c", {"train": 0.9, "valid": 0.2}, 0)
    assert P.dealt(members(spark), "c", {"train": 1.0}, 0).count() == members(spark).select("c").distinct().count()


def test_ranks_with_outliers_and_texts(spark):
    rows = [("g", i) for i in range(500)] + [("g", -(2**62)), ("g", 2**62), (None, 3)]
    got = {(r["g"], r["o"]): r["rank"] for r in ranked(spark.createDataFrame(rows, "g string, o long"), "g", "o").collect()}
    assert got["g", -(2**62)] == 1
    assert got["g", 2**62] == 502
    assert all(got["g", i] == i + 2 for i in range(500))
    words = [f"w{i:05d}" for i in range(300)] + ["", "é", "日本"]
    got = {r["o"]: r["rank"] for r in ranked(spark.createDataFrame([("g", w) for w in words], "g string, o string"), "g", "o").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words), 1)}


def test_shuffles_are_permutations(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id int, g int")
    x = P.running(M.shuffled(df, ["id"], 4), "lot", F.lit(1), "place").orderBy("place").collect()
    assert [r["place"] for r in x] == list(range(100))
    assert sorted(r["id"] for r in x) == list(range(100))
    assert [r["id"] for r in x] != list(range(100))
    y = M.shuffled(df, ["id"], 4, buffer=8)
    assert y.select("shard").distinct().count() == 8
    assert sorted(r["id"] for r in y.collect()) == list(range(100))
    assert M.picked(df, "g", ["id"], 5, 1).count() == 15
    assert M.drawn(df, ["id"], 7, 1).count() == 7


def test_array_flatten(spark):
    arrays = [[1, 2, 3, 4], [5, 6], [7], [], [8, 9, 10]]
    df = spark.createDataFrame([("c", i, a, "unused") for i, a in enumerate(arrays)], "some_constant string, orig_idx int, some_array array<int>, unused string")
    flat = df.select("some_constant", "orig_idx", F.explode("some_array").alias("x"))
    assert [r["orig_idx"] for r in flat.orderBy("x").collect()] == [0, 0, 0, 0, 1, 1, 2, 4, 4, 4]
    b = M.batched(flat, "some_constant", ["orig_idx", "x"], 3).orderBy("x").collect()
    assert [r["batch"] for r in b] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_formulas(spark):
    df = spark.createDataFrame([(3,)], "n int")
    assert df.select(H.arithmetic("-(n + 1) * 2 / 4 - +1", {"n"}).alias("x")).head()["x"] == -3.0
    for bad in ("n ** 2", "__import__('os')", "m + 1", "'a' + 1"):
        with pytest.raises(ValueError, match="formula"):
            H.arithmetic(bad, {"n"})


def test_steps(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (9, "c")], "n int, t string")
    assert df.transform(H.compose([{"_target_": "longer_than", "column": "n", "least": 2}, lambda d: d.where("t = 'b'"), None])).count() == 1
    assert df.transform(H.compose(None)).columns == ["n", "t"]
    with pytest.raises(ValueError, match="no step"):
        H.made({"_target_": "nothing"})


def test_scores_are_reused_once(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (None, 1)], "a int, b int")
    before = spark.createDataFrame([(1, 1, 0.5), (None, 1, 0.7), (8, 8, 0.1)], "a int, b int, s double")
    got = {tuple(r) for r in H.incremental(rows, before, ["a", "b"], lambda d: d.withColumn("s", F.lit(0.0))).collect()}
    assert got == {(1, 1, 0.5), (None, 1, 0.7), (1, 2, 0.0)}
    with pytest.raises(Exception, match="scored twice"):
        H.incremental(rows, before.unionByName(before), ["a", "b"], lambda d: d.withColumn("s", F.lit(0.0))).collect()


def test_arrays(spark):
    df = spark.createDataFrame([([1, 0, 1], [5, 6, 0, 0], "abc")], "v array<int>, t array<int>, s string")
    r = df.select(V.names(F.col("v"), ["x", "y", "z"]).alias("n"), V.until(F.col("t"), 0).alias("u"), V.masked_text(F.col("s"), F.array(F.lit(True), F.lit(False), F.lit(True))).alias("m"), V.only_item(F.col("t")).alias("o"), V.elementwise_max(F.col("v"), F.slice("t", 2, 3)).alias("e")).head()
    assert tuple(r) == (["x", "z"], [5, 6], "ac", None, [6, 0, 1])


def test_masked_mean(spark):
    from siltstone.operators.metrics import masked_mean

    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 3), (4.0, -1)], "x double, t int")
    loss = F.col("x") + F.col("t")
    assert df.agg(masked_mean(loss, F.col("t")).alias("m")).head()["m"] == 3.0


def test_a_stopped_writer_leaves_a_state(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    for df in (a, b, a):
        S.write_branch(df, str(tmp_path), "main")
    assert S.read_branch(spark, str(tmp_path), "main.before").head()["x"] == 2
    (tmp_path / "main").rename(tmp_path / "gone")
    assert S.read_branch(spark, str(tmp_path)).head()["x"] == 2
    S.write_branch(a, str(tmp_path), "main")
    assert S.read_branch(spark, str(tmp_path)).head()["x"] == 1


def test_failures_go_to_their_own_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    good, failed = S.append_checked(df, F.when(F.col("t").isNull(), "no text"), str(tmp_path / "t"))
    good, failed = S.append_checked(df, F.when(F.col("t").isNull(), "no text"), str(tmp_path / "t"))
    assert [r["id"] for r in good.collect()] == [1, 1]
    assert [tuple(r) for r in failed.collect()] == [(2, None, "no text")] * 2
