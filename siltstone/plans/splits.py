"""Queries of clusters and splits, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import samples as M
from ..operators import splits as P
from ..session import cut
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARES = {"train": 0.8, "valid": 0.1}
LEAST = 100


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CL = """WITH RECURSIVE st AS (SELECT DISTINCT statement_id AS s, coalesce(entities, '') AS e, coalesce(trademarks, '') AS m FROM statements),
tk AS (SELECT DISTINCT s, tok FROM (SELECT s, unnest(string_split(e, ', ')) AS tok FROM st WHERE TRUE UNION ALL SELECT s, unnest(string_split(m, ', ')) FROM st WHERE m NOT IN ('', 'n/a')) WHERE TRUE),
tk2 AS (SELECT * FROM tk WHERE tok <> 'Inc.'),
lo AS (SELECT tok, min(s) AS b FROM tk2 GROUP BY tok),
ed AS (SELECT DISTINCT s AS a, b FROM tk2 JOIN lo USING (tok)), un AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
re AS (SELECT a AS id, a AS c FROM un UNION SELECT un.b, re.c FROM re JOIN un ON un.a = re.id WHERE re.c < un.b),
mem AS (SELECT s AS statement_id, coalesce(min(c), s) AS cluster FROM (SELECT DISTINCT s FROM st) LEFT JOIN re ON id = s GROUP BY s)
"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(P.linked_clusters(table(spark, sf_dir, "statements"), "statement_id", "entities", "trademarks"), "members")


@query(_CL + "SELECT statement_id, cluster FROM mem")
def statement_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements linked by comma-separated trademarks or entities; those that name no entity are one cluster."""
    return P.linked_clusters(table(spark, sf_dir, "statements"), "statement_id", "entities", "trademarks")


_RES = _CL + f""", sz AS (SELECT cluster, count(*) AS size FROM mem GROUP BY cluster),
rn AS (SELECT cluster, size, coalesce(sum(size) OVER (ORDER BY md5('7:' || cluster) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sz),
res AS (SELECT cluster, size FROM rn WHERE before < {LEAST}),
ban AS (SELECT statement_id FROM statements GROUP BY statement_id HAVING max(page_count) > 40),
gold AS (SELECT * FROM res WHERE cluster NOT IN (SELECT cluster FROM mem WHERE statement_id IN (SELECT statement_id FROM ban))),
val AS (SELECT statement_id FROM annotations WHERE annotator_idx = 0 AND statement_id IS NOT NULL GROUP BY statement_id),
chk AS (SELECT cluster, statement_id FROM mem WHERE cluster IN (SELECT cluster FROM gold) AND statement_id IN (SELECT statement_id FROM val))"""


def _banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "statements").groupBy("statement_id").agg(F.max("page_count").alias("p")).where("p > 40").select("statement_id")


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annotations").where("annotator_idx = 0 AND statement_id IS NOT NULL").select("statement_id").distinct()


@query(_RES + " SELECT cluster, size::BIGINT AS size FROM gold")
def reserved_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters reserved at random up to a number of statements, then without those that have a banned statement."""
    m = _members(spark, sf_dir)
    return P.without_banned(P.reserved(m, "cluster", LEAST, 7), m, "cluster", "statement_id", _banned(spark, sf_dir))


@query(_RES + " SELECT cluster, statement_id FROM chk")
def validated_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated statements of the reserved clusters."""
    m = _members(spark, sf_dir)
    gold = P.without_banned(P.reserved(m, "cluster", LEAST, 7), m, "cluster", "statement_id", _banned(spark, sf_dir))
    return P.validated_members(gold, m, "cluster", "statement_id", _validated(spark, sf_dir))


@query(_CL + " SELECT DISTINCT cluster FROM mem WHERE statement_id IN (SELECT statement_id FROM annotations WHERE annotator_idx = 0)")
def clusters_of_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that hold given statements, each once."""
    return P.cluster_of(_validated(spark, sf_dir), _members(spark, sf_dir), "cluster", "statement_id")


_SPLIT = _RES + """, fr AS (SELECT * FROM mem WHERE cluster NOT IN (SELECT cluster FROM gold)),
od AS (SELECT cluster, row_number() OVER (ORDER BY md5('3:' || cluster)) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM fr)),
dl AS (SELECT cluster, CASE WHEN nth < round_even(0.8 * n, 0) THEN 'train' WHEN nth < round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'valid' END AS subset FROM od),
u AS (SELECT statement_id, subset FROM fr JOIN dl USING (cluster) WHERE subset IS NOT NULL
UNION ALL SELECT statement_id, 'valid' FROM chk WHERE cluster IN (SELECT cluster FROM chk WHERE statement_id % 2 = 0) AND cluster % 2 = 0
UNION ALL SELECT statement_id, 'test' FROM chk WHERE cluster IN (SELECT cluster FROM chk WHERE statement_id IS NOT NULL) AND cluster % 2 = 1
UNION ALL SELECT statement_id, 'gold' FROM chk),
sp AS (SELECT * FROM u UNION ALL SELECT statement_id, 'unused' FROM mem WHERE statement_id NOT IN (SELECT statement_id FROM u))"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = _members(spark, sf_dir)
    val = _validated(spark, sf_dir)
    # Which validated clusters go to valid and which to test is given by lists of statements: here by parity.
    ids = m.join(val, "statement_id", "left_semi")
    valid = ids.where("cluster % 2 = 0 AND statement_id % 2 = 0").select("statement_id")
    test = ids.where("cluster % 2 = 1").select("statement_id")
    return P.full_split(m, "cluster", "statement_id", SHARES, 3, LEAST, 7, _banned(spark, sf_dir), val, valid, test), m


@query(_SPLIT + " SELECT statement_id, subset FROM sp")
def full_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train, valid, test, gold and unused statements; linked statements stay together."""
    return _split(spark, sf_dir)[0]


@query(_SPLIT + ", mn AS (SELECT * FROM sp WHERE subset NOT IN ('gold', 'unused')) SELECT 'record in several subsets' AS fault, count(*) AS n FROM (SELECT 1 FROM mn GROUP BY statement_id HAVING count(DISTINCT subset) > 1) UNION ALL SELECT 'record twice in a subset', count(*) FROM (SELECT 1 FROM sp GROUP BY statement_id, subset HAVING count(*) > 1) UNION ALL SELECT 'cluster in several subsets', count(*) FROM (SELECT 1 FROM mn JOIN mem USING (statement_id) GROUP BY cluster HAVING count(DISTINCT subset) > 1) UNION ALL SELECT 'record in several clusters', count(*) FROM (SELECT 1 FROM mem GROUP BY statement_id HAVING count(DISTINCT cluster) > 1) UNION ALL SELECT 'record of no cluster', count(*) FROM sp WHERE statement_id NOT IN (SELECT statement_id FROM mem)")
def split_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the split: a row each with the number of faults."""
    s, m = _split(spark, sf_dir)
    return P.split_faults(s, "statement_id", m, "cluster")


@query(_SPLIT + " SELECT subset, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM mem), 6) AS share FROM sp GROUP BY subset")
def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many statements each subset has, and their share of all."""
    s, m = _split(spark, sf_dir)
    n = m.agg(F.count("*").alias("all_n"))
    return s.groupBy("subset").agg(F.count("*").alias("n")).join(F.broadcast(n)).select("subset", "n", F.round(F.col("n") / F.col("all_n"), 6).alias("share"))


@query(_CL + " SELECT cluster, min(statement_id) AS first, count(*) AS size FROM mem GROUP BY cluster")
def cluster_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their first statement, by which they are listed, and size."""
    return P.listed(_members(spark, sf_dir), "cluster", "statement_id")


@query(_CL + ", o AS (SELECT cluster, row_number() OVER (ORDER BY md5('0:' || cluster)) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM mem)) SELECT statement_id, cluster, CASE WHEN nth < round_even(0.8 * n, 0) THEN 'train' WHEN nth < round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'valid' ELSE 'test' END AS split FROM mem JOIN o USING (cluster)")
def dealt_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a shuffled order of clusters: the shares hold for the number of clusters."""
    m = _members(spark, sf_dir)
    d = P.dealt(m, "cluster", {"train": 0.8, "valid": 0.1}, 0)
    return m.join(d, "cluster", "left").select("statement_id", "cluster", F.coalesce("subset", F.lit("test")).alias("split"))


# --- shuffles and picks ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def random_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each source at random, by a seed."""
    return M.picked(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 5, 5)


@query("SELECT statement_id FROM (SELECT DISTINCT statement_id FROM statements) ORDER BY md5('11:' || statement_id) LIMIT 5")
def shuffled_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five statements of a seeded shuffle."""
    return M.drawn(table(spark, sf_dir, "statements").select("statement_id").distinct(), ["statement_id"], 5, 11)


@query("WITH b AS (SELECT DISTINCT doc_id // 64 AS batch FROM documents ORDER BY md5('2:' || (doc_id // 64)), batch LIMIT 8) SELECT batch, min_by(doc_id, md5('2:' || doc_id)) AS doc_id FROM documents JOIN b ON doc_id // 64 = batch GROUP BY batch")
def batch_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight batches at random without replacement, and one element of each at random."""
    d = table(spark, sf_dir, "documents").select("doc_id").withColumn("batch", F.floor(F.col("doc_id") / 64))
    b = M.drawn(d.select("batch").distinct(), ["batch"], 8, 2)
    return M.picked(d.join(F.broadcast(b), "batch"), "batch", ["doc_id"], 1, 2).select("batch", "doc_id")


@query("SELECT doc_id, i - 1 AS idx, row_number() OVER (ORDER BY md5('9:' || doc_id || ':' || (i - 1)), doc_id, i) - 1 AS place FROM (SELECT doc_id, generate_subscripts(sentences, 1) AS i FROM documents)")
def shuffled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened sentences with their place in a seeded shuffle of all."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode("sentences").alias("idx", "s")).drop("s")
    x = M.shuffled(d, ["doc_id", "idx"], 9)
    return P.running(x, "lot", F.lit(1), "place").select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("place").cast("long").alias("place"))


@query("WITH s AS (SELECT doc_id, generate_subscripts(sentences, 1) - 1 AS idx FROM documents), w AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id || ':' || idx), doc_id, idx) - 1 AS place FROM s), b AS (SELECT place // 256 AS batch, doc_id, count(*) AS n FROM w GROUP BY ALL) SELECT batch, count(*) AS n_docs, round(count(*)::DOUBLE / sum(n), 6) AS ratio, max(n) AS most, arg_min(doc_id, (1000 - n) * 1000000000 + doc_id) AS mode, (sum(n) - count(*))::BIGINT AS duplicates FROM b GROUP BY batch")
def shuffle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a shuffle mixes: distinct documents per batch of 256, their ratio, the most frequent one, repeated ones."""
    b = shuffled_items(spark, sf_dir).withColumn("batch", F.floor(F.col("place") / 256)).groupBy("batch", "doc_id").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("doc_id")).alias("d")))
    return b.groupBy("batch").agg(F.count("*").alias("n_docs"), F.round(F.count("*") / F.sum("n"), 6).alias("ratio"), F.max("n").alias("most"), (-best["d"]).alias("mode"), (F.sum("n") - F.count("*")).alias("duplicates"))


@query("SELECT idx, 'SID_' || (1000 + row_number() OVER (ORDER BY idx) - 1) AS sequence_id FROM (SELECT DISTINCT idx FROM statements)")
def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered ids with an offset, in the order of the key."""
    from ..operators.rank import ranked

    ids = table(spark, sf_dir, "statements").select("idx").distinct()
    x = ranked(ids.withColumn("g", F.lit(1)), "g", "idx")
    return x.select("idx", F.concat(F.lit("SID_"), (F.col("rank") + 999).cast("string")).alias("sequence_id"))
