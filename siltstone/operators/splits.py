"""Splits of clusters: reserved and validated clusters, bans, shares of a shuffled order, checks.

The order in which clusters are picked or dealt is that of a digest of the seed and the cluster's id, so it is the same in every run and
engine. Sums along it are taken within 256 ranges of the digest first, so no task holds all clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .clusters import clusters
from .samples import lot


def linked_clusters(records: DataFrame, key: str, always: str, maybe: str, skipped: tuple[str, ...] = ("Inc.",), nothing: tuple[str, ...] = ("", "n/a")) -> DataFrame:
    """(key, cluster): records that share a value of the comma-separated texts `always` or `maybe`, over any number of steps;
    cluster is the smallest key. The texts are matched as they are, in one name space.

    Nothing in `maybe` links nobody; nothing in `always` is a value like any other, so such records are one cluster; values in
    skipped link nobody. NULL counts as the empty text. Records without links are clusters of their own. A value of a third of
    all records gives one link per record.
    """
    x = records.select(F.col(key).alias("s"), F.coalesce(always, F.lit("")).alias("a"), F.coalesce(maybe, F.lit("")).alias("m")).where("s IS NOT NULL")
    tokens = F.concat(F.array_except(F.split("a", ", "), F.array(*[F.lit(v) for v in skipped])), F.when(~F.col("m").isin(*nothing), F.split("m", ", ")).otherwise(F.array()))
    t = x.select("s", F.explode(tokens).alias("tok")).distinct()
    links = t.join(t.groupBy("tok").agg(F.min("s").alias("b"), F.count("*").alias("n")).where("n > 1"), "tok").select(F.col("s").alias("a"), "b")
    ids = x.select("s").distinct()
    return ids.join(clusters(links).withColumnRenamed("id", "s"), "s", "left").select(F.col("s").alias(key), F.coalesce("cluster", "s").alias("cluster"))


def running(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows before it in the order of `order` (hexadecimal digests, so their first two figures are
    even ranges): within ranges, plus the totals of the ranges before."""
    x = df.withColumn("_p", F.substring(order, 1, 2)).withColumn("_v", value)
    totals = x.groupBy("_p").agg(F.sum("_v").alias("_t")).withColumn("_o", F.coalesce(F.sum("_t").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    own = F.coalesce(F.sum("_v").over(W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("_w", own).join(F.broadcast(totals), "_p").withColumn(name, F.col("_o") + F.col("_w")).drop("_p", "_v", "_o", "_w")


def reserved(members: DataFrame, cluster: str, least: int, seed: int) -> DataFrame:
    """(cluster, size): clusters picked in the order of the seed until they hold at least `least` records."""
    sizes = members.groupBy(cluster).agg(F.count("*").alias("size")).withColumn("_l", lot(seed, cluster))
    return running(sizes, "_l", F.col("size"), "_before").where(F.col("_before") < least).select(cluster, "size")


def without_banned(picked: DataFrame, members: DataFrame, cluster: str, key: str, banned: DataFrame) -> DataFrame:
    """picked without the clusters that have a banned record (banned: key); one is enough, and it is dropped after the pick."""
    return picked.join(members.join(banned.select(key), key, "left_semi").select(cluster).distinct(), cluster, "left_anti")


def validated_members(picked: DataFrame, members: DataFrame, cluster: str, key: str, validated: DataFrame) -> DataFrame:
    """(cluster, key): the validated records (key) of picked clusters; clusters without any are gone."""
    return members.join(picked.select(cluster), cluster, "left_semi").join(validated.select(key).distinct(), key, "left_semi").select(cluster, key)


def cluster_of(wanted: DataFrame, members: DataFrame, cluster: str, key: str) -> DataFrame:
    """(cluster): those that hold wanted records (key), each once."""
    return members.join(wanted.select(key), key, "left_semi").select(cluster).distinct()


def dealt(members: DataFrame, cluster: str, shares: dict[str, float], seed: int) -> DataFrame:
    """(cluster, subset): clusters in the order of the seed, the first round(share x clusters) to the first subset (half to even),
    and so on; those beyond all shares are left out."""
    if any(not 0 <= v <= 1 for v in shares.values()) or sum(shares.values()) > 1 + 1e-8:
        raise ValueError("shares must lie in 0..1 and sum up to at most 1")
    c = members.select(cluster).distinct().withColumn("_l", lot(seed, cluster))
    n = c.count()
    out, low = F.lit(None).cast("string"), 0
    bounds = []
    for name, share in shares.items():
        bounds.append((name, low, low + round(share * n)))
        low += round(share * n)
    for name, a, b in bounds:
        out = F.when((F.col("_at") >= a) & (F.col("_at") < b), name).otherwise(out)
    return running(c, "_l", F.lit(1), "_at").select(cluster, out.alias("subset")).where("subset IS NOT NULL")


def full_split(members: DataFrame, cluster: str, key: str, shares: dict[str, float], seed: int, least: int, gold_seed: int, banned: DataFrame, validated: DataFrame, valid_ids: DataFrame, test_ids: DataFrame) -> DataFrame:
    """(key, subset): train and valid from the clusters that aren't reserved; valid and test from the validated reserved clusters that
    hold valid_ids and test_ids; every validated reserved record once more as gold; all records in none of these as unused."""
    gold = without_banned(reserved(members, cluster, least, gold_seed), members, cluster, key, banned)
    checked = validated_members(gold, members, cluster, key, validated)
    free = members.join(gold.select(cluster), cluster, "left_anti")
    parts = [free.join(dealt(free, cluster, shares, seed), cluster).select(key, "subset")]
    parts += [checked.join(cluster_of(ids, checked, cluster, key), cluster, "left_semi").select(key, F.lit(name).alias("subset")) for name, ids in (("valid", valid_ids), ("test", test_ids))]
    parts.append(checked.select(key, F.lit("gold").alias("subset")))
    used = parts[0]
    for p in parts[1:]:
        used = used.unionByName(p)
    rest = members.select(key).join(used.select(key).distinct(), key, "left_anti").select(key, F.lit("unused").alias("subset"))
    return used.unionByName(rest)


def split_faults(split: DataFrame, key: str, members: DataFrame, cluster: str, aside: tuple[str, ...] = ("gold", "unused")) -> DataFrame:
    """(fault, n), a row per check: records in several subsets, repeated records in one, clusters in several subsets, clusters that
    share a record, records of no cluster. Subsets in `aside` are there for other uses and don't count as overlaps."""
    main = split.where(~F.col("subset").isin(*aside))
    several = main.groupBy(key).agg(F.countDistinct("subset").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("record in several subsets").alias("fault"), "n")
    twice = split.groupBy(key, "subset").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("record twice in a subset").alias("fault"), "n")
    torn = main.join(members, key).groupBy(cluster).agg(F.countDistinct("subset").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("cluster in several subsets").alias("fault"), "n")
    shared = members.groupBy(key).agg(F.countDistinct(cluster).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("record in several clusters").alias("fault"), "n")
    lost = split.join(members, key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("record of no cluster").alias("fault"), "n")
    return several.unionByName(twice).unionByName(torn).unionByName(shared).unionByName(lost)


def listed(members: DataFrame, cluster: str, key: str) -> DataFrame:
    """(place, cluster, size): clusters in the order of their smallest record. Sizes are counted, members aren't collected."""
    c = members.groupBy(cluster).agg(F.min(key).alias("first"), F.count("*").alias("size"))
    return c.select(cluster, "first", "size")
