"""Connected components of links between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut

#: A key with more rows than this is looked up by a broadcast: there are at most (all rows / HOT) of them.
HOT = 100_000


def looked_up(rows: DataFrame, key: str, pairs: DataFrame, n: int, hot: int = HOT) -> DataFrame:
    """rows joined with pairs (one row per key). No key's rows ever go to one task: keys with more than `hot` of the n rows are
    counted, map-side first, and their few pairs are broadcast; without so many rows there is no such key."""
    if n <= hot:
        return rows.join(pairs, key)
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(key)
    few = pairs.join(F.broadcast(often), key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(often), key, "left_anti").join(pairs, key))


def star_links(values: DataFrame, key: str, value: str) -> DataFrame:
    """(u, v), u > v: each record linked with the smallest record that has the same value.

    A value of a third of all rows gives one link per record, never a pair of its records. NULL keys and values link nothing.
    """
    x = values.select(F.col(f"`{key}`").alias("u"), F.col(f"`{value}`").alias("value")).where("u IS NOT NULL AND value IS NOT NULL").distinct()
    # The smallest is found by a group-by with partial aggregates, not by a window over all records of a value.
    low = x.groupBy("value").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return x.join(low, "value").where("u <> v").select("u", "v").distinct()


def components(links: DataFrame, rounds: int = 60, hot: int = HOT) -> DataFrame:
    """(id, component): the smallest id that is linked to each id of links (u, v), directly or over others.

    Parallel hooking and shortcutting over the parent table: every round joins the links with grandparents, hooks both a node
    and its parent under the smallest grandparent among its neighbours, and shortcuts nodes to their grandparents, until no
    parent changes (rounds grow with the logarithm of the longest chain). One table per round is written to the shared folder; the
    one before is deleted. Ids of one kind in both columns. Self links and NULLs count for nothing; ids without links
    aren't in the result; no links: no rows.
    """
    both = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
    both = cut(both, "links")
    n = both.count()
    # A node's first parent is its smallest neighbour or itself.
    parents = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p")).select(F.col("u").alias("id"), "p"), "parents")
    for _ in range(rounds):
        grand = looked_up(parents.select("id", "p"), "p", parents.select(F.col("id").alias("p"), F.col("p").alias("g")), n, hot).select("id", "p", "g")
        low = looked_up(both, "v", grand.select(F.col("id").alias("v"), "g"), n, hot).groupBy("u").agg(F.min("g").alias("m"))
        hooks = grand.join(low.withColumnRenamed("u", "id"), "id").select("id", "p", "g", "m")
        none = F.lit(None).cast(parents.schema["p"].dataType)
        own = F.struct(F.col("id"), F.least("p", "g", "m").alias("q"), F.col("p").alias("before"))
        offers = hooks.select(F.explode(F.array(own, F.struct(F.col("p").alias("id"), F.col("m").alias("q"), none.alias("before")))).alias("o")).select("o.*")
        after = cut(offers.groupBy("id").agg(F.min("q").alias("p"), F.max("before").alias("before")), "parents")
        settled = after.where("p <> before").isEmpty()
        drop_cut(parents)
        parents = after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    drop_cut(both)
    return parents.select("id", F.col("p").alias("component"))


def clusters(links: DataFrame) -> DataFrame:
    """(id, cluster) of links (a, b): cluster is the smallest id reached."""
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("component", "cluster")
