"""Splits that keep related records together: connected components (hooking and shortcutting over parent tables, in
operators/clusters.py), then closest split totals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.clusters import components, star_links
from ..session import cut


star_edges = star_links
__all__ = ["closest_counts", "components", "plan_split", "split_records", "star_edges"]

#: Totals that one pass of the bitsets looks at, and that a driver's arrays hold: 4 bytes and two bits each.
WIDTH = 1 << 22


def _items(sizes: dict[int, int]) -> list[tuple[int, int]]:
    """(size, how many at once): the multiplicity of a size cut into powers of two, the smallest sizes first."""
    out = []
    for size, many in sorted(sizes.items()):
        k = 1
        while many > 0:
            out.append((size, min(k, many)))
            many -= k
            k *= 2
    return out


def _places(bits: int) -> np.ndarray:
    """The places of the ones of a long number."""
    words = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 64) * 8, "little"), np.uint64)
    some = np.flatnonzero(words)
    rows, cols = np.nonzero(np.unpackbits(words[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return some[rows] * 64 + cols


def _subset(items: list[tuple[int, int]], target: int) -> tuple[dict[int, int], int]:
    """(size -> how many, their total): the subset of items whose total is closest to target, the lower at a tie.

    Subset sums as a bitset, each item a shift. What a total was first reached with is kept in one array of numbers, not a
    bitset per item: the items before it always reached the rest. Done as soon as target itself is reached.
    """
    top = 2 * target + 1
    first = np.zeros(top + 1, np.int32)
    mask = (1 << (top + 1)) - 1
    reach = 1
    for i, (size, k) in enumerate(items):
        if reach >> target & 1:
            break
        if size * k <= top and (new := (reach << (size * k)) & mask & ~reach):
            first[_places(new)] = i
            reach |= new
    below = (reach & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = reach >> target
    up = target + ((above & -above).bit_length() - 1) if above else None
    total = below if up is None or target - below <= up - target else up
    take: dict[int, int] = {}
    left = total
    while left:
        size, k = items[first[left]]
        take[size] = take.get(size, 0) + k
        left -= size * k
    return take, total


def closest_counts(sizes: dict[int, int], target: int, width: int = WIDTH) -> dict[int, int]:
    """size -> how many groups of that size to take so that their total is as close to target as can be (the lower at a tie).

    The bitsets look at the last `width` records of the target; what lies before is filled with the largest groups that leave that
    many. A total that meets the target can't be bettered. One that doesn't is tried again with twice the width, until the
    bitsets look at the whole target: so the answer is the closest one at any total, and a target within the width
    is settled at once.
    """
    while True:
        left, take, need = dict(sizes), {}, target
        for size in sorted(sizes, reverse=True):
            if need <= width:
                break
            n = min(left[size], (need - width) // size)
            if n > 0:
                take[size] = n
                left[size] -= n
                need -= n * size
        more, total = _subset(_items({s: n for s, n in left.items() if n}), need) if need <= width else ({}, None)
        if total == need or total is not None and width >= target:
            for s, n in more.items():
                take[s] = take.get(s, 0) + n
            return take
        width = min(2 * width, max(target, 1)) if width < target else width * 2


def plan_split(sizes: dict[int, int], shares: dict[str, float], width: int = WIDTH) -> dict[int, list[tuple[str, int]]]:
    """size -> [(split, how many groups of that size)], in the order of shares.

    The smallest share is filled first, each as close to its total as the remaining groups allow; the largest takes the rest.
    """
    total = sum(s * n for s, n in sizes.items())
    norm = sum(shares.values())
    order = sorted(shares, key=lambda k: (shares[k], k))
    left, given = dict(sizes), {k: {} for k in shares}
    for k in order[:-1]:
        for s, n in closest_counts(left, round(total * shares[k] / norm), width).items():
            given[k][s] = n
            left[s] -= n
    given[order[-1]] = left
    return {s: [(k, given[k].get(s, 0)) for k in shares] for s in sizes}


def split_records(records: DataFrame, key: str, comps: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(key, component, split) for each distinct key of records; keys of one component get the same split.

    comps: as from components(); a key without a component is a group of its own. Which groups of one size go where follows
    a hash of the component. NULL keys give no row.
    """
    ids = records.select(F.col(f"`{key}`").alias("id")).where("id IS NOT NULL").distinct().join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    ids = cut(ids, "members")
    groups = ids.groupBy("component").agg(F.count("*").alias("size"))
    # The histogram of sizes has at most sqrt(2 x records) rows.
    sizes = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()}
    plan = plan_split(sizes, shares)
    spark = records.sparkSession
    ranges, schema = [], "size long, split string, lo long, hi long"
    for s, parts in plan.items():
        at = 0
        for k, n in parts:
            if n:
                ranges.append((s, k, at, at + n))
            at += n
    # A rank within a size, without one task holding all groups of the commonest size: ranks within 1,024 hash buckets, plus
    # the counts of the buckets before.
    groups = groups.withColumn("h", F.xxhash64("component")).withColumn("bucket", F.pmod("h", F.lit(1024)))
    before = groups.groupBy("size", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("size", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = groups.withColumn("r", F.row_number().over(W.partitionBy("size", "bucket").orderBy("h", "component"))).join(before, ["size", "bucket"]).select("component", "size", (F.col("r") + F.col("before") - 1).alias("r"))
    where = spark.createDataFrame(ranges, schema)
    chosen = ranked.join(where, (ranked["size"] == where["size"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).select("component", "split")
    return ids.join(chosen, "component").select(F.col("id").alias(key), "component", "split")
