"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def continuous_periods(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, kind, start_day, end_day): the periods covered by the intervals [start, end] (dates, both days included) of
    each entity and the gaps between consecutive periods, as dates.

    A period that begins the day after another ends continues it. Rows with a NULL entity, start or end, or whose start is
    after the end, don't count. Repeated rows and ties change nothing. Other columns are not read. Empty df: no rows.

    Starts and ends are ranked independently of each other within the entity: the intervals leave a gap after rank k exactly
    if the (k+1)-th start lies beyond the day after the k-th end, and then k intervals have begun and ended before it. Equal
    days are counted before they are moved, so an entity with a third of all rows arrives as one row per distinct day (at
    most a calendar's worth), and ranks are sums of these counts.
    """
    rows = df.select(F.col(f"`{entity}`").alias("entity"), F.col(f"`{start}`").cast("date").alias("s"), F.col(f"`{end}`").cast("date").alias("e")).where("entity IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND s <= e")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("day")), F.struct(F.lit(1).alias("side"), F.col("e").alias("day"))))
    days = rows.select("entity", sides.alias("x")).select("entity", "x.side", "x.day").groupBy("entity", "side", "day").agg(F.count("*").alias("n"))
    # One partitioning by entity serves all windows. k: how many intervals have begun before this start, or ended by this end.
    days = days.repartition("entity")
    w = W.partitionBy("entity", "side").orderBy("day")
    upto = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))
    ranked = days.select("entity", "side", "day", F.when(F.col("side") == 0, upto - F.col("n")).otherwise(upto).alias("k"))
    # A start and an end of equal rank k meet here: a boundary if the start is beyond the day after the end. At k = 0 only a
    # start stands, at the last k only an end.
    paired = ranked.groupBy("entity", "k").agg(F.max(F.when(F.col("side") == 0, F.col("day"))).alias("s"), F.max(F.when(F.col("side") == 1, F.col("day"))).alias("e"))
    edges = paired.where("(k = 0) OR (s IS NULL AND e IS NOT NULL) OR (s > date_add(e, 1))")
    b = W.partitionBy("entity").orderBy("k")
    last = F.max("k").over(W.partitionBy("entity"))
    edges = edges.withColumn("last", last).where("s IS NOT NULL OR k = last").withColumn("until", F.lead("e").over(b))
    out = F.array(
        F.when(F.col("s").isNotNull(), F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_day"), F.col("until").alias("end_day"))),
        F.when(F.col("s").isNotNull() & F.col("e").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.date_add("e", 1).alias("start_day"), F.date_sub("s", 1).alias("end_day"))),
    )
    return edges.select("entity", F.explode(F.filter(out, lambda x: x.isNotNull())).alias("x")).select(F.col("entity").alias(entity), "x.kind", "x.start_day", "x.end_day")
