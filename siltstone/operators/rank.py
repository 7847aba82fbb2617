"""Ranks within groups that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranked(df: DataFrame, group: str, order: str, name: str = "rank", share: int = 64) -> DataFrame:
    """df with the row's number within its group by `order` (unique within the group, of any type that has an order), from 1.

    Only ranks within (group, range of order) are taken by windows; the ranges before are added as counts, so one group never has to
    fit into one task. The ranges are quantiles of each group, estimated in one aggregate of bounded size: an outlier does not
    empty them, whatever the scale. NULL groups are a group of their own.
    """
    kind = dict(df.dtypes)[order]
    # Numbers have quantiles of their own; texts and others are ordered by the number of their first seven bytes, which keeps the order.
    number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp") or kind.startswith("decimal")
    place = F.col(order).cast("double") if number and kind not in ("date", "timestamp") else F.col(order).cast("timestamp").cast("double") if number else F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(order).cast("string"), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    x = df.withColumn("_p", place)
    bounds = x.groupBy(group).agg(F.approx_percentile("_p", [k / share for k in range(1, share)], 1000).alias("_q")).withColumnRenamed(group, "_s")
    x = x.join(bounds, x[group].eqNullSafe(bounds["_s"])).drop("_s")
    x = x.withColumn("_b", F.size(F.filter("_q", lambda q: q < F.col("_p")))).drop("_q", "_p")
    counts = x.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col(group).alias("_g"), F.col("_b").alias("_c"), "_before")
    x = x.withColumn("_r", F.row_number().over(W.partitionBy(group, "_b").orderBy(order)))
    x = x.join(counts, x[group].eqNullSafe(counts["_g"]) & (x["_b"] == counts["_c"]))
    return x.withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_g", "_c", "_before")
