"""Statistics of tables: profiles, boxes, densities, agreement, copies, best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def positive_iou() -> Column:
    """IoU of positives from agreed_pos and disagreed; 1 where both are 0."""
    both = F.col("agreed_pos") + F.col("disagreed")
    return F.when(both == 0, 1.0).otherwise(F.col("agreed_pos") / both)


def iou_overall(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """(macro, micro, pooled) from counts per pair (criterion, agreed_pos, disagreed): the mean of the criteria's means, the mean of
    all pairs, and the ratio of the sums."""
    c = pairs.withColumn("v", positive_iou()).groupBy("criterion").agg(F.avg("v").alias("m"), F.sum("v").alias("s"), F.count("*").alias("n"), F.sum("agreed_pos").alias("p"), F.sum("disagreed").alias("d"))
    return c.agg(F.round(F.avg("m"), digits).alias("macro"), F.round(F.sum("s") / F.sum("n"), digits).alias("micro"), F.round(F.sum("p") / (F.sum("p") + F.sum("d")), digits).alias("pooled"))


def annotation_iou(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., iaa) of two annotations (keys..., annotator_idx 0 or 1, sentence_idx, yes): 0 if one says yes to nothing and the
    other doesn't, else the IoU of the sentences they say yes to; 1 where both are empty.

    One row per sentence first, then sums: no sets are collected. Keys that only one annotator has give no row.
    """
    there = lambda a: F.bool_or(F.col("annotator_idx") == a)
    said = lambda a: F.coalesce(F.bool_or((F.col("annotator_idx") == a) & F.col("yes")), F.lit(False)).cast("int")
    s = rows.groupBy(*keys, "sentence_idx").agg(there(0).alias("t0"), there(1).alias("t1"), said(0).alias("a"), said(1).alias("b"))
    g = s.groupBy(*keys).agg(F.bool_or("t0").alias("t0"), F.bool_or("t1").alias("t1"), F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("b")).alias("n"), F.sum(F.greatest("a", "b")).alias("u"))
    iaa = F.when((F.col("na") > 0) != (F.col("nb") > 0), 0.0).when(F.col("u") == 0, 1.0).otherwise(F.col("n") / F.col("u"))
    return g.where("t0 AND t1").select(*keys, iaa.alias("iaa"))


def box(df: DataFrame, group: str, value: str, reach: float = 1.5) -> DataFrame:
    """(group, q1, q2, q3, low_whisker, high_whisker, fliers): whiskers are the outermost values within reach x (q3 - q1) of the
    quartiles. Equal values are counted first, so what a quartile needs to hold is one count per distinct value."""
    v = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    q = v.groupBy(group).agg(F.percentile(value, [0.25, 0.5, 0.75], F.col("_n")).alias("_q"))
    x = v.join(q, group)
    lo, hi = F.col("_q")[0] - reach * (F.col("_q")[2] - F.col("_q")[0]), F.col("_q")[2] + reach * (F.col("_q")[2] - F.col("_q")[0])
    out = (F.col(value) < lo) | (F.col(value) > hi)
    g = x.groupBy(group).agg(F.first("_q").alias("_q"), F.min(F.when(F.col(value) >= lo, F.col(value))).alias("low_whisker"), F.max(F.when(F.col(value) <= hi, F.col(value))).alias("high_whisker"), F.sum(F.when(out, F.col("_n")).otherwise(0)).alias("fliers"))
    return g.select(group, *[F.col("_q")[i].alias(f"q{i + 1}") for i in range(3)], "low_whisker", "high_whisker", "fliers")


def reverse_density(df: DataFrame, value: str, bins: int, digits: int = 6) -> DataFrame:
    """(bin, n, at_least): equal-width bins from the least to the largest value, which falls into the last one, and the share of values in
    a bin or a later one. The running sum goes over at most `bins` rows."""
    x = df.where(F.col(value).isNotNull())
    m = x.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    b = x.join(F.broadcast(m)).groupBy(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    return b.select("bin", "n", F.round(F.sum("n").over(w) / F.sum("n").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), digits).alias("at_least"))


def profile(df: DataFrame, columns: tuple[str, ...], few: int) -> DataFrame:
    """(name, n, shown): distinct values of each column, and which, in order, where they are fewer than `few`. Values are made
    distinct by a group-by over (column, value), and only the first `few` of a column are ever put together."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("e")).select("e.*")
    seen = rows.distinct()
    counts = seen.groupBy("name").agg(F.count("v").alias("n"))
    r = F.row_number().over(W.partitionBy("name").orderBy("v"))
    shown = seen.where("v IS NOT NULL").withColumn("r", r).where(F.col("r") < few).groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("v")), "|").alias("s"))
    return counts.join(shown, "name", "left").select("name", "n", F.when(F.col("n") < few, F.coalesce("s", F.lit(""))).alias("shown"))


def distinct_tokens(df: DataFrame, separators: dict[str, str]) -> DataFrame:
    """(field, n): distinct trimmed values of each field, split by its own separator. Tokens are made distinct in one group-by."""

    def tokens(field: str, separator: str) -> Column:
        return F.transform(F.split(F.col(field), separator), lambda t: F.struct(F.lit(field).alias("field"), F.trim(t).alias("t")))

    each = [tokens(c, s) for c, s in separators.items()]
    rows = df.select(F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("e")).select("e.*").distinct()
    return rows.groupBy("field").agg(F.count("*").alias("n"))


def copies(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n, identical): keys on several rows, and whether these agree in the columns (NULL as empty text): smallest and largest
    digest are compared, so no versions are collected."""
    d = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return df.groupBy(key).agg(F.count("*").alias("n"), (F.min(d) == F.max(d)).alias("identical")).where("n > 1")


def best(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """(group, key, best): the row with the largest value; the smallest key at a tie."""
    b = F.max(F.struct(F.col(value).alias("v"), (-F.col(key)).alias("k")))
    return df.groupBy(group).agg(b.alias("b")).select(group, (-F.col("b.k")).alias(key), F.col("b.v").alias("best"))


def timings(df: DataFrame, group: str, value: str, item: str, digits: int = 6) -> DataFrame:
    """(group, n, low, high, mean, std, per_item): per_item is the total over the distinct items, counted after one row per item."""
    per = df.groupBy(group, item).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    std = F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0)))
    return per.groupBy(group).agg(n.alias("n"), *[F.round(c, digits).alias(k) for k, c in (("low", F.min("lo")), ("high", F.max("hi")), ("mean", mean), ("std", std), ("per_item", F.sum("s") / F.count("*")))])

