"""Multi-label metrics over long rows (label, target, prediction): target -1 is left out, zero denominators give 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn per group of rows (target, prediction in {0, 1})."""
    t, p = F.col("target") == 1, F.col("prediction") == 1
    return df.where("target >= 0").groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def scores(counts: DataFrame, digits: int = 6) -> DataFrame:
    """accuracy, precision, recall and f1 beside the columns of confusion()."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    x = {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    return counts.withColumns({k: F.round(v, digits) for k, v in x.items()})


def averages(counts: DataFrame, digits: int = 6) -> DataFrame:
    """One row: micro, macro and support-weighted F1 over the labels of confusion()."""
    f1, support = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.col("tp") + F.col("fn")
    micro = ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    return counts.agg(F.round(micro, digits).alias("f1_micro"), F.round(F.avg(f1), digits).alias("f1_macro"), F.round(ratio(F.sum(f1 * support), F.sum(support)), digits).alias("f1_weighted"))


def valid_predictions(df: DataFrame) -> DataFrame:
    """df with predictions other than 0 and 1 (and NULL ones) as 0."""
    return df.withColumn("prediction", F.when(F.col("prediction") == 1, 1).otherwise(0))


def by_class(df: DataFrame) -> DataFrame:
    """confusion() of each of the classes 0 and 1 that occurs, as label_idx: every row counts for both."""
    each = df.where("target >= 0").select("target", "prediction", F.explode(F.array(F.lit(0), F.lit(1))).alias("label_idx"))
    on = each.select("label_idx", (F.col("target") == F.col("label_idx")).cast("int").alias("target"), (F.col("prediction") == F.col("label_idx")).cast("int").alias("prediction"))
    return confusion(on, ["label_idx"]).where("tp + fp + fn > 0")


def report(counts: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """(label, accuracy, f1, precision, recall): a row per label and their plain mean as macro, which is taken before rounding."""
    names = ("accuracy", "f1", "precision", "recall")
    s = scores(counts, 15).select(F.col(label).cast("string").alias("label"), *names)
    macro = s.agg(F.lit("macro").alias("label"), *[F.avg(c).alias(c) for c in names])
    return s.unionByName(macro).select("label", *[F.round(c, digits).alias(c) for c in names])


def masked_mean(loss: Column, target: Column) -> Column:
    """Aggregate: the mean of losses, those of masked targets (below 0) as 0; masked elements count in the denominator."""
    return F.sum(F.when(target >= 0, loss).otherwise(0.0)) / F.count("*")
