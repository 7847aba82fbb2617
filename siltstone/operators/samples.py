"""Samples from annotated texts: what a sample is by each strategy, labels per sample and criterion, batches, shuffles, picks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .annotations import binary_labels


def labelled(sentences: DataFrame, counts: DataFrame, panels: DataFrame, key: str, criteria: Iterable[str]) -> DataFrame:
    """(key, idx, criterion, y) for every sentence (key, idx) and each criterion: y as binary_labels() says. Sentences without hits
    count zero; a criterion without a panel is masked. The criteria are a constant array: no join makes the grid."""
    grid = sentences.select(key, "idx", F.explode(F.array(*[F.lit(c) for c in criteria])).alias("criterion"))
    x = grid.join(panels.select(key, "criterion", "panel"), [key, "criterion"], "left").join(counts, [key, "criterion", "idx"], "left").na.fill(0, ["panel", "n_annotators", "n_chunks", "n_yes"])
    return x.select(key, "idx", "criterion", binary_labels(F.col("n_annotators"), F.col("panel"), F.col("n_chunks"), F.col("n_yes")).alias("y"))


def _rows(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.posexplode("sentences").alias("idx", "sentence"))


def all_sentences(texts: DataFrame, placed: DataFrame, key: str, visual: bool = False) -> DataFrame:
    """(key, idx): every sentence; without visual those that a chunk of a visual element stands on are left out."""
    rows = _rows(texts, key).select(key, "idx")
    return rows if visual else rows.join(placed.where("origin <> 'main_body'").select(key, "idx").distinct(), [key, "idx"], "left_anti")


def without_chunks(texts: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """(key, idx, sentence): sentences that no chunk of any criterion or origin stands on."""
    return _rows(texts, key).join(placed.select(key, "idx").distinct(), [key, "idx"], "left_anti")


def of_chunks(texts: DataFrame, placed: DataFrame, key: str, by: list[str], visual: bool = False) -> DataFrame:
    """(key, by..., chunk_no, idxs): a sample per chunk, with the places of its sentences as text; sentences of no chunk follow as
    samples of their own, with NULL for by and chunk_no."""
    return _with_missing(_main(placed, visual).groupBy(key, *by, "chunk_no").agg(F.array_sort(F.collect_set("idx")).alias("i")).select(key, *by, "chunk_no", F.array_join(F.col("i").cast("array<string>"), ",").alias("idxs")), texts, placed, key)


def of_subchunks(texts: DataFrame, placed: DataFrame, key: str, by: list[str], visual: bool = False) -> DataFrame:
    """(key, by..., chunk_no, idxs): as of_chunks(), but a sample per sentence of a chunk."""
    return _with_missing(_main(placed, visual).select(key, *by, "chunk_no", "idx").distinct().select(key, *by, "chunk_no", F.col("idx").cast("string").alias("idxs")), texts, placed, key)


def _main(placed: DataFrame, visual: bool) -> DataFrame:
    return placed if visual else placed.where("origin = 'main_body'")


def _with_missing(samples: DataFrame, texts: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    rest = without_chunks(texts, placed, key).select(key, F.col("idx").cast("string").alias("idxs"))
    return samples.withColumn("chunk_no", F.col("chunk_no").cast("long")).unionByName(rest, allowMissingColumns=True)


def batched(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """df with batch: rows of a group in their order, `size` to a batch, counted from 0.

    The first column of order parts the group: rows of one value of it must fit into a task, the group needn't. What comes before is added as
    sums of counts.
    """
    first = order[0]
    counts = df.groupBy(group, first).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy(first).rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("_g"), F.col(first).alias("_f"), F.coalesce(before, F.lit(0)).alias("_before"))
    x = df.withColumn("_r", F.row_number().over(W.partitionBy(group, first).orderBy(*order[1:])))
    x = x.join(counts, x[group].eqNullSafe(counts["_g"]) & x[first].eqNullSafe(counts["_f"]))
    return x.withColumn("batch", F.floor((F.col("_r") + F.col("_before") - 1) / size).cast("long")).drop("_r", "_before", "_g", "_f")


def lot(seed: int, *key: str) -> Column:
    """A row's place in a shuffle: a digest of the seed and its key, the same in every run, engine and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def shuffled(df: DataFrame, key: list[str], seed: int, buffer: int | None = None, group: str | None = None) -> DataFrame:
    """df with (shard, lot): rows in the order of `lot` are shuffled. With a buffer only within runs of about `buffer` rows, by a
    hash of the key, each a shard of its own that a reader can take alone; without one the order is global."""
    x = df.withColumn("lot", lot(seed, *key))
    return x.withColumn("shard", F.lit(0) if buffer is None else F.pmod(F.xxhash64(group or key[0]), F.lit(buffer)).cast("int"))


def picked(df: DataFrame, group: str, key: list[str], k: int, seed: int) -> DataFrame:
    """k rows of each group at random: those of the smallest lots. Spark keeps only k rows per group and task before the shuffle."""
    w = W.partitionBy(group).orderBy("_lot", *key)
    return df.withColumn("_lot", lot(seed, *key)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_lot", "_r")


def drawn(df: DataFrame, key: list[str], k: int, seed: int) -> DataFrame:
    """k rows of all at random, without replacement: the smallest lots, as a top-k."""
    return df.withColumn("_lot", lot(seed, *key)).orderBy("_lot", *key).limit(k).drop("_lot")
