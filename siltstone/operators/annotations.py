"""Annotation rows: from annotators' columns to rows, rejected groups, chunks of supporting text and where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .match import best_match


def annotator_rows(wide: DataFrame, keys: list[str], fields: dict[str, str], annotators: list[int]) -> DataFrame:
    """(keys..., annotator, fields...) from columns per annotator; a field's pattern has {} where the annotator's number stands.
    One expression, one row per annotator, no shuffle."""
    each = [F.struct(F.lit(a).alias("annotator"), *[F.col(p.format(a)).alias(k) for k, p in fields.items()]) for a in annotators]
    return wide.select(*keys, F.explode(F.array(*each)).alias("r")).select(*keys, "r.*")


def sorted_out(rows: DataFrame, group: list[str], order: str, error: str, validated: str) -> DataFrame:
    """rows with (state, reason): good, rejected or after.

    Annotators are read in order. A validated row (validated is not NULL) needs no check and ends the reading: what comes after it
    is left out. One bad row rejects its whole group; so does a valid row before a validated one, which must be the only one.
    The group's verdict is one group-by of minima, so a large group is never in one task.
    """
    at = lambda cond: F.min(F.when(cond, F.col(order)))
    checked = F.col(validated).isNotNull()
    bad = ~checked & F.col(error).isNotNull()
    g = rows.groupBy(*group).agg(at(checked).alias("_v"), at(bad).alias("_b"), at(~checked & F.col(error).isNull()).alias("_g"))
    g = g.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], "_v", F.when(F.col("_b") < F.coalesce("_v", F.col("_b") + 1), "invalid data").when(F.col("_g") < F.col("_v"), "more than the validated row").alias("_why"))
    x = rows.join(g, [rows[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group)])
    state = F.when(F.col(order) > F.col("_v"), "after").when(F.col("_why").isNotNull(), "rejected").otherwise("good")
    return x.withColumn("state", state).withColumn("reason", F.when(F.col("state") == "rejected", F.coalesce(F.when(~checked, F.col(error)), "_why"))).drop("_v", "_why", *[f"_k{i}" for i in range(len(group))])


def fully_validated(rows: DataFrame, item: str, part: str, validated: str, parts: int) -> DataFrame:
    """(item): those with exactly one validated row for each of `parts` parts."""
    per = rows.groupBy(item, part).agg(F.count(validated).alias("n"))
    return per.groupBy(item).agg(F.count_if(F.col("n") == 1).alias("n")).where(F.col("n") == parts).select(item)


def chunks(excerpts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., chunk_no, origin, chunk): the parts of each excerpt, their figure or table prefix off. Empty excerpts have none."""
    x = excerpts.where(F.length(text) > 0).select(*keys, F.posexplode(X.excerpt_parts(F.col(text))).alias("chunk_no", "part"))
    return x.select(*keys, "chunk_no", X.excerpt_origin(F.col("part")).alias("origin"), X.without_prefix(F.col("part")).alias("chunk"))


def placed_chunks(parts: DataFrame, keys: list[str], sentences: DataFrame, key: str) -> DataFrame:
    """(keys..., chunk_no, origin, chunk, piece, sentence, idx, score, stage): every sentence of every chunk at its place among the
    sentences (key, sentences array<string>) of its text. Texts without sentences have no row."""
    x = parts.join(sentences.select(key, "sentences").where("size(sentences) > 0"), key)
    found = F.transform(F.array(F.struct(F.col("sentences").alias("s"), X.sentences_of(F.col("chunk"), "annotators").alias("c"))), lambda p: F.transform(p["c"], lambda c: F.struct(c.alias("sentence"), best_match(p["s"], c).alias("m"))))
    x = x.select(*keys, "chunk_no", "origin", "chunk", F.posexplode(F.get(found, 0)).alias("piece", "f"))
    return x.select(*keys, "chunk_no", "origin", "chunk", "piece", F.col("f.sentence").alias("sentence"), F.col("f.m.idx").alias("idx"), F.col("f.m.score").alias("score"), F.col("f.m.stage").alias("stage"))


def first_of_chunk(placed: DataFrame, by: list[str]) -> DataFrame:
    """(by..., chunk, idx, chunk_no): each chunk text once per group, where it first stands: by sentence, then by chunk. A
    minimum, not a window over the group's rows."""
    return placed.groupBy(*by, "chunk").agg(F.min(F.struct("idx", "chunk_no")).alias("f")).select(*by, "chunk", "f.idx", "f.chunk_no")


def sentence_counts(placed: DataFrame, key: str, criterion: str, annotator: str) -> DataFrame:
    """(key, criterion, idx, n_annotators, n_chunks, n_yes): distinct annotators and chunks that stand on each sentence; a chunk
    counts once per sentence, however many of its pieces match it. placed has (label) of the chunk's annotation."""
    once = placed.select(key, criterion, annotator, "chunk_no", "idx", "label").distinct()
    return once.groupBy(key, criterion, "idx").agg(F.countDistinct(annotator).alias("n_annotators"), F.count("*").alias("n_chunks"), F.count_if(F.col("label") == "YES").alias("n_yes"))


def binary_labels(hits: Column, panel: Column, chunks_: Column, yes: Column) -> Column:
    """struct of relevance and evidence by the three strategies, with their masks, for one sentence and criterion.

    hits: annotators whose text it is, of the panel's number; yes: chunks with label YES, of the chunks there. Without a panel all
    labels are 0 and masked. Evidence is masked, too, where the sentence isn't relevant by the same strategy. A sentence
    without chunks agrees with all of none (intersection), and its soft evidence is NULL.
    """
    none = F.coalesce(panel, F.lit(0)) == 0
    union, inter, soft = hits > 0, hits == panel, F.round(hits / panel, 6)
    out = {
        "rel_union": F.when(none, False).otherwise(union), "rel_inter": F.when(none, False).otherwise(inter), "rel_soft": F.when(none, 0.0).otherwise(soft),
        "ev_union": F.when(none, False).otherwise(yes > 0), "ev_inter": F.when(none, False).otherwise(yes == chunks_), "ev_soft": F.when(none, 0.0).when(chunks_ > 0, F.round(yes / chunks_, 6)),
        "rel_masked": none,
    }
    out |= {"ev_union_masked": none | ~out["rel_union"], "ev_inter_masked": none | ~out["rel_inter"], "ev_soft_masked": none | (out["rel_soft"] == 0)}
    return F.struct(*[v.alias(k) for k, v in out.items()])


def with_ignore(label: Column, masked: Column, ignore: int = -1) -> Column:
    """The label as a number, `ignore` where it is masked."""
    return F.when(masked, F.lit(ignore)).otherwise(label.cast("int"))


def merged_label(labels: Column) -> Column:
    """Aggregate: YES if any label is, else NO if any is, else UNCLEAR."""
    return F.when(F.bool_or(labels == "YES"), "YES").when(F.bool_or(labels == "NO"), "NO").otherwise("UNCLEAR")
