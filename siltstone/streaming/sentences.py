"""Streaming forms: sentences of arriving texts, maxima per statement, scoring each sentence once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences_of


def sentence_stream(texts: DataFrame, key: str, text: str, source: str = "fitz") -> DataFrame:
    """(key, pos, sentence) of a stream of texts; needs no state."""
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(sentences_of(F.col(text), source)).alias("pos", "sentence"))


def statement_max_stream(scores: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """Largest score per (key, label), seeded with 0; for update or complete mode."""
    return scores.groupBy(key, label).agg(F.greatest(F.lit(0.0), F.max(F.col(score).cast("double"))).alias("score"))


def scored_once(sentences: DataFrame, keys: list[str], event_time: str, late: str = "1 day") -> DataFrame:
    """The first arrival of each key within the watermark; later copies are dropped."""
    return sentences.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, event_time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per kind and tumbling window; windows older than the watermark are final."""
    return events.withWatermark(event_time, late).groupBy(F.window(event_time, window), kind).agg(F.count("*").alias("n"))
