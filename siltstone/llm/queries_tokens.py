"""Queries of problems 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread, table
from .packing import fill_containers
from .pieces import cut_texts
from .tokens import encode_corpus

CAPACITY, LIMIT, OVERLAP = 4096, 512, 64


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text; NULL and empty texts have none."""
    return encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in containers of 4,096 tokens."""
    return fill_containers(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", CAPACITY)


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 512 tokens with an overlap of up to 64."""
    return cut_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", LIMIT, OVERLAP)


QUERIES = {"p8_ids": p8_ids, "p9_containers": p9_containers, "p10_pieces": p10_pieces}
SQL: dict[str, str] = {}
