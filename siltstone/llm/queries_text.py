"""Queries of problems 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread, table
from .scans import ScanRepair
from .sentences import sentence_units


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of the texts that were extracted from born-digital documents."""
    return sentence_units(spread(table(spark, sf_dir, "documents").where(F.col("extractor").isin("fitz", "abbyy")).select("doc_id", "text")), "doc_id", "text")


def p5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every text."""
    return sentence_units(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def _repair(spark: SparkSession, sf_dir: str) -> ScanRepair:
    raw = table(spark, sf_dir, "raw_texts").select(F.lit("raw_texts").alias("origin"), F.col("statement_id").cast("long").alias("id"), F.col("fitz_text").alias("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "extractor")
    scans = docs.where("extractor = 'scan'").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text").unionByName(raw)
    words = docs.select("text", F.coalesce(F.col("extractor") == "scan", F.lit(False)).alias("scan")).unionByName(raw.select("text", F.lit(True).alias("scan")))
    return ScanRepair(spread(scans), words)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture lines, divided words and misread words of all scans."""
    return _repair(spark, sf_dir).found()


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous paragraphs of all scans."""
    return _repair(spark, sf_dir).paragraphs()


QUERIES = {"p4_found": p4_found, "p4_paragraphs": p4_paragraphs, "p5_found": p5_found, "p5_units": p5_units}
SQL: dict[str, str] = {}
