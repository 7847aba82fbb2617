"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread, table
from .components import components
from .neardup import expanded, near_pairs


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a similarity of at least 0.6."""
    pairs, members = near_pairs(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", 0.6)
    return expanded(pairs, members, None).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are linked, directly or over others, with the smallest doc_id of their group."""
    pairs, members = near_pairs(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", 0.6)
    links = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(members.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    return components(links).select(F.col("id").alias("doc_id"), F.col("component").alias("group_id"))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
SQL: dict[str, str] = {}
