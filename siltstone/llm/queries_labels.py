"""Queries of problems 2 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import unpack_fields
from ..sources.tables import table
from .components import components, split_records, star_edges
from .consensus import Consensus, krippendorff, latest_labels

ITEM = ["statement_id", "criterion", "sentence_idx"]
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = unpack_fields(table(spark, sf_dir, "statements"), "statement_id", ["entities", "trademarks"], version="loaded_at")
    return components(star_edges(values.select("statement_id", F.lower("value").alias("value")), "statement_id", "value"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that share a value of entities or trademarks, over any number of steps."""
    return _linked(spark, sf_dir).select(F.col("id").alias("statement_id"), F.col("component").alias("group_id"))


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train, validation or test of each statement; linked statements stay together."""
    return split_records(table(spark, sf_dir, "statements"), "statement_id", _linked(spark, sf_dir), SHARES).select("statement_id", F.col("component").alias("group_id"), "split")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = latest_labels(table(spark, sf_dir, "annotations"), ITEM, "annotator_id", "label", "last_update")
    return x.withColumnsRenamed({f"i{k}": c for k, c in enumerate(ITEM)})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose consensus is YES."""
    return Consensus(_labels(spark, sf_dir)).per_item().where("consensus = 'YES'").select(*ITEM)


def p7_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with at least one label: probability of YES, consensus, number of YES or NO votes."""
    return Consensus(_labels(spark, sf_dir)).per_item()


def p7_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each annotator's sensitivity and specificity with 95 % posterior intervals."""
    return Consensus(_labels(spark, sf_dir)).per_annotator().withColumnRenamed("annotator", "annotator_id")


def p7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's nominal alpha per criterion."""
    return krippendorff(_labels(spark, sf_dir), "criterion")


_LATEST = """
WITH l AS (
  SELECT statement_id, criterion, sentence_idx, annotator_id, last_update,
         CASE WHEN lower(trim(label)) IN ('yes','y','true','1') THEN 'YES'
              WHEN lower(trim(label)) IN ('no','n','false','0') THEN 'NO'
              WHEN lower(trim(label)) = 'unclear' THEN 'UNCLEAR' END AS label
  FROM annotations WHERE annotator_id IS NOT NULL),
f AS (
  SELECT statement_id, criterion, sentence_idx, annotator_id, label FROM l WHERE label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY statement_id, criterion, sentence_idx, annotator_id
                             ORDER BY last_update DESC NULLS LAST, label DESC) = 1)
"""

QUERIES = {"p2_found": p2_found, "p2_split": p2_split, "p7_found": p7_found, "p7_consensus": p7_consensus, "p7_reliability": p7_reliability, "p7_agreement": p7_agreement}
SQL = {
    "p7_agreement": _LATEST + """, per AS (
  SELECT criterion, count(*) AS m, count(*) FILTER (label='YES') AS y, count(*) FILTER (label='NO') AS n, count(*) FILTER (label='UNCLEAR') AS u
  FROM f GROUP BY statement_id, criterion, sentence_idx HAVING count(*) >= 2),
g AS (SELECT criterion, count(*) AS n_items, sum((m*(m-1) - y*(y-1) - n*(n-1) - u*(u-1))::DOUBLE / (m-1)) AS apart,
             sum(m)::DOUBLE AS t, sum(y)::DOUBLE AS y, sum(n)::DOUBLE AS n, sum(u)::DOUBLE AS u FROM per GROUP BY criterion)
SELECT criterion, n_items, CASE WHEN t*t - y*y - n*n - u*u > 0 THEN round(1 - apart / ((t*t - y*y - n*n - u*u) / (t-1)), 6) END AS alpha FROM g
""",
}
