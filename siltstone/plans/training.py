"""Queries of the general training-data operators (problems 1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import readable_date
from ..operators.intervals import continuous_periods
from ..operators.packed import known_of, packed_values, unpack_fields
from ..sources.tables import table

FIELDS = ("countries", "industry_sectors", "entities", "trademarks")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of each packed field of each statement; of a statement's versions the last loaded counts."""
    known = known_of(table(spark, sf_dir, "known_values"))
    return unpack_fields(table(spark, sf_dir, "statements"), "statement_id", FIELDS, known, "loaded_at").select("statement_id", "field", "pos", "value")


def p3_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose piece had a malformed quotation, with their position."""
    known = known_of(table(spark, sf_dir, "known_values"))
    return unpack_fields(table(spark, sf_dir, "statements"), "statement_id", FIELDS, known, "loaded_at").where("malformed").select("statement_id", "field", "pos", "value")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous reporting periods and gaps of each entity."""
    s = table(spark, sf_dir, "statements").select("statement_id", "entities", "period_start", "period_end", "loaded_at")
    last = s.groupBy("statement_id").agg(F.max(F.struct("loaded_at", "entities", "period_start", "period_end")).alias("r")).select("statement_id", "r.*")
    dated = last.select("statement_id", "entities", readable_date(F.col("period_start")).alias("s"), readable_date(F.col("period_end")).alias("e")).where("s IS NOT NULL AND e IS NOT NULL AND s <= e")
    rows = dated.select("s", "e", F.explode(packed_values(F.col("entities"))).alias("v")).select(F.lower("v.value").alias("entity"), "s", "e")
    out = continuous_periods(rows, "entity", "s", "e")
    return out.select("entity", "kind", F.date_format("start_day", "yyyy-MM-dd").alias("start_day"), F.date_format("end_day", "yyyy-MM-dd").alias("end_day"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_malformed": p3_malformed}
SQL: dict[str, str] = {}
