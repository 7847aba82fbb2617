"""Readers and writers of files: CSV snapshots, yearly parts, texts, JSON, XML, HTML, binaries, branches."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, drop_cut


def all_strings(path: str, spark: SparkSession, columns: Iterable[str] | None = None, fill: str | None = "", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """A CSV file of strings only; NULLs become fill (None: they stay); rows without any value are left out."""
    r = spark.read.option("header", header).option("encoding", encoding).option("multiLine", True).option("escape", '"')
    if columns:
        r = r.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = r.csv(path).na.drop("all")
    return df if fill is None else df.na.fill(fill)


def yearly(spark: SparkSession, paths: dict[str, str], column: str = "register_year") -> DataFrame:
    """CSV parts by year, with the year as a column; columns missing from a part are NULL."""
    out = None
    for year, path in sorted(paths.items()):
        part = all_strings(path, spark, fill=None).withColumn(column, F.lit(year))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df; an error at once, by a count per key, if a key stands on several rows."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"{key} is not unique")
    return df


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, md5, content) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", F.md5("content").alias("md5"), "content")


def joined_pages(pages: DataFrame, key: str, number: str, text: str, token: str = "\n----\n\n//\n\n----\n") -> DataFrame:
    """(key, text): pages in the order of their number, joined by the page token."""
    x = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("ps"))
    return x.select(key, F.array_join(F.transform("ps", lambda p: p["t"]), token).alias("text"))


def _element(e: ET.Element) -> object:
    if not len(e) and not e.attrib:
        return (e.text or "").strip()
    out: dict[str, object] = {}
    for c in e:
        k, v = c.tag.rsplit("}", 1)[-1], _element(c)
        if k in out:
            out[k] = [*out[k], v] if isinstance(out[k], list) else [out[k], v]
        else:
            out[k] = v
    return out | e.attrib


@F.pandas_udf(T.StringType())
def xml_as_json(xml: pd.Series) -> pd.Series:
    """JSON of an XML text: name spaces off, repeated children as lists, attributes over children, text of leaves; NULL if unreadable."""
    import json

    def one(x: str | None) -> str | None:
        try:
            root = ET.fromstring(x) if x else None
        except ET.ParseError:
            return None
        return None if root is None else json.dumps({root.tag.rsplit("}", 1)[-1]: _element(root)}, ensure_ascii=False)

    return xml.map(one)


def row_links(html: Column) -> Column:
    """The first link of each row of an HTML table that has one."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.filter(F.transform(rows, lambda r: F.regexp_extract(r, r"(?is)<a\s[^>]*?href=[\"']([^\"']+)[\"']", 1)), lambda a: a != "")


def numbered_folder(path: Column) -> Column:
    """The number that names the folder of a .pkl file; NULL for others."""
    return F.nullif(F.regexp_extract(path, r"/(\d+)/[^/]+\.pkl$", 1), F.lit("")).try_cast("long")


def wide_logs(logs: list[DataFrame], time: str) -> DataFrame:
    """Logs with columns of their own as one frame, NULL where a log lacks a column, in the order of time."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.orderBy(time)


def column_sets(frames: dict[str, DataFrame]) -> dict[str, list[str]]:
    """column -> the frames that lack it, for columns that not all frames have; empty where all have the same."""
    names = {c for f in frames.values() for c in f.columns}
    return {c: missing for c in sorted(names) if (missing := [k for k, f in frames.items() if c not in f.columns])}


def renamed(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """df with headers in lower case, blanks and signs as single underscores, then renamed by names."""
    plain = {c: re.sub(r"\W+", "_", c.strip()).strip("_").lower() for c in df.columns}
    return df.withColumnsRenamed({c: (names or {}).get(n, n) for c, n in plain.items()})


def in_all(sets: list[DataFrame]) -> DataFrame:
    """The rows that all of the sets have."""
    out = sets[0]
    for s in sets[1:]:
        out = out.intersect(s)
    return out


def links(html: Column, label: str = ".*?") -> Column:
    """Addresses of the links of an HTML text whose label matches."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<a\s[^>]*?href=[\"']([^\"']+)[\"'][^>]*>{label}</a>"), F.lit(1))


def headings(html: Column, level: int = 2) -> Column:
    """Texts of the headings of a level, without tags."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), F.lit(1)), lambda h: F.trim(F.regexp_replace(h, r"<[^>]+>", "")))


def list_column(c: Column, n: int) -> Column:
    """array<double> of a list written as text; n zeros for NULL and unreadable ones."""
    return F.coalesce(F.from_json(c, "array<double>"), F.array_repeat(F.lit(0.0), n))


def last_columns(df: DataFrame, n: int) -> DataFrame:
    """df with its last n columns as one array of labels."""
    return df.select(*df.columns[:-n], F.array(*[F.col(f"`{c}`").cast("int") for c in df.columns[-n:]]).alias("labels"))


def _states(spark: SparkSession, root: str, branch: str) -> tuple:
    jvm, path = spark._jvm, f"{root.rstrip('/')}/{branch}"
    now, new, old, older = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.before", f"{path}.older"))
    return now.getFileSystem(spark._jsc.hadoopConfiguration()), now, new, old, older


def read_branch(spark: SparkSession, root: str, branch: str = "main") -> DataFrame:
    """The branch's state; the one before where a writer was stopped between its renames."""
    fs, now, _, old, _ = _states(spark, root, branch)
    return spark.read.parquet(str(old if not fs.exists(now) and fs.exists(old) else now))


def write_branch(df: DataFrame, root: str, branch: str) -> str:
    """Write df as a new state of a branch; the earlier one stays beside it as <branch>.before.

    At every moment the branch or its earlier state is there whole: the state before that goes only once the new one is in place.
    """
    fs, now, new, old, older = _states(df.sparkSession, root, branch)
    df.write.mode("overwrite").parquet(str(new))
    if fs.exists(now):
        fs.delete(older, True)
        if fs.exists(old):
            fs.rename(old, older)
        fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(older, True)
    return str(now)


def restart_branch(spark: SparkSession, root: str, source: str, branch: str, defaults: dict[str, object]) -> DataFrame:
    """A branch made anew from another's state, with columns of defaults added."""
    write_branch(with_defaults(read_branch(spark, root, source), defaults), root, branch)
    return read_branch(spark, root, branch)


def replicated(value: Column, slots: Column) -> Column:
    """A single value for every place of the array it replaces; NULL leaves the array as it is."""
    return F.when(value.isNull(), slots).otherwise(F.array_repeat(value, F.size(slots)))


def overridden(rows: DataFrame, validated: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with the values of validated rows where there are any; a key has at most one validated row."""
    v = validated.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("validated"))
    x = rows.join(v, keys, "left").withColumn("validated", F.coalesce("validated", F.lit(False)))
    return x.select(*[F.when(F.col("validated"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns], "validated")


def append_checked(rows: DataFrame, error: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """Append the rows without an error to the table at path, and the others with their error to <path>.failed; (table, failed).
    Both parts come from one written table, so an expensive row is made once."""
    spark = rows.sparkSession
    checked = cut(rows.withColumn("error", error), "checked")
    checked.where("error IS NULL").drop("error").write.mode("append").parquet(path)
    checked.where("error IS NOT NULL").write.mode("append").parquet(f"{path}.failed")
    drop_cut(checked)
    return spark.read.schema(rows.schema).parquet(path), spark.read.schema(checked.schema).parquet(f"{path}.failed")


def add_columns(base: DataFrame, extra: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """base with the columns of extra by key, defaults where extra has no row."""
    x = base.join(extra, key, "left")
    return x.na.fill({k: v for k, v in defaults.items() if isinstance(v, (str, int, float, bool))})


def upsert(base: DataFrame, edits: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """base with the values of edits where they have one; keys only in edits are appended."""
    columns = list(columns)
    e = edits.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    x = base.join(e, key, "left")
    kept = x.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])
    return kept.unionByName(edits.join(base, key, "left_anti").select(key, *columns), allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema]).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_texts(df: DataFrame, key: str, text: str, path: str) -> None:
    """A file per key, in a folder <key>=..., with its text."""
    df.select(key, F.col(text).alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with missing columns as constants."""
    return df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})


def prefixed(df: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Only the columns whose names begin with one of the prefixes."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.startswith(prefixes)])
