"""Queries of readers and writers: every one writes a table's rows in some form and reads them again; the SQL says what must come back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import readable_date
from ..operators import samples as M
from ..operators.context import with_context
from ..session import shared_path
from ..sources import files as S
from ..sources.tables import table
from .reference import SQL as _SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_TEXTS = ("idx", "period_start", "statement_type", "countries", "trademarks", "entities", "industry_sectors", "link", "register_year")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT statement_id::VARCHAR AS statement_id, page_count::VARCHAR AS page_count, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _TEXTS) + " FROM statements")
def csv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the register as CSV, read as texts, nothing as the empty text."""
    path = shared_path(spark, "snapshot")
    S.write_csv(table(spark, sf_dir, "statements").select("statement_id", "page_count", *_TEXTS), path)
    return S.all_strings(path, spark)


@query("SELECT register_year, statement_id::VARCHAR AS statement_id, CASE WHEN register_year::INT % 2 = 1 THEN coalesce(nullif(link, ''), '') END AS link, count(*) AS n FROM (SELECT * FROM statements WHERE register_year IN ('2020', '2021', '2022', '2023')) GROUP BY ALL")
def yearly_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by year, of which some lack a column, put together with their year."""
    s = table(spark, sf_dir, "statements")
    paths = {}
    for y in ("2020", "2021", "2022", "2023"):
        paths[y] = shared_path(spark, f"year-{y}")
        S.write_csv(s.where(F.col("register_year") == y).select("statement_id", *(["link"] if int(y) % 2 else [])), paths[y])
    x = S.yearly(spark, paths)
    return x.groupBy("register_year", "statement_id", F.when(F.col("register_year").cast("int") % 2 == 1, F.coalesce("link", F.lit(""))).alias("link")).agg(F.count("*").alias("n"))


@query("SELECT statement_id::VARCHAR AS statement_id, criterion, annotator_id::VARCHAR AS annotator_id, coalesce(label, '') AS label, count(*) AS n FROM annotations GROUP BY ALL")
def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation files of texts only, NULL as the empty text."""
    path = shared_path(spark, "annotations")
    S.write_csv(table(spark, sf_dir, "annotations").select("statement_id", "criterion", "annotator_id", "label"), path)
    return S.all_strings(path, spark).groupBy("statement_id", "criterion", "annotator_id", "label").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT md5(fitz_text) AS digest, len(string_split(fitz_text, chr(10) || '----' || chr(10) || chr(10) || '//' || chr(10) || chr(10) || '----' || chr(10))) AS pages FROM raw_texts WHERE fitz_text IS NOT NULL")
def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into pages, and the pages joined in their order by the page token: the same texts again."""
    t = table(spark, sf_dir, "raw_texts").where("fitz_text IS NOT NULL").select("fitz_text").distinct().withColumn("k", F.md5("fitz_text"))
    pages = t.select("k", F.posexplode(F.split("fitz_text", r"\Q" + X.PAGE_TOKEN + r"\E")).alias("n", "page"))
    back = S.joined_pages(pages, "k", "n", "page")
    return back.join(pages.groupBy("k").agg(F.count("*").alias("pages")), "k").select(F.md5("text").alias("digest"), "pages")


@query("WITH t AS (SELECT statement_id, max(fitz_text) AS text FROM raw_texts WHERE fitz_text <> '' AND statement_id IS NOT NULL GROUP BY statement_id) SELECT statement_id, md5(text || chr(10)) AS digest, length(text) + 1 AS n FROM t ORDER BY md5('4:' || statement_id), statement_id LIMIT 5")
def exported_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of five statements as a file each, read as whole texts."""
    t = table(spark, sf_dir, "raw_texts").where("fitz_text <> '' AND statement_id IS NOT NULL").groupBy("statement_id").agg(F.max("fitz_text").alias("text"))
    path = shared_path(spark, "texts")
    S.write_texts(M.drawn(t, ["statement_id"], 5, 4), "statement_id", "text", path)
    w = S.whole_texts(spark, f"{path}/*")
    return w.select(F.regexp_extract("path", r"statement_id=(\d+)", 1).cast("int").alias("statement_id"), F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@query("WITH t AS (SELECT statement_id, max(fitz_text) AS text FROM raw_texts WHERE fitz_text <> '' AND statement_id IS NOT NULL GROUP BY statement_id) SELECT md5(text || chr(10)) AS md5, (strlen(text) + 1)::BIGINT AS length FROM t ORDER BY md5('4:' || statement_id), statement_id LIMIT 5")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and digests of files."""
    t = table(spark, sf_dir, "raw_texts").where("fitz_text <> '' AND statement_id IS NOT NULL").groupBy("statement_id").agg(F.max("fitz_text").alias("text"))
    path = shared_path(spark, "binaries")
    S.write_texts(M.drawn(t, ["statement_id"], 5, 4), "statement_id", "text", path)
    return S.binaries(spark, f"{path}/*", "*.txt").select("md5", "length")


@query("SELECT statement_id, coalesce(statement_type, '') AS kind, CASE WHEN page_count IS NULL THEN NULL ELSE '[\"' || page_count || '\",\"' || coalesce(image_count, 0) || '\"]' END AS counts, register_year AS year FROM statements")
def xml_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML with a name space, repeated children and attributes, as JSON."""
    a = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    year = F.when(F.col("register_year").isNull(), "").otherwise(F.concat(F.lit(" year='"), F.col("register_year"), F.lit("'")))
    pages = F.when(F.col("page_count").isNull(), "").otherwise(F.concat(F.lit("<c>"), a("page_count"), F.lit("</c><c>"), F.coalesce(F.col("image_count"), F.lit(0)).cast("string"), F.lit("</c>")))
    xml = F.concat(F.lit("<n:d xmlns:n='u'"), year, F.lit("><kind>"), a("statement_type"), F.lit("</kind>"), pages, F.lit("</n:d>"))
    x = table(spark, sf_dir, "statements").select("statement_id", S.xml_as_json(xml).alias("j"))
    return x.select("statement_id", F.get_json_object("j", "$.d.kind").alias("kind"), F.get_json_object("j", "$.d.c").alias("counts"), F.get_json_object("j", "$.d.year").alias("year"))


@query("SELECT statement_id, link, '/two/' || statement_id AS second, register_year = '2020' AS headed FROM statements WHERE link IS NOT NULL")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First links of the rows of a table, a link by its label, and headings, from HTML."""
    cell = F.concat(F.lit("<h2>Report <i>("), F.coalesce("register_year", F.lit("")), F.lit(")</i></h2><table><tr><th>x</th></tr><tr><td><a class='k' href='"), F.col("link"), F.lit("'>One</a> <a href=\"/other\">Other</a></td></tr><TR><td><a href='/two/"), F.col("statement_id").cast("string"), F.lit("'>Download</a></td></TR></table>"))
    h = table(spark, sf_dir, "statements").where("link IS NOT NULL").select("statement_id", "link", "register_year", cell.alias("h"))
    rows = S.row_links(F.col("h"))
    headed = F.exists(S.headings(F.col("h")), lambda t: F.contains(t, F.lit("(2020)")))
    return h.select("statement_id", F.get(rows, 0).alias("link"), F.when(F.get(rows, 1) == F.get(S.links(F.col("h"), "Download"), 0), F.get(rows, 1)).alias("second"), F.when(F.col("register_year").isNotNull(), headed).alias("headed"))


@query("SELECT statement_id, CASE WHEN statement_id % 3 = 0 THEN NULL ELSE statement_id END::BIGINT AS folder FROM (SELECT DISTINCT statement_id FROM statements)")
def numbered_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of folders that hold .pkl files, from paths."""
    s = table(spark, sf_dir, "statements").select("statement_id").distinct()
    path = F.concat(F.lit("/dump/"), F.col("statement_id").cast("string"), F.when(F.col("statement_id") % 3 == 0, "/a.json").otherwise("/a.pkl"))
    return s.select("statement_id", S.numbered_folder(path).alias("folder"))


@query("SELECT event_id, ts, CASE WHEN event_type = 'click' THEN round(value, 6) END AS loss, CASE WHEN event_type <> 'click' THEN round(value, 6) END AS accuracy FROM events")
def metric_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with columns of their own, written apart, as one frame in the order of time."""
    e, parts = table(spark, sf_dir, "events"), []
    for name, cond in (("loss", "event_type = 'click'"), ("accuracy", "event_type <> 'click'")):
        path = shared_path(spark, name)
        e.where(cond).select("event_id", "ts", F.round("value", 6).alias(name)).write.parquet(path)
        parts.append(spark.read.parquet(path))
    return S.wide_logs(parts, "ts")


@query("SELECT vec_id, array_to_string(list_transform(embedding[1:11], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), ',') AS labels FROM embeddings")
def last_label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV whose last eleven columns are labels."""
    path = shared_path(spark, "labels")
    S.write_csv(table(spark, sf_dir, "embeddings").select("vec_id", *[(F.get("embedding", F.lit(i)) > 0).cast("int").alias(f"c{i}") for i in range(11)]), path)
    return S.last_columns(S.all_strings(path, spark), 11).select(F.col("vec_id").cast("long").alias("vec_id"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(_SQL["context_window"])
def context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their context as CSV and back."""
    path = shared_path(spark, "context")
    S.write_csv(with_context(table(spark, sf_dir, "documents"), "doc_id", "sentences", 20), path)
    return S.all_strings(path, spark).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "sentence", "context")


@query("SELECT vec_id, round(sum(CASE WHEN label % 4 = 0 THEN 0 ELSE round(x::DOUBLE, 4) END) * 10000)::BIGINT AS total, count(*) AS n FROM (SELECT vec_id, label, unnest(embedding[1:11]) AS x FROM embeddings) GROUP BY vec_id")
def list_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written as text in a CSV and read as arrays; zeros where there is none."""
    path = shared_path(spark, "lists")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 4 != 0, F.transform(F.slice("embedding", 1, 11), lambda x: F.round(x.cast("double"), 4))).alias("predictions"))
    S.write_csv(e, path)
    x = S.all_strings(path, spark, fill=None).select(F.col("vec_id").cast("long").alias("vec_id"), S.list_column(F.col("predictions"), 11).alias("p"))
    return x.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) * 10000).cast("long").alias("total"), F.size("p").cast("long").alias("n"))


_BASE = "SELECT statement_id, criterion, max(annot1_pos_counts) AS n FROM agreement_stats GROUP BY ALL"


@query(f"WITH b AS ({_BASE}) SELECT statement_id, criterion, CASE WHEN statement_id % 5 = 0 THEN 99 ELSE n END AS n, '' AS last_update, CASE WHEN statement_id % 5 = 0 THEN '9,9' ELSE 'a,b' END AS slots FROM b")
def branch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch restarted from another with a column of defaults, edited by key and written again; a single value fills all slots."""
    root = shared_path(spark, "branches")
    base = table(spark, sf_dir, "agreement_stats").groupBy("statement_id", "criterion").agg(F.max("annot1_pos_counts").alias("n"))
    S.write_branch(base.withColumn("k", F.concat_ws("|", "statement_id", "criterion")).withColumn("slots", F.array(F.lit("a"), F.lit("b"))), root, "main")
    v = S.restart_branch(spark, root, "main", "validated", {"last_update": ""})
    edits = v.where("statement_id % 5 = 0").select("k", F.lit(99).cast("int").alias("n"))
    new = S.upsert(v, edits, "k", ["n"]).withColumn("slots", S.replicated(F.when(F.col("n") == 99, "9"), F.col("slots")))
    S.write_branch(new, root, "validated")
    return S.read_branch(spark, root, "validated").select("statement_id", "criterion", "n", "last_update", F.array_join("slots", ",").alias("slots"))


@query(f"WITH b AS ({_BASE}) SELECT statement_id, criterion, CASE WHEN statement_id % 4 = 0 THEN -1 ELSE n END AS n, statement_id % 4 = 0 AS validated FROM b")
def validated_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the values of validated rows in place of their own."""
    base = table(spark, sf_dir, "agreement_stats").groupBy("statement_id", "criterion").agg(F.max("annot1_pos_counts").alias("n"))
    return S.overridden(base, base.where("statement_id % 4 = 0").withColumn("n", F.lit(-1)), ["statement_id", "criterion"], ["n"])


@query("SELECT statement_id, link, CASE WHEN entities IS NULL OR entities = '' THEN 'no entity' WHEN page_count > 30 THEN 'too long' END AS error, count(*) AS n FROM statements GROUP BY ALL")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a table, those that fail to a table of failures with the reason."""
    s = table(spark, sf_dir, "statements").select("statement_id", "link", "entities", "page_count")
    error = F.when(F.coalesce("entities", F.lit("")) == "", "no entity").when(F.col("page_count") > 30, "too long")
    good, failed = S.append_checked(s, error, shared_path(spark, "appended"))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(failed).groupBy("statement_id", "link", "error").agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars::INT AS chars, doc_id IN (SELECT doc_id FROM annotations) AS kept FROM documents WHERE n_chars IS NOT NULL")
def ids_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written with thousands commas, with whether a table has them (semi-join) or not (anti-join)."""
    d = table(spark, sf_dir, "documents").where("n_chars IS NOT NULL").select(F.format_number("doc_id", 0).alias("id"), F.format_number("n_chars", 0).alias("chars"))
    x = d.select(X.id_with_commas(F.col("id")).cast("long").alias("doc_id"), X.id_with_commas(F.col("chars")).alias("chars"))
    a = table(spark, sf_dir, "annotations").select("doc_id").distinct()
    return x.join(a, "doc_id", "left_semi").withColumn("kept", F.lit(True)).unionByName(x.join(a, "doc_id", "left_anti").withColumn("kept", F.lit(False)))


@query("SELECT s.statement_id, coalesce(array_to_string(a.ls, ','), ',') AS labels, a.ls IS NOT NULL AS annotated FROM (SELECT DISTINCT statement_id FROM statements) s LEFT JOIN (SELECT statement_id, [coalesce(max(label) FILTER (annotator_idx = 0), ''), coalesce(max(label) FILTER (annotator_idx = 1), '')] AS ls FROM annotations GROUP BY statement_id) a USING (statement_id)")
def attached_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement with its annotators' labels as an array, an array of empty texts where it has none."""
    one = lambda i: F.coalesce(F.max(F.when(F.col("annotator_idx") == i, F.col("label"))), F.lit(""))
    a = table(spark, sf_dir, "annotations").groupBy("statement_id").agg(F.array(one(0), one(1)).alias("ls"))
    x = table(spark, sf_dir, "statements").select("statement_id").distinct().join(a, "statement_id", "left")
    return x.select("statement_id", F.array_join(F.coalesce("ls", F.array_repeat(F.lit(""), 2)), ",").alias("labels"), F.col("ls").isNotNull().alias("annotated"))


@query("SELECT statement_id, link AS address, coalesce(page_count, -1) AS pages, 0 AS word_total, NULL::VARCHAR AS comment FROM statements WHERE statement_id IS NOT NULL AND link IS NOT NULL")
def normalised_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in one form, rows without an id or address left out, missing columns by their type's default."""
    s = table(spark, sf_dir, "statements").select(F.col("statement_id").alias(" Statement ID"), F.col("link").alias("Web-Link"), F.coalesce("page_count", F.lit(-1)).alias("Page  Count"))
    x = S.renamed(s, {"web_link": "address", "page_count": "pages"}).na.drop(subset=["statement_id", "address"])
    return S.with_defaults(x, {"word_total": 0, "comment": None}).withColumn("comment", F.col("comment").cast("string"))


@query("SELECT 'annotator_id' AS name, 'documents' AS missing UNION ALL SELECT 'annotator_idx', 'documents' UNION ALL SELECT 'criterion', 'documents' UNION ALL SELECT 'extractor', 'annotations' UNION ALL SELECT 'label', 'documents' UNION ALL SELECT 'lang', 'annotations' UNION ALL SELECT 'last_update', 'documents' UNION ALL SELECT 'n_chars', 'annotations' UNION ALL SELECT 'processed_at', 'annotations' UNION ALL SELECT 'sentence_idx', 'documents' UNION ALL SELECT 'sentences', 'annotations' UNION ALL SELECT 'source', 'annotations' UNION ALL SELECT 'text', 'annotations'")
def column_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that not all of the given tables have, and which lack them."""
    found = S.column_sets({t: table(spark, sf_dir, t) for t in ("documents", "annotations")})
    return spark.createDataFrame([(c, ",".join(m)) for c, m in found.items()], "name string, missing string")


@query("SELECT statement_id, list_position(['metadata', 'other'], 'metadata') = 1 AS meta, count(*) AS n FROM statements GROUP BY ALL")
def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns of one prefix: the scan reads no other."""
    s = table(spark, sf_dir, "statements").withColumnsRenamed({"link": "metadata/link", "statement_id": "metadata/id"})
    m = S.prefixed(s, ("metadata",))
    return m.groupBy(F.col("`metadata/id`").alias("statement_id"), F.lit(len(m.columns) == 2).alias("meta")).agg(F.count("*").alias("n"))


@query("SELECT statement_id, min(d) AS first_day, max(d) AS last_day FROM (SELECT statement_id, try_strptime(period_start, '%Y-%m-%d')::DATE AS d FROM statements WHERE regexp_matches(period_start, '^\\d{4}-\\d{2}-\\d{2}$')) GROUP BY statement_id")
def period_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last readable day of each statement, in ISO notation."""
    s = table(spark, sf_dir, "statements").where(F.col("period_start").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return s.groupBy("statement_id").agg(F.min(readable_date(F.col("period_start"))).alias("first_day"), F.max(readable_date(F.col("period_start"))).alias("last_day"))
