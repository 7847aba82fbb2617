"""Queries of the document-analytics operators over the standing tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import criteria as C
from ..functions import text as X
from ..operators.clusters import clusters
from ..operators.context import first_context, plain_context, with_context
from ..operators.match import best_match, matched
from ..operators.metrics import averages, confusion, scores
from ..operators.rank import ranked
from ..operators.splits import dealt
from ..session import cut
from ..sources.files import in_all
from ..sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def both(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query whose SQL is the same in both engines: {t} stands for table t."""
    import re

    tables = set(re.findall(r"\{(\w+)\}", spark_sql or sql))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql((spark_sql or sql).format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in tables}))

    QUERIES[name] = run
    SQL[name] = sql.format(**{t: t for t in set(re.findall(r"\{(\w+)\}", sql))})


# --- text engine: abbreviations, separators, clean-up, sentences ---------------------------------------------------------

_q = lambda s: s.replace("'", "''")
_undot = lambda t, p: f"list_aggregate(list_transform(range(1, len(string_split_regex({t}, '{_q(p)}')) + 1), lambda i: string_split_regex({t}, '{_q(p)}')[i] || coalesce(replace(regexp_extract_all({t}, '{_q(p)}')[i], '.', ''), '')), 'string_agg', '')"
_WS = r"[ \t\n\f\r\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# A year from 2015 to the next one, as a whole word, keeps its place; other leading numbers go.
_KEPT_YEAR = "^[.(-]?(" + "|".join(str(y) for y in range(2015, date.today().year + 2)) + ")([^0-9A-Za-z_]|$)"
_NUMBERED = r"^[.(-]?[0-9]+([.-][0-9]*)*[)]?"


def engine_sql(source: str, columns: str, separator: str, p: str = "", by: str = "doc_id") -> str:
    """CTEs {p}a ... {p}sent (columns, pos, sentence) over the rows of source, whose text is t."""
    split = f"string_split_regex(t, '{_q(separator)}')"
    return f"""{p}a AS ({source}),
{p}b AS (SELECT {columns}, {_undot("t", X.NEVER_PATTERN)} AS t FROM {p}a),
{p}c AS (SELECT {columns}, {_undot("t", X.MAY_PATTERN)} AS t FROM {p}b),
{p}d AS (SELECT {columns}, unnest({split}) AS s, generate_subscripts({split}, 1) AS i FROM {p}c),
{p}e AS (SELECT {columns}, i, CASE WHEN regexp_matches(s, '{_KEPT_YEAR}') THEN s ELSE regexp_replace(s, '{_NUMBERED}', '') END AS s FROM {p}d),
{p}f AS (SELECT {columns}, i, regexp_replace(s, '[^\\x{{00}}-\\x{{7F}}]', '', 'g') AS s FROM {p}e),
{p}g AS (SELECT {columns}, i, regexp_replace(s, '^{_WS}*[.,;:!?"]+{_WS}*', '') AS s FROM {p}f),
{p}h AS (SELECT {columns}, i, regexp_replace(s, '{_WS}*[.,;:!?"]+{_WS}*$', '') AS s FROM {p}g),
{p}k AS (SELECT {columns}, i, trim(regexp_replace(s, '{_WS}+', ' ', 'g')) AS sentence FROM {p}h),
{p}sent AS (SELECT {columns}, row_number() OVER (PARTITION BY {by} ORDER BY i) - 1 AS pos, sentence FROM {p}k WHERE regexp_matches(sentence, '\\b\\w{{2,}}\\b'))
"""


_SENTENCES = "WITH " + engine_sql("SELECT doc_id, lang, text AS t FROM documents WHERE text IS NOT NULL", "doc_id, lang", X.SEPARATORS["fitz"])


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", "text"))
    return d.select("doc_id", "lang", F.posexplode(X.sentences_of(F.col("text"))).alias("pos", "sentence"))


@query(_SENTENCES + "SELECT doc_id, pos, sentence FROM sent")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(_SENTENCES + "SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_sentences, min(n) AS min_words, max(n) AS max_words, round(avg(n), 6) AS avg_words FROM (SELECT *, len(string_split(sentence, ' ')) AS n FROM sent) GROUP BY lang")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sentences(spark, sf_dir).withColumn("n", X.word_count(F.col("sentence")).cast("long"))
    per = s.groupBy("lang", "doc_id").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("sum"))
    return per.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("k").alias("n_sentences"), F.min("lo").alias("min_words"), F.max("hi").alias("max_words"), F.round(F.sum("sum") / F.sum("k"), 6).alias("avg_words"))


@query("SELECT doc_id, i - 1 AS pos, s AS sentence, len(string_split(s, ' ')) AS n_words FROM (SELECT doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM documents)")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", X.word_count(F.col("sentence")).cast("long").alias("n_words"))


@query("SELECT statement_id, s AS sentence FROM (SELECT statement_id, unnest(sentences) AS s FROM documents) GROUP BY statement_id, s HAVING count(*) = 1")
def dedup_all_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of a repeated sentence of a statement go: a count before, not a window over, its rows."""
    d = table(spark, sf_dir, "documents").select("statement_id", F.explode("sentences").alias("sentence"))
    return d.groupBy("statement_id", "sentence").agg(F.count("*").alias("n")).where("n = 1").drop("n")


@query("""
WITH s AS (SELECT doc_id, sentences AS s, string_split(array_to_string(sentences, '. '), ' ') AS w FROM documents WHERE len(sentences) > 0),
e AS (SELECT doc_id, i - 1 AS pos, s[i] AS sentence, w, len(s) AS n,
             CASE WHEN i = 1 THEN 0 ELSE len(string_split(array_to_string(s[1:i-1], '. '), ' ')) END AS st, len(string_split(s[i], ' ')) AS k
      FROM (SELECT doc_id, s, w, unnest(range(1, len(s) + 1)) AS i FROM s))
SELECT doc_id, pos, sentence,
       trim((CASE WHEN pos > 0 THEN array_to_string(list_concat(w[greatest(1, st - 8):st], ['']), ' ') || ' ' ELSE '' END) || '[L] ' || sentence || ' [R]' ||
            array_to_string(list_concat(['.'], CASE WHEN st + k < len(w) THEN w[st + k + 1:st + k + 9] ELSE [''] END), ' '), ' ') AS context
FROM e
""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 words around each sentence."""
    return with_context(table(spark, sf_dir, "documents"), "doc_id", "sentences", 20).withColumn("pos", F.col("pos").cast("long"))


_PIECES = lambda a, b: f"list_filter(string_split_regex(array_to_string(s[{a}:{b}], '. '), '\\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, i - 1 AS pos, trim(array_to_string(b[greatest(1, len(b) - 8):], ' ') || '.  [L] ' || s[i] || ' [R]. ' || array_to_string(a[1:9], ' '), ' ') AS context FROM (SELECT doc_id, s, i, {_PIECES('greatest(1, i - 9)', 'i - 1')} AS b, {_PIECES('i + 1', 'i + 10')} AS a FROM (SELECT doc_id, sentences AS s, unnest(range(1, len(sentences) + 1)) AS i FROM documents WHERE len(sentences) > 0))")
def context_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("size(sentences) > 0")
    return d.select("doc_id", F.posexplode(plain_context(F.col("sentences"), 20)).alias("pos", "context")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT doc_id, i - 1 AS pos, trim(array_to_string(b[greatest(1, len(b) - 9):], ' ') || ' [L] ' || s || ' [R]' || array_to_string(a[1:10], ' '), ' ') AS context FROM (SELECT doc_id, i, s, string_split(f[1:instr(f, s) - 1], ' ') AS b, string_split(f[instr(f, s) + length(s):], ' ') AS a FROM (SELECT doc_id, i, sentences[i] AS s, array_to_string(sentences, '. ') AS f FROM (SELECT doc_id, sentences, unnest(range(1, len(sentences) + 1)) AS i FROM documents WHERE len(sentences) > 0)))")
def context_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("size(sentences) > 0")
    return d.select("doc_id", F.posexplode(first_context(F.col("sentences"), 20)).alias("pos", "context")).withColumn("pos", F.col("pos").cast("long"))


_CUT = rf"\.?{_WS}*//{_WS}*(?:[.\x{{2022}}-]{_WS}*)?"
_PARTS = lambda t: f"list_transform(string_split_regex(regexp_replace({t}, '(http:|https:|ftp:)//', '\\1~SLASHES~', 'g'), '{_CUT}'), lambda x: replace(x, '~SLASHES~', '//'))"
_ORIGIN = lambda t: f"CASE WHEN regexp_matches({t}, '^\\s*fig\\.p\\d+\\.\\s*') THEN 'infographic' WHEN regexp_matches({t}, '^\\s*tab\\.p\\d+\\.\\s*') THEN 'table' ELSE 'main_body' END"
_BARE = lambda t: f"regexp_replace({t}, '^\\s*(fig|tab)\\.p\\d+\\.\\s*', '')"


@query(f"SELECT doc_id, i - 1 AS part, {_ORIGIN('s')} AS origin, {_BARE('s')} AS body FROM (SELECT doc_id, unnest({_PARTS('text')}) AS s, generate_subscripts({_PARTS('text')}, 1) AS i FROM documents WHERE text IS NOT NULL)")
def excerpt_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every text at // (not that of an address), with where they come from and without their prefix."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.excerpt_parts(F.col("text"))).alias("part", "s"))
    return d.select("doc_id", F.col("part").cast("long").alias("part"), X.excerpt_origin(F.col("s")).alias("origin"), X.without_prefix(F.col("s")).alias("body"))


@query("SELECT statement_id, CASE WHEN regexp_matches(link, '/(\\d+)/?$') THEN regexp_extract(link, '/(\\d+)/?$', 1)::INT END AS link_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(entities, '[\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]', ' ', 'g')), '[^\\x{00}-\\x{7F}]', '', 'g')), '[^\\w\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug, md5(coalesce(entities, '')) AS digest, string_split(statement_type, ' ')[1] AS main_type FROM statements")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "statements").select("statement_id", X.id_of_link(F.col("link")).alias("link_id"), X.slug(F.col("entities")).alias("slug"), F.md5(F.coalesce("entities", F.lit(""))).alias("digest"), F.split_part("statement_type", F.lit(" "), F.lit(1)).alias("main_type"))


both("composite_ids", "SELECT DISTINCT statement_id, sentence_idx, {fmt} AS sample_id FROM {annotations}".replace("{fmt}", "concat('statement', lpad(CAST(statement_id AS VARCHAR), 5, '0'), ':sentence', lpad(CAST(sentence_idx AS VARCHAR), 5, '0'))"), "SELECT DISTINCT statement_id, sentence_idx, format_string('statement%05d:sentence%05d', statement_id, sentence_idx) AS sample_id FROM {annotations}")


@query("SELECT doc_id, i - 1 AS pos, s AS sentence FROM (SELECT doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM documents) WHERE regexp_matches(lower(s), '" + "|".join(X.FUTURE) + "')")
def evidence_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))
    return d.where(X.about_future(F.col("sentence"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query("SELECT vec_id, round(p, 5) AS pos, round(n, 5) AS neg, (p - n > 0.15)::INT AS prediction, round(CASE WHEN p - n > 0.15 THEN p / (p + n) ELSE n / (p + n) END, 5) AS confidence FROM (SELECT vec_id, 1 / (1 + exp(-embedding[1]::DOUBLE)) AS p, 1 / (1 + exp(-embedding[2]::DOUBLE)) AS n FROM embeddings)")
def evidence_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = lambda i: 1 / (1 + F.exp(-F.get("embedding", F.lit(i)).cast("double")))
    p, n = sig(0), sig(1)
    yes = p - n > 0.15
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(p, 5).alias("pos"), F.round(n, 5).alias("neg"), yes.cast("int").alias("prediction"), F.round(F.when(yes, p / (p + n)).otherwise(n / (p + n)), 5).alias("confidence"))


# --- matching ------------------------------------------------------------------------------------------------------------

_MATCH = _SENTENCES + """, ex AS (SELECT doc_id, i - 1 AS part, s AS excerpt FROM (SELECT doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM documents) WHERE s <> ''),
m1 AS (SELECT ex.doc_id, part, excerpt, min(pos) AS matched_idx FROM ex JOIN sent ON sent.doc_id = ex.doc_id AND sentence = excerpt GROUP BY ALL),
r1 AS (SELECT * FROM ex ANTI JOIN m1 USING (doc_id, part)),
m2 AS (SELECT r1.doc_id, part, excerpt, min(pos) AS matched_idx FROM r1 JOIN sent ON sent.doc_id = r1.doc_id AND contains(sentence, excerpt) GROUP BY ALL)
"""


def _excerpts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "documents").select("doc_id", F.posexplode("sentences").alias("part", "excerpt")).where("excerpt <> ''")
    s = _sentences(spark, sf_dir).select("doc_id", F.col("pos").alias("idx"), "sentence")
    return e, s


@query(_MATCH + "SELECT doc_id, part, excerpt, matched_idx, 1.0::DOUBLE AS score, 'exact' AS stage FROM m1 UNION ALL SELECT doc_id, part, excerpt, matched_idx, 0.999::DOUBLE, 'inside' FROM m2")
def passage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the earlier splitter found, exactly or inside, among the sentences of their text: within the text's own row."""
    d = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL AND size(sentences) > 0").select("doc_id", "text", "sentences"))
    one = lambda p: F.transform(p["e"], lambda e: F.struct(e.alias("excerpt"), F.when(e != "", best_match(p["s"], e, 2.0)).alias("m")))
    pairs = F.transform(F.array(F.struct(X.sentences_of(F.col("text")).alias("s"), F.col("sentences").alias("e"))), one)
    m = d.select("doc_id", F.posexplode(F.get(pairs, 0)).alias("part", "x")).where("x.m IS NOT NULL")
    return m.select("doc_id", F.col("part").cast("long").alias("part"), F.col("x.excerpt").alias("excerpt"), F.col("x.m.idx").cast("long").alias("matched_idx"), F.col("x.m.score").alias("score"), F.col("x.m.stage").alias("stage"))


@query()
def passage_match_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three stages; every excerpt of a text with sentences has its nearest one, whatever the score."""
    return matched(*_excerpts(spark, sf_dir), "doc_id")


# --- joins and sets ------------------------------------------------------------------------------------------------------

_META = ("period_start", "period_end", "statement_type", "submitted_at", "published_at", "countries", "trademarks", "annual_revenue", "entities", "link", "industry_sectors", "register_year")
_FILLED = ", ".join(f"coalesce({c}, 'n/a') AS {c}" for c in _META)


@query(f"WITH x AS (SELECT statement_id, loaded_at, {_FILLED} FROM statements), a AS (SELECT {', '.join(_META)}, max(statement_id) AS s FROM x GROUP BY ALL) SELECT x.statement_id, a.s AS global_id, count(*) AS n FROM x JOIN a USING ({', '.join(_META)}) GROUP BY ALL")
def meta_multikey_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "statements").select("statement_id", *_META).na.fill("n/a")
    a = x.groupBy(*_META).agg(F.max("statement_id").alias("global_id"))
    return x.join(a, list(_META)).groupBy("statement_id", "global_id").agg(F.count("*").alias("n"))


both(
    "fallback_link_join",
    "WITH s AS (SELECT DISTINCT statement_id, CAST(nullif(regexp_extract(link, '/(\\d+)/?$', 1), '') AS INT) AS link_id FROM {statements}), r AS (SELECT DISTINCT statement_id FROM {raw_texts}), direct AS (SELECT s.statement_id, s.statement_id AS text_id, 'id' AS how FROM s JOIN r ON s.statement_id = r.statement_id), rest AS (SELECT s.* FROM s LEFT JOIN r ON s.statement_id = r.statement_id WHERE r.statement_id IS NULL) SELECT * FROM direct UNION ALL SELECT rest.statement_id, r.statement_id, 'link' FROM rest JOIN r ON rest.link_id = r.statement_id",
    "WITH s AS (SELECT DISTINCT statement_id, CAST(nullif(regexp_extract(link, '/(\\\\d+)/?$', 1), '') AS INT) AS link_id FROM {statements}), r AS (SELECT DISTINCT statement_id FROM {raw_texts}), direct AS (SELECT s.statement_id, s.statement_id AS text_id, 'id' AS how FROM s JOIN r ON s.statement_id = r.statement_id), rest AS (SELECT s.* FROM s LEFT ANTI JOIN r ON s.statement_id = r.statement_id) SELECT * FROM direct UNION ALL SELECT rest.statement_id, r.statement_id, 'link' FROM rest JOIN r ON rest.link_id = r.statement_id",
)
both("statements_with_text", "SELECT DISTINCT statement_id FROM {statements} WHERE statement_id IN (SELECT statement_id FROM {raw_texts} WHERE statement_id IS NOT NULL)")
both("skipped_statements", "SELECT DISTINCT s.statement_id FROM {statements} s LEFT JOIN {raw_texts} r ON s.statement_id = r.statement_id WHERE r.statement_id IS NULL")
both("attach_default", "SELECT s.statement_id, coalesce(a.n, 0) AS n_labels FROM (SELECT DISTINCT statement_id FROM {statements}) s LEFT JOIN (SELECT statement_id, count(*) AS n FROM {annotations} GROUP BY statement_id) a ON s.statement_id = a.statement_id")
both("ids_with_commas", "SELECT doc_id, CAST(replace(format('{{:,}}', n_chars), ',', '') AS INT) AS n_chars FROM {documents} WHERE n_chars IS NOT NULL", "SELECT doc_id, CAST(replace(format_number(n_chars, 0), ',', '') AS INT) AS n_chars FROM {documents} WHERE n_chars IS NOT NULL")
both("anti_cache", "SELECT DISTINCT a.statement_id, a.sentence_idx FROM {annotations} a WHERE NOT EXISTS (SELECT 1 FROM {annotations} p WHERE p.statement_id = a.statement_id AND p.sentence_idx = a.sentence_idx AND p.annotator_idx = 0)")
both("text_lookup", "SELECT DISTINCT a.doc_id, a.sentence_idx, {get} AS sentence FROM {annotations} a JOIN {documents} d ON a.doc_id = d.doc_id".replace("{get}", "d.sentences[a.sentence_idx + 1]"), "SELECT DISTINCT a.doc_id, a.sentence_idx, get(d.sentences, a.sentence_idx) AS sentence FROM {annotations} a JOIN {documents} d ON a.doc_id = d.doc_id")
both("extractor_pairs", "SELECT a.statement_id, a.n AS fitz_chars, b.n AS abbyy_chars FROM (SELECT statement_id, sum(n_chars) AS n FROM {documents} WHERE extractor = 'fitz' GROUP BY statement_id) a JOIN (SELECT statement_id, sum(n_chars) AS n FROM {documents} WHERE extractor = 'abbyy' GROUP BY statement_id) b ON a.statement_id = b.statement_id")
both("union_distinct_ids", "SELECT statement_id FROM {statements} UNION SELECT statement_id FROM {documents} UNION SELECT statement_id FROM {annotations}")
@query("SELECT statement_id FROM annotations INTERSECT SELECT statement_id FROM documents INTERSECT SELECT statement_id FROM agreement_stats INTERSECT SELECT statement_id FROM raw_texts")
def nway_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that four tables have."""
    return in_all([table(spark, sf_dir, t).select("statement_id") for t in ("annotations", "documents", "agreement_stats", "raw_texts")])


both("unused_ids", "SELECT statement_id FROM {statements} EXCEPT SELECT statement_id FROM {annotations}")
both("symmetric_difference", "SELECT statement_id, 'statements' AS only_in FROM (SELECT statement_id FROM {statements} EXCEPT SELECT statement_id FROM {documents}) x UNION ALL SELECT statement_id, 'documents' FROM (SELECT statement_id FROM {documents} EXCEPT SELECT statement_id FROM {statements}) y")
both("appended_sources", "SELECT source_table, count(*) AS n, count(DISTINCT statement_id) AS n_ids FROM (SELECT 'documents' AS source_table, statement_id FROM {documents} UNION ALL SELECT 'raw_texts', statement_id FROM {raw_texts}) u GROUP BY source_table")
both("gold_flag", "SELECT d.doc_id, CASE WHEN g.statement_id IS NOT NULL THEN 1 ELSE 0 END AS gold FROM {documents} d LEFT JOIN (SELECT statement_id FROM {annotations} GROUP BY statement_id HAVING count(DISTINCT annotator_id) >= 3) g ON d.statement_id = g.statement_id")

# --- annotation rows and labels --------------------------------------------------------------------------------------------

_L = "CASE WHEN trim(label) IN ('" + "','".join(C.YES) + "') THEN 'YES' WHEN trim(label) IN ('" + "','".join(C.NO) + "') THEN 'NO' WHEN trim(label) IN ('" + "','".join(C.UNCLEAR) + "') THEN 'UNCLEAR' END"
_AN = f"WITH an AS (SELECT statement_id, criterion, sentence_idx, annotator_idx, annotator_id, {_L} AS l, last_update FROM annotations)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annotations").select("statement_id", "criterion", "sentence_idx", "annotator_idx", "annotator_id", C.label(F.col("label")).alias("l"), "last_update")


@query(_AN + " SELECT criterion, l AS label, count(*) AS n FROM an GROUP BY ALL")
def label_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("criterion", F.col("l").alias("label")).agg(F.count("*").alias("n"))


_ERROR = "CASE WHEN label IS NULL THEN 'no label' WHEN trim(label) = '' THEN 'blank label' WHEN l IS NULL THEN 'unknown label' WHEN sentence_idx < 0 THEN 'no sentence' WHEN annotator_id IS NULL THEN 'no annotator' END"


@query(f"WITH an AS (SELECT *, {_L} AS l FROM annotations), e AS (SELECT *, {_ERROR} AS error FROM an) SELECT statement_id, criterion, count(*) AS n, count(error) AS n_bad, arg_min(error, list_position(['no label', 'blank label', 'unknown label', 'no sentence', 'no annotator'], error)) AS first_error FROM e GROUP BY ALL HAVING count(error) > 0")
def first_error_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups (statement, criterion) that one bad row rejects, with the first rule, in their order, that one of its rows breaks."""
    a = table(spark, sf_dir, "annotations").withColumn("l", C.label(F.col("label")))
    rules = {"no label": F.col("label").isNull(), "blank label": F.trim("label") == "", "unknown label": F.col("l").isNull(), "no sentence": F.col("sentence_idx") < 0, "no annotator": F.col("annotator_id").isNull()}
    e = F.coalesce(*[F.when(c, F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"))) for k, (m, c) in enumerate(rules.items())])
    return a.withColumn("error", e).groupBy("statement_id", "criterion").agg(F.count("*").alias("n"), F.count("error").alias("n_bad"), F.min("error")["m"].alias("first_error")).where("n_bad > 0")


@query(_AN + ", bad AS (SELECT statement_id, criterion FROM an GROUP BY ALL HAVING bool_or(l IS NULL)) SELECT statement_id, criterion, count(*) AS n FROM an ANTI JOIN bad USING (statement_id, criterion) GROUP BY ALL")
def valid_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("statement_id", "criterion").agg(F.count("*").alias("n"), F.bool_or(F.col("l").isNull()).alias("bad")).where("NOT bad").drop("bad")


_VOTES = _AN + """, lat AS (SELECT * FROM an WHERE l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY statement_id, criterion, sentence_idx, annotator_idx ORDER BY last_update DESC, l DESC) = 1),
panel AS (SELECT statement_id, criterion, count(DISTINCT annotator_idx) AS n_annotators FROM lat GROUP BY ALL),
v AS (SELECT statement_id, criterion, sentence_idx, count(*) AS n_labels, count(*) FILTER (l = 'YES') AS n_yes, count(*) FILTER (l = 'NO') AS n_no, count(*) FILTER (l = 'UNCLEAR') AS n_unclear FROM lat GROUP BY ALL)"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _labelled(spark, sf_dir).where("l IS NOT NULL")
    return a.groupBy("statement_id", "criterion", "sentence_idx", "annotator_idx").agg(F.max(F.struct("last_update", "l")).alias("r")).select("statement_id", "criterion", "sentence_idx", "annotator_idx", "r.l")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("l") == k)
    return _latest(spark, sf_dir).groupBy("statement_id", "criterion", "sentence_idx").agg(F.count("*").alias("n_labels"), n("YES").alias("n_yes"), n("NO").alias("n_no"), n("UNCLEAR").alias("n_unclear"))


@query(_VOTES + " SELECT statement_id, criterion, sentence_idx, n_yes > 0 AS hard_union, n_yes = n_annotators AS hard_intersection, round(n_yes::DOUBLE / n_annotators, 6) AS soft, n_labels = 0 AS dont_care FROM v JOIN panel USING (statement_id, criterion)")
def sentence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by the three strategies: any, all, share of the panel."""
    panel = _latest(spark, sf_dir).groupBy("statement_id", "criterion").agg(F.countDistinct("annotator_idx").alias("k"))
    v = _votes(spark, sf_dir).join(panel, ["statement_id", "criterion"])
    return v.select("statement_id", "criterion", "sentence_idx", (F.col("n_yes") > 0).alias("hard_union"), (F.col("n_yes") == F.col("k")).alias("hard_intersection"), F.round(F.col("n_yes") / F.col("k"), 6).alias("soft"), (F.col("n_labels") == 0).alias("dont_care"))


@query(_VOTES + " SELECT statement_id, criterion, sentence_idx, CASE WHEN n_yes > 0 THEN 'YES' WHEN n_no > 0 THEN 'NO' ELSE 'UNCLEAR' END AS merged FROM v")
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).select("statement_id", "criterion", "sentence_idx", F.when(F.col("n_yes") > 0, "YES").when(F.col("n_no") > 0, "NO").otherwise("UNCLEAR").alias("merged"))


_POS = "list_position(['" + "','".join(C.CRITERIA) + "'], criterion) - 1"


@query(_VOTES + f" SELECT statement_id, {_POS} AS class_idx, greatest(0, max((n_yes > 0)::INT)) AS target, max(round(n_yes::DOUBLE / n_labels, 6)) AS prediction FROM v GROUP BY ALL")
def statement_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement-level maxima per class, seeded with 0."""
    v = _votes(spark, sf_dir).withColumn("class_idx", C.position(F.col("criterion")))
    return v.groupBy("statement_id", "class_idx").agg(F.greatest(F.lit(0), F.max((F.col("n_yes") > 0).cast("int"))).alias("target"), F.max(F.round(F.col("n_yes") / F.col("n_labels"), 6)).alias("prediction"))


@query(_VOTES + " SELECT statement_id, criterion, annotator_idx, string_agg(sentence_idx || '=' || l, ',' ORDER BY sentence_idx) AS labels FROM lat GROUP BY ALL")
def group_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each annotator's labels of a statement and criterion, in the order of its sentences."""
    x = _latest(spark, sf_dir).groupBy("statement_id", "criterion", "annotator_idx").agg(F.array_sort(F.collect_list(F.struct("sentence_idx", "l"))).alias("x"))
    return x.select("statement_id", "criterion", "annotator_idx", F.array_join(F.transform("x", lambda e: F.concat_ws("=", e["sentence_idx"], e["l"])), ",").alias("labels"))


@query(_VOTES + " SELECT statement_id, criterion, sentence_idx, string_agg(annotator_idx || '=' || l, ',' ORDER BY annotator_idx) AS labels FROM lat GROUP BY ALL")
def group_collect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of every sentence by its annotators, in their order."""
    x = _latest(spark, sf_dir).groupBy("statement_id", "criterion", "sentence_idx").agg(F.array_sort(F.collect_list(F.struct("annotator_idx", "l"))).alias("x"))
    return x.select("statement_id", "criterion", "sentence_idx", F.array_join(F.transform("x", lambda e: F.concat_ws("=", e["annotator_idx"], e["l"])), ",").alias("labels"))


both("uniform_multiplicity", "SELECT criterion, min(n) = max(n) AS uniform, min(n) AS least, max(n) AS most FROM (SELECT criterion, statement_id, count(DISTINCT annotator_idx) AS n FROM {annotations} GROUP BY criterion, statement_id) x GROUP BY criterion")
both("annotation_counts", "SELECT statement_id, criterion, count(*) AS n, count(DISTINCT annotator_idx) AS n_annotators FROM {annotations} GROUP BY statement_id, criterion")
both("fully_labelled", "SELECT statement_id FROM (SELECT statement_id, criterion, count(DISTINCT annotator_idx) AS n FROM {annotations} GROUP BY statement_id, criterion) x GROUP BY statement_id HAVING min(n) >= 2")
both("potential_counts", "SELECT s.statement_id, CASE WHEN a.statement_id IS NOT NULL THEN 2 ELSE 0 END AS potential FROM (SELECT DISTINCT statement_id FROM {statements}) s LEFT JOIN (SELECT DISTINCT statement_id FROM {annotations} WHERE criterion IN ('approval', 'signature', 'c1 (reporting entity)')) a ON s.statement_id = a.statement_id")
both("unpivot_annotations", "SELECT statement_id, criterion, measure, n FROM {agreement_stats} UNPIVOT (n FOR measure IN (agreed_positive_counts, agreed_negative_counts, disagreed_counts))")
both("upsert_edits", "SELECT b.statement_id, b.criterion, coalesce(e.n, b.n) AS n, e.n IS NOT NULL AS edited FROM (SELECT statement_id, criterion, max(annot1_pos_counts) AS n FROM {agreement_stats} GROUP BY statement_id, criterion) b LEFT JOIN (SELECT statement_id, criterion, max(annot2_pos_counts) AS n FROM {agreement_stats} WHERE disagreed_counts > 0 GROUP BY statement_id, criterion) e ON b.statement_id = e.statement_id AND b.criterion = e.criterion")
both("validated_flags", "SELECT statement_id, criterion, max(last_update) IS NOT NULL AS validated, count(last_update) AS n FROM {annotations} GROUP BY statement_id, criterion")

# --- agreement ---------------------------------------------------------------------------------------------------------------

_PAIR = _VOTES + """, pr AS (SELECT a.statement_id, a.criterion, a.sentence_idx, a.l = 'YES' AS x, b.l = 'YES' AS y FROM lat a JOIN lat b USING (statement_id, criterion, sentence_idx) WHERE a.annotator_idx = 0 AND b.annotator_idx = 1),
ct AS (SELECT statement_id, criterion, count(*) FILTER (x AND y) AS agreed_pos, count(*) FILTER (NOT x AND NOT y) AS agreed_neg, count(*) FILTER (x <> y) AS disagreed, count(*) FILTER (x) AS p1, count(*) FILTER (y) AS p2, count(*) AS n FROM pr GROUP BY ALL)"""


def _pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators side by side: one group-by instead of a self-join."""
    one = lambda i: F.max(F.when(F.col("annotator_idx") == i, F.col("l") == "YES"))
    p = _latest(spark, sf_dir).where("annotator_idx < 2").groupBy("statement_id", "criterion", "sentence_idx").agg(one(0).alias("x"), one(1).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    return p.groupBy("statement_id", "criterion").agg(F.count_if(x & y).alias("agreed_pos"), F.count_if(~x & ~y).alias("agreed_neg"), F.count_if(x != y).alias("disagreed"), F.count_if(x).alias("p1"), F.count_if(y).alias("p2"), F.count("*").alias("n"))


@query(_PAIR + " SELECT statement_id, criterion, agreed_pos, agreed_neg, disagreed FROM ct")
def agreement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_counts(spark, sf_dir).select("statement_id", "criterion", "agreed_pos", "agreed_neg", "disagreed")


_IOU = "CASE WHEN agreed_pos + disagreed = 0 THEN 1.0 ELSE agreed_pos::DOUBLE / (agreed_pos + disagreed) END"


@query(_PAIR + f" SELECT criterion, round(avg({_IOU}), 6) AS iou_mean, round(stddev_pop({_IOU}), 6) AS iou_std, round(avg((agreed_pos + agreed_neg)::DOUBLE / n), 6) AS observed FROM ct GROUP BY criterion")
def iou_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _pair_counts(spark, sf_dir)
    iou = F.when(F.col("agreed_pos") + F.col("disagreed") == 0, 1.0).otherwise(F.col("agreed_pos") / (F.col("agreed_pos") + F.col("disagreed")))
    return c.groupBy("criterion").agg(F.round(F.avg(iou), 6).alias("iou_mean"), F.round(F.stddev_pop(iou), 6).alias("iou_std"), F.round(F.avg((F.col("agreed_pos") + F.col("agreed_neg")) / F.col("n")), 6).alias("observed"))


@query(_PAIR + ", g AS (SELECT criterion, sum(p1)::DOUBLE AS p1, sum(p2)::DOUBLE AS p2, sum(n)::DOUBLE AS t, avg((agreed_pos + agreed_neg)::DOUBLE / n) AS po FROM ct GROUP BY criterion), h AS (SELECT criterion, po, (p1 * p2 + (t - p1) * (t - p2)) / (t * t) AS pe FROM g) SELECT criterion, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM h")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance agreement pooled over statements, observed agreement as the mean of statements."""
    g = _pair_counts(spark, sf_dir).groupBy("criterion").agg(F.sum("p1").alias("p1"), F.sum("p2").alias("p2"), F.sum("n").alias("t"), F.avg((F.col("agreed_pos") + F.col("agreed_neg")) / F.col("n")).alias("po"))
    pe = (F.col("p1") * F.col("p2") + (F.col("t") - F.col("p1")) * (F.col("t") - F.col("p2"))) / (F.col("t") * F.col("t"))
    return g.select("criterion", F.round("po", 6).alias("po"), F.round(pe, 6).alias("pe"), F.round((F.col("po") - pe) / (1 - pe), 6).alias("kappa"))


both("iou_by_length", "SELECT bin, count(*) AS n, round(avg(iou), 6) AS iou FROM (SELECT CAST(floor((p + q + d) / 5) * 5 AS INT) AS bin, CASE WHEN p + d = 0 THEN 1.0E0 ELSE CAST(p AS DOUBLE) / (p + d) END AS iou FROM (SELECT DISTINCT statement_id, criterion, agreed_positive_counts AS p, agreed_negative_counts AS q, coalesce(disagreed_counts, 0) AS d FROM {agreement_stats}) x WHERE p >= 1) y GROUP BY bin")

# --- metrics -------------------------------------------------------------------------------------------------------------------

_EV = "WITH ev AS (SELECT vec_id, i - 1 AS label_idx, (label = i - 1)::INT AS target, (1 / (1 + exp(-20 * embedding[i]::DOUBLE)) > 0.5)::INT AS prediction FROM (SELECT vec_id, label, embedding, unnest(range(1, 12)) AS i FROM embeddings)), cm AS (SELECT label_idx, count(*) FILTER (target = 1 AND prediction = 1) AS tp, count(*) FILTER (target = 0 AND prediction = 1) AS fp, count(*) FILTER (target = 1 AND prediction = 0) AS fn, count(*) FILTER (target = 0 AND prediction = 0) AS tn FROM ev GROUP BY ALL)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 11)).alias("label_idx", "x"))
    return e.select("vec_id", F.col("label_idx").cast("long").alias("label_idx"), (F.col("label") == F.col("label_idx")).cast("int").alias("target"), (1 / (1 + F.exp(-20 * F.col("x").cast("double"))) > 0.5).cast("int").alias("prediction"))


_R = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"


@query(_EV + f" SELECT label_idx, tp, fp, fn, tn, round({_R('tp + tn', '(tp + fp + fn + tn)')}, 6) AS accuracy, round({_R('tp', '(tp + fp)')}, 6) AS precision, round({_R('tp', '(tp + fn)')}, 6) AS recall, round({_R('2 * tp', '(2 * tp + fp + fn)')}, 6) AS f1 FROM cm")
def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(confusion(_predictions(spark, sf_dir), ["label_idx"]))


@query(_EV + f" SELECT round({_R('2 * sum(tp)', '(2 * sum(tp) + sum(fp) + sum(fn))')}, 6) AS f1_micro, round(avg({_R('2 * tp', '(2 * tp + fp + fn)')}), 6) AS f1_macro, round(sum(({_R('2 * tp', '(2 * tp + fp + fn)')}) * (tp + fn)) / sum(tp + fn), 6) AS f1_weighted FROM cm")
def f1_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averages(confusion(_predictions(spark, sf_dir), ["label_idx"]))


_MERGE = "CASE WHEN label_idx IN (3, 4, 5) THEN 3 WHEN label_idx = 6 THEN 4 WHEN label_idx IN (7, 8) THEN 5 WHEN label_idx > 8 THEN label_idx - 3 ELSE label_idx END"


@query(_EV.replace("cm AS (SELECT label_idx", f"mg AS (SELECT vec_id, {_MERGE} AS label_idx, max(target) AS target, max(prediction) AS prediction FROM ev GROUP BY ALL), cm AS (SELECT label_idx").replace("FROM ev GROUP BY ALL)", "FROM @@ GROUP BY ALL)", 1).replace("FROM ev GROUP BY ALL)", "FROM mg GROUP BY ALL)").replace("@@", "ev") + f" SELECT label_idx, tp, fp, fn, tn, round({_R('2 * tp', '(2 * tp + fp + fn)')}, 6) AS f1 FROM cm")
def merged_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 after merging the three c2 and two c4 labels by their maximum."""
    p = _predictions(spark, sf_dir).withColumn("label_idx", F.expr(_MERGE)).groupBy("vec_id", "label_idx").agg(F.max("target").alias("target"), F.max("prediction").alias("prediction"))
    return scores(confusion(p, ["label_idx"])).select("label_idx", "tp", "fp", "fn", "tn", "f1")


@query(_EV + " SELECT round(avg((target = prediction)::INT), 6) AS accuracy, round(avg((target = prediction)::INT) FILTER (target = 1), 6) AS on_positives, round(avg((target = prediction)::INT) FILTER (target = 0), 6) AS on_negatives, round(avg(prediction), 6) AS flagged FROM ev")
def accuracy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir).withColumn("hit", (F.col("target") == F.col("prediction")).cast("int"))
    on = lambda t: F.round(F.avg(F.when(F.col("target") == t, F.col("hit"))), 6)
    return p.agg(F.round(F.avg("hit"), 6).alias("accuracy"), on(1).alias("on_positives"), on(0).alias("on_negatives"), F.round(F.avg("prediction"), 6).alias("flagged"))


both("masked_stats", "SELECT criterion, count(*) AS n, count(disagreed_counts) AS n_valid, sum(disagreed_counts) AS total, round(avg(disagreed_counts), 6) AS mean, round(CAST(count(disagreed_counts) AS DOUBLE) / count(*), 6) AS valid_ratio FROM {agreement_stats} GROUP BY criterion")

# --- statistics ------------------------------------------------------------------------------------------------------------------

both("dataset_totals", "SELECT count(*) AS n, sum(page_count) AS pages, sum(word_count) AS words, sum(CASE WHEN image_count > 0 THEN page_count END) AS pages_with_images, min(published_at) AS first_published, max(published_at) AS last_published FROM {statements}")
both("column_profile", "SELECT count(DISTINCT statement_type) AS types, count(DISTINCT register_year) AS years, count(DISTINCT entities) AS entities, count(DISTINCT link) AS links FROM {statements}")
both("date_minmax", "SELECT o_orderpriority, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderpriority")
both("bins", "SELECT bin, count(*) AS n FROM (SELECT CASE WHEN page_count <= 0 THEN 'none' WHEN page_count <= 5 THEN '(0,5]' WHEN page_count <= 10 THEN '(5,10]' WHEN page_count <= 15 THEN '(10,15]' WHEN page_count <= 30 THEN '(15,30]' ELSE '(30,inf)' END AS bin FROM {statements} WHERE page_count IS NOT NULL) x GROUP BY bin")
both("histogram", "SELECT least(49, CAST(floor((n_chars - lo) * 50 / (hi - lo)) AS INT)) AS bin, count(*) AS n FROM (SELECT n_chars, m.lo, m.hi FROM {documents} CROSS JOIN (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM {documents}) m WHERE n_chars IS NOT NULL) x GROUP BY bin", "SELECT least(49, CAST(floor((n_chars - lo) * 50 / (hi - lo)) AS INT)) AS bin, count(*) AS n FROM (SELECT n_chars, (SELECT CAST(min(n_chars) AS DOUBLE) FROM {documents}) AS lo, (SELECT CAST(max(n_chars) AS DOUBLE) FROM {documents}) AS hi FROM {documents} WHERE n_chars IS NOT NULL) x GROUP BY bin")


@query("SELECT c AS cutoff, round(100 * avg((n_chars >= c)::INT), 6) AS percent FROM documents CROSS JOIN (SELECT unnest(range(0, 2000, 50)) AS c) WHERE n_chars IS NOT NULL GROUP BY c")
def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts with at least each cutoff: counts per step, then a reversed running sum over at most 40 steps."""
    d = table(spark, sf_dir, "documents").where("n_chars IS NOT NULL")
    steps = d.groupBy(F.least(F.floor(F.col("n_chars") / 50), F.lit(39)).alias("k")).agg(F.count("*").alias("n"))
    grid = d.sparkSession.range(0, 40).select(F.col("id").alias("k")).join(steps, "k", "left").na.fill(0, ["n"])
    w = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    return grid.select((F.col("k") * 50).alias("cutoff"), F.round(100 * F.sum("n").over(w) / F.sum("n").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), 6).alias("percent"))


both("boxplot", "SELECT extractor, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3, min(n_chars) AS low, max(n_chars) AS high FROM {documents} GROUP BY extractor", "SELECT extractor, percentile(n_chars, 0.25) AS q1, percentile(n_chars, 0.5) AS q2, percentile(n_chars, 0.75) AS q3, min(n_chars) AS low, max(n_chars) AS high FROM {documents} GROUP BY extractor")
both("length_by_source", "SELECT extractor, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 4) AS std, min(n_chars) AS low, max(n_chars) AS high FROM {documents} GROUP BY extractor")
both("duplicate_copies", "SELECT statement_id, count(*) AS n, count(DISTINCT coalesce(entities, '')) AS versions FROM {statements} GROUP BY statement_id HAVING count(*) > 1")
both("outliers_left_out", "SELECT doc_id, n_chars FROM {documents} WHERE n_chars <= 5000 AND n_chars > 0")
both("sentence_totals", "SELECT sum(k) AS sentences, round(avg(k), 6) AS mean, min(k) AS low, max(k) AS high FROM (SELECT len(sentences) AS k FROM {documents} WHERE sentences IS NOT NULL) x", "SELECT sum(k) AS sentences, round(avg(k), 6) AS mean, min(k) AS low, max(k) AS high FROM (SELECT size(sentences) AS k FROM {documents} WHERE sentences IS NOT NULL) x")
both("distinct_split_tokens", "SELECT count(DISTINCT t) AS n FROM (SELECT trim(unnest(string_split(entities, ','))) AS t FROM {statements} WHERE entities IS NOT NULL) x", "SELECT count(DISTINCT t) AS n FROM (SELECT trim(t) AS t FROM {statements} LATERAL VIEW explode(split(entities, ',')) e AS t WHERE entities IS NOT NULL) x")
both("json_extract", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM {events} GROUP BY event_type", "SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM {events} GROUP BY event_type")
both("relevant_ratio", "SELECT criterion, round(avg(r), 6) AS ratio FROM (SELECT criterion, statement_id, CAST(annot1_pos_counts AS DOUBLE) / (annot1_pos_counts + annot1_neg_counts) AS r FROM {agreement_stats} WHERE annot1_pos_counts + annot1_neg_counts > 0) x GROUP BY criterion")

# --- order, rank, sample ---------------------------------------------------------------------------------------------------------

both("contiguity", "SELECT l_orderkey, min(CASE WHEN d IS NULL OR d = 1 THEN 1 ELSE 0 END) = 1 AS contiguous FROM (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM {lineitem}) x GROUP BY l_orderkey")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each source per turn."""
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", "turn")


@query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 5")
def subsample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each group: Spark keeps only five rows per group and task before the shuffle."""
    r = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").withColumn("r", r).where("r <= 5").drop("r")


@query("WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' WHEN r <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'valid' ELSE 'test' END AS split FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    a, b = F.bround(F.col("n") * 0.8), F.bround(F.col("n") * 0.1)
    return ranked(e, "label", "vec_id").join(n, "label").select("vec_id", "label", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "valid").otherwise("test").alias("split"))


both("top_orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
both("best_per_customer", "SELECT o_custkey, max(o_totalprice) AS best FROM {orders} GROUP BY o_custkey")
both("page_of_rows", "SELECT doc_id, lang FROM {documents} ORDER BY doc_id LIMIT 20 OFFSET 40")


# --- clusters ----------------------------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE t AS (SELECT DISTINCT statement_id AS s, trim(lower(unnest(string_split(entities, ',')))) AS tok FROM statements WHERE entities IS NOT NULL AND entities <> ''),
top AS (SELECT tok, min(s) AS m FROM t GROUP BY tok),
e AS (SELECT DISTINCT s AS a, m AS b FROM t JOIN top USING (tok)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id WHERE r.c < u.b)
SELECT id AS statement_id, min(c) AS cluster FROM r GROUP BY id
""")
def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that share a comma-separated entity, over any number of steps; single ones are their own cluster."""
    t = table(spark, sf_dir, "statements").where("entities <> ''").select(F.col("statement_id").alias("s"), F.explode(F.split("entities", ",")).alias("tok")).select("s", F.trim(F.lower("tok")).alias("tok")).distinct()
    links = t.join(t.groupBy("tok").agg(F.min("s").alias("m")), "tok").select(F.col("s").alias("a"), F.col("m").alias("b"))
    found = clusters(links)
    return t.select(F.col("s").alias("id")).distinct().join(found, "id", "left").select(F.col("id").alias("statement_id"), F.coalesce("cluster", "id").alias("cluster"))


@query(SQL["entity_clusters"].replace("SELECT id AS statement_id, min(c) AS cluster FROM r GROUP BY id", ", f AS (SELECT id, min(c) AS c FROM r GROUP BY id), z AS (SELECT c, count(*) AS n FROM f GROUP BY c) SELECT count(*) AS clusters, max(n) AS largest, count(*) FILTER (n = 1) AS singles, CAST(floor(median(n)) AS INT) AS middle FROM z"))
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = entity_clusters(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"))
    return z.agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singles"), F.floor(F.median("n")).cast("int").alias("middle"))


@query(SQL["entity_clusters"].replace("SELECT id AS statement_id, min(c) AS cluster FROM r GROUP BY id", ", f AS (SELECT id, min(c) AS c FROM r GROUP BY id), o AS (SELECT c, row_number() OVER (ORDER BY md5('0:' || c)) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT c FROM f)) SELECT id AS statement_id, c AS cluster, CASE WHEN nth < round_even(0.8 * n, 0) THEN 'train' WHEN nth < round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'valid' ELSE 'test' END AS split FROM f JOIN o USING (c)"))
def cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole clusters to train (0.8), valid (0.1), test (the rest) in a shuffled order of a seed."""
    c = cut(entity_clusters(spark, sf_dir), "clusters")
    d = dealt(c, "cluster", {"train": 0.8, "valid": 0.1}, 0)
    return c.join(d, "cluster", "left").select("statement_id", "cluster", F.coalesce("subset", F.lit("test")).alias("split"))
