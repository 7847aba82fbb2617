"""Queries of annotation rows, chunks, labels and samples, each with its DuckDB SQL.

The tables hold labels only, so the texts and fields of annotators are made from them: an annotator's supporting text for a criterion
are the sentences that they labelled YES, and the other fields follow from whole numbers in the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import annotations as A
from ..functions import criteria as C
from ..functions import text as X
from ..operators import annotations as O
from ..operators import samples as M
from ..sources.tables import spread, table
from .reference import _BARE, _L, _ORIGIN, _PARTS, _SENTENCES, engine_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = ["doc_id", "criterion", "annotator_idx"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- fields of annotation rows -------------------------------------------------------------------------------------------

_N = "(statement_id * 7 + sentence_idx * 13 + annotator_idx * 5 + length(criterion)) % 40"
# The same expressions in both engines make the fields; what is compared is what the operators make of them.
_FIELDS = {
    "has_no_support_info": "(n = 1 AND l = 'YES') OR n = 2 OR (n = 5 AND l = 'NO')", "yes_text": "CASE WHEN (l = 'YES' AND n <> 3) OR n = 4 THEN 'yes text' ELSE '' END", "no_text": "CASE WHEN (l = 'NO' AND n <> 4) OR (l = 'YES' AND n IN (3, 26)) THEN 'no text' END",
    "unclear_text": "CASE WHEN l = 'UNCLEAR' THEN 'unclear text' ELSE '' END", "has_date": "n IN (6, 20)", "date_text": "CASE WHEN n IN (7, 20) THEN '1 May' ELSE '' END", "date_text_is_scanned": "n = 21",
    "viz_elem_label": "n IN (8, 9, 10, 22)", "viz_elem_text": "CASE WHEN n IN (9, 10, 22) THEN 'a // b. // http://c' END", "viz_elem_page": "CASE WHEN n IN (8, 10, 11) THEN '3' WHEN n = 22 THEN 'p. 4' ELSE '' END", "viz_elem_type": "CASE WHEN n IN (8, 9, 22) THEN 'Data Table' END", "viz_elem_scanned": "FALSE",
    "add_viz_elem_label": "n IN (12, 13, 14, 23)", "add_viz_elem_text": "CASE WHEN n IN (13, 14, 22, 23) THEN 'x' END", "add_viz_elem_page": "CASE WHEN n IN (12, 14, 15, 23) THEN '7' END", "add_viz_elem_type": "CASE WHEN n IN (12, 13, 23) THEN 'figure' END", "add_viz_elem_scanned": "FALSE",
    "joint_option": "CASE WHEN criterion = 'approval' THEN CASE n % 4 WHEN 0 THEN 'option_1' WHEN 1 THEN 'Opt 2' WHEN 2 THEN '3' ELSE 'other' END END", "opt_3_explanation": "CASE WHEN n IN (16, 17, 18, 24) THEN 'explained' ELSE ' ' END",
}
_FORMS = f"forms0 AS (SELECT statement_id, doc_id, criterion, sentence_idx, annotator_idx, last_update, label AS raw, {_L} AS l, {_N} AS n FROM annotations), forms AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _FIELDS.items()) + " FROM forms0)"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "annotations").select("statement_id", "doc_id", "criterion", "sentence_idx", "annotator_idx", "last_update", F.col("label").alias("raw"), C.label(F.col("label")).alias("l"), F.expr(_N).alias("n"))
    return a.select("*", *[F.expr(v).alias(k) for k, v in _FIELDS.items()])


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _forms(spark, sf_dir)
    fields = {k: A.blank_to_empty(F.col(k)) if "text" in k or k == "opt_3_explanation" else F.col(k) for k in _FIELDS if k != "joint_option"} | {"label": F.col("l")}
    own, approval = A.first_error(fields), A.first_error(fields | {"joint_option": A.option(F.col("joint_option"))})
    return f.withColumn("error", F.when(F.col("criterion") == "approval", approval).otherwise(own))


_VISUAL = lambda p: [f"{p}_label AND coalesce({p}_text, '') = '' AND NOT {p}_scanned", f"{p}_label AND coalesce({p}_page, '') = ''", f"{p}_label AND coalesce({p}_type, '') = ''", f"NOT {p}_label AND (coalesce({p}_page, '') <> '' OR coalesce({p}_type, '') <> '' OR coalesce({p}_text, '') <> '' OR {p}_scanned)"]
_OWN = "coalesce(CASE l WHEN 'YES' THEN yes_text WHEN 'NO' THEN no_text ELSE unclear_text END, '')"
_COUNT = "(coalesce(yes_text, '') <> '')::INT + (coalesce(no_text, '') <> '')::INT + (coalesce(unclear_text, '') <> '')::INT"
_BROKEN = [
    "l IS NULL", "l = 'YES' AND has_no_support_info", "has_no_support_info AND l <> 'NO'", f"{_COUNT} > 0 AND {_OWN} = ''", f"{_COUNT} > 1", "has_date AND date_text = '' AND NOT date_text_is_scanned",
    "NOT has_date AND (date_text <> '' OR date_text_is_scanned)", *_VISUAL("viz_elem"), *_VISUAL("add_viz_elem"),
    "criterion = 'approval' AND trim(opt_3_explanation) <> '' AND coalesce(joint_option, '') NOT IN ('3')",
]
_ERRORS = f"WITH {_FORMS}, bad AS (SELECT *, CASE " + " ".join(f"WHEN {b} THEN {k}" for k, b in enumerate(_BROKEN, 1)) + " END AS rule FROM forms)"


@query(_ERRORS + " SELECT statement_id, criterion, sentence_idx, annotator_idx, n, l AS label, rule FROM bad")
def validity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every annotation row with the first of the 16 rules that it breaks, NULL if it is valid."""
    return _errors(spark, sf_dir).select("statement_id", "criterion", "sentence_idx", "annotator_idx", "n", F.col("l").alias("label"), F.col("error.rule").alias("rule"))


_SORTED = _ERRORS + """, v AS (SELECT *, CASE WHEN n = 25 THEN last_update END AS validated FROM bad),
g AS (SELECT statement_id, criterion, sentence_idx, min(annotator_idx) FILTER (validated IS NOT NULL) AS v, min(annotator_idx) FILTER (validated IS NULL AND rule IS NOT NULL) AS b, min(annotator_idx) FILTER (validated IS NULL AND rule IS NULL) AS o FROM v GROUP BY ALL),
s AS (SELECT v.*, CASE WHEN v.annotator_idx > g.v THEN 'after' WHEN g.b < coalesce(g.v, g.b + 1) OR g.o < g.v THEN 'rejected' ELSE 'good' END AS state FROM v JOIN g USING (statement_id, criterion, sentence_idx))"""


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _errors(spark, sf_dir).withColumn("rule", F.col("error.rule")).withColumn("why", F.col("error.message")).withColumn("validated", F.when(F.col("n") == 25, F.col("last_update")))
    return O.sorted_out(e, ["statement_id", "criterion", "sentence_idx"], "annotator_idx", "why", "validated")


@query(_SORTED + " SELECT statement_id, criterion, sentence_idx, annotator_idx, n, rule, state FROM s")
def sorted_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and rejected rows: a bad one rejects its group, a validated one ends it."""
    return _sorted(spark, sf_dir).select("statement_id", "criterion", "sentence_idx", "annotator_idx", "n", "rule", "state")


@query(_SORTED + " SELECT coalesce(rule, 0) AS rule, state, count(*) AS n FROM s GROUP BY ALL")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each rule and the verdict of their group let pass or reject."""
    return _sorted(spark, sf_dir).groupBy(F.coalesce("rule", F.lit(0)).alias("rule"), "state").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT statement_id, criterion, count(*) FILTER (annotator_idx = 0) AS k FROM (SELECT DISTINCT statement_id, criterion, annotator_idx FROM annotations) GROUP BY ALL) SELECT statement_id FROM p GROUP BY statement_id HAVING count(*) FILTER (k = 1) = max((SELECT count(DISTINCT criterion) FROM annotations WHERE criterion LIKE 'c2%'))")
def fully_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with exactly one validated row (here: that of annotator 0) for each of as many criteria as are asked for."""
    a = table(spark, sf_dir, "annotations").select("statement_id", "criterion", "annotator_idx").distinct()
    return O.fully_validated(a.withColumn("v", F.when(F.col("annotator_idx") == 0, 1)), "statement_id", "criterion", "v", len(C.criteria_of("c2")))


@query("SELECT statement_id, criterion, annotator, pos, neg FROM (SELECT statement_id, criterion, 1 AS annotator, annot1_pos_counts AS pos, annot1_neg_counts AS neg FROM agreement_stats UNION ALL SELECT statement_id, criterion, 2, annot2_pos_counts, annot2_neg_counts FROM agreement_stats)")
def annotator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per annotator from columns per annotator."""
    return O.annotator_rows(table(spark, sf_dir, "agreement_stats"), ["statement_id", "criterion"], {"pos": "annot{}_pos_counts", "neg": "annot{}_neg_counts"}, [1, 2])


@query(f"WITH {_FORMS} SELECT DISTINCT criterion, joint_option, CASE WHEN regexp_matches(joint_option, '[123]$') THEN right(joint_option, 1)::INT END AS option, raw, l AS label FROM forms")
def label_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of labels and options with what they mean."""
    return _forms(spark, sf_dir).select("criterion", "joint_option", A.option(F.col("joint_option")).alias("option"), "raw", F.col("l").alias("label")).distinct()


@query(f"WITH {_FORMS} SELECT statement_id, criterion, sentence_idx, annotator_idx, n, CASE l WHEN 'YES' THEN yes_text WHEN 'NO' THEN no_text WHEN 'UNCLEAR' THEN unclear_text END AS text, CASE WHEN l = 'YES' THEN yes_text ELSE '' END AS yes_text, CASE WHEN l = 'NO' THEN coalesce(no_text, '') ELSE '' END AS no_text, CASE WHEN l = 'UNCLEAR' THEN unclear_text ELSE '' END AS unclear_text FROM forms")
def label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each row's label, and the row as columns again: the text only in the column of its label."""
    f = _forms(spark, sf_dir)
    t = A.supporting_text(F.col("l"), F.col("yes_text"), F.col("no_text"), F.col("unclear_text"))
    return f.select("statement_id", "criterion", "sentence_idx", "annotator_idx", "n", t.alias("text"), A.label_texts(F.col("l"), t).alias("x")).select("statement_id", "criterion", "sentence_idx", "annotator_idx", "n", "text", "x.*")


@query(f"WITH {_FORMS}, t AS (SELECT *, CASE n WHEN 9 THEN 'tab.p0.a // tab.p0.b // tab.p0.http://c' WHEN 10 THEN 'fig.p3.a // fig.p3.b // fig.p3.http://c' WHEN 22 THEN 'tab.p4.a // tab.p4.b // tab.p4.http://c // fig.p0.x' WHEN 13 THEN 'fig.p0.x' WHEN 14 THEN 'fig.p7.x' WHEN 23 THEN 'fig.p7.x' ELSE '' END AS v FROM forms) SELECT statement_id, criterion, sentence_idx, annotator_idx, n, CASE WHEN yes_text = '' THEN v WHEN v = '' THEN yes_text ELSE yes_text || ' // ' || v END AS excerpt FROM t")
def visual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text and texts of visual elements, each part with the prefix of its kind and page, as one excerpt."""
    v = [tuple(F.col(f"{p}_{k}") for k in ("text", "type", "page")) for p in ("viz_elem", "add_viz_elem")]
    return _forms(spark, sf_dir).select("statement_id", "criterion", "sentence_idx", "annotator_idx", "n", A.full_excerpt(F.col("yes_text"), v).alias("excerpt"))


@query("SELECT statement_id, criterion, sentence_idx, annotator_idx, last_update, trim(label) IN ('yes','Yes','YES','y','Y','True','true','1') AS has_date, CASE WHEN regexp_matches(label, '^\\s+$') THEN '' ELSE label END AS date_text FROM annotations WHERE NOT regexp_matches(lower(label), 'unclear')")
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by the ends of their names: flags as booleans, texts without blank ones."""
    a = table(spark, sf_dir, "annotations").where("NOT lower(label) RLIKE 'unclear'")
    return a.select("statement_id", "criterion", "sentence_idx", "annotator_idx", "last_update", *[A.typed(k, F.col("label")).alias(k) for k in ("has_date", "date_text")])


# --- chunks -----------------------------------------------------------------------------------------------------------------

_SAID = f"""said AS (SELECT doc_id, criterion, annotator_idx, sentence_idx, CASE WHEN annotator_idx % 3 = 2 THEN 'NO' ELSE 'YES' END AS label FROM (SELECT *, {_L} AS l FROM annotations) WHERE l = 'YES' GROUP BY ALL),
ex AS (SELECT doc_id, criterion, annotator_idx, label, string_agg(CASE sentence_idx % 7 WHEN 3 THEN 'fig.p2. ' || s WHEN 5 THEN 'tab.p1.' || s ELSE s END, ' // ' ORDER BY sentence_idx) AS excerpt FROM (SELECT said.*, documents.sentences[sentence_idx + 1] AS s FROM said JOIN documents USING (doc_id)) WHERE s <> '' GROUP BY ALL)"""
_CHUNKS = _SAID + f", pt AS (SELECT doc_id, criterion, annotator_idx, label, unnest({_PARTS('excerpt')}) AS part, generate_subscripts({_PARTS('excerpt')}, 1) - 1 AS chunk_no FROM ex), ch AS (SELECT doc_id, criterion, annotator_idx, label, chunk_no, {_ORIGIN('part')} AS origin, {_BARE('part')} AS chunk FROM pt)"
_WHO = "doc_id, criterion, annotator_idx, label, chunk_no, origin, chunk"
_ID = "doc_id, criterion, annotator_idx, chunk_no"
_PLACED = (
    _SENTENCES + ", " + _CHUNKS + ", " + engine_sql(f"SELECT {_WHO}, chunk AS t FROM ch", _WHO, X.SEPARATORS["annotators"], "c_", _ID)
    + f""", m1 AS (SELECT {_ID}, c.pos AS piece, min(s.pos) AS idx FROM c_sent c JOIN sent s USING (doc_id) WHERE s.sentence = c.sentence GROUP BY ALL),
r1 AS (SELECT * FROM (SELECT *, pos AS piece FROM c_sent) ANTI JOIN m1 USING ({_ID}, piece)),
m2 AS (SELECT {_ID}, piece, min(s.pos) AS idx FROM r1 JOIN sent s USING (doc_id) WHERE contains(s.sentence, r1.sentence) GROUP BY ALL),
r2 AS (SELECT * FROM r1 ANTI JOIN m2 USING ({_ID}, piece)),
sc AS (SELECT {_ID}, piece, s.pos AS idx, 1 - levenshtein(r2.sentence, s.sentence)::DOUBLE / greatest(length(r2.sentence), length(s.sentence)) AS score FROM r2 JOIN sent s USING (doc_id)),
m3 AS (SELECT {_ID}, piece, idx, score FROM sc QUALIFY row_number() OVER (PARTITION BY {_ID}, piece ORDER BY score DESC, idx) = 1),
m AS (SELECT *, 1.0::DOUBLE AS score, 'exact' AS stage FROM m1 UNION ALL SELECT *, 0.999::DOUBLE, 'inside' FROM m2 UNION ALL SELECT {_ID}, piece, idx, round(score, 6), 'near' FROM m3),
placed AS (SELECT {_WHO}, m.piece, c.sentence, m.idx, m.score, m.stage FROM m JOIN (SELECT *, pos AS piece FROM c_sent) c USING ({_ID}, piece))"""
)


def _excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "annotations").where(C.label(F.col("label")) == "YES").select(*KEYS, "sentence_idx").distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", "sentences")
    s = F.get("sentences", F.col("sentence_idx"))
    x = a.join(d, "doc_id").select(*KEYS, "sentence_idx", s.alias("s")).where("s <> ''")
    shown = F.when(F.col("sentence_idx") % 7 == 3, F.concat(F.lit("fig.p2. "), F.col("s"))).when(F.col("sentence_idx") % 7 == 5, F.concat(F.lit("tab.p1."), F.col("s"))).otherwise(F.col("s"))
    x = x.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("sentence_idx", shown.alias("s")))).alias("x"))
    return x.select(*KEYS, F.when(F.col("annotator_idx") % 3 == 2, "NO").otherwise("YES").alias("label"), F.array_join(F.transform("x", lambda p: p["s"]), " // ").alias("excerpt"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    return d.select("doc_id", X.sentences_of(F.col("text")).alias("sentences"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.placed_chunks(O.chunks(_excerpts(spark, sf_dir), [*KEYS, "label"], "excerpt"), [*KEYS, "label"], _texts(spark, sf_dir), "doc_id")


@query("WITH " + _CHUNKS + " SELECT doc_id, criterion, annotator_idx, label, chunk_no, origin, chunk FROM ch")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every annotator's supporting text, with where they come from."""
    return O.chunks(_excerpts(spark, sf_dir), [*KEYS, "label"], "excerpt").withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query(_PLACED + " SELECT doc_id, criterion, annotator_idx, chunk_no, piece, sentence, idx, score, stage FROM placed")
def chunk_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every chunk at its place in the text: exact, inside, or nearest."""
    p = _placed(spark, sf_dir)
    return p.select(*KEYS, *[F.col(c).cast("long").alias(c) for c in ("chunk_no", "piece")], "sentence", F.col("idx").cast("long").alias("idx"), "score", "stage")


_COUNTS = ", hit AS (SELECT doc_id, criterion, idx, count(DISTINCT annotator_idx) AS n_annotators, count(*) AS n_chunks, count(*) FILTER (label = 'YES') AS n_yes FROM (SELECT DISTINCT doc_id, criterion, annotator_idx, chunk_no, idx, label FROM placed) GROUP BY ALL)"


@query(_PLACED + _COUNTS + " SELECT * FROM hit")
def chunk_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotators and chunks that stand on each sentence."""
    return O.sentence_counts(_placed(spark, sf_dir), "doc_id", "criterion", "annotator_idx").withColumn("idx", F.col("idx").cast("long"))


@query(_PLACED + " SELECT doc_id, criterion, chunk, arg_min(idx, idx * 100000 + chunk_no) AS idx, arg_min(chunk_no, idx * 100000 + chunk_no) AS chunk_no FROM placed GROUP BY ALL")
def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk text once per text and criterion, where it first stands."""
    return O.first_of_chunk(_placed(spark, sf_dir), ["doc_id", "criterion"]).withColumns({c: F.col(c).cast("long") for c in ("idx", "chunk_no")})


@query("WITH " + _CHUNKS + " SELECT doc_id, criterion, annotator_idx, chunk_no, chunk FROM ch WHERE criterion IN ('approval', 'signature', 'c1 (reporting entity)') AND origin = 'main_body'")
def criterion_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one group of criteria that come from the main text."""
    c = O.chunks(_excerpts(spark, sf_dir), KEYS, "excerpt").where(F.col("criterion").isin(*C.criteria_of("a-s-c1")) & (F.col("origin") == "main_body"))
    return c.select(*KEYS, F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


# --- labels and samples --------------------------------------------------------------------------------------------------------

_CRITERIA = "['" + "','".join(C.CRITERIA) + "']"
_LABELS = _PLACED + _COUNTS + f""", panel AS (SELECT doc_id, criterion, count(DISTINCT annotator_idx) AS k FROM ex GROUP BY ALL),
grid AS (SELECT doc_id, pos AS idx, unnest({_CRITERIA}) AS criterion FROM sent),
full_ AS (SELECT doc_id, idx, criterion, coalesce(k, 0) AS k, coalesce(n_annotators, 0) AS h, coalesce(n_chunks, 0) AS c, coalesce(n_yes, 0) AS y FROM grid LEFT JOIN panel USING (doc_id, criterion) LEFT JOIN hit USING (doc_id, criterion, idx)),
lab AS (SELECT doc_id, idx, criterion, k > 0 AND h > 0 AS rel_union, k > 0 AND h = k AS rel_inter, CASE WHEN k = 0 THEN 0.0 ELSE round(h::DOUBLE / k, 6) END AS rel_soft, k > 0 AND y > 0 AS ev_union, k > 0 AND y = c AS ev_inter, CASE WHEN k = 0 THEN 0.0 WHEN c > 0 THEN round(y::DOUBLE / c, 6) END AS ev_soft, k = 0 AS rel_masked FROM full_)"""  # fmt: skip


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _excerpts(spark, sf_dir)
    s = _texts(spark, sf_dir).where("size(sentences) > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.size("sentences") - 1)).alias("idx"))
    return M.labelled(s, O.sentence_counts(_placed(spark, sf_dir), "doc_id", "criterion", "annotator_idx"), e.groupBy("doc_id", "criterion").agg(F.countDistinct("annotator_idx").alias("panel")), "doc_id", C.CRITERIA)


@query(_LABELS + " SELECT doc_id, idx, criterion, rel_union, rel_inter, rel_soft, ev_union, ev_inter, ev_soft, rel_masked, rel_masked OR NOT rel_union AS ev_union_masked, rel_masked OR NOT rel_inter AS ev_inter_masked, rel_masked OR rel_soft = 0 AS ev_soft_masked FROM lab")
def relevance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance and evidence of every sentence for every criterion, by three strategies, with their masks."""
    x = _labels(spark, sf_dir)
    return x.select("doc_id", F.col("idx").cast("long").alias("idx"), "criterion", "y.*")


@query(_LABELS + " SELECT doc_id, idx, criterion, CASE WHEN rel_masked THEN -1 ELSE rel_union::INT END AS relevance, CASE WHEN rel_masked OR NOT rel_union THEN -1 ELSE ev_union::INT END AS evidence FROM lab")
def masked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as numbers, -1 where they are masked."""
    y = F.col("y")
    return _labels(spark, sf_dir).select("doc_id", F.col("idx").cast("long").alias("idx"), "criterion", O.with_ignore(y["rel_union"], y["rel_masked"]).alias("relevance"), O.with_ignore(y["ev_union"], y["ev_union_masked"]).alias("evidence"))


_HIT = ", any_ AS (SELECT doc_id, idx, bool_or(origin <> 'main_body') AS visual FROM placed GROUP BY ALL)"
_SUB = " SELECT doc_id, criterion, annotator_idx, chunk_no, idx::VARCHAR AS idxs FROM (SELECT DISTINCT doc_id, criterion, annotator_idx, chunk_no, idx FROM placed WHERE origin = 'main_body')"
_MISSING = " UNION ALL SELECT doc_id, NULL, NULL, NULL, pos::VARCHAR FROM sent ANTI JOIN (SELECT doc_id, idx AS pos FROM any_) USING (doc_id, pos)"


@query(_PLACED + _HIT + " SELECT doc_id, pos AS idx FROM sent ANTI JOIN (SELECT doc_id, idx AS pos FROM any_ WHERE visual) USING (doc_id, pos)")
def samples_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence that no chunk of a visual element stands on."""
    return M.all_sentences(_texts(spark, sf_dir), _placed(spark, sf_dir), "doc_id").withColumn("idx", F.col("idx").cast("long"))


@query(_PLACED + _HIT + _SUB + _MISSING)
def samples_subchunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample per sentence of a chunk, and the sentences of no chunk."""
    return M.of_subchunks(_texts(spark, sf_dir), _placed(spark, sf_dir), "doc_id", KEYS[1:])


@query(_PLACED + _HIT + " SELECT doc_id, criterion, annotator_idx, chunk_no, string_agg(idx, ',' ORDER BY idx) AS idxs FROM (SELECT DISTINCT doc_id, criterion, annotator_idx, chunk_no, idx FROM placed WHERE origin = 'main_body') GROUP BY ALL" + _MISSING)
def samples_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample per chunk with all of its sentences, and the sentences of no chunk."""
    return M.of_chunks(_texts(spark, sf_dir), _placed(spark, sf_dir), "doc_id", KEYS[1:])


@query(_PLACED + _HIT + " SELECT doc_id, pos AS idx, sentence FROM sent ANTI JOIN (SELECT doc_id, idx AS pos FROM any_) USING (doc_id, pos)")
def missing_irrelevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that no chunk stands on."""
    return M.without_chunks(_texts(spark, sf_dir), _placed(spark, sf_dir), "doc_id").withColumn("idx", F.col("idx").cast("long"))


@query("SELECT doc_id, i - 1 AS idx, printf('statement%05d:sentence%05d', statement_id, i - 1) AS sample_id, (r - 1) // 64 AS batch, length(s) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS r FROM (SELECT doc_id, statement_id, source, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM documents WHERE statement_id IS NOT NULL))")
def sample_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences in numbered batches of 64 per source, with their sample ids."""
    d = table(spark, sf_dir, "documents").where("statement_id IS NOT NULL").select("doc_id", "statement_id", "source", F.posexplode("sentences").alias("idx", "s"))
    x = M.batched(d, "source", ["doc_id", "idx"], 64)
    return x.select("doc_id", F.col("idx").cast("long").alias("idx"), X.sample_id(F.col("statement_id"), F.col("idx")).alias("sample_id"), "batch", F.length("s").cast("long").alias("n"))


@query("WITH b AS (SELECT source, (r - 1) // 64 AS batch, doc_id, i, s FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS r FROM (SELECT doc_id, source, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM documents))) SELECT source, batch, count(*) AS batch_size, max(length(s)) AS width, sum(length(s)) AS filled, count(*) * max(length(s)) - sum(length(s)) AS padding FROM b GROUP BY ALL")
def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch holds when its rows are padded to the longest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode("sentences").alias("idx", "s"))
    b = M.batched(d, "source", ["doc_id", "idx"], 64)
    n = F.length("s").cast("long")
    return b.groupBy("source", "batch").agg(F.count("*").alias("batch_size"), F.max(n).alias("width"), F.sum(n).alias("filled"), (F.count("*") * F.max(n) - F.sum(n)).alias("padding"))
