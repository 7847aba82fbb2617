"""Queries of metrics, statistics, small functions and hooks, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions import criteria as C
from ..functions import hooks as H
from ..functions import text as X
from ..operators import metrics as M
from ..operators import statistics as S
from ..sources.tables import spread, table
from .reference import _EV, _PAIR, _R, _pair_counts, _predictions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- metrics -----------------------------------------------------------------------------------------------------------------

# Some targets are masked and some predictions invalid, by the row's number.
_MK = _EV[: _EV.index(", cm AS")] + ", mk AS (SELECT vec_id, label_idx, CASE WHEN (vec_id + label_idx) % 7 = 0 THEN -1 ELSE target END AS target, CASE WHEN (vec_id * 3 + label_idx) % 11 = 0 THEN 5 ELSE prediction END AS prediction FROM ev)"


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    n = F.col("vec_id") + F.col("label_idx")
    return p.withColumn("target", F.when(n % 7 == 0, -1).otherwise(F.col("target"))).withColumn("prediction", F.when((F.col("vec_id") * 3 + F.col("label_idx")) % 11 == 0, 5).otherwise(F.col("prediction")))


@query(_MK + f", c AS (SELECT count(*) FILTER (target = 1 AND p = 1) AS tp, count(*) FILTER (target = 0 AND p = 1) AS fp, count(*) FILTER (target = 1 AND p = 0) AS fn, count(*) FILTER (target = 0 AND p = 0) AS tn, count(*) FILTER (bad) AS invalid FROM (SELECT *, prediction NOT IN (0, 1) AS bad, CASE WHEN prediction IN (0, 1) THEN prediction ELSE 0 END AS p FROM mk) WHERE target >= 0) SELECT tp, fp, fn, tn, invalid, round({_R('tp + tn', '(tp + fp + fn + tn)')}, 6) AS accuracy, round({_R('tp', '(tp + fp)')}, 6) AS precision, round({_R('tp', '(tp + fn)')}, 6) AS recall, round({_R('2 * tp', '(2 * tp + fp + fn)')}, 6) AS f1 FROM c")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary metrics without masked targets; invalid predictions count as 0."""
    m = _masked(spark, sf_dir).where("target >= 0")
    bad = m.agg(F.count_if(~F.col("prediction").isin(0, 1)).alias("invalid"))
    return M.scores(M.confusion(M.valid_predictions(m), [])).join(F.broadcast(bad)).select("tp", "fp", "fn", "tn", "invalid", "accuracy", "precision", "recall", "f1")


@query(_MK + f", cm AS (SELECT label_idx, count(*) FILTER (target = 1 AND prediction = 1) AS tp, count(*) FILTER (target = 0 AND prediction = 1) AS fp, count(*) FILTER (target = 1 AND prediction <> 1) AS fn, count(*) FILTER (target = 0 AND prediction <> 1) AS tn, count(*) AS n FROM mk WHERE target >= 0 GROUP BY label_idx) SELECT label_idx::VARCHAR AS label, round({_R('tp + tn', 'n')}, 6) AS accuracy, round({_R('2 * tp', '(2 * tp + fp + fn)')}, 6) AS f1, round({_R('tp', '(tp + fp)')}, 6) AS precision, round({_R('tp', '(tp + fn)')}, 6) AS recall FROM cm UNION ALL SELECT 'macro', round(avg({_R('tp + tn', 'n')}), 6), round(avg({_R('2 * tp', '(2 * tp + fp + fn)')}), 6), round(avg({_R('tp', '(tp + fp)')}), 6), round(avg({_R('tp', '(tp + fn)')}), 6) FROM cm")
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four metrics per label and their macro average, masked targets left out."""
    return M.report(M.confusion(M.valid_predictions(_masked(spark, sf_dir)), ["label_idx"]), "label_idx")


@query(_EV[: _EV.index(", cm AS")] + f", k AS (SELECT c, count(*) FILTER (target = c AND prediction = c) AS tp, count(*) FILTER (target <> c AND prediction = c) AS fp, count(*) FILTER (target = c AND prediction <> c) AS fn FROM ev, (VALUES (0), (1)) t(c) GROUP BY c) SELECT round({_R('2 * sum(tp)', '(2 * sum(tp) + sum(fp) + sum(fn))')}, 6) AS f1_micro, round(avg({_R('2 * tp', '(2 * tp + fp + fn)')}), 6) AS f1_macro, round(sum(({_R('2 * tp', '(2 * tp + fp + fn)')}) * (tp + fn)) / sum(tp + fn), 6) AS f1_weighted FROM k")
def classwise_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over the classes 0 and 1."""
    return M.averages(M.by_class(_predictions(spark, sf_dir)))


@query(_PAIR + ", s AS (SELECT criterion, avg(CASE WHEN agreed_pos + disagreed = 0 THEN 1.0 ELSE agreed_pos::DOUBLE / (agreed_pos + disagreed) END) AS v, sum(agreed_pos) AS p, sum(disagreed) AS d FROM ct GROUP BY criterion) SELECT round(avg(v), 6) AS macro, round((SELECT avg(CASE WHEN agreed_pos + disagreed = 0 THEN 1.0 ELSE agreed_pos::DOUBLE / (agreed_pos + disagreed) END) FROM ct), 6) AS micro, round(sum(p)::DOUBLE / (sum(p) + sum(d)), 6) AS pooled FROM s")
def iou_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive IoU over all criteria: mean of criteria, mean of all pairs, and pooled."""
    return S.iou_overall(_pair_counts(spark, sf_dir))


_IAA = """WITH l AS (SELECT statement_id, criterion, annotator_idx, sentence_idx, CASE WHEN trim(label) IN ('yes','Yes','YES','y','Y','True','true','1') THEN 1 ELSE 0 END AS y FROM annotations WHERE annotator_idx < 2),
a AS (SELECT statement_id, criterion, annotator_idx, max(y) AS lab, list_distinct(list(sentence_idx) FILTER (y = 1)) AS s FROM l GROUP BY ALL),
p AS (SELECT x.statement_id, x.criterion, CASE WHEN x.lab <> z.lab THEN 0.0 WHEN len(coalesce(x.s, [])) + len(coalesce(z.s, [])) = 0 THEN 1.0 ELSE len(list_intersect(x.s, z.s))::DOUBLE / len(list_distinct(list_concat(x.s, z.s))) END AS iaa FROM a x JOIN a z USING (statement_id, criterion) WHERE x.annotator_idx = 0 AND z.annotator_idx = 1)"""


@query(_IAA + " SELECT statement_id, criterion, round(iaa, 6) AS iaa FROM p")
def annotation_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two annotations: 0 if their labels differ, else IoU of their sets of sentences."""
    a = table(spark, sf_dir, "annotations").where("annotator_idx < 2")
    yes = C.label(F.col("label")).eqNullSafe("YES")
    return S.annotation_iou(a.select("statement_id", "criterion", "annotator_idx", "sentence_idx", yes.alias("yes")), ["statement_id", "criterion"]).select("statement_id", "criterion", F.round("iaa", 6).alias("iaa"))


@query(_IAA + " SELECT c.criterion, round(coalesce(avg(iaa), 0.0), 6) AS mean, count(iaa) AS n FROM (SELECT DISTINCT criterion FROM annotations) c LEFT JOIN p ON p.criterion = c.criterion GROUP BY ALL")
def annotation_iou_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean agreement per criterion, 0 where no pair is."""
    c = table(spark, sf_dir, "annotations").select("criterion").distinct()
    return c.join(annotation_iou(spark, sf_dir), "criterion", "left").groupBy("criterion").agg(F.round(F.coalesce(F.avg("iaa"), F.lit(0.0)), 6).alias("mean"), F.count("iaa").alias("n"))


@query("WITH ev AS (SELECT vec_id, i - 1 AS label_idx, CASE WHEN (vec_id + i) % 7 = 0 THEN -1 ELSE (label = i - 1)::INT END AS target, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, 12)) AS i FROM embeddings)) SELECT label_idx, round(sum(CASE WHEN target >= 0 THEN (x - target) * (x - target) ELSE 0 END) / count(*), 6) AS loss, count(*) FILTER (target >= 0) AS n_valid FROM ev GROUP BY ALL")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error with masked targets as 0, over all elements."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 11)).alias("label_idx", "x"))
    e = e.withColumn("target", F.when((F.col("vec_id") + F.col("label_idx") + 1) % 7 == 0, -1).otherwise((F.col("label") == F.col("label_idx")).cast("int")))
    x = F.col("x").cast("double")
    return e.groupBy(F.col("label_idx").cast("long").alias("label_idx")).agg(F.round(M.masked_mean((x - F.col("target")) * (x - F.col("target")), F.col("target")), 6).alias("loss"), F.count_if(F.col("target") >= 0).alias("n_valid"))


@query("WITH b AS (SELECT label, vec_id // 32 AS batch, count(*) AS n, avg(embedding[1]::DOUBLE) AS loss FROM embeddings GROUP BY ALL) SELECT label, round(sum(loss * n) / sum(n), 6) AS weighted, round(avg(loss), 6) AS plain FROM b GROUP BY label")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of batch means, weighted by batch size and not."""
    b = table(spark, sf_dir, "embeddings").groupBy("label", F.floor(F.col("vec_id") / 32).alias("batch")).agg(F.count("*").alias("n"), F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("loss"))
    return b.groupBy("label").agg(F.round(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), 6).alias("weighted"), F.round(F.avg("loss"), 6).alias("plain"))


@query("SELECT label, i - 1 AS dim, round(max(x), 6) AS pooled FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def max_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value of each dimension over the vectors of a label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.max(F.col("x").cast("double")), 6).alias("pooled"))


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(sum(value) / count(DISTINCT user_id), 6) AS per_item FROM events GROUP BY event_type")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, largest and mean of measured values, their spread, and what falls to one item."""
    return S.timings(table(spark, sf_dir, "events"), "event_type", "value", "user_id")


@query("SELECT source, count(*) AS batches, sum(n) AS items FROM (SELECT source, len(sentences) AS n FROM documents WHERE sentences IS NOT NULL) GROUP BY source")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of nested batches, added up."""
    return table(spark, sf_dir, "documents").where("sentences IS NOT NULL").groupBy("source").agg(F.count("*").alias("batches"), F.sum(F.size("sentences")).alias("items"))


# --- statistics ----------------------------------------------------------------------------------------------------------------

_Q = "SELECT extractor, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3 FROM documents WHERE n_chars IS NOT NULL GROUP BY extractor"


@query(f"WITH q AS ({_Q}) SELECT extractor, q1, q2, q3, min(n_chars) FILTER (n_chars >= q1 - 1.5 * (q3 - q1)) AS low_whisker, max(n_chars) FILTER (n_chars <= q3 + 1.5 * (q3 - q1)) AS high_whisker, count(*) FILTER (n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)) AS fliers FROM documents JOIN q USING (extractor) WHERE n_chars IS NOT NULL GROUP BY ALL")
def boxplot_whiskers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles, and the outermost values within 1.5 interquartile ranges of them."""
    return S.box(table(spark, sf_dir, "documents").where("extractor IS NOT NULL"), "extractor", "n_chars")


@query("WITH t AS (SELECT n_chars AS v FROM documents WHERE n_chars IS NOT NULL), b AS (SELECT least(79, CAST(floor((v - lo) * 80 / (hi - lo)) AS INT)) AS bin, count(*) AS n FROM t, (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM t) GROUP BY bin) SELECT bin, n, round((sum(n) OVER (ORDER BY bin DESC))::DOUBLE / (sum(n) OVER ()), 6) AS at_least FROM b")
def reverse_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of 80 bins with the share of values in each bin or a later one."""
    return S.reverse_density(table(spark, sf_dir, "documents"), "n_chars", 80)


_PROFILED = ("statement_type", "register_year", "annual_revenue", "link")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n, CASE WHEN count(DISTINCT {c}) < 6 THEN array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), '|') END AS shown FROM statements" for c in _PROFILED))
def column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each column has, and which if they are fewer than six."""
    return S.profile(table(spark, sf_dir, "statements"), _PROFILED, 6)


@query("WITH s AS (SELECT statement_id, max(page_count) AS p, max(word_count) AS w, max(entities) AS e, max(published_at) AS latest_at FROM statements GROUP BY statement_id) SELECT count(*) AS n, sum(p)::BIGINT AS pages, sum(w)::BIGINT AS words, sum(p) FILTER (a)::BIGINT AS annotated_pages, sum(w) FILTER (a)::BIGINT AS annotated_words, count(DISTINCT e) AS entities, max(latest_at) AS latest FROM (SELECT s.*, statement_id IN (SELECT statement_id FROM annotations WHERE statement_id IS NOT NULL) AS a FROM s)")
def annotated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and words of all statements and of annotated ones, entities, latest date."""
    s = table(spark, sf_dir, "statements").groupBy("statement_id").agg(F.max("page_count").alias("p"), F.max("word_count").alias("w"), F.max("entities").alias("e"), F.max("published_at").alias("at"))
    a = table(spark, sf_dir, "annotations").select("statement_id").distinct().withColumn("a", F.lit(True))
    x = s.join(a, "statement_id", "left")
    on = lambda c: F.sum(F.when(F.col("a"), F.col(c)))
    return x.agg(F.count("*").alias("n"), F.sum("p").alias("pages"), F.sum("w").alias("words"), on("p").alias("annotated_pages"), on("w").alias("annotated_words"), F.count_distinct("e").alias("entities"), F.max("at").alias("latest"))


@query("SELECT criterion, sum(n)::BIGINT AS sentences, sum(k)::BIGINT AS relevant FROM (SELECT statement_id, criterion, count(DISTINCT sentence_idx) AS n, count(DISTINCT sentence_idx) FILTER (trim(label) IN ('yes','Yes','YES','y','Y','True','true','1')) AS k FROM annotations GROUP BY ALL) GROUP BY criterion")
def relevant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and relevant ones per criterion: one aggregate per sentence, no distinct counts."""
    a = table(spark, sf_dir, "annotations").where("sentence_idx IS NOT NULL")
    one = a.groupBy("criterion", "statement_id", "sentence_idx").agg(F.bool_or(C.label(F.col("label")).eqNullSafe("YES")).alias("y"))
    return one.groupBy("criterion").agg(F.count("*").alias("sentences"), F.count_if("y").alias("relevant"))


@query("SELECT 'industry_sectors' AS field, count(DISTINCT t) AS n FROM (SELECT trim(unnest(string_split(industry_sectors, chr(10)))) AS t FROM statements) UNION ALL SELECT 'trademarks', count(DISTINCT t) FROM (SELECT trim(unnest(string_split(trademarks, ','))) AS t FROM statements) UNION ALL SELECT 'entities', count(DISTINCT t) FROM (SELECT trim(unnest(string_split(entities, ','))) AS t FROM statements)")
def distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of fields after splitting each by its own separator."""
    return S.distinct_tokens(table(spark, sf_dir, "statements"), {"industry_sectors": "\n", "trademarks": ",", "entities": ","})


@query("SELECT statement_id, count(*) AS n, count(DISTINCT md5(concat_ws('|', coalesce(idx, ''), coalesce(period_start, ''), coalesce(entities, ''), coalesce(link, '')))) = 1 AS identical FROM statements GROUP BY statement_id HAVING count(*) > 1")
def identical_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys, and whether all copies are the same."""
    return S.copies(table(spark, sf_dir, "statements"), "statement_id", ["idx", "period_start", "entities", "link"])


@query("SELECT (floor(n / 5) * 5)::BIGINT AS bin, round(avg(v), 6) AS mean FROM (SELECT agreed_positive_counts + agreed_negative_counts AS n, agreed_positive_counts::DOUBLE AS v FROM agreement_stats) GROUP BY bin ORDER BY mean DESC, bin")
def sorted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by bin, the largest first."""
    a = table(spark, sf_dir, "agreement_stats")
    n = F.col("agreed_positive_counts") + F.col("agreed_negative_counts")
    return a.groupBy((F.floor(n / 5) * 5).alias("bin")).agg(F.round(F.avg("agreed_positive_counts"), 6).alias("mean")).orderBy(F.desc("mean"), "bin")


@query("SELECT o_custkey, arg_max(o_orderkey, o_totalprice * 1000000 - o_orderkey / 1000000.0) AS o_orderkey, max(o_totalprice) AS best FROM orders GROUP BY o_custkey")
def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the largest value of each group; the smallest key at a tie."""
    return S.best(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all rows by a metric (top-k with k = 1)."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(1)


@query("SELECT event_type, max(event_id) AS last_step, max(ts) AS last_at, arg_max(value, event_id) AS last_value FROM events GROUP BY event_type")
def last_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last step of each log, with its value."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("event_id").alias("last_step"), F.max("ts").alias("last_at"), F.max_by("value", "event_id").alias("last_value"))


# --- arrays, maps, texts ---------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, i - 1 AS class_idx, " + "['" + "','".join(C.CRITERIA) + "'][i] AS criterion FROM (SELECT vec_id, label, unnest(range(4, 12)) AS i FROM embeddings) WHERE (vec_id + i) % 5 = 0 OR label = i - 1")
def later_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per positive class from the fourth on, with the name of its own position."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: ((i == F.col("label")) | ((F.col("vec_id") + i + 1) % 5 == 0)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode(V.positives(vector, C.CRITERIA, 3)).alias("p")).select("vec_id", F.col("p.idx").cast("long").alias("class_idx"), F.col("p.name").alias("criterion"))


@query("SELECT vec_id, coalesce(nullif(array_to_string(list_filter(list_transform(range(1, 12), lambda i: CASE WHEN (vec_id + i) % 6 = 0 THEN ['" + "','".join(C.CRITERIA) + "'][i] END), lambda x: x IS NOT NULL), '|'), ''), 'none') AS names FROM embeddings")
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the positive classes of a vector."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: ((F.col("vec_id") + i + 1) % 6 == 0).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(F.nullif(F.array_join(V.names(vector, C.CRITERIA), "|"), F.lit("")), F.lit("none")).alias("names"))


@query("WITH t AS (SELECT vec_id, list_transform(range(0, 12), lambda i: CASE WHEN i > vec_id % 13 THEN 0 ELSE vec_id % 97 + i + 1 END) AS ids FROM embeddings) SELECT vec_id, array_to_string(CASE WHEN list_position(ids, 0) > 0 THEN ids[1:list_position(ids, 0) - 1] ELSE ids END, ' ') AS ids FROM t")
def trimmed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays up to the first padding."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i > F.col("vec_id") % 13, F.lit(0).cast("long")).otherwise(F.col("vec_id") % 97 + i + 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(V.until(ids, 0).cast("array<string>"), " ").alias("ids"))


@query("SELECT doc_id, i - 1 AS idx, substr(s, 1 + (i - 1) % 3, greatest(0, length(s) - 2 - (i - 1) % 3)) AS target FROM (SELECT doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM documents)")
def target_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters that a mask marks as the target."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode("sentences").alias("idx", "s"))
    n = F.length("s")
    mask = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i >= F.col("idx") % 3) & (i < n - 2))).otherwise(F.array().cast("array<boolean>"))
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), V.masked_text(F.col("s"), mask).alias("target"))


@query("SELECT a.statement_id, c AS criterion, coalesce(n, 0) AS n FROM (SELECT DISTINCT statement_id FROM annotations WHERE statement_id IS NOT NULL) a CROSS JOIN (SELECT unnest(['" + "','".join(C.CRITERIA) + "']) AS c) LEFT JOIN (SELECT statement_id, criterion, count(*) AS n FROM annotations GROUP BY ALL) b ON b.statement_id = a.statement_id AND b.criterion = c")
def default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by criterion from a map, 0 for criteria that it lacks."""
    a = table(spark, sf_dir, "annotations").where("statement_id IS NOT NULL").groupBy("statement_id", "criterion").agg(F.count("*").alias("n"))
    m = a.groupBy("statement_id").agg(F.map_from_entries(F.collect_list(F.struct("criterion", "n"))).alias("m"))
    return m.select("statement_id", "m", F.explode(F.array(*[F.lit(c) for c in C.CRITERIA])).alias("criterion")).select("statement_id", "criterion", V.looked_up(F.col("m"), F.col("criterion"), F.lit(0).cast("long")).alias("n"))


@query("SELECT statement_id, strftime(loaded_at::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS iso, (strptime(strftime(loaded_at::TIMESTAMP, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S')) AS back, try_strptime(submitted_at, '%Y-%m-%d %H:%M:%S') AS submitted, try_strptime(submitted_at, '%Y-%m-%d %H:%M:%S') IS NULL AND coalesce(submitted_at, '') <> '' AS unreadable FROM statements")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps as ISO texts and back; times in one other notation."""
    s = table(spark, sf_dir, "statements")
    iso = X.iso_text(F.col("loaded_at"))
    at = X.time_of(F.col("submitted_at"))
    return s.select("statement_id", iso.alias("iso"), X.time_of_iso(iso).cast("timestamp_ntz").alias("back"), at.cast("timestamp_ntz").alias("submitted"), (at.isNull() & (F.coalesce("submitted_at", F.lit("")) != "")).alias("unreadable"))


@query("SELECT doc_id, regexp_replace(regexp_replace(substr(text, 1, length(text)), '\\s+', ' ', 'g'), '(.{50})', '\\1<br>', 'g') AS wrapped FROM documents WHERE text IS NOT NULL")
def wrapped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a break after every 50 characters."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.wrapped(F.regexp_replace("text", r"\s+", " "), 50, "<br>").alias("wrapped"))


@query("SELECT doc_id, i - 1 AS idx, 'Does this sentence describe ' || 'risks' || '? Answer yes or no.' || chr(10) || 'Context: ' || lang || chr(10) || 'Sentence: ' || s AS prompt FROM (SELECT doc_id, coalesce(lang, '') AS lang, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM documents)")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from a template with named fields."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode("sentences").alias("idx", "s"))
    t = "Does this sentence describe {what}? Answer yes or no.\nContext: {lang}\nSentence: {sentence}"
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), X.templated(t, what=F.lit("risks"), lang=F.col("lang"), sentence=F.col("s")).alias("prompt"))


@query("SELECT doc_id, i - 1 AS idx, contains(s, 'will') AS future, s IS NOT NULL AND contains(s, 'not') AS negative FROM (SELECT doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM documents)")
def comment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a comment mentions a word, as written; NULL comments mention nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode("sentences").alias("idx", "s"))
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), X.mentions(F.col("s"), "will").alias("future"), X.mentions(F.col("s"), "not").alias("negative"))


@query("SELECT doc_id, CASE WHEN len(sentences) = 1 THEN sentences[1] END AS only_one, coalesce(len(sentences), 0) AS n FROM documents")
def single_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of one item as that item."""
    return table(spark, sf_dir, "documents").select("doc_id", V.only_item(F.col("sentences")).alias("only_one"), F.coalesce(F.size("sentences"), F.lit(0)).cast("long").alias("n"))


@query("SELECT doc_id, sentence_idx, annotator_id, coalesce(sentence_idx >= 0 AND sentence_idx < len(sentences), FALSE) AS in_range, regexp_matches(printf('statement%05d:sentence%05d', statement_id, sentence_idx), '^statement[0-9]{5,}:sentence[0-9]{5,}$') AS well_formed FROM annotations JOIN documents USING (doc_id)".replace("printf('statement%05d:sentence%05d', statement_id", "printf('statement%05d:sentence%05d', annotations.statement_id"))
def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether places lie within their array, and ids have their form."""
    a = table(spark, sf_dir, "annotations").select("doc_id", "statement_id", "sentence_idx", "annotator_id").join(table(spark, sf_dir, "documents").select("doc_id", "sentences"), "doc_id")
    return a.select("doc_id", "sentence_idx", "annotator_id", V.within(F.col("sentence_idx"), F.coalesce(F.size("sentences"), F.lit(0))).alias("in_range"), X.is_sample_id(X.sample_id(F.col("statement_id"), F.col("sentence_idx"))).alias("well_formed"))


@query("SELECT statement_id, md5(coalesce(link, '')) AS md5, sha1(coalesce(link, '')) AS sha1 FROM statements")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a text."""
    link = F.coalesce("link", F.lit(""))
    return table(spark, sf_dir, "statements").select("statement_id", F.md5(link).alias("md5"), F.sha1(link).alias("sha1"))


@query("SELECT o_orderkey, (o_orderkey % 100) / 100.0 * (0.5 - 2.0) + 2.0 AS linear, CASE WHEN o_orderkey % 100 < 10 THEN (o_orderkey % 100) / 10.0 ELSE round(0.5 * (1 + cos(pi() * (o_orderkey % 100 - 10) / 90.0)), 6) END AS warm FROM orders")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by step: a straight line, and a warm-up with a cosine after it."""
    step = F.col("o_orderkey") % 100
    return table(spark, sf_dir, "orders").select("o_orderkey", V.linear_rate(step, 100, 2.0, 0.5).alias("linear"), F.round(V.warm_cosine_rate(step, 10, 100), 6).alias("warm"))


@query("SELECT n_nationkey, -(n_nationkey * 2 + 1) / 4.0 + 2 * (3 - n_regionkey) AS value FROM nation")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula of numbers, columns, + - * / and signs, checked before it becomes an expression."""
    return table(spark, sf_dir, "nation").select("n_nationkey", H.arithmetic("-(n_nationkey * 2 + 1) / 4 + 2 * (3 - n_regionkey)", {"n_nationkey", "n_regionkey"}).cast("double").alias("value"))


@query()
def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cleaned sentence with the places of its characters in the raw text."""
    d = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    return d.select("doc_id", F.explode(X.sentences_with_offsets("text")).alias("x")).select("doc_id", F.col("x.pos").alias("pos"), F.col("x.sentence").alias("sentence"), F.col("x.offsets").alias("offsets"))


# --- hooks ---------------------------------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE n_chars > 100 AND extractor IN ('fitz', 'abbyy') GROUP BY lang")
def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of steps from a configuration: each names a registered step and its parameters."""
    steps = [{"_target_": "longer_than", "column": "n_chars", "least": 100}, {"_target_": "one_of", "column": "extractor", "values": ["fitz", "abbyy"]}]
    return table(spark, sf_dir, "documents").transform(H.compose(steps)).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT vec_id, list_dot_product(embedding, embedding)::DOUBLE > 0 AS scored FROM embeddings")
def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scored in batches by a model that is loaded once per worker."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return H.scored(e, "embedding", lambda: lambda xs: [float(sum(v * v for v in x)) for x in xs], "score").select("vec_id", (F.col("score") > 0).alias("scored"))


@query("SELECT doc_id, i - 1 AS idx, CASE WHEN length(s) % 2 = 0 THEN 1 ELSE 0 END AS answer FROM (SELECT doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM documents)")
def mock_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mock in place of a remote classifier: a rule answers in words, and the words are read as 1, 0 or -1."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode("sentences").alias("idx", "s"))
    said = F.when(F.length("s") % 2 == 0, "Yes, it does.").otherwise("No.")
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), X.yes_no(said).alias("answer"))


@query("SELECT statement_id, criterion, sentence_idx, max(k) AS answer, count(*) AS n FROM (SELECT statement_id, criterion, sentence_idx, 1 AS k FROM (SELECT DISTINCT statement_id, criterion, sentence_idx FROM annotations WHERE annotator_idx = 0) UNION ALL SELECT DISTINCT statement_id, criterion, sentence_idx, 0 FROM annotations a WHERE NOT EXISTS (SELECT 1 FROM annotations b WHERE b.annotator_idx = 0 AND b.statement_id = a.statement_id AND b.criterion = a.criterion AND b.sentence_idx = a.sentence_idx)) GROUP BY ALL")
def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scored before keep their score; only the others are scored, then both are put together."""
    a = table(spark, sf_dir, "annotations")
    keys = ["statement_id", "criterion", "sentence_idx"]
    before = a.where("annotator_idx = 0").select(*keys, F.lit(1).alias("answer")).distinct()
    x = H.incremental(a.select(*keys).distinct(), before, keys, lambda new: new.withColumn("answer", F.lit(0)))
    return x.groupBy(*keys).agg(F.max("answer").alias("answer"), F.count("*").alias("n"))
