"""Finding excerpts among the sentences of their own text: exact, then inside a sentence, then the nearest by edit distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.edits import Texts, nearest

WITHIN = 0.999
STAGES = ["exact", "inside", "near"]


def best_match(sentences: Column, excerpt: Column, threshold: float = 0.0) -> Column:
    """struct<idx, score, stage> of the excerpt among the array of sentences; NULL without sentences or below the threshold.

    Stages: exact (score 1), inside a sentence (0.999), nearest (1 - distance / longer length). The first index wins ties. A stage is
    only computed where those before it failed. The nearest keeps the best so far: a distance is computed only up to what
    would still beat it, and not at all where the lengths alone rule that out. A threshold above 1 leaves the last stage out.
    """
    made = lambda idx, score, stage: F.struct(idx.cast("int").alias("idx"), score.alias("score"), F.lit(stage).alias("stage"))
    same = F.array_position(sentences, excerpt)
    within = F.array_position(F.transform(sentences, lambda s: F.contains(s, excerpt)), F.lit(True))
    start = F.struct(F.lit(-1).alias("idx"), F.lit(-1.0).alias("score"), F.lit(-1).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        longest = F.greatest(F.length(s), F.length(excerpt), F.lit(1))
        # The largest distance that beats the best so far; equal ones don't.
        most = F.ceil(longest * (1 - acc["score"]) - 1e-9).cast("int") - 1
        off = F.abs(F.length(s) - F.length(excerpt))
        d = F.when(off <= most, F.call_function("levenshtein", s, excerpt, F.least(most, longest)))
        at = acc["at"] + 1
        return F.when(d.isNotNull() & (d >= 0), F.struct(at.alias("idx"), (1 - d / longest).alias("score"), at.alias("at"))).otherwise(F.struct(acc["idx"].alias("idx"), acc["score"].alias("score"), at.alias("at")))

    near = F.aggregate(sentences, start, step, lambda acc: F.when((acc["idx"] >= 0) & (acc["score"] >= threshold), made(acc["idx"], F.round(acc["score"], 6), "near")))
    if threshold > 1:  # no score reaches it: the last stage isn't there at all
        near = F.lit(None).cast("struct<idx: int, score: double, stage: string>")
    found = F.when(same > 0, made(same - 1, F.lit(1.0), "exact")).otherwise(F.when(within > 0, made(within - 1, F.lit(WITHIN), "inside")).otherwise(near))
    return F.when((F.size(sentences) > 0) & excerpt.isNotNull(), found)


def matched(excerpts: DataFrame, sentences: DataFrame, key: str, threshold: float = 0.0) -> DataFrame:
    """excerpts (key, part, excerpt) with (matched_idx, score, stage) from sentences (key, idx, sentence), as best_match() says.

    Sentences and excerpts meet as one array each per key, so one join on the key serves all stages and no sentence moves twice. The
    nearest of many keys' excerpts are looked for at once (functions/edits.py). Excerpts of keys without sentences, and
    NULL ones, have no row.
    """
    arrays = sentences.where("sentence IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "sentence"))).alias("_s"))
    arrays = arrays.select(key, F.transform("_s", lambda s: s["sentence"]).alias("_s"), F.transform("_s", lambda s: s["idx"]).alias("_i"))
    asked = excerpts.where("excerpt IS NOT NULL").groupBy(key).agg(F.collect_list(F.struct("part", "excerpt")).alias("_x"))
    asked = asked.select(key, F.transform("_x", lambda x: x["excerpt"]).alias("_x"), F.transform("_x", lambda x: x["part"]).alias("_p"))
    part, idx = excerpts.schema["part"].dataType, sentences.schema["idx"].dataType
    kept = [excerpts.schema[key], T.StructField("part", part), T.StructField("excerpt", T.StringType()), T.StructField("matched_idx", idx), T.StructField("score", T.DoubleType()), T.StructField("stage", T.StringType())]
    found = asked.join(arrays, key).select(key, "_x", "_p", "_s", "_i").mapInArrow(best_matches(threshold), T.StructType(kept))
    return found.withColumn("score", F.round("score", 6))


def best_matches(threshold: float = 0.0, most: int = 1 << 24) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step from (key, excerpts, parts, sentences, idxs) to (key, part, excerpt, matched_idx, score, stage), as best_match() says but
    for the rounding of scores. Keys of about `most` bytes are looked at together."""

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        key, xs, ps, ss, ids = b.columns
        x, s = xs.flatten().to_pylist(), ss.flatten().to_pylist()
        many, count = pc.list_value_length(xs).to_numpy(), pc.list_value_length(ss).to_numpy()
        first = np.repeat(np.cumsum(count, dtype=np.int64) - count, many)
        count = np.repeat(count, many).astype(np.int64)
        at, score, stage = np.full(len(x), -1), np.zeros(len(x)), np.full(len(x), 2)
        places: dict[str, int] = {}
        begin = -1
        for k, (e, f, n) in enumerate(zip(x, first.tolist(), count.tolist(), strict=True)):
            if f != begin:
                begin, own = f, s[f : f + n]
                places = {}
                for i, t in enumerate(own):
                    places.setdefault(t, i)
            if e in places:
                at[k], score[k], stage[k] = f + places[e], 1.0, 0
                continue
            i = next((i for i, t in enumerate(own) if e in t), -1)
            if i >= 0:
                at[k], score[k], stage[k] = f + i, WITHIN, 1
        rest = np.flatnonzero(at < 0)
        if len(rest) and threshold <= 1:
            a, texts = Texts([x[k] for k in rest.tolist()]), Texts(s)
            which, d = nearest(a, texts, first[rest], count[rest])
            at[rest] = first[rest] + which
            score[rest] = 1 - d / np.maximum(np.maximum(a.size, texts.size[at[rest]]), 1)
        good = np.flatnonzero((at >= 0) & ((stage < 2) | (score >= threshold)))
        take = pa.array(good)
        of = np.repeat(np.arange(b.num_rows), many)[good]
        columns = [key.take(pa.array(of)), ps.flatten().take(take), xs.flatten().take(take), ids.flatten().take(pa.array(at[good])), pa.array(score[good]), pa.array(STAGES).take(pa.array(stage[good]))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "part", "excerpt", "matched_idx", "score", "stage"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.zeros(b.num_rows + 1, np.int64)
            for c in (b.column(1), b.column(3)):
                texts = c.flatten()
                ends += np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])[np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy())])]
            k = 0
            while k < b.num_rows:
                to = max(k + 1, int(np.searchsorted(ends, ends[k] + most, side="right")) - 1)
                yield rows(b.slice(k, to - k))
                k = to

    return run
