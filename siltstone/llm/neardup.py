"""Near-duplicate texts by a token-group matrix: similar texts in groups, a token union per group, a bound before a group is opened.

Texts are compared in lower case and folded, as sets of substrings of `gram` code points (their tokens).

1. Exact copies (by a digest of 128 bits) become one text with members.
2. A text is sketched: its tokens below a threshold on their hash (the threshold falls with the number of tokens, so that 32 to
   64 are expected; 32 bits of each are kept), and its keys.
3. Texts meet over keys (meeting_keys). A key is a band of `ROWS` min-hashes over all tokens, so two texts of similarity s have each key in common with probability
   s ** ROWS, whatever their size, where they differ, and how many other texts have it. All of the keys of a pair at 0.6 differ
   in far less than one of 1,000 pairs. Four bits of each min-hash go along; of pairs with a common key only those go on that have
   as many of them in common as the similarity lets expect, less 3.5 deviations. Texts of keys of very many texts, as a shared passage makes
   them, are compared in the same way, all with all, but in blocks (block_pairs) and not by a join.
4. Texts with the same smallest shared key make a group, parted by a hash into about 64 texts at most; the matrix has the union of
   its sketched tokens and the smallest number of tokens.
5. A text meets the groups of those texts. The overlap of its sketch with the group's union bounds that with any member. Only groups that can reach the similarity, less a margin of 3.5 deviations of the
   sampling, are opened; members pass the same bound on their own sketch.
6. What passes is compared exactly, on whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .tokens import small_batches

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
# Min-hashes of a text; each is in two keys of ROWS, the second time in another company.
HASHES, ROWS = 128, 4
_RANDOM = np.random.default_rng(6)
_FACTORS = (_RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_BANDS = np.concatenate([np.arange(HASHES), _RANDOM.permutation(HASHES)]).reshape(-1, ROWS)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    m = 1
    while m < n:
        k = min(m, n - m)
        out[m : m + k] = out[:k] * (out[m - 1 : m] * base)
        m += k
    return out


_CACHE: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _CACHE or len(_CACHE["up"]) < n:
        size = max(n, 1 << 16)
        _CACHE["up"], _CACHE["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _CACHE["up"], _CACHE["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    """Non-negative hashes of 63 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def folded(text: str) -> str:
    """In lower case, white space of any kind trimmed at the ends and collapsed to one plain space."""
    return " ".join(text.split()).lower()


class Windows:
    """Hashes of all windows of any length of some texts, from one running polynomial over them."""

    def __init__(self, texts: list[str]) -> None:
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        c += np.uint64(1)
        c *= np.uint64(0xD6E8FEB86659FD93)
        c ^= c >> np.uint64(32)
        up, self.down = _tables(len(c) + 1)
        self.sums = np.zeros(len(c) + 1, dtype=np.uint64)
        np.cumsum(c * up[: len(c)], out=self.sums[1:])
        self.starts = np.cumsum([0, *map(len, texts)]).tolist()
        self.made: dict[int, np.ndarray] = {}

    def of(self, text: int, w: int) -> np.ndarray:
        """Hashes of the windows of w code points of the text of that number."""
        a, b = self.starts[text], self.starts[text + 1]
        if b - a < w:
            return np.empty(0, np.int64)
        if w not in self.made:
            self.made[w] = self._hashes(0, self.starts[-1], w)
        return self.made[w][a : b - w + 1]

    def _hashes(self, a: int, b: int, w: int) -> np.ndarray:
        k = max(0, b - w + 1)
        return _mix((self.sums[a + w : b + 1] - self.sums[a:k]) * self.down[a:k] + np.uint64(w))


def grams(text: str, gram: int) -> np.ndarray:
    """Sorted distinct token hashes of a folded text."""
    return np.unique(Windows([text]).of(0, gram))


def level(n: int) -> int:
    """Thresholds on hashes are 2**63 / 2**level."""
    return max(0, (n // 32).bit_length() - 1)


def band_keys(x: Windows, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, signs of 16 min-hashes a number) of all texts of x, a row each; every text has at least gram code points."""
    n = np.diff(x.starts) - gram + 1
    signs = np.empty((HASHES, len(n)), np.uint32)
    i = 0
    while i < len(n):
        # Some texts at a time, that fit into the cache of a core.
        j = max(i + 1, int(np.searchsorted(np.cumsum(n[i:]), 1 << 16)) + i)
        h = (np.concatenate([x.of(k, gram) for k in range(i, j)]) >> 31).astype(np.uint32)
        at = np.cumsum(n[i:j]) - n[i:j]
        turned = np.empty_like(h)
        for k in range(HASHES):
            np.multiply(h, _FACTORS[k], out=turned)
            signs[k, i:j] = np.minimum.reduceat(turned, at)
        i = j
    keys = np.repeat(np.arange(len(_BANDS), dtype=np.uint64)[:, None], len(n), axis=1)
    for k in range(ROWS):
        keys = keys * _BASE + signs[_BANDS[:, k]]
        keys ^= keys >> np.uint64(29)
    few = np.zeros((HASHES // 16, len(n)), np.uint64)
    for k in range(HASHES):
        few[k // 16] |= (signs[k] * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint64) << np.uint64(k % 16 * 4)
    return _mix(keys).T, few.view(np.int64).T


def sketch(x: Windows, i: int, gram: int) -> tuple[int, int, np.ndarray]:
    """(tokens, level, sketched tokens) of the i-th folded text of x."""
    t = np.unique(x.of(i, gram))
    lv = level(len(t))
    some = t[: np.searchsorted(t, (1 << 63) >> lv)] if lv else t
    return len(t), lv, np.unique((some >> 31) - (1 << 31)).astype(np.int32)


def sketches(df: DataFrame, gram: int) -> DataFrame:
    """(id, digest, n, level, tokens, keys, signs) of df (id, text): one row per text of at least gram code points when folded."""
    kind = df.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 1 << 20):
            texts = [folded(t) for t in b.column("text").to_pylist()]
            take = [i for i, t in enumerate(texts) if len(t) >= gram]
            texts = [texts[i] for i in take]
            if not texts:
                continue
            x = Windows(texts)
            rows = [(*sketch(x, i, gram), k, g) for i, (k, g) in enumerate(zip(*band_keys(x, gram), strict=True))]
            digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            lists = lambda k: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(r[k]) for r in rows]]), pa.int32()), pa.array(np.concatenate([r[k] for r in rows])))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(take)), pa.array(digests, pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), lists(2), lists(3), lists(4)], names=["id", "digest", "n", "level", "tokens", "keys", "signs"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("signs", T.ArrayType(T.LongType()))])
    return df.mapInArrow(run, schema)


def _deviations(share: float, n: int, exact: bool) -> float:
    """The least count among n sampled tokens, of which a share is expected: less 3.5 deviations, unless nothing was left out."""
    return share * n - (0.0 if exact else 3.5 * (share * (1 - share) * n) ** 0.5)


def _below(tokens: np.ndarray, level: int) -> np.ndarray:
    """The sorted sketch at a coarser level."""
    return tokens[: np.searchsorted(tokens, (1 << 32 >> level) - (1 << 31))] if level else tokens


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def opened_groups(threshold: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Likely pairs (a, b) of a bucket: askers (g, part, id, n, level, tokens) and members (the same columns, with m_)."""

    def run(askers: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        rows = []
        of: dict[tuple, list[tuple]] = {}
        for g, part, *m in members[["m_g", "m_part", "m_id", "m_n", "m_level", "m_tokens"]].itertuples(index=False, name=None):
            of.setdefault((g, part), []).append(m)
        matrix = {k: (np.unique(np.concatenate([m[3] for m in ms])), max(m[2] for m in ms)) for k, ms in of.items()}
        for g, part, i, n, level, tokens in askers[["g", "part", "id", "n", "level", "tokens"]].itertuples(index=False, name=None):
            union, top = matrix[g, part]
            lv = max(level, top)
            own = _below(tokens, lv)
            # A member of the similarity has at least that share of the text's own tokens, all of them in the union.
            if _common(own, union) < _deviations(threshold, len(own), lv == 0) - 1e-9:
                continue
            for d, dn, dl, dt in of[g, part]:
                if d > i and min(n, dn) >= threshold * max(n, dn) - 1e-9:
                    lv = max(level, dl)
                    x, y = _below(tokens, lv), _below(dt, lv)
                    c = _common(x, y)
                    if c >= _deviations(threshold, len(x) + len(y) - c, lv == 0) - 1e-9:
                        rows.append((i, d))
        return pd.DataFrame(rows, columns=["a", "b"])

    return run


def bounded(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, marked for broadcast if it has at most `most` narrow rows (it is counted, so it should be a written table); beyond that a
    join with it shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def shared_keys(postings: DataFrame) -> DataFrame:
    """(id, key, texts): the postings (id, key) whose key has at least two texts, with the number of its texts."""
    counts = cut(postings.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1"), "counts")
    return cut(postings.join(bounded(counts), "key").select("id", "key", "texts"), "postings")


def block_pairs(hot: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """Pairs (id, o_id), id < o_id, of texts that have a key in common and pass the comparison of sizes and min-hashes; hot: (key, texts, id, n, signs).

    All texts of a key are compared with all others, in squares of two blocks of about `block` texts: nothing is left out, and a key of any
    number of texts is spread over many groups. A pair of texts of fitting sizes costs a comparison of 64 bytes.
    """
    kind = hot.schema["id"].dataType
    blocks = F.ceil(F.col("texts") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    cells = hot.select("key", "id", "n", "signs", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = cells.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id", "n", "signs", "own")
    least = _deviations(_each(threshold), HASHES, False)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("n")
        n = t.column("n").to_numpy()
        signs = pc.list_flatten(t.column("signs")).to_numpy().view(np.uint64).reshape(len(n), -1)
        within = t.column("p")[0] == t.column("q")[0]
        left = np.ones(len(n), bool) if within else t.column("own").to_numpy() == t.column("p")[0].as_py()
        rows, columns = np.flatnonzero(left), np.flatnonzero(left if within else ~left)
        a, b = [], []
        for k in range(0, len(rows), 64):
            i = rows[k : k + 64]
            # Sizes that can fit, in their order.
            j = columns[np.searchsorted(n[columns], n[i[0]] * threshold - 1) : np.searchsorted(n[columns], n[i[-1]] / threshold + 1, side="right")]
            differing = np.zeros((len(i), len(j)), np.uint16)
            for w in range(signs.shape[1]):
                x = signs[i, None, w] ^ signs[None, j, w]
                x |= x >> np.uint64(1)
                x |= x >> np.uint64(2)
                x &= np.uint64(0x1111111111111111)
                differing += np.bitwise_count(x)
            ok = HASHES - differing.astype(np.int32) >= least
            small, large = np.minimum(n[i, None], n[None, j]), np.maximum(n[i, None], n[None, j])
            ok &= small >= threshold * large - 1e-9
            if within:
                ok &= i[:, None] < j[None, :]
            x, y = np.nonzero(ok)
            a.append(i[x])
            b.append(j[y])
        ids = t.column("id").combine_chunks()
        x, y = (ids.take(pa.array(np.concatenate([np.empty(0, np.int64), *c]))) for c in (a, b))
        first = pc.less(x, y)
        return pa.table({"id": pc.if_else(first, x, y), "o_id": pc.if_else(first, y, x)})

    return cells.groupBy("key", "p", "q").applyInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("o_id", kind)]))


def _each(threshold: float) -> float:
    """The share of equal signs of min-hashes that is expected at the threshold; a sixteenth of unequal min-hashes have equal signs."""
    return threshold + (1 - threshold) / 16


def meeting_keys(postings: DataFrame, hot: int = 1000, hotter: int = 20) -> DataFrame:
    """(id, key) over which most, not all, texts meet, from their keys (id, key); keys of one text alone are left out.

    near_pairs() doesn't use it, for it leaves partners out: see block_pairs(). It is for where few meetings count more than whole results.
    A key of more than `hot` texts would let each of them meet all others. Its texts meet over pairs of such keys instead, and where a
    pair, too, has more than hot * hotter texts, over triples whose pairs all have. Two texts that share any key of few
    texts meet there as ever. With 64 keys, of which texts of similarity 0.6 share 8.3 on average, fewer than two are shared by 0.15 %
    of such texts and fewer than three by 0.8 %; at 0.65 by 0.005 % and 0.04 %. Texts that share only a passage of a
    third of each (similarity 0.2) share a key in 10 %, a pair in 0.5 % and a triple in 0.02 % of cases. A text has up to 2,016 pairs, but as many only if
    it is much like over `hot` others, which it then is a pair with.
    """
    counted = lambda x: cut(x.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1"), "counts")
    shared = shared_keys(postings)
    out = shared.where(F.col("texts") <= hot).select("id", "key")
    if shared.where(F.col("texts") > hot).isEmpty():
        return out
    own = shared.where(F.col("texts") > hot).groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("k"))
    two = F.flatten(F.transform("k", lambda a, i: F.transform(F.slice("k", i + 2, F.greatest(F.size("k") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = own.select("id", F.explode(two).alias("p")).select("id", "p", F.xxhash64("p.a", "p.b").alias("key"))
    pair_counts = counted(pairs)
    pairs = cut(pairs.join(bounded(pair_counts), "key"), "pairs")
    most = hot * hotter
    out = out.unionByName(pairs.where(F.col("texts") <= most).select("id", "key"))
    if pair_counts.where(F.col("texts") > most).isEmpty():
        return out
    sets = pairs.where(F.col("texts") > most).groupBy("id").agg(F.collect_list("p").alias("ps"))
    three = F.flatten(F.transform("ps", lambda p: F.transform(F.filter("ps", lambda q: (q["a"] == p["b"]) & F.array_contains("ps", F.struct(p["a"].alias("a"), q["b"].alias("b")))), lambda q: F.xxhash64(p["a"], p["b"], q["b"]))))
    return out.unionByName(sets.select("id", F.explode(three).alias("key")))


def near_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, gram: int = 12, hot: int = 1000, group: int = 64, per_bucket: int = 8000, repeated_keys: bool = False, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(pairs, members).

    pairs (a, b, similarity), a < b: texts whose similarity is at least threshold, between the smallest keys of their exact copies.
    members (id, rep): the keys of texts that have copies, with the smallest key of their class.
    NULL texts, those shorter than gram code points when folded, and NULL keys are in no pair and no class. Keys of more than `hot` texts meet in blocks of `block`: see block_pairs(). Keys must be unique,
    unless repeated_keys: then repeated rows of one key and text count once. Other columns are not read. Empty df: no rows.
    """
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    every = cut(sketches(docs, gram), "sketches")
    # One text per class: copies meet by their digest in narrow rows, map-side first.
    several = every.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    members = cut(every.select("id", "digest").join(bounded(cut(several, "classes")), "digest").select("id", "rep").distinct(), "members")
    reps = every.join(bounded(members.where("id <> rep").select("id")), "id", "left_anti")
    if repeated_keys:
        reps = reps.dropDuplicates(["id", "digest"])

    postings = reps.select("id", F.explode("keys").alias("key"))
    keys = shared_keys(postings)

    lowest = keys.groupBy("id").agg(F.min("key").alias("g"))
    sizes = lowest.groupBy("g").agg(F.count("*").alias("size"))
    homes = lowest.join(sizes, "g").select("id", "g", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / group)).alias("part")).join(reps.select("id", "n"), "id")
    homes = cut(homes, "homes")

    # Pairs by their keys; most differ in too many min-hashes and end here.
    signs = [f"s{i}" for i in range(HASHES // 16)]
    asking = keys.where(F.col("texts") <= hot).select("id", "key").join(reps.select("id", "n", *[F.get("signs", F.lit(i)).alias(c) for i, c in enumerate(signs)]), "id")
    other = asking.withColumnsRenamed({c: f"o_{c}" for c in ("id", "n", *signs)})
    fitting = (F.col("id") < F.col("o_id")) & (F.least("n", "o_n") >= threshold * F.greatest("n", "o_n") - 1e-9)
    differing = " + ".join(f"bit_count(({c} ^ o_{c} | shiftrightunsigned({c} ^ o_{c}, 1) | shiftrightunsigned({c} ^ o_{c}, 2) | shiftrightunsigned({c} ^ o_{c}, 3)) & {0x1111111111111111})" for c in signs)
    alike = HASHES - F.expr(differing) >= _deviations(_each(threshold), HASHES, False)
    met = asking.join(other, "key").where(fitting & alike).select("id", "o_id")
    many = keys.where(F.col("texts") > hot)
    if not many.isEmpty():
        met = met.unionByName(block_pairs(many.join(reps.select("id", "n", "signs"), "id"), threshold, block))
    met = met.distinct()
    meets = cut(met.join(homes.select(F.col("id").alias("o_id"), "g", "part"), "o_id").select("id", "g", "part").distinct(), "meets")

    # Sketches move once, to buckets of groups; a group with many askers is in several buckets, each with all of its few members.
    buckets = max(1, -(-meets.count() // per_bucket))
    asked_by = meets.groupBy("g", "part").agg(F.ceil(F.count("*") / per_bucket).cast("int").alias("salts"))
    bucket = F.pmod(F.xxhash64("g", "part", "salt"), F.lit(buckets)).alias("bucket")
    tokens = reps.select("id", "n", "level", "tokens")
    asked = meets.join(asked_by, ["g", "part"]).withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int")).select("id", "g", "part", bucket).join(tokens, "id")
    inside = homes.select("id", "g", "part").join(asked_by, ["g", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("id", "g", "part", bucket).join(tokens, "id")
    inside = inside.select(*[F.col(c).alias(f"m_{c}") for c in inside.columns])
    kind = reps.schema["id"].dataType
    pair = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    likely = asked.groupBy("bucket").cogroup(inside.groupBy("m_bucket")).applyInPandas(opened_groups(threshold), pair).distinct()
    likely = cut(likely, "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.join(bounded(cut(wanted, "wanted")), "id", "left_semi")
    texts = cut(texts.dropDuplicates(["id"]) if repeated_keys else texts, "texts")
    both = likely.join(texts.withColumnsRenamed({"id": "a", "text": "x"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "y"}), "b")
    return verified(both, gram).where(F.col("common") >= threshold * F.col("either") - 1e-9).select("a", "b", (F.col("common") / F.col("either")).alias("similarity")), members


def verified(both: DataFrame, gram: int) -> DataFrame:
    """both (a, b, x, y) with the sizes of intersection and union of the token sets of x and y."""
    a, b = both.schema["a"], both.schema["b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[object, np.ndarray] = {}

        def of(k: object, t: str) -> np.ndarray:
            if k not in kept:
                if len(kept) >= 500:
                    kept.clear()
                kept[k] = grams(folded(t), gram)
            return kept[k]

        for p in batches:
            rows = []
            for i, j, x, y in zip(p["a"], p["b"], p["x"], p["y"], strict=True):
                s, t = of(i, x), of(j, y)
                c = len(np.intersect1d(s, t, assume_unique=True))
                rows.append((i, j, c, len(s) + len(t) - c))
            yield pd.DataFrame(rows, columns=["a", "b", "common", "either"])

    return both.mapInPandas(run, T.StructType([a, b, T.StructField("common", T.LongType()), T.StructField("either", T.LongType())]))


def expanded(pairs: DataFrame, members: DataFrame, copies: int | None = 100) -> DataFrame:
    """(a, b), a < b: pairs with their classes' members put in.

    Classes of up to `copies` members, with None those of any size, are expanded into all pairs. A larger class (it can hold a third of all rows) isn't: each of its
    members is paired with its representative, and only the representative with other texts.
    """
    small = members.groupBy("rep").agg(F.count("*").alias("n"))
    inside = members.join(small, "rep")
    small_enough = F.lit(True) if copies is None else F.col("n") <= copies
    few = inside.where(small_enough).select("rep", "id")
    many = inside.where(~small_enough & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    own = few.alias("s").join(few.alias("t"), "rep").where("s.id < t.id").select(F.col("s.id").alias("a"), F.col("t.id").alias("b"))
    x = pairs.select("a", "b").join(few.withColumnsRenamed({"rep": "a", "id": "i"}), "a", "left").join(few.withColumnsRenamed({"rep": "b", "id": "j"}), "b", "left")
    x = x.select(F.coalesce("i", "a").alias("i"), F.coalesce("j", "b").alias("j")).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    return x.unionByName(own).unionByName(many)
