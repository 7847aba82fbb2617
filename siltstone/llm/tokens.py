"""Encoding with a public byte-pair tokenizer, reusing content-defined chunks.

A text is cut where a rolling hash over its last 16 code points meets a mask, so equal passages give equal chunks wherever
they stand. A chunk is encoded once and kept; what its ends would have merged into across a joint is repaired: from the last
place before a joint at which the tokenizer always parts words to the first such place after it, the text is encoded anew (and
kept, too). If a chunk has no such place the repair goes on into the next chunk. Ids therefore equal those of the whole text.

Chunks are kept per worker, within bounds on their number and size: a memo needs no shuffle, while a table of the chunks of a whole corpus
would have to move all of its text and ids twice.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before merges, as the vocabulary's publisher gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Places at which PATTERN parts words whatever stands around: before white space after anything else; between a letter of the
# large scripts and common punctuation. Code points of which versions of Unicode disagree are left out.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-zÀ-ÖØ-öø-ſぁ-ゖァ-ヺ一-龥가-힣"
SAFE = re.compile(rf"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[{_LETTER}])(?=[.,;:!?()\"、。！，：；？])")
_GEAR = np.random.default_rng(16).integers(0, 1 << 63, 4096, dtype=np.uint64)


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """folder, else the one of SILTSTONE_TOKENIZERS, else /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers"), name)


_ENCODINGS: dict[str, object] = {}


def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def chunk_ends(text: str, bits: int = 7, least: int = 48, most: int = 4096) -> list[int]:
    """Content-defined ends of chunks in text, the last being its length; chunks have about 2**bits code points, at least `least`
    and, where the content gives no end, `most` (the last one up to most + least)."""
    n = len(text)
    if n <= 2 * least:
        return [n]
    h = _GEAR[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 4095]
    for w in (1, 2, 4, 8):
        g = h.copy()
        g[w:] += h[:-w] << np.uint64(w)
        h = g
    at = np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << bits) - 1) == 0) + 1
    ends, last = [], 0
    for e in (*at.tolist(), n):
        while e - last > most + least:
            last += most
            ends.append(last)
        if e - last >= least and n - e >= least:
            ends.append(e)
            last = e
    ends.append(n)
    return ends


class ChunkEncoder:
    """Ids of texts, by chunks that are kept; keep: how many chunks and repairs at most, held: how many code points of chunks."""

    def __init__(self, path: str, keep: int = 150_000, held: int = 1 << 25) -> None:
        self.enc = encoding(path).encode_ordinary
        self.keep, self.held, self.size = keep, held, 0
        self.chunks: dict[str, tuple[int, array | None, int]] = {}
        self.joints: dict[str, array] = {}
        self.hits = self.misses = 0

    def _ids(self, s: str) -> array:
        """Lone surrogates, which no UTF-8 text has, are encoded as U+FFFD."""
        try:
            return array("i", self.enc(s))
        except UnicodeEncodeError:
            return array("i", self.enc(s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")))

    def _joint(self, s: str) -> array:
        got = self.joints.get(s)
        if got is None:
            got = self._ids(s)
            if len(s) <= 256:
                if len(self.joints) >= self.keep:
                    self.joints.clear()
                self.joints[s] = got
        return got

    def _chunk(self, s: str) -> tuple[int, array | None, int]:
        """Where the first and the last safe place of chunk s are, and the ids between them; None if it has none."""
        got = self.chunks.get(s)
        if got is None:
            self.misses += 1
            m = SAFE.search(s)
            if m is None:
                got = (0, None, 0)
            else:
                a = b = m.start()
                k = max(a, len(s) - 48)  # the last safe place is near the end, as a rule
                for m in SAFE.finditer(s, k):
                    b = m.start()
                if b == a and k > a:
                    for m in SAFE.finditer(s, a):
                        b = m.start()
                got = (a, self._ids(s[a:b]), b)
            if len(self.chunks) >= self.keep or self.size > self.held:
                self.chunks.clear()
                self.size = 0
            self.chunks[s] = got
            self.size += len(s)
        else:
            self.hits += 1
        return got

    def encode(self, text: str | None) -> array:
        """Ids of text; none for NULL and empty texts."""
        if not text:
            return array("i")
        out, open_, at = array("i"), "", 0
        for e in chunk_ends(text):
            s = text[at:e]
            at = e
            a, ids, b = self._chunk(s)
            if ids is None:
                open_ += s
                continue
            open_ += s[:a]
            if open_:
                out.extend(self._joint(open_))
            out.extend(ids)
            open_ = s[b:]
        if open_:
            out.extend(self._joint(open_))
        return out


class PartCounter:
    """Token counts of parts between safe places; mostly words, so most have been counted before. keep: how many at most."""

    def __init__(self, encoder_: ChunkEncoder, keep: int = 300_000) -> None:
        self.enc = encoder_._ids
        self.keep = keep
        self.known: dict[str, int] = {"": 0}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        out = []
        for p in parts:
            n = known.get(p)
            if n is None:
                n = len(self.enc(p))
                if len(p) <= 64:
                    if len(known) >= self.keep:
                        known.clear()
                        known[""] = 0
                    known[p] = n
            out.append(n)
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder: chunks stay kept from batch to batch and task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def id_arrays(texts: list[str | None], path: str) -> pa.ListArray:
    """list<int32> of ids."""
    e, values, ends = encoder(path), array("i"), [0]
    for t in texts:
        values.extend(e.encode(t))
        ends.append(len(values))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, dtype=np.int32) if values else np.empty(0, np.int32)))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `limit` bytes in column at most (single longer rows stay whole)."""
    import pyarrow.compute as pc

    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum() if b.num_rows else []
        if not b.num_rows:
            continue
        at, base = 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield b.slice(at, to - at)
            base, at = size[to - 1], to


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids array<int>) for every row of df: the ids of its text without special tokens.

    NULL and empty texts have an empty list. Rows are neither joined nor dropped: repeated and NULL keys stay. Other columns are
    not read. Strings that look like special tokens are ordinary text.
    """
    path = path or vocabulary_path()
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = src.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("key"), id_arrays(b.column("text").to_pylist(), path)], names=["key", "ids"])

    return src.mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])).withColumnRenamed("key", key)
