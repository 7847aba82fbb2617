"""Filling containers of fixed capacity: items in the order of a space-filling curve over hashed vectors, packed with their neighbours."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .tokens import encoder, small_batches, vocabulary_path

DIMS, BITS = 4, 12


def projection(ids: int, dims: int = DIMS, seed: int = 9) -> np.ndarray:
    """A direction of dims numbers for each of ids hash values."""
    return np.random.default_rng(seed).standard_normal((ids, dims)).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (uint, below 2**bits); neighbours on the curve are neighbours in space."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        p = q - one
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p).astype(np.uint64)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def sized_vectors(df: DataFrame, key: str, text: str, path: str, dims: int = DIMS) -> DataFrame:
    """(key, size, v): tokens of each text and the mean direction of its hashed tokens; NULL and empty texts have size 0."""
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    directions = projection(1 << 13, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in small_batches(batches, "text"):
            sizes, vs = [], []
            for t in b.column("text").to_pylist():
                ids = np.frombuffer(e.encode(t) or b"", dtype=np.int32)
                sizes.append(len(ids))
                vs.append((directions[ids & 8191].mean(axis=0) if len(ids) else np.zeros(dims)).tolist())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sizes, pa.int64()), pa.array(vs, pa.list_(pa.float32()))], names=["key", "size", "v"])

    return src.mapInArrow(run, T.StructType([T.StructField("key", src.schema["key"].dataType), T.StructField("size", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType()))]))


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: containers as lists of places in sizes (all at most capacity)."""
    out: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(free, (sizes[i], -1))
        if k < len(free):
            room, c = free.pop(k)
        else:
            room, c = capacity, len(out)
            out.append([])
        out[c].append(i)
        insort(free, (room - sizes[i], c))
    return out


def packed_stream(items: Iterator[tuple[int, object]], capacity: int, window: int = 4096, full: float = 0.99) -> Iterator[list[tuple[int, object]]]:
    """Containers of (size, what), from items in curve order: of each window of neighbours the well filled containers leave, the
    others' items stay for the next window."""
    held: list[tuple[int, object]] = []

    def settle(last: bool) -> Iterator[list[tuple[int, object]]]:
        nonlocal held
        packed = [[held[i] for i in c] for c in fill([s for s, _ in held], capacity)]
        packed.sort(key=lambda c: -sum(s for s, _ in c))
        rest: list[tuple[int, object]] = []
        for n, c in enumerate(packed):
            if last or sum(s for s, _ in c) >= full * capacity or n * 2 < len(packed):
                yield c
            else:
                rest.extend(c)
        held = rest

    for x in items:
        held.append(x)
        if len(held) >= window:
            yield from settle(False)
    yield from settle(True)


def fill_containers(df: DataFrame, key: str, text: str, capacity: int, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """(container, place, key, piece, first_token, n_tokens): every row of df in containers of at most capacity tokens.

    An item larger than the capacity is divided into pieces of exactly the capacity and a rest (first_token counts from 0); no
    other is. Items of size 0 (NULL and empty texts) take a place but no room. place counts from 0 within the container. Rows
    with equal or NULL keys are items of their own. Other columns are not read. Empty df: no rows.

    partitions: how many ranges of the curve are packed at once; each may leave one container partly filled. By default one
    for about 20,000 items. Copies of one text share a curve key; ranges also go by a hash of the row's key, so a third of all rows alike
    are still parted.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    path = path or vocabulary_path()
    sized = cut(sized_vectors(df, key, text, path), "sized")
    stats = sized.where("size > 0").select(*[F.element_at("v", i + 1).cast("double").alias(f"v{i}") for i in range(DIMS)]).agg(F.count("*").alias("n"), *[f(f"v{i}").alias(f"{k}{i}") for i in range(DIMS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).head()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(DIMS)])
    spread = np.array([stats[f"s{i}"] or 1.0 for i in range(DIMS)])

    @F.pandas_udf("long")
    def curve(v: pd.Series) -> pd.Series:
        z = (np.stack(v.to_numpy()) - mean) / spread
        cells = np.clip((1 << BITS) / (1 + np.exp(-1.7 * z)), 0, (1 << BITS) - 1)
        return pd.Series(hilbert_key(cells.astype(np.uint64)))

    n = partitions or max(1, -(-int(stats["n"]) // 20_000))
    kind = sized.schema["key"].dataType
    placed = sized.select("key", "size", curve("v").alias("h"), F.xxhash64("key").alias("k")).repartitionByRange(n, "h", "k").sortWithinPartitions("h", "k", "size")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()

        def items() -> Iterator[tuple[int, object]]:
            for b in batches:
                for k, s in zip(b["key"].tolist(), b["size"].tolist(), strict=True):
                    for piece, at in enumerate(range(0, max(s, 1), capacity)):
                        yield min(capacity, s - at), (k, piece + 1, at)

        rows: list[tuple] = []
        for n_, c in enumerate(packed_stream(items(), capacity)):
            rows.extend(((task << 40) + n_, place, k, piece, at, s) for place, (s, (k, piece, at)) in enumerate(c))
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=["container", "place", "key", "piece", "first_token", "n_tokens"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["container", "place", "key", "piece", "first_token", "n_tokens"])

    schema = T.StructType([T.StructField("container", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("key", kind), T.StructField("piece", T.IntegerType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return placed.mapInPandas(pack, schema).withColumnRenamed("key", key)
