"""Cutting oversized texts at natural boundaries, along the tree of their structure."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import SAFE, PartCounter, encoder, small_batches, vocabulary_path

# What parts or begins the nodes of the tree.
_PAGE = regex.compile(r"\f|\n----\n\n//\n\n----\n?")
_TITLED = regex.compile(r"(?m)^(?:(?P<marks>#{1,6})[^\S\n]+\S|[^\S\n]*<h(?P<tag>[1-6])\b)")
_TITLE = regex.compile(r"(?:(?<=\n[^\S\n]*\n)|\A)(?P<number>\d{1,2}(?:\.\d{1,2})*\.?[^\S\n]+)?[^\n]{1,80}(?<![.!?。！？।؟,;:，；、：\s])[^\S\n]*(?=\n[^\S\n]*\n|\n?\Z)")
_ITEM = regex.compile(r"(?m)^(?P<indent>[^\S\n]*)(?:(?:[-–—•▪◦‣⁃●○■□∙·*+]|\(?(?:\d{1,3}|[A-Za-z]|[ivx]{1,5})[.)])[^\S\n]+|<(?:li|tr|dt|dd|p)\b)")
_PARAGRAPH = regex.compile(r"\n[^\S\n]*\n\s*")
_LINE = regex.compile(r"\n\s*")
_SENTENCE = regex.compile(r"(?:[.!?]+[\"'”’»)\]]*(?=\s)|[。！？؟।]+[”’」』）\"]*)")
_CLAUSE = regex.compile(r"[,;:](?=\s)|[，；、：،؛]")
_WORD = regex.compile(r"(?<=\S)(?=\s)")
_GRAPHEME = regex.compile(r"\X")
# Below pages, sections and lists; whether a child begins where the pattern matches, or after it.
_PLAIN = ((_PARAGRAPH, False), (_LINE, False), (_SENTENCE, False), (_CLAUSE, False), (_WORD, True))
_DEEPEST = 7


class Tree:
    """The structure of one text: pages; sections by the rank of their headings; paragraphs; lists by the indentation of their items;
    lines, sentences, clauses, words. Children cover their node without gaps and are made when asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        ranks: dict[int, int] = {}
        # A number's parts say how deep a heading stands; other short lines between blank ones stand deepest.
        for m in _TITLE.finditer(text):
            if not _ITEM.match(text, m.start()) or m["number"]:
                ranks[m.start()] = min(_DEEPEST - 1, len(m["number"].strip(" .\t").split("."))) if m["number"] else _DEEPEST
        for m in _TITLED.finditer(text):
            ranks[m.start()] = len(m["marks"]) if m["marks"] else int(m["tag"])
        self.headings = sorted(ranks.items())
        self.items = [(m.start(), len(m["indent"].expandtabs(4))) for m in _ITEM.finditer(text) if m.start() not in ranks]
        self._ranks = ranks

    def heading(self, a: int, b: int) -> bool:
        """Whether text[a:b] is a heading alone."""
        return a in self._ranks and "\n" not in self.text[a:b].strip()

    def begins_section(self, a: int) -> bool:
        return a in self._ranks

    def _outermost(self, marks: list[tuple[int, int]], a: int, b: int) -> list[int]:
        """Places within (a, b) of the marks of the smallest rank there."""
        inside = marks[bisect_right(marks, (a, 1 << 30)) : bisect_left(marks, (b, -1))]
        least = min((r for _, r in inside), default=0)
        return [p for p, r in inside if r == least]

    def children(self, a: int, b: int, level: int) -> tuple[list[tuple[int, int]], int]:
        """(children of the node text[a:b], level at which to look into them); no children: nothing but letters is left."""
        while level < len(_PLAIN) + 3:
            # Sections and lists hold others of their kind, so their children are looked at on the same level.
            stay = level in (1, 3)
            if level == 0:
                places = [m.end() for m in _PAGE.finditer(self.text, a, b)]
            elif level == 1:
                places = self._outermost(self.headings, a, b)
            elif level == 3:
                places = self._outermost(self.items, a, b)
            else:
                pattern, before = _PLAIN[0 if level == 2 else level - 3]
                places = [m.start() if before else m.end() for m in pattern.finditer(self.text, a, b)]
            at = [a, *sorted({p for p in places if a < p < b}), b]
            if len(at) > 2:
                return list(zip(at, at[1:], strict=False)), level if stay else level + 1
            level += 1
        return [], level


def _letters(text: str, a: int, b: int, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole characters with at most `limit` bytes, so at most as many tokens; a larger character stands alone."""
    start, size = a, 0
    for m in _GRAPHEME.finditer(text, a, b):
        n = len(m[0].encode("utf-8", "surrogatepass"))
        if size and size + n > limit:
            yield start, m.start()
            start, size = m.start(), 0
        size += n
    if start < b:
        yield start, b


def bodies(text: str, limit: int, count: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Spans that cover text, each of at most limit tokens by count(start, end) (a single larger character stands alone).

    Only nodes over the limit are entered. Below such a node, whole children that stand side by side are merged as long as they
    fit; what an entered child is cut into is merged with nothing outside of it. A heading goes with the node after it, even where
    that is entered.
    """
    tree = Tree(text)

    def units(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        """The spans of the node text[a:b], which is over the limit."""
        parts, level = tree.children(a, b, level)
        if not parts:
            yield from _letters(text, a, b, limit)
            return
        held: tuple[int, int, int] | None = None
        for p, q in parts:
            n = count(p, q)
            if held and held[2] + n <= limit + 2 and (m := count(held[0], q)) <= limit:
                held = held[0], q, m
                continue
            below = level
            if held and tree.heading(held[0], held[1]) and not tree.begins_section(p):
                # A list after a heading is looked at line by line: its items would part it from the heading again.
                p, n, held, below = held[0], limit + 1, None, level + (level == 3)
            if held:
                yield held[:2]
            held = (p, q, n) if n <= limit else None
            if held is None:
                yield from units(p, q, below)
        if held:
            yield held[:2]

    if not text:
        return []
    return [(0, len(text))] if count(0, len(text)) <= limit else list(units(0, len(text), 0))


_STARTS = regex.compile(r"(?<=\s)(?=\S)|(?<=[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}。！？，、；：])(?=\S)")


class Tally:
    """Token counts of the spans of one text, from counts of its parts between places where the tokenizer always parts words.

    of() never is below the count of a span that begins and ends at such places, and exact there.
    """

    def __init__(self, text: str, counter: PartCounter) -> None:
        parts = SAFE.split(text)
        self.places = list(accumulate(map(len, parts), initial=0))
        self.sums = list(accumulate(counter.counts(parts), initial=0))

    def of(self, a: int, b: int) -> int:
        i = bisect_right(self.places, a) - 1
        j = bisect_left(self.places, b)
        return self.sums[j] - self.sums[i] + (self.places[i] != a) + (self.places[j] != b)


def overlapped(text: str, spans: list[tuple[int, int]], limit: int, overlap: int, count: Callable[[str], int], tally: Callable[[int, int], int] | None = None) -> list[tuple[int, int, int, int]]:
    """(start, body start, end, tokens): each body with the end of the body before it, of at most overlap tokens.

    tally: quick counts of spans that the search goes by; what it finds is counted exactly.
    """
    tally = tally or (lambda a, b: count(text[a:b]))
    out = []
    for k, (a, b) in enumerate(spans):
        start, n = a, None
        if k and overlap:
            low, first, reach = a, spans[k - 1][0], 8 * overlap
            while low > first:  # as far back as the overlap fits
                low = max(first, a - reach)
                reach *= 4
                if tally(low, a) > overlap:
                    break
            places = [m.start() for m in _STARTS.finditer(text, low, a) if low <= m.start() < a] or [p for p in range(max(low, a - overlap), a) if p > low]
            if low == first and low not in places:
                places.insert(0, low)
            i, j = 0, len(places)
            while i < j:  # the earliest place from which the overlap and the whole piece fit
                m = (i + j) // 2
                if tally(places[m], a) <= overlap and tally(places[m], b) <= limit:
                    j = m
                else:
                    i = m + 1
            while i < len(places):
                n = count(text[places[i] : b])
                if n <= limit and count(text[places[i] : a]) <= overlap:
                    start = places[i]
                    break
                i, n = i + 1, None
        out.append((start, a, b, count(text[a:b]) if n is None else n))
    return out


def pieces(text: str, limit: int, overlap: int, count: Callable[[str], int], counter: PartCounter) -> list[tuple[int, int, int, int]]:
    """(start, body start, end, tokens) of the pieces of a text."""
    tally = Tally(text, counter)
    if tally.sums[-1] <= limit:
        return [(0, 0, len(text), tally.sums[-1])]
    out = overlapped(text, bodies(text, limit - overlap, tally.of), limit, overlap, count, tally.of)
    if max(p[3] for p in out) > limit:  # quick counts of spans between odd places can be too low: exact ones then
        exact = lambda a, b: count(text[a:b])
        out = overlapped(text, bodies(text, limit - overlap, exact), limit, overlap, count)
    return out


def cut_texts(df: DataFrame, key: str, text: str, limit: int, overlap: int, path: str | None = None) -> DataFrame:
    """(key, piece_no, start_char, body_char, end_char, n_tokens): the pieces of every text of df.

    A text of at most limit tokens is one piece. Longer ones are cut along the tree of their structure, at the outermost boundaries
    that allow it: pages, sections by the rank of their headings, paragraphs, lists by indentation, lines, sentences, clauses, words,
    at last characters. Bodies
    [body_char, end_char) cover the text without gap or overlap; a piece begins at start_char, up to overlap tokens before its
    body (the nearest word boundary that doesn't exceed it). A piece has at most limit tokens, unless a single character has more.
    Places count code points from 0; piece_no counts from 1. NULL and empty texts give no piece. Rows with equal or NULL
    keys are cut each on its own. Other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    path = path or vocabulary_path()
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        counter = PartCounter(e)
        count = lambda s: len(e.encode(s))
        for b in small_batches(batches, "text"):
            take, rows = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                cut = pieces(t, limit, overlap, count, counter)
                take.extend([i] * len(cut))
                rows.extend((k, *p) for k, p in enumerate(cut, 1))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(take, pa.int64())), *[pa.array(c, pa.int32()) for c in cols]], names=["key", "piece_no", "start_char", "body_char", "end_char", "n_tokens"])

    return src.mapInArrow(run, T.StructType([T.StructField("key", src.schema["key"].dataType), *[T.StructField(c, T.IntegerType()) for c in ("piece_no", "start_char", "body_char", "end_char", "n_tokens")]])).withColumnRenamed("key", key)
