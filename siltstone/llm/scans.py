"""Repair of text from scanned pages: page furniture, words divided over lines, misread words.

1. All words of the collection are counted, in clean texts and in scans apart.
2. A character editor (averaged perceptron) is trained on rare words of scans beside frequent words of clean texts that are up to two characters
   apart: keep, replace, delete, insert. Its training rows are a bounded sample (RARE, FREQUENT), everything else covers all data.
3. Page furniture is told from the body by its place on the page, its form and its repetition in the document.
4. A word that ends a line of the body with a mark of division goes on in the next line of the body. Line-join is decided between the
   joined word, the word with its hyphen and edits of both, by how often they stand in the collection.
5. Other words that are rare get the editor's candidates; the one that the collection supports becomes the spelling.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .editor import Editor, apply, mined_pairs
from .tokens import small_batches

# Bounds of the editor's training sample.
FREQUENT, RARE = 20_000, 20_000
USUAL = 1e-4
TOKEN_LINES = ("----", "//")
DIVIDERS = "-­¬‐‑"
_ENDS = ".,;:!?()[]{}\"'“”„‟‘’‚«»‹›…·•"
# Scripts that are written without blanks have no words that blanks part.
_BLANKLESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = re.compile(
    r"\d{1,3}|[ivxl1|]{1,7}|[-–—] ?\w{1,4} ?[-–—]|[\[(]\w{1,4}[\])]|\W{0,2}P\w{1,3}g\w ?\w{1,4}(?: \wf \w{1,4})?|\w{1,3} ?/ ?\w{1,3}|P\w{1,3}g\w \w{1,4} ?/ ?\w{1,4}",
    re.I,
)
_YEAR_LAST = re.compile(r"(?<![\d.])(?:19|20)\d\d(?:\s+\d{1,3})?$")
_PAGED = re.compile(r"^\d{1,3}(?:\s{2,}|\s*\|\s*)\S|\S(?:\s{2,}|\s*\|\s*)\d{1,3}$")
_FOOTER = re.compile(r"\d{1,3} \| \S.*(?:19|20)\d\d$")
_ADDRESS = re.compile(r"[/@]|www\.")
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "9": "g", "c": "e", "†": "t", "ä": "a", "b": "h", "f": "t"})


def core(token: str) -> str:
    """The word of a token: without punctuation and quotes at the ends."""
    return token.strip(_ENDS)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n_clean, n_scan) over texts (text, scan boolean): words in lower case, of scripts with blanks, with at least a letter.

    Each task counts before it sends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words: dict[str, list[int]] = {}
            for k in (0, 1):
                for t, n in counts[k].items():
                    w = core(t).lower()
                    if w and _LETTER.search(w) and not _BLANKLESS.search(w):
                        words.setdefault(w, [0, 0])[k] += n
                counts[k].clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), *[pa.array([v[k] for v in words.values()], pa.int64()) for k in (0, 1)]], names=["word", "n_clean", "n_scan"])

        for b in small_batches(batches, "text"):
            for t, s in zip(b.column("text").to_pylist(), b.column("scan").to_pylist(), strict=True):
                if t:
                    counts[bool(s)].update(t.split())
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush()
        yield flush()

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_clean", T.LongType()), T.StructField("n_scan", T.LongType())])
    return texts.select("text", "scan").mapInArrow(run, schema).groupBy("word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_scan").alias("n_scan"))


def trained_editor(words: DataFrame) -> tuple[Editor, list[str]]:
    """The editor and the frequent words of words (as from word_counts). Words that make up at least USUAL of the clean text count
    as plain spellings for its training: names are rarer."""
    top = [(r["word"], r["n_clean"]) for r in words.where("n_clean >= 5").orderBy(F.desc("n_clean"), "word").limit(FREQUENT).collect()]
    total = words.agg(F.sum("n_clean")).head()[0] or 0
    odd = "[-\u00ad\u00ac\u2010]$|[./@:%]"
    rare = {r["word"]: r["n_scan"] for r in words.where(f"n_scan > 0 AND n_clean = 0 AND length(word) BETWEEN 4 AND 24 AND NOT word RLIKE '{odd}'").orderBy(F.xxhash64("word")).limit(RARE).collect()}
    usual = [w for w, n in top if len(w) >= 4 and n >= USUAL * total]
    return Editor().train(mined_pairs(list(rare), usual), usual, rare), [w for w, n in top if n >= USUAL * total]


# --- pages -------------------------------------------------------------------------------------------------------------


def _plain(line: str) -> str:
    return re.sub(r"(?<!\w)\d+(?!\w)|\s+", " ", line.strip().lower()).replace("  ", " ").strip().translate(_FOLD)


def furniture(lines: list[str]) -> tuple[set[int], set[int]]:
    """(places of furniture lines, places of lines of the page token) among the lines of a text."""
    token = set()
    for i, x in enumerate(lines):
        if x.strip() == "//" and i >= 2 and i + 2 < len(lines) and lines[i - 2].strip() == "----" and lines[i + 2].strip() == "----":
            token.update((i - 2, i - 1, i, i + 1, i + 2))
    filled = [i for i, x in enumerate(lines) if x.strip() and i not in token]
    if not filled:
        return set(), token
    top, bottom = {filled[0]}, {filled[-1]}
    for a, b in zip(filled, filled[1:], strict=False):
        if any(i in token for i in range(a + 1, b)):
            bottom.add(a)
            top.add(b)
    has_pages = bool(token)
    places = {i: k for k, i in enumerate(filled)}
    at_edge = Counter(_plain(lines[i]) for i in top | bottom)
    all_ = Counter(_plain(lines[i]) for i in filled)

    def number(i: int) -> bool:
        return _NUMBER.fullmatch(lines[i].strip()) is not None

    def header(i: int, edge: bool) -> bool:
        """A score over the line's form, its repetition and its place."""
        x = lines[i].strip()
        words = x.split()
        if not x or len(x) > 90 or len(words) > 10 or "/" in x:
            return False
        first = x.lstrip("0123456789 |[]-")[:1]
        p = _plain(x)
        s = 2.0 * edge
        s += 2.0 * bool(_PAGED.search(x)) + 1.5 * bool(_YEAR_LAST.search(x))
        s += 1.0 * (" | " in x) + 1.0 * first.isupper() - 3.0 * first.islower() - 3.0 * (x[-1] in ".!?,;:" and not x.endswith(("Ltd.", "Inc.", "Co.", "Corp.")))
        # Repeated at the edges of pages, and hardly elsewhere.
        s += 2.0 * (at_edge[p] - edge >= 1 and at_edge[p] * 2 >= all_[p] and len(p) > 3)
        return s >= 4.0

    out: set[int] = set()
    for i in bottom:
        if (number(i) and (has_pages or len(filled) > 1)) or header(i, True):
            out.add(i)
    for i in top:
        if header(i, True) or (number(i) and len(filled) > 1 and not lines[i].strip().isalpha()):
            out.add(i)
    # Breaks without a token: a page number, or a line that pages of this document begin or end with, between lines of the body.
    for i in filled:
        if i in out:
            continue
        x = lines[i].strip()
        if number(i):
            blank_after = i + 1 < len(lines) and not lines[i + 1].strip()
            if not (x.isdigit() and len(x) > 3) and (blank_after or i in top or i in bottom):
                out.add(i)
        elif (_PAGED.search(x) or _YEAR_LAST.search(x)) and header(i, False):
            out.add(i)
        elif _FOOTER.match(x) and header(i, True):
            out.add(i)
    # Next to furniture: a second line of furniture.
    for i in sorted(out):
        k = places[i]
        for j in (k + 1, k - 1):
            if 0 <= j < len(filled) and filled[j] not in out:
                y = filled[j]
                if (number(i) and j == k + 1 and header(y, True) and (i in bottom or y - i > 1)) or (y in bottom | top and number(y) and not lines[y].strip().isalpha()):
                    out.add(y)
                elif (i in top and j == k + 1 or i in bottom and j == k - 1) and (number(y) and (i in bottom or y + 1 < len(lines) and not lines[y + 1].strip()) or header(y, True) and at_edge[_plain(lines[y])] >= 1):
                    out.add(y)
    return out, token


def scanned_lines(text: str) -> tuple[list[str], set[int], list[tuple[int, int, str, str, str]], dict[int, tuple[bool, bool]]]:
    """(lines, furniture, divided words as (line, next line, left, mark, right), body lines with whether their first and last token
    belong to a divided word)."""
    lines = text.split("\n")
    out, token = furniture(lines)
    body = [i for i, x in enumerate(lines) if x.strip() and i not in out and i not in token]
    divided, flags = [], {i: (False, False) for i in body}
    for a, b in zip(body, body[1:], strict=False):
        x = lines[a].rstrip()
        if x[-1:] not in DIVIDERS or len(x) < 2 or not x[-2].isalpha():
            continue
        right = lines[b].split(None, 1)[0]
        if not right[:1].isalnum() or right.lower() in ("and", "or", "und", "oder", "et", "ou", "y", "o"):
            continue
        # Blank lines between the halves are there only for a page break.
        if b > a + 1 and not any(i in out or i in token for i in range(a + 1, b)):
            continue
        left = x.split()[-1][:-1].lstrip(_ENDS)
        divided.append((a, b, left, x[-1], right.rstrip(_ENDS)))
        flags[a] = (flags[a][0], True)
        flags[b] = (True, flags[b][1])
    return lines, out, divided, flags


class ScanRepair:
    """Cases of noise in scans (origin, id, text); words of all texts are counted over vocabulary (text, scan)."""

    def __init__(self, scans: DataFrame, vocabulary: DataFrame) -> None:
        self.scans = scans.select("origin", "id", "text").where("text <> ''")
        self.words = cut(word_counts(vocabulary), "words")
        self.editor, top = trained_editor(self.words)
        self.frequent = frozenset(top)
        self.cases = cut(self._cases(), "cases")

    def _cases(self) -> DataFrame:
        """(origin, id, line_no, kind, a, mark, b): furniture lines; halves a and b of divided words; unusual words a."""
        frequent = self.frequent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, "text", 4 << 20):
                rows = []
                for k, t in enumerate(b.column("text").to_pylist()):
                    lines, out, divided, flags = scanned_lines(t)
                    rows.extend((k, i + 1, "furniture", "", "", "") for i in out)
                    rows.extend((k, i + 1, "hyphen", left, mark, right) for i, _, left, mark, right in divided)
                    for i, (first, last) in flags.items():
                        tokens = lines[i].split()
                        for w in dict.fromkeys(tokens[first : len(tokens) - last]):
                            w = core(w)
                            if w and w.lower() not in frequent and len(w) > 1 and not _ADDRESS.search(w) and _LETTER.search(w) and not _BLANKLESS.search(w):
                                rows.append((k, i + 1, "misread", w, "", ""))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                take = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("origin").take(take), b.column("id").take(take), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.string()) for c in cols[2:]]], names=["origin", "id", "line_no", "kind", "a", "mark", "b"])

        s = self.scans.schema
        text = [T.StructField(c, T.StringType()) for c in ("kind", "a", "mark", "b")]
        return self.scans.mapInArrow(run, T.StructType([s["origin"], s["id"], T.StructField("line_no", T.IntegerType()), *text]))

    @staticmethod
    def _spread(df: DataFrame, *by: str) -> DataFrame:
        """Narrow rows that cost much each, by number over all shuffle partitions: their few bytes would be put into one task."""
        return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *by)

    def _supported(self, tried: DataFrame) -> DataFrame:
        """tried (key, word, way, score, ...) with n_clean and n_scan of word."""
        return tried.join(self.words, "word", "left").na.fill(0, ["n_clean", "n_scan"])

    def spellings(self) -> DataFrame:
        """(a, fixed): unusual words that have another plain spelling."""
        editor = self.editor

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for w in b["a"]:
                    low = w.lower()
                    rows.append((w, low, -1, 0.0, w))
                    if len(low) == len(w):
                        rows.extend((w, x, k, s, apply(w, edits)) for k, (x, s, edits) in enumerate(editor.candidates(low)))
                yield pd.DataFrame(rows, columns=["a", "word", "way", "score", "fixed"])

        unusual = self._spread(self.cases.where("kind = 'misread'").select("a").distinct(), "a")
        tried = self._supported(unusual.mapInPandas(run, "a string, word string, way int, score double, fixed string"))
        best = tried.groupBy("a").agg(
            F.max(F.when(F.col("way") < 0, F.struct("n_clean", "n_scan"))).alias("own"),
            F.max(F.when((F.col("way") >= 0) & (F.col("n_clean") + F.col("n_scan") > 0), F.struct((F.log2(1 + F.col("n_clean") + 0.1 * F.col("n_scan")) + F.col("score")).alias("s"), "n_clean", "n_scan", "fixed"))).alias("new"),
            F.max(F.when(F.col("way") == 0, F.struct("score", "fixed"))).alias("guess"),
        )
        own = F.col("own.n_clean") * 4 + F.col("own.n_scan")
        # A figure or sign within letters isn't in any plain spelling.
        odd = F.col("a").rlike(r"^(?=.*[\p{L}].*[\p{L}])(?=.*[0-9|†]).*$") & ~F.col("a").rlike(r"^[0-9]|[./@:%-]") | F.col("a").rlike(r"^[0-9|†][a-z]{3,}|[ﬀ-ﬆ†]|[a-z]{2}\|$")
        supported = F.col("new").isNotNull() & ((F.col("new.n_clean") * 4 + F.col("new.n_scan") >= F.when(odd, 1).otherwise(8) * own) & (odd | (F.col("own.n_clean") <= F.col("new.n_clean") / 50)))
        fixed = F.when(supported, F.col("new.fixed")).when(odd & F.col("guess").isNotNull() & (F.col("own.n_clean") == 0), F.col("guess.fixed"))
        return best.select("a", fixed.alias("fixed")).where("fixed IS NOT NULL AND fixed <> a")

    def joins(self) -> DataFrame:
        """(a, mark, b, fixed): divided words as a whole."""
        editor = self.editor

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                rows = []
                for a, m, b in zip(p["a"], p["mark"], p["b"], strict=True):
                    for hyphen in (0, 1):
                        w = a + "-" * hyphen + b
                        low = w.lower()
                        rows.append((a, m, b, low, -1, -3.0 * hyphen * (m != "-"), w))
                        if len(low) == len(w):
                            rows.extend((a, m, b, x, k, s - 6.0 - 3.0 * hyphen * (m != "-"), apply(w, e)) for k, (x, s, e) in enumerate(editor.candidates(low, 12)))
                yield pd.DataFrame(rows, columns=["a", "mark", "b", "word", "way", "score", "fixed"])

        pairs = self._spread(self.cases.where("kind = 'hyphen'").select("a", "mark", "b").distinct(), "a", "b")
        tried = self._supported(pairs.mapInPandas(run, "a string, mark string, b string, word string, way int, score double, fixed string"))
        parts = tried.groupBy("a", "mark", "b").agg(F.max(F.when(F.col("n_clean") + F.col("n_scan") > 0, F.struct((F.log2(1 + F.col("n_clean") * 4 + F.col("n_scan")) + F.col("score")).alias("s"), "fixed"))).alias("best"))
        # Unknown either way: the hyphen is the word's own if both halves are words.
        known = self.words.where("n_clean >= 20").select("word")
        halves = parts.join(known.select(F.col("word").alias("l"), F.lit(True).alias("lk")), F.lower("a") == F.col("l"), "left").join(known.select(F.col("word").alias("r"), F.lit(True).alias("rk")), F.lower("b") == F.col("r"), "left")
        default = F.when((F.col("mark") == "-") & F.col("lk") & F.col("rk"), F.concat_ws("-", "a", "b")).otherwise(F.concat("a", "b"))
        return halves.select("a", "mark", "b", F.coalesce("best.fixed", default).alias("fixed"))

    def found(self) -> DataFrame:
        """(origin, id, line_no, kind, fixed), equal rows once."""
        c = self.cases
        lines = c.where("kind = 'furniture'").select("origin", "id", "line_no", "kind", F.lit("").alias("fixed"))
        hyphens = c.where("kind = 'hyphen'").join(self.joins(), ["a", "mark", "b"]).select("origin", "id", "line_no", "kind", "fixed")
        misread = c.where("kind = 'misread'").join(self.spellings(), "a").select("origin", "id", "line_no", "kind", "fixed")
        return lines.unionByName(hyphens).unionByName(misread).distinct()

    def paragraphs(self) -> DataFrame:
        """(origin, id, paragraph_no, text): the texts without furniture, with divided words joined and misread words corrected,
        one row per paragraph; lines within one are joined by blanks. Equal scans give equal rows, once."""
        c = self.cases
        hyphens = c.where("kind = 'hyphen'").join(self.joins(), ["a", "mark", "b"]).select("origin", "id", "line_no", "kind", "a", "fixed")
        misread = c.where("kind = 'misread'").join(self.spellings(), "a").select("origin", "id", "line_no", "kind", "a", "fixed")
        fixes = hyphens.unionByName(misread).distinct().groupBy("origin", "id").agg(F.collect_list(F.struct("line_no", "kind", "a", "fixed")).alias("fixes"))
        docs = self.scans.distinct().join(fixes, ["origin", "id"], "left")
        s = self.scans.schema

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                rows = []
                for o, i, t, fx in zip(p["origin"], p["id"], p["text"], p["fixes"], strict=True):
                    rows.extend((o, i, k, x) for k, x in enumerate(repaired(t, fx if fx is not None else []), 1))
                yield pd.DataFrame(rows, columns=["origin", "id", "paragraph_no", "text"])

        return docs.mapInPandas(run, T.StructType([s["origin"], s["id"], T.StructField("paragraph_no", T.IntegerType()), T.StructField("text", T.StringType())]))


def repaired(text: str, fixes: list[dict]) -> list[str]:
    """Paragraphs of a scanned text, given its fixes (line_no, kind, a, fixed)."""
    lines, out, divided, flags = scanned_lines(text)
    joined = {f["line_no"] - 1: f["fixed"] for f in fixes if f["kind"] == "hyphen"}
    spell: dict[int, dict[str, str]] = {}
    for f in fixes:
        if f["kind"] == "misread":
            spell.setdefault(f["line_no"] - 1, {})[f["a"]] = f["fixed"]
    follows = {b: (a, left, right) for a, b, left, _, right in divided}
    heads = {a: left for a, _, left, _, _ in divided}
    paragraphs: list[list[str]] = [[]]
    last = None
    for i in flags:
        # A blank line ends a paragraph, but not where furniture stands beside it and the sentence goes on.
        if last is not None and any(not lines[j].strip() for j in range(last + 1, i)) and i not in follows:
            moved = any(lines[j].strip() for j in range(last + 1, i))
            if not (moved and paragraphs[-1] and paragraphs[-1][-1][-1:] not in ".!?:”\"" and lines[i].lstrip()[:1].islower()):
                paragraphs.append([])
        tokens = lines[i].split()
        words = [t.replace(core(t), spell[i][core(t)]) if i in spell and core(t) in spell[i] else t for t in tokens]
        if i in follows and follows[i][0] in joined:
            words = words[1:]
        if i in heads and i in joined:
            end = next(right for a, _, right in follows.values() if a == i)
            nxt = next(b for b, v in follows.items() if v[0] == i)
            tail = lines[nxt].split(None, 1)[0]
            words[-1] = tokens[-1][: len(tokens[-1]) - 1 - len(heads[i])] + joined[i] + tail[len(end) :]
        paragraphs[-1].extend(words)
        last = i
    return [" ".join(p) for p in paragraphs if p]
