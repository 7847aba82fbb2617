"""Sentence units of texts in many languages, by semi-Markov dynamic programming over whole spans."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import small_batches

# The page token; list marks; abbreviations after which a sentence goes on (in lower case, without the last dot), and
# those with which it may end; words that follow "Co." in a name; frequent first words of sentences; nouns after ordinals.
PAGE = re.compile(r"\s*----\n\n//\n\n----\s*")
MARK = r"(?:[-–—•▪◦‣⁃●○■□∙·*]|\(?\d{1,3}\)|\(?[A-Za-z]\)|\(?[ivx]{1,5}\))"
NEVER = frozenset(
    "mr mrs ms dr prof hon rep st sr sra srta dra mme mlle mm no nos num nr núm nro art arts al abs sec fig figs p pp pg pág págs para paras vol ch chap ed eds cf vs viz esp approx ca env "
    "bzw vgl evtl ggf inkl zzgl usf z d u i.e e.g z.b d.h u.a p.ex p.ej ex ej etc.a jan feb mar apr jun jul aug sep sept oct nov dec pty ee av bd c.f resp tel fr hr exc डॉ श्री सं د أ م ร ดร นพ".split()
)
ENDING = frozenset("inc ltd co corp llc plc u.s u.k u.n e.u u.s.a uu ee.uu s.a s.a.s c.v s.l s.p.a n.v b.v a.m p.m etc ph.d m.d b.a m.a jr esq bhd dept est usw u.s.w kg ag a.g gmbh g.m.b.h approx.s bros d.c".split())
NAME_GOES_ON = frozenset("kg kgaa ltd limited inc llc corp plc ohg".split())
OPENERS = frozenset(
    "the a an our in on at by for with we it this that these those no each every who what when where how why as if under while during according following despite without across has is are "
    "die der das ein eine unser unsere im am bei nach auf ohne unter laut zum zur wer wir es "
    "le la les l’agence l’entreprise un une notre au aux en sur selon après avec sans lors pour pourquoi par nous il "
    "el los las una nuestro nuestra al según tras sin con para durante quién por unos".split()
)
ORDINAL_NOUNS = frozenset("januar februar märz april mai juni juli august september oktober november dezember quartal halbjahr absatz jahrhundert tag woche monat".split())
_OPEN, _CLOSE = "“„«「『‹", "”»」』›"

_BLOCK_END = re.compile(rf"\s*\n[^\S\n]*\n\s*|\s*\n[^\S\n]*(?={MARK}[^\S\n]+\S)|\f")
_MARKED = re.compile(rf"\s*{MARK}[^\S\n]+(?=\S)")
_STOP = re.compile(r"(?P<dot>[.!?‼⁇-⁉]+|[。！？｡؟۔।॥။።]+)(?:\s?»(?=[\s,;.:]|\Z)|[\"'”’»」』›）)\]]|“(?=[\s,;]|\Z))*")
_THAI = re.compile(r"(?<=[฀-๿%”\"\d)])\s+(?=[฀-๿“\"(])")
_HAS_THAI = re.compile(r"[฀-๿]{3}")
_TOKEN = re.compile(r"[^\s(\[“„«「『\"]*\Z")
_NEXT = re.compile(r"[\s\"'“„«「『‹(\[¿¡]*([^\W_][^\s,.;:!?]*)?")
_UNCASED = re.compile(r"\s+[\u0590-\u0dff\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff]")
_QUOTE = re.compile(r"[\"“”„«»「」『』‹›]")

#: Code points from which a unit is too long, and those that cost a point more.
LONG, SLOPE = 700, 300


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans that no unit crosses: parts of pages between blank lines, list items without their marks."""
    at = 0
    for page in (*PAGE.finditer(text), None):
        end = page.start() if page else len(text)
        for m in (*_BLOCK_END.finditer(text, at, end), None):
            to = m.start() if m else end
            if to > at:
                k = _MARKED.match(text, at, to)
                yield (k.end() if k else at), to
            at = m.end() if m else end
        at = page.end() if page else end


def _end_score(text: str, a: int, stop: re.Match, b: int) -> float | None:
    """Log odds of an end at a stop within the block text[a:b], from its closing word and the next opening word; None: no end."""
    dots, to = stop["dot"], stop.end()
    nxt = text[to] if to < b else " "
    wide = dots[0] not in ".!?"
    if len(dots) > 1 and dots == "." * len(dots):
        return None
    tight = not nxt.isspace()
    if wide:
        # A closing bracket or quotation right after, or a comma: the sentence goes on.
        return None if nxt in ",;:，；：、…" else 6.0
    before = text[stop.start() - 1] if stop.start() > a else " "
    word = (_NEXT.match(text, to, b)[1] or "") if to < b else ""
    # A first letter before a capital is a slip of the pen ("eThe"): the capital counts.
    upper = word[:1].isupper() or word[1:2].isupper()
    lower = word[:1].islower() and not upper
    if tight:
        # A blank was lost: "... report.The board ..."
        if nxt in "\"“„«" and dots != ".":
            return 3.0
        if not ((before.islower() and nxt.isupper()) or (before.isalpha() and nxt.isalpha() and not before.isascii() and not nxt.isascii() and not lower)):
            return None
    if dots[0] != ".":
        return -6.0 if lower else 5.0
    token = _TOKEN.search(text, max(a, stop.start() - 24), stop.start())[0]
    t = token.lower().strip("'’,;:")
    plain = 5.0 if upper else -6.0 if lower else 4.0
    if to > stop.start() + len(dots) and plain > 0:
        return plain  # closed by a quotation mark or a bracket
    if t in ENDING:
        if tight or not upper:
            return -7.0
        return -8.0 if word.lower().rstrip(".") in NAME_GOES_ON else 2.5
    if t in NEVER:
        return -8.0
    if len(t) == 1 and t.isalpha():
        return -5.0
    if t.isdigit() and len(t) < 3:
        w = word.lower()
        return -8.0 if w in ORDINAL_NOUNS else 3.0 if w in OPENERS else -1.0
    if tight and (len(t) < 2 or len(t) < 3 and len(word) < 2 or "." in t or "/" in t):
        return None
    if "." in t and len(t) < 8 and not t.replace(".", "").isdigit():
        return 2.0 if upper and word.lower() in OPENERS else -4.0
    return plain


def _quotes(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(place, +1 opening / -1 closing / 0 either) of quotation marks; “ closes after „."""
    out, german = [], False
    for m in _QUOTE.finditer(text, a, b):
        ch = m[0]
        if ch == "„":
            german = True
        kind = 0 if ch == '"' else 1 if ch in _OPEN else -1
        if ch == "“" and german:
            kind, german = -1, False
        out.append((m.start(), kind))
    return out


def _quoted(text: str, a: int, b: int, marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(place of the opening mark, of the closing one) of the outermost quotations that close within text[a:b]."""
    opened, out, plain = [], [], None
    for p, kind in marks:
        if kind > 0:
            opened.append(p)
        elif kind < 0:
            if opened:
                out.append((opened.pop(), p))
        elif plain is None:
            # A plain mark opens only before a word, and closes only after something.
            if (p == a or text[p - 1].isspace() or text[p - 1] in "([") and p + 1 < b and not text[p + 1].isspace():
                plain = p
        elif not text[p - 1].isspace():
            out.append((plain, p))
            plain = None
    outer: list[tuple[int, int]] = []
    for s, e in sorted(out):
        if not outer or s > outer[-1][1]:
            outer.append((s, e))
    return outer


def units(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The best division of the block text[a:b] into units: the sum over spans of the score of their end, opening, length and
    balance of quotation marks is largest."""
    thai = _HAS_THAI.search(text, a, b) is not None
    ends: list[tuple[int, float]] = []
    for m in _STOP.finditer(text, a, b):
        s = _end_score(text, a, m, b)
        if s is not None and m.end() < b and text[m.end() : b].strip():
            ends.append((m.end(), s))
    if thai:
        known = {e for e, _ in ends}
        ends.extend((m.start(), 4.0) for m in _THAI.finditer(text, a, b) if m.start() not in known)
        ends.sort()
    marks = _quotes(text, a, b)
    quoted = _quoted(text, a, b, marks)
    if quoted:
        opens = [s for s, _ in quoted]
        ends = [(e, s) for e, s in ends if not (k := bisect_left(opens, e)) or e > quoted[k - 1][1]]
    if not ends:
        return [(a, b)]
    ends.append((b, 0.0))
    starts = [a, *[e for e, _ in ends[:-1]]]
    # Signed and unsigned counts of quotation marks before each place.
    at, k, net, odd = [], 0, 0, 0
    for p in [a, *[e for e, _ in ends]]:
        while k < len(marks) and marks[k][0] < p:
            net += marks[k][1]
            odd += marks[k][1] == 0
            k += 1
        at.append((net, odd))
    first = {p for p, kind in marks if kind >= 0}
    # Code points in closed quotations before each place: they do not make a unit too long.
    inside, k, total = [], 0, 0
    for p in [a, *[e for e, _ in ends]]:
        while k < len(quoted) and quoted[k][1] < p:
            total += quoted[k][1] - quoted[k][0]
            k += 1
        inside.append(total)
    # Every earlier start is looked at, whatever lies between: starts of one state (counts of quotation marks before them, whether they open
    # a quotation) differ only in what was best up to them and, beyond LONG, in their place. So a state keeps the best of those
    # near enough, in a queue of falling values, and the best of those further away.
    place = [p - q for p, q in zip([a, *[e for e, _ in ends]], inside, strict=True)]
    opens_quote = []
    for p in starts:
        while p < b and text[p].isspace():
            p += 1
        opens_quote.append(p in first)
    best, back = [0.0] + [-1e18] * len(ends), [0] * (len(ends) + 1)
    near: dict[tuple[int, int, bool], deque[int]] = {}
    far: dict[tuple[int, int, bool], tuple[float, int]] = {}
    ready = 0
    for j in range(1, len(ends) + 1):
        end, score = ends[j - 1]
        while ready < j and end - starts[ready] >= 4:
            q = near.setdefault((at[ready][0], at[ready][1] & 1, opens_quote[ready]), deque())
            while q and best[q[-1]] < best[ready]:
                q.pop()
            q.append(ready)
            ready += 1
        # Who said it follows: a unit that is a quotation, though text goes on without a blank or in a script without capitals.
        said = bool(marks) and j < len(ends) and text[end - 1] in "”」』»\"" and (not text[end].isspace() or _UNCASED.match(text, end, b) is not None)
        found: list[tuple[float, int]] = []

        def cost(net: int, odd: int, quote: bool, j: int = j, said: bool = said) -> float:
            return 6.0 * abs(at[j][0] - net) + 6.0 * ((at[j][1] - odd) & 1) + 12.0 * (said and quote)

        for state, q in near.items():
            while q and place[q[0]] < place[j] - LONG:
                i = q.popleft()
                old = far.get(state, (-1e18, 0))
                far[state] = max(old, (best[i] + place[i] / SLOPE, -i))
            if q:
                found.append((best[q[0]] - cost(*state), -q[0]))
            if state in far:
                v, i = far[state]
                found.append((v - (place[j] - LONG) / SLOPE - cost(*state), i))
        found.extend((best[i] - 2.0 - cost(at[i][0], at[i][1], opens_quote[i]), -i) for i in range(ready, j))
        v, i = max(found)
        best[j], back[j] = score + v, -i
    out, j = [], len(ends)
    while j:
        out.append((starts[back[j]], ends[j - 1][0]))
        j = back[j]
    return out[::-1]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each unit of text, in code points, without white space at the ends."""
    out = []
    for a, b in blocks(text or ""):
        for s, e in units(text, a, b):
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
    return out


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_no, start_char, end_char): the sentences, headings and list items of every text of df.

    Places count code points from 0, the end is exclusive; sent_no counts from 1 in each row. NULL, empty and blank texts have no
    unit. Rows with equal or NULL keys are divided each on its own. Other columns are not read.
    """
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            take, no, starts, ends = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for k, (s, e) in enumerate(sentence_spans(t), 1):
                    take.append(i)
                    no.append(k)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(take, pa.int64())), *[pa.array(c, pa.int32()) for c in (no, starts, ends)]], names=["key", "sent_no", "start_char", "end_char"])

    return src.mapInArrow(run, T.StructType([T.StructField("key", src.schema["key"].dataType), *[T.StructField(c, T.IntegerType()) for c in ("sent_no", "start_char", "end_char")]])).withColumnRenamed("key", key)
