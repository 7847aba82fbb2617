"""Fields that hold several values: one row per value, with its position.

The grammar is a parsing expression grammar: alternatives are ordered, the first that matches wins, and a failed one is
undone (backtracking).

    field   <- blank* (list / flat) blank* end
    list    <- '[' (piece (',' piece)*)? ']'            pieces as in flat, separated by commas only
    flat    <- (piece? separator)* piece?
    piece   <- mark? (quoted / bracketed / known / bare)
    quoted  <- '"' ('""' / '\\' any / !'"' any)* '"' &edge  /  opening ... closing of any other quotation pair &edge
    bracketed <- '(' ... ')' &edge
    known   <- a known value, longest first &edge
    bare    <- (tail / !separator any)+
    tail    <- ',' blank* legal-form &edge
    separator <- newline / tab / ';' / '|' / ',' / blank '/' blank
    edge    <- blank* (separator / end)

A quotation without its end, or with text after its end, is malformed: the parser goes back to its start and reads the
piece as bare, with an error flag.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quotation pairs, list marks, words for "nothing", legal forms that may follow a comma.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "'": "'"}
MARKS = "•‣▪◦●○■□▶►∙·*–—-"
NOTHING = ("", "n/a", "na", "n.a.", "none", "nil", "null", "nan", "not applicable", "-", "–", "—")
LEGAL_FORMS = (
    "inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "l.l.c", "lp", "l.p", "llp", "plc", "p.l.c", "pty ltd", "pty. ltd", "pty limited",
    "pty", "co", "company", "group", "gmbh", "g.m.b.h", "ag", "kg", "s.a", "sa", "s.a.s", "sas", "sarl", "s.a.r.l", "s.r.l", "srl", "s.p.a", "spa", "n.v", "nv", "b.v", "bv", "ab", "as", "oy", "bhd", "sdn bhd", "pte ltd", "pte. ltd", "kk", "k.k", "s. a",
)

_SPACE = re.compile(r"\s+")
_SEPARATOR = re.compile(r"[\n\r\t;|,\u2028\u2029\x0b\x0c]|(?<=\s)/(?=\s)")
_COMMA = re.compile(r",")
_BLANK = re.compile(r"[^\S\n\r\t\x0b\x0c\u2028\u2029]*")
_MARK = re.compile(rf"[{re.escape(MARKS)}][^\S\n\r\t]+|\(?\d{{1,3}}[.)][^\S\n\r\t]+")
_LEGAL = re.compile(r"(?:%s)\.?(?![^\W_])" % "|".join(re.escape(x).replace(r"\ ", r"\s+") for x in sorted(LEGAL_FORMS, key=lambda x: (-len(x), x))), re.I)


def fold_text(s: str) -> str:
    """White space of any kind trimmed at the ends and collapsed to one plain space."""
    return _SPACE.sub(" ", s).strip()


class Grammar:
    """The grammar above for one field; known: values that are never split."""

    def __init__(self, known: Iterable[str] = ()) -> None:
        words = sorted({fold_text(k) for k in known if k and fold_text(k)}, key=lambda k: (-len(k), k))
        self.known = re.compile("|".join(r"\s+".join(map(re.escape, k.split(" "))) for k in words), re.I) if words else None

    def edge(self, s: str, i: int, sep: re.Pattern, end: int) -> bool:
        j = _BLANK.match(s, i, end).end()
        return j >= end or sep.match(s, j, end) is not None

    def quoted(self, s: str, i: int, sep: re.Pattern, end: int) -> tuple[int, str] | None:
        close = QUOTES.get(s[i])
        if close is None:
            return None
        out, j = [], i + 1
        while j < end:
            ch = s[j]
            if ch == "\\" and j + 1 < end:
                out.append(s[j + 1])
                j += 2
            elif ch == close:
                if close == s[i] and s.startswith(close, j + 1) and j + 1 < end:
                    out.append(ch)
                    j += 2
                elif self.edge(s, j + 1, sep, end):
                    return j + 1, "".join(out)
                elif close in "’'":
                    out.append(ch)
                    j += 1
                else:
                    return None
            else:
                out.append(ch)
                j += 1
        return None

    def bracketed(self, s: str, i: int, sep: re.Pattern, end: int) -> tuple[int, str] | None:
        if s[i] != "(":
            return None
        j = s.find(")", i, end)
        return (j + 1, s[i + 1 : j]) if j > 0 and self.edge(s, j + 1, sep, end) else None

    def literal(self, s: str, i: int, sep: re.Pattern, end: int) -> tuple[int, str] | None:
        m = self.known.match(s, i, end) if self.known else None
        return (m.end(), m[0]) if m and self.edge(s, m.end(), sep, end) else None

    def bare(self, s: str, i: int, sep: re.Pattern, end: int) -> tuple[int, str]:
        j = i
        while True:
            m = sep.search(s, j, end)
            if m is None:
                return end, s[i:end]
            if m[0] == "," and s[i : m.start()].strip():
                k = _BLANK.match(s, m.end(), end).end()
                legal = _LEGAL.match(s, k, end)
                if legal and self.edge(s, legal.end(), sep, end):
                    j = legal.end()
                    continue
            return m.start(), s[i : m.start()]

    def piece(self, s: str, i: int, sep: re.Pattern, end: int) -> tuple[int, str, bool]:
        i = _BLANK.match(s, i, end).end()
        if m := _MARK.match(s, i, end):
            i = _BLANK.match(s, m.end(), end).end()
        if i < end:
            for rule in (self.quoted, self.bracketed, self.literal):
                if got := rule(s, i, sep, end):
                    j = _BLANK.match(s, got[0], end).end()
                    return j, got[1], False
        j, v = self.bare(s, i, sep, end)
        v = v.strip()
        bad = any(q in v for q in '"“”„«»')
        if bad:
            v = v.strip('"“”„«» ').replace('""', '"').replace('\\"', '"')
        return j, v, bad

    def parse(self, s: str) -> Iterator[tuple[str, bool]]:
        """Values in written order, each with its error flag. A field or piece that says nothing gives none."""
        i, end, sep = 0, len(s), _SEPARATOR
        while i < end and s[i].isspace():
            i += 1
        while end > i and s[end - 1].isspace():
            end -= 1
        if fold_text(s).lower() in NOTHING:
            return
        opened = i < end and s[i] == "["
        if opened and s[end - 1] == "]":
            i, end, sep, opened = i + 1, end - 1, re.compile(r"[,\n\r]"), False
        elif opened:
            i += 1
        while i < end:
            i, v, bad = self.piece(s, i, sep, end)
            v = fold_text(v)
            if v.lower() not in NOTHING:
                yield v, bad or opened
            m = sep.match(s, i, end)
            i = m.end() if m else max(i, end)


VALUES = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("malformed", T.BooleanType())]))


def packed_values(c: Column, known: Iterable[str] = (), of_row: Column | None = None) -> Column:
    """array<struct<pos, value, malformed>> of the packed field c; pos counts from 1.

    known: values that are never split; of_row: an array column with further ones for the row's own text. NULL, blank and "nothing"
    fields give an empty array. Equal fields of a batch are parsed once.
    """
    words = tuple(known)

    @F.pandas_udf(VALUES)
    def parse(fields: pd.Series) -> pd.Series:
        g, seen = Grammar(words), {None: []}
        for s in fields.dropna().unique():
            seen[s] = _listed(g, s)
        return fields.map(lambda s: seen[s] if isinstance(s, str) else [])

    @F.pandas_udf(VALUES)
    def parse_with(fields: pd.Series, own: pd.Series) -> pd.Series:
        seen: dict[str, list] = {}
        for s, k in zip(fields, own, strict=True):
            if isinstance(s, str) and s not in seen:
                seen[s] = _listed(Grammar((*words, *(k if k is not None else ()))), s)
        return fields.map(lambda s: seen[s] if isinstance(s, str) else [])

    return parse(c) if of_row is None else parse_with(c, of_row)


def _listed(g: Grammar, s: str) -> list[dict]:
    return [{"pos": k, "value": v, "malformed": bad} for k, (v, bad) in enumerate(g.parse(s), 1)]


def known_of(known_values: DataFrame | None, limit: int = 10_000) -> dict[str, list[str]] | DataFrame:
    """field -> values of a table of known values, for the grammar. A table of more than limit rows stays one: unpack_fields() then finds
    the values of each text by a join."""
    if known_values is None:
        return {}
    some = known_values.where("field IS NOT NULL AND known_value IS NOT NULL").select("field", "known_value").distinct()
    rows = some.limit(limit + 1).collect()
    if len(rows) > limit:
        return some
    out: dict[str, list[str]] = {}
    for f, v in rows:
        out.setdefault(f, []).append(v)
    return out


def known_in(texts: DataFrame, known_values: DataFrame) -> DataFrame:
    """(field, text, known): for distinct texts (field, text) the known values that stand in them. They meet over their first word, so
    neither side is ever on one machine; values without a letter or figure are in no text."""
    word = r"[\p{L}\p{N}]+"
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    k = known_values.select("field", "known_value", plain(F.col("known_value")).alias("plain")).withColumn("word", F.regexp_extract("plain", word, 0)).where("word <> ''")
    t = texts.select("field", "text", plain(F.col("text")).alias("folded"))
    t = t.select("field", "text", "folded", F.explode(F.array_distinct(F.regexp_extract_all("folded", F.lit(f"({word})")))).alias("word"))
    met = t.join(k, ["field", "word"]).where(F.contains("folded", "plain"))
    return met.groupBy("field", "text").agg(F.collect_set("known_value").alias("known"))


def unpack_fields(df: DataFrame, key: str, fields: Iterable[str], known: dict[str, list[str]] | DataFrame | None = None, version: str | None = None) -> DataFrame:
    """One row (key, field, pos, value, malformed) per value of each packed field of df.

    known: as from known_of(), a table (field, known_value) of any size or values by field. version: rows of one key are versions of it;
    the one with the largest version counts (ties: the largest field values). Without it every row counts. Rows whose key is NULL are kept under
    the NULL key. Other columns of df, whatever their names, are not read. Empty df: no rows.
    """
    fields = list(fields)
    base = df.select(F.col(f"`{key}`").alias("key"), *([F.col(f"`{version}`").alias("version")] if version else []), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    if version:
        last = F.max(F.struct("version", *[f"f{i}" for i in range(len(fields))])).alias("r")
        base = base.groupBy("key").agg(last).select("key", *[F.col(f"r.f{i}").alias(f"f{i}") for i in range(len(fields))])
    if isinstance(known, DataFrame):
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("text")) for i, f in enumerate(fields)])
        rows = base.select("key", F.explode(each).alias("e")).select("key", "e.field", "e.text").where("text IS NOT NULL")
        found = known_in(rows.select("field", "text").distinct(), known)
        lists = rows.join(found, ["field", "text"], "left").select("key", "field", packed_values(F.col("text"), (), F.col("known")).alias("vs"))
        return lists.select("key", "field", F.explode("vs").alias("v")).select(F.col("key").alias(key), "field", "v.pos", "v.value", "v.malformed")
    lists = base.select("key", *[packed_values(F.col(f"f{i}"), (known or {}).get(f, ())).alias(f"v{i}") for i, f in enumerate(fields)])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v{i}").alias("vs")) for i, f in enumerate(fields)])
    return lists.select("key", F.explode(each).alias("e")).select("key", "e.field", F.explode("e.vs").alias("v")).select(F.col("key").alias(key), "field", "v.pos", "v.value", "v.malformed")
