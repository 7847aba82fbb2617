"""Text functions as Column expressions: abbreviation repair, sentence separators, clean-up, identifiers, answers.

White space and word classes are spelled out, so the expressions mean the same in every engine and for every script.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations whose dots never end a sentence; those whose dots may, in this order; code points of bullets; the page
# token; separators of annotators' excerpts; punctuation stripped from the ends of a sentence.
NEVER_END = ("esp.", "No.", "Num.", "Sec.", "Fig.", "e.g.", "i.e.", "vs.", "Dr.", "Mr.", "Mrs.", "Ms.", "Hon.", "Prof.", "Rep.")
MAY_END = (
    "Inc.", "Pty.", "Ltd.", "Pty.Ltd.", "Pty. Limited", "Co.", "Corp.", "ABN.", "AN.", "etc.", "Jan.", "Feb.", "Mar.", "Apr.", "Jun.", "Jul.", "Aug.", "Sep.", "Oct.", "Nov.", "Dec.", "Rev.", "Est.",
    "A.I.", "Bhd.", "Ges.m.b.H.", "G.m.b.H.", "L.L.C.", "LLC.", "U.S.", "Jr.", "Sr.", "esq.", "approx.", "H.R.", "PhD.", "Ph.D.", "Eng.", "Atty.", "Mgr.", "Dir.",
)
BULLETS = (
    "2022", "2043", "25E6", "2619", "2765", "29BE", "29BF", "2023", "2024", "204C", "204D", "2219", "25D8", "25D9", "25AA", "25AB", "25FD", "25FE", "2794", "2798", "2799", "279A", "279D", "2B1B", "2B1C",
    "2B25", "2B26", "2B27", "2B28", "2012", "2013", "2014",
)
PAGE_TOKEN = "\n----\n\n//\n\n----\n"
EXCERPT_TOKEN = " // "
EDGE = r"\.,;:!\?\x{201C}\x{201D}\""

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Guards: one look at the first character spares most places all alternatives.
_NOT_WITHIN = r"(?![A-Za-z0-9,])"
_COMMON = rf"\.{WS}+|\n{WS}*[{''.join(rf'\x{{{b}}}' for b in BULLETS)}]{WS}*|\n{WS}*-{WS}+|\n{WS}*[A-Za-z0-9][\.\)]{WS}+"
SEPARATORS = {
    "fitz": rf"{WS}*----\n\n//\n\n----{WS}*|{_COMMON}|{WS}*\n{WS}*\n{WS}*",
    "abbyy": rf"{_COMMON}|{WS}*\n{WS}*",
    "annotators": rf"{_COMMON}|{WS}*\n{WS}*\n{WS}*",
}
NEVER_PATTERN = "(?:" + "|".join(re.escape(a).replace(r"\ ", " ") for a in NEVER_END) + ")"
MAY_PATTERN = "(?:" + "|".join(re.escape(a).replace(r"\ ", " ") for a in MAY_END) + rf")[,;:]?{WS}[^A-Z]"


def section_pattern(last_year: int | None = None) -> tuple[str, str]:
    """(pattern of a leading section number, pattern of lines that begin with a year from 2015 to last_year, as a whole word, and
    keep it); last_year is next year by default."""
    years = "|".join(str(y) for y in range(2015, (last_year or date.today().year + 1) + 1))
    return r"^[\.\-\(]?\d+(?:[\.\-]\d*)*\)?", rf"^[\.\-\(]?(?:{years})\b"


def _initials(words: tuple[str, ...]) -> str:
    return "(?=[" + "".join(sorted({w[0] for w in words})) + "])"


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c bound to a variable: it is computed once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def without_dots(c: Column, pattern: str) -> Column:
    """c without the dots inside the matches of pattern, found in one pass."""
    pattern = {NEVER_PATTERN: _initials(NEVER_END), MAY_PATTERN: _initials(MAY_END)}.get(pattern, "") + pattern

    def joined(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        bare = F.concat(F.transform(found, lambda m: F.replace(m, F.lit("."), F.lit(""))), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(x, pattern), bare, lambda a, b: F.concat(a, b)), "")

    return _bound(c, joined)


def repaired_abbreviations(c: Column) -> Column:
    return without_dots(without_dots(c, NEVER_PATTERN), MAY_PATTERN)


def cleaned_sentence(c: Column, last_year: int | None = None) -> Column:
    """Section number off, ASCII only, one pass of punctuation off each end, white space collapsed."""
    section, year = section_pattern(last_year)
    x = F.when(c.rlike(year), c).otherwise(F.regexp_replace(c, section, ""))
    # Guards: most sentences have nothing to take out.
    x = _bound(x, lambda v: F.when(F.octet_length(v) == F.length(v), v).otherwise(F.regexp_replace(v, r"[^\x{00}-\x{7F}]", "")))
    x = F.regexp_replace(x, rf"^{WS}*[{EDGE}]+{WS}*", "")
    x = _bound(x, lambda v: F.when(F.substring(v, -1, 1).rlike(f"[{WS[1:-1]}{EDGE}]"), F.regexp_replace(v, rf"{WS}*[{EDGE}]+{WS}*$", "")).otherwise(v))
    # Single plain blanks stay as they are.
    return F.trim(F.regexp_replace(x, rf"{WS}{{2,}}|[\t\n\x{{0B}}\f\r\x{{1C}}-\x{{1F}}]", " "))


def has_word(c: Column) -> Column:
    """Whether c has a word of at least two word characters."""
    return c.rlike(r"\b\w{2,}\b")


def sentences_of(c: Column, source: str = "fitz", last_year: int | None = None) -> Column:
    """The cleaned sentences of a raw text: separators of its source, then clean-up; those without a word are left out."""
    return F.filter(F.transform(F.split(repaired_abbreviations(c), f"{_NOT_WITHIN}(?:{SEPARATORS[source]})"), lambda s: cleaned_sentence(s, last_year)), has_word)


def excerpt_parts(c: Column) -> Column:
    """Parts of an annotator's excerpt, cut at // (not that of an address)."""
    return F.split(c, rf"\.?{WS}*(?<!http:)(?<!https:)(?<!ftp:)//{WS}*(?:[\.\x{{2022}}\-]{WS}*)?")


def excerpt_origin(c: Column) -> Column:
    """infographic or table for excerpts with a figure or table prefix, else main_body."""
    return F.when(c.rlike(r"^\s*fig\.p\d+\.\s*"), "infographic").when(c.rlike(r"^\s*tab\.p\d+\.\s*"), "table").otherwise("main_body")


def without_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*(?:fig|tab)\.p\d+\.\s*", "")


def visual_excerpt(text: Column, kind: Column, page: Column) -> Column:
    """Parts of a visual element's text, each with its prefix, joined again; page 0 where it has no digits."""
    digits = F.regexp_extract(F.coalesce(page, F.lit("")), r"(\d+)", 1)
    head = F.concat(F.when(kind == "table", F.lit("tab")).otherwise("fig"), F.lit(".p"), F.when(digits == "", "0").otherwise(digits), F.lit("."))
    return F.array_join(F.transform(excerpt_parts(text), lambda x: F.concat(head, x)), EXCERPT_TOKEN)


def word_count(c: Column) -> Column:
    """Pieces between single blanks."""
    return F.size(F.split(c, " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer text; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def id_of_link(c: Column) -> Column:
    """The number that ends an address."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"/(\d+)/?$", 1), F.lit("")), F.lit("9999999999")).cast("int")


def id_with_commas(c: Column) -> Column:
    """A number written with thousands commas."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("int")


def yes_no(c: Column) -> Column:
    """1 for an answer that is or begins with yes, 0 for no, else -1."""
    x = F.trim(F.regexp_replace(F.lower(c), r"[\.,;:!\?'\"]", ""))
    return F.when((x == "yes") | x.rlike(r"^yes[^0-9a-zA-Z]"), 1).when((x == "no") | x.rlike(r"^no[^0-9a-zA-Z]"), 0).otherwise(-1)


def sample_id(statement: Column, sentence: Column) -> Column:
    return F.format_string("statement%05d:sentence%05d", statement, sentence)


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD), ASCII only."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def slug(c: Column) -> Column:
    """Lower case, accents and ligatures as plain letters; only letters, figures, _ and dashes; runs of blanks and dashes become
    one dash, none at the ends."""
    kept = F.regexp_replace(F.lower(_decomposed(c)), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


# Keywords of statements about the future.
FUTURE = ("will", "intend", "expect", "aim", "plan", "anticipate", "future", "going to", "shall", "may include", "plans to", "2024", "next year", "at a later stage", "next steps", "to be completed", "continue", "continuing")


def about_future(c: Column) -> Column:
    """Whether a sentence has a keyword about the future anywhere."""
    return F.lower(c).rlike("|".join(FUTURE))


def mentions(c: Column, word: str) -> Column:
    """Whether a comment has a word as it is written; NULL comments have none."""
    return F.coalesce(F.contains(c, F.lit(word)), F.lit(False))


def is_sample_id(c: Column) -> Column:
    return c.rlike(r"^statement[0-9]{5,}:sentence[0-9]{5,}$")


def wrapped(c: Column, width: int, mark: str = "\n") -> Column:
    """c with a mark after every `width` characters."""
    return F.regexp_replace(c, "(?s)(.{%d})" % width, "$1" + mark)


def templated(template: str, **fields: Column) -> Column:
    """The template with {name} replaced by fields; NULL fields are empty. Other braces stay."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, fields)) + r")\}", template)
    return F.concat(*[F.coalesce(fields[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def iso_text(c: Column) -> Column:
    """A time as ISO text, to the second."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def time_of_iso(c: Column) -> Column:
    """The time of an ISO text; NULL if it is none."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def time_of(c: Column) -> Column:
    """The time of a text yyyy-MM-dd HH:mm:ss; NULL if it is none."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


# --- sentences with the places of their characters -----------------------------------------------------------------------


def _python(pattern: str) -> re.Pattern:
    """A pattern of this module for Python: code points in its notation, white space spelled out as it is."""
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern))


def _kept(s: str, at: list[int], spans: list[tuple[int, int]]) -> tuple[str, list[int]]:
    """s and the places of its characters without the spans."""
    out, places, end = [], [], 0
    for a, b in spans:
        out.append(s[end:a])
        places.extend(at[end:a])
        end = b
    return "".join(out) + s[end:], places + at[end:]


def sentences_with_offsets(column: str, source: str = "fitz", last_year: int | None = None) -> Column:
    """array<struct<pos, sentence, offsets>>: what sentences_of() makes of the text, each character with its place in the raw text.

    A run of white space that became one blank has the place of its first character. NULL stays NULL. Built-in expressions give no
    places of matches, so this is a vectorised Python function; sentences_of() is the way where places aren't needed.
    """
    never, may, cut_at = (_python(p) for p in (NEVER_PATTERN, MAY_PATTERN, f"{_NOT_WITHIN}(?:{SEPARATORS[source]})"))
    section, year = (_python(p) for p in section_pattern(last_year))
    head, tail = _python(rf"^{WS}*[{EDGE}]+{WS}*"), _python(rf"{WS}*[{EDGE}]+{WS}*\Z")
    blanks, word = _python(rf"{WS}{{2,}}|[\t\n\x{{0B}}\f\r\x{{1C}}-\x{{1F}}]"), re.compile(r"\b\w{2,}\b", re.ASCII)

    def one(text: str) -> list[dict]:
        s, at = text, list(range(len(text)))
        for p in (never, may):
            s, at = _kept(s, at, [(m.start() + i, m.start() + i + 1) for m in p.finditer(s) for i, ch in enumerate(m[0]) if ch == "."])
        out, begin = [], 0
        for m in (*cut_at.finditer(s), None):
            x, o = s[begin : m.start() if m else len(s)], at[begin : m.start() if m else len(s)]
            begin = m.end() if m else begin
            if not year.match(x) and (n := section.match(x)):
                x, o = x[n.end() :], o[n.end() :]
            x, o = _kept(x, o, [(i, i + 1) for i, ch in enumerate(x) if ord(ch) > 127])
            for p in (head, tail):
                if n := p.search(x):
                    x, o = _kept(x, o, [n.span()])
            runs = [n.span() for n in blanks.finditer(x)]
            chars = list(x)
            for a, _ in runs:
                chars[a] = " "
            x, o = _kept("".join(chars), o, [(a + 1, b) for a, b in runs])
            a, b = len(x) - len(x.lstrip(" ")), len(x.rstrip(" "))
            x, o = x[a:b], o[a:b]
            if word.search(x):
                out.append({"pos": len(out), "sentence": x, "offsets": o})
        return out

    place = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("sentence", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(T.ArrayType(place))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else one(t))

    return run(F.col(column))
