"""Dates in mixed notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Notations of a date, tried in this order (regular expression, Spark pattern).
NOTATIONS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "y.M.d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.y"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM y"),
    (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM y"),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "MMM d y"),
    (r"^[A-Z][a-z]{3,} \d{1,2} \d{4}$", "MMMM d y"),
)
SPACES = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def fold(c: Column) -> Column:
    """White space of any kind trimmed at the ends and collapsed to one plain space."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def readable_date(c: Column) -> Column:
    """The date in c, whatever its notation; NULL if it can't be read.

    All-number dates that end in the year have the day first. A time of day after the date is ignored; impossible days
    (31 February) are unreadable.
    """
    t = F.regexp_replace(fold(c), r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?$", "")
    words = F.regexp_replace(F.regexp_replace(F.initcap(F.regexp_replace(t, r"[,.]", " ")), " +", " "), r"\bSept\b", "Sep")
    words = F.regexp_replace(F.trim(words), r"\b(\d{1,2})(St|Nd|Rd|Th)\b", "$1")
    # Bound as a lambda's variable, each form of the text is made once, not once per notation.
    forms = F.array(F.struct(t.alias("t"), words.alias("w")))

    def read(x: Column) -> Column:
        return F.coalesce(*[F.when(x["w" if "MMM" in pattern else "t"].rlike(shape), F.try_to_date(x["w" if "MMM" in pattern else "t"], pattern)) for shape, pattern in NOTATIONS])

    return F.get(F.transform(forms, read), 0)
