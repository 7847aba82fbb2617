"""Criteria of an annotated statement, in the order that fixes array positions, and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The criteria in order; the names of their two groups; spellings of labels.
CRITERIA = (
    "approval", "signature", "c1 (reporting entity)", "c2 (structure)", "c2 (operations)", "c2 (supply chains)", "c3 (risk description)", "c4 (risk mitigation)", "c4 (remediation)", "c5 (effectiveness)", "c6 (consultation)",
)
GROUPS = {"a-s-c1": CRITERIA[:3], "c2-c3-c4-c5-c6": CRITERIA[3:]}
YES = ("yes", "Yes", "YES", "y", "Y", "True", "true", "1")
NO = ("no", "No", "NO", "n", "N", "False", "false", "0")
UNCLEAR = ("unclear", "Unclear", "UNCLEAR")
MERGED = {"c2": (3, 4, 5), "c4": (7, 8)}


def criteria_of(setup: str) -> tuple[str, ...]:
    """any, the name of a group, a criterion or the beginning of one."""
    if setup == "any":
        return CRITERIA
    if setup in GROUPS:
        return GROUPS[setup]
    found = tuple(c for c in CRITERIA if c.startswith(setup))
    if not found:
        raise ValueError(f"no criterion begins with {setup!r}")
    return found


def label(c: Column) -> Column:
    """YES, NO or UNCLEAR; NULL for blanks and unknown spellings."""
    s = F.trim(c)
    return F.when(s.isin(*YES), "YES").when(s.isin(*NO), "NO").when(s.isin(*UNCLEAR), "UNCLEAR")


def group_of(c: Column) -> Column:
    return F.when(c.isin(*GROUPS["a-s-c1"]), "a-s-c1").when(c.isin(*GROUPS["c2-c3-c4-c5-c6"]), "c2-c3-c4-c5-c6")


def position(c: Column) -> Column:
    """0-based place of a criterion."""
    return F.array_position(F.array(*[F.lit(x) for x in CRITERIA]), c) - 1
