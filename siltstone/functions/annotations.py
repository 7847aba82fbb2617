"""Functions of annotation rows: labels with their texts, typed fields, and the rules that make a row valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .criteria import NO, YES
from .text import excerpt_parts, visual_excerpt

# Ways to begin an option's name; fields that are flags; messages of the rules, in the order in which they are tried.
OPTION_PREFIXES = ("option", "Option", "OPTION", "opt", "Opt", "OPT")
FLAGS = ("has_no_support_info", "has_date", "date_text_is_scanned", "viz_elem_label", "viz_elem_scanned", "add_viz_elem_label", "add_viz_elem_scanned")
RULES = (
    "label is not yes, no or unclear",
    "yes, though flagged as without supporting information",
    "flagged as without supporting information, but the label is not no",
    "supporting text of another label only",
    "supporting text of several labels",
    "date without text or scan",
    "date text or scan without a date",
    "visual element without text or scan",
    "visual element without a page",
    "visual element without a type",
    "information on a visual element that is not there",
    "additional visual element without text or scan",
    "additional visual element without a page",
    "additional visual element without a type",
    "information on an additional visual element that is not there",
    "explanation of option 3 with another option",
)


def option(c: Column) -> Column:
    """1, 2 or 3 of an option's spelling; NULL for anything else."""
    s = F.trim(c)
    bare = F.regexp_extract(s, r"^(?:" + "|".join(OPTION_PREFIXES) + r")?[ _]?([123])$", 1)
    return F.nullif(bare, F.lit("")).cast("int")


def flag(c: Column) -> Column:
    """TRUE or FALSE of a flag written as text; blanks are FALSE, other texts an error when the row is read."""
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    wrong = F.raise_error(F.concat(F.lit("not a yes or no: "), s)).cast("boolean")
    return F.when(s.isin(*YES), True).when(s.isin(*NO, ""), False).otherwise(wrong)


def typed(name: str, c: Column) -> Column:
    """A field by its name: flags as booleans, other texts without blank ones."""
    return flag(c) if name.endswith(FLAGS) else blank_to_empty(c)


def blank_to_empty(c: Column) -> Column:
    """White space alone counts as empty."""
    return F.when(c.rlike(r"^\s+$"), "").otherwise(c)


def supporting_text(label: Column, yes: Column, no: Column, unclear: Column) -> Column:
    """The text that belongs to the label; NULL without a label."""
    return F.when(label == "YES", yes).when(label == "NO", no).when(label == "UNCLEAR", unclear)


def label_texts(label: Column, text: Column) -> Column:
    """struct<yes_text, no_text, unclear_text>: the text only in the field of its label, else empty."""
    return F.struct(*[F.when(label == k.upper(), F.coalesce(text, F.lit(""))).otherwise("").alias(f"{k}_text") for k in ("yes", "no", "unclear")])


def full_excerpt(main: Column, visuals: list[tuple[Column, Column, Column]], token: str = " // ") -> Column:
    """The main text and the texts of visual elements (text, type, page), those that are not empty, joined."""
    seen = [F.when(F.length(F.coalesce(t, F.lit(""))) > 0, visual_excerpt(t, F.when(F.lower(k).contains("table"), "table").otherwise("figure"), p)) for t, k, p in visuals]
    return F.array_join(F.array_compact(F.array(F.nullif(main, F.lit("")), *seen)), token)


def first_error(fields: dict[str, Column]) -> Column:
    """struct<rule, message> of the first rule that a row breaks, NULL for a valid row. Fields that are missing or NULL count as
    empty; the rule on options holds only where fields has an option."""
    none = F.lit(None)
    has = lambda k: F.coalesce(fields.get(k, none).cast("boolean"), F.lit(False)) if k in FLAGS else F.length(F.coalesce(fields.get(k, none).cast("string"), F.lit(""))) > 0
    label = fields["label"]
    texts = [has(k).cast("int") for k in ("yes_text", "no_text", "unclear_text")]
    own = F.coalesce(supporting_text(label, has("yes_text"), has("no_text"), has("unclear_text")), F.lit(False))
    several = texts[0] + texts[1] + texts[2]

    def visual(prefix: str) -> list[Column]:
        there, text, scan, page, kind = (has(f"{prefix}_{k}") for k in ("label", "text", "scanned", "page", "type"))
        return [there & ~text & ~scan, there & ~page, there & ~kind, ~there & (page | kind | text | scan)]

    date, written = has("has_date"), has("date_text") | has("date_text_is_scanned")
    broken = [
        label.isNull(),
        (label == "YES") & has("has_no_support_info"),
        has("has_no_support_info") & (label != "NO"),
        (several > 0) & ~own,
        several > 1,
        date & ~written,
        ~date & written,
        *visual("viz_elem"),
        *visual("add_viz_elem"),
    ]
    if "joint_option" in fields:
        broken.append(has("opt_3_explanation") & ~fields["joint_option"].eqNullSafe(F.lit(3)))
    return F.coalesce(*[F.when(b, F.struct(F.lit(k).alias("rule"), F.lit(RULES[k - 1]).alias("message"))) for k, b in enumerate(broken, 1)])


__all__ = ["blank_to_empty", "excerpt_parts", "first_error", "flag", "full_excerpt", "label_texts", "option", "supporting_text", "typed"]
