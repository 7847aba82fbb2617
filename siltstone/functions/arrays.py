"""Functions of arrays, maps and steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _named(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def positives(vector: Column, names: Sequence[str], first: int = 0) -> Column:
    """array<struct<idx, name>> of the positions from `first` on that are 1, each with the name of its own position."""
    pairs = F.transform(vector, lambda v, i: F.struct(i.alias("idx"), F.get(_named(names), i).alias("name"), v.alias("v")))
    return F.filter(pairs, lambda p: (p["v"] == 1) & (p["idx"] >= first))


def names(vector: Column, labels: Sequence[str]) -> Column:
    """Names of the positions that are 1."""
    return F.transform(positives(vector, labels), lambda p: p["name"])


def until(items: Column, stop: object) -> Column:
    """The items before the first `stop`."""
    at = F.array_position(items, F.lit(stop))
    return F.when(at > 0, F.slice(items, F.lit(1), at.cast("int") - 1)).otherwise(items)


def masked_text(text: Column, mask: Column) -> Column:
    """The characters of text at the places where the mask is TRUE."""
    kept = F.filter(F.transform(mask, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda p: p["m"])
    return F.array_join(F.transform(kept, lambda p: F.substring(text, p["i"] + 1, F.lit(1))), "")


def looked_up(entries: Column, key: Column, default: Column) -> Column:
    """The map's value of a key, default where it has none."""
    return F.coalesce(F.try_element_at(entries, key), default)


def only_item(items: Column) -> Column:
    """The item of an array of one; NULL for others."""
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def within(place: Column, n: Column) -> Column:
    """Whether a place, counted from 0, lies in an array of n items."""
    return F.coalesce((place >= 0) & (place < n), F.lit(False))


def elementwise_max(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def linear_rate(step: Column, steps: int, start: float, end: float) -> Column:
    """A rate that goes from start to end in a straight line over the steps, and stays there."""
    return start + F.least(step / steps, F.lit(1.0)) * (end - start)


def warm_cosine_rate(step: Column, warm: int, steps: int) -> Column:
    """A rate that rises to 1 over the warm-up and falls to 0 along half a cosine."""
    return F.when(step < warm, step / warm).otherwise(0.5 * (1 + F.cos(F.pi() * (step - warm) / (steps - warm))))
