"""Extension points: registered steps from a configuration, formulas, scorers, reuse of earlier scores."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]
STEPS: dict[str, Callable[..., Step]] = {}


def step(f: Callable[..., Step]) -> Callable[..., Step]:
    """Register a maker of steps under its name."""
    STEPS[f.__name__] = f
    return f


@step
def identity() -> Step:
    return lambda df: df


@step
def longer_than(column: str, least: int) -> Step:
    return lambda df: df.where(F.col(column) > least)


@step
def one_of(column: str, values: list) -> Step:
    return lambda df: df.where(F.col(column).isin(*values))


@step
def without(columns: list[str]) -> Step:
    return lambda df: df.drop(*columns)


@step
def where(condition: str) -> Step:
    return lambda df: df.where(condition)


def made(spec: Step | dict | None) -> Step:
    """A step from a callable, a configuration ({"_target_": name, parameters...}) or nothing."""
    if spec is None:
        return identity()
    if callable(spec):
        return spec
    name = spec["_target_"]
    if name not in STEPS:
        raise ValueError(f"no step is called {name!r}")
    return STEPS[name](**{k: v for k, v in spec.items() if k != "_target_"})


def compose(specs: list | Step | dict | None) -> Step:
    """One step of several, in their order; all of them become one plan."""
    steps = [made(s) for s in (specs if isinstance(specs, list) else [specs])]

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


_OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}


def arithmetic(formula: str, columns: set[str] = frozenset()) -> Column:
    """A formula of numbers, the given columns, + - * / and signs as an expression; anything else is an error."""

    def of(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return of(n.body)
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return F.lit(n.value)
        if isinstance(n, ast.Name) and n.id in columns:
            return F.col(n.id)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -of(n.operand) if isinstance(n.op, ast.USub) else of(n.operand)
        if isinstance(n, ast.BinOp) and type(n.op) in _OPERATORS:
            return _OPERATORS[type(n.op)](of(n.left), of(n.right))
        raise ValueError(f"not allowed in a formula: {ast.dump(n)[:80]}")

    return of(ast.parse(formula, mode="eval"))


def scored(df: DataFrame, column: str, load: Callable[[], Callable[[list], list[float]]], name: str) -> DataFrame:
    """df with a score per row. load() makes the model once per task; it scores a batch's values at once."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(b.tolist()), dtype="float64")

    return df.withColumn(name, score(F.col(column)))


def incremental(rows: DataFrame, before: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with scores: those of before (keys, scores) where a key has one, else of score(rows that are left). Keys are compared once, with
    NULLs as values; a key that stands twice in before is an error when it is read."""
    once = before.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in before.columns if c not in keys])
    once = once.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key was scored twice"))).otherwise(F.col("_n"))).where("_n = 1").drop("_n")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    kept = once.alias("b").join(rows.select(*keys).alias("r"), [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left_semi")
    new = rows.join(once, same(rows, once), "left_anti")
    return kept.unionByName(score(new))
