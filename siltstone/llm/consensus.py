"""Consensus from several annotators' labels: a mean-field variational confusion model, reliabilities, agreement."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut

# Spellings of the labels.
YES = ("yes", "y", "true", "1")
NO = ("no", "n", "false", "0")
UNCLEAR = ("unclear",)


def label_of(c: Column) -> Column:
    """YES, NO or UNCLEAR; NULL for NULL, blank and anything else, which is no label."""
    s = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    return F.when(s.isin(*YES), "YES").when(s.isin(*NO), "NO").when(s.isin(*UNCLEAR), "UNCLEAR")


def label_code(c: Column) -> Column:
    """0, 1, 2 for NO, UNCLEAR, YES; NULL for what is no label."""
    s = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    return F.when(s.isin(*YES), 2).when(s.isin(*NO), 0).when(s.isin(*UNCLEAR), 1)


def latest_labels(df: DataFrame, item: list[str], annotator: str, label: str, when: str) -> DataFrame:
    """(item..., annotator, label): of an annotator's labels of an item the latest that is a label.

    NULL times count as the earliest; ties go to the larger of NO < UNCLEAR < YES. Rows without an annotator, or with a NULL
    in the item, speak for nobody and don't count. Repeated rows count once.
    """
    keys = [f"i{k}" for k in range(len(item))]
    code = label_code(F.col(f"`{label}`"))
    # Time and label in one number: its maximum needs no sort, unlike that of a struct.
    at = F.coalesce(F.unix_micros(F.col(f"`{when}`").cast("timestamp")), F.lit(-(1 << 60)))
    x = df.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(keys, item, strict=True)], F.col(f"`{annotator}`").alias("annotator"), (at * 4 + code).alias("r")).where("r IS NOT NULL").na.drop(subset=[*keys, "annotator"])
    last = F.pmod(F.col("r"), F.lit(4))
    return x.groupBy(*keys, "annotator").agg(F.max("r").alias("r")).select(*keys, "annotator", F.when(last == 2, "YES").when(last == 1, "UNCLEAR").otherwise("NO").alias("label"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma of positive x: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def beta_interval(a: float, b: float, mass: float = 0.95, grid: int = 4001) -> tuple[float, float]:
    """Equal-tailed interval of Beta(a, b), by its density on a grid of logits."""
    z = np.linspace(-14, 14, grid)
    p = 1 / (1 + np.exp(-z))
    d = a * np.log(p) + b * np.log1p(-p)
    c = np.cumsum(np.exp(d - d.max()))
    c /= c[-1]
    return float(p[np.searchsorted(c, (1 - mass) / 2)]), float(p[np.searchsorted(c, (1 + mass) / 2)])


def digamma_column(x: Column) -> Column:
    """Digamma of positive x as an expression: recurrence by 6, then the asymptotic series. No Python in the rounds."""
    z = x + 6.0
    y = 1.0 / (z * z)
    series = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return F.log(z) - 0.5 / z - series - sum(1.0 / (x + float(k)) for k in range(6))


class Consensus:
    """Mean-field variational Bayes over binary truth (YES, NO) with one confusion matrix per annotator.

    Priors: Dirichlet(prior_class) on the classes, Dirichlet(prior_right, prior_wrong) on each annotator's rows. UNCLEAR
    speaks for neither class. Items with equal sets of (annotator, label) have equal posteriors, so they are counted first and
    the rounds run over the distinct sets. Each round is two group-bys: by set (posterior), by annotator (digamma updates). Rounds that
    end without settling give a warning, and `converged` is False.
    """

    def __init__(self, labels: DataFrame, prior_class: float = 1.0, prior_right: float = 2.0, prior_wrong: float = 1.0, rounds: int = 60, tolerance: float = 1e-3) -> None:
        """labels: as from latest_labels()."""
        self.keys = [c for c in labels.columns if c not in ("annotator", "label")]
        self.prior = (prior_class, prior_right, prior_wrong)
        self.spark = labels.sparkSession
        voted = F.when(F.col("label") != "UNCLEAR", F.struct("annotator", (F.col("label") == "YES").alias("yes")))
        # Vote sets are told apart by 128 bits of hash.
        pattern = [F.xxhash64("votes").alias("p1"), F.xxhash64("votes", F.lit(1)).alias("p2")]
        items = labels.groupBy(*self.keys).agg(F.collect_set(voted).alias("votes")).select(*self.keys, F.array_sort("votes").alias("votes"))
        self.items = cut(items.select("*", *pattern), "items")
        sets = self.items.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.first("votes").alias("votes"))
        self.sets = cut(sets, "sets")
        self._run(rounds, tolerance)

    def _posterior(self, logs: DataFrame, prior_yes: float, prior_no: float) -> DataFrame:
        """(p1, p2, n, votes, q): q is the posterior of YES."""
        x = self.sets.select("p1", "p2", "n", "votes", F.explode_outer("votes").alias("v")).select("p1", "p2", "n", "votes", "v.annotator", "v.yes")
        x = x.join(logs, ["annotator", "yes"], "left").groupBy("p1", "p2").agg(F.sum(F.coalesce("ly", F.lit(0.0))).alias("ly"), F.sum(F.coalesce("ln", F.lit(0.0))).alias("ln"))
        return self.sets.join(x, ["p1", "p2"]).select("p1", "p2", "n", "votes", (1 / (1 + F.exp(F.col("ln") + prior_no - F.col("ly") - prior_yes))).alias("q"))

    def _update(self, post: DataFrame) -> DataFrame:
        """Posterior counts by annotator, and the classes' under the NULL annotator."""
        each = post.select(F.explode(F.concat("votes", F.array(F.lit(None).cast(post.schema["votes"].dataType.elementType)))).alias("v"), (F.col("n") * F.col("q")).alias("a"), (F.col("n") * (1 - F.col("q"))).alias("b"))
        each = each.select("v.annotator", "v.yes", "a", "b")
        on = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
        said, other = F.col("yes"), ~F.col("yes")
        return each.groupBy("annotator").agg(on(said, "a").alias("yy"), on(other, "a").alias("yn"), on(said, "b").alias("ny"), on(other, "b").alias("nn"), F.sum("a").alias("pos"), F.sum("b").alias("neg"))

    def _logs(self, counts: DataFrame) -> DataFrame:
        _, right, wrong = self.prior
        # E[log P(label | YES)], E[log P(label | NO)] of the Dirichlet rows.
        yy, yn, ny, nn = F.col("yy") + right, F.col("yn") + wrong, F.col("ny") + wrong, F.col("nn") + right
        row = lambda said, p, q: F.struct(F.lit(said).alias("yes"), (digamma_column(p) - digamma_column(yy + yn)).alias("ly"), (digamma_column(q) - digamma_column(ny + nn)).alias("ln"))
        return counts.where("annotator IS NOT NULL").select("annotator", F.explode(F.array(row(True, yy, ny), row(False, yn, nn))).alias("e")).select("annotator", "e.*")

    def _run(self, rounds: int, tolerance: float) -> None:
        c = self.prior[0]
        # Start: the share of YES among an item's votes.
        yes = F.size(F.filter("votes", lambda v: v["yes"]))
        x = self.sets.select("p1", "p2", "n", "votes", F.when(F.size("votes") > 0, yes / F.size("votes")).otherwise(0.5).alias("q"))
        counts = cut(self._update(x), "counts")
        pos, neg = self._classes(counts)
        self.converged = False
        for self.rounds in range(1, rounds + 1):
            both = digamma(np.array([pos + c, neg + c]))
            after = cut(self._update(self._posterior(self._logs(counts), *map(float, both))), "counts")
            # One aggregate says how far the counts moved and what the classes are now.
            j = after.alias("a").join(counts.alias("b"), F.col("a.annotator").eqNullSafe(F.col("b.annotator")))
            none = F.col("a.annotator").isNull()
            moved = j.agg(F.max(sum(F.abs(F.col(f"a.{k}") - F.col(f"b.{k}")) for k in ("yy", "ny", "pos"))), F.max("a.pos"), F.max(F.when(none, F.col("a.pos"))), F.max(F.when(none, F.col("a.neg")))).head()
            drop_cut(counts)
            counts, pos, neg = after, moved[2] or 0.0, moved[3] or 0.0
            if moved[0] is None or self.rounds > 1 and moved[0] <= tolerance * max(1.0, moved[1]):
                self.converged = True
                break
        else:
            warnings.warn(f"consensus did not settle in {rounds} rounds", RuntimeWarning, stacklevel=3)
        self.counts = counts
        self.posterior = self._posterior(self._logs(counts), *map(float, digamma(np.array([pos + c, neg + c])))).select("p1", "p2", "q")

    @staticmethod
    def _classes(counts: DataFrame) -> tuple[float, float]:
        total = counts.where("annotator IS NULL").select("pos", "neg").head()
        return (total["pos"], total["neg"]) if total else (0.0, 0.0)

    def per_item(self) -> DataFrame:
        """(item..., p_yes, consensus, n_votes): consensus is the more probable class, NO at exactly one half."""
        x = self.items.select(*self.keys, "p1", "p2", F.size("votes").alias("n_votes")).join(self.posterior, ["p1", "p2"])
        return x.select(*self.keys, F.col("q").alias("p_yes"), F.when(F.col("q") > 0.5, "YES").otherwise("NO").alias("consensus"), "n_votes")

    def per_annotator(self) -> DataFrame:
        """(annotator, sensitivity, sens_low, sens_high, specificity, spec_low, spec_high, n_labels): posterior means and 95 % intervals."""
        _, right, wrong = self.prior

        @F.pandas_udf("lo double, hi double")
        def interval(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([beta_interval(x, y) for x, y in zip(a, b, strict=True)], columns=["lo", "hi"])

        a, b, p, q = F.col("yy") + right, F.col("yn") + wrong, F.col("nn") + right, F.col("ny") + wrong
        x = self.counts.where("annotator IS NOT NULL").select("annotator", (a / (a + b)).alias("sensitivity"), interval(a, b).alias("s"), (p / (p + q)).alias("specificity"), interval(p, q).alias("t"), F.round(F.col("yy") + F.col("yn") + F.col("ny") + F.col("nn")).cast("long").alias("n_labels"))
        return x.select("annotator", "sensitivity", F.col("s.lo").alias("sens_low"), F.col("s.hi").alias("sens_high"), "specificity", F.col("t.lo").alias("spec_low"), F.col("t.hi").alias("spec_high"), "n_labels")


def krippendorff(labels: DataFrame, by: str) -> DataFrame:
    """(by, n_items, alpha): nominal alpha over the items of each group that have at least two labels; labels as from
    latest_labels(), of which UNCLEAR is a category of its own. alpha is NULL where all labels agree by having one category."""
    keys = [c for c in labels.columns if c not in ("annotator", "label")]
    per = labels.groupBy(*keys).agg(*[F.count(F.when(F.col("label") == k, 1)).alias(k) for k in ("YES", "NO", "UNCLEAR")], F.count("*").alias("m")).where("m >= 2")
    same = sum(F.col(k) * (F.col(k) - 1) for k in ("YES", "NO", "UNCLEAR"))
    g = per.groupBy(by).agg(F.count("*").alias("n_items"), F.sum((F.col("m") * (F.col("m") - 1) - same) / (F.col("m") - 1)).alias("apart"), F.sum("m").alias("n"), *[F.sum(k).alias(k) for k in ("YES", "NO", "UNCLEAR")])
    expected = (F.col("n") * F.col("n") - sum(F.col(k) * F.col(k) for k in ("YES", "NO", "UNCLEAR"))) / (F.col("n") - 1)
    return g.select(by, "n_items", F.when(expected > 0, F.round(1 - F.col("apart") / expected, 6)).alias("alpha"))
