"""Paired statistics of run records: exact McNemar test, paired bootstrap, Holm correction, comparison matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_N = 1_000
TAIL_BLOCK = 65_536


def last_per_query(records: DataFrame, by: Sequence[str] = ("condition", "i"), order: str = "rec_id") -> DataFrame:
    """Of replayed records the last one counts."""
    rest = [c for c in records.columns if c not in by]
    return records.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*by, "x.*")


def mcnemar_p(a_only: Column, b_only: Column) -> Column:
    """Two-sided exact p of the discordant counts: the binomial tail by its recurrence, in logarithms for large counts."""
    n, m = (a_only + b_only).cast("double"), F.least(a_only, b_only)
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("sum"))
    short = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.when(n <= LOG_N, m).otherwise(F.lit(0)).cast("bigint")),
        start,
        lambda s, j: F.struct((s["term"] * (n - j) / (j + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).when(n <= LOG_N, F.least(F.lit(1.0), 2 * short)).otherwise(_log_tail(a_only, b_only))


def binomial_tail(n: int, m: int) -> float:
    """P(X <= m) of n fair coins, m <= n / 2: the largest term, then the ratios down from it until they add nothing.

    That is some multiple of the root of n terms, taken in blocks.
    """
    from math import exp, lgamma, log

    total, last, j = 1.0, 1.0, m
    while j > 0 and last > 1e-18 * total:
        at = np.arange(j, max(0, j - TAIL_BLOCK), -1, dtype=np.float64)
        terms = last * np.cumprod(at / (n - at + 1))
        total, last, j = total + float(terms.sum()), float(terms[-1]), j - len(at)
    return exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) - n * log(2) + log(total))


@F.pandas_udf(T.DoubleType())
def _log_tail(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, 2 * binomial_tail(int(x + y), int(min(x, y)))) for x, y in zip(a, b)], dtype="float64")


def paired(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., i, a, b)``: what both sides have, each ``(by..., i, correct)`` with unique keys."""
    keys = [*by, "i"]
    return a.select(*keys, F.col("correct").alias("a")).join(b.select(*keys, F.col("correct").alias("b")), keys)


def mcnemar(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, a_only, b_only, diff, p)``."""
    counts = (pairs.groupBy(*by) if by else pairs.groupBy()).agg(
        F.count("*").alias("n"), F.sum((F.col("a") > F.col("b")).cast("bigint")).alias("a_only"), F.sum((F.col("b") > F.col("a")).cast("bigint")).alias("b_only"), F.avg(F.col("a") - F.col("b")).alias("diff")
    )
    return counts.withColumn("p", mcnemar_p(F.col("a_only"), F.col("b_only")))


def bootstrap(pairs: DataFrame, by: Sequence[str], reps: int = 1_000, seed: int = 7) -> DataFrame:
    """``(by..., diff, lo, hi)``: mean of a - b and its 95 % interval over ``reps`` paired resamples.

    A resample of n pairs depends only on how many of them have each difference (-1, 0, 1), and these three numbers are
    multinomial. So the pairs are aggregated to their counts and each resample is one draw of three numbers, which is
    exact at any n. Every group starts from ``seed``, so its interval does not depend on the other groups.
    """
    counts = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("a") < F.col("b")).cast("bigint")).alias("neg"), F.sum((F.col("a") > F.col("b")).cast("bigint")).alias("pos"))

    @F.pandas_udf("lo double, hi double")
    def interval(n: pd.Series, neg: pd.Series, pos: pd.Series) -> pd.DataFrame:
        rows = []
        for total, below, above in zip(n.tolist(), neg.tolist(), pos.tolist()):
            drawn = np.random.default_rng(seed).multinomial(total, [below / total, above / total, (total - below - above) / total], reps)
            x = np.sort(drawn[:, 1] - drawn[:, 0])
            rows.append((x[int(0.025 * reps)] / total, x[int(0.975 * reps) - 1] / total))
        return pd.DataFrame(rows, columns=["lo", "hi"], dtype="float64")

    placed = counts.withColumn("x", interval("n", F.coalesce("neg", F.lit(0)), F.coalesce("pos", F.lit(0))))
    return placed.select(*by, ((F.col("pos") - F.col("neg")) / F.col("n")).alias("diff"), "x.lo", "x.hi")


def holm(tests: DataFrame, p: str = "p", order: Sequence[str] = ()) -> DataFrame:
    """Adds ``holm_p``: the step-down correction over all rows (as many as there are comparisons)."""
    n = Window.partitionBy(F.lit(0))
    w = n.orderBy(p, *order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = tests.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(n))
    step = step.withColumn("_adj", F.least(F.lit(1.0), (F.col("_n") - F.col("_rn") + 1) * F.col(p)))
    return step.withColumn("holm_p", F.max("_adj").over(upto)).drop("_rn", "_n", "_adj")


def comparison_matrix(records: DataFrame, comparisons: DataFrame) -> DataFrame:
    """``(question, a, b, acc_a, acc_b, n, a_only, b_only, diff, p, holm_p)`` of ``comparisons(question, a, b)``.

    ``records(condition, i, correct)`` has each query of a condition once. Accuracies are over all records of a condition;
    a comparison one of whose conditions has no records is skipped.
    """
    accuracy = records.groupBy("condition").agg(F.avg("correct").alias("acc"))
    left = comparisons.join(records.select(F.col("condition").alias("a"), "i", F.col("correct").alias("x")), "a")
    both = left.join(records.select(F.col("condition").alias("b"), "i", F.col("correct").alias("y")), ["b", "i"]).select("question", "a", "b", F.col("x").alias("_a"), F.col("y").alias("_b"))
    tests = both.groupBy("question", "a", "b").agg(
        F.count("*").alias("n"), F.sum((F.col("_a") > F.col("_b")).cast("bigint")).alias("a_only"), F.sum((F.col("_b") > F.col("_a")).cast("bigint")).alias("b_only"), F.avg(F.col("_a") - F.col("_b")).alias("diff")
    )
    tests = tests.withColumn("p", mcnemar_p(F.col("a_only"), F.col("b_only")))
    tests = tests.join(accuracy.select(F.col("condition").alias("a"), F.col("acc").alias("acc_a")), "a").join(accuracy.select(F.col("condition").alias("b"), F.col("acc").alias("acc_b")), "b")
    return holm(tests, "p", ("question", "a", "b"))
