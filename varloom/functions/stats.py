"""Discrete distributions and tests as expressions over a table of log-factorials.

``lnfact(n)`` is an array of ln(i!) for i = 0..n held in one broadcast row; sums over k are higher-order
functions, so everything stays in the JVM. What needs a larger n, or gamma functions, is a Pandas UDF.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..plans.cut import cut


def lnfact(most: int) -> Column:
    """ln(i!) for i = 0..most as one literal array (``most`` up to a few thousand)."""
    if most > 5000:
        raise ValueError("a literal table of at most 5000; use the Pandas forms beyond")
    total, values = 0.0, [0.0]
    for i in range(1, most + 1):
        total += math.log(i)
        values.append(total)
    return F.lit(np.array(values))


def _at(table: Column, n: Column) -> Column:
    return F.get(table, n.cast("int"))


def binomial_pmf(table: Column, n: Column, k: Column, p: float) -> Column:
    log = _at(table, n) - _at(table, k) - _at(table, n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    return F.when((k >= 0) & (k <= n), F.exp(log)).otherwise(0.0)


def binomial_tail(table: Column, n: Column, k: Column, p: float = 0.5) -> Column:
    """P(X >= k); 1 for n <= 0 or k <= 0, 0 for k > n."""
    terms = F.transform(F.sequence(F.least(k, n).cast("int"), n.cast("int")), lambda i: binomial_pmf(table, n, i, p))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when((n <= 0) | (k <= 0), 1.0).when(k > n, 0.0).otherwise(F.least(total, F.lit(1.0)))


def poisson_pmf(table: Column, mean: Column, k: Column) -> Column:
    return F.when(k >= 0, F.exp(k * F.ln(mean) - mean - _at(table, k))).otherwise(0.0)


def poisson_tail(table: Column, mean: Column, k: Column) -> Column:
    """P(X >= k)."""
    below = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)).cast("int")), lambda i: poisson_pmf(table, mean, i)),
                        F.lit(0.0), lambda s, x: s + x)
    return F.when(k <= 0, 1.0).otherwise(1.0 - below)


def poisson_best(table: Column, means: list[float], k: Column) -> Column:
    """The mean under which ``k`` is most likely; scanning stops at the first that isn't better."""
    best = F.lit(means[-1])
    for a, b in reversed(list(zip(means, means[1:]))):
        best = F.when(poisson_pmf(table, F.lit(a), k) >= poisson_pmf(table, F.lit(b), k), a).otherwise(best)
    return best


def log_choose(table: Column, n: Column, k: Column) -> Column:
    return _at(table, n) - _at(table, k) - _at(table, n - k)


def fisher_point(table: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Probability of a 2x2 table under fixed margins."""
    return F.exp(_at(table, a + b) + _at(table, c + d) + _at(table, a + c) + _at(table, b + d)
                 - _at(table, a) - _at(table, b) - _at(table, c) - _at(table, d) - _at(table, a + b + c + d))


def fisher_tails(table: Column, a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Left-, right- and two-tailed p of Fisher's exact test."""
    row, col, n = a + b, a + c, a + b + c + d
    low, high = F.greatest(F.lit(0), row + col - n), F.least(row, col)
    point = fisher_point(table, a, b, c, d)
    each = F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda x: F.struct(
        x.alias("x"), fisher_point(table, x, row - x, col - x, n - row - col + x).alias("p")))

    def total(keep) -> Column:
        return F.least(F.aggregate(F.filter(each, keep), F.lit(0.0), lambda s, x: s + x["p"]), F.lit(1.0))

    return total(lambda x: x["x"] <= a), total(lambda x: x["x"] >= a), total(lambda x: x["p"] <= point * (1 + 1e-9))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("p_left", "p_right", "p_two")]))
def fisher_of(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    """The three p-values for tables of any size."""
    top = int((a + b + c + d).max()) if len(a) else 0
    log = np.r_[0.0, np.cumsum(np.log(np.arange(1, top + 1)))]
    out = []
    for w, x, y, z in zip(a, b, c, d):
        row, col, n = int(w + x), int(w + y), int(w + x + y + z)
        k = np.arange(max(0, row + col - n), min(row, col) + 1)
        p = np.exp(log[row] + log[n - row] + log[col] + log[n - col] - log[n] - log[k] - log[row - k] - log[col - k] - log[n - row - col + k])
        own = p[int(w) - k[0]]
        out.append([min(float(p[m].sum()), 1.0) for m in (k <= w, k >= w, p <= own * (1 + 1e-9))])
    return pd.DataFrame(out, columns=["p_left", "p_right", "p_two"])


def fdr_threshold(df: DataFrame, p: str, alpha: float, keys: list[str] | None = None, dependent: bool = False) -> DataFrame:
    """Benjamini-Hochberg (-Yekutieli when ``dependent``) threshold per group: the largest p within its line, 0 without one.

    Ranks come from counts per distinct p, summed over blocks of sorted p, never from one task's sort of all rows.
    """
    keys = keys or []
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.withColumn("blk", F.floor(F.col(p) * 1024)))
    blocks = counts.groupBy(*keys, "blk").agg(F.sum("n").alias("bn"))
    over = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    blocks = blocks.select(*keys, "blk", (F.sum("bn").over(over.orderBy("blk")) - F.col("bn")).alias("before"), F.sum("bn").over(over).alias("m"))
    inner = Window.partitionBy(*keys, "blk").orderBy(p)
    ranked = counts.join(blocks, [*keys, "blk"]).withColumn("rank", F.col("before") + F.sum("n").over(inner))
    c = F.ln("m") + F.lit(0.5772156649015329) + 1 / (2 * F.col("m")) if dependent else F.lit(1.0)
    return ranked.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(p) <= F.col("rank") / (F.col("m") * c) * alpha, F.col(p))), F.lit(0.0)).alias("threshold"))


def half_binomial_tails(n: int, log: np.ndarray) -> np.ndarray:
    """P(X >= k) for k = 0..n at one half; ``log`` holds ln(i!) up to n at least."""
    pmf = np.exp(log[n] - log[: n + 1] - log[n::-1] - n * math.log(2))
    return np.minimum(np.cumsum(pmf[::-1])[::-1], 1.0)


def log_factorials(most: int) -> np.ndarray:
    return np.r_[0.0, np.cumsum(np.log(np.arange(1, most + 1)))]


def permutation_threshold(coverage: int, level: float = 0.05, log: np.ndarray | None = None) -> float:
    """The exact ``level`` quantile of the imbalance p of balanced reads at a coverage (the law a permutation samples).

    The p of a larger allele count k is its upper tail, and twice that tail is the share of draws with such a p or a smaller one.
    """
    if coverage <= 0:
        return 1.0
    tails = half_binomial_tails(coverage, log_factorials(coverage) if log is None else log)[-(-coverage // 2):]
    return float(tails[2 * tails >= level].min())


@F.pandas_udf(T.DoubleType())
def permutation_threshold_of(coverage: pd.Series) -> pd.Series:
    """The threshold per distinct coverage; meant for a table of distinct coverages, joined back."""
    each = [int(c) for c in coverage.dropna().unique()]
    log = log_factorials(max([0, *each]))
    return coverage.map({c: permutation_threshold(c, log=log) for c in each}).astype("float64")


def chi2_sf(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees exceeds x): the regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * front)
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, h * front)


def uniform_chi2_p(counts: np.ndarray) -> float:
    """p of bin counts against equal shares, as rounded percentages with an expected count of at least one, rescaled to
    what the rounded percentages sum to."""
    total = counts.sum()
    if total == 0:
        return 1.0
    observed = np.floor(counts / total * 100 + 0.5)
    expected = max(1.0, 100 / len(counts))
    if abs(observed.sum() - expected * len(counts)) > 1e-5:
        expected = observed.sum() / len(counts)
    if expected == 0:
        return 1.0
    return chi2_sf(float(((observed - expected) ** 2 / expected).sum()), len(counts) - 1)
