"""Percentiles of very large numeric columns: merging centroid digests with certified rank error.

Each task clusters the sorted values of its groups under a size function of the quantile (small
clusters at both ends), digests merge by clustering their centroids again, and a second pass counts
how many values lie below and at each estimate, which gives its true rank error.

Defined results: null and NaN are no values; a group without values gives no row; null keys are a
group of their own; infinite values are values and sort last; a group of one value estimates that
value everywhere; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.cut import cut
from ..plans.joins import BROADCAST_ROWS
from ..plans.spread import spread

#: Clusters of a digest, about. One at the median holds 1.6 / DELTA of the values, those towards the ends less: the
#: rank error stays below that share of a group, or below one value where that is more.
DELTA = 200
#: Values a task holds before it clusters them.
HOLD = 500_000
#: Tasks whose digests of a group merge at once; those of more merge in layers.
FAN_IN = 64

DIGEST = "n bigint, low double, high double, means array<double>, weights array<double>"


def _cluster_ids(low: np.ndarray, high: np.ndarray, delta: int) -> np.ndarray:
    """Cluster of each item from the quantiles at its edges: the unit interval of k(q) holding its middle."""
    q = np.clip((low + high) / 2, 0.0, 1.0)
    return np.floor(delta / np.pi * np.arcsin(2 * q - 1)).astype(np.int64)


def cluster(group: np.ndarray, value: np.ndarray, weight: np.ndarray, delta: int = DELTA) -> pd.DataFrame:
    """Digests of all groups at once from weighted values: sort, cut each group by the size function, average."""
    order = np.lexsort((value, group))
    group, value, weight = group[order], value[order], weight[order]
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[heads, len(group)])
    total = np.add.reduceat(weight, heads)
    upto = np.cumsum(weight)
    before = np.repeat(upto[heads] - weight[heads], sizes)
    whole = np.repeat(total, sizes)
    ids = _cluster_ids((upto - weight - before) / whole, (upto - before) / whole, delta)
    # the ends stay exact, so the smallest and the largest value are clusters of their own
    new = np.r_[True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])]
    new[heads] = True
    new[heads[sizes > 1] + 1] = True
    new[(heads + sizes - 1)] = True
    begin = np.flatnonzero(new)
    weights = np.add.reduceat(weight, begin)
    with np.errstate(invalid="ignore"):
        means = np.add.reduceat(value * weight, begin) / weights
    lone = np.diff(np.r_[begin, len(value)]) == 1
    means[lone] = value[begin][lone]
    bad = np.isnan(means)  # both infinities in one cluster
    means[bad] = value[begin][bad]
    cuts = np.searchsorted(begin, heads)
    return pd.DataFrame({
        "group": group[heads], "n": np.rint(total).astype(np.int64), "low": value[heads],
        "high": value[heads + sizes - 1], "means": np.split(means, cuts[1:]), "weights": np.split(weights, cuts[1:]),
    })


def merge(digests: pd.DataFrame, delta: int = DELTA) -> tuple[int, float, float, np.ndarray, np.ndarray]:
    """One digest from several: their centroids, clustered again."""
    means = np.concatenate(digests["means"].to_list())
    weights = np.concatenate(digests["weights"].to_list())
    out = cluster(np.zeros(len(means), np.int64), means, weights, delta).iloc[0]
    return int(digests["n"].sum()), float(digests["low"].min()), float(digests["high"].max()), out["means"], out["weights"]


def estimate(low: float, high: float, means: np.ndarray, weights: np.ndarray, shares: list[float]) -> np.ndarray:
    """Values at the given shares, interpolated between the middles of neighbouring clusters."""
    middle = np.cumsum(weights) - weights / 2
    at = np.asarray(shares) * weights.sum()
    out = np.interp(at, middle, means)
    return np.clip(np.where(np.isnan(out), means[np.searchsorted(middle, at).clip(0, len(means) - 1)], out), low, high)


def digest_groups(df: DataFrame, groupings: dict[str, Column], values: dict[str, Column], delta: int = DELTA) -> DataFrame:
    """Digests per (by, key, field): one per group of each grouping and each value column, mergeable later.

    Rows are never shuffled; a task sends one digest per group it saw in each ``HOLD`` values. Digests of more than
    ``FAN_IN`` tasks merge in as many layers as it takes, so what a task gathers doesn't grow with the table.
    """
    names, fields = list(groupings), list(values)
    source = df.select(*[c.cast("string").alias(f"k{i}") for i, c in enumerate(groupings.values())],
                       *[c.cast("double").alias(f"v{i}") for i, c in enumerate(values.values())])

    def flush(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(held, ignore_index=True)
        for i, by in enumerate(names):
            codes, keys = pd.factorize(rows[f"k{i}"], use_na_sentinel=False)
            for j, field in enumerate(fields):
                v = rows[f"v{j}"].to_numpy(np.float64)
                real = ~np.isnan(v)
                if not real.any():
                    continue
                out = cluster(codes[real].astype(np.int64), v[real], np.ones(int(real.sum())), delta)
                key = pd.Series(keys, dtype=object)[out.pop("group").to_numpy()].reset_index(drop=True)
                yield pd.DataFrame({"by": by, "key": key.where(key.notna(), None), "field": field}).join(out)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= HOLD:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    parts = spread(source).mapInPandas(partial, f"by string, key string, field string, {DIGEST}")
    parts = cut(parts.withColumn("layer", F.spark_partition_id()))
    layers = (parts.agg(F.max("layer")).first()[0] or 0) + 1
    while layers > FAN_IN:
        layers = -(-layers // FAN_IN)
        parts = cut(merge_digests(parts.withColumn("layer", F.col("layer") % layers), ["by", "key", "field", "layer"], delta))
    return merge_digests(parts, ["by", "key", "field"], delta)


def merge_digests(digests: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """The digests of each group of ``keys`` as one, whatever parts or days they come from."""
    kinds = ", ".join(f"`{k}` {digests.schema[k].dataType.simpleString()}" for k in keys)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        n, low, high, means, weights = merge(part, delta)
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "n": [n], "low": [low], "high": [high],
                             "means": [means], "weights": [weights]})

    columns = [*keys, "n", "low", "high", "means", "weights"]
    return digests.select(*columns).groupBy(*keys).applyInPandas(run, f"{kinds}, {DIGEST}")


def estimates(digests: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """``q``: the estimates at ``shares`` of each digest, in their order."""
    kinds = ", ".join(f"`{k}` {digests.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = [estimate(r.low, r.high, np.asarray(r.means), np.asarray(r.weights), shares) for r in b.itertuples()]
            yield b[[*keys, "n"]].assign(q=q)

    return digests.mapInPandas(run, f"{kinds}, n bigint, q array<double>")


def percentiles(df: DataFrame, groupings: dict[str, Column], values: dict[str, Column],
                shares: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), delta: int = DELTA,
                max_broadcast_groups: int = BROADCAST_ROWS // 10, salts: int = 16) -> DataFrame:
    """by, key, field, n, share, estimate, n_below, n_at and ``rank_error``: the certified distance of
    ``share`` from the ranks the estimate really has, as a part of n (0 when it lies within them).

    The counting pass reads the table again and sums in the JVM, so tasks send counts only. The
    estimates are broadcast while there are few groups, otherwise joined by salted keys.
    """
    fields = list(values)
    found = cut(estimates(digest_groups(df, groupings, values, delta), ["by", "key", "field"], list(shares)))
    wide = found.groupBy("by", "key").agg(*[
        F.first(F.when(F.col("field") == f, F.col("q")), ignorenulls=True).alias(f"q{j}") for j, f in enumerate(fields)])
    rows = df.select(
        F.explode(F.array(*[F.struct(F.lit(by).alias("by"), c.cast("string").alias("key")) for by, c in groupings.items()])).alias("g"),
        *[c.cast("double").alias(f"v{j}") for j, c in enumerate(values.values())],
    ).select("g.by", "g.key", *[F.nanvl(f"v{j}", F.lit(None).cast("double")).alias(f"v{j}") for j in range(len(fields))])
    same = ["by", "key"]
    if found.select("by", "key").distinct().limit(max_broadcast_groups + 1).count() <= max_broadcast_groups:
        right = F.broadcast(wide)
    else:
        same.append("salt")
        rows = rows.withColumn("salt", (F.rand(11) * salts).cast("int"))
        right = wide.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    joined = rows.join(right, [rows[c].eqNullSafe(right[f"r_{c}"]) for c in same])
    sums = []
    for j in range(len(fields)):
        for i in range(len(shares)):
            q = F.col(f"r_q{j}")[i]
            sums += [F.count_if(F.col(f"v{j}") < q).alias(f"b{j}_{i}"), F.count_if(F.col(f"v{j}") == q).alias(f"a{j}_{i}")]
    counts = joined.groupBy("by", "key").agg(*sums)
    counts = counts.select("by", "key", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(p).alias("share"), F.lit(i).alias("i"),
                 F.col(f"b{j}_{i}").alias("n_below"), F.col(f"a{j}_{i}").alias("n_at"))
        for j, f in enumerate(fields) for i, p in enumerate(shares)])).alias("c")).select("by", "key", "c.*")
    other = counts.select(*[F.col(c).alias(f"c_{c}") for c in counts.columns])
    out = found.join(other, (found["by"] == other["c_by"]) & found["key"].eqNullSafe(other["c_key"]) & (found["field"] == other["c_field"]))
    rank = F.col("c_share") * F.col("n")
    low, high = F.col("c_n_below"), F.col("c_n_below") + F.col("c_n_at")
    return out.select(
        "by", "key", "field", "n", F.col("c_share").alias("share"), F.col("q")[F.col("c_i")].alias("estimate"),
        F.col("c_n_below").alias("n_below"), F.col("c_n_at").alias("n_at"),
        (F.greatest(low - rank, rank - high, F.lit(0.0)) / F.col("n")).alias("rank_error"))
