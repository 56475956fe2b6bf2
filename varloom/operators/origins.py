"""Replication origins from signed mutations along chromosomes: count windows, tracks, distances, splines.

Mutations are rows of sample, chrom, pos and ``forward`` (true for TCT to TAT, false for AGA to ATA).
Windows and state run within a sample's chromosome, whose length bounds a group.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import stats as S
from ..functions.genomics import discretize_distance
from ..plans.intervals import disjoin, points_in_intervals

WINDOW = 20
#: Windows and difference of values within which marks after a collision are dropped.
GAP, LEEWAY = 2, 0.05


def read_signed(bed: DataFrame) -> DataFrame:
    """chrom, pos, forward from rows of chrom, start, end, _, value: the value's sign is the direction."""
    return bed.select("chrom", F.col("start").alias("pos"), (F.col("value") > 0).alias("forward"))


def count_windows(rows: DataFrame, keys: list[str], order: list[str], flag: str, pos: str, size: int = WINDOW) -> DataFrame:
    """Windows of the last ``size`` rows: counts of either flag, their binomial p signed by the majority, and the middle rows' span.

    A window comes out when it is full, and at the last row of a group that never fills one.
    """
    over = Window.partitionBy(*keys).orderBy(*order)
    last = over.rowsBetween(-(size - 1), 0)
    rows = rows.withColumn("__r", F.row_number().over(over)).withColumn("__end", F.lead(F.lit(1)).over(over).isNull())
    rows = rows.withColumn("n", F.count(F.lit(1)).over(last)).withColumn("n_forward", F.sum(F.col(flag).cast("bigint")).over(last))
    # the middle row of an odd window, the two middle rows of an even one
    rows = rows.withColumn("__near", F.collect_list(pos).over(last))
    rows = rows.where((F.col("__r") >= size) | F.col("__end"))
    n, k = F.col("n"), F.greatest(F.col("n_forward"), F.col("n") - F.col("n_forward"))
    p = S.binomial_tail(S.lnfact(max(size, 1)), n, k)
    sign = F.when(2 * F.col("n_forward") >= n, 1.0).otherwise(-1.0)
    low = F.element_at("__near", F.floor((n + 1) / 2).cast("int"))
    high = F.element_at("__near", (F.floor(n / 2) + 1).cast("int"))
    return rows.select(*keys, *order, "n", "n_forward", (sign * p).alias("signed_p"), F.least(low, high).alias("mid_start"), F.greatest(low, high).alias("mid_end"))


def track_states(windows: DataFrame, keys: list[str], order: list[str], value: str = "signed_p") -> DataFrame:
    """Positive, Negative, ORI (from positive to negative) or Collision (from negative to positive) against the window before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    v = F.col(value)
    state = (F.when((before > 0) & (v < 0), "ORI").when((before < 0) & (v > 0), "Collision").when(v > 0, "Positive").otherwise("Negative"))
    return windows.withColumn("state", state)


def inter_distance(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Distance from the end of the one before, also rounded to its power of ten."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(start, end))
    return rows.withColumn("distance", F.col(start) - before).withColumn("distance_class", discretize_distance(F.col("distance")))


class OriginTrack:
    """Origins and collisions along one chromosome's mutations: windows first, then one pass over them with the
    rows since which either direction has been seen, then the filter of marks that alternate."""

    def __init__(self, pos: list[int], forward: list[bool], size: int = WINDOW) -> None:
        self.forward, self.size = forward, size
        n = len(pos)
        upto = np.r_[0, np.cumsum(forward)].astype(int).tolist()
        tails: dict[int, list[float]] = {}
        self.rows = list(range(min(size, n) - 1, n)) if n else []
        self.p, self.middle, self.span = [], [], []
        for r in self.rows:
            begin = max(0, r - size + 1)
            c, k = r + 1 - begin, upto[r + 1] - upto[begin]
            if c not in tails:
                weights = np.array([math.comb(c, i) for i in range(c + 1)], float) / 2.0**c
                tails[c] = np.cumsum(weights[::-1])[::-1].tolist()
            self.p.append(tails[c][max(k, c - k)] * (1 if 2 * k >= c else -1))
            low, high = begin + (c - 1) // 2, begin + c // 2
            self.middle.append(low)
            self.span.append((int(pos[low]), int(pos[high])))
        self.marks: dict[int, str] = {}

    def find(self) -> None:
        since: dict[bool, int | None] = {True: None, False: None}
        seen = 0
        for w, r in enumerate(self.rows):
            for row in range(seen, r + 1):
                if since[self.forward[row]] is None:
                    since[self.forward[row]] = row
            seen = r + 1
            if not w:
                continue
            before, now = self.p[w - 1], self.p[w]
            if (before > 0) != (now > 0):
                self.marks[w] = "ORI" if before > 0 else "Collision"
                since = {True: None, False: None}
            elif now > 0:
                # a full window since the first backward row, yet still forward: the change lies half a window back
                if since[False] is not None and r - since[False] + 1 == self.size:
                    self.marks.setdefault(max(w + 1 - self.size // 2, 0), "ORI")
                    since = {True: None, False: None}
            elif since[True] is not None and now >= -0.1 and not self.forward[self.middle[w]]:
                at = self.turning(w)
                if at is not None:
                    self.marks.setdefault(at, "ORI")
                    since = {True: self.latest_forward(w, r), False: None}

    def turning(self, w: int) -> int | None:
        """Going back to the last origin, the window of the smallest value that a rise follows, if it isn't above the present one."""
        least = None
        for v in range(w - 1, -1, -1):
            if self.marks.get(v) == "ORI":
                return None
            if least is None or self.p[v] < self.p[least]:
                least = v
            elif self.p[v] > self.p[least]:
                return least if self.p[w] >= self.p[least] else None
        return None

    def latest_forward(self, w: int, r: int) -> int | None:
        """The last forward row before ``r`` whose window, or any later one, isn't an origin."""
        for back in range(1, w + 1):
            if self.marks.get(w - back) == "ORI":
                return None
            if self.forward[r - back]:
                return r - back
        return None

    def settle(self, gap: int = GAP, leeway: float = LEEWAY) -> list[tuple[int, int, str]]:
        """The marks without those that follow a collision within ``gap`` windows or on nearly equal values."""
        after = -1
        for w in sorted(k for k, v in self.marks.items() if v == "Collision"):
            if w <= after:
                continue
            reach = v = w
            while (v := v + 1) < len(self.p) and v - reach <= gap:
                if v in self.marks or abs(self.p[v] - self.p[reach]) <= leeway:
                    reach = v
            for v in range(w + 1, reach + 1):
                self.marks.pop(v, None)
            after = reach
        return [(*self.span[w], self.marks[w]) for w in sorted(self.marks)]


def find_origins(mutations: DataFrame, size: int = WINDOW, gap: int = GAP, leeway: float = LEEWAY) -> DataFrame:
    """start, end, kind (ORI or Collision) per sample and chromosome, from rows of sample, chrom, pos and ``forward``."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        track = OriginTrack(part["pos"].tolist(), part["forward"].tolist(), size)
        track.find()
        return pd.DataFrame([(part["sample"].iloc[0], int(part["chrom"].iloc[0]), *r) for r in track.settle(gap, leeway)],
                            columns=["sample", "chrom", "start", "end", "kind"])

    return mutations.select("sample", "chrom", "pos", "forward").groupBy("sample", "chrom").applyInPandas(
        run, "sample string, chrom int, start bigint, end bigint, kind string")


def origin_marks(mutations: DataFrame, size: int = WINDOW, gap: int = GAP, leeway: float = LEEWAY) -> DataFrame:
    """sample, chrom, pos, kind: the windows that ``find_origins`` marks, by the position of their last row as in ``count_windows``."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        track = OriginTrack(part["pos"].tolist(), part["forward"].tolist(), size)
        track.find()
        track.settle(gap, leeway)
        rows = [(part["sample"].iloc[0], int(part["chrom"].iloc[0]), int(part["pos"].iloc[track.rows[w]]), k) for w, k in sorted(track.marks.items())]
        return pd.DataFrame(rows, columns=["sample", "chrom", "pos", "kind"])

    return mutations.select("sample", "chrom", "pos", "forward").groupBy("sample", "chrom").applyInPandas(run, "sample string, chrom int, pos bigint, kind string")


def recurrent_origins(origins: DataFrame, least: int = 3) -> DataFrame:
    """Pieces covered by the origins of at least ``least`` samples."""
    return disjoin(origins.where("kind = 'ORI'"), ["chrom"], "start", "end").where(F.col("recurrence") >= least)


def origins_with_transcripts(origins: DataFrame, transcripts: DataFrame, leeway: int = 100_000) -> DataFrame:
    """Origins with each gene whose transcript, widened by the leeway, holds the origin's start; the first transcript of a gene."""
    near = transcripts.select(F.regexp_replace("chrom", "_.*$", "").alias("__c"), (F.col("start") - leeway).alias("t_start"), (F.col("end") + leeway).alias("t_end"), "gene")
    near = near.withColumnRenamed("__c", "t_chrom")
    rows = points_in_intervals(origins.withColumn("t_chrom", F.concat(F.lit("chr"), F.col("chrom").cast("string"))), near, ["t_chrom"], "start", "t_start", "t_end")
    over = Window.partitionBy("sample", "chrom", "start", "gene").orderBy("t_start", "t_end")
    return rows.withColumn("__r", F.row_number().over(over)).where("__r = 1").drop("__r", "t_chrom")


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray, clamp: float = 0.5) -> np.ndarray:
    """Natural cubic spline through the knots, by one tridiagonal sweep, clamped."""
    h, n = np.diff(x).astype(float), len(x)
    slope = np.diff(y) / h
    c, d = np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        w = 2 * (h[i - 1] + h[i]) - h[i - 1] * c[i - 1]
        c[i] = h[i] / w
        d[i] = (6 * (slope[i] - slope[i - 1]) - h[i - 1] * d[i - 1]) / w
    m = np.zeros(n)
    for i in range(n - 2, 0, -1):
        m[i] = d[i] - c[i] * m[i + 1]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, b = at - x[k], x[k + 1] - at
    out = (m[k] * b**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * b + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t
    return np.clip(out, -clamp, clamp)


def spline_knots(marked: np.ndarray, step: int) -> np.ndarray:
    """Indices of the first and last window, of all marked ones, and of every ``step``-th since the last knot."""
    ends = np.unique(np.r_[0, np.flatnonzero(marked), len(marked)])
    runs = [np.arange(a, b, step) for a, b in zip(ends, ends[1:])]
    return np.unique(np.r_[0, len(marked) - 1, *runs]).astype(int)


def spline_track(windows: DataFrame, marks: DataFrame | None = None, step: int = 3, least: int = 10) -> DataFrame:
    """Windows with ``smooth``: a spline through the first and last one, every origin and collision of ``marks`` (as
    ``origin_marks`` gives them) and every ``step``-th one since the last knot; groups of too few knots keep their values."""
    names = [*windows.columns, "smooth"]
    keys = ["sample", "chrom", "pos"]
    rows = windows.withColumn("__mark", F.lit(False)) if marks is None else windows.join(
        marks.select(*keys, F.lit(True).alias("__mark")).distinct(), keys, "left").withColumn("__mark", F.coalesce("__mark", F.lit(False)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["mid_start", "pos"], kind="stable")
        knots = part.iloc[spline_knots(part["__mark"].to_numpy(bool), step)].groupby("mid_start", as_index=False)["signed_p"].mean()
        y = part["signed_p"].to_numpy(float)
        if len(knots) > least:
            y = spline_values(knots["mid_start"].to_numpy(float), knots["signed_p"].to_numpy(float), part["mid_start"].to_numpy(float))
        return part.assign(smooth=y)[names]

    return rows.groupBy("sample", "chrom").applyInPandas(run, ", ".join(f"`{n}` {k}" for n, k in windows.dtypes) + ", smooth double")


def permuted_distances(rows: DataFrame, iterations: int = 50, seed: int = 7) -> DataFrame:
    """Distances between consecutive marked rows when as many marks are dealt out at random: iteration, distance_class, n per group."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        pos, marked = part["pos"].to_numpy(), int(part["marked"].sum())
        rng = np.random.default_rng([seed, zlib.crc32(str(part["sample"].iloc[0]).encode()), int(part["chrom"].iloc[0])])
        n, chunk, out = len(pos), max(1, 2_000_000 // max(1, len(pos))), []
        for begin in range(0, iterations if marked > 1 else 0, chunk):
            k = min(chunk, iterations - begin)
            # the smallest of random keys are a draw without replacement, for all iterations of a chunk at once
            drawn = np.sort(np.argpartition(rng.random((k, n)), marked - 1, axis=1)[:, :marked], axis=1)
            d = np.diff(pos[drawn], axis=1)
            which = np.repeat(np.arange(begin, begin + k), marked - 1)[d.ravel() > 0]
            d = d.ravel()[d.ravel() > 0]
            power = 10.0 ** np.minimum(np.floor(np.log10(d)), 4)
            out.append(pd.DataFrame({"iteration": which, "distance_class": np.floor(d / power + 0.5) * power}).value_counts(sort=False).rename("n").reset_index())
        table = pd.concat(out) if out else pd.DataFrame({"iteration": [], "distance_class": [], "n": []})
        return pd.DataFrame({"sample": str(part["sample"].iloc[0]), "chrom": int(part["chrom"].iloc[0]), "iteration": table["iteration"].astype("int32"),
                             "distance_class": table["distance_class"].astype(float), "n": table["n"].astype("int64")})

    return rows.groupBy("sample", "chrom").applyInPandas(run, "sample string, chrom int, iteration int, distance_class double, n bigint")
