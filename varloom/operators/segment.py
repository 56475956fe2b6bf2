"""Segments of equal events, and the iterative region caller that merges, tests and fills them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.genomics import CN_EVENTS
from ..functions.stats import uniform_chi2_p
from ..plans.intervals import collapse_islands

#: Events that neither start nor break a segment.
UNSEGMENTED = ("Noise", "Ignored", "HETSomatic")
#: Candidate mean lists of the tumor fraction, the balanced one first; the second line for higher sensitivity.
CANDIDATES = ((0.5,), (0.4, 0.6), (1 / 3, 2 / 3), (0.3, 0.7), (0.25, 0.75), (0.2, 0.8), (0.15, 0.85), (0.1, 0.9), (0.05, 0.95), (0.005, 0.995), (0.0001, 0.9999))
FINE_CANDIDATES = ((0.48, 0.52), (0.45, 0.55))
#: Targets of the merging passes in order, number of passes.
TARGETS, PASSES = ("GainSomatic", "LOH", "cnLOH"), 3


def segments(sites: DataFrame) -> DataFrame:
    """sample, chrom, event, start, end, n of consecutive valid sites with one event. Sites without a valid event don't break one."""
    valid = sites.where(~F.col("event").isin(*UNSEGMENTED)).select("sample", "chrom", "pos", "event")
    over = valid.groupBy("sample", "chrom", "pos").agg(F.min("event").alias("event"))
    return collapse_islands(over, ["sample", "chrom"], "pos", ["event"])


def remove_singletons(regions: DataFrame) -> DataFrame:
    return regions.where("start <> end")


def _best_pmf(means: tuple[float, ...], log: bool) -> np.ndarray:
    """For x = 0..100 the probability under the candidate's most likely mean, scanning stopped at the first that isn't better."""
    out = np.empty(101)
    for x in range(101):
        best = -1.0
        for m in sorted(means):
            lam = 100.0 * m
            p = math.exp(x * math.log(lam) - lam - math.lgamma(x + 1))
            if p <= best:
                break
            best = p
        out[x] = best
    return np.log(np.maximum(out, 1e-300)) if log else out


class ChromosomeCaller:
    """Regions of one sample's chromosome: segment, merge and fill until the passes are done."""

    def __init__(self, pos, event, cn, vaf_t, var_n, cov_n, sensitivity: str = "Low", log: bool = False) -> None:
        self.pos, self.event, self.cn = pos, event, cn
        self.vaf, self.sensitivity, self.log = vaf_t, sensitivity, log
        self.band = (cov_n > 0) & (100 * var_n > 10 * cov_n) & (100 * var_n <= 90 * cov_n)
        self.used = self.band & (var_n > 0) & (var_n < cov_n) & ~np.isnan(vaf_t)
        self.x = np.clip(np.floor(100 * np.nan_to_num(vaf_t) + 0.5), 0, 100).astype(int)
        self.band_upto = np.r_[0, np.cumsum(self.band)]
        self._tables: dict[bool, np.ndarray] = {}

    def table(self, target: str) -> np.ndarray:
        fine = self.sensitivity != "Low" and target in ("GainSomatic", "LOH")
        if fine not in self._tables:
            lists = (CANDIDATES[0], *FINE_CANDIDATES, *CANDIDATES[1:]) if fine else CANDIDATES
            self._tables[fine] = np.array([_best_pmf(c, self.log) for c in lists])
            self.lists = {**getattr(self, "lists", {}), fine: lists}
        return self._tables[fine]

    def segment(self) -> list[list]:
        """[first row, last row, event, sites] of each run of a valid event."""
        out: list[list] = []
        last = None
        for i in range(len(self.pos)):
            e = self.event[i]
            if e in UNSEGMENTED or self.pos[i] == last:
                continue
            last = self.pos[i]
            if out and out[-1][2] == e:
                out[-1][1] = i
                out[-1][3] += 1
            else:
                out.append([i, i, e, 1])
        return out

    def test(self, a: int, b: int, target: str) -> bool:
        """Whether rows a..b carry the event: not balanced, not uniform, and for copy-neutral loss with peaks off the centre."""
        if a >= b:
            return False
        rows = np.flatnonzero(self.used[a : b + 1]) + a
        if len(rows) == 0:
            return False
        table = self.table(target)
        winner = int(table[:, self.x[rows]].sum(1).argmax())
        if winner == 0:
            return False
        v = self.vaf[rows]
        if uniform_chi2_p(np.histogram(v, 11, (0, 1))[0]) >= 0.05:
            return False
        if target == "cnLOH" and 1.25 < np.nanmean(self.cn[a : b + 1]) < 2.5:
            near = lambda c: int(((v > c - 0.04) & (v <= c + 0.04)).sum())
            means = self.lists[self.sensitivity != "Low" and target in ("GainSomatic", "LOH")][winner]
            peaks = [near(m) > near(0.5) for m in means]
            return any(peaks) if self.sensitivity == "VeryHigh" else all(peaks)
        return True

    def copy_rule(self, target: str, cn: float, ok: bool) -> bool:
        rule = {"LOH": 1.1 < cn <= 1.8, "DELHom": cn <= 1.1, "cnLOH": 1.8 < cn < 2.2, "GainSomatic": cn >= 2.2}.get(target, True)
        return ok and rule if self.sensitivity == "Low" or target == "cnLOH" else rule

    def combine(self, a: list, b: list, same: bool) -> bool:
        if same and a[2] != b[2]:
            return False
        low, high = a[1] + 1, b[0] - 1
        between = int(self.band_upto[b[0]] - self.band_upto[low]) if high >= low else 0
        if same and between == 0:
            return True
        return self.test(a[0], b[1], a[2]) if between < 8 else self.test(low, high, a[2])

    def merge(self, regions: list[list], target: str) -> list[list]:
        out: list[list] = []
        ext = None
        for r in regions:
            if r[2] == target:
                if ext is not None:
                    ok = self.combine(ext, r, True)
                    if r[0] - 1 >= ext[1] + 1:
                        ok = self.copy_rule(target, float(np.nanmean(self.cn[ext[1] + 1 : r[0]])), ok)
                    if ok:
                        ext[1], ext[3] = r[1], ext[3] + r[3]
                        continue
                ext = list(r)
                out.append(ext)
            elif target in CN_EVENTS and r[2] in CN_EVENTS:
                ext = None
            elif ext is not None and r[2] == "HETGermline":
                if self.copy_rule(target, float(np.nanmean(self.cn[r[0] : r[1] + 1])), self.combine(ext, r, False)):
                    ext[1], ext[3] = r[1], ext[3] + r[3]
        return out

    def fill(self, region: list, target: str) -> None:
        rows = np.arange(region[0], region[1] + 1)
        own = self.event[rows]
        if self.test(region[0], region[1], target):
            self.event[rows[np.isin(own, ("HETGermline", "Noise", "Ignored"))]] = target
        else:
            self.event[rows[(own == target) & (self.cn[rows] < 3.8)]] = "HETGermline"

    def run(self) -> None:
        for _ in range(PASSES):
            for target in TARGETS:
                for region in self.merge(self.segment(), target):
                    self.fill(region, target)
        for a, b, _, _ in self.segment():
            self.cn[a : b + 1] = np.nanmean(self.cn[a : b + 1])


def call_regions(sites: DataFrame, sensitivity: str = "Low", log: bool = False) -> DataFrame:
    """Sites with events and copy numbers after all passes. Chromosomes are independent, so one sample's chromosome is a group."""
    names = sites.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        caller = ChromosomeCaller(part["pos"].to_numpy(), part["event"].to_numpy(object).copy(), part["cn"].to_numpy(float).copy(),
                                  part["adj_vaf_t"].to_numpy(float), part["var_n"].to_numpy(float), part["cov_n"].to_numpy(float), sensitivity, log)
        caller.run()
        return part.assign(event=caller.event, cn=caller.cn)[names]

    return sites.groupBy("sample", "chrom").applyInPandas(run, sites.schema)


def fill_regions(sites: DataFrame, regions: DataFrame, target: str) -> DataFrame:
    """Sites of accepted regions (sample, chrom, start, end) that are heterozygous, noise or ignored become ``target``."""
    from ..plans.intervals import points_in_intervals

    marked = points_in_intervals(sites.select("sample", "chrom", "pos"), regions.select("sample", "chrom", "start", "end"), ["sample", "chrom"], "pos", "start", "end")
    inside = marked.select("sample", "chrom", "pos").distinct().withColumn("__in", F.lit(True))
    open_ = F.col("event").isin("HETGermline", "Noise", "Ignored")
    return sites.join(inside, ["sample", "chrom", "pos"], "left").withColumn(
        "event", F.when(F.col("__in") & open_, target).otherwise(F.col("event"))).drop("__in")


def reassign_by_copy_number(regions: DataFrame, cn: str = "cn") -> DataFrame:
    """Regions' events by copy number alone: amplified, two copies, or lost."""
    from ..functions.genomics import copy_number_class

    kind = copy_number_class(F.col(cn))
    return regions.withColumn("event", F.when(kind == "amp", "GainSomatic").when(kind == "diploid", "cnLOH").when(kind.isNotNull(), "LOH"))


def fit_r2(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fit of a straight line to a region's sorted values: R2 and squared error, ranks counted within the region."""
    from pyspark.sql import Window

    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    return ranked.groupBy(*keys).agg(F.regr_r2(value, "__r").alias("r2"), (F.regr_syy(value, "__r") - F.try_divide(
        F.regr_sxy(value, "__r") * F.regr_sxy(value, "__r"), F.regr_sxx(value, "__r"))).alias("sse"))
