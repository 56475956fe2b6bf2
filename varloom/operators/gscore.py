"""Recurrent aberrations: G-scores of markers, null by convolution, q-values, peaks and peel-off.

Markers are long: marker, chrom, pos, sample, value. Scores are whole numbers of bins of 0.001.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.genomics import SHORT_ARMS, arm
from ..plans.cut import cut
from ..plans.joins import sized_join

#: Bin of a score, thresholds and caps of gains and losses, high-level thresholds, q threshold.
BIN, GAIN, LOSS, CAP_GAIN, CAP_LOSS, HIGH_GAIN, HIGH_LOSS, Q = 0.001, 0.3, -0.3, 1.5, -1.5, 0.9, -1.3, 0.25
#: Probability below which the ends of a law are cut off.
NEGLIGIBLE = 1e-60
#: Fixed value: markers looked ahead over a gap when peel-off is limited.
LOOK_AHEAD = 11
#: Samples convolved by one task at a time.
FAN_IN = 64


def unpivot_markers(wide: DataFrame, id_cols: tuple[str, ...] = ("marker", "chrom", "pos")) -> DataFrame:
    """Marker x sample matrix as long rows; extra ``Genetic`` and ``Score`` columns are left out."""
    samples = [c for c in wide.columns if c not in id_cols and not c.startswith(("Genetic", "Score"))]
    return wide.unpivot(list(id_cols), samples, "sample", "value")


def arm_medians(markers: DataFrame) -> DataFrame:
    """Upper median of each sample's markers per chromosome arm."""
    rows = markers.where("value IS NOT NULL").withColumn("arm", arm(F.col("chrom"), F.col("pos")))
    over = Window.partitionBy("sample", "chrom", "arm")
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(over)).withColumn("__r", F.row_number().over(over.orderBy("value", "marker")))
    return rows.where(F.col("__r") == F.floor(F.col("__n") / 2) + 1).select("sample", "chrom", "arm", F.col("value").alias("median"))


def focal_thresholds(markers: DataFrame) -> DataFrame:
    """Per sample the largest and smallest arm median: what focal gains and losses must exceed."""
    return arm_medians(markers).groupBy("sample").agg(F.max("median").alias("high"), F.min("median").alias("low"))


def contributions(markers: DataFrame, focal: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Each marker's and sample's score per type (AMP, DEL; LOH comes from ``loh_contributions``): capped values beyond the threshold, in bins, times the weight."""
    rows = markers.where("value IS NOT NULL")
    rows = rows.join(focal, "sample", "left") if focal is not None else rows.withColumns({"high": F.lit(0.0), "low": F.lit(0.0)})
    rows = rows.join(weights, "sample", "left") if weights is not None else rows.withColumn("weight", F.lit(1))
    v = F.greatest(F.least(F.col("value"), F.lit(CAP_GAIN)), F.lit(CAP_LOSS))
    score = F.floor(v / BIN + 0.5).cast("bigint") * F.coalesce("weight", F.lit(1))
    amp = F.when(v > F.coalesce("high", F.lit(0.0)) + GAIN, score).otherwise(0)
    loss = F.when(v < F.coalesce("low", F.lit(0.0)) + LOSS, -score).otherwise(0)
    return rows.select("marker", "chrom", "pos", "sample", F.explode(F.array(
        F.struct(F.lit("AMP").alias("type"), amp.alias("score")), F.struct(F.lit("DEL").alias("type"), loss.alias("score")))).alias("x")).select(
        "marker", "chrom", "pos", "sample", "x.*")


def loh_contributions(markers: DataFrame) -> DataFrame:
    """Scores of type LOH from a matrix of its own, long as the other markers: 1 (or a share) where a sample lost heterozygosity."""
    score = F.floor(F.greatest(F.col("value"), F.lit(0.0)) / BIN + 0.5).cast("bigint")
    return markers.where("value IS NOT NULL").select("marker", "chrom", "pos", "sample", F.lit("LOH").alias("type"), score.alias("score"))


def g_scores(parts: DataFrame) -> DataFrame:
    """G-score of each marker and type."""
    return parts.groupBy("type", "marker", "chrom", "pos").agg(F.sum("score").alias("g"))


def differential_weights(groups: DataFrame) -> DataFrame:
    """Weights of a comparison of two groups of samples (sample, group 1 or 2): group 1 by the size of 2, group 2 by minus that of 1."""
    n = groups.agg(F.count_if(F.col("group") == 1).alias("n1"), F.count_if(F.col("group") == 2).alias("n2"))
    return groups.crossJoin(F.broadcast(n)).select("sample", F.when(F.col("group") == 1, F.col("n2")).otherwise(-F.col("n1")).cast("int").alias("weight"))


def strength(value: str = "value") -> tuple:
    """0, 1 or 2 (high level) of a gain and of a loss; 0 or 1 of lost heterozygosity."""
    v = F.col(value)
    gain = F.when(v > HIGH_GAIN, 2).when(v > GAIN, 1).otherwise(0)
    loss = F.when(v < HIGH_LOSS, 2).when(v < LOSS, 1).otherwise(0)
    return gain, loss, F.when(v > 0, 1).otherwise(0)


def null_distribution(parts: DataFrame) -> DataFrame:
    """Law of G if each sample's scores were shuffled over the markers: type, g, log_p (ln P(G >= g)).

    Each sample's histogram is counted in the cluster; histograms are convolved in groups of ``FAN_IN``,
    groups of groups and so on, so no task and not the driver holds those of all samples.
    """
    hist = parts.groupBy("type", "sample", "score").agg(F.count(F.lit(1)).alias("n"))

    def first(part: pd.DataFrame) -> pd.DataFrame:
        low, high = int(part["score"].min()), int(part["score"].max())
        p = np.zeros(high - low + 1)
        np.add.at(p, part["score"].to_numpy() - low, part["n"].to_numpy() / part["n"].sum())
        return pd.DataFrame({"type": [part["type"].iloc[0]], "low": [low], "p": [p]})

    def convolve(part: pd.DataFrame) -> pd.DataFrame:
        low, p = 0, np.ones(1)
        for r in part.sort_values("p", key=lambda x: x.map(len)).itertuples():
            low, p = low + int(r.low), np.convolve(p, np.asarray(r.p))
            # far ends whose probability adds nothing to any q are cut off, so laws grow with the spread of G, not its range
            kept = np.flatnonzero(p > NEGLIGIBLE)
            low, p = low + int(kept[0]), p[kept[0] : kept[-1] + 1]
        return pd.DataFrame({"type": [part["type"].iloc[0]], "low": [low], "p": [p]})

    laws = cut(hist.groupBy("type", "sample").applyInPandas(first, "type string, low bigint, p array<double>").withColumn("id", F.monotonically_increasing_id()))
    count = laws.groupBy("type").count().agg(F.max("count")).first()[0] or 0
    while count > 1:
        groups = -(-count // FAN_IN)
        laws = cut(laws.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups))).groupBy("type", "g").applyInPandas(
            convolve, "type string, low bigint, p array<double>").withColumn("id", F.monotonically_increasing_id()))
        count = laws.groupBy("type").count().agg(F.max("count")).first()[0]

    def tail(batches):
        for b in batches:
            for r in b.itertuples():
                t = np.cumsum(np.asarray(r.p)[::-1])[::-1]
                with np.errstate(divide="ignore"):
                    yield pd.DataFrame({"type": r.type, "g": np.arange(len(t)) + int(r.low), "log_p": np.log(np.minimum(t, 1.0))})

    return laws.select("type", "low", "p").mapInPandas(tail, "type string, g bigint, log_p double")


def q_values(scores: DataFrame, null: DataFrame) -> DataFrame:
    """Per type and score: p, rank (markers at or above), q = p m / rank made monotone along ascending scores, at most 1."""
    counts = scores.groupBy("type", "g").agg(F.count(F.lit(1)).alias("n"))
    # below all that a law can give p is 1, beyond it 0
    least = null.groupBy("type").agg(F.min("g").alias("__least"))
    joined = counts.join(null, ["type", "g"], "left").join(F.broadcast(least), "type", "left")
    joined = joined.withColumn("p", F.coalesce(F.exp("log_p"), F.when(F.col("g") < F.col("__least"), 1.0), F.lit(0.0)))
    return monotone_q(joined)


def monotone_q(counts: DataFrame) -> DataFrame:
    """q-values from (type, g, n, p): a table of distinct scores, so windows over a type are small."""
    over = Window.partitionBy("type")
    rows = counts.withColumn("rank", F.sum("n").over(over.orderBy(F.desc("g")))).withColumn("m", F.sum("n").over(over))
    q = F.col("p") * F.col("m") / F.col("rank")
    return rows.select("type", "g", "n", "p", "rank", F.least(F.min(q).over(over.orderBy("g")), F.lit(1.0)).alias("q"))


def significance_threshold(q: DataFrame, below: float = Q) -> DataFrame:
    """The smallest score of each type whose q is below the threshold."""
    return q.where(F.col("q") < below).groupBy("type").agg(F.min("g").alias("g_sig"))


def floor_q(scores: DataFrame, q: DataFrame) -> DataFrame:
    """Each marker's q: that of the greatest tabulated score at or below its own, 1 without one. Looked up once per distinct score."""
    from ..plans.intervals import asof_floor

    own = scores.select("type", "g").where("type IS NOT NULL AND g IS NOT NULL").distinct()
    found = cut(asof_floor(own, q.select("type", "g", "q"), ["type"], "g", "q", "q", F.lit(1.0), block=1_000_000))
    return sized_join(scores.drop("q"), found, ["type", "g"]).withColumn("q", F.coalesce("q", F.lit(1.0)))


def region_strength(markers: DataFrame, regions: DataFrame, type_: str = "AMP", biolearn: bool = False) -> DataFrame:
    """Per region and sample: 2 when more than half of its markers are strong, 0 when at least half have none, else 1; and the mean value."""
    from ..plans.intervals import points_in_intervals

    s = strength()[("AMP", "DEL", "LOH").index(type_)]
    rows = points_in_intervals(markers.select("chrom", "pos", "sample", "value", s.alias("s")), regions.select("region", "chrom", "start", "end"), ["chrom"], "pos", "start", "end")
    by = rows.groupBy("region", "sample").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") == 2).alias("strong"), F.count_if(F.col("s") == 0).alias("none"), F.avg("value").alias("mean"))
    half = F.col("n") / 2 if biolearn else (F.col("n") + 1) / 2
    return by.select("region", "sample", F.when(F.col("strong") > F.col("n") / 2, 2).when(F.col("none") >= half, 0).otherwise(1).alias("strength"), "mean")


def gene_calls(markers: DataFrame, genes: DataFrame) -> DataFrame:
    """Per gene and sample the smallest marker value and its call N, A or D; genes normal in all samples are left out."""
    from ..plans.intervals import points_in_intervals

    rows = points_in_intervals(markers.select("chrom", "pos", "sample", "value"), genes.select("gene", "chrom", "start", "end"), ["chrom"], "pos", "start", "end")
    by = rows.groupBy("gene", "sample").agg(F.min("value").alias("value"))
    by = by.withColumn("call", F.when(F.col("value") > GAIN, "A").when(F.col("value") < LOSS, "D").otherwise("N"))
    return by.join(by.where("call <> 'N'").select("gene").distinct(), "gene", "left_semi")


def runs_of_equal_g(scores: DataFrame) -> DataFrame:
    """Consecutive markers of equal score: type, chrom, g, start, end, n."""
    from ..plans.intervals import collapse_islands

    return collapse_islands(scores, ["type", "chrom"], "pos", ["g"])


def score_track(runs: DataFrame, q: DataFrame, compat_last: bool = False) -> DataFrame:
    """Runs with -log10 of their q for a browser."""
    return floor_q(runs, q).withColumn("track", -F.log10(F.greatest("q", F.lit(1e-300))))


class PeakFinder:
    """Peaks of one chromosome: take the run at the smallest q, widen it leaving samples out in turn, peel its samples off, repeat.

    Scores are runs of equal contributions (sample, first and last marker, score), never a matrix of samples by markers.
    """

    def __init__(self, g: np.ndarray, runs: pd.DataFrame, grid: np.ndarray, grid_q: np.ndarray, threshold: float = Q,
                 arms: np.ndarray | None = None, limit: int | None = None) -> None:
        self.g, self.left, self.grid, self.grid_q, self.threshold = g, g.copy(), grid, grid_q, threshold
        self.arms, self.limit = arms, limit
        self.q = self.lookup(g)
        significant = grid[grid_q < threshold]
        self.g_sig = int(significant.min()) if len(significant) else None
        self.runs: dict[str, list[tuple[int, int, int]]] = {}
        for sample, low, high, score in runs[["sample", "low", "high", "score"]].sort_values(["sample", "low"]).itertuples(index=False):
            self.runs.setdefault(sample, []).append((int(low), int(high), int(score)))

    def lookup(self, g: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grid, g, side="right") - 1
        return np.where(at >= 0, self.grid_q[np.maximum(at, 0)], 1.0) if len(self.grid) else np.ones(len(g))

    def own(self, sample: str, low: int, high: int) -> np.ndarray:
        """What a sample still contributes to markers low..high."""
        out = np.zeros(high - low + 1, np.int64)
        for a, b, score in self.runs[sample]:
            if a <= high and b >= low:
                out[max(a, low) - low : min(b, high) - low + 1] += score
        return out

    def reach(self, sample: str, at: int, step: int, top: int) -> int:
        """How far from ``at`` the score without the sample stays at ``top`` or above, marker by marker."""
        while 0 <= at + step < len(self.left):
            ahead = min(256, len(self.left) - 1 - at if step > 0 else at)
            low, high = (at + 1, at + ahead) if step > 0 else (at - ahead, at - 1)
            good = self.left[low : high + 1] - self.own(sample, low, high) >= top
            n = int(np.argmin(good if step > 0 else good[::-1])) if not good.all() else ahead
            at += step * n
            if n < ahead:
                break
        return at

    def budget(self, at: int, step: int) -> int:
        """The last marker that may be peeled: where nothing of the peak's samples remains, or what others add reaches the limit.
        A sample that pauses for fewer than ``LOOK_AHEAD`` markers still remains."""
        samples, n = list(self.runs), len(self.left)
        remain = np.array([self.own(x, at, at)[0] for x in samples], np.int64)
        while 0 <= at + step < n:
            ahead = min(256, n - 1 - at if step > 0 else at)
            far = min(ahead + LOOK_AHEAD, n - 1 - at if step > 0 else at)
            low, high = (at + 1, at + far) if step > 0 else (at - far, at - 1)
            block = np.array([self.own(x, low, high) for x in samples], np.int64).reshape(len(samples), -1)
            block = block if step > 0 else block[:, ::-1]
            for j in range(ahead):
                here = block[:, j]
                near = block[:, j : j + LOOK_AHEAD + (step < 0)].max(1)
                here = np.where(here < remain, np.minimum(near, remain), here)
                added, remain = np.maximum(here - remain, 0).sum(), np.minimum(here, remain)
                at += step
                if remain.sum() == 0 or added >= self.limit:
                    return at
        return at

    def peel(self, sample: str, low: int, high: int) -> None:
        """Takes a sample's contributions off markers low..high."""
        kept = []
        for a, b, score in self.runs[sample]:
            x, y = max(a, low), min(b, high)
            if x > y:
                kept.append((a, b, score))
                continue
            self.left[x : y + 1] -= score
            if a < x:
                kept.append((a, x - 1, score))
            if y < b:
                kept.append((y + 1, b, score))
        self.runs[sample] = kept

    def stretches(self, sample: str) -> list[tuple[int, int]]:
        """Where a sample contributes without a gap."""
        out: list[list[int]] = []
        for a, b, _ in self.runs[sample]:
            if out and out[-1][1] == a - 1:
                out[-1][1] = b
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def focal_span(self, low: int, high: int) -> tuple[int, int, int]:
        """A peak's score, and the markers around it that score above that less the significance threshold."""
        top = int(self.g[low : high + 1].max())
        if self.g_sig is None:
            return top, low, high
        while low > 0 and self.g[low - 1] > top - self.g_sig:
            low -= 1
        while high + 1 < len(self.g) and self.g[high + 1] > top - self.g_sig:
            high += 1
        return top, low, high

    def run(self) -> list[tuple[int, int, int, int, float, int, int, int, int]]:
        """(region first, last, peak first, last, q, samples peeled, peak's score, its span's first, last) in order of finding."""
        n, out = len(self.left), []
        while n:
            q = self.lookup(self.left)
            best = q.min()
            if not best < self.threshold:
                break
            low = int(np.argmax(q <= best))
            high = low
            while high + 1 < n and q[high + 1] <= best:
                high += 1
            for sample in [x for x, runs in self.runs.items() if any(a <= high and b >= low for a, b, _ in runs)]:
                top = int((self.left[low : high + 1] - self.own(sample, low, high)).max())
                if top > 0:  # a peak of a single sample stays as narrow as it is
                    low, high = self.reach(sample, low, -1, top), self.reach(sample, high, 1, top)
            a, b = low, high
            while a > 0 and self.q[a - 1] < self.threshold:
                a -= 1
            while b + 1 < n and self.q[b + 1] < self.threshold:
                b += 1
            bounds = (self.budget(low, -1), self.budget(high, 1)) if self.limit is not None else (0, n - 1)
            count = 0
            for sample in list(self.runs):
                own = [(x, y) for x, y in self.stretches(sample) if x <= high and y >= low]
                count += bool(own)
                for x, y in own:
                    if self.arms is not None:  # the sample's aberrations on the peak's whole arm
                        arm_ = np.flatnonzero(np.isin(self.arms, self.arms[max(x, low) : min(y, high) + 1]))
                        x, y = int(arm_[0]), int(arm_[-1])
                    self.peel(sample, max(x, bounds[0]), min(y, bounds[1]))
            if not count:
                break
            out.append((a, b, low, high, float(best), count, *self.focal_span(low, high)))
        return out


def find_peaks(parts: DataFrame, q: DataFrame, threshold: float = Q, peel: str = "stretch", limit: dict[str, int] | None = None) -> DataFrame:
    """Significant regions and peaks per type and chromosome, with the peak's score and the span around it that decides whether it is focal.

    ``peel``: what a peak takes from its samples, the contiguous ``stretch`` around it, that within the ``limited`` reach
    (``limit``: score that others may add per type, by default the significance threshold), or all of its ``arm``. A
    task gets a chromosome's scores and its samples' runs of equal contributions; the table of q by score is reduced to its steps.
    """
    from ..plans.intervals import ordered_islands

    if peel not in ("stretch", "limited", "arm"):
        raise ValueError("peel is stretch, limited or arm")
    steps = q.groupBy("type", "q").agg(F.min("g").alias("g")).select("type", "g", "q")  # q falls with g, so equal q are neighbours
    rows = steps.limit(1_000_001).toPandas()
    if len(rows) > 1_000_000:
        raise ValueError("more distinct scores than samples times bins allow")
    table = {t: d.sort_values("g")[["g", "q"]].to_numpy() for t, d in rows.groupby("type")}
    schema = ("type string, chrom int, region_start bigint, region_end bigint, peak_start bigint, peak_end bigint, q double, n_samples int, "
              "place int, peak_g bigint, span_start bigint, span_end bigint")
    names = [c.split()[0] for c in schema.split(", ")]
    own = parts.groupBy("type", "chrom", "sample", "pos").agg(F.sum("score").alias("score"))
    scores = own.groupBy("type", "chrom", "pos").agg(F.sum("score").alias("g"))
    runs = ordered_islands(own, ["type", "chrom", "sample"], "pos", ["score"]).where("score <> 0").groupBy(
        "type", "chrom", "sample", "island", "score").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))

    def run(g: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame(columns=names)
        g = g.sort_values("pos")
        type_, chrom, pos = g["type"].iloc[0], int(g["chrom"].iloc[0]), g["pos"].to_numpy()
        known = table.get(type_, np.zeros((0, 2)))
        arms = pos >= SHORT_ARMS[chrom - 1] if peel == "arm" else None
        finder = PeakFinder(g["g"].to_numpy(np.int64), r.assign(low=np.searchsorted(pos, r["start"]), high=np.searchsorted(pos, r["end"])),
                            known[:, 0], known[:, 1], threshold, arms)
        if peel == "limited":
            finder.limit = (limit or {}).get(type_, finder.g_sig or 0)
        rows = [(type_, chrom, *(int(pos[x]) for x in (a, b, s, e)), v, n, i, top, int(pos[x]), int(pos[y]))
                for i, (a, b, s, e, v, n, top, x, y) in enumerate(finder.run())]
        return pd.DataFrame(rows, columns=names)

    # both sides come from one table: new names keep their columns apart
    scores = scores.select(F.col("type").alias("type"), F.col("chrom").alias("chrom"), "pos", "g")
    runs = runs.select(F.col("type").alias("type"), F.col("chrom").alias("chrom"), "sample", "start", "end", "score")
    return scores.groupBy("type", "chrom").cogroup(runs.groupBy("type", "chrom")).applyInPandas(run, schema)


def best_region_per_gene(overlaps: DataFrame) -> DataFrame:
    """One region per gene: overlapping before near, higher class, peak, then larger and closer."""
    over = Window.partitionBy("gene").orderBy(F.desc("overlap"), F.desc("class"), F.desc("is_peak"), F.desc("size"), "distance", "region")
    return overlaps.withColumn("__r", F.row_number().over(over)).where("__r = 1").drop("__r")


def segments_to_markers(segments: DataFrame, markers: DataFrame) -> DataFrame:
    """Values of segments (sample, chrom, start, end, value) at markers (marker, chrom, pos); gaps between segments are split at their middle."""
    from ..plans.intervals import fill_midpoints, points_in_intervals

    filled = fill_midpoints(segments, ["sample", "chrom"], "start", "end").select("sample", "chrom", "fill_start", "fill_end", "value")
    return points_in_intervals(markers.select("marker", "chrom", "pos"), filled, ["chrom"], "pos", "fill_start", "fill_end").select("sample", "marker", "chrom", "pos", "value")


def markers_to_segments(markers: DataFrame) -> DataFrame:
    """Runs of equal values per sample: sample, chrom, value, start, end, n."""
    from ..plans.intervals import collapse_islands

    return collapse_islands(markers, ["sample", "chrom"], "pos", ["value"])


def copy_numbers_to_markers(calls: DataFrame, markers: DataFrame) -> DataFrame:
    """Copy numbers of segments (sample, chrom, start, end, cn) as marker values cn - 2; markers at 2 in every sample are left out."""
    from ..plans.intervals import points_in_intervals

    rows = points_in_intervals(markers.select("marker", "chrom", "pos"), calls.select("sample", "chrom", "start", "end", (F.col("cn") - 2).alias("value")), ["chrom"], "pos", "start", "end")
    rows = rows.select("sample", "marker", "chrom", "pos", "value")
    return rows.join(rows.where("value <> 0").select("marker").distinct(), "marker", "left_semi")


def gene_scores(scores: DataFrame, genes: DataFrame, q: DataFrame) -> DataFrame:
    """Per gene (gene, chrom, start, end) and type the rounded mean score of its closest markers and the q of that score."""
    from ..plans.intervals import markers_of_intervals

    probes = scores.select("chrom", "pos").distinct()
    closest = markers_of_intervals(genes.select("gene", "chrom", "start", "end"), probes, ["chrom"], "start", "end", "pos")
    by = closest.join(scores.select("chrom", "pos", "type", "g"), ["chrom", "pos"]).groupBy("gene", "chrom", "start", "end", "type").agg(
        F.floor(F.avg("g") + 0.5).cast("bigint").alias("g"))
    return floor_q(by, q)


def impute_scores(markers: DataFrame, scored: DataFrame) -> DataFrame:
    """Scores of unscored markers (chrom, pos) from the scored ones (chrom, pos, g) on either side, weighted by nearness; on a chromosome's ends the only neighbour's."""
    from ..plans.intervals import asof_floor

    s = scored.select("chrom", F.col("pos").cast("bigint").alias("pos"), F.struct(F.col("pos").alias("p"), "g").alias("s"))
    m = markers.select("chrom", F.col("pos").cast("bigint").alias("pos"))
    low = asof_floor(m, s, ["chrom"], "pos", "s", "b")
    flip = lambda d: d.withColumn("pos", -F.col("pos"))
    both = flip(asof_floor(flip(low), flip(s), ["chrom"], "pos", "s", "a"))
    d1, d2 = F.col("pos") - F.col("b.p"), F.col("a.p") - F.col("pos")
    mixed = F.when(d1 + d2 == 0, (F.col("b.g") + F.col("a.g")) / 2).otherwise((d2 * F.col("b.g") + d1 * F.col("a.g")) / (d1 + d2))
    return both.select("chrom", "pos", F.when(F.col("b").isNull(), F.col("a.g")).when(F.col("a").isNull(), F.col("b.g")).otherwise(F.floor(mixed)).cast("bigint").alias("g"))


def classify_peaks(peaks: DataFrame, arms: DataFrame, g_sig: DataFrame) -> DataFrame:
    """``is_broad``: the region is at least its arm's threshold long (chrom, arm, broad_length); ``is_focal``: a broad region's
    peak scores above twice the significance threshold (type, g_sig), and the span around it that stays above the peak's
    score less the threshold is shorter than the arm's threshold."""
    rows = peaks.withColumn("arm", arm(F.col("chrom"), F.col("peak_start"))).join(arms, ["chrom", "arm"], "left").join(g_sig, "type", "left")
    broad = F.coalesce(F.col("region_end") - F.col("region_start") + 1 >= F.col("broad_length"), F.lit(False))
    focal = (F.col("peak_g") > 2 * F.col("g_sig")) & (F.col("span_end") - F.col("span_start") < F.col("broad_length"))
    return rows.withColumn("is_broad", broad).withColumn("is_focal", broad & F.coalesce(focal, F.lit(False))).drop("broad_length", "g_sig")


def require_several_samples(parts: DataFrame) -> DataFrame:
    """Raises when a type has aberrations in one sample only: its null distribution would be that sample's own."""
    lone = parts.where("score <> 0").groupBy("type").agg(F.count_distinct("sample").alias("n")).where("n = 1").collect()
    if lone:
        raise ValueError(f"aberrations of a single sample: {sorted(r['type'] for r in lone)}")
    return parts
