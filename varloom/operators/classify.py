"""Classification of sites: corrected fractions, planes, events, clusters of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import genomics as G, stats as S
from ..plans.cut import cut
from ..plans.joins import sized_join
from .copynumber import block_ratios, center_on_median, chrom_coverage, gene_blocks, smooth_blocks
from .qc import in_het_band, with_bias

NEAR = 1 + 1e-9  # equal probabilities computed along two ways


def adjust_vafs(sites: DataFrame, min_samples: int = 2) -> DataFrame:
    """adj_vaf_n and adj_vaf_t: both moved by the position's mean deviation from one half, towards one half, within 0..1.

    Only in the heterozygous band, where the bias table knows the position and the chromosome has no germline gain.
    """
    v_n, v_t = G.vaf(F.col("var_n"), F.col("cov_n")), G.vaf(F.col("var_t"), F.col("cov_t"))
    known = in_het_band() & (F.col("n_samples") >= min_samples) & (F.col("avg_vaf_n") > 0) & ~F.coalesce(F.col("germline_gain"), F.lit(False))
    side = F.signum((2 * F.col("var_n") - F.col("cov_n")).cast("double"))
    offset = F.when(F.coalesce(known, F.lit(False)), -side * F.abs(F.lit(0.5) - F.col("avg_vaf_n"))).otherwise(0.0)
    bound = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return sites.withColumn("adj_vaf_n", bound(v_n + offset)).withColumn("adj_vaf_t", bound(v_t + offset))


@F.pandas_udf(T.DoubleType())
def _imbalance(high: pd.Series, total: pd.Series) -> pd.Series:
    high, total = high.to_numpy(), total.to_numpy()
    out = np.ones(len(total))
    if len(total):
        log = S.log_factorials(max(0, int(total.max())))
        order = np.argsort(total, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(total[order])) + 1):
            n = int(total[rows[0]])
            if n > 0:
                out[rows] = np.where(high[rows] <= 0, 1.0, S.half_binomial_tails(n, log)[np.clip(high[rows], 0, n)])
    return pd.Series(out)


def with_imbalance(sites: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """p_n, p_t and sig_p: one-sided imbalance of both tissues and the coverage's 5 % threshold.

    Each distinct pair of counts is computed once and joined back, whatever the number of sites. ``source``: a table
    with the same counts that is cheaper to read.
    """
    pair = lambda v, n: (F.greatest(F.col(v), F.col(n) - F.col(v)), F.col(n))
    out = sites
    for side in ("n", "t"):
        high, total = pair(f"var_{side}", f"cov_{side}")
        out = out.withColumn(f"__h{side}", high).withColumn(f"__c{side}", total)
    both = F.array(*[F.struct(*[c.alias(n) for c, n in zip(pair(f"var_{s}", f"cov_{s}"), "hc")]) for s in "nt"])
    pairs = (sites if source is None else source).select(F.explode(both).alias("x")).select("x.*")
    pairs = pairs.where("h IS NOT NULL AND c IS NOT NULL AND h <= c").distinct()
    table = cut(pairs.withColumn("p", _imbalance("h", "c")))
    levels = cut(table.select("c").distinct().withColumn("sig_p", S.permutation_threshold_of(F.col("c"))))
    for side in "nt":
        out = sized_join(out, table.select(F.col("h").alias(f"__h{side}"), F.col("c").alias(f"__c{side}"), F.col("p").alias(f"p_{side}")), [f"__h{side}", f"__c{side}"])
    out = sized_join(out, levels.withColumnRenamed("c", "__ct"), ["__ct"])
    return out.drop("__hn", "__cn", "__ht", "__ct")


def plane(germline_gain: str = "germline_gain", cn: str = "cn", leeway: float = 0.2, normal_p: float = 0.01) -> Column:
    """2 for chromosomes gained in the germline, 1 for imbalanced sites, 0 for others; -1 on the diagonal at two copies; null out of the band."""
    imbalanced = (F.col("p_t") <= F.col("sig_p") * NEAR) | (F.col("p_n") <= normal_p)
    diagonal = G.on_diagonal(F.col("adj_vaf_t"), F.col("adj_vaf_n"), leeway) & (G.copy_number_class(F.col(cn)) == "diploid")
    return F.when(in_het_band(), F.when(F.coalesce(F.col(germline_gain), F.lit(False)), 2)
                  .when(F.coalesce(imbalanced, F.lit(False)), F.when(F.coalesce(diagonal, F.lit(False)), -1).otherwise(1)).otherwise(0))


def lower_plane_event(cn: str = "cn") -> Column:
    return F.when(F.col(cn) < 1.1, "DELHom").when(F.col(cn) > 3, "GainSomatic").otherwise("HETGermline")


def upper_plane_event(cn: str = "cn") -> Column:
    kind = G.copy_number_class(F.col(cn))
    return F.when(kind == "amp", "GainSomatic").when(kind == "diploid", "cnLOH").otherwise("LOH")


def out_of_band_event(tumor_only: bool = False) -> Column:
    """Event of a site whose normal tissue is not heterozygous; whole-number comparisons throughout."""
    n, cn_, t, ct = F.col("var_n"), F.col("cov_n"), F.col("var_t"), F.col("cov_t")
    low = 10 * n <= cn_
    third, two_thirds = 10000 * t <= 3333 * ct, 10000 * t > 6667 * ct
    somatic = (20 * n <= cn_) & (10 * t >= ct)
    flat = (20 * n >= 19 * cn_) & (10 * t >= ct) & (10 * t <= 9 * ct)
    return (F.when(F.coalesce(cn_ <= 0, F.lit(True)) | F.coalesce(ct <= 0, F.lit(True)), "Ignored")
            .when(low, F.when(somatic, "Ignored" if tumor_only else "HETSomatic").when(two_thirds & ~third, "LOH").otherwise("Ignored"))
            .otherwise(F.when(flat, "Ignored").when(third, "LOH").otherwise("Ignored")))


def call_events(sites: DataFrame, tumor_only: bool = False) -> DataFrame:
    """``event`` of every site. Needs cn (2 x centred ratio), p_n, p_t, sig_p, adjusted fractions and germline_gain.

    Heterozygous sites of the lower plane re-centre the copy number before the upper plane is called.
    """
    first = sites.withColumn("plane", plane())
    lower = F.when(F.col("plane") == 0, lower_plane_event())
    first = first.withColumn("event", F.coalesce(lower, F.lit(""))).withColumn("ratio", F.col("cn") / 2)
    centred = center_on_median(cut(first), ["sample"], "ratio", F.col("event") == "HETGermline")
    centred = centred.withColumn("cn", 2 * F.col("ratio"))
    diagonal = G.on_diagonal(F.col("adj_vaf_t"), F.col("adj_vaf_n")) & (G.copy_number_class(F.col("cn")) == "diploid")
    event = (F.when(F.col("plane") == 0, F.col("event")).when(F.col("plane") == 2, "GainGermline").when(F.col("plane") == -1, "Ignored")
             .when(F.col("plane") == 1, F.when(F.coalesce(diagonal, F.lit(False)), "Ignored").otherwise(upper_plane_event()))
             .otherwise(out_of_band_event(tumor_only)))
    return centred.withColumn("event", event)


def likelihoods(sites: DataFrame, keys: list[str], x: Column, candidates: list[list[float]], log: bool = False) -> DataFrame:
    """Per group the sum over its sites of the most likely candidate mean's Poisson probability: one column l0, l1, ... per list.

    ``x`` is a whole percentage; means are fractions. ``log`` sums logarithms instead.
    """
    table = S.lnfact(100)

    def best(means: list[float]) -> Column:
        terms = [S.poisson_pmf(table, F.lit(100.0 * m), x) for m in sorted(means)]
        out = terms[-1]
        for a, b in reversed(list(zip(terms, terms[1:]))):
            out = F.when(a >= b, a).otherwise(out)
        return F.ln(F.greatest(out, F.lit(1e-300))) if log else out

    return sites.groupBy(*keys).agg(*[F.sum(best(c)).alias(f"l{i}") for i, c in enumerate(candidates)])


def germline_aneuploidy(sites: DataFrame, coverage: DataFrame, min_ratio: float = 1.4) -> DataFrame:
    """Per sample and chromosome ``germline_gain``: three copies fit the normal fractions better than two, and coverage is raised."""
    x = F.floor(100 * G.vaf(F.col("var_n"), F.col("cov_n")) + 0.5)
    het = sites.where(in_het_band() & ~G.is_homozygous(F.col("var_n"), F.col("cov_n")))
    fit = likelihoods(het, ["sample", "chrom"], x, [[0.5], [1 / 3, 2 / 3]])
    out = coverage.select("sample", "chrom", "rel_n").join(fit, ["sample", "chrom"], "left")
    three = F.coalesce(F.col("l1") > F.col("l0"), F.lit(False))
    return out.select("sample", "chrom", (three & (F.col("rel_n") >= min_ratio)).alias("germline_gain"),
                      (three & (F.col("rel_n") < min_ratio)).alias("contaminated"))


def prepare_sites(sites: DataFrame, bias: DataFrame, smooth: bool = True) -> DataFrame:
    """Cleaned sites with all that events are called from: cn, ratio, adjusted fractions, p-values, germline gain.

    The cleaned sites and their blocks are written once: three aggregates and the calls read them.
    """
    blocks = gene_blocks(sites)
    gains = germline_aneuploidy(blocks, chrom_coverage(blocks)).select("sample", "chrom", "germline_gain")
    ratios = block_ratios(blocks)
    if smooth:
        ratios = smooth_blocks(ratios).withColumn("ratio", F.coalesce("smooth", "ratio"))
    ratios = ratios.select("sample", "chrom", "block", "ratio").join(gains, ["sample", "chrom"], "left")
    rows = blocks.join(ratios, ["sample", "chrom", "block"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    if not smooth:
        rows = center_on_median(rows, ["sample"], "ratio")
    return with_imbalance(adjust_vafs(with_bias(rows.withColumn("cn", 2 * F.col("ratio")), bias)), blocks)


def dbscan(points: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Cluster of each 2-D point, -1 for noise; a point counts itself. Cells of side eps bound the neighbours to look at."""
    cells: dict[tuple[int, int], list[int]] = {}
    keys = np.floor(points / eps).astype(int)
    for i, (a, b) in enumerate(map(tuple, keys)):
        cells.setdefault((a, b), []).append(i)
    boxes = {k: np.array(v) for k, v in cells.items()}

    def around(i: int) -> np.ndarray:
        a, b = keys[i]
        near = [boxes[k] for k in ((a + x, b + y) for x in (-1, 0, 1) for y in (-1, 0, 1)) if k in boxes]
        near = np.concatenate(near)
        return near[((points[near] - points[i]) ** 2).sum(1) <= eps * eps]

    out, cluster = np.full(len(points), -2), -1
    for i in range(len(points)):
        if out[i] != -2:
            continue
        found = around(i)
        if len(found) < min_points:
            out[i] = -1
            continue
        cluster += 1
        out[i] = cluster
        stack = list(found)
        while stack:
            j = stack.pop()
            if out[j] == -1:
                out[j] = cluster
            if out[j] != -2:
                continue
            out[j] = cluster
            more = around(j)
            if len(more) >= min_points:
                stack.extend(more)
    return out


#: Cells of a block's side; cells that a point's reach can pass (a cell's diagonal is eps); most distances held at once.
BLOCK, REACH, PAIRS = 8, 2, 1_000_000
_AROUND = [(a, b) for a in range(-REACH, REACH + 1) for b in range(-REACH, REACH + 1)]


def _by_cell(cx: np.ndarray, cy: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The rows of each cell."""
    order = np.lexsort((cy, cx))
    starts = np.flatnonzero((np.diff(cx[order]) != 0) | (np.diff(cy[order]) != 0)) + 1
    return {(int(cx[i[0]]), int(cy[i[0]])): i for i in np.split(order, starts)} if len(order) else {}


def _facing(p: np.ndarray, i: np.ndarray, j: np.ndarray, eps: float) -> np.ndarray:
    """Those of the rows ``j`` that lie within eps of the box around the rows ``i``."""
    low, high = p[i].min(0) - eps * NEAR, p[i].max(0) + eps * NEAR
    return j[((p[j] >= low) & (p[j] <= high)).all(1)]


def _within(p: np.ndarray, i: np.ndarray, j: np.ndarray, eps: float):
    """Pieces of ``j`` with the matrix of which rows of ``i`` they are within eps of."""
    step = max(1, PAIRS // max(1, len(i)))
    for k in range(0, len(j), step):
        part = j[k:k + step]
        yield part, (p[i, None, 0] - p[None, part, 0]) ** 2 + (p[i, None, 1] - p[None, part, 1]) ** 2 <= eps * eps


def _core_rows(p: np.ndarray, w: np.ndarray, cells: dict, own: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Which of the block's own rows are core: all of a cell that holds enough, else by counting around."""
    core, weight = np.zeros(len(p), bool), {c: int(w[i].sum()) for c, i in cells.items()}
    for (a, b), i in cells.items():
        if not own[i[0]]:
            continue
        if weight[a, b] >= min_points:
            core[i] = True
            continue
        near = [(a + x, b + y) for x, y in _AROUND if (a + x, b + y) in cells]
        if sum(weight[c] for c in near) >= min_points:
            near = _facing(p, i, np.concatenate([cells[c] for c in near]), eps)
            core[i] = sum(hit @ w[part] for part, hit in _within(p, i, near, eps)) >= min_points
    return core


def _touch(p: np.ndarray, i: np.ndarray, j: np.ndarray, eps: float) -> bool:
    """Whether any row of ``i`` is within eps of any of ``j``."""
    j = _facing(p, i, j, eps)
    i = _facing(p, j, i, eps) if len(j) else j
    if not len(i):
        return False
    # those nearest to the other side first: in crowded cells they settle it
    i, j = i[np.argsort(((p[i] - p[j].mean(0)) ** 2).sum(1))], j[np.argsort(((p[j] - p[i].mean(0)) ** 2).sum(1))]
    if any(hit.any() for _, hit in _within(p, i[:64], j[:64], eps)):
        return True
    return any(hit.any() for k in range(0, len(i), 1000) for _, hit in _within(p, i[k:k + 1000], j, eps))


def _contacts(p: np.ndarray, core: np.ndarray, cells: dict, own: np.ndarray, eps: float) -> list[tuple]:
    """(row, cell, cell): pairs of cells whose core rows are connected (row -1), and other rows with each cell that has a core row within reach."""
    cores = {c: k for c, i in cells.items() if len(k := i[core[i]])}
    out = []
    for (a, b), i in cells.items():
        if not own[i[0]]:
            continue
        near = [(a + x, b + y) for x, y in _AROUND if (a + x, b + y) in cores]
        if (a, b) in cores:
            out.append((-1, a, b, a, b))
            out += [(-1, a, b, *c) for c in near if c > (a, b) and _touch(p, cores[a, b], cores[c], eps)]
        others = i[~core[i]]
        if len(others):
            for c in near:
                found = np.zeros(len(others), bool)
                if len(j := _facing(p, others, cores[c], eps)):
                    for _, hit in _within(p, others, j, eps):
                        found |= hit.any(1)
                out += [(int(r), a, b, *c) for r in others[found]]
    return out


def _components(part: pd.DataFrame) -> np.ndarray:
    """The root of each pair of nodes (a, b) under union, as an index into the nodes' rows."""
    codes, _ = pd.factorize(pd.MultiIndex.from_arrays([np.r_[part["cx"], part["ax"]], np.r_[part["cy"], part["ay"]]]))
    n = len(part)
    root = list(range(codes.max() + 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(codes[:n].tolist(), codes[n:].tolist()):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in codes[:n].tolist()])


def dbscan_cells(df: DataFrame, keys: list[str], id_col: str, x: str, y: str, eps: float, min_points: int, lattice: float | None = None) -> DataFrame:
    """The same clusters without gathering a group's points: blocks of cells with what lies around them, clusters as connected cells.

    A cell's diagonal is eps, so that its core points are one cluster, and all are core where it holds ``min_points``.
    Only points of other cells are counted around; cells are connected where two of their core points are within eps.
    What is gathered per group are its cells, which the plane's area bounds. Equal points are one weighted point.
    ``lattice`` moves points to multiples of that step first, which is not DBSCAN's result any more: distances are then
    off by a step.
    ``cluster`` is the smallest core id of the cluster, null for noise; border points take the smallest cluster within reach.
    """
    snap = (lambda c: F.round(F.round(c / lattice) * lattice, 9)) if lattice else (lambda c: c)
    rows = df.select(*keys, F.col(id_col).alias("__id"), snap(F.col(x).cast("double")).alias("__x"), snap(F.col(y).cast("double")).alias("__y"))
    side = eps / (2**0.5 * NEAR)
    known = rows.where("__x IS NOT NULL AND __y IS NOT NULL AND NOT isnan(__x) AND NOT isnan(__y)")
    spots = cut(known.groupBy(*keys, "__x", "__y").agg(F.min("__id").alias("s"), F.count(F.lit(1)).alias("w"))
                .withColumn("cx", F.floor(F.col("__x") / side)).withColumn("cy", F.floor(F.col("__y") / side)))
    typed = ", ".join(f"`{n}` {t}" for n, t in spots.dtypes if n in keys)
    blocks = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / BLOCK) for d in (-REACH, 0, REACH)]))

    def spread(table: DataFrame, *columns: str) -> DataFrame:
        wide = table.select(*keys, "__x", "__y", "cx", "cy", *columns, F.explode(blocks("cx")).alias("__bx"))
        wide = wide.withColumn("__by", F.explode(blocks("cy")))
        return wide.withColumn("own", (F.floor(F.col("cx") / BLOCK) == F.col("__bx")) & (F.floor(F.col("cy") / BLOCK) == F.col("__by")))

    def opened(part: pd.DataFrame) -> tuple:
        return part[["__x", "__y"]].to_numpy(float), _by_cell(part["cx"].to_numpy(), part["cy"].to_numpy()), part["own"].to_numpy(bool)

    def find_cores(part: pd.DataFrame) -> pd.DataFrame:
        p, cells, own = opened(part)
        return part.loc[_core_rows(p, part["w"].to_numpy(), cells, own, eps, min_points), [*keys, "__x", "__y"]]

    def find_contacts(part: pd.DataFrame) -> pd.DataFrame:
        p, cells, own = opened(part)
        found = pd.DataFrame(_contacts(p, part["core"].to_numpy(bool), cells, own, eps), columns=["r", "cx", "cy", "ax", "ay"], dtype="int64")
        r = found["r"].to_numpy()
        at = np.where((r >= 0)[:, None], p[np.maximum(r, 0)], 0.0)
        heads = {k: pd.Series([part[k].iloc[0]] * len(found), dtype=part[k].dtype) for k in keys}
        return pd.DataFrame({**heads, "linked": r < 0, "__x": at[:, 0], "__y": at[:, 1], **{c: found[c] for c in ("cx", "cy", "ax", "ay")}})

    def find_roots(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(root=_components(part))[[*keys, "cx", "cy", "root"]].drop_duplicates()

    block = [*keys, "__bx", "__by"]
    cores = spread(spots, "w").groupBy(*block).applyInPandas(find_cores, f"{typed}, __x double, __y double")
    flagged = cut(spots.join(cores.withColumn("core", F.lit(True)), [*keys, "__x", "__y"], "left").withColumn("core", F.coalesce("core", F.lit(False))))
    contacts = cut(spread(flagged, "core").groupBy(*block).applyInPandas(
        find_contacts, f"{typed}, linked boolean, __x double, __y double, cx bigint, cy bigint, ax bigint, ay bigint"))
    roots = contacts.where("linked").select(*keys, "cx", "cy", "ax", "ay").groupBy(*keys).applyInPandas(find_roots, f"{typed}, cx bigint, cy bigint, root bigint")
    cells = cut(flagged.where("core").groupBy(*keys, "cx", "cy").agg(F.min("s").alias("s")).join(roots, [*keys, "cx", "cy"]))
    named = cells.groupBy(*keys, "root").agg(F.min("s").alias("cluster"))
    cells = cells.join(named, [*keys, "root"]).select(*keys, "cx", "cy", "cluster")
    border = contacts.where("NOT linked").select(*keys, "__x", "__y", F.col("ax").alias("cx"), F.col("ay").alias("cy")).join(cells, [*keys, "cx", "cy"])
    own = flagged.where("core").join(cells, [*keys, "cx", "cy"]).select(*keys, "__x", "__y", "cluster").union(
        border.groupBy(*keys, "__x", "__y").agg(F.min("cluster").alias("cluster")).select(*keys, "__x", "__y", "cluster"))
    return rows.join(own, [*keys, "__x", "__y"], "left").select(*keys, F.col("__id").alias(id_col), "cluster")


def kmeans_lloyd(points: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Cluster of each point: centres evenly spaced over the ranges, points dealt in turn, then Lloyd's rounds."""
    low, high = points.min(0), points.max(0)
    centres = np.array([low + (high - low) * (i + 1) / (k + 1) for i in range(k)])
    labels = np.arange(len(points)) % k
    for _ in range(rounds):
        new = ((points[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        if (new == labels).all():
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                centres[j] = points[labels == j].mean(0)
    return labels


def central_cluster(clusters: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per group the cluster of the point nearest to the middle of all points' range."""
    middle = clusters.groupBy(*keys).agg(((F.min(x) + F.max(x)) / 2).alias("__mx"), ((F.min(y) + F.max(y)) / 2).alias("__my"))
    d = (F.col(x) - F.col("__mx")) ** 2 + (F.col(y) - F.col("__my")) ** 2
    return clusters.join(middle, keys).groupBy(*keys).agg(F.min_by("cluster", F.struct(d.alias("d"), "cluster")).alias("cluster"))


def largest_cluster(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the cluster of most points, noise aside; ties to the smallest."""
    counts = clusters.where("cluster IS NOT NULL").groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("cluster"), F.max("n").alias("n"))


def within_min_radius(clusters: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``inside``: the point lies within the smaller of its cluster's two radii around the cluster's centre; null for noise."""
    both = [*keys, "cluster"]
    centre = clusters.where("cluster IS NOT NULL").groupBy(*both).agg(F.avg(x).alias("__cx"), F.avg(y).alias("__cy"))
    rows = clusters.join(centre, both, "left")
    radius = rows.where("cluster IS NOT NULL").groupBy(*both).agg(
        F.least(F.max(F.abs(F.col(x) - F.col("__cx"))), F.max(F.abs(F.col(y) - F.col("__cy")))).alias("__r"))
    d = (F.col(x) - F.col("__cx")) ** 2 + (F.col(y) - F.col("__cy")) ** 2
    return rows.join(radius, both, "left").withColumn("inside", d <= F.col("__r") * F.col("__r")).drop("__cx", "__cy", "__r")


def purity_estimate(sites: DataFrame) -> DataFrame:
    """Per sample the tumor's share from its LOH and copy-neutral sites: the mean of the fractions' larger side, each solved for purity."""
    v = G.vaf(F.col("var_t"), F.col("cov_t"))
    big = F.greatest(v, 1 - v)
    own = sites.where(F.col("event").isin("LOH", "cnLOH") & in_het_band())
    m = own.groupBy("sample", "event").agg(F.avg(big).alias("v"), F.count(F.lit(1)).alias("n"))
    return m.select("sample", "event", "n", F.when(F.col("event") == "cnLOH", G.purity_from_vaf(F.col("v"), True)).otherwise(G.purity_from_vaf(F.col("v"), False)).alias("purity"))
