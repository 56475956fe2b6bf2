"""Simulated cohorts with known truth; every random draw is seeded by what it belongs to, so reruns agree."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.genomics import CHROM_LENGTHS
from ..functions.stats import half_binomial_tails, log_factorials

#: Copies of either haplotype per event.
HAPLOTYPES = {"HETGermline": (1, 1), "LOH": (0, 1), "cnLOH": (0, 2), "GainSomatic": (1, 2), "GainGermline": (1, 2), "DELHom": (0, 0)}


def place_regions(sample: str, n: int = 5, mean_length: float = 8e7, seed: int = 7, chroms: range = range(1, 23)) -> list[tuple[int, int, int, str]]:
    """(chrom, start, end, event) of regions with exponential lengths that don't overlap; five tries a chromosome."""
    rng = np.random.default_rng([seed, zlib.crc32(sample.encode())])
    events, out = ("LOH", "cnLOH", "GainSomatic", "DELHom"), []
    for k in range(n):
        for _ in range(5):
            chrom = int(rng.choice(list(chroms)))
            size = CHROM_LENGTHS[chrom - 1]
            length = int(min(rng.exponential(mean_length), size - 1)) + 1
            start = int(rng.integers(1, size - length + 2))
            if all(c != chrom or start + length - 1 < s or e < start for c, s, e, _ in out):
                out.append((chrom, start, start + length - 1, events[k % len(events)]))
                break
    return out


def reads(rng: np.random.Generator, coverage: float, copies: tuple[int, int], purity: float, floor: int = 0) -> tuple[int, int]:
    """Reference and variant reads of a heterozygous site: Poisson per haplotype at the copies the purity mixes, redrawn below ``floor``.

    A floor far above what the rates give is an error, not a pair below it.
    """
    rates = [coverage / 2 * (purity * c + (1 - purity)) for c in copies]
    for _ in range(1000):
        a, b = rng.poisson(rates)
        if a + b >= floor:
            return int(a), int(b)
    raise ValueError(f"reads of rates {rates} don't reach {floor}")


def simulate_cohort(spark: SparkSession, samples: list[str], sites_per_chrom: int | dict[str, int] = 200, coverage: float = 100.0, purity_t: float = 0.7,
                    purity_n: float = 0.0, germline_gain: bool = True, seed: int = 7, adjust: Callable | None = None) -> DataFrame:
    """Sites of simulated samples: coverages, variant reads and ``truth``. One task per sample and chromosome; ``adjust`` may alter reads.

    ``sites_per_chrom`` is one number or one per sample.
    """
    sizes = sites_per_chrom if isinstance(sites_per_chrom, dict) else dict.fromkeys(samples, sites_per_chrom)
    grid = spark.createDataFrame([(s, c, sizes[s]) for s in samples for c in range(1, 23)], "sample string, chrom int, n int").repartition("sample", "chrom")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sample, chrom, n_sites in zip(b["sample"], b["chrom"], b["n"]):
                regions = place_regions(sample, seed=seed)
                rng = np.random.default_rng([seed, zlib.crc32(sample.encode()), int(chrom)])
                gained = germline_gain and zlib.crc32(sample.encode()) % 22 + 1 == chrom
                rows = []
                for pos in np.unique(rng.integers(1, CHROM_LENGTHS[chrom - 1], n_sites)).tolist():
                    event = next((e for c, s, t, e in regions if c == chrom and s <= pos <= t), "HETGermline")
                    event = "GainGermline" if gained else event
                    flip = rng.random() < 0.5
                    copies = HAPLOTYPES[event][:: -1 if flip else 1]
                    normal = copies if event == "GainGermline" else (1, 1)
                    t = reads(rng, coverage, copies, 1.0 if event == "GainGermline" else purity_t)
                    n = reads(rng, coverage, normal, 1.0 if event == "GainGermline" else purity_n, 15)
                    if adjust is not None:
                        t, n = adjust(t), adjust(n)
                    rows.append((sample, chrom, pos, sum(n), n[1], sum(t), t[1], event))
                yield pd.DataFrame(rows, columns=["sample", "chrom", "pos", "cov_n", "var_n", "cov_t", "var_t", "truth"])

    return grid.mapInPandas(run, "sample string, chrom int, pos int, cov_n int, var_n int, cov_t int, var_t int, truth string")


def tumor_only(sites: DataFrame, coverage: float = 100.0, seed: int = 7) -> DataFrame:
    """A matched normal for samples without one: balanced reads where the tumor shows both alleles, else the tumor's own genotype."""
    most = int(coverage + 12 * coverage**0.5 + 20)
    log = log_factorials(most)
    counts = np.cumsum(np.exp(np.arange(most + 1) * np.log(coverage) - coverage - log))

    def uniform(key: np.ndarray, salt: int) -> np.ndarray:
        """A number between 0 and 1 per site, the same wherever the site lies (a mixing hash of its key)."""
        x = key.astype(np.uint64) + np.uint64((seed * 2 + salt) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53

    @F.pandas_udf("cov int, var int")
    def draw(key: pd.Series, var: pd.Series, cov: pd.Series) -> pd.DataFrame:
        key, var, cov = key.to_numpy(np.int64), var.to_numpy(float), cov.to_numpy(float)
        with np.errstate(over="ignore"):
            one, two = uniform(key, 0), uniform(key, 1)
        total = np.maximum(15, np.minimum(np.searchsorted(counts, one), most))
        none = ~(cov > 0) | ~(var > 0.1 * cov)
        out = np.where(none, 0, total)  # homozygous sites keep the tumor's genotype
        het = ~none & (var <= 0.9 * cov)
        for n in np.unique(total[het]):
            rows = het & (total == n)
            at_most = 1 - np.r_[half_binomial_tails(int(n), log)[1:], 0.0]
            out[rows] = np.searchsorted(at_most, two[rows])
        return pd.DataFrame({"cov": total.astype("int32"), "var": np.minimum(out, total).astype("int32")})

    key = F.xxhash64("sample", "chrom", "pos")
    return sites.withColumn("__n", draw(key, F.col("var_t"), F.col("cov_t"))).withColumns({"cov_n": F.col("__n.cov"), "var_n": F.col("__n.var")}).drop("__n")


def germline_only(sites: DataFrame) -> DataFrame:
    """The normal tissue in the tumor's place."""
    return sites.withColumns({"cov_t": F.col("cov_n"), "var_t": F.col("var_n")})


def contaminate_normal(sites: DataFrame, share: float) -> DataFrame:
    """Tumor reads mixed into the normal tissue at a share."""
    return sites.withColumns({
        "cov_n": F.floor(F.col("cov_n") * (1 - share) + F.col("cov_t") * share + 0.5).cast("int"),
        "var_n": F.floor(F.col("var_n") * (1 - share) + F.col("var_t") * share + 0.5).cast("int")})
