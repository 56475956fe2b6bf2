"""Cleaning of sites: canonical rows, filters, duplicate removal, density windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import genomics as G
from ..plans.intervals import anchor_groups

#: Bases of a density block in ``fixed`` mode; windows reach at most one block to either side.
DENSITY_BLOCK = 5_000_000


def canonical_sites(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Loaded rows as typed sites: sample, chrom (code), pos, coverages, fractions, gene, mutation type, identifier.

    Rows without a sample, on no chromosome of 1..22 and X, or without a position are left out.
    """
    out = raw.select(
        F.col("sample_id").alias("sample"), G.chrom_code(F.col("refname")).alias("chrom"), F.col("coordinate").alias("pos"),
        F.col("line_no"), F.col("site_id"), G.nucleotide(F.col("refbase")).alias("ref"), G.nucleotide(F.col("varbase")).alias("alt"),
        F.col("q20_totcov_n").alias("cov_n"), F.col("q20_totcov_t").alias("cov_t"), F.col("q20_varcov_n").alias("var_n"),
        F.col("q20_varcov_t").alias("var_t"), F.col("refenv_t").alias("flank"), F.col("dbsnp"),
        G.mutation_type(F.col("mutationtype")).alias("mutation"), F.coalesce(G.gene_name(F.col("hugo_symbol")), F.lit(".")).alias("gene"),
        *[F.col(c) for c in keep])
    return out.where(F.col("sample").isNotNull() & F.col("chrom").between(1, 23) & F.col("pos").isNotNull())


def drop_headers(df: DataFrame, line: str) -> DataFrame:
    """Raw lines without headers inside the file and without chrY and chrM."""
    x = F.col(line)
    return df.where(~((x.contains("refName") & x.contains("coord")) | x.contains("chrY") | x.contains("chrM")))


def first_of_position(sites: DataFrame, keys: tuple[str, ...] = ("sample", "chrom", "pos"), order: tuple[str, ...] = ("line_no", "site_id")) -> DataFrame:
    """The first line of each position, in the file's order."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return sites.withColumn("__rn", F.row_number().over(over)).where("__rn = 1").drop("__rn")


def min_reads(sites: DataFrame, normal: int = 15, tumor: int = 0, tumor_only: bool = False) -> DataFrame:
    keep = F.col("cov_t") >= tumor
    return sites.where(keep if tumor_only else keep & (F.col("cov_n") >= normal))


def extreme_gc(sites: DataFrame, flank: str = "flank", low: float = 0.05, high: float = 0.80, drop_low: bool = True, compat: bool = False) -> DataFrame:
    """Without sites whose flank has an extreme GC fraction. ``compat``: the high side is dropped even when the filter is off."""
    gc = F.coalesce(G.gc_fraction(F.col(flank)), F.lit(-1.0))
    bad = (gc >= 0) & (gc < low)
    if compat:
        return sites.where(~((gc >= 0) & ((F.lit(drop_low) & (gc < low)) | (gc >= high))))
    return sites.where(~(bad | (gc >= high))) if drop_low else sites


def in_het_band(var: str = "var_n", total: str = "cov_n", low: int = 10, high: int = 90) -> Column:
    """low % < var / total <= high %, in whole numbers so that no rounding decides."""
    return (100 * F.col(var) > low * F.col(total)) & (100 * F.col(var) <= high * F.col(total)) & (F.col(total) > 0)


def with_bias(sites: DataFrame, bias: DataFrame) -> DataFrame:
    """Sites with n_samples, avg_vaf_n, avg_abs_cn of their position (null without)."""
    table = bias.select(F.col("chrom"), F.col("pos"), "n_samples", "avg_vaf_n", "avg_abs_cn")
    return sites.join(table, ["chrom", "pos"], "left")


def bias_filter(sites: DataFrame, min_samples: int = 2, max_cn: float = 4.0, max_vaf: float = 0.33) -> DataFrame:
    """Without positions of high germline copy number or aberrant germline fraction over the samples."""
    enough = F.col("n_samples") >= min_samples
    bad = enough & ((F.col("avg_abs_cn") >= max_cn) | F.col("avg_vaf_n").between(0.0, max_vaf))
    return sites.where(~F.coalesce(bad, F.lit(False)))


def dense_sites(sites: DataFrame, keys: tuple[str, ...] = ("sample", "chrom"), pos: str = "pos", counted: Column | None = None,
                window: int = 1000, most: int = 3) -> DataFrame:
    """Without counted sites that have more than ``most`` counted sites within ``window`` bases around them.

    A range frame over blocks of the position; the frame's margin is repeated into the neighbouring block.
    """
    flag = F.lit(True) if counted is None else counted
    rows = sites.withColumn("__c", F.coalesce(flag, F.lit(False)).cast("int")).withColumn("__own", F.floor(F.col(pos) / DENSITY_BLOCK))
    margins = F.array_distinct(F.array(*[F.floor((F.col(pos) + d) / DENSITY_BLOCK) for d in (-window, 0, window)]))
    rows = rows.withColumn("__blk", F.explode(margins))
    over = Window.partitionBy(*keys, "__blk").orderBy(F.col(pos).cast("bigint")).rangeBetween(-(window - 1), window - 1)
    rows = rows.withColumn("__n", F.sum("__c").over(over)).where("__blk = __own")
    return rows.where(~((F.col("__c") == 1) & (F.col("__n") > most))).drop("__c", "__own", "__blk", "__n")


def anchored_density(sites: DataFrame, counted: str, keys: tuple[str, ...] = ("sample", "chrom"), pos: str = "pos",
                     order: tuple[str, ...] = ("pos", "line_no"), window: int = 1000, most: int = 3, compat: bool = False) -> DataFrame:
    """Greedy windows: one opens at a site and takes what lies less than ``window`` bases on; windows with more than
    ``most`` counted sites are dropped whole. ``compat`` never cleans the last window of a group.
    """
    rows = anchor_groups(sites, list(keys), list(order), pos, window, "__w")
    over = Window.partitionBy(*keys)
    rows = rows.withColumn("__n", F.sum(F.coalesce(F.col(counted), F.lit(False)).cast("int")).over(Window.partitionBy(*keys, "__w")))
    bad = F.col("__n") > most
    if compat:
        rows = rows.withColumn("__last", F.max("__w").over(over))
        bad = bad & (F.col("__w") < F.col("__last"))
    return rows.where(~bad).select(*sites.columns)


def overlaps_any(regions: DataFrame, chosen: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Regions that overlap any of a list (start, end per key)."""
    from ..plans.intervals import overlapping_intervals

    return overlapping_intervals(regions, chosen, keys, (low, high), ("list_start", "list_end"), "semi")


def consecutive_duplicates(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Without rows equal in ``same`` to the row before."""
    over = Window.partitionBy(*keys).orderBy(*order)
    label = F.struct(*same)
    return df.withColumn("__p", F.lag(F.struct(label.alias("l"))).over(over)).where(
        F.col("__p").isNull() | ~label.eqNullSafe(F.col("__p.l"))).drop("__p")


def genome_ranks(rows: DataFrame, order: tuple[str, ...] = ("pos", "line_no", "site_id"), block: int = 50_000_000) -> DataFrame:
    """``place``: each row's rank in genome order within its sample (sample, chrom, pos).

    Ranks within blocks of a chromosome, then the blocks' counts: no window holds a chromosome, let alone a sample.
    """
    rows = rows.withColumn("__blk", F.floor(F.col("pos") / block))
    keys = ["sample", "chrom", "__blk"]
    within = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*keys, (F.sum("__n").over(Window.partitionBy("sample").orderBy("chrom", "__blk")) - F.col("__n")).alias("__b"))
    return within.join(before, keys).withColumn("place", (F.col("__b") + F.col("__r")).cast("bigint")).drop("__blk", "__r", "__b")
