"""Coverage and copy number: bias tables, chromosome coverage, gene blocks, centring, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import genomics as G
from ..plans.cut import cut
from ..plans.intervals import anchor_groups, ordered_islands


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median", block: float = 1 / 256) -> DataFrame:
    """The ordinary median per group without sorting a group in one task.

    Distinct values are counted first, then blocks of values; only the blocks that hold the middle are ordered.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*keys, v.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counts = cut(counts.withColumn("__blk", F.floor(F.col("__v") / block)))
    over = Window.partitionBy(*keys)
    blocks = counts.groupBy(*keys, "__blk").agg(F.sum("__c").alias("__bc"))
    blocks = blocks.select(*keys, "__blk", F.sum("__bc").over(over).alias("__m"), (F.sum("__bc").over(over.orderBy("__blk")) - F.col("__bc")).alias("__before"), "__bc")
    low, high = F.floor((F.col("__m") + 1) / 2), F.floor(F.col("__m") / 2) + 1
    middle = blocks.where((F.col("__before") + F.col("__bc") >= low) & (F.col("__before") < high))
    rows = counts.join(middle, [*keys, "__blk"])
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__blk").orderBy("__v"))
    rows = rows.withColumn("__u", upto)
    a = F.min(F.when(F.col("__u") >= low, F.col("__v")))
    b = F.min(F.when(F.col("__u") >= high, F.col("__v")))
    return rows.groupBy(*keys).agg(((a + b) / 2).alias(out))


def bias_table(sites: DataFrame) -> DataFrame:
    """Per position over the samples: n_samples, mean fraction and mean coverage relative to the sample, normal tissue.

    Only fractions between 10 % and 90 %, both excluded. Sample means come first, so the wide shuffle carries sums only.
    """
    means = sites.groupBy("sample").agg((F.sum("cov_n") / F.count("cov_n")).alias("__mean"))
    het = (10 * F.col("var_n") > F.col("cov_n")) & (10 * F.col("var_n") < 9 * F.col("cov_n"))
    rows = sites.where(het).select("sample", "chrom", "pos", G.vaf(F.col("var_n"), F.col("cov_n")).alias("v"), "cov_n")
    rows = rows.join(means, "sample").withColumn("c", F.col("cov_n") / F.col("__mean"))
    return rows.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n_samples"), F.avg("v").alias("avg_vaf_n"), F.avg("c").alias("avg_abs_cn"))


def read_bias(raw: DataFrame) -> DataFrame:
    """A bias table as delivered: chromosomes by code, one row per position (most samples first)."""
    rows = raw.select(G.chrom_code(F.col("chrom")).alias("chrom"), F.col("pos").cast("bigint").alias("pos"), "n_samples",
                      F.col("avg_vaf_n").cast("double").alias("avg_vaf_n"), F.col("avg_abs_cn").cast("double").alias("avg_abs_cn"))
    rows = rows.where(F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    over = Window.partitionBy("chrom", "pos").orderBy(F.desc_nulls_last("n_samples"), F.desc_nulls_last("avg_vaf_n"), F.desc_nulls_last("avg_abs_cn"))
    return rows.withColumn("__rn", F.row_number().over(over)).where("__rn = 1").drop("__rn")


def chrom_coverage(sites: DataFrame, compat: bool = False) -> DataFrame:
    """Per sample and chromosome: n, mean coverages, normal coverage relative to the sample's, tumor/normal ratio (1 without).

    ``compat`` divides in whole numbers.
    """
    by = sites.groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("cov_n").alias("sum_n"), F.sum("cov_t").alias("sum_t"))
    # the sample's totals come from its chromosomes, so the table is read once
    over = Window.partitionBy("sample")
    mean = (lambda a, b: F.floor(a / b).cast("double")) if compat else (lambda a, b: a / b)
    by = by.select("sample", "chrom", "n", "sum_n", "sum_t", mean(F.col("sum_n"), F.col("n")).alias("avg_n"), mean(F.col("sum_t"), F.col("n")).alias("avg_t"),
                   mean(F.sum("sum_n").over(over), F.sum("n").over(over)).alias("all_n"))
    return by.select("sample", "chrom", "n", "avg_n", "avg_t", F.try_divide("avg_n", "all_n").alias("rel_n"),
                     F.coalesce(F.try_divide("avg_t", "avg_n"), F.lit(1.0)).alias("tn_ratio"))


def modal_coverage(sites: DataFrame) -> DataFrame:
    """Per sample the most frequent 5-read bin of each tissue; ties go to the lowest bin."""
    long = sites.select("sample", F.explode(F.create_map(F.lit("normal"), F.col("cov_n"), F.lit("tumor"), F.col("cov_t"))).alias("tissue", "cov"))
    counts = long.where("cov IS NOT NULL").groupBy("sample", "tissue", G.nearest_5(F.col("cov")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("sample", "tissue").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"))


def gene_blocks(sites: DataFrame, gap: int = 1000) -> DataFrame:
    """Sites with ``block``: a new one where the gene changes (case aside), or within no gene after more than ``gap`` bases."""
    low = sites.withColumn("gene_key", F.lower("gene"))
    far = (F.col("gene_key") == ".") & (F.col("pos") - F.col("prev_pos") > gap)
    return ordered_islands(low, ["sample", "chrom"], "pos", ["gene_key"], extra_break=far, out="block")


def block_ratios(blocks: DataFrame) -> DataFrame:
    """Per sample, chromosome and block: start, end and tumor/normal ratio relative to the sample (null when all somatic)."""
    by = blocks.groupBy("sample", "chrom", "block").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n_sites"),
        F.sum(F.when(F.col("cov_n") > 0, F.col("cov_t"))).alias("t"), F.sum(F.when(F.col("cov_n") > 0, F.col("cov_n"))).alias("n"),
        F.sum("cov_t").alias("all_t"), F.sum("cov_n").alias("all_n"))
    by = cut(by)
    totals = by.groupBy("sample").agg(F.sum("all_t").alias("s_t"), F.sum("all_n").alias("s_n"))
    ratio = F.try_divide(F.col("t").cast("double") * F.col("s_n"), F.col("n").cast("double") * F.col("s_t"))
    return by.join(totals, "sample").select("sample", "chrom", "block", "start", "end", "n_sites", ratio.alias("ratio"))


def center_on_median(df: DataFrame, keys: list[str], value: str, of: Column | None = None) -> DataFrame:
    """``value`` shifted so that the median (of the rows chosen by ``of``) becomes 1."""
    chosen = df if of is None else df.where(of)
    medians = exact_median(chosen, keys, value, "__median")
    return df.join(medians, keys, "left").withColumn(value, F.col(value) + 1 - F.coalesce("__median", F.lit(1.0))).drop("__median")


def smooth_blocks(ratios: DataFrame, reach: int = 1_000_000) -> DataFrame:
    """``smooth``: ratios averaged over anchored groups of consecutive blocks that begin within ``reach`` of the group's first."""
    rows = anchor_groups(ratios, ["sample", "chrom"], ["start"], "start", reach + 1, "__w")
    return rows.withColumn("smooth", F.avg("ratio").over(Window.partitionBy("sample", "chrom", "__w"))).drop("__w")


def region_mean(sites: DataFrame, regions: DataFrame, value: str) -> DataFrame:
    """Regions (sample, chrom, start, end) with the mean of ``value`` and the number of sites in them."""
    from ..plans.intervals import points_in_intervals

    joined = points_in_intervals(sites.select("sample", "chrom", "pos", value), regions, ["sample", "chrom"], "pos", "start", "end")
    return joined.groupBy("sample", "chrom", "start", "end").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n_sites"))


def binned_vaf_stats(sites: DataFrame, width: float = 0.025) -> DataFrame:
    """Per sample the mean and deviation (n - 1) of normal fractions in bins, a bin standing for its upper edge."""
    v = G.vaf(F.col("var_n"), F.col("cov_n"))
    bins = sites.where((v > 0.2) & (v <= 0.8)).groupBy("sample", (F.floor(v / width) + 1).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    x, c = F.col("b") * width, F.col("c")
    sums = bins.groupBy("sample").agg(F.sum("c").alias("n"), F.sum(c * x).alias("s"), F.sum(c * x * x).alias("q"))
    return sums.select("sample", "n", (F.col("s") / F.col("n")).alias("mean"),
                       F.sqrt(F.greatest(F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1), F.lit(0.0))).alias("sd"))
