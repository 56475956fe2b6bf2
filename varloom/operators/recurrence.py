"""Recurrence over samples: disjoint pieces, positions, browser tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.genomics import rescale_score, with_genome_position
from ..plans.intervals import disjoin, points_in_intervals


def recurrent_pieces(regions: DataFrame, event: str | None = None) -> DataFrame:
    """Pieces cut at every boundary with the number of regions of one event that cover each; any order of samples gives the same."""
    own = regions if event is None else regions.where(F.col("event") == event)
    return disjoin(own, ["chrom"] if event else ["event", "chrom"], "start", "end")


def recurrence_by_position(sites: DataFrame) -> DataFrame:
    """Samples per event and position, with the genome-wide position."""
    counts = sites.groupBy("event", "chrom", "pos").agg(F.count(F.lit(1)).alias("n"))
    return with_genome_position(counts, "chrom", "pos")


def events_per_sample(sites: DataFrame) -> DataFrame:
    return sites.groupBy("sample", "event").agg(F.count(F.lit(1)).alias("n"))


def event_span(sites: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Smallest and largest position per event and chromosome over all samples, or within each of ``regions`` (chrom, r_start, r_end)."""
    if regions is None:
        return sites.groupBy("event", "chrom").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    rows = points_in_intervals(sites.select("chrom", "pos", "event"), regions.select("chrom", "r_start", "r_end"), ["chrom"], "pos", "r_start", "r_end")
    return rows.groupBy("event", "chrom", "r_start", "r_end").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))


def cumulative(counts: DataFrame, keys: list[str], bucket: str, n: str = "n") -> DataFrame:
    """Counts per bucket with the forward and backward cumulative counts and the shares of each group's total."""
    w = Window.partitionBy(*keys)
    up, total = F.sum(n).over(w.orderBy(bucket)), F.sum(n).over(w)
    return counts.select(*keys, bucket, n, up.alias("upto"), F.sum(n).over(w.orderBy(F.desc(bucket))).alias("from_here"),
                         (F.col(n) / total).alias("share"), (up / total).alias("share_upto"))


def sites_in_recurrent(sites: DataFrame, regions: DataFrame, recurrent: DataFrame) -> DataFrame:
    """Counts of events of sites that lie in a recurrent region and in a region of their own sample."""
    own = points_in_intervals(sites, regions.select("sample", "chrom", F.col("start").alias("o_start"), F.col("end").alias("o_end")),
                              ["sample", "chrom"], "pos", "o_start", "o_end", "semi")
    both = points_in_intervals(own.select("chrom", "pos", "event"), recurrent.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end")), ["chrom"], "pos", "r_start", "r_end")
    return both.groupBy("chrom", "r_start", "r_end", "event").agg(F.count(F.lit(1)).alias("n"))


def region_density(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """Events and heterozygous sites per base of each region."""
    joined = points_in_intervals(sites.select("sample", "chrom", "pos", F.col("event").alias("site_event")), regions, ["sample", "chrom"], "pos", "start", "end")
    length = F.col("end") - F.col("start") + 1
    return joined.groupBy("sample", "chrom", "start", "end", "event").agg(
        (F.count_if(F.col("site_event") == F.col("event"))).alias("n_event"), F.count_if(F.col("site_event") == "HETGermline").alias("n_het")).select(
        "*", (F.col("n_event") / length).alias("event_density"), (F.col("n_het") / length).alias("het_density"))


def browser_scores(pieces: DataFrame, value: str = "recurrence", keys: tuple[str, ...] = ("event",)) -> DataFrame:
    """``score`` 200..900 by linear rescale within each track."""
    ends = pieces.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return pieces.join(ends, list(keys)).withColumn("score", rescale_score(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def bed_lines(pieces: DataFrame, name: str = "event") -> DataFrame:
    """Text lines of a browser track; the end is raised by one as the tracks' readers expect."""
    code = F.when(F.col("chrom") == 23, "X").when(F.col("chrom") == 24, "Y").when(F.col("chrom") == 25, "M").otherwise(F.col("chrom").cast("string"))
    return pieces.select("chrom", "start", F.concat_ws(" ", F.concat(F.lit("chr"), code), F.col("start"), F.col("end") + 1, F.col(name), F.col("score"), F.lit("+")).alias("value"))


def sample_manifest(sites: DataFrame, event: str) -> DataFrame:
    """Samples by number of sites of an event, most first, ties by name descending; one row per sample."""
    counts = sites.where(F.col("event") == event).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("sample"))))


def copy_number_track(segments: DataFrame) -> DataFrame:
    """Overlaid copy-number segments (chrom, start, end, value) as pieces scored 2^|mean| and rescaled."""
    low = segments.groupBy("chrom").agg(F.min("value").alias("__min"))
    shifted = segments.join(low, "chrom").withColumn("value", F.col("value") - F.col("__min"))
    pieces = disjoin(shifted, ["chrom"], "start", "end", mean=F.avg("value"), depth=F.count(F.lit(1)))
    return browser_scores(pieces.withColumn("power", F.pow(F.lit(2.0), F.abs("mean"))), "power", ("chrom",))
