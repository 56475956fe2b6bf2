"""Roll-ups to genes: tallies, summaries, multi-event genes, pairs of events that occur together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import genomics as G

#: Events that gene roll-ups leave out.
IGNORED = ("Noise", "Ignored", "HETGermline")


def gene_sites(sites: DataFrame, keep_ignored: bool = False) -> DataFrame:
    """Sites within a gene, keyed by its name without case."""
    own = sites.withColumn("gene_key", F.lower("gene")).where(F.col("gene_key").isNotNull() & ~F.col("gene_key").isin("", "."))
    return own if keep_ignored else own.where(~F.col("event").isin(*IGNORED))


def tally_genes(sites: DataFrame, events: tuple[str, ...] = G.EVENTS, mutations: tuple[str, ...] = G.MUTATION_TYPES) -> DataFrame:
    """Per gene: span, counts per event and mutation type, patients (once per copy number) per event and in all."""
    n = lambda c: F.count_if(c)
    aggregates = [F.min("pos").alias("low"), F.max("pos").alias("high"), F.count(F.lit(1)).alias("n_sites"), F.count_distinct("sample").alias("n_patients")]
    aggregates += [n(F.col("event") == e).alias(f"n_{e}") for e in events]
    aggregates += [n(F.col("mutation") == m).alias("n_" + m.replace(";", "_").replace("-", "_")) for m in mutations]
    return sites.groupBy("gene_key").agg(*aggregates)


def patients_per_event(sites: DataFrame, cn: str = "cn") -> DataFrame:
    """Per gene and event the number of distinct (patient, copy number) and of patients."""
    return sites.groupBy("gene_key", "event").agg(F.count_distinct("sample", F.round(cn, 3)).alias("n_patient_cn"), F.count_distinct("sample").alias("n_patients"))


def allele_event(event: Column, var_t: Column, cov_t: Column) -> Column:
    """Which allele an event lost or gained: the variant has more than half of the tumor's reads when the reference was lost."""
    variant = 2 * var_t > cov_t
    return (F.when(event.isin("LOH", "cnLOH"), F.when(variant, "LossReference").otherwise("LossVariant"))
            .when(event.isin("GainSomatic", "GainGermline"), F.when(variant, "GainVariant").otherwise("GainReference")))


def tally_alleles(sites: DataFrame) -> DataFrame:
    """Per gene, allele event and population class (rare or novel against others) the sites and patients."""
    rare = F.when(G.population_frequency_class(F.col("dbsnp"), F.col("ref")).isin("Rare", "Novel"), "rare").otherwise("other")
    rows = sites.withColumn("allele_event", allele_event(F.col("event"), F.col("var_t"), F.col("cov_t"))).withColumn("population", rare)
    return rows.where("allele_event IS NOT NULL").groupBy("gene_key", "allele_event", "population").agg(
        F.count(F.lit(1)).alias("n_sites"), F.count_distinct("sample").alias("n_patients"))


def summarize_genes(sites: DataFrame) -> DataFrame:
    """Per gene: counts, their logarithm, density per base, patients, losses by allele and the binomial p of their imbalance."""
    allele = allele_event(F.col("event"), F.col("var_t"), F.col("cov_t"))
    out = sites.withColumn("__a", allele).groupBy("gene_key").agg(
        F.count(F.lit(1)).alias("n_sites"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count_distinct("sample").alias("n_patients"),
        *[F.count_if(F.col("__a") == a).alias(f"n_{a}") for a in ("LossReference", "LossVariant", "GainReference", "GainVariant")])
    length = F.col("high") - F.col("low") + 1
    return out.select("*", F.ln("n_sites").alias("ln_sites"), (F.col("n_sites") / length).alias("density"))


def with_binomial_p(genes: DataFrame, hits: str, total: Column, out: str = "p_value") -> DataFrame:
    """Upper-tail binomial p (one half) of ``hits`` out of ``total``; distinct pairs are computed once."""
    from ..plans.cut import cut
    from ..plans.joins import sized_join
    from .classify import _imbalance

    rows = genes.withColumn("__h", F.col(hits)).withColumn("__c", total)
    pairs = cut(rows.select("__h", "__c").where("__h IS NOT NULL AND __c IS NOT NULL").distinct().withColumn(out, _imbalance("__h", "__c")))
    return sized_join(rows, pairs, ["__h", "__c"]).drop("__h", "__c")


def multi_event_genes(sites: DataFrame) -> DataFrame:
    """Genes with more than one event in a patient: patient, gene, number of events and their sorted list."""
    return sites.groupBy("sample", "gene_key").agg(F.array_sort(F.collect_set("event")).alias("events")).where(F.size("events") > 1).select(
        "sample", "gene_key", F.size("events").alias("n_events"), F.concat_ws(";", "events").alias("events"))


def co_occurrence(rows: DataFrame, patient: str, gene: str, event: str, min_patients: int = 2, salts: int = 8) -> DataFrame:
    """Unordered pairs of (gene, event) that occur together in at least ``min_patients`` patients, with their number.

    Triples are made distinct and nodes of too few patients are left out before the self-join. Each
    patient's rows are spread over ``salts`` on one side and repeated on the other, so that a patient
    with many events is shared by several tasks; counts are partial before they are shuffled.
    """
    triples = rows.select(F.col(patient).alias("patient"), F.lower(F.trim(gene)).alias("gene"), F.trim(event).alias("event")).where(
        "patient IS NOT NULL AND gene IS NOT NULL AND event IS NOT NULL").distinct()
    common = triples.groupBy("gene", "event").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_patients).drop("n")
    kept = triples.join(common, ["gene", "event"]).withColumn("node", F.concat_ws("\x01", "gene", "event"))
    a = kept.select("patient", F.col("node").alias("a"), F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("salt"))
    b = kept.select("patient", F.col("node").alias("b"), F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"))
    pairs = a.join(b, ["patient", "salt"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_patients")).where(F.col("n_patients") >= min_patients)
    part = lambda c, i: F.split(c, "\x01")[i]
    return pairs.select(part("a", 0).alias("gene1"), part("a", 1).alias("event1"), part("b", 0).alias("gene2"), part("b", 1).alias("event2"), "n_patients")


def pair_histogram(pairs: DataFrame) -> DataFrame:
    """How many pairs occur together in 1, 2, 3, ... patients."""
    return pairs.groupBy("n_patients").agg(F.count(F.lit(1)).alias("n_pairs"))


def dual_event_lower_bound(pairs: DataFrame, top: float = 0.01) -> DataFrame:
    """The smallest number of patients among the most frequent ``top`` share of pairs, from a table of counts."""
    from pyspark.sql import Window

    counts = pairs.groupBy("n_patients").agg(F.count(F.lit(1)).alias("n"))
    over = Window.orderBy(F.desc("n_patients"))
    return counts.withColumn("upto", F.sum("n").over(over)).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(1)))).where(
        F.col("upto") - F.col("n") < F.col("all") * top).agg(F.min("n_patients").alias("lower_bound"))


def gene_pair_distance(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """Pairs with the genes' distance as a share of their chromosome (genes: gene, chrom code, start, end)."""
    dim = G.chrom_dim(pairs.sparkSession).select(F.col("code").alias("c1"), "length")
    one = genes.select(F.col("gene").alias("gene1"), F.col("chrom").alias("c1"), F.col("end").alias("e1"))
    two = genes.select(F.col("gene").alias("gene2"), F.col("chrom").alias("c2"), F.col("start").alias("s2"))
    joined = pairs.join(one, "gene1").join(two, "gene2").join(F.broadcast(dim), "c1")
    return joined.withColumn("distance", G.gene_distance(F.col("c1"), F.col("e1"), F.col("c2"), F.col("s2"), F.col("length")))
