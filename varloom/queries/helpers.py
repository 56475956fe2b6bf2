"""Queries that carry scalar expressions and smaller operators over all rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import genomics as G, stats as S
from ..operators import enrichment as E, genes as N, origins as O, recurrence as R, segment as X
from ..plans import intervals as I
from ..sources import tables as T
from .cohort import _GENE, _NODES, _REGIONS, _genes, _regions, cooccurrence
from .sites import CALLED, CANONICAL, REGIONS, _called, _raw, _regions as _segments
from ..operators.qc import canonical_sites


def fraction_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions by platform, logarithms, roundings and mixtures of every row."""
    r = _raw(spark, sf_dir)
    cov, var, n = F.col("q20_totcov_t"), F.col("q20_varcov_t"), F.col("q20_totcov_n")
    v = G.vaf(var, cov)
    platform = F.when(F.col("site_id") % 2 == 0, "SOLiD").otherwise("Illumina")
    a, b = F.log10(1.0 + cov), F.log10(1.0 + n)
    table = S.lnfact(3000)
    out = {
        "vaf": G.vaf_from_raw(platform, F.col("q20_variantratio_t"), var, cov), "log10_vaf": G.safe_log10(v), "ln_vaf": G.log_or_zero(v),
        "log_sum": G.log_add(a, b), "log10_sum": G.log10_add(a, b), "mixed": G.purity_mix(F.lit(0.7), 2.0 * v), "stroma": G.purity_mix(v, F.lit(3.0), F.lit(1.0)),
        "scaled": G.normalize(cov.cast("double"), F.lit(10.0), F.lit(90.0)), "hundreds": G.round_to_power(cov, 2), "tenths": G.round_to_power(v, -1),
        "ln_choose": F.when((cov <= 3000) & (var >= 0) & (var <= cov), S.log_choose(table, cov, var)),
    }
    return r.select("site_id", *[F.round(F.nanvl(c.cast("double"), F.lit(None).cast("double")), 7).alias(k) for k, c in out.items()])


def text_functions(spark, sf_dir):
    """Places, leading numbers, letters and names in the text columns of every row."""
    r = _raw(spark, sf_dir)
    d = F.col("dbsnp")
    return r.select("site_id", G.first_whitespace(d).cast("int").alias("blank_at"), G.nth_index(d, ",", 2).cast("int").alias("second_comma"), G.parse_leading_int(F.substring(d, 3, 50)).cast("bigint").alias("number"),
                    G.unique_characters(F.concat("refbase", "varbase", "variantbase_n", "variantbase_t")).alias("letters"),
                    G.alphanumeric_match(F.col("mutationtype"), F.col("hugo_symbol")).alias("alike"), G.rs_text(d).alias("rs"))


def allele_functions(spark, sf_dir):
    """Alleles by genotype, the variant allele, how pairs agree, and the role of a sample's barcode, for every canonical row."""
    s = canonical_sites(_raw(spark, sf_dir))
    kind = G.genotype(G.vaf(F.col("var_t"), F.col("cov_t")))
    pair = G.genotype_alleles(kind, F.col("ref"), F.col("alt"))
    code = F.concat(F.lit("XY-00-0000-"), F.lpad((F.col("site_id") % 20).cast("string"), 2, "0"), F.lit("A-01-Z-"), F.col("site_id").cast("string"))
    code = F.when(F.col("site_id") % 7 == 0, F.substring_index(code, "-", 5)).otherwise(code)
    return s.select("site_id", pair.alias("alleles"), G.deduce_variant(F.col("ref"), F.substring(pair, 1, 1), F.substring(pair, 2, 1)).alias("variant"),
                    G.allele_pair_match(F.concat("ref", "alt"), G.complement(F.concat("alt", "ref"))).alias("agree"), G.barcode_role(code).alias("role"))


def event_span(spark, sf_dir):
    return R.event_span(_called(spark, sf_dir))


def event_span_in_genes(spark, sf_dir):
    """The same within each gene's interval."""
    g = _genes(spark, sf_dir).select("chrom", F.col("g_start").alias("r_start"), F.col("g_end").alias("r_end")).distinct()
    return R.event_span(_called(spark, sf_dir), g)


def pair_histogram(spark, sf_dir):
    return N.pair_histogram(cooccurrence(spark, sf_dir))


def dual_event_lower_bound(spark, sf_dir):
    return N.dual_event_lower_bound(cooccurrence(spark, sf_dir))


def gene_pair_distance(spark, sf_dir):
    """Distance of the genes of each pair of events that occur together."""
    genes = _genes(spark, sf_dir).groupBy(F.lower(F.trim("gene")).alias("gene"), "chrom").agg(F.min("g_start").alias("start"), F.max("g_end").alias("end"))
    d = N.gene_pair_distance(cooccurrence(spark, sf_dir), genes)
    return d.select("gene1", "event1", "gene2", "event2", "n_patients", F.col("c1").alias("chrom1"), F.col("c2").alias("chrom2"), F.round("distance", 9).alias("distance"))


def region_reassign(spark, sf_dir):
    """Called segments with the event that their mean copy number alone gives."""
    cn = _called(spark, sf_dir).withColumn("cn", F.round("cn", 4))
    r = _segments(spark, sf_dir).select("sample", "chrom", "start", "end", "n")
    inside = I.points_in_intervals(cn.select("sample", "chrom", "pos", "cn"), r, ["sample", "chrom"], "pos", "start", "end")
    mean = inside.groupBy("sample", "chrom", "start", "end", "n").agg(F.round(F.avg("cn"), 5).alias("cn"))
    return X.reassign_by_copy_number(mean).select("sample", "chrom", "start", "end", "n", "event")


def fill_regions(spark, sf_dir):
    """Open sites within their sample's lost segments of several sites become lost."""
    r = _segments(spark, sf_dir).where("event = 'LOH' AND n > 1")
    return X.fill_regions(_called(spark, sf_dir).select("sample", "chrom", "pos", "event"), r, "LOH")


def origin_transcripts(spark, sf_dir):
    """Delivered regions' starts with the genes within 100 kb, as origins with transcripts."""
    o = _regions(spark, sf_dir).select(F.col("patient").alias("sample"), "chrom", "start", "end").distinct()
    t = _genes(spark, sf_dir).select(F.concat(F.lit("chr"), F.col("chrom").cast("string"), F.when(F.col("g_start") % 2 == 0, "_alt").otherwise("")).alias("chrom"),
                                     F.col("g_start").alias("start"), F.col("g_end").alias("end"), "gene")
    return O.origins_with_transcripts(o, t).select("sample", "chrom", "start", "end", "gene", "t_start", "t_end")


def probe_map(spark, sf_dir):
    """Probes of all positions, named by identifier or numbered along the genome."""
    s = canonical_sites(_raw(spark, sf_dir))
    return T.probe_map(s.select("chrom", "pos", G.rs_number(F.col("dbsnp")).cast("bigint").alias("rs")))


def copy_number_track(spark, sf_dir):
    """Pieces of overlaid delivered segments, scored by 2^|mean|."""
    r = _regions(spark, sf_dir).where("log2_ratio IS NOT NULL AND NOT isnan(log2_ratio)").select("chrom", "start", "end", F.round(F.col("log2_ratio"), 2).alias("value"))
    return R.copy_number_track(r).select("chrom", "start", "end", "depth", F.round("mean", 6).alias("mean"))


def top_per_sample(spark, sf_dir):
    """The report of each sample's three genes with most called sites."""
    c = N.gene_sites(_called(spark, sf_dir)).groupBy("sample", "gene_key").agg(F.count(F.lit(1)).alias("n"))
    return E.top_per_group(c, ["sample"], "n", 3, ["gene_key"])


def bh_dependent(spark, sf_dir):
    """The threshold for dependent tests, over p-values of suppliers' discounts."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = li.select(F.col("l_suppkey").alias("k"), F.round((F.col("l_orderkey") % 1000 + 1) * (F.col("l_linenumber") / 200000), 9).alias("p"))
    return S.fdr_threshold(p, "p", 0.05, ["k"], dependent=True).select("k", F.round("threshold", 9).alias("threshold"))


QUERIES = {f.__name__: f for f in (fraction_functions, text_functions, allele_functions, event_span, event_span_in_genes, pair_histogram, dual_event_lower_bound, gene_pair_distance,
                                   region_reassign, fill_regions, origin_transcripts, probe_map, copy_number_track, top_per_sample, bh_dependent)}

_PAIRS = f"""{_NODES}, pairs AS (SELECT a.gene AS gene1, a.event AS event1, b.gene AS gene2, b.event AS event2, count(*) AS n_patients
  FROM x a JOIN x b ON a.patient = b.patient AND a.node < b.node GROUP BY ALL HAVING count(*) >= 3)"""
_LENGTH = "CASE c1 " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(G.CHROM_LENGTHS, 1)) + " END"
_BARE_WORD = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"

ORACLES = {
    "fraction_functions": """WITH b AS (SELECT site_id, q20_totcov_t AS cov, q20_varcov_t AS var, q20_variantratio_t AS given, q20_totcov_n AS n, q20_varcov_t / nullif(q20_totcov_t, 0) AS v,
        log10(1.0 + q20_totcov_t) AS a, log10(1.0 + q20_totcov_n) AS c FROM naf_taf_inputs),
      f AS (SELECT site_id, CASE WHEN site_id % 2 = 0 THEN v ELSE given END AS vaf, CASE WHEN v = 0 THEN -50.0 ELSE log10(nullif(v, 0)) END AS log10_vaf, CASE WHEN v = 0 THEN 0.0 ELSE ln(nullif(v, 0)) END AS ln_vaf,
        ln(exp(a) + exp(c)) AS log_sum, log10(pow(10, a) + pow(10, c)) AS log10_sum, 0.7 * 2 * v + 0.3 * 2 AS mixed, v * 3 + (1 - v) AS stroma, (cov - 10) / 80 AS scaled,
        floor(cov / 100.0 + 0.5) * 100 AS hundreds, floor(v / 0.1 + 0.5) * 0.1 AS tenths,
        CASE WHEN cov <= 3000 AND var >= 0 AND var <= cov THEN lgamma(cov + 1) - lgamma(var + 1) - lgamma(cov - var + 1) END AS ln_choose FROM b)
      SELECT site_id, COLUMNS(* EXCLUDE (site_id)) FROM (SELECT site_id, """ + ", ".join(
        f"round(CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END, 7) AS {c}" for c in
        ("vaf", "log10_vaf", "ln_vaf", "log_sum", "log10_sum", "mixed", "stroma", "scaled", "hundreds", "tenths", "ln_choose")) + " FROM f)",
    "text_functions": f"""WITH d AS (SELECT *, refbase || varbase || variantbase_n || variantbase_t AS four, {_BARE_WORD.format('mutationtype')} AS m, {_BARE_WORD.format('hugo_symbol')} AS h FROM naf_taf_inputs)
      SELECT site_id, CAST(length(regexp_extract(dbsnp, '^([^ \t\n\x0B\f\r]*)[ \t\n\x0B\f\r]', 1)) - CASE WHEN regexp_matches(dbsnp, '[ \\t\\n\\x0B\\f\\r]') THEN 0 ELSE 1 END AS INTEGER) AS blank_at,
        CAST(CASE WHEN len(string_split(dbsnp, ',')) > 2 THEN length(string_split(dbsnp, ',')[1]) + length(string_split(dbsnp, ',')[2]) + 1 WHEN dbsnp IS NOT NULL THEN -1 END AS INTEGER) AS second_comma,
        coalesce(try_cast(nullif(regexp_extract(dbsnp[3:52], '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS number,
        array_to_string(list_filter(string_split(four, ''), lambda x, i: list_position(string_split(four, ''), x) = i), '') AS letters,
        contains(m, h) OR contains(h, m) AS alike, regexp_extract(dbsnp, 'rs(-1|[0-9]*)', 0) AS rs FROM d""",
    "allele_functions": f"""WITH {CANONICAL}, k AS (SELECT *, var_t / nullif(cov_t, 0) AS v FROM canonical),
      a AS (SELECT *, CASE WHEN v <= 0.1 THEN ref || ref WHEN v > 0.9 THEN alt || alt WHEN v IS NOT NULL THEN ref || alt END AS alleles, translate(translate(alt || ref, 'ACGT', 'TGCA'), '', '') AS other FROM k)
      SELECT site_id, alleles, CASE WHEN alleles[1] <> ref THEN alleles[1] WHEN alleles[2] <> ref THEN alleles[2] ELSE 'N' END AS variant,
        CASE WHEN ref || alt = other THEN 'same' WHEN ref || alt = reverse(other) THEN 'flipped' WHEN ref || alt = translate(other, 'ACGT', 'TGCA') THEN 'complement'
          WHEN ref || alt = reverse(translate(other, 'ACGT', 'TGCA')) THEN 'complement_flipped' ELSE 'different' END AS agree,
        CASE WHEN site_id % 7 <> 0 THEN CASE WHEN site_id % 20 < 10 THEN 'tumor' ELSE 'normal' END END AS role FROM a""",
    "event_span": f"WITH {CALLED} SELECT event, chrom, min(pos) AS low, max(pos) AS high FROM called GROUP BY ALL",
    "event_span_in_genes": f"""WITH {CALLED}, {_GENE}, u AS (SELECT DISTINCT chrom, g_start AS r_start, g_end AS r_end FROM genes)
      SELECT event, c.chrom, r_start, r_end, min(pos) AS low, max(pos) AS high FROM called c JOIN u ON u.chrom = c.chrom AND pos BETWEEN r_start AND r_end GROUP BY ALL""",
    "pair_histogram": f"WITH {_PAIRS} SELECT n_patients, count(*) AS n_pairs FROM pairs GROUP BY n_patients",
    "dual_event_lower_bound": f"""WITH {_PAIRS}, r AS (SELECT n_patients, count(*) OVER (ORDER BY n_patients DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, count(*) OVER (PARTITION BY n_patients) AS n,
        count(*) OVER () AS every FROM pairs) SELECT min(n_patients) AS lower_bound FROM r WHERE upto - n < every * 0.01""",
    "gene_pair_distance": f"""WITH {_PAIRS}, {_GENE}, g AS (SELECT lower(trim(gene)) AS gene, chrom, min(g_start) AS s, max(g_end) AS e FROM genes GROUP BY ALL),
      j AS (SELECT p.*, a.chrom AS c1, b.chrom AS c2, a.e, b.s FROM pairs p JOIN g a ON a.gene = p.gene1 JOIN g b ON b.gene = p.gene2)
      SELECT gene1, event1, gene2, event2, n_patients, c1 AS chrom1, c2 AS chrom2, round(CASE WHEN c1 = c2 THEN (s - e) / {_LENGTH} ELSE 1.0 END, 9) AS distance FROM j""",
    "region_reassign": f"""WITH {REGIONS}, m AS (SELECT r.sample, r.chrom, r.start, r."end", r.n, round(avg(round(c.cn, 4)), 5) AS cn FROM regions r
        JOIN called c ON c.sample = r.sample AND c.chrom = r.chrom AND c.pos BETWEEN r.start AND r."end" GROUP BY ALL)
      SELECT sample, chrom, start, "end", n, CASE WHEN cn >= 2.2 THEN 'GainSomatic' WHEN cn > 1.8 THEN 'cnLOH' WHEN cn IS NOT NULL THEN 'LOH' END AS event FROM m""",
    "fill_regions": f"""WITH {REGIONS}, l AS (SELECT * FROM regions WHERE event = 'LOH' AND n > 1)
      SELECT sample, chrom, pos, CASE WHEN event IN ('HETGermline', 'Noise', 'Ignored') AND EXISTS (SELECT 1 FROM l WHERE l.sample = c.sample AND l.chrom = c.chrom AND c.pos BETWEEN l.start AND l."end") THEN 'LOH' ELSE event END AS event FROM called c""",
    "origin_transcripts": f"""WITH {_REGIONS}, {_GENE}, o AS (SELECT DISTINCT patient AS sample, chrom, start, "end" FROM delivered),
      t AS (SELECT gene, chrom, g_start - 100000 AS t_start, g_end + 100000 AS t_end FROM genes)
      SELECT sample, o.chrom, start, "end", gene, t_start, t_end FROM o JOIN t ON t.chrom = o.chrom AND start BETWEEN t_start AND t_end
      QUALIFY row_number() OVER (PARTITION BY sample, o.chrom, start, gene ORDER BY t_start, t_end) = 1""",
    "probe_map": f"""WITH {CANONICAL}, p AS (SELECT chrom, pos, max(CASE WHEN contains(lower(dbsnp), 'novel') THEN -5 ELSE coalesce(try_cast(nullif(regexp_extract(dbsnp, 'rs([0-9]+)', 1), '') AS BIGINT), -1) END) AS rs FROM canonical GROUP BY chrom, pos)
      SELECT 'rs' || rs AS probe, chrom, pos FROM p WHERE rs > 0 UNION ALL SELECT 'novel_' || row_number() OVER (ORDER BY chrom, pos), chrom, pos FROM p WHERE coalesce(rs, 0) <= 0""",
    "copy_number_track": f"""WITH {_REGIONS}, v AS (SELECT chrom, start, "end", round(log2_ratio, 2) AS value FROM delivered WHERE log2_ratio IS NOT NULL AND NOT isnan(log2_ratio)),
      s AS (SELECT chrom, start, "end", value - min(value) OVER (PARTITION BY chrom) AS value FROM v),
      e AS (SELECT DISTINCT chrom, p FROM (SELECT chrom, start AS p FROM s UNION ALL SELECT chrom, "end" + 1 FROM s)),
      w AS (SELECT chrom, p AS start, lead(p) OVER (PARTITION BY chrom ORDER BY p) - 1 AS "end" FROM e)
      SELECT w.chrom, w.start, w."end", count(*) AS depth, round(avg(value), 6) AS mean FROM w JOIN s ON s.chrom = w.chrom AND w.start BETWEEN s.start AND s."end" WHERE w."end" IS NOT NULL GROUP BY ALL""",
    "top_per_sample": f"""WITH {CALLED}, c AS (SELECT sample, lower(gene) AS gene_key, count(*) AS n FROM called WHERE lower(gene) NOT IN ('', '.') AND event NOT IN ('Noise', 'Ignored', 'HETGermline') GROUP BY ALL)
      SELECT *, CAST(row_number() OVER (PARTITION BY sample ORDER BY n DESC, gene_key) AS INTEGER) AS place FROM c QUALIFY place <= 3""",
    "bh_dependent": """WITH p AS (SELECT l_suppkey AS k, round((l_orderkey % 1000 + 1) * (l_linenumber / 200000), 9) AS p FROM lineitem),
      r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS rank, count(*) OVER (PARTITION BY k) AS m FROM p)
      SELECT k, round(coalesce(max(p) FILTER (p <= rank / (m * (ln(m) + 0.5772156649015329 + 1 / (2 * m))) * 0.05), 0.0), 9) AS threshold FROM r GROUP BY k""",
}
