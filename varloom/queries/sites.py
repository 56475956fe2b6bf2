"""Queries over sites: cleaning, bias, coverage, copy number, classification, segments, recurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import genomics as G, stats as S
from ..operators import classify as C, copynumber as N, genes as E, qc as Q, recurrence as R, segment as X
from ..plans.cut import cut, kept
from ..plans.intervals import gap_regions


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/naf_taf_inputs.parquet")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned sites: canonical, first of each position, enough reads."""
    return Q.min_reads(Q.first_of_position(Q.canonical_sites(_raw(spark, sf_dir))))


def _bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.read_bias(spark.read.parquet(f"{sf_dir}/allelic_bias.parquet"))


_KEYS = ["sample", "chrom", "pos"]
_PAIR = ["cov_n", "var_n", "cov_t", "var_t"]


def sort_sites(spark, sf_dir):
    """Every canonical row with its rank in genome order within the sample."""
    rows = Q.canonical_sites(_raw(spark, sf_dir)).select("sample", "chrom", "pos", "line_no", "site_id")
    return Q.genome_ranks(rows).select("site_id", "place")


def dedup_sites(spark, sf_dir):
    return Q.first_of_position(Q.canonical_sites(_raw(spark, sf_dir))).select(*_KEYS, "line_no", "site_id")


def qc_min_reads(spark, sf_dir):
    return _sites(spark, sf_dir).select(*_KEYS, *_PAIR)


def qc_gc_fraction(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select("site_id", F.round(G.gc_fraction(F.col("refenv_t")), 6).alias("gc"))


def qc_extreme_gc(spark, sf_dir):
    return Q.extreme_gc(Q.canonical_sites(_raw(spark, sf_dir))).select("site_id")


def density_filter(spark, sf_dir):
    kept = Q.dense_sites(_sites(spark, sf_dir), counted=10 * F.col("var_n") > F.col("cov_n"))
    return kept.select(*_KEYS)


def anchored_density(spark, sf_dir):
    rows = _sites(spark, sf_dir).withColumn("counted", 10 * F.col("var_n") > F.col("cov_n"))
    return Q.anchored_density(rows, "counted").select(*_KEYS)


def bias_table(spark, sf_dir):
    t = N.bias_table(_sites(spark, sf_dir))
    return t.select("chrom", "pos", "n_samples", F.round("avg_vaf_n", 6).alias("avg_vaf_n"), F.round("avg_abs_cn", 6).alias("avg_abs_cn"))


def bias_filter(spark, sf_dir):
    return Q.bias_filter(Q.with_bias(_sites(spark, sf_dir), _bias(spark, sf_dir))).select(*_KEYS)


def scalar_functions(spark, sf_dir):
    """Identifier, population class, gene, mutation type, arm, genome position and genotype of every row."""
    rows = Q.canonical_sites(_raw(spark, sf_dir))
    rows = G.with_genome_position(rows, "chrom", "pos")
    v = G.vaf(F.col("var_t"), F.col("cov_t"))
    return rows.select("site_id", G.rs_number(F.col("dbsnp")).cast("bigint").alias("rs"), G.population_frequency_class(F.col("dbsnp"), F.col("ref")).alias("population"),
                       F.lower("gene").alias("gene"), "mutation", G.arm(F.col("chrom"), F.col("pos")).alias("arm"), F.col("genome_pos").cast("bigint").alias("genome_pos"),
                       G.genotype(v).alias("genotype"), G.complement(F.col("alt")).alias("alt_complement"), G.nearest_5(F.col("cov_n")).alias("cov_bin"),
                       G.somatic_location(G.vaf(F.col("var_n"), F.col("cov_n"))).alias("location"))


def chrom_coverage(spark, sf_dir):
    c = N.chrom_coverage(_sites(spark, sf_dir))
    return c.select("sample", "chrom", "n", *[F.round(x, 6).alias(x) for x in ("avg_n", "avg_t", "rel_n", "tn_ratio")])


def modal_coverage(spark, sf_dir):
    return N.modal_coverage(_sites(spark, sf_dir))


def gene_blocks(spark, sf_dir):
    b = N.block_ratios(N.gene_blocks(_sites(spark, sf_dir)))
    return b.select("sample", "chrom", "start", "end", "n_sites", F.round("ratio", 6).alias("ratio"))


def median_center(spark, sf_dir):
    b = N.block_ratios(N.gene_blocks(_sites(spark, sf_dir))).where("ratio IS NOT NULL")
    return N.exact_median(b, ["sample"], "ratio").select("sample", F.round("median", 6).alias("median"))


def anchored_smooth(spark, sf_dir):
    b = N.smooth_blocks(N.block_ratios(N.gene_blocks(_sites(spark, sf_dir))))
    return b.select("sample", "chrom", "start", "end", F.round("smooth", 6).alias("smooth"))


def cn_class(spark, sf_dir):
    b = N.block_ratios(N.gene_blocks(_sites(spark, sf_dir))).where("ratio IS NOT NULL")
    return b.groupBy("sample", G.copy_number_class(F.round(2 * F.col("ratio"), 6)).alias("cn_class")).agg(F.count(F.lit(1)).alias("n"))


def binned_vaf(spark, sf_dir):
    t = N.binned_vaf_stats(_sites(spark, sf_dir), 0.025)
    return t.select("sample", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def binom_tail(spark, sf_dir):
    rows = C.with_imbalance(_sites(spark, sf_dir)).where("p_t IS NOT NULL")
    return rows.select(F.col("cov_t").alias("n"), F.greatest(F.col("var_t"), F.col("cov_t") - F.col("var_t")).alias("k"), F.round("p_t", 8).alias("p")).distinct()


def permutation_thresholds(spark, sf_dir):
    covs = _sites(spark, sf_dir).select(F.col("cov_t").alias("cov")).distinct()
    return covs.select("cov", F.round(S.permutation_threshold_of(F.col("cov")), 8).alias("threshold"))


def _imbalanced(spark, sf_dir):
    return C.with_imbalance(cut(_sites(spark, sf_dir)))


def bh_threshold(spark, sf_dir):
    rows = _imbalanced(spark, sf_dir).withColumn("p", F.round("p_t", 10))
    return S.fdr_threshold(rows, "p", 0.01, ["sample"]).select("sample", F.round("threshold", 8).alias("threshold"))


def vaf_adjust(spark, sf_dir):
    rows = Q.with_bias(_sites(spark, sf_dir), _bias(spark, sf_dir)).withColumn("germline_gain", F.lit(False))
    return C.adjust_vafs(rows).select(*_KEYS, F.round("adj_vaf_n", 6).alias("adj_vaf_n"), F.round("adj_vaf_t", 6).alias("adj_vaf_t"))


def out_of_band_call(spark, sf_dir):
    return _sites(spark, sf_dir).where(~Q.in_het_band()).select(*_KEYS, C.out_of_band_event().alias("event"))


def poisson_argmax(spark, sf_dir):
    x = F.floor(100 * G.vaf(F.col("var_t"), F.col("cov_t")) + 0.5)
    rows = _sites(spark, sf_dir).where("cov_t > 0").select(x.alias("x")).distinct()
    return rows.where("x BETWEEN 0 AND 100").select("x", S.poisson_best(S.lnfact(100), [20.0, 40.0, 50.0, 60.0, 80.0], F.col("x")).alias("best"))


def germline_aneuploidy(spark, sf_dir):
    s = _sites(spark, sf_dir)
    return C.germline_aneuploidy(s, N.chrom_coverage(s))


def _prepared(spark, sf_dir, smooth):
    return C.prepare_sites(_sites(spark, sf_dir), _bias(spark, sf_dir), smooth)


def plane_split(spark, sf_dir):
    """Planes with copy numbers from unsmoothed, centred gene blocks."""
    return _prepared(spark, sf_dir, False).withColumn("cn", F.round("cn", 6)).groupBy("sample", C.plane().alias("plane")).agg(F.count(F.lit(1)).alias("n"))


def event_call(spark, sf_dir):
    called = C.call_events(_prepared(spark, sf_dir, True))
    return called.select(*_KEYS, "event", F.round("cn", 4).alias("cn"))


def _called(spark, sf_dir):
    """Every cleaned site with its called event and copy number: what all roll-ups below begin with."""
    names = [*_KEYS, "line_no", "site_id", "ref", "alt", *_PAIR, "dbsnp", "mutation", "gene", "event", "cn"]
    return kept(spark, "called", sf_dir, lambda: C.call_events(_prepared(spark, sf_dir, True)).select(*names))


def events_by_sample(spark, sf_dir):
    return R.events_per_sample(_called(spark, sf_dir))


def segments(spark, sf_dir):
    return X.segments(_called(spark, sf_dir))


def _regions(spark, sf_dir):
    return cut(X.segments(_called(spark, sf_dir)))


def region_mean_cn(spark, sf_dir):
    sites = _called(spark, sf_dir).withColumn("x", F.col("cov_t") * 1000 / F.col("cov_n"))
    r = X.remove_singletons(_regions(spark, sf_dir)).select("sample", "chrom", "start", "end")
    return N.region_mean(sites, r, "x").select("sample", "chrom", "start", "end", F.round("mean", 4).alias("mean"), "n_sites")


def region_gaps(spark, sf_dir):
    loh = _regions(spark, sf_dir).where("event IN ('LOH', 'cnLOH') AND n > 1")
    return gap_regions(_sites(spark, sf_dir), loh, ["sample", "chrom"], "pos", "start", "end")


def disjoin_recurrence(spark, sf_dir):
    return R.recurrent_pieces(_regions(spark, sf_dir))


def recurrence_by_pos(spark, sf_dir):
    r = R.recurrence_by_position(_called(spark, sf_dir))
    return r.select("event", "chrom", "pos", "n", F.col("genome_pos").cast("bigint").alias("genome_pos"))


def browser_score(spark, sf_dir):
    pieces = R.recurrent_pieces(_regions(spark, sf_dir))
    return R.bed_lines(R.browser_scores(pieces)).select("value")


def recurrent_site_counts(spark, sf_dir):
    regions = _regions(spark, sf_dir).where("event = 'LOH'")
    pieces = cut(R.recurrent_pieces(regions, "LOH").where("recurrence > 1"))
    return R.sites_in_recurrent(_called(spark, sf_dir), regions, pieces)


def region_density(spark, sf_dir):
    d = R.region_density(_called(spark, sf_dir), _regions(spark, sf_dir).select("sample", "chrom", "start", "end", "event"))
    return d.select("sample", "chrom", "start", "end", "event", "n_event", "n_het", F.round("event_density", 9).alias("event_density"))


def sample_manifest(spark, sf_dir):
    return R.sample_manifest(_called(spark, sf_dir), "LOH")


def region_caller(spark, sf_dir):
    """The full caller: events, three passes of merging and filling, then segments."""
    return X.segments(X.call_regions(C.call_events(_prepared(spark, sf_dir, True))))


def dbscan(spark, sf_dir):
    s = _sites(spark, sf_dir).where(Q.in_het_band()).where("cov_t > 0")
    pts = s.select("sample", "site_id", G.vaf(F.col("var_t"), F.col("cov_t")).alias("x"), G.vaf(F.col("var_n"), F.col("cov_n")).alias("y"))
    return C.dbscan_cells(pts, ["sample"], "site_id", "x", "y", 0.035, 100)


def gene_tally(spark, sf_dir):
    return E.tally_genes(E.gene_sites(_called(spark, sf_dir)))


def gene_summary(spark, sf_dir):
    g = E.summarize_genes(E.gene_sites(_called(spark, sf_dir)))
    return g.select("gene_key", "n_sites", "low", "high", "n_patients", "n_LossReference", "n_LossVariant", "n_GainReference", "n_GainVariant", F.round("density", 9).alias("density"))


def allele_tally(spark, sf_dir):
    return E.tally_alleles(E.gene_sites(_called(spark, sf_dir)))


def gene_loss_p(spark, sf_dir):
    g = E.summarize_genes(E.gene_sites(_called(spark, sf_dir)))
    g = E.with_binomial_p(g, "n_LossReference", F.col("n_LossReference") + F.col("n_LossVariant"))
    return g.select("gene_key", F.round("p_value", 8).alias("p_value"))


def multi_event_genes(spark, sf_dir):
    return E.multi_event_genes(E.gene_sites(_called(spark, sf_dir)))


def patients_per_event(spark, sf_dir):
    rows = E.gene_sites(_called(spark, sf_dir)).withColumn("cn", F.floor(F.col("cov_t") * 4 / F.col("cov_n")))
    return E.patients_per_event(rows)


QUERIES = {f.__name__: f for f in (
    sort_sites, dedup_sites, qc_min_reads, qc_gc_fraction, qc_extreme_gc, density_filter, anchored_density, bias_table, bias_filter, scalar_functions,
    chrom_coverage, modal_coverage, gene_blocks, median_center, anchored_smooth, cn_class, binned_vaf, binom_tail, permutation_thresholds, bh_threshold,
    vaf_adjust, out_of_band_call, poisson_argmax, germline_aneuploidy, plane_split, event_call, events_by_sample, segments, region_mean_cn, region_gaps,
    disjoin_recurrence, recurrence_by_pos, browser_score, recurrent_site_counts, region_density, sample_manifest, region_caller, dbscan, gene_tally,
    gene_summary, allele_tally, gene_loss_p, multi_event_genes, patients_per_event)}

_NAMES = "CASE lower(trim(mutationtype)) " + " ".join(f"WHEN '{m.lower()}' THEN '{m}'" for m in G.MUTATION_TYPES) + " ELSE 'None' END"
_CODE = """CASE WHEN starts_with(b, 'x') THEN 23 WHEN starts_with(b, 'y') THEN 24 WHEN starts_with(b, 'm') THEN 25
    WHEN regexp_full_match(b, '[0-9]+') AND try_cast(b AS INTEGER) BETWEEN 0 AND 25 THEN try_cast(b AS INTEGER) END"""
_NUC = "CASE WHEN upper(trim({0})) IN ('A', 'C', 'G', 'T') THEN upper(trim({0})) ELSE 'N' END"

CANONICAL = f"""
bare AS (SELECT *, regexp_replace(lower(trim(refname)), '^(chr_|chr|c)', '') AS b FROM naf_taf_inputs),
canonical AS (
  SELECT sample_id AS sample, {_CODE} AS chrom, coordinate AS pos, line_no, site_id, {_NUC.format('refbase')} AS ref, {_NUC.format('varbase')} AS alt,
    q20_totcov_n AS cov_n, q20_totcov_t AS cov_t, q20_varcov_n AS var_n, q20_varcov_t AS var_t, refenv_t AS flank, dbsnp, {_NAMES} AS mutation,
    CASE WHEN hugo_symbol IS NULL OR trim(hugo_symbol) IN ('', '.') THEN '.'
      WHEN contains(trim(hugo_symbol), 'dist') THEN split_part(trim(hugo_symbol), '(', 1) ELSE trim(hugo_symbol) END AS gene
  FROM bare WHERE sample_id IS NOT NULL AND coordinate IS NOT NULL AND ({_CODE}) BETWEEN 1 AND 23)"""
SITES = f"""{CANONICAL},
firsts AS (SELECT * FROM canonical QUALIFY row_number() OVER (PARTITION BY sample, chrom, pos ORDER BY line_no, site_id) = 1),
sites AS (SELECT * FROM firsts WHERE cov_t >= 0 AND cov_n >= 15)"""
_HET = "(100 * var_n > 10 * cov_n AND 100 * var_n <= 90 * cov_n AND cov_n > 0)"
_BIAS = f"""
bare_bias AS (SELECT *, regexp_replace(lower(trim(chrom)), '^(chr_|chr|c)', '') AS b FROM allelic_bias),
bias AS (SELECT {_CODE} AS chrom, pos, n_samples, CAST(avg_vaf_n AS DOUBLE) AS avg_vaf_n, CAST(avg_abs_cn AS DOUBLE) AS avg_abs_cn FROM bare_bias
  WHERE ({_CODE}) IS NOT NULL AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ({_CODE}), pos
    ORDER BY n_samples DESC NULLS LAST, avg_vaf_n DESC NULLS LAST, avg_abs_cn DESC NULLS LAST) = 1)"""
_BLOCKS = f"""{SITES},
marked AS (SELECT *, lower(gene) AS gene_key, CASE WHEN lag(pos) OVER w IS NULL THEN 0 WHEN lower(gene) <> lag(lower(gene)) OVER w
    OR (lower(gene) = '.' AND pos - lag(pos) OVER w > 1000) THEN 1 ELSE 0 END AS brk FROM sites WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY sample, chrom ORDER BY pos) AS block FROM marked),
totals AS (SELECT sample, sum(cov_t) AS s_t, sum(cov_n) AS s_n FROM sites GROUP BY sample),
blocks AS (SELECT sample, chrom, block, min(pos) AS start, max(pos) AS "end", count(*) AS n_sites,
    sum(cov_t) FILTER (cov_n > 0) AS t, sum(cov_n) FILTER (cov_n > 0) AS n FROM numbered GROUP BY sample, chrom, block),
ratios AS (SELECT sample, chrom, block, start, "end", n_sites, CASE WHEN n * s_t <> 0 THEN (CAST(t AS DOUBLE) * s_n) / (CAST(n AS DOUBLE) * s_t) END AS ratio
  FROM blocks JOIN totals USING (sample))"""
_OUT = """CASE WHEN coalesce(cov_n <= 0, true) OR coalesce(cov_t <= 0, true) THEN 'Ignored'
  WHEN 10 * var_n <= cov_n THEN CASE WHEN 20 * var_n <= cov_n AND 10 * var_t >= cov_t THEN 'HETSomatic'
    WHEN 10000 * var_t > 6667 * cov_t AND NOT 10000 * var_t <= 3333 * cov_t THEN 'LOH' ELSE 'Ignored' END
  ELSE CASE WHEN 20 * var_n >= 19 * cov_n AND 10 * var_t >= cov_t AND 10 * var_t <= 9 * cov_t THEN 'Ignored'
    WHEN 10000 * var_t <= 3333 * cov_t THEN 'LOH' ELSE 'Ignored' END END"""
def pieces_sql(source: str, keys: str, name: str = "pieces") -> str:
    """CTEs of the boundary sweep over ``source``."""
    return f"""
edges AS (SELECT {keys}, p0 AS start, sum(d) AS d FROM (SELECT {keys}, start AS p0, 1 AS d FROM {source} UNION ALL SELECT {keys}, "end" + 1, -1 FROM {source}) GROUP BY {keys}, p0),
swept AS (SELECT {keys}, start, lead(start) OVER w - 1 AS "end", CAST(sum(d) OVER w AS BIGINT) AS recurrence FROM edges WINDOW w AS (PARTITION BY {keys} ORDER BY start)),
{name} AS (SELECT * FROM swept WHERE recurrence > 0 AND "end" IS NOT NULL)"""


_TAIL = "least(list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)))), 1.0)"
_POPULATION = """(CASE WHEN lower(trim(dbsnp)) = 'novel' THEN 'Novel' WHEN dbsnp IS NULL OR len(string_split(dbsnp, ',')) <= 2 OR low IS NULL THEN 'Unknown'
    WHEN (CASE WHEN low.a = ref THEN 1 - low.f ELSE low.f END) < 0.01 THEN 'Rare' ELSE 'Common' END)"""
_LOWEST = """list_min(list_filter(list_transform(string_split(string_split(dbsnp, ',')[3], ';'), lambda p: struct_pack(f := try_cast(string_split(p, '|')[2] AS DOUBLE), a := string_split(p, '|')[1])), lambda s: s.f IS NOT NULL))"""
_OFFSETS, _total = [], 0
for _i, _length in enumerate(G.CHROM_LENGTHS, 1):
    _OFFSETS.append(f"WHEN {_i} THEN {_total}")
    _total += _length
_OFFSET = "CASE chrom " + " ".join(_OFFSETS) + " END"
_ARM = "CASE chrom " + " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(G.SHORT_ARMS, 1)) + " END"

_PMF = "exp(x * ln({0}) - {0} - lgamma(x + 1))"
_GAINS = f"""
het AS (SELECT sample, chrom, floor(100 * (var_n / cov_n) + 0.5) AS x FROM sites WHERE {_HET} AND NOT (var_n = cov_n OR var_n = 0)),
fit AS (SELECT sample, chrom, sum({_PMF.format('50.0')}) AS l0, sum(greatest({_PMF.format('(100 / 3.0)')}, {_PMF.format('(200 / 3.0)')})) AS l1 FROM het GROUP BY ALL),
cov AS (SELECT sample, chrom, sum(cov_n) / count(*) AS avg_n, sum(sum(cov_n)) OVER (PARTITION BY sample) / sum(count(*)) OVER (PARTITION BY sample) AS all_n FROM sites GROUP BY sample, chrom),
gains AS (SELECT sample, chrom, coalesce(l1 > l0, false) AND avg_n / all_n >= 1.4 AS germline_gain, coalesce(l1 > l0, false) AND avg_n / all_n < 1.4 AS contaminated
  FROM cov LEFT JOIN fit USING (sample, chrom))"""


def anchors_sql(source: str, position: str, reach: int, name: str = "anchors") -> str:
    """A recursive CTE of the greedy windows' first positions."""
    return f"""{name} AS (
  SELECT sample, chrom, min({position}) AS first FROM {source} GROUP BY sample, chrom
  UNION ALL SELECT a.sample, a.chrom, min(s.{position}) FROM {name} a JOIN {source} s ON s.sample = a.sample AND s.chrom = a.chrom AND s.{position} >= a.first + {reach} GROUP BY a.sample, a.chrom, a.first)"""


_SMOOTH = f"""{_BLOCKS}, {anchors_sql('ratios', 'start', 1_000_001)},
grouped AS (SELECT r.*, a.first FROM ratios r ASOF JOIN anchors a ON r.sample = a.sample AND r.chrom = a.chrom AND r.start >= a.first),
smoothed AS (SELECT *, avg(ratio) OVER (PARTITION BY sample, chrom, first) AS smooth FROM grouped)"""


def prepared_sql(smooth: bool) -> str:
    """CTEs up to ``ready``: sites with all that events are called from."""
    centre = """
medians AS (SELECT sample, median(ratio) AS m FROM joined GROUP BY sample),
rated AS (SELECT * REPLACE (ratio + 1 - m AS ratio) FROM joined JOIN medians USING (sample))""" if not smooth else "rated AS (SELECT * FROM joined)"
    source = "(SELECT sample, chrom, block, coalesce(smooth, ratio) AS ratio FROM smoothed)" if smooth else "ratios"
    return f"""{_SMOOTH if smooth else _BLOCKS}, {_BIAS}, {_GAINS},
joined AS (SELECT n.sample, n.chrom, n.pos, n.cov_n, n.var_n, n.cov_t, n.var_t, coalesce(r.ratio, 1.0) AS ratio, germline_gain, n_samples, avg_vaf_n
  FROM numbered n LEFT JOIN {source} r ON n.sample = r.sample AND n.chrom = r.chrom AND n.block = r.block
  LEFT JOIN gains g ON n.sample = g.sample AND n.chrom = g.chrom LEFT JOIN bias b ON n.chrom = b.chrom AND n.pos = b.pos), {centre},
pairs AS (SELECT DISTINCT n, k FROM (SELECT cov_n AS n, greatest(var_n, cov_n - var_n) AS k FROM sites UNION ALL SELECT cov_t, greatest(var_t, cov_t - var_t) FROM sites) WHERE k <= n),
tails AS (SELECT n, k, CASE WHEN n <= 0 OR k <= 0 THEN 1.0 ELSE {_TAIL.format(n='n', k='k')} END AS p FROM pairs),
steps AS (SELECT cov, unnest(range(CAST(ceil(cov / 2) AS BIGINT), cov + 1)) AS m FROM (SELECT DISTINCT n AS cov FROM pairs WHERE n > 0)),
levels AS (SELECT cov, min(tail) FILTER (2 * tail >= 0.05) AS sig_p FROM (SELECT cov, least(sum(exp(lgamma(cov + 1) - lgamma(m + 1) - lgamma(cov - m + 1) - cov * ln(2)))
  OVER (PARTITION BY cov ORDER BY m DESC), 1.0) AS tail FROM steps) GROUP BY cov UNION ALL SELECT DISTINCT n, 1.0 FROM pairs WHERE n <= 0),
moved AS (SELECT r.*, 2 * ratio AS cn, a.p AS p_n, b.p AS p_t, l.sig_p, CASE WHEN {_HET} AND n_samples >= 2 AND avg_vaf_n > 0 AND NOT coalesce(germline_gain, false)
    THEN -sign(2 * var_n - cov_n) * abs(0.5 - avg_vaf_n) ELSE 0.0 END AS o
  FROM rated r LEFT JOIN tails a ON a.n = cov_n AND a.k = greatest(var_n, cov_n - var_n) LEFT JOIN tails b ON b.n = cov_t AND b.k = greatest(var_t, cov_t - var_t) LEFT JOIN levels l ON l.cov = cov_t),
ready AS (SELECT *, CASE WHEN var_n IS NOT NULL THEN least(greatest(var_n / cov_n + o, 0.0), 1.0) END AS adj_n,
    CASE WHEN var_t IS NOT NULL AND cov_t <> 0 THEN least(greatest(var_t / cov_t + o, 0.0), 1.0) END AS adj_t FROM moved)"""


def plane_sql(cn: str) -> str:
    return f"""CASE WHEN {_HET} THEN CASE WHEN coalesce(germline_gain, false) THEN 2 WHEN coalesce(p_t <= sig_p * (1 + 1e-9) OR p_n <= 0.01, false)
    THEN CASE WHEN coalesce(adj_t <> 0 AND abs(adj_n / nullif(adj_t, 0) - 1) <= 0.2, false) AND {cn} > 1.8 AND {cn} < 2.2 THEN -1 ELSE 1 END ELSE 0 END END"""


#: CTEs of the event calls, up to ``calls`` (cn2 is the re-centred copy number).
_CALLS = f"""{prepared_sql(True)}, p AS (SELECT *, {plane_sql('cn')} AS plane FROM ready),
  low AS (SELECT *, CASE WHEN plane = 0 THEN CASE WHEN cn < 1.1 THEN 'DELHom' WHEN cn > 3 THEN 'GainSomatic' ELSE 'HETGermline' END ELSE '' END AS first_event, cn / 2 AS half FROM p),
  m AS (SELECT sample, median(half) AS med FROM low WHERE first_event = 'HETGermline' GROUP BY sample),
  c AS (SELECT low.*, 2 * (half + 1 - coalesce(med, 1.0)) AS cn2 FROM low LEFT JOIN m USING (sample)),
  calls AS (SELECT sample, chrom, pos, cn2, CASE plane WHEN 0 THEN first_event WHEN 2 THEN 'GainGermline' WHEN -1 THEN 'Ignored'
    WHEN 1 THEN CASE WHEN coalesce(adj_t <> 0 AND abs(adj_n / nullif(adj_t, 0) - 1) <= 0.2, false) AND cn2 > 1.8 AND cn2 < 2.2 THEN 'Ignored'
      WHEN cn2 >= 2.2 THEN 'GainSomatic' WHEN cn2 > 1.8 AND cn2 < 2.2 THEN 'cnLOH' ELSE 'LOH' END ELSE {_OUT} END AS event FROM c)"""
#: Sites with their calls; the calls' own CTEs stay inside, so that their names are free.
CALLED = f"""{SITES},
called AS MATERIALIZED (SELECT s.*, e.event, e.cn2 AS cn FROM sites s JOIN (WITH RECURSIVE {_CALLS} SELECT * FROM calls) e
  ON s.sample = e.sample AND s.chrom = e.chrom AND s.pos = e.pos)"""
REGIONS = f"""{CALLED},
valid AS (SELECT sample, chrom, pos, min(event) AS event FROM called WHERE event NOT IN ('Noise', 'Ignored', 'HETSomatic') GROUP BY sample, chrom, pos),
changes AS (SELECT *, CASE WHEN event = lag(event) OVER w THEN 0 ELSE 1 END AS brk FROM valid WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY sample, chrom ORDER BY pos) AS run FROM changes),
regions AS (SELECT sample, chrom, event, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM runs GROUP BY sample, chrom, event, run)"""


_GENES = f"""{CALLED},
in_genes AS (SELECT *, lower(gene) AS gene_key, CASE WHEN event IN ('LOH', 'cnLOH') THEN CASE WHEN 2 * var_t > cov_t THEN 'LossReference' ELSE 'LossVariant' END
    WHEN event IN ('GainSomatic', 'GainGermline') THEN CASE WHEN 2 * var_t > cov_t THEN 'GainVariant' ELSE 'GainReference' END END AS allele_event
  FROM called WHERE lower(gene) NOT IN ('', '.') AND event NOT IN ('Noise', 'Ignored', 'HETGermline'))"""

ORACLES = {
    "anchored_density": f"""WITH RECURSIVE {SITES}, c AS (SELECT *, CASE WHEN 10 * var_n > cov_n THEN 1 ELSE 0 END AS counted FROM sites), {anchors_sql('c', 'pos', 1000)},
      w AS (SELECT c.sample, c.chrom, c.pos, sum(counted) OVER (PARTITION BY c.sample, c.chrom, a.first) AS n FROM c ASOF JOIN anchors a ON c.sample = a.sample AND c.chrom = a.chrom AND c.pos >= a.first)
      SELECT sample, chrom, pos FROM w WHERE n <= 3""",
    "anchored_smooth": f'WITH RECURSIVE {_SMOOTH} SELECT sample, chrom, start, "end", round(smooth, 6) AS smooth FROM smoothed',
    "germline_aneuploidy": f"WITH {SITES}, {_GAINS} SELECT * FROM gains",
    "plane_split": f"WITH {prepared_sql(False)}, rounded AS (SELECT * REPLACE (round(cn, 6) AS cn) FROM ready) SELECT sample, {plane_sql('cn')} AS plane, count(*) AS n FROM rounded GROUP BY ALL",
    "event_call": f"WITH RECURSIVE {_CALLS} SELECT sample, chrom, pos, round(cn2, 4) AS cn, event FROM calls",
    "sort_sites": f"WITH {CANONICAL} SELECT site_id, row_number() OVER (PARTITION BY sample ORDER BY chrom, pos, line_no, site_id) AS place FROM canonical",
    "dedup_sites": f"WITH {SITES} SELECT sample, chrom, pos, line_no, site_id FROM firsts",
    "qc_min_reads": f"WITH {SITES} SELECT sample, chrom, pos, cov_n, var_n, cov_t, var_t FROM sites",
    "qc_gc_fraction": """SELECT site_id, round(CASE WHEN length(regexp_replace(refenv_t, '[^ACGTNacgtn]', '', 'g')) = 0 THEN -1.0
      ELSE length(regexp_replace(refenv_t, '[^GCgc]', '', 'g')) / length(regexp_replace(refenv_t, '[^ACGTNacgtn]', '', 'g')) END, 6) AS gc FROM naf_taf_inputs""",
    "qc_extreme_gc": f"""WITH {CANONICAL}, f AS (SELECT site_id, coalesce(length(regexp_replace(flank, '[^ACGTNacgtn]', '', 'g')), 0) AS n, length(regexp_replace(flank, '[^GCgc]', '', 'g')) AS g FROM canonical)
      SELECT site_id FROM f WHERE n = 0 OR (g / n >= 0.05 AND g / n < 0.80)""",
    "density_filter": f"""WITH {SITES}, c AS (SELECT *, CASE WHEN 10 * var_n > cov_n THEN 1 ELSE 0 END AS counted FROM sites),
      w AS (SELECT *, sum(counted) OVER (PARTITION BY sample, chrom ORDER BY pos RANGE BETWEEN 999 PRECEDING AND 999 FOLLOWING) AS near FROM c)
      SELECT sample, chrom, pos FROM w WHERE NOT (counted = 1 AND near > 3)""",
    "bias_table": f"""WITH {SITES}, means AS (SELECT sample, avg(cov_n) AS m FROM sites GROUP BY sample)
      SELECT chrom, pos, count(*) AS n_samples, round(avg(var_n / cov_n), 6) AS avg_vaf_n, round(avg(cov_n / m), 6) AS avg_abs_cn
      FROM sites JOIN means USING (sample) WHERE 10 * var_n > cov_n AND 10 * var_n < 9 * cov_n GROUP BY chrom, pos""",
    "bias_filter": f"""WITH {SITES}, {_BIAS} SELECT sample, chrom, pos FROM sites LEFT JOIN bias USING (chrom, pos)
      WHERE NOT coalesce(n_samples >= 2 AND (avg_abs_cn >= 4 OR avg_vaf_n BETWEEN 0 AND 0.33), false)""",
    "scalar_functions": f"""WITH {CANONICAL}, l AS (SELECT *, {_LOWEST} AS low FROM canonical)
      SELECT site_id, CAST(CASE WHEN contains(lower(dbsnp), 'novel') THEN -5 ELSE coalesce(try_cast(nullif(regexp_extract(dbsnp, 'rs([0-9]+)', 1), '') AS BIGINT), -1) END AS BIGINT) AS rs,
        {_POPULATION} AS population, lower(gene) AS gene, mutation, CASE WHEN pos >= {_ARM} THEN 'q' ELSE 'p' END AS arm, CAST(pos + {_OFFSET} AS BIGINT) AS genome_pos,
        CASE WHEN cov_t = 0 OR cov_t IS NULL OR var_t IS NULL THEN NULL WHEN var_t / cov_t <= 0.1 THEN 'hom_ref' WHEN var_t / cov_t > 0.9 THEN 'hom_alt' ELSE 'het' END AS genotype,
        translate(alt, 'ACGT', 'TGCA') AS alt_complement, CAST(floor(cov_n / 5.0 + 0.5) * 5 AS BIGINT) AS cov_bin,
        CASE WHEN cov_n = 0 OR cov_n IS NULL OR var_n IS NULL THEN NULL WHEN var_n / cov_n >= 0.05 THEN 'Germline' ELSE 'Somatic' END AS location FROM l""",
    "chrom_coverage": f"""WITH {SITES}, c AS (SELECT sample, chrom, count(*) AS n, sum(cov_n) AS a, sum(cov_t) AS t FROM sites GROUP BY sample, chrom),
      d AS (SELECT *, a / n AS avg_n, t / n AS avg_t, sum(a) OVER (PARTITION BY sample) / sum(n) OVER (PARTITION BY sample) AS all_n FROM c)
      SELECT sample, chrom, n, round(avg_n, 6) AS avg_n, round(avg_t, 6) AS avg_t, round(avg_n / all_n, 6) AS rel_n, round(avg_t / avg_n, 6) AS tn_ratio FROM d""",
    "modal_coverage": f"""WITH {SITES}, long AS (SELECT sample, 'normal' AS tissue, cov_n AS cov FROM sites UNION ALL SELECT sample, 'tumor', cov_t FROM sites),
      c AS (SELECT sample, tissue, CAST(floor(cov / 5.0 + 0.5) * 5 AS BIGINT) AS bin, count(*) AS n FROM long WHERE cov IS NOT NULL GROUP BY ALL)
      SELECT sample, tissue, bin, n FROM c QUALIFY row_number() OVER (PARTITION BY sample, tissue ORDER BY n DESC, bin) = 1""",
    "gene_blocks": f'WITH {_BLOCKS} SELECT sample, chrom, start, "end", n_sites, round(ratio, 6) AS ratio FROM ratios',
    "median_center": f"WITH {_BLOCKS} SELECT sample, round(median(ratio), 6) AS median FROM ratios WHERE ratio IS NOT NULL GROUP BY sample",
    "cn_class": f"""WITH {_BLOCKS}, c AS (SELECT sample, round(2 * ratio, 6) AS cn FROM ratios WHERE ratio IS NOT NULL)
      SELECT sample, CASE WHEN cn <= 1.1 THEN 'homdel' WHEN cn <= 1.8 THEN 'del' WHEN cn >= 2.2 THEN 'amp' ELSE 'diploid' END AS cn_class, count(*) AS n FROM c GROUP BY ALL""",
    "binned_vaf": f"""WITH {SITES}, b AS (SELECT sample, (floor(var_n / cov_n / CAST(0.025 AS DOUBLE)) + 1) * CAST(0.025 AS DOUBLE) AS x FROM sites WHERE var_n / cov_n > 0.2 AND var_n / cov_n <= 0.8)
      SELECT sample, count(*) AS n, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS sd FROM b GROUP BY sample""",
    "binom_tail": f"""WITH {SITES}, p AS (SELECT DISTINCT cov_t AS n, greatest(var_t, cov_t - var_t) AS k FROM sites WHERE greatest(var_t, cov_t - var_t) <= cov_t)
      SELECT n, k, round(CASE WHEN n <= 0 OR k <= 0 THEN 1.0 ELSE {_TAIL.format(n='n', k='k')} END, 8) AS p FROM p""",
    "permutation_thresholds": f"""WITH {SITES}, c AS (SELECT DISTINCT cov_t AS cov FROM sites WHERE cov_t IS NOT NULL),
      t AS (SELECT cov, unnest(range(CAST(ceil(cov / 2) AS BIGINT), cov + 1)) AS m FROM c WHERE cov > 0),
      p AS (SELECT cov, least(sum(exp(lgamma(cov + 1) - lgamma(m + 1) - lgamma(cov - m + 1) - cov * ln(2))) OVER (PARTITION BY cov ORDER BY m DESC), 1.0) AS tail FROM t)
      SELECT cov, round(min(tail) FILTER (2 * tail >= 0.05), 8) AS threshold FROM p GROUP BY cov UNION ALL SELECT cov, 1.0 FROM c WHERE cov <= 0""",
    "bh_threshold": f"""WITH {SITES}, k AS (SELECT sample, cov_t AS n, greatest(var_t, cov_t - var_t) AS k FROM sites WHERE cov_t IS NOT NULL AND var_t IS NOT NULL),
      p AS (SELECT sample, round(CASE WHEN n <= 0 OR k <= 0 THEN 1.0 ELSE {_TAIL.format(n='n', k='k')} END, 10) AS p FROM k WHERE k <= n OR k IS NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY p) AS rank, count(*) OVER (PARTITION BY sample) AS m FROM p)
      SELECT sample, round(coalesce(max(p) FILTER (p <= rank / m * 0.01), 0.0), 8) AS threshold FROM r GROUP BY sample""",
    "vaf_adjust": f"""WITH {SITES}, {_BIAS}, j AS (SELECT *, var_n / nullif(cov_n, 0) AS v_n, var_t / nullif(cov_t, 0) AS v_t,
        CASE WHEN {_HET} AND n_samples >= 2 AND avg_vaf_n > 0 THEN -sign(2 * var_n - cov_n) * abs(0.5 - avg_vaf_n) ELSE 0.0 END AS o FROM sites LEFT JOIN bias USING (chrom, pos))
      SELECT sample, chrom, pos, round(CASE WHEN v_n IS NOT NULL THEN least(greatest(v_n + o, 0.0), 1.0) END, 6) AS adj_vaf_n, round(CASE WHEN v_t IS NOT NULL THEN least(greatest(v_t + o, 0.0), 1.0) END, 6) AS adj_vaf_t FROM j""",
    "out_of_band_call": f"WITH {SITES} SELECT sample, chrom, pos, {_OUT} AS event FROM sites WHERE NOT {_HET}",
    "poisson_argmax": f"""WITH {SITES}, x AS (SELECT DISTINCT CAST(floor(100 * var_t / cov_t + 0.5) AS BIGINT) AS x FROM sites WHERE cov_t > 0),
      l AS (SELECT x, unnest([20.0, 40.0, 50.0, 60.0, 80.0]) AS m FROM x WHERE x BETWEEN 0 AND 100)
      SELECT x, CAST(arg_max(m, x * ln(m) - m) AS DOUBLE) AS best FROM l GROUP BY x""",
    "events_by_sample": f"WITH {CALLED} SELECT sample, event, count(*) AS n FROM called GROUP BY ALL",
    "segments": f"WITH {REGIONS} SELECT * FROM regions",
    "region_mean_cn": f"""WITH {REGIONS} SELECT r.sample, r.chrom, r.start, r."end", round(avg(s.cov_t * 1000 / s.cov_n), 4) AS mean, count(*) AS n_sites
      FROM regions r JOIN called s ON s.sample = r.sample AND s.chrom = r.chrom AND s.pos BETWEEN r.start AND r."end" WHERE r.start <> r."end" GROUP BY ALL""",
    "region_gaps": f"""WITH {REGIONS}, loh AS (SELECT * FROM regions WHERE event IN ('LOH', 'cnLOH') AND n > 1),
      tagged AS (SELECT s.sample, s.chrom, s.pos, min(r.start) AS region FROM sites s LEFT JOIN loh r ON s.sample = r.sample AND s.chrom = r.chrom AND s.pos BETWEEN r.start AND r."end" GROUP BY ALL),
      c AS (SELECT *, CASE WHEN region IS NOT DISTINCT FROM lag(region) OVER w AND lag(pos) OVER w IS NOT NULL THEN 0 ELSE 1 END AS brk FROM tagged WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)),
      i AS (SELECT *, sum(brk) OVER (PARTITION BY sample, chrom ORDER BY pos) AS run FROM c)
      SELECT sample, chrom, min(pos) AS start, max(pos) AS "end", count(*) AS n_sites, region IS NULL AS is_gap FROM i GROUP BY sample, chrom, run, region""",
    "disjoin_recurrence": f"WITH {REGIONS}, {pieces_sql('regions', 'event, chrom')} SELECT * FROM pieces",
    "recurrence_by_pos": f"WITH {CALLED} SELECT event, chrom, pos, count(*) AS n, CAST(pos + {_OFFSET} AS BIGINT) AS genome_pos FROM called GROUP BY ALL",
    "browser_score": f"""WITH {REGIONS}, {pieces_sql('regions', 'event, chrom')},
      s AS (SELECT *, min(recurrence) OVER (PARTITION BY event) AS lo, max(recurrence) OVER (PARTITION BY event) AS hi FROM pieces)
      SELECT concat_ws(' ', 'chr' || CASE chrom WHEN 23 THEN 'X' ELSE CAST(chrom AS VARCHAR) END, start, "end" + 1, event, CAST(floor((recurrence - lo) / (hi - lo + 1) * 700 + 200) AS INTEGER), '+') AS value FROM s""",
    "recurrent_site_counts": f"""WITH {REGIONS}, loh AS (SELECT * FROM regions WHERE event = 'LOH'), {pieces_sql('loh', 'chrom')}
      SELECT p.chrom, p.start AS r_start, p."end" AS r_end, s.event, count(*) AS n FROM called s JOIN pieces p ON p.recurrence > 1 AND s.chrom = p.chrom AND s.pos BETWEEN p.start AND p."end"
      WHERE EXISTS (SELECT 1 FROM loh r WHERE r.sample = s.sample AND r.chrom = s.chrom AND s.pos BETWEEN r.start AND r."end") GROUP BY ALL""",
    "region_density": f"""WITH {REGIONS} SELECT r.sample, r.chrom, r.start, r."end", r.event, count(*) FILTER (s.event = r.event) AS n_event, count(*) FILTER (s.event = 'HETGermline') AS n_het,
        round(count(*) FILTER (s.event = r.event) / (r."end" - r.start + 1), 9) AS event_density
      FROM regions r JOIN called s ON s.sample = r.sample AND s.chrom = r.chrom AND s.pos BETWEEN r.start AND r."end" GROUP BY r.sample, r.chrom, r.start, r."end", r.event""",
    "sample_manifest": f"""WITH {CALLED}, c AS (SELECT sample, count(*) AS n FROM called WHERE event = 'LOH' GROUP BY sample)
      SELECT *, CAST(row_number() OVER (ORDER BY n DESC, sample DESC) AS INTEGER) AS place FROM c""",
    "gene_tally": f"WITH {_GENES} SELECT gene_key, min(pos) AS low, max(pos) AS high, count(*) AS n_sites, count(DISTINCT sample) AS n_patients, "
    + ", ".join(f"count(*) FILTER (event = '{e}') AS n_{e}" for e in G.EVENTS) + ", "
    + ", ".join(f"count(*) FILTER (mutation = '{m}') AS n_{m.replace(';', '_').replace('-', '_')}" for m in G.MUTATION_TYPES) + " FROM in_genes GROUP BY gene_key",
    "gene_summary": f"WITH {_GENES} SELECT gene_key, count(*) AS n_sites, min(pos) AS low, max(pos) AS high, count(DISTINCT sample) AS n_patients, "
    + ", ".join(f"count(*) FILTER (allele_event = '{a}') AS n_{a}" for a in ("LossReference", "LossVariant", "GainReference", "GainVariant"))
    + ", round(count(*) / (max(pos) - min(pos) + 1), 9) AS density FROM in_genes GROUP BY gene_key",
    "allele_tally": f"""WITH {_GENES}, l AS (SELECT *, {_LOWEST} AS low FROM in_genes WHERE allele_event IS NOT NULL),
      p AS (SELECT *, CASE WHEN {_POPULATION} IN ('Rare', 'Novel') THEN 'rare' ELSE 'other' END AS population FROM l)
      SELECT gene_key, allele_event, population, count(*) AS n_sites, count(DISTINCT sample) AS n_patients FROM p GROUP BY ALL""",
    "gene_loss_p": f"""WITH {_GENES}, g AS (SELECT gene_key, count(*) FILTER (allele_event = 'LossReference') AS k, count(*) FILTER (allele_event IN ('LossReference', 'LossVariant')) AS n FROM in_genes GROUP BY gene_key)
      SELECT gene_key, round(CASE WHEN n <= 0 OR k <= 0 THEN 1.0 ELSE {_TAIL.format(n='n', k='k')} END, 8) AS p_value FROM g""",
    "multi_event_genes": f"""WITH {_GENES} SELECT sample, gene_key, CAST(count(DISTINCT event) AS INTEGER) AS n_events, array_to_string(list_sort(list(DISTINCT event)), ';') AS events FROM in_genes GROUP BY sample, gene_key HAVING count(DISTINCT event) > 1""",
    "patients_per_event": f"""WITH {_GENES} SELECT gene_key, event, count(DISTINCT (sample, floor(cov_t * 4 / cov_n))) AS n_patient_cn, count(DISTINCT sample) AS n_patients FROM in_genes GROUP BY ALL""",
}
