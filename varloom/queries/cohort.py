"""Queries over regions, genes, call sets, markers, origins and the generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import genomics as G, stats as S
from ..operators import compare as M, enrichment as E, genes as N, gscore as K, origins as O, qc as Q, recurrence as R, simulate as U
from ..operators import classify as C, segment as X
from ..plans import intervals as I
from ..plans.cut import cut
from .sites import CALLED, CANONICAL, SITES, _called, _sites, pieces_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _regions(spark, sf_dir) -> DataFrame:
    """Delivered regions with chromosome codes, rows repeated under another id once."""
    t = _table(spark, sf_dir, "gistic_regions")
    t = t.select(F.col("sample_id").alias("patient"), G.chrom_code(F.col("chrom")).alias("chrom"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"),
                 "num_markers", "log2_ratio", F.coalesce("event_name", F.lit("NA")).alias("event"), "genes")
    return t.where("patient IS NOT NULL AND chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND start <= end").distinct()


def _genes(spark, sf_dir) -> DataFrame:
    t = _table(spark, sf_dir, "gene_locations")
    return t.select(F.col("symbol").alias("gene"), G.chrom_code(F.col("chrom")).alias("chrom"), F.col("start_pos").alias("g_start"), F.col("end_pos").alias("g_end")).where("chrom IS NOT NULL").distinct()


def _calls(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "gene_event_patient").select("gene", F.col("event_name").alias("event"), "patient")


def range_semi(spark, sf_dir):
    """Sites within any delivered region of their own sample."""
    r = _regions(spark, sf_dir).select(F.col("patient").alias("sample"), "chrom", "start", "end")
    return I.points_in_intervals(_sites(spark, sf_dir).select("sample", "chrom", "pos"), r, ["sample", "chrom"], "pos", "start", "end", "semi")


def range_anti(spark, sf_dir):
    r = _regions(spark, sf_dir).select(F.col("patient").alias("sample"), "chrom", "start", "end")
    return I.points_in_intervals(_sites(spark, sf_dir).select("sample", "chrom", "pos"), r, ["sample", "chrom"], "pos", "start", "end", "anti")


def point_in_region_counts(spark, sf_dir):
    r = _regions(spark, sf_dir).select(F.col("patient").alias("sample"), "chrom", "start", "end").distinct()
    j = I.points_in_intervals(_sites(spark, sf_dir).select("sample", "chrom", "pos"), r, ["sample", "chrom"], "pos", "start", "end")
    return j.groupBy("sample", "chrom", "start", "end").agg(F.count(F.lit(1)).alias("n"))


def region_filter(spark, sf_dir):
    """Regions that overlap any gene."""
    g = _genes(spark, sf_dir).select("chrom", F.col("g_start").alias("list_start"), F.col("g_end").alias("list_end"))
    r = _regions(spark, sf_dir).select("patient", "chrom", "start", "end", "event").distinct()
    return Q.overlaps_any(r, g, ["chrom"], "start", "end")


def region_genes(spark, sf_dir):
    """Number of genes that overlap each region and the bases they share."""
    r = _regions(spark, sf_dir).select("patient", "chrom", "start", "end").distinct()
    j = I.overlapping_intervals(r, _genes(spark, sf_dir), ["chrom"], ("start", "end"), ("g_start", "g_end"))
    return j.groupBy("patient", "chrom", "start", "end").agg(
        F.count(F.lit(1)).alias("n_genes"), F.sum(I.overlap_length(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end"))).alias("shared"))


def overlap_class(spark, sf_dir):
    """How each region lies to the next one of its patient."""
    r = _regions(spark, sf_dir).select("patient", "chrom", "start", "end").distinct()
    over = Window.partitionBy("patient").orderBy("chrom", "start", "end")
    n = r.select("*", *[F.lead(c).over(over).alias(f"next_{c}") for c in ("chrom", "start", "end")]).where("next_chrom IS NOT NULL")
    args = [F.col(c) for c in ("chrom", "start", "end", "next_chrom", "next_start", "next_end")]
    return n.groupBy(I.overlap_class(*args).alias("relation")).agg(F.count(F.lit(1)).alias("n"), F.max(I.interval_distance(*args)).alias("farthest"))


def region_overlap_join(spark, sf_dir):
    """Delivered regions against those segmented from the sites."""
    own = X.segments(_called(spark, sf_dir)).select(F.col("sample").alias("patient"), "chrom", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "event")
    return M.compare_regions(_regions(spark, sf_dir), own)


def region_union(spark, sf_dir):
    """Pieces of all patients' regions per event with recurrence."""
    r = _regions(spark, sf_dir).select("event", "chrom", "start", "end")
    return I.disjoin(r, ["event", "chrom"], "start", "end")


def splice_scores(spark, sf_dir):
    r = _regions(spark, sf_dir).where("log2_ratio IS NOT NULL AND NOT isnan(log2_ratio)").select("chrom", "start", "end", F.floor(F.col("log2_ratio") * 1000).alias("score"))
    return I.splice_scores(r, ["chrom"], "start", "end", "score")


def region_points(spark, sf_dir):
    return I.sample_points(_regions(spark, sf_dir).select("patient", "chrom", "start", "end").distinct(), "start", "end").groupBy("patient", "chrom").agg(
        F.count(F.lit(1)).alias("n"), F.sum("position").alias("total"))


def asof_floor(spark, sf_dir):
    """Each event with the value of its user's last purchase at or before it."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.round("value", 6).alias("value"))
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("bought")).groupBy("user_id", "ts").agg(F.max("bought").alias("bought"))
    secs = lambda d: d.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    return I.asof_floor(secs(e.select("event_id", "user_id", "ts")), secs(buys), ["user_id"], "ts", "bought", "bought", block=86_400_000_000).select("event_id", "bought")


def nearest_gene(spark, sf_dir):
    """Each delivered region's start with the nearest gene start of its chromosome."""
    r = _regions(spark, sf_dir).select("chrom", F.col("start").alias("at")).distinct()
    g = _genes(spark, sf_dir).groupBy("chrom", F.col("g_start").alias("at")).agg(F.min("gene").alias("gene"))
    return I.nearest(r, g, ["chrom"], "at", "gene")


def callset_compare(spark, sf_dir):
    other = N.gene_sites(_called(spark, sf_dir)).select(F.col("gene_key").alias("gene"), "event", F.col("sample").alias("patient"))
    return M.match_tallies(M.compare_calls(_calls(spark, sf_dir), other)).withColumn("match_fraction", F.round("match_fraction", 6))


def maf_annotate(spark, sf_dir):
    """Every row with the status of its position in the bias table."""
    bias = _table(spark, sf_dir, "allelic_bias").select(G.chrom_code(F.col("chrom")).alias("chrom"), F.col("pos").cast("int").alias("pos"), F.col("rsid").alias("status"), "n_samples")
    rows = Q.canonical_sites(_table(spark, sf_dir, "naf_taf_inputs")).select("site_id", "chrom", "pos", F.lit(None).cast("int").alias("n_samples"))
    return M.annotate_variants(rows, bias.where("chrom IS NOT NULL"), ["chrom", "pos"], "status", ["n_samples"], ["status", "n_samples"]).select("site_id", "status", "n_samples")


def confusion_metrics(spark, sf_dir):
    """Whole-number calls against calls of the tumor alone, taken as truth."""
    s = _called(spark, sf_dir)
    test = F.when(F.abs(2 * F.col("var_t") - F.col("cov_t")) * 4 > F.col("cov_t"), "LOH").otherwise("HETGermline")
    c = M.confusion(s.select("event", test.alias("test")), "event", "test")
    return c.select("event", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("sensitivity", "specificity", "ppv", "npv", "f1")])


_FLAGS = ["A", "N", "R"]


def _masks(spark, sf_dir):
    return M.caller_masks(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", _FLAGS)


def center_metrics(spark, sf_dir):
    m = M.caller_metrics(_masks(spark, sf_dir), 3)
    return m.select("least", "caller", "score", "calls", "confirmed", F.round("ppv", 6).alias("ppv"), F.round("sens", 6).alias("sens"), F.round("f1", 6).alias("f1"))


def superset_counts(spark, sf_dir):
    return M.superset_counts(_masks(spark, sf_dir))


def center_correlation(spark, sf_dir):
    c = M.caller_correlation(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", _FLAGS)
    return c.select("a", "b", F.round("r", 6).alias("r"))


def cooccurrence(spark, sf_dir):
    return N.co_occurrence(_calls(spark, sf_dir).where("event <> 'NA'"), "patient", "gene", "event", min_patients=3)


def _gene_values(spark, sf_dir):
    return _calls(spark, sf_dir).where("gene IS NOT NULL").groupBy("gene").agg(F.count(F.lit(1)).alias("value"))


def _roster(spark, sf_dir):
    return _calls(spark, sf_dir).where("gene IS NOT NULL AND event IS NOT NULL AND event <> 'NA'").select("gene", F.col("event").alias("pathway")).distinct()


def pathway_tau(spark, sf_dir):
    t = E.pathway_tau(_gene_values(spark, sf_dir), _roster(spark, sf_dir))
    return t.withColumn("tau", F.round("tau", 6))


def term_counts(spark, sf_dir):
    return E.term_counts(_gene_values(spark, sf_dir), _roster(spark, sf_dir).withColumnRenamed("pathway", "term"))


def term_fold(spark, sf_dir):
    genes, terms = _gene_values(spark, sf_dir), _roster(spark, sf_dir).withColumnRenamed("pathway", "term")
    top = E.top_genes(genes, "value", 20)
    f = E.term_fold(E.term_counts(top, terms), E.term_counts(genes, terms))
    return f.withColumn("fold", F.round("fold", 6))


def pathway_scores(spark, sf_dir):
    return E.pathway_scores(_gene_values(spark, sf_dir), _roster(spark, sf_dir), "value")


def top20(spark, sf_dir):
    """The report of the twenty genes with most rows."""
    return E.top_genes(_gene_values(spark, sf_dir), "value", 20)


def _markers(spark, sf_dir) -> DataFrame:
    """Values of the delivered segments at the genes' starts, the largest where segments overlap."""
    seg = _regions(spark, sf_dir).where("log2_ratio IS NOT NULL AND NOT isnan(log2_ratio)").groupBy("patient", "chrom", "start").agg(F.max("end").alias("end"), F.max("log2_ratio").alias("value"))
    probes = _genes(spark, sf_dir).groupBy("chrom", F.col("g_start").alias("pos")).agg(F.min("gene").alias("marker"))
    m = K.segments_to_markers(seg.withColumnRenamed("patient", "sample"), probes)
    return cut(m.groupBy("sample", "marker", "chrom", "pos").agg(F.max("value").alias("value")))


def seg_to_marker(spark, sf_dir):
    return _markers(spark, sf_dir)


def marker_to_seg(spark, sf_dir):
    m = _markers(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 10))
    return K.markers_to_segments(m)


def arm_median_thresholds(spark, sf_dir):
    return K.focal_thresholds(_markers(spark, sf_dir))


def gscore(spark, sf_dir):
    return K.g_scores(K.contributions(_markers(spark, sf_dir)))


def qvalue_monotone(spark, sf_dir):
    """q-values of the G-scores under the convolved null."""
    parts = cut(K.contributions(_markers(spark, sf_dir)))
    q = K.q_values(K.g_scores(parts), K.null_distribution(parts))
    return q.select("type", "g", "n", F.round("p", 9).alias("p"), "rank", F.round("q", 9).alias("q"))


def equal_g_runs(spark, sf_dir):
    return K.runs_of_equal_g(K.g_scores(K.contributions(_markers(spark, sf_dir))))


def strength_matrix(spark, sf_dir):
    """Majority strength of gains (AMP) and of losses (DEL) per chromosome arm of each sample."""
    m = _markers(spark, sf_dir)
    # some genes lie beyond build 38's length of their chromosome: the long arm reaches to the last marker
    dim = G.chrom_dim(spark).join(F.broadcast(m.groupBy(F.col("chrom").alias("code")).agg(F.max("pos").alias("last"))), "code")
    arm = lambda name, start, end: dim.select(F.concat(F.col("code").cast("string"), F.lit(name)).alias("region"), F.col("code").alias("chrom"), start.alias("start"), end.alias("end"))
    arms = arm("p", F.lit(0).cast("bigint"), F.col("p_arm") - 1).union(arm("q", F.col("p_arm"), F.greatest("length", "last")))
    out = [K.region_strength(m, arms, t).select(F.lit(t).alias("type"), "region", "sample", "strength", F.round("mean", 10).alias("mean")) for t in ("AMP", "DEL")]
    return out[0].union(out[1])


def gene_matrix(spark, sf_dir):
    genes = _genes(spark, sf_dir).select("gene", "chrom", F.col("g_start").alias("start"), F.col("g_end").alias("end"))
    return K.gene_calls(_markers(spark, sf_dir), genes)


def regulator_sets(spark, sf_dir):
    r = _regions(spark, sf_dir).where("genes IS NOT NULL AND genes <> ''")
    rows = r.select(F.when(F.col("event").startswith("Gain"), "AMP").otherwise("DEL").alias("aberration"), F.explode(F.split("genes", ";")).alias("gene"),
                    F.least(F.lit(3), 1 + F.floor(F.coalesce("num_markers", F.lit(0)) / 20)).cast("int").alias("class"))
    return M.regulator_sets(rows.where("gene <> ''"))


def region_neighbours(spark, sf_dir):
    """Genes that overlap each region and the nearest ones within 100 kb on either side."""
    r = _regions(spark, sf_dir).select("patient", "chrom", "start", "end")
    n = I.neighbours_of_intervals(r, _genes(spark, sf_dir), ["chrom"], ("start", "end"), ("g_start", "g_end"))
    return n.select("patient", "chrom", "start", "end", "gene", "distance")


def gene_markers(spark, sf_dir):
    """Markers within each gene, else the next one: positions known to the bias table."""
    probes = _table(spark, sf_dir, "allelic_bias").select(G.chrom_code(F.col("chrom")).alias("chrom"), "pos").where("chrom IS NOT NULL AND pos IS NOT NULL").distinct()
    return I.markers_of_intervals(_genes(spark, sf_dir), probes, ["chrom"], "g_start", "g_end", "pos").select("gene", "chrom", "g_start", "pos")


def purity(spark, sf_dir):
    return C.purity_estimate(_called(spark, sf_dir)).withColumn("purity", F.round("purity", 6))


def fisher_exact(spark, sf_dir):
    """Returned against kept, by open and closed lines of each supplier."""
    li = _table(spark, sf_dir, "lineitem")
    r, o = F.col("l_returnflag") == "R", F.col("l_quantity") > 25
    t = li.groupBy("l_suppkey").agg(F.count_if(r & o).alias("a"), F.count_if(r & ~o).alias("b"), F.count_if(~r & o).alias("c"), F.count_if(~r & ~o).alias("d"))
    t = t.withColumn("p", S.fisher_of("a", "b", "c", "d"))
    return t.select("l_suppkey", "a", "b", "c", "d", *[F.round(F.col(f"p.{c}"), 8).alias(c) for c in ("p_left", "p_right", "p_two")])


def _mutations(spark, sf_dir) -> DataFrame:
    return _sites(spark, sf_dir).select("sample", "chrom", "pos", (F.col("ref").isin("A", "T") != F.col("alt").isin("A", "C")).alias("forward"))


def _windows(spark, sf_dir) -> DataFrame:
    return O.count_windows(_mutations(spark, sf_dir), ["sample", "chrom"], ["pos"], "forward", "pos")


def count_window20(spark, sf_dir):
    return _windows(spark, sf_dir).withColumn("signed_p", F.round("signed_p", 8))


def track_state(spark, sf_dir):
    return O.track_states(_windows(spark, sf_dir), ["sample", "chrom"], ["pos"]).select("sample", "chrom", "pos", "state")


def origins(spark, sf_dir):
    return O.find_origins(_mutations(spark, sf_dir))


def recurrent_origins(spark, sf_dir):
    return O.recurrent_origins(origins(spark, sf_dir), 3)


def spline(spark, sf_dir):
    return O.spline_track(_windows(spark, sf_dir), O.origin_marks(_mutations(spark, sf_dir))).select("sample", "chrom", "pos", F.round("smooth", 6).alias("smooth"))


def permutation_pvalue(spark, sf_dir):
    m = _mutations(spark, sf_dir).withColumn("marked", F.col("forward").cast("int"))
    return O.permuted_distances(m).groupBy("sample", "chrom", "distance_class").agg(F.sum("n").alias("n"))


def inter_event_distance(spark, sf_dir):
    s = _called(spark, sf_dir).where("event = 'LOH'").select("sample", "chrom", F.col("pos").alias("start"), F.col("pos").alias("end"))
    return O.inter_distance(s, ["sample", "chrom"], "start", "end").select("sample", "chrom", "start", "distance", F.col("distance_class").cast("double").alias("distance_class"))


def bucket_cumulative(spark, sf_dir):
    """Forward and backward cumulative counts and shares of discounts per return flag."""
    c = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_discount") * 100 + 0.5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return R.cumulative(c, ["l_returnflag"], "bucket").withColumns({x: F.round(x, 6) for x in ("share", "share_upto")})


def sigfig_hist(spark, sf_dir):
    x = F.col("l_extendedprice")
    return _table(spark, sf_dir, "lineitem").groupBy(G.significant(x, 1).alias("price")).agg(F.count(F.lit(1)).alias("n"))


def horizontal_concat(spark, sf_dir):
    """Nations and regions side by side by key."""
    a = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line_no"), "n_name")
    b = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("line_no"), "r_name")
    return M.paste([a, b])


def matrix_union(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    a = li.groupBy(F.col("l_suppkey").alias("row"), F.col("l_returnflag").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    b = li.groupBy(F.col("l_suppkey").alias("row"), F.col("l_linestatus").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return M.matrix_union(a, b, "row", "col", "n").groupBy("row").pivot("col", ["A", "F", "N", "O", "R"]).agg(F.first("n")).na.fill(0)


def regression(spark, sf_dir):
    """Fit of a line to each supplier's sorted prices."""
    fit = X.fit_r2(_table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("double").alias("x")), ["l_suppkey"], "x")
    return fit.select("l_suppkey", F.round("r2", 6).alias("r2"), F.round(F.col("sse") / 1e6, 4).alias("sse"))


def event_runs(spark, sf_dir):
    """Runs of one event type per user, in order of time."""
    e = _table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return I.collapse_islands(e, ["user_id"], "us", ["event_type"], ("event_id",))


def consecutive_duplicates(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return Q.consecutive_duplicates(e, ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


def mutation_permutation(spark, sf_dir):
    """p of the most frequent genes' mutation frequency among all genes with a length: a million seeded trials."""
    lengths = _genes(spark, sf_dir).groupBy("gene").agg(F.max(F.col("g_end") - F.col("g_start") + 1).alias("length"))
    rows = lengths.join(_gene_values(spark, sf_dir), "gene").where("length > 0").orderBy("gene").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("genes are a dimension; more than 100,000 are not")
    per = [r["value"] / r["length"] for r in rows]
    return M.mutation_permutation(spark, [r["length"] for r in rows], [r["value"] for r in rows], 20, sorted(per)[-20])


def _simulated(spark, sf_dir) -> DataFrame:
    """As many simulated samples as the input has, each with as many sites, spread evenly over 22 chromosomes."""
    n = {r["sample"]: -(-r["count"] // 22) for r in _sites(spark, sf_dir).groupBy("sample").count().collect()}
    return U.simulate_cohort(spark, sorted(n), n)


def simulated_cohort(spark, sf_dir):
    """Simulated samples through the full caller (events, then regions), scored against their truth."""
    sim = cut(_simulated(spark, sf_dir))
    bias = spark.createDataFrame([], "chrom int, pos bigint, n_samples int, avg_vaf_n double, avg_abs_cn double")
    sites = sim.drop("truth").withColumns({"gene": F.lit("."), "line_no": F.lit(1), "site_id": F.lit(1)})
    called = X.call_regions(C.call_events(C.prepare_sites(sites, bias, True)))
    return M.confusion(sim.select("sample", "chrom", "pos", "truth").join(called.select("sample", "chrom", "pos", "event"), ["sample", "chrom", "pos"]), "truth", "event")


QUERIES = {f.__name__: f for f in (
    range_semi, range_anti, point_in_region_counts, region_filter, region_genes, overlap_class, region_overlap_join, region_union, splice_scores, region_points,
    asof_floor, nearest_gene, callset_compare, maf_annotate, confusion_metrics, center_metrics, superset_counts, center_correlation, cooccurrence, pathway_tau,
    term_counts, term_fold, pathway_scores, top20, seg_to_marker, marker_to_seg, arm_median_thresholds, gscore, qvalue_monotone,
    equal_g_runs, strength_matrix, gene_matrix, regulator_sets, region_neighbours, gene_markers, purity, fisher_exact, count_window20, track_state, origins, recurrent_origins, spline, permutation_pvalue,
    inter_event_distance, bucket_cumulative, sigfig_hist, horizontal_concat, matrix_union, regression, event_runs, consecutive_duplicates, mutation_permutation, simulated_cohort)}

_CHROM = """CASE WHEN starts_with(b, 'x') THEN 23 WHEN starts_with(b, 'y') THEN 24 WHEN starts_with(b, 'm') THEN 25
    WHEN regexp_full_match(b, '[0-9]+') AND try_cast(b AS INTEGER) BETWEEN 0 AND 25 THEN try_cast(b AS INTEGER) END"""
_BARE = "(SELECT *, regexp_replace(lower(trim(chrom)), '^(chr_|chr|c)', '') AS b FROM {0})"
_REGIONS = f"""delivered AS (SELECT DISTINCT sample_id AS patient, {_CHROM} AS chrom, start_pos AS start, end_pos AS "end", num_markers, log2_ratio, coalesce(event_name, 'NA') AS event, genes
  FROM {_BARE.format('gistic_regions')} WHERE sample_id IS NOT NULL AND ({_CHROM}) IS NOT NULL AND start_pos <= end_pos)"""
_GENE = f"genes AS (SELECT DISTINCT symbol AS gene, {_CHROM} AS chrom, start_pos AS g_start, end_pos AS g_end FROM {_BARE.format('gene_locations')} WHERE ({_CHROM}) IS NOT NULL)"
_IN = 's.sample = r.patient AND s.chrom = r.chrom AND s.pos BETWEEN r.start AND r."end"'
_VALUES = "vals AS (SELECT gene, count(*) AS value FROM gene_event_patient WHERE gene IS NOT NULL GROUP BY gene), roster AS (SELECT DISTINCT gene, event_name AS pathway FROM gene_event_patient WHERE gene IS NOT NULL AND event_name IS NOT NULL AND event_name <> 'NA')"
_MARKERS = f"""{_REGIONS}, {_GENE},
seg AS (SELECT patient, chrom, start, max("end") AS "end", max(log2_ratio) AS value FROM delivered WHERE log2_ratio IS NOT NULL AND NOT isnan(log2_ratio) GROUP BY patient, chrom, start),
filled AS (SELECT patient, chrom, value, CASE WHEN lag("end") OVER w IS NULL THEN start ELSE CAST(floor((lag("end") OVER w + start) / 2) AS BIGINT) + 1 END AS lo,
  CASE WHEN lead(start) OVER w IS NULL THEN "end" ELSE CAST(floor(("end" + lead(start) OVER w) / 2) AS BIGINT) END AS hi FROM seg WINDOW w AS (PARTITION BY patient, chrom ORDER BY start)),
probes AS (SELECT chrom, g_start AS pos, min(gene) AS marker FROM genes GROUP BY chrom, g_start),
markers AS (SELECT f.patient AS sample, p.marker, p.chrom, p.pos, max(f.value) AS value FROM filled f JOIN probes p ON f.chrom = p.chrom AND p.pos BETWEEN f.lo AND f.hi AND f.lo <= f.hi GROUP BY ALL)"""
_PARTS = f"""{_MARKERS}, capped AS (SELECT *, greatest(least(value, 1.5), -1.5) AS v FROM markers),
parts AS (SELECT 'AMP' AS type, marker, chrom, pos, sample, CASE WHEN v > 0.3 THEN CAST(floor(v / 0.001 + 0.5) AS BIGINT) ELSE 0 END AS score FROM capped
  UNION ALL SELECT 'DEL', marker, chrom, pos, sample, CASE WHEN v < -0.3 THEN -CAST(floor(v / 0.001 + 0.5) AS BIGINT) ELSE 0 END FROM capped),
g AS (SELECT type, marker, chrom, pos, CAST(sum(score) AS BIGINT) AS g FROM parts GROUP BY ALL)"""
_MASKS = "masks AS (SELECT mask, count(*) AS n FROM (SELECT l_orderkey, bit_or(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 4 END) AS mask FROM lineitem GROUP BY l_orderkey) GROUP BY mask)"
_MUT = f"{SITES}, muts AS (SELECT sample, chrom, pos, (ref IN ('A', 'T')) <> (alt IN ('A', 'C')) AS forward FROM sites)"
_TAILN = "least(list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)))), 1.0)"
_WIN = f"""{_MUT}, w20 AS (SELECT *, row_number() OVER o AS r, lead(pos) OVER o IS NULL AS is_last, count(*) OVER w AS n, CAST(sum(CASE WHEN forward THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_forward, list(pos) OVER w AS near
  FROM muts WINDOW o AS (PARTITION BY sample, chrom ORDER BY pos), w AS (PARTITION BY sample, chrom ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
windows AS (SELECT sample, chrom, pos, n, n_forward, (CASE WHEN 2 * n_forward >= n THEN 1.0 ELSE -1.0 END) * {_TAILN.format(k='greatest(n_forward, n - n_forward)', n='n')} AS signed_p,
  near[CAST(floor((n + 1) / 2) AS BIGINT)] AS mid_start, near[CAST(floor(n / 2) AS BIGINT) + 1] AS mid_end FROM w20 WHERE r >= 20 OR is_last)"""
_NODES = """t AS (SELECT DISTINCT patient, lower(trim(gene)) AS gene, trim(event_name) AS event FROM gene_event_patient WHERE patient IS NOT NULL AND gene IS NOT NULL AND event_name IS NOT NULL AND event_name <> 'NA'),
  k AS (SELECT gene, event FROM t GROUP BY ALL HAVING count(*) >= 3), x AS (SELECT t.*, gene || chr(1) || event AS node FROM t JOIN k USING (gene, event))"""
_PFISH = "exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma({x} + 1) - lgamma(a + b - {x} + 1) - lgamma(a + c - {x} + 1) - lgamma(d - a + {x} + 1))"

ORACLES = {
    "range_semi": f"WITH {SITES}, {_REGIONS} SELECT sample, chrom, pos FROM sites s WHERE EXISTS (SELECT 1 FROM delivered r WHERE {_IN})",
    "range_anti": f"WITH {SITES}, {_REGIONS} SELECT sample, chrom, pos FROM sites s WHERE NOT EXISTS (SELECT 1 FROM delivered r WHERE {_IN})",
    "point_in_region_counts": f"""WITH {SITES}, {_REGIONS}, u AS (SELECT DISTINCT patient, chrom, start, "end" FROM delivered)
      SELECT s.sample, r.chrom, r.start, r."end", count(*) AS n FROM sites s JOIN u r ON {_IN} GROUP BY ALL""",
    "region_filter": f"""WITH {_REGIONS}, {_GENE} SELECT DISTINCT patient, chrom, start, "end", event FROM delivered r WHERE EXISTS (SELECT 1 FROM genes g WHERE g.chrom = r.chrom AND r.start <= g_end AND g_start <= r."end")""",
    "region_genes": f"""WITH {_REGIONS}, {_GENE}, u AS (SELECT DISTINCT patient, chrom, start, "end" FROM delivered)
      SELECT patient, r.chrom, start, "end", count(*) AS n_genes, CAST(sum(least("end", g_end) - greatest(start, g_start) + 1) AS BIGINT) AS shared
      FROM u r JOIN genes g ON g.chrom = r.chrom AND r.start <= g_end AND g_start <= r."end" GROUP BY ALL""",
    "overlap_class": f"""WITH {_REGIONS}, u AS (SELECT DISTINCT patient, chrom AS c1, start AS s1, "end" AS e1 FROM delivered),
      n AS (SELECT *, lead(c1) OVER w AS c2, lead(s1) OVER w AS s2, lead(e1) OVER w AS e2 FROM u WINDOW w AS (PARTITION BY patient ORDER BY c1, s1, e1))
      SELECT CASE WHEN c1 < c2 THEN 'BeforeViaDiffChromosome' WHEN c1 > c2 THEN 'AfterViaDiffChromosome'
        WHEN s1 = s2 THEN CASE WHEN e1 = e2 THEN 'Equals' WHEN e1 < e2 THEN 'ConsumedByAlignedLeft' ELSE 'SubsumesAlignedLeft' END
        WHEN s1 < s2 THEN CASE WHEN e1 = e2 THEN 'SubsumesAlignedRight' WHEN e1 > e2 THEN 'SubsumesTotal' WHEN e1 >= s2 THEN 'BeforeWithOverlap' WHEN s2 - e1 = 1 THEN 'AdjacentBefore' ELSE 'BeforeWithoutOverlap' END
        ELSE CASE WHEN e1 = e2 THEN 'ConsumedByAlignedRight' WHEN e1 < e2 THEN 'ConsumedByTotal' WHEN s1 <= e2 THEN 'AfterWithOverlap' WHEN s1 - e2 = 1 THEN 'AdjacentAfter' ELSE 'AfterWithoutOverlap' END END AS relation,
        count(*) AS n, max(CASE WHEN c1 <> c2 THEN 2147483647 ELSE greatest(s1 - e2, s2 - e1, 0) END) AS farthest FROM n WHERE c2 IS NOT NULL GROUP BY 1""",
    "region_overlap_join": f"""WITH {CALLED}, valid AS (SELECT sample, chrom, pos, min(event) AS event FROM called WHERE event NOT IN ('Noise', 'Ignored', 'HETSomatic') GROUP BY sample, chrom, pos),
      changes AS (SELECT *, CASE WHEN event = lag(event) OVER w THEN 0 ELSE 1 END AS brk FROM valid WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)),
      runs AS (SELECT *, sum(brk) OVER (PARTITION BY sample, chrom ORDER BY pos) AS run FROM changes),
      own AS (SELECT sample, chrom, event, min(pos) AS start, max(pos) AS "end" FROM runs GROUP BY sample, chrom, event, run), {_REGIONS},
      a AS (SELECT DISTINCT patient, chrom, start, "end", event FROM delivered)
      SELECT a.patient, a.chrom, a.start, a."end", a.event, count(b.event) AS n_overlap,
        count(*) FILTER ((a.event = 'LOH' AND b.event IN ('LOH', 'DELHom')) OR (a.event IN ('GainSomatic', 'GainGermline') AND b.event IN ('GainSomatic', 'GainGermline')) OR a.event = b.event) AS n_agree,
        coalesce(bool_or(b.event = 'GainGermline'), false) AS germline
      FROM a LEFT JOIN own b ON a.patient = b.sample AND a.chrom = b.chrom AND a.start <= b."end" AND b.start <= a."end" GROUP BY a.patient, a.chrom, a.start, a."end", a.event""",
    "region_union": f"WITH {_REGIONS}, {pieces_sql('delivered', 'event, chrom')} SELECT * FROM pieces",
    "splice_scores": f"""WITH {_REGIONS}, sc AS (SELECT chrom, start, "end", CAST(floor(log2_ratio * 1000) AS BIGINT) AS score FROM delivered WHERE log2_ratio IS NOT NULL AND NOT isnan(log2_ratio)), {pieces_sql('sc', 'chrom')}
      SELECT p.chrom, p.start, p."end", p.recurrence, max(s.score) AS max_score, CAST(sum(s.score) AS BIGINT) AS sum_score, count(*) AS depth FROM pieces p JOIN sc s ON p.chrom = s.chrom AND p.start BETWEEN s.start AND s."end" GROUP BY ALL""",
    "region_points": f"""WITH {_REGIONS}, u AS (SELECT DISTINCT patient, chrom, start, "end" FROM delivered),
      p AS (SELECT patient, chrom, unnest(range(start, "end" + 1, greatest(CAST(floor(("end" - start) / 20) AS BIGINT), 1))) AS position FROM u)
      SELECT patient, chrom, count(*) AS n, CAST(sum(position) AS BIGINT) AS total FROM p GROUP BY ALL""",
    "asof_floor": """SELECT e.event_id, b.bought FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(round(value, 6)) AS bought FROM events WHERE event_type = 'purchase' GROUP BY ALL) b
      ON e.user_id = b.user_id AND e.ts >= b.ts""",
    "nearest_gene": f"""WITH {_REGIONS}, {_GENE}, r AS (SELECT DISTINCT chrom, start AS at_pos FROM delivered), g AS (SELECT chrom, g_start AS gp, min(gene) AS gene FROM genes GROUP BY ALL)
      SELECT r.chrom, r.at_pos AS "at", arg_min(g.gene, abs(gp - at_pos) * 2 + CASE WHEN gp > at_pos THEN 1 ELSE 0 END) AS gene, min(abs(gp - at_pos)) AS distance FROM r LEFT JOIN g ON r.chrom = g.chrom GROUP BY r.chrom, r.at_pos""",
    "callset_compare": f"""WITH {CALLED}, other AS (SELECT lower(gene) AS g, lower(sample) AS p, min(event) AS other_event FROM called WHERE lower(gene) NOT IN ('', '.') AND event NOT IN ('Noise', 'Ignored', 'HETGermline') GROUP BY ALL),
      own AS (SELECT gene, patient, CASE WHEN event_name IS NULL OR event_name = 'NA' THEN 'Ignored' ELSE event_name END AS e FROM gene_event_patient WHERE gene IS NOT NULL AND patient IS NOT NULL),
      m AS (SELECT lower(gene) AS gene, CASE WHEN other_event IS NULL THEN CASE WHEN e <> 'Ignored' THEN 'MismatchCallNoCall' ELSE 'MatchNoCall' END WHEN e = other_event THEN 'MatchCall'
        WHEN e = 'Ignored' THEN 'MismatchNoCallCall' ELSE 'MismatchCallDiffCall' END AS match FROM own LEFT JOIN other ON lower(gene) = g AND lower(patient) = p),
      c AS (SELECT gene, """ + ", ".join(f"count(*) FILTER (match = '{m}') AS {m}" for m in M.MATCHES) + """ FROM m GROUP BY gene)
      SELECT *, MatchCall + MatchNoCall AS n_match, MismatchCallDiffCall + MismatchCallNoCall + MismatchNoCallCall AS n_mismatch,
        round(CASE WHEN MatchCall + MismatchCallDiffCall + MismatchCallNoCall > 0 THEN MatchCall / (MatchCall + MismatchCallDiffCall + MismatchCallNoCall) END, 6) AS match_fraction FROM c""",
    "maf_annotate": f"""WITH {CANONICAL}, v AS (SELECT {_CHROM} AS chrom, CAST(pos AS INTEGER) AS pos, rsid, n_samples FROM {_BARE.format('allelic_bias')} WHERE ({_CHROM}) IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY ({_CHROM}), pos ORDER BY rsid NULLS FIRST, n_samples NULLS FIRST) = 1)
      SELECT site_id, CASE WHEN v.pos IS NOT NULL THEN rsid ELSE 'DeNovo' END AS status, v.n_samples FROM canonical c LEFT JOIN v ON c.chrom = v.chrom AND c.pos = v.pos""",
    "confusion_metrics": f"""WITH {CALLED}, q AS (SELECT event AS t, CASE WHEN abs(2 * var_t - cov_t) * 4 > cov_t THEN 'LOH' ELSE 'HETGermline' END AS p FROM called),
      c AS (SELECT t, p, count(*) AS n FROM q WHERE NOT (t = 'GainGermline' AND p = 'Ignored') GROUP BY ALL), e AS (SELECT t AS event FROM c UNION SELECT p FROM c),
      x AS (SELECT event, CAST(coalesce(sum(n) FILTER (t = event AND p = event), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (t <> event AND p = event), 0) AS BIGINT) AS fp,
        CAST(coalesce(sum(n) FILTER (t = event AND p <> event), 0) AS BIGINT) AS fn, CAST(coalesce(sum(n) FILTER (t <> event AND p <> event), 0) AS BIGINT) AS tn FROM e CROSS JOIN c GROUP BY event)
      SELECT *, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS sensitivity, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 6) AS specificity, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS ppv,
        round(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END, 6) AS npv, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM x""",
    "center_metrics": f"""WITH {_MASKS}, r AS (SELECT l.least, c.caller, n, (mask >> c.caller) & 1 = 1 AS has, bit_count(mask) >= l.least AS ok FROM masks, (VALUES (1), (2), (3)) l(least), (VALUES (0), (1), (2)) c(caller)),
      s AS (SELECT least, caller, CAST(coalesce(sum(n) FILTER (has AND ok), 0) AS BIGINT) AS score, CAST(coalesce(sum(n) FILTER (has), 0) AS BIGINT) AS calls, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS confirmed FROM r GROUP BY ALL),
      f AS (SELECT *, CASE WHEN calls > 0 THEN score / calls END AS ppv, CASE WHEN confirmed > 0 THEN score / confirmed END AS sens FROM s)
      SELECT least, caller, score, calls, confirmed, round(ppv, 6) AS ppv, round(sens, 6) AS sens, round(CASE WHEN ppv + sens > 0 THEN 2 * ppv * sens / (ppv + sens) END, 6) AS f1 FROM f""",
    "superset_counts": f"WITH {_MASKS} SELECT a.mask AS subset, CAST(sum(b.n) AS BIGINT) AS n_including FROM masks a JOIN masks b ON (a.mask & b.mask) = a.mask GROUP BY a.mask",
    "center_correlation": """WITH w AS (SELECT l_orderkey, max(CAST(l_returnflag = 'A' AS INT)) AS a, max(CAST(l_returnflag = 'N' AS INT)) AS n, max(CAST(l_returnflag = 'R' AS INT)) AS r FROM lineitem GROUP BY l_orderkey)
      SELECT 'A' AS a, 'N' AS b, round(corr(a, n), 6) AS r FROM w UNION ALL SELECT 'A', 'R', round(corr(a, r), 6) FROM w UNION ALL SELECT 'N', 'R', round(corr(n, r), 6) FROM w""",
    "cooccurrence": f"""WITH {_NODES} SELECT a.gene AS gene1, a.event AS event1, b.gene AS gene2, b.event AS event2, count(*) AS n_patients FROM x a JOIN x b ON a.patient = b.patient AND a.node < b.node
      GROUP BY ALL HAVING count(*) >= 3""",
    "pathway_tau": f"""WITH {_VALUES}, m AS (SELECT *, CASE WHEN value >= avg(value) OVER () THEN 1 ELSE 0 END AS high, count(*) OVER () AS x, FROM vals), t AS (SELECT CAST(sum(high) AS BIGINT) AS g_x FROM m)
      SELECT pathway, CAST(sum(high) AS BIGINT) AS g_p, count(*) AS p, g_x, x, round(sum(high) * x / (g_x * count(*)), 6) AS tau FROM roster JOIN m USING (gene), t GROUP BY pathway, g_x, x""",
    "term_counts": f"WITH {_VALUES} SELECT pathway AS term, count(*) AS n FROM roster JOIN vals USING (gene) GROUP BY pathway",
    "term_fold": f"""WITH {_VALUES}, top AS (SELECT gene FROM vals WHERE gene <> '.' ORDER BY value DESC, gene LIMIT 20), a AS (SELECT pathway AS term, count(*) AS n_all FROM roster GROUP BY pathway),
      b AS (SELECT pathway AS term, count(*) AS n_top FROM roster JOIN top USING (gene) GROUP BY pathway) SELECT term, n_top, n_all, round(n_top / n_all, 6) AS fold FROM a JOIN b USING (term)""",
    "pathway_scores": f"WITH {_VALUES} SELECT pathway, array_to_string(list_sort(list(gene || ':' || CAST(value AS VARCHAR))), ';') AS scores FROM roster JOIN vals USING (gene) GROUP BY pathway",
    "top20": f"WITH {_VALUES} SELECT gene, value FROM vals WHERE gene <> '.' ORDER BY value DESC, gene LIMIT 20",
    "seg_to_marker": f"WITH {_MARKERS} SELECT * FROM markers",
    "marker_to_seg": f"""WITH {_MARKERS}, v AS (SELECT sample, chrom, pos, CAST(floor(value * 10) AS BIGINT) AS value FROM markers),
      c AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS brk FROM v WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)),
      i AS (SELECT *, sum(brk) OVER (PARTITION BY sample, chrom ORDER BY pos) AS run FROM c)
      SELECT sample, chrom, value, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM i GROUP BY sample, chrom, value, run""",
    "arm_median_thresholds": f"""WITH {_MARKERS}, a AS (SELECT *, CASE chrom """ + " ".join(f"WHEN {i} THEN pos >= {x}" for i, x in enumerate(G.SHORT_ARMS, 1)) + f""" END AS q FROM markers),
      r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY sample, chrom, q ORDER BY value, marker) AS rn FROM a WINDOW w AS (PARTITION BY sample, chrom, q))
      SELECT sample, max(value) AS high, min(value) AS low FROM r WHERE rn = n // 2 + 1 GROUP BY sample""",
    "gscore": f"WITH {_PARTS} SELECT * FROM g",
    "equal_g_runs": f"""WITH {_PARTS}, c AS (SELECT *, CASE WHEN g = lag(g) OVER w THEN 0 ELSE 1 END AS brk FROM g WINDOW w AS (PARTITION BY type, chrom ORDER BY pos)),
      i AS (SELECT *, sum(brk) OVER (PARTITION BY type, chrom ORDER BY pos) AS run FROM c) SELECT type, chrom, g, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM i GROUP BY type, chrom, g, run""",
    "strength_matrix": f"""WITH {_MARKERS}, a AS (SELECT *, CASE chrom """ + " ".join(f"WHEN {i} THEN CASE WHEN pos >= {x} THEN 'q' ELSE 'p' END" for i, x in enumerate(G.SHORT_ARMS, 1)) + """ END AS arm FROM markers),
      s AS (SELECT *, 'AMP' AS type, CASE WHEN value > 0.9 THEN 2 WHEN value > 0.3 THEN 1 ELSE 0 END AS s FROM a
        UNION ALL SELECT *, 'DEL', CASE WHEN value < -1.3 THEN 2 WHEN value < -0.3 THEN 1 ELSE 0 END FROM a)
      SELECT type, CAST(chrom AS VARCHAR) || arm AS region, sample, CASE WHEN count(*) FILTER (s = 2) > count(*) / 2 THEN 2 WHEN count(*) FILTER (s = 0) >= (count(*) + 1) / 2 THEN 0 ELSE 1 END AS strength,
        round(avg(value), 10) AS mean FROM s WHERE arm IS NOT NULL GROUP BY type, chrom, arm, sample""",
    "gene_matrix": f"""WITH {_MARKERS}, m AS (SELECT g.gene, k.sample, min(k.value) AS value FROM markers k JOIN genes g ON g.chrom = k.chrom AND k.pos BETWEEN g.g_start AND g.g_end GROUP BY ALL),
      c AS (SELECT *, CASE WHEN value > 0.3 THEN 'A' WHEN value < -0.3 THEN 'D' ELSE 'N' END AS call FROM m) SELECT * FROM c WHERE gene IN (SELECT gene FROM c WHERE call <> 'N')""",
    "regulator_sets": f"""WITH {_REGIONS}, e AS (SELECT CASE WHEN starts_with(event, 'Gain') THEN 'AMP' ELSE 'DEL' END AS aberration, unnest(string_split(genes, ';')) AS gene,
        least(3, 1 + floor(coalesce(num_markers, 0) / 20)) AS class FROM delivered WHERE genes IS NOT NULL AND genes <> ''),
      b AS (SELECT aberration, gene, max(class) AS class FROM e WHERE gene <> '' GROUP BY ALL), u AS (SELECT * FROM b UNION ALL SELECT 'ALL', gene, max(class) FROM b GROUP BY gene)
      SELECT aberration, gene, 'Broad' AS "set" FROM u UNION ALL SELECT aberration, gene, 'NonBroad' FROM u WHERE class >= 2 UNION ALL SELECT aberration, gene, 'Peak' FROM u WHERE class >= 3""",
    "region_neighbours": f"""WITH {_REGIONS}, {_GENE}, u AS (SELECT DISTINCT patient, chrom, start, "end" FROM delivered),
      j AS (SELECT u.*, gene, CASE WHEN g_start > "end" THEN 1 WHEN g_end < start THEN -1 ELSE 0 END AS side, greatest(g_start - "end", start - g_end, 0) AS distance
        FROM u JOIN genes g ON u.chrom = g.chrom WHERE greatest(g_start - "end", start - g_end, 0) < 100000)
      SELECT patient, chrom, start, "end", gene, distance FROM j QUALIFY distance = min(distance) OVER (PARTITION BY patient, chrom, start, "end", side)""",
    "gene_markers": f"""WITH {_GENE}, m AS (SELECT DISTINCT {_CHROM} AS chrom, pos FROM {_BARE.format('allelic_bias')} WHERE ({_CHROM}) IS NOT NULL AND pos IS NOT NULL),
      i AS (SELECT gene, g.chrom, g_start, g_end, pos FROM genes g JOIN m ON g.chrom = m.chrom AND pos BETWEEN g_start AND g_end),
      l AS (SELECT g.gene, g.chrom, g.g_start, g.g_end, coalesce(min(pos) FILTER (pos >= g_start), max(pos)) AS pos FROM genes g JOIN m ON g.chrom = m.chrom
        WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.gene = g.gene AND i.chrom = g.chrom AND i.g_start = g.g_start AND i.g_end = g.g_end) GROUP BY ALL)
      SELECT gene, chrom, g_start, pos FROM i UNION ALL SELECT gene, chrom, g_start, pos FROM l""",
    "purity": f"""WITH {CALLED}, m AS (SELECT sample, event, avg(greatest(var_t / cov_t, 1 - var_t / cov_t)) AS v, count(*) AS n FROM called
        WHERE event IN ('LOH', 'cnLOH') AND (100 * var_n > 10 * cov_n AND 100 * var_n <= 90 * cov_n AND cov_n > 0) GROUP BY ALL)
      SELECT sample, event, n, round(CASE WHEN event = 'cnLOH' THEN 2 * greatest(v, 1 - v) - 1 ELSE (2 * greatest(v, 1 - v) - 1) / greatest(v, 1 - v) END, 6) AS purity FROM m""",
    "fisher_exact": f"""WITH t AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS a, count(*) FILTER (l_returnflag = 'R' AND NOT l_quantity > 25) AS b,
        count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 25) AS c, count(*) FILTER (l_returnflag <> 'R' AND NOT l_quantity > 25) AS d FROM lineitem GROUP BY l_suppkey),
      p AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM t), q AS (SELECT *, {_PFISH.format(x='x')} AS px, {_PFISH.format(x='a')} AS pa FROM p)
      SELECT l_suppkey, a, b, c, d, round(least(sum(px) FILTER (x <= a), 1.0), 8) AS p_left, round(least(sum(px) FILTER (x >= a), 1.0), 8) AS p_right, round(least(sum(px) FILTER (px <= pa * (1 + 1e-9)), 1.0), 8) AS p_two FROM q GROUP BY ALL""",
    "count_window20": f"WITH {_WIN} SELECT sample, chrom, pos, n, n_forward, round(signed_p, 8) AS signed_p, least(mid_start, mid_end) AS mid_start, greatest(mid_start, mid_end) AS mid_end FROM windows",
    "track_state": f"""WITH {_WIN}, l AS (SELECT *, lag(signed_p) OVER (PARTITION BY sample, chrom ORDER BY pos) AS b FROM windows)
      SELECT sample, chrom, pos, CASE WHEN b > 0 AND signed_p < 0 THEN 'ORI' WHEN b < 0 AND signed_p > 0 THEN 'Collision' WHEN signed_p > 0 THEN 'Positive' ELSE 'Negative' END AS state FROM l""",
    "inter_event_distance": f"""WITH {CALLED}, d AS (SELECT sample, chrom, pos AS start, pos - lag(pos) OVER (PARTITION BY sample, chrom ORDER BY pos) AS distance FROM called WHERE event = 'LOH')
      SELECT *, CASE WHEN distance > 0 THEN floor(distance / pow(10, least(floor(log10(distance)), 4)) + 0.5) * pow(10, least(floor(log10(distance)), 4)) ELSE CAST(distance AS DOUBLE) END AS distance_class FROM d""",
    "bucket_cumulative": """WITH c AS (SELECT l_returnflag, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY ALL),
      w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bucket) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bucket DESC) AS BIGINT) AS from_here, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM c)
      SELECT l_returnflag, bucket, n, upto, from_here, round(n / total, 6) AS share, round(upto / total, 6) AS share_upto FROM w""",
    "sigfig_hist": """SELECT round(l_extendedprice * pow(10, 1 - ceil(log10(abs(l_extendedprice))))) / pow(10, 1 - ceil(log10(abs(l_extendedprice)))) AS price, count(*) AS n FROM lineitem GROUP BY 1""",
    "horizontal_concat": "SELECT coalesce(n_nationkey, r_regionkey) AS line_no, coalesce(n_name, 'NA') AS n_name, coalesce(r_name, 'NA') AS r_name FROM nation FULL JOIN region ON n_nationkey = r_regionkey",
    "matrix_union": "SELECT l_suppkey AS \"row\", " + ", ".join(f"count(*) FILTER (l_returnflag = '{c}' OR l_linestatus = '{c}') AS \"{c}\"" for c in "AFNOR") + " FROM lineitem GROUP BY l_suppkey",
    "regression": """WITH r AS (SELECT l_suppkey, CAST(l_extendedprice AS DOUBLE) AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS k FROM lineitem)
      SELECT l_suppkey, round(regr_r2(x, k), 6) AS r2, round((regr_syy(x, k) - regr_sxy(x, k) * regr_sxy(x, k) / nullif(regr_sxx(x, k), 0)) / 1e6, 4) AS sse FROM r GROUP BY l_suppkey""",
    "event_runs": """WITH c AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM c) SELECT user_id, event_type, min(us) AS start, max(us) AS "end", count(*) AS n FROM i GROUP BY user_id, event_type, run""",
    "consecutive_duplicates": """SELECT event_id, user_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)""",
}
