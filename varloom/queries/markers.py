"""Queries over markers with a recurrent aberration: null law, q-values, significant regions, peaks, genes.

The delivered segments have no significant marker, so a gain of every sample is planted on one stretch of chromosome 2;
lost heterozygosity has a matrix of its own, from the delivered losses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.genomics import CHROM_LENGTHS as _LENGTHS, SHORT_ARMS as _ARMS
from ..operators import gscore as K
from ..plans import intervals as I
from ..plans.cut import cut
from ..sources.tables import broad_thresholds
from .cohort import _GENE, _MARKERS, _PARTS, _genes, _markers, _regions

#: The stretch of the planted gain and the value there.
CHROM, LOW, HIGH, VALUE = 2, 20_000_000, 60_000_000, 1.2


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _markers(spark, sf_dir)
    samples = [r["sample"] for r in m.select("sample").distinct().orderBy("sample").limit(10_001).collect()]
    if len(samples) > 10_000:
        raise ValueError("samples are a dimension; more than 10,000 are not")
    planted = (F.col("chrom") == CHROM) & F.col("pos").between(LOW, HIGH)
    probes = _genes(spark, sf_dir).groupBy("chrom", F.col("g_start").alias("pos")).agg(F.min("gene").alias("marker")).where(planted)
    gain = probes.select(F.explode(F.lit(samples)).alias("sample"), "marker", "chrom", "pos", F.lit(VALUE).alias("value"))
    m = cut(m.where(~planted).select(gain.columns).unionByName(gain))
    lost = _regions(spark, sf_dir).where(F.upper("event").contains("LOH")).select(F.col("patient").alias("sample"), "chrom", "start", "end").distinct()
    hit = I.points_in_intervals(m.select("sample", "chrom", "pos", "marker"), lost, ["sample", "chrom"], "pos", "start", "end", "semi").withColumn("hit", F.lit(1.0))
    loh = m.join(hit, ["sample", "chrom", "pos", "marker"], "left").withColumn("value", F.coalesce("hit", F.lit(0.0))).drop("hit")
    parts = K.contributions(m)
    return cut(parts.unionByName(K.loh_contributions(loh).select(parts.columns)))


def _scored(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = _parts(spark, sf_dir)
    g = cut(K.g_scores(parts))
    return parts, g, cut(K.q_values(g, K.null_distribution(parts)))


def marker_scores(spark, sf_dir):
    """G-scores of gains, losses and lost heterozygosity."""
    return K.g_scores(_parts(spark, sf_dir))


def marker_qvalues(spark, sf_dir):
    return _scored(spark, sf_dir)[2].select("type", "g", "n", F.round("p", 9).alias("p"), "rank", F.round("q", 9).alias("q"))


def significance_threshold(spark, sf_dir):
    return K.significance_threshold(_scored(spark, sf_dir)[2])


def significant_regions(spark, sf_dir):
    """Stretches of markers whose q lies below the threshold."""
    _, g, q = _scored(spark, sf_dir)
    marked = K.floor_q(g, q).withColumn("significant", F.col("q") < K.Q)
    runs = I.ordered_islands(marked, ["type", "chrom"], "pos", ["significant"]).where("significant")
    return runs.groupBy("type", "chrom", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n"), F.max("g").alias("g")).drop("island")


def score_track(spark, sf_dir):
    """Runs of equal scores with -log10 of their q."""
    _, g, q = _scored(spark, sf_dir)
    return K.score_track(K.runs_of_equal_g(g), q).select("type", "chrom", "g", "start", "end", F.round("track", 6).alias("track"))


def gene_gscores(spark, sf_dir):
    """Scores of genes from their closest markers, with q-values under the convolved null."""
    _, g, q = _scored(spark, sf_dir)
    genes = _genes(spark, sf_dir).select("gene", "chrom", F.col("g_start").alias("start"), F.col("g_end").alias("end"))
    return K.gene_scores(g, genes, q).withColumn("q", F.round("q", 9))


def _peaks(spark, sf_dir, peel: str) -> DataFrame:
    parts, _, q = _scored(spark, sf_dir)
    peaks = K.find_peaks(parts, q, peel=peel)
    bands = spark.createDataFrame([(c, a, 0, n, b) for c, (n, p) in enumerate(zip(_LENGTHS, _ARMS), 1) for a, n, b in (("p", p, "p1"), ("q", n - p, "q1"))],
                                  "chrom int, arm string, start bigint, end bigint, band string")
    return K.classify_peaks(peaks, broad_thresholds(bands), K.significance_threshold(q))


def peak_finder(spark, sf_dir):
    """Regions and peaks, broad and focal ones told apart."""
    return _peaks(spark, sf_dir, "stretch")


def peak_finder_limited(spark, sf_dir):
    """The same with limited peel-off."""
    return _peaks(spark, sf_dir, "limited")


def peak_finder_arm(spark, sf_dir):
    """The same, peeling whole arms."""
    return _peaks(spark, sf_dir, "arm")


def differential_scores(spark, sf_dir):
    """Scores of one group of samples against the other: each weighs the other's size."""
    m = _markers(spark, sf_dir)
    groups = m.select("sample").distinct().withColumn("group", F.when(F.substring("sample", -1, 1).isin(*"02468"), 1).otherwise(2))
    return K.g_scores(K.contributions(m, weights=K.differential_weights(groups)))


def best_gene_region(spark, sf_dir):
    """One delivered region per gene: overlapping before near, more markers, longer, closer."""
    r = _regions(spark, sf_dir).select("patient", "chrom", "start", "end", F.coalesce("num_markers", F.lit(0)).alias("n")).groupBy("patient", "chrom", "start", "end").agg(F.max("n").alias("n"))
    near = I.neighbours_of_intervals(_genes(spark, sf_dir), r, ["chrom"], ("g_start", "g_end"), ("start", "end"))
    rows = near.select("gene", (F.col("distance") == 0).alias("overlap"), F.floor(F.col("n") / 20).cast("int").alias("class"), (F.col("n") > 30).alias("is_peak"),
                       (F.col("end") - F.col("start")).alias("size"), "distance", F.concat_ws(":", "patient", "chrom", "start", "end").alias("region"))
    return K.best_region_per_gene(rows)


QUERIES = {f.__name__: f for f in (marker_scores, marker_qvalues, significance_threshold, significant_regions, score_track, gene_gscores, peak_finder,
                                   peak_finder_limited, peak_finder_arm, differential_scores, best_gene_region)}


def null_sql(parts: str, scores: str) -> str:
    """CTEs ``law`` (the samples' scores convolved one after the other) and ``q`` of some parts and scores."""
    return f"""
hist AS MATERIALIZED (SELECT type, sample, score, dense_rank() OVER (PARTITION BY type ORDER BY sample) AS i, count(*) / sum(count(*)) OVER (PARTITION BY type, sample) AS share FROM {parts} GROUP BY type, sample, score),
law AS (SELECT DISTINCT type, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS g, CAST(1 AS DOUBLE) AS p FROM hist
  UNION ALL SELECT l.type, l.i + 1, l.g + h.score, sum(l.p * h.share) FROM law l JOIN hist h ON h.type = l.type AND h.i = l.i + 1 GROUP BY l.type, l.i, l.g + h.score),
whole AS MATERIALIZED (SELECT type, g, p FROM law QUALIFY i = max(i) OVER (PARTITION BY type)),
ranked AS (SELECT type, g, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY type ORDER BY g DESC) AS BIGINT) AS rank, sum(count(*)) OVER (PARTITION BY type) AS m FROM {scores} GROUP BY type, g),
tails AS (SELECT r.type, r.g, n, rank, m, least(coalesce(sum(w.p), 0.0), 1.0) AS p FROM ranked r LEFT JOIN whole w ON w.type = r.type AND w.g >= r.g GROUP BY ALL),
q AS MATERIALIZED (SELECT type, g, n, p, rank, least(min(p * m / rank) OVER (PARTITION BY type ORDER BY g), 1.0) AS q FROM tails)"""


_PLANTED = f"""{_MARKERS},
planted AS (SELECT sample, marker, chrom, pos, value FROM markers WHERE NOT (chrom = {CHROM} AND pos BETWEEN {LOW} AND {HIGH})
  UNION ALL SELECT sample, marker, chrom, pos, CAST({VALUE} AS DOUBLE) FROM probes, (SELECT DISTINCT sample FROM markers) WHERE chrom = {CHROM} AND pos BETWEEN {LOW} AND {HIGH}),
capped AS (SELECT sample, marker, chrom, pos, greatest(least(value, 1.5), -1.5) AS v FROM planted),
losses AS (SELECT DISTINCT patient, chrom, start, "end" FROM delivered WHERE contains(upper(event), 'LOH')),
parts AS MATERIALIZED (SELECT 'AMP' AS type, marker, chrom, pos, sample, CASE WHEN v > 0.3 THEN CAST(floor(v / 0.001 + 0.5) AS BIGINT) ELSE 0 END AS score FROM capped
  UNION ALL SELECT 'DEL', marker, chrom, pos, sample, CASE WHEN v < -0.3 THEN -CAST(floor(v / 0.001 + 0.5) AS BIGINT) ELSE 0 END FROM capped
  UNION ALL SELECT 'LOH', marker, chrom, pos, sample, CASE WHEN EXISTS (SELECT 1 FROM losses l WHERE l.patient = sample AND l.chrom = planted.chrom AND pos BETWEEN l.start AND l."end") THEN 1000 ELSE 0 END FROM planted),
g AS MATERIALIZED (SELECT type, marker, chrom, pos, CAST(sum(score) AS BIGINT) AS g FROM parts GROUP BY ALL)"""
_Q = f"{_PLANTED}, {null_sql('parts', 'g')}"

ORACLES = {
    "qvalue_monotone": f"WITH RECURSIVE {_PARTS}, {null_sql('parts', 'g')} SELECT type, g, n, round(p, 9) AS p, rank, round(q, 9) AS q FROM q",
    "marker_scores": f"WITH {_PLANTED} SELECT * FROM g",
    "marker_qvalues": f"WITH RECURSIVE {_Q} SELECT type, g, n, round(p, 9) AS p, rank, round(q, 9) AS q FROM q",
    "significance_threshold": f"WITH RECURSIVE {_Q} SELECT type, min(g) AS g_sig FROM q WHERE q < 0.25 GROUP BY type",
    "significant_regions": f"""WITH RECURSIVE {_Q}, s AS (SELECT g.*, q < 0.25 AS significant FROM g JOIN q USING (type, g)),
      c AS (SELECT *, CASE WHEN significant = lag(significant) OVER w THEN 0 ELSE 1 END AS brk FROM s WINDOW w AS (PARTITION BY type, chrom ORDER BY pos)),
      i AS (SELECT *, sum(brk) OVER (PARTITION BY type, chrom ORDER BY pos) AS run FROM c)
      SELECT type, chrom, min(pos) AS start, max(pos) AS "end", count(*) AS n, max(g) AS g FROM i WHERE significant GROUP BY type, chrom, run""",
    "score_track": f"""WITH RECURSIVE {_Q}, c AS (SELECT *, CASE WHEN g = lag(g) OVER w THEN 0 ELSE 1 END AS brk FROM g WINDOW w AS (PARTITION BY type, chrom ORDER BY pos)),
      i AS (SELECT *, sum(brk) OVER (PARTITION BY type, chrom ORDER BY pos) AS run FROM c), r AS (SELECT type, chrom, g, min(pos) AS start, max(pos) AS "end" FROM i GROUP BY type, chrom, g, run)
      SELECT r.*, round(-log10(greatest(q, 1e-300)), 6) AS track FROM r JOIN q USING (type, g)""",
    "gene_gscores": f"""WITH RECURSIVE {_Q}, m AS (SELECT DISTINCT chrom, pos FROM g),
      inside AS (SELECT gene, s.chrom, g_start, g_end, pos FROM genes s JOIN m ON s.chrom = m.chrom AND pos BETWEEN g_start AND g_end),
      lone AS (SELECT s.gene, s.chrom, s.g_start, s.g_end, coalesce(min(pos) FILTER (pos >= g_start), max(pos)) AS pos FROM genes s JOIN m ON s.chrom = m.chrom
        WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.gene = s.gene AND i.chrom = s.chrom AND i.g_start = s.g_start AND i.g_end = s.g_end) GROUP BY ALL),
      closest AS (SELECT * FROM inside UNION ALL SELECT * FROM lone),
      means AS (SELECT gene, c.chrom, g_start AS start, g_end AS "end", type, CAST(floor(avg(g) + 0.5) AS BIGINT) AS g FROM closest c JOIN g ON g.chrom = c.chrom AND g.pos = c.pos GROUP BY gene, c.chrom, g_start, g_end, type)
      SELECT a.*, round(coalesce((SELECT q.q FROM q WHERE q.type = a.type AND q.g <= a.g ORDER BY q.g DESC LIMIT 1), 1.0), 9) AS q FROM means a""",
    "differential_scores": f"""WITH {_PARTS}, s AS (SELECT DISTINCT sample, CASE WHEN right(sample, 1) IN ('0', '2', '4', '6', '8') THEN 1 ELSE 2 END AS grp FROM markers),
      w AS (SELECT sample, CASE WHEN grp = 1 THEN (SELECT count(*) FROM s WHERE grp = 2) ELSE -(SELECT count(*) FROM s WHERE grp = 1) END AS weight FROM s)
      SELECT type, marker, chrom, pos, CAST(sum(score * weight) AS BIGINT) AS g FROM parts JOIN w USING (sample) GROUP BY ALL""",
    "best_gene_region": f"""WITH {_MARKERS}, r AS (SELECT patient, chrom, start, "end", max(coalesce(num_markers, 0)) AS n FROM delivered GROUP BY ALL),
      near AS (SELECT gene, g_start, g_end, r.*, greatest(start - g_end, g_start - "end", 0) AS distance, CASE WHEN start > g_end THEN 1 WHEN "end" < g_start THEN -1 ELSE 0 END AS side
        FROM genes s JOIN r ON r.chrom = s.chrom WHERE greatest(start - g_end, g_start - "end", 0) < 100000),
      kept AS (SELECT * FROM near QUALIFY distance = min(distance) OVER (PARTITION BY gene, chrom, g_start, g_end, side)),
      t AS (SELECT gene, distance = 0 AS overlap, CAST(floor(n / 20) AS INTEGER) AS class, n > 30 AS is_peak, "end" - start AS size, distance,
        concat_ws(':', patient, chrom, start, "end") AS region FROM kept)
      SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY gene ORDER BY overlap DESC, class DESC, is_peak DESC, size DESC, distance, region) = 1""",
}
