import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varloom.functions import genomics as G, stats as S
from varloom.operators import classify as C, copynumber as N, genes as E, qc as Q, recurrence as R, segment as X, simulate as U


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("name, code", [("chr1", 1), (" CHR01", 1), ("X", 23), ("chrXq", 23), ("chrY", 24), ("MT", 25), ("c7", 7), ("chr_22", 22), ("26", None), ("", None), ("un", None), (None, None), ("0", 0)])
def test_chrom_code(spark, name, code):
    assert spark.createDataFrame([(name,)], "x string").select(G.chrom_code(F.col("x"))).first()[0] == code


def test_scalars(spark):
    def run(expr, *rows):
        return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, y string").orderBy("i").select(expr).collect()]

    x, y = F.col("x"), F.col("y")
    assert run(G.gc_fraction(x), ("GgCcAATT", None), ("", None), ("NNNN", None), (None, None), ("G-G", None)) == [0.5, -1.0, 0.0, None, 1.0]
    assert run(G.rs_number(x), ("rs12,x", None), ("novel", None), ("rs-1", None), (None, None)) == [12, -5, -1, -1]
    assert run(G.rs_text(x), ("a rs-1", None), ("rs", None), ("x", None)) == ["rs-1", "rs", ""]
    cls = G.population_frequency_class(x, y)
    assert run(cls, ("rs1,byfrequency,G|0.997;A|0.003,.", "G"), ("rs1,b,G|0.5;A|0.5", "G"), ("novel", "G"), ("rs1,b", "G"), (None, "G"), ("rs1,b,A|0.003;G|0.997", "A")) == [
        "Rare", "Common", "Novel", "Unknown", "Unknown", "Common"]
    assert run(G.gene_name(x), ("A(dist=5),B(dist=6)", None), (".", None), (" A ", None)) == ["A", None, "A"]
    assert run(G.mutation_type(x), ("utr3", None), ("zzz", None), (None, None)) == ["UTR3", "None", "None"]
    assert run(G.hamming(x, y), ("abc", "abd"), ("a", "ab")) == [1, 2**31 - 1]
    assert run(G.nth_index(x, ",", 2), ("a,b,c", None), ("a,b", None)) == [3, -1]
    assert run(G.allele_pair_match(x, y), ("AC", "AC"), ("AC", "CA"), ("AC", "TG"), ("AC", "GT"), ("AC", "AA")) == ["same", "flipped", "complement", "complement_flipped", "different"]
    assert run(G.barcode_role(x), ("TCGA-AA-1-01A-1-2-3", None), ("TCGA-AA-1-11A-1-2-3", None), ("short", None)) == ["tumor", "normal", None]
    assert run(G.unique_characters(x), ("abca", None)) == ["abc"] and run(G.parse_leading_int(x), ("-12x", None), ("x", None)) == [-12, 0]
    nums = spark.createDataFrame([(2.5,), (-2.5,), (7.4,)], "v double")
    assert [r[0] for r in nums.select(G.nearest_5(F.col("v"))).collect()] == [5, 0, 5]
    assert [r[0] for r in spark.createDataFrame([(123.0,), (0.0456,), (0.0,)], "v double").select(G.significant(F.col("v"), 1)).collect()] == pytest.approx([100.0, 0.05, 0.0])
    assert spark.range(1).select(G.log_add(F.lit(-1000.0), F.lit(-1000.0))).first()[0] == pytest.approx(-1000 + math.log(2))
    assert [r["members"] for r in G.power_set(spark, ["a", "b"]).orderBy("mask").collect()] == [["a"], ["b"], ["a", "b"]]
    assert G.parse_number_lists("({0.5};{0.4,0.6})") == [[0.5], [0.4, 0.6]] and G.parse_number_lists("{1,2,3-5}") == [[1, 2, 3, 4, 5]]


def test_binomial_and_poisson(spark):
    table = S.lnfact(60)
    rows = [(n, k) for n in range(0, 40, 3) for k in range(0, n + 2)]
    df = spark.createDataFrame(rows, "n int, k int").select("n", "k", S.binomial_tail(table, F.col("n"), F.col("k")).alias("p"))
    for r in df.collect():
        n, k = r["n"], r["k"]
        want = 1.0 if n <= 0 or k <= 0 else sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
        assert r["p"] == pytest.approx(want, abs=1e-12)
    p = spark.range(1).select(S.poisson_tail(table, F.lit(3.0), F.lit(2)), S.poisson_best(table, [1.0, 5.0, 20.0], F.lit(6))).first()
    assert p[0] == pytest.approx(1 - math.exp(-3) * 4) and p[1] == 5.0


@pytest.mark.parametrize("t", [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (1, 0, 0, 1)])
def test_fisher(spark, t):
    a, b, c, d = t
    def point(x):
        return math.comb(a + b, x) * math.comb(c + d, a + c - x) / math.comb(a + b + c + d, a + c)
    xs = range(max(0, a - d), min(a + b, a + c) + 1)
    want = (sum(point(x) for x in xs if x <= a), sum(point(x) for x in xs if x >= a), sum(point(x) for x in xs if point(x) <= point(a) * (1 + 1e-9)))
    df = spark.createDataFrame([t], "a int, b int, c int, d int")
    args = [F.col(x) for x in "abcd"]
    assert tuple(df.select(*S.fisher_tails(S.lnfact(100), *args)).first()) == pytest.approx(want)
    assert tuple(df.select(S.fisher_of(*args).alias("p")).select("p.*").first()) == pytest.approx(want)


def test_fdr_and_thresholds(spark):
    rng = random.Random(4)
    p = [round(rng.random() ** 3, 4) for _ in range(500)]
    df = spark.createDataFrame([("g", x) for x in p] + [("h", 0.9), ("g", None)], "k string, p double")
    got = {r["k"]: r["threshold"] for r in S.fdr_threshold(df, "p", 0.05, ["k"]).collect()}
    want = max((x for i, x in enumerate(sorted(p), 1) if x <= i / len(p) * 0.05), default=0)
    assert got == {"g": pytest.approx(want), "h": 0.0}
    for n in (1, 2, 7, 30, 101):
        tail = lambda m: sum(math.comb(n, i) for i in range(m, n + 1)) / 2**n  # noqa: B023,E731
        assert S.permutation_threshold(n) == pytest.approx(min(tail(m) for m in range(-(-n // 2), n + 1) if 2 * tail(m) >= 0.05))
    assert S.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and S.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert S.uniform_chi2_p(np.full(11, 10)) > 0.9 and S.uniform_chi2_p(np.array([100] + [0] * 10)) < 1e-6


def test_exact_median(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.random(), 0.25, -3.0, 900.0])) for k in "aab" for _ in range(101)] + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k").v.median().dropna().to_dict()
    assert {r["k"]: r["median"] for r in N.exact_median(df, ["k"], "v").collect()} == pytest.approx(want)


def sites_df(spark, rows):
    return spark.createDataFrame(rows, "sample string, chrom int, pos int, line_no bigint, site_id bigint, cov_n int, var_n int, cov_t int, var_t int, gene string")


def test_density(spark):
    rows = [("s", 1, p, i, i, 20, 10, 20, 10, "g") for i, p in enumerate([1, 100, 200, 300, 5000, 5100, 9_999_500, 9_999_900, 10_000_100, 10_000_300])]
    df = sites_df(spark, rows).withColumn("c", F.lit(True))
    assert sorted(r["pos"] for r in Q.dense_sites(df).collect()) == [5000, 5100]
    assert sorted(r["pos"] for r in Q.anchored_density(df, "c").collect()) == [5000, 5100]
    assert sorted(r["pos"] for r in Q.anchored_density(df, "c", compat=True).collect()) == [5000, 5100, 9_999_500, 9_999_900, 10_000_100, 10_000_300]


def test_blocks_ratios_and_smoothing(spark):
    rows = [("s", 1, 10, 1, 1, 20, 0, 40, 0, "A"), ("s", 1, 20, 2, 2, 20, 0, 40, 0, "a"), ("s", 1, 30, 3, 3, 20, 0, 10, 0, "."), ("s", 1, 900, 4, 4, 20, 0, 10, 0, "."),
            ("s", 1, 5000, 5, 5, 20, 0, 10, 0, "."), ("s", 2, 5000, 6, 6, 0, 0, 10, 0, ".")]
    ratios = sorted(N.block_ratios(N.gene_blocks(sites_df(spark, rows))).collect(), key=lambda r: (r["chrom"], r["start"]))
    assert [(r["start"], r["end"], r["n_sites"]) for r in ratios] == [(10, 20, 2), (30, 900, 2), (5000, 5000, 1), (5000, 5000, 1)]
    whole = 120 / 100
    assert [r["ratio"] for r in ratios] == pytest.approx([2 / whole, 0.5 / whole, 0.5 / whole, None], nan_ok=True)
    b = spark.createDataFrame([("s", 1, i, s, s, 1, float(i)) for i, s in enumerate([0, 400_000, 1_000_000, 1_000_001, 2_500_000])], "sample string, chrom int, block bigint, start int, end int, n_sites int, ratio double")
    assert [r["smooth"] for r in N.smooth_blocks(b).orderBy("start").collect()] == [1.0, 1.0, 1.0, 3.0, 4.0]


def test_segments_ignore_invalid_sites(spark):
    rows = [("s", 1, p, e) for p, e in [(1, "LOH"), (2, "Ignored"), (3, "LOH"), (4, "HETSomatic"), (5, "HETGermline"), (6, "Noise"), (7, "LOH")]] + [("s", 2, 1, "LOH"), ("t", 2, 1, "Noise")]
    got = X.segments(spark.createDataFrame(rows, "sample string, chrom int, pos int, event string"))
    assert {(r["chrom"], r["event"], r["start"], r["end"], r["n"]) for r in got.collect()} == {(1, "LOH", 1, 3, 2), (1, "HETGermline", 5, 5, 1), (1, "LOH", 7, 7, 1), (2, "LOH", 1, 1, 1)}


def test_caller_recovers_simulated_events(spark):
    """Simulated chromosomes: called events must agree with the truth on most heterozygous sites of large events."""
    sim = U.simulate_cohort(spark, ["A", "B"], 150, purity_t=0.95, germline_gain=False).cache()
    assert sim.count() == U.simulate_cohort(spark, ["A", "B"], 150, purity_t=0.95, germline_gain=False).intersect(sim).count()
    bias = spark.createDataFrame([], "chrom int, pos bigint, n_samples int, avg_vaf_n double, avg_abs_cn double")
    sites = sim.withColumns({"gene": F.lit("."), "line_no": F.lit(1), "site_id": F.lit(1)})
    called = C.call_events(C.prepare_sites(sites, bias, smooth=True))
    final = X.call_regions(called.select("sample", "chrom", "pos", "event", "cn", "adj_vaf_t", "var_n", "cov_n"))
    joined = final.join(sim.select("sample", "chrom", "pos", "truth"), ["sample", "chrom", "pos"]).where(Q.in_het_band())
    pdf = joined.select("event", "truth").toPandas()
    assert len(pdf) > 4000
    quiet = pdf[pdf.truth == "HETGermline"]
    assert (quiet.event == "HETGermline").mean() > 0.8
    lost = pdf[pdf.truth.isin(["LOH", "cnLOH"])]
    assert len(lost) == 0 or lost.event.isin(["LOH", "cnLOH", "DELHom"]).mean() > 0.7


def test_out_of_band(spark):
    rows = [(100, 2, 100, 50, "HETSomatic"), (100, 8, 100, 80, "LOH"), (100, 8, 100, 20, "Ignored"), (100, 97, 100, 50, "Ignored"), (100, 93, 100, 10, "LOH"), (100, 93, 100, 95, "Ignored"), (0, 0, 50, 5, "Ignored")]
    df = spark.createDataFrame(rows, "cov_n int, var_n int, cov_t int, var_t int, want string")
    assert all(r["e"] == r["want"] for r in df.select("want", C.out_of_band_event().alias("e")).collect())


def test_dbscan_forms_agree(spark):
    rng = np.random.default_rng(6)
    pts = np.vstack([rng.normal((0.5, 0.5), 0.02, (150, 2)), rng.normal((0.8, 0.5), 0.02, (120, 2)), rng.random((40, 2))])
    labels = C.dbscan(pts, 0.035, 20)
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "k string, i int, x double, y double")
    got = {r["i"]: r["cluster"] for r in C.dbscan_cells(df, ["k"], "i", "x", "y", 0.035, 20).collect()}
    near = [(np.hypot(*(pts - p).T) <= 0.035).sum() >= 20 for p in pts]
    core = [i for i in range(len(pts)) if near[i]]
    assert all((labels[i] == labels[j]) == (got[i] == got[j]) for i in core for j in core)
    assert {i for i in got if got[i] is None} == {i for i in range(len(pts)) if labels[i] == -1}
    assert len({got[i] for i in core}) >= 2
    assert C.dbscan_cells(df, ["k"], "i", "x", "y", 0.035, 20, lattice=0.005).where("cluster IS NOT NULL").count() > 200


def test_genes(spark):
    rows = [("p1", "A", "LOH", 10, 3, 2), ("p1", "a", "LOH", 10, 8, 5), ("p1", "A", "GainSomatic", 10, 8, 7), ("p2", "A", "LOH", 10, 8, 9), ("p2", ".", "LOH", 10, 8, 9), ("p2", "B", "Noise", 10, 8, 9)]
    df = spark.createDataFrame(rows, "sample string, gene string, event string, cov_t int, var_t int, pos int").withColumns({"mutation": F.lit("UTR3"), "dbsnp": F.lit("novel"), "ref": F.lit("A")})
    own = E.gene_sites(df)
    t = E.tally_genes(own).first()
    assert (t["gene_key"], t["n_sites"], t["n_patients"], t["n_LOH"], t["n_GainSomatic"], t["low"], t["high"], t["n_UTR3"]) == ("a", 4, 2, 3, 1, 2, 9, 4)
    s = E.summarize_genes(own).first()
    assert (s["n_LossReference"], s["n_LossVariant"], s["n_GainVariant"]) == (2, 1, 1)
    assert {(r["sample"], r["events"]) for r in E.multi_event_genes(own).collect()} == {("p1", "GainSomatic;LOH")}
    pairs = E.co_occurrence(spark.createDataFrame([(p, g, e) for p in ("x", "y", "y") for g, e in (("A", "L"), ("b", "G"))] + [("z", "A", "L"), ("z", "c", "L"), (None, "A", "L")], "p string, g string, e string"), "p", "g", "e", 2, 3)
    assert [tuple(r) for r in pairs.collect()] == [("a", "L", "b", "G", 2)]


def test_tracks(spark):
    df = spark.createDataFrame([("LOH", 23, 1, 9, 1), ("LOH", 23, 10, 19, 3)], "event string, chrom int, start int, end int, recurrence int")
    assert sorted(r[0] for r in R.bed_lines(R.browser_scores(df)).select("value").collect()) == ["chrX 1 10 LOH 200 +", "chrX 10 20 LOH 666 +"]
    cn = R.copy_number_track(spark.createDataFrame([(1, 1, 10, -1.0), (1, 5, 20, 1.0)], "chrom int, start int, end int, value double"))
    assert cn.count() == 3 and cn.agg(F.min("score"), F.max("score")).first()[0] >= 200


def test_simulated_tissues(spark):
    from varloom.operators import simulate as U

    rows = [("s", 1, i, 100, 50, 200, v) for i, v in enumerate([0, 10, 100, 150, 200] * 400)]
    df = spark.createDataFrame(rows, "sample string, chrom int, pos int, cov_n int, var_n int, cov_t int, var_t int")
    got = U.tumor_only(df, coverage=60.0).toPandas()
    assert got.groupby("var_t").apply(lambda d: (d.var_n / d.cov_n).mean(), include_groups=False).round(1).to_dict() == {0: 0.0, 10: 0.0, 100: 0.5, 150: 0.5, 200: 1.0}
    assert abs(got.cov_n.mean() - 60) < 1 and 50 < got.cov_n.var() < 70 and got.cov_n.min() >= 15 and (got.var_n <= got.cov_n).all()
    het = got[got.var_t == 100]
    assert abs((het.var_n - het.cov_n / 2).var() / (het.cov_n.mean() / 4) - 1) < 0.25
    again = U.tumor_only(df.repartition(7), coverage=60.0).toPandas().sort_values("pos", ignore_index=True)
    assert (again.cov_n == got.sort_values("pos", ignore_index=True).cov_n).all()
    assert {tuple(r) for r in U.germline_only(df).select("cov_t", "var_t").distinct().collect()} == {(100, 50)}
    mixed = {tuple(r) for r in U.contaminate_normal(df.where("var_t = 0"), 0.5).select("cov_n", "var_n").distinct().collect()}
    assert mixed == {(150, 25)}


def test_kmeans():
    import numpy as np

    from varloom.operators.classify import kmeans_lloyd

    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(c, 0.05, (50, 2)) for c in (0.0, 1.0, 2.0)])
    labels = kmeans_lloyd(points, 3)
    assert [len(set(labels[i : i + 50])) for i in (0, 50, 100)] == [1, 1, 1] and len(set(labels)) == 3
