"""Queries over all of their input, against SQL without the cuts that the registered SQL repeats."""

import os

import numpy as np
import pytest
from oracle import DATA, assert_same, connect

from varloom.functions import genomics as G
from varloom.operators import classify as C, origins as O
from varloom.queries import cohort, sites

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect()


def test_density_of_every_region(spark, con):
    """One row per region of ``segments``, those of one and two sites too."""
    cut = " WHERE r.n > 2"
    assert sites.region_density(spark, DATA).count() == sites.segments(spark, DATA).count()
    assert_same(spark, con, sites.region_density, sites.ORACLES["region_density"].replace(cut, ""))


def test_strength_of_both_arms(spark, con):
    """Each marker is in one arm, gains and losses come out; the SQL is the registered one with all arms and both types."""
    names = " ".join(f"WHEN {i} THEN CASE WHEN pos >= {x} THEN 'q' ELSE 'p' END" for i, x in enumerate(G.SHORT_ARMS, 1))
    sql = f"""WITH {cohort._MARKERS}, a AS (SELECT *, CASE chrom {names} END AS arm FROM markers),
      s AS (SELECT *, 'AMP' AS type, CASE WHEN value > 0.9 THEN 2 WHEN value > 0.3 THEN 1 ELSE 0 END AS s FROM a
        UNION ALL SELECT *, 'DEL', CASE WHEN value < -1.3 THEN 2 WHEN value < -0.3 THEN 1 ELSE 0 END FROM a)
      SELECT type, CAST(chrom AS VARCHAR) || arm AS region, sample, CASE WHEN count(*) FILTER (s = 2) > count(*) / 2 THEN 2 WHEN count(*) FILTER (s = 0) >= (count(*) + 1) / 2 THEN 0 ELSE 1 END AS strength,
        round(avg(value), 10) AS mean FROM s WHERE arm IS NOT NULL GROUP BY type, chrom, arm, sample"""
    assert_same(spark, con, cohort.strength_matrix, sql)
    assert {(r["type"], r["region"][-1]) for r in cohort.strength_matrix(spark, DATA).collect()} == {(t, a) for t in ("AMP", "DEL") for a in "pq"}


def test_spline_meets_origins_and_ends(spark):
    """Origins, collisions and both ends are knots, whatever the stride; the stride begins again at each."""
    marked = np.zeros(9, bool)
    marked[4] = True
    assert O.spline_knots(marked, 3).tolist() == [0, 3, 4, 7, 8]
    flags = [True] * 30 + [False] * 30 + [True] * 30
    df = spark.createDataFrame([("s", 1, 10 * i, f) for i, f in enumerate(flags)], "sample string, chrom int, pos bigint, forward boolean")
    w = O.count_windows(df, ["sample", "chrom"], ["pos"], "forward", "pos").cache()
    marks = O.origin_marks(df)
    own = marks.join(w, ["sample", "chrom", "pos"]).collect()
    assert sorted((r["mid_start"], r["mid_end"], r["kind"]) for r in own) == sorted((r["start"], r["end"], r["kind"]) for r in O.find_origins(df).collect())
    assert {r["kind"] for r in own} == {"ORI", "Collision"}
    rows = O.spline_track(w, marks).orderBy("pos").collect()
    at = {r["pos"] for r in own} | {rows[0]["pos"], rows[-1]["pos"]}
    assert len(rows) == 71 and any((p // 10 - 19) % 3 for p in at)
    assert all(r["smooth"] == pytest.approx(min(max(r["signed_p"], -0.5), 0.5), abs=1e-9) for r in rows if r["pos"] in at)


@pytest.mark.parametrize("seed", range(3))
def test_dbscan_is_exact(spark, seed):
    """Core points, clusters, noise and borders equal brute force, across blocks, in crowded and in sparse cells, with equal points."""
    rng = np.random.default_rng(seed)
    pts = np.vstack([rng.normal((0.5, 0.5), 0.05, (700, 2)), rng.normal((0.2, 0.7), 0.01, (300, 2)), rng.random((500, 2)), [(0.9, 0.1)] * 25,
                     np.c_[np.linspace(-0.4, 0.9, 300), np.full(300, 0.2)]])
    eps, least = 0.035, 20
    near = (pts[:, None, 0] - pts[None, :, 0]) ** 2 + (pts[:, None, 1] - pts[None, :, 1]) ** 2 <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(pts)), len(pts))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(pts)).min(1), len(pts))
        if (new == label).all():
            break
        label = new
    label = np.where(core, label, np.where(near & core[None], label[None], len(pts)).min(1))
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + [("h", 0, None, 0.5)], "k string, i int, x double, y double")
    rows = C.dbscan_cells(df, ["k"], "i", "x", "y", eps, least).collect()
    got = {r["i"]: r["cluster"] for r in rows if r["k"] == "g"}
    assert len(rows) == len(pts) + 1 and [r["cluster"] for r in rows if r["k"] == "h"] == [None]
    assert [got[i] for i in range(len(pts))] == [None if v == len(pts) else v for v in label.tolist()]
    assert (~core & (label < len(pts))).any() and len(set(label.tolist())) > 3


def test_dbscan_query_keeps_exact_fractions(spark, tmp_path):
    """Noise of the registered query is that of the exact fractions, on one sample with uneven coverages."""
    n, rng = 2000, np.random.default_rng(11)
    own = spark.read.parquet(f"{DATA}/naf_taf_inputs.parquet").limit(n).toPandas()
    cov = rng.integers(150, 400, (2, len(own)))
    var = np.floor(cov * np.clip(rng.normal(0.5, 0.09, cov.shape), 0.15, 0.85)).astype(int)
    own = own.assign(sample_id="s", refname="chr1", coordinate=np.arange(len(own)) + 1, line_no=np.arange(len(own)), site_id=np.arange(len(own)),
                     q20_totcov_n=cov[0], q20_totcov_t=cov[1], q20_varcov_n=var[0], q20_varcov_t=var[1])
    schema = spark.read.parquet(f"{DATA}/naf_taf_inputs.parquet").schema
    spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/naf_taf_inputs.parquet")
    got = sites.dbscan(spark, str(tmp_path)).toPandas().sort_values("site_id")["cluster"]
    noise = C.dbscan(np.c_[var[1] / cov[1], var[0] / cov[0]], 0.035, 100) == -1
    assert len(got) == len(noise) and 100 < noise.sum() < len(noise) - 100
    assert (got.isna().to_numpy() == noise).all()


def test_binned_mean_and_deviation(spark, con):
    """The registered SQL has counts only; this one has the bins, each standing for its upper edge."""
    sql = f"""WITH {sites.SITES}, b AS (SELECT sample, (floor(var_n / cov_n / CAST(0.025 AS DOUBLE)) + 1) * CAST(0.025 AS DOUBLE) AS x FROM sites WHERE var_n / cov_n > 0.2 AND var_n / cov_n <= 0.8)
      SELECT sample, count(*) AS n, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS sd FROM b GROUP BY sample"""
    got, want = (sorted(map(tuple, d[["sample", "n", "mean", "sd"]].itertuples(index=False))) for d in (sites.binned_vaf(spark, DATA).toPandas(), con.execute(sql).df()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(g[2] == pytest.approx(w[2], abs=2e-6) for g, w in zip(got, want))
    assert all(w[1] < 2 or g[3] == pytest.approx(w[3], abs=2e-6) for g, w in zip(got, want))


def test_simulation_has_the_inputs_size(spark):
    """All samples of the input, and each simulated site scored once under every event."""
    n = sites._sites(spark, DATA).groupBy("sample").count().toPandas().set_index("sample")["count"]
    sim = cohort._simulated(spark, DATA)
    size = sim.count()
    assert {r["sample"] for r in sim.select("sample").distinct().collect()} == set(n.index) and n.sum() <= size <= n.sum() + 22 * len(n)
    c = cohort.simulated_cohort(spark, DATA).collect()
    assert {r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in c} <= set(range(int(size * 0.9), size + 1))
    assert {"LOH", "GainSomatic", "HETGermline"} <= {r["event"] for r in c}
