import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varloom.operators import compare as M, enrichment as E, gscore as K, origins as O


def test_call_sets(spark):
    a = spark.createDataFrame([("A", "LOH", "p"), ("B", "NA", "p"), ("C", "LOH", "p"), ("d", None, "P"), ("E", "LOH", "p")], "gene string, event string, patient string")
    b = spark.createDataFrame([("a", "LOH", "P"), ("A", "cnLOH", "p"), ("C", "cnLOH", "p"), ("D", "LOH", "p")], "gene string, event string, patient string")
    got = {r["gene"]: r["match"] for r in M.compare_calls(a, b).collect()}
    assert got == {"A": "MatchCall", "B": "MatchNoCall", "C": "MismatchCallDiffCall", "d": "MismatchNoCallCall", "E": "MismatchCallNoCall"}
    assert M.match_tallies(M.compare_calls(a, b)).where("gene = 'a'").first()["match_fraction"] == 1.0


def test_contingency_rates(spark):
    r = M.contingency_rates(spark.createDataFrame([(171, 23, 45, 243)], "tp int, fp int, fn int, tn int")).first()
    assert (r["sensitivity"], r["specificity"], r["ppv"], r["npv"]) == pytest.approx((171 / 216, 243 / 266, 171 / 194, 243 / 288))


def test_annotation_takes_the_first(spark):
    t = spark.createDataFrame([(1, "T1", "x"), (2, "t2", "x")], "pos int, tumor string, status string")
    v = spark.createDataFrame([(1, "t1", "b", 5), (1, "T1", "a", 4), (3, "T2", "c", 6)], "pos int, tumor string, status string, n int")
    got = {r["pos"]: (r["status"], r["n"]) for r in M.annotate_variants(t, v, ["pos", "tumor"], "status", ["n"], ["n"]).collect()}
    assert got == {1: ("a", 4), 2: ("DeNovo", None)}


def test_regulators_and_terms(spark):
    r = spark.createDataFrame([("AMP", "g", 1), ("AMP", "g", 3), ("DEL", "h", 2)], "aberration string, gene string, class int")
    got = {tuple(x) for x in M.regulator_sets(r).collect()}
    assert ("AMP", "g", "Peak") in got and ("ALL", "h", "NonBroad") in got and ("DEL", "h", "Peak") not in got
    genes = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 3.0), (".", 9.0)], "gene string, value double")
    roster = spark.createDataFrame([("a", "P"), ("a", "P"), ("b", "P"), ("c", "Q")], "gene string, pathway string")
    tau = {x["pathway"]: (x["g_p"], x["p"], x["tau"]) for x in E.pathway_tau(genes, roster).collect()}
    assert tau == {"P": (1, 2, pytest.approx(1 * 4 / (2 * 2))), "Q": (0, 1, 0.0)}
    assert {x["pathway"]: x["g_p"] for x in E.pathway_tau(genes, roster, compat=True).collect()} == {"P": 0, "Q": 0}
    assert [x["gene"] for x in E.top_genes(genes, "value", 2).collect()] == ["a", "c"]


def markers_df(spark, rows):
    return spark.createDataFrame(rows, "marker string, chrom int, pos bigint, sample string, value double")


def test_scores_null_and_peaks(spark):
    rng = random.Random(8)
    rows = []
    for s in range(12):
        for i in range(60):
            v = rng.choice([0.0, 0.0, 0.0, 0.35]) if not 20 <= i < 24 else 1.2
            rows.append((f"m{i}", 1, 1000 + i * 10, f"s{s}", v))
    parts = K.contributions(markers_df(spark, rows)).cache()
    g = K.g_scores(parts)
    amp = {r["marker"]: r["g"] for r in g.where("type = 'AMP'").collect()}
    assert amp["m21"] == 12 * 1200 and all(r["g"] == 0 for r in g.where("type = 'DEL'").collect())
    null = {r["g"]: r["log_p"] for r in K.null_distribution(parts).where("type = 'AMP'").collect()}
    law = {0: 1.0}
    for s in range(12):
        own = [r["score"] for r in parts.where((F.col("type") == "AMP") & (F.col("sample") == f"s{s}")).collect()]
        law2 = {}
        for a, p in law.items():
            for x in set(own):
                law2[a + x] = law2.get(a + x, 0) + p * own.count(x) / len(own)
        law = law2
    for at in (0, 1200, 5000, 14400):
        assert math.exp(null[at]) == pytest.approx(sum(p for x, p in law.items() if x >= at), abs=1e-12)
    q = K.q_values(g, K.null_distribution(parts)).cache()
    ordered = [r["q"] for r in q.where("type = 'AMP'").orderBy("g").collect()]
    assert all(a >= b for a, b in zip(ordered, ordered[1:])) and max(ordered) <= 1
    found = K.find_peaks(parts, q).collect()
    first = min(found, key=lambda r: r["place"])
    assert (first["type"], first["peak_start"], first["peak_end"]) == ("AMP", 1200, 1230) and first["n_samples"] == 12
    floor = {(r["type"], r["g"]): r["q"] for r in K.floor_q(g, q).collect()}
    assert floor[("AMP", 14400)] == pytest.approx(min(ordered))


def test_marker_segments_round_trip(spark):
    seg = spark.createDataFrame([("s", 1, 100, 200, 0.5), ("s", 1, 301, 400, -0.5)], "sample string, chrom int, start bigint, end bigint, value double")
    probes = spark.createDataFrame([(f"m{p}", 1, p) for p in range(100, 401, 25)], "marker string, chrom int, pos bigint")
    m = K.segments_to_markers(seg, probes)
    assert {r["pos"]: r["value"] for r in m.collect()} == {p: 0.5 if p <= 250 else -0.5 for p in range(100, 401, 25)}
    back = sorted(tuple(r[c] for c in ("start", "end", "value", "n")) for r in K.markers_to_segments(m).collect())
    assert back == [(100, 250, 0.5, 7), (275, 400, -0.5, 6)]
    med = K.focal_thresholds(m).first()
    assert med["high"] == 0.5
    cn = K.copy_numbers_to_markers(seg.withColumn("cn", F.when(F.col("value") > 0, 2).otherwise(1)), probes)
    assert cn.where("value = 0").count() == 0 and cn.count() > 0


def test_windows_and_origins(spark):
    flags = [True] * 30 + [False] * 30 + [True] * 30
    df = spark.createDataFrame([("s", 1, 10 * i, f) for i, f in enumerate(flags)] + [("t", 1, 5, True), ("t", 1, 6, False), ("t", 1, 7, True)], "sample string, chrom int, pos bigint, forward boolean")
    w = O.count_windows(df, ["sample", "chrom"], ["pos"], "forward", "pos").cache()
    assert w.where("sample = 's'").count() == 71
    short = w.where("sample = 't'").collect()
    assert [(r["n"], r["n_forward"], r["mid_start"], r["mid_end"]) for r in short] == [(3, 2, 6, 6)]
    full = w.where("sample = 's' AND pos = 190").first()
    assert full["signed_p"] == pytest.approx(0.5**20) and (full["mid_start"], full["mid_end"]) == (90, 100)
    states = [r["state"] for r in O.track_states(w, ["sample", "chrom"], ["pos"]).where("sample = 's'").orderBy("pos").collect()]
    assert states.count("ORI") == 1 and states.count("Collision") == 1
    kinds = [r["kind"] for r in O.find_origins(df).where("sample = 's'").orderBy("start").collect()]
    assert kinds[0] == "ORI" and kinds.count("ORI") == 1
    x = np.arange(0, 200, 10.0)
    assert O.spline_values(x, 0.002 * x, np.array([5.0, 111.0])) == pytest.approx([0.01, 0.222])
    assert O.spline_track(w).count() == w.count()
    d = O.inter_distance(spark.createDataFrame([("s", 1, 1), ("s", 1, 35), ("s", 1, 123456)], "k string, start int, end int").withColumn("start", F.col("end")), ["k"], "start", "end").orderBy("start").collect()
    assert [r["distance"] for r in d] == [None, 34, 123421] and [r["distance_class"] for r in d] == [None, 30.0, 120000.0]


def test_permutation(spark):
    lengths, counts = [100.0] * 50, [1] * 50
    assert M.mutation_permutation(spark, lengths, counts, 5, 0.01, trials=2000).first()[0] == 1.0
    assert M.mutation_permutation(spark, lengths, counts, 5, 0.5, trials=2000).first()[0] == pytest.approx(1 / 2000)


def test_imputed_and_classified(spark):
    scored = spark.createDataFrame([(1, 10, 100), (1, 30, 200)], "chrom int, pos bigint, g bigint")
    got = {r["pos"]: r["g"] for r in K.impute_scores(spark.createDataFrame([(1, 5), (1, 15), (1, 40), (1, 10)], "chrom int, pos bigint"), scored).collect()}
    assert got == {5: 100, 15: 125, 40: 200, 10: 100}
    # broad with a narrow span; with a score of just twice the threshold; with a span as long as the arm's threshold; not broad
    peaks = [("AMP", 1, 1, 100, 5, 9, 41, 5, 9), ("AMP", 1, 1, 101, 5, 9, 40, 5, 9), ("AMP", 1, 1, 102, 5, 9, 90, 5, 65), ("AMP", 1, 1, 10, 5, 9, 50, 5, 9)]
    peaks = spark.createDataFrame(peaks, "type string, chrom int, region_start int, region_end int, peak_start int, peak_end int, peak_g int, span_start int, span_end int")
    arms = spark.createDataFrame([(1, "p", 60)], "chrom int, arm string, broad_length int")
    rows = K.classify_peaks(peaks, arms, spark.createDataFrame([("AMP", 20)], "type string, g_sig int")).orderBy("region_end").collect()
    assert [(r["is_broad"], r["is_focal"]) for r in rows] == [(False, False), (True, True), (True, False), (True, False)]
    with pytest.raises(ValueError):
        K.require_several_samples(spark.createDataFrame([("AMP", "s", 5), ("DEL", "s", 0)], "type string, sample string, score int"))


def test_cluster_summaries(spark):
    from varloom.operators import classify as C

    df = spark.createDataFrame([("k", 1, 0.5, 0.5), ("k", 1, 0.52, 0.5), ("k", 1, 0.5, 0.6), ("k", 2, 0.9, 0.9), ("k", None, 0.1, 0.1)], "k string, cluster int, x double, y double")
    assert C.central_cluster(df, ["k"], "x", "y").first()["cluster"] == 1
    assert tuple(C.largest_cluster(df, ["k"]).first()) == ("k", 1, 3)
    rows = C.within_min_radius(df, ["k"], "x", "y").collect()
    assert {r["inside"] for r in rows if r["cluster"] is None} == {None} and len(rows) == 5


def runs_of(scores):
    rows = []
    for i, row in enumerate(scores):
        edges = np.flatnonzero(np.diff(row)) + 1
        for a, b in zip([0, *edges], [*edges, len(row)]):
            if row[a]:
                rows.append((f"s{i:03}", a, b - 1, row[a]))
    return pd.DataFrame(rows, columns=["sample", "low", "high", "score"])


def dense_peaks(scores, grid, grid_q, threshold, arms=None, limit=None, look=11):
    """The same on a matrix, marker by marker."""
    look_up = lambda g: grid_q[np.searchsorted(grid, g, side="right") - 1] if g >= grid[0] else 1.0
    left, n, out = scores.copy(), scores.shape[1], []
    q0 = [look_up(g) for g in scores.sum(0)]
    while True:
        q = [look_up(g) for g in left.sum(0)]
        if not min(q) < threshold:
            return out
        s = q.index(min(q))
        e = s
        while e + 1 < n and q[e + 1] <= min(q):
            e += 1
        for i in [i for i in range(len(left)) if left[i, s : e + 1].any()]:
            rest = left.sum(0) - left[i]
            top = rest[s : e + 1].max()
            while top > 0 and s > 0 and rest[s - 1] >= top:
                s -= 1
            while top > 0 and e + 1 < n and rest[e + 1] >= top:
                e += 1
        a, b = s, e
        while a > 0 and q0[a - 1] < threshold:
            a -= 1
        while b + 1 < n and q0[b + 1] < threshold:
            b += 1
        bounds = [0, n - 1]
        if limit is not None:
            for side, at, step in ((0, s, -1), (1, e, 1)):
                remain = left[:, at].copy()
                while 0 <= at + step < n:
                    at += step
                    added = 0
                    for i in range(len(left)):
                        c = left[i, at]
                        if c < remain[i]:
                            near = left[i, at : at + look] if step > 0 else left[i, max(at - look, 0) : at + 1]
                            c = min(near.max(), remain[i])
                        added += max(c - remain[i], 0)
                        remain[i] = min(c, remain[i])
                    if remain.sum() == 0 or added >= limit:
                        break
                bounds[side] = at
        count = 0
        for i in range(len(left)):
            hit = [x for x in range(s, e + 1) if left[i, x]]
            count += bool(hit)
            for x in hit:
                if not left[i, x]:
                    continue
                lo = hi = x
                while lo > 0 and left[i, lo - 1]:
                    lo -= 1
                while hi + 1 < n and left[i, hi + 1]:
                    hi += 1
                if arms is not None:
                    lo, hi = np.flatnonzero(arms == arms[x])[[0, -1]]
                left[i, max(lo, bounds[0]) : min(hi, bounds[1]) + 1] = 0
        out.append((a, b, s, e, min(q), count))


@pytest.mark.parametrize("mode", ["stretch", "arm", "limited"])
def test_peaks_equal_the_dense_search(mode):
    rng = np.random.default_rng(5)
    for _ in range(25):
        scores = np.zeros((8, 60), int)
        for i in range(8):
            for _ in range(rng.integers(1, 5)):
                a = rng.integers(0, 58)
                scores[i, a : a + rng.integers(1, 25)] = rng.choice([300, 700, 900])
        scores[:, 30:33] = 900
        grid = np.array([0, 1500, 2600, 4000, 5500])
        q = np.array([1.0, 0.5, 0.2, 0.05, 0.001])
        arms = (np.arange(60) >= 35) if mode == "arm" else None
        limit = 1200 if mode == "limited" else None
        found = K.PeakFinder(scores.sum(0), runs_of(scores), grid, q, 0.25, arms, limit).run()
        assert found and [x[:6] for x in found] == dense_peaks(scores, grid, q, 0.25, arms, limit)


def test_peeling_by_stretch_and_arm():
    scores = np.zeros((4, 40), int)
    scores[:, 5:8] = 900  # a peak on the short arm, and a lower one of the same samples further on
    scores[:3, 15:18] = 900
    grid, q = np.array([0, 2700, 3600]), np.array([1.0, 0.1, 0.01])
    arms = np.arange(40) >= 20
    by_stretch = K.PeakFinder(scores.sum(0), runs_of(scores), grid, q).run()
    by_arm = K.PeakFinder(scores.sum(0), runs_of(scores), grid, q, arms=arms).run()
    assert [(s, e) for _, _, s, e, *_ in by_stretch] == [(5, 7), (15, 17)]
    assert [(s, e) for _, _, s, e, *_ in by_arm] == [(5, 7)]
    assert by_stretch[0][6:] == (3600, 5, 7)  # score, and the span above 3600 - 2700


def test_limited_peel_off_leaves_what_others_begin():
    scores = np.zeros((6, 60), int)
    scores[:4, 10:14] = 900
    scores[:2, 10:40] = 900  # two of the peak's samples go on, where others begin
    scores[4:, 20:30] = 900
    grid, q = np.array([0, 1700, 3000]), np.array([1.0, 0.1, 0.01])
    whole = K.PeakFinder(scores.sum(0), runs_of(scores), grid, q).run()
    limited = K.PeakFinder(scores.sum(0), runs_of(scores), grid, q, limit=1700).run()
    assert [x[2:4] + x[5:6] for x in whole][:1] == [x[2:4] + x[5:6] for x in limited][:1] == [(10, 13, 4)]
    assert [x[5] for x in whole[1:]] == [2] and [x[5] for x in limited[1:]] == [4]


def test_lost_heterozygosity_has_scores_of_its_own(spark):
    rows = [(f"m{i}", 1, i * 10, f"s{j}", float(5 <= i < 8 or (i + j) % 9 == 0)) for i in range(40) for j in range(10)] + [("m0", 1, 0, "s0", None)]
    parts = K.loh_contributions(markers_df(spark, rows)).cache()
    g = {r["marker"]: r["g"] for r in K.g_scores(parts).collect()}
    assert g["m6"] == 10_000 and {r["type"] for r in parts.select("type").distinct().collect()} == {"LOH"}
    peaks = K.find_peaks(parts, K.q_values(K.g_scores(parts), K.null_distribution(parts))).orderBy("place").collect()
    assert [(r["type"], r["peak_start"], r["peak_end"], r["n_samples"]) for r in peaks] == [("LOH", 50, 70, 10)]
    regions = spark.createDataFrame([("r", 1, 0, 1000)], "region string, chrom int, start int, end int")
    assert {r["strength"] for r in K.region_strength(markers_df(spark, [("m", 1, 5, "s", 1.0), ("n", 1, 6, "s", 1.0), ("o", 1, 7, "s", 0.0)]), regions, "LOH").collect()} == {1}


def test_permuted_distances(spark):
    rows = [("s", 1, i, int(i % 3 == 0)) for i in range(60)] + [("t", 1, 5, 1), ("t", 1, 9, 0)]
    df = spark.createDataFrame(rows, "sample string, chrom int, pos bigint, marked int")
    got = O.permuted_distances(df, 4)
    assert {(r["iteration"], r["n"]) for r in got.groupBy("iteration").agg(F.sum("n").alias("n")).collect()} == {(i, 19) for i in range(4)}
    again = O.permuted_distances(df, 4)
    assert got.exceptAll(again).count() == 0
