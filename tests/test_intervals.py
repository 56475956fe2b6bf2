import itertools
import random

import pytest
from pyspark.sql import functions as F

from varloom.plans import intervals as I
from varloom.plans.joins import sized_join


def intervals(rng, n, top=200, long=30):
    out = []
    for i in range(n):
        a = rng.randint(1, top)
        out.append((rng.choice([1, 2]), a, a + rng.randint(0, long), i))
    return out


@pytest.mark.parametrize("width", [7, 1000])
def test_points_and_overlaps_match_brute_force(spark, width):
    rng = random.Random(1)
    pts = [(rng.choice([1, 2, 3]), rng.randint(1, 230), i) for i in range(150)] + [(None, 5, 900), (1, None, 901)]
    ivs, more = intervals(rng, 40), intervals(rng, 30)
    p = spark.createDataFrame(pts, "c int, pos int, i int")
    a = spark.createDataFrame(ivs + [(1, None, 3, 99), (1, 9, 3, 98)], "c int, lo int, hi int, k int")
    b = spark.createDataFrame(more, "c int, blo int, bhi int, j int")
    want = {(i, k) for c, x, i in pts if x is not None for d, lo, hi, k in ivs if c == d and lo <= x <= hi}
    got = I.points_in_intervals(p, a, ["c"], "pos", "lo", "hi", width=width)
    assert sorted((r["i"], r["k"]) for r in got.collect()) == sorted(want)
    hit = {i for i, _ in want}
    assert {r["i"] for r in I.points_in_intervals(p, a, ["c"], "pos", "lo", "hi", "semi", width).collect()} == hit
    assert {r["i"] for r in I.points_in_intervals(p, a, ["c"], "pos", "lo", "hi", "anti", width).collect()} == {i for *_, i in pts} - hit
    assert I.points_in_intervals(p, a, ["c"], "pos", "lo", "hi", "left", width).count() == len(want) + len(pts) - len(hit)
    good = a.where("k < 90")
    pairs = {(k, j) for c, lo, hi, k in ivs for d, x, y, j in more if c == d and lo <= y and x <= hi}
    got = I.overlapping_intervals(good, b, ["c"], ("lo", "hi"), ("blo", "bhi"), width=width)
    assert sorted((r["k"], r["j"]) for r in got.collect()) == sorted(pairs)
    assert {r["k"] for r in I.overlapping_intervals(good, b, ["c"], ("lo", "hi"), ("blo", "bhi"), "semi", width).collect()} == {k for k, _ in pairs}
    assert {r["k"] for r in I.overlapping_intervals(good, b, ["c"], ("lo", "hi"), ("blo", "bhi"), "anti", width).collect()} == {r[3] for r in ivs} - {k for k, _ in pairs}


@pytest.mark.parametrize("block", [3, 50, 10**9])
def test_islands_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(k, t, rng.choice("xy") if rng.random() < 0.9 else None) for k in ("a", "b", None) for t in sorted(rng.sample(range(300), 80))]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    for gap in (None, 9):
        extra = None if gap is None else F.col("t") - F.col("prev_t") > gap
        got = I.ordered_islands(df, ["k"], "t", ["v"], extra_break=extra, block=block).collect()
        assert len(got) == len(rows)
        want = []
        for k in ("a", "b", None):
            own = [(t, v) for kk, t, v in rows if kk == k]
            run = [own[0][0]]
            for (t0, v0), (t1, v1) in zip(own, own[1:]):
                if v0 != v1 or (gap and t1 - t0 > gap):
                    want.append((k, tuple(run)))
                    run = []
                run.append(t1)
            want.append((k, tuple(run)))
        found = {}
        for r in got:
            found.setdefault((r["k"], r["island"]), []).append(r["t"])
        assert sorted(((k, tuple(sorted(ts))) for (k, _), ts in found.items()), key=repr) == sorted(want, key=repr)


def test_disjoin_by_hand_and_in_any_order(spark):
    rows = [(1, 10), (1, 1), (4, 5), (9, 10), (5, 9)]
    want = {(1, 1, 2), (2, 3, 1), (4, 4, 2), (5, 5, 3), (6, 8, 2), (9, 9, 3), (10, 10, 2)}
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 40):
        df = spark.createDataFrame([(2, a, b) for a, b in order], "chrom int, start int, end int")
        got = {(r["start"], r["end"], r["recurrence"]) for r in I.disjoin(df, ["chrom"], "start", "end").collect()}
        assert got == want
    scored = I.splice_scores(spark.createDataFrame([(1, 1, 5, 3), (1, 4, 8, 7)], "c int, lo int, hi int, s int"), ["c"], "lo", "hi", "s")
    assert {(r["start"], r["end"], r["max_score"], r["sum_score"], r["depth"]) for r in scored.collect()} == {(1, 3, 3, 3, 1), (4, 5, 7, 10, 2), (6, 8, 7, 7, 1)}


@pytest.mark.parametrize("block", [None, 5])
def test_asof_and_nearest(spark, block):
    rng = random.Random(2)
    left = [(k, rng.randint(-50, 50), i) for i, k in enumerate("ab" * 60)]
    right = [(k, t, t * 10) for k in "ab" for t in rng.sample(range(-45, 45), 12)]
    a, b = spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v int")
    got = {r["i"]: r["f"] for r in I.asof_floor(a, b, ["k"], "t", "v", "f", F.lit(-999), block).collect()}
    assert got == {i: max((u, v) for kk, u, v in right if kk == k and u <= t)[1] if any(kk == k and u <= t for kk, u, _ in right) else -999 for k, t, i in left}
    near = {r["i"]: (r["v"], r["distance"]) for r in I.nearest(a, b, ["k"], "t", "v").collect()}
    for k, t, i in left:
        d, u, v = min((abs(t - u), u > t, v) for kk, u, v in right if kk == k)
        assert near[i] == (v, d)


def test_gaps_tile_the_sites(spark):
    rng = random.Random(3)
    sites = spark.createDataFrame([("s", 1, p) for p in sorted(rng.sample(range(1000), 200))], "sample string, chrom int, pos int")
    regions = spark.createDataFrame([("s", 1, 100, 180), ("s", 1, 300, 310), ("s", 1, 311, 400)], "sample string, chrom int, start int, end int")
    got = sorted(I.gap_regions(sites, regions, ["sample", "chrom"], "pos", "start", "end").collect(), key=lambda r: r["start"])
    assert sum(r["n_sites"] for r in got) == 200
    assert all(a["end"] < b["start"] for a, b in zip(got, got[1:]))
    assert [r["is_gap"] for r in got] in ([True, False, True, False, False, True], [True, False, True, False, True])


def test_overlap_classes(spark):
    ranges = [(1, 1, 1000), (2, 1, 1), (2, 1, 1), (2, 1, 10), (2, 4, 5), (2, 9, 10), (2, 5, 9), (2, 6, 8), (2, 12, 13)]
    df = spark.createDataFrame([(*a, *b) for a in ranges for b in ranges], "a int, b int, c int, d int, e int, f int")
    rows = df.withColumn("x", I.overlap_class(*[F.col(c) for c in "abcdef"])).collect()
    flip = {"Equals": "Equals", "SubsumesTotal": "ConsumedByTotal", "SubsumesAlignedLeft": "ConsumedByAlignedLeft", "SubsumesAlignedRight": "ConsumedByAlignedRight",
            "BeforeWithOverlap": "AfterWithOverlap", "AdjacentBefore": "AdjacentAfter", "BeforeWithoutOverlap": "AfterWithoutOverlap", "BeforeViaDiffChromosome": "AfterViaDiffChromosome"}
    flip |= {v: k for k, v in flip.items()}
    by = {tuple(r[:6]): r["x"] for r in rows}
    for a in ranges:
        for b in ranges:
            assert by[(*b, *a)] == flip[by[(*a, *b)]]
            overlap = a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]
            assert overlap == (by[(*a, *b)] in ("Equals",) or "Sub" in by[(*a, *b)] or "Consumed" in by[(*a, *b)] or "WithOverlap" in by[(*a, *b)])


def test_midpoints_and_points(spark):
    seg = spark.createDataFrame([("s", 10, 20), ("s", 31, 40)], "k string, lo int, hi int")
    got = {(r["lo"], r["fill_start"], r["fill_end"]) for r in I.fill_midpoints(seg, ["k"], "lo", "hi").collect()}
    assert got == {(10, 10, 25), (31, 26, 40)}
    assert I.sample_points(seg, "lo", "hi", 5).count() == 6 + 10


def test_anchor_groups(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate([1, 3, 11, 12, 21, 40])] + [("b", 5, 9)], "k string, t int, i int")
    got = {r["i"]: r["anchor"] for r in I.anchor_groups(df, ["k"], ["t"], "t", 10).collect()}
    parts = {}
    for i, g in got.items():
        parts.setdefault(("b" if i == 9 else "a", g), []).append(i)
    assert sorted(map(sorted, parts.values())) == [[0, 1], [2, 3], [4], [5], [9]]


@pytest.mark.parametrize("most", [10, 0])
def test_sized_join(spark, most):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [(None, 99), ("x", 100)], "k string, i int")
    right = spark.createDataFrame([("hot", 1.0), ("y", 2.0)], "k string, v double")
    got = sized_join(left, right, ["k"], max_broadcast_rows=most, salts=4)
    assert got.count() == 52 and got.where("v = 1.0").count() == 50
    assert sized_join(left, right, ["k"], "inner", most, 4).count() == 50
