import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varloom.llm.digests import DELTA, cluster, digest_groups, estimate, merge, merge_digests, percentiles
from varloom.llm.runs import collapse_runs, same_chromosome
from varloom.llm.terms import BurstTrie, choose_routes, count_terms, mark_terms, merge_subtrees, route_of, split_by_route, symbol_terms, whole_term


def brute_runs(rows, near):
    seen = {}
    for s, o, k, p in rows:
        if s is not None and o is not None:
            seen.setdefault(s, {}).setdefault(o, (k, p))
    out = set()
    for s, lines in seen.items():
        run = []
        for o in [*sorted(lines), None]:
            k, p = lines.get(o, (None, None))
            if run and k is not None and p is not None and lines[run[-1]][0] == k and lines[run[-1]][1] is not None and abs(lines[run[-1]][1] - p) <= near:
                run.append(o)
                continue
            if len(run) > 1:
                ps = [lines[x][1] for x in run]
                out.add((s, run[0], run[-1], len(run), max(ps) - min(ps)))
            run = [] if o is None else [o]
    return out


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_runs_match_brute_force(spark, block):
    rng = random.Random(block)
    rows = [("hot", i, "chr1", 5) for i in range(100)]  # one run over many blocks
    for s in "abc":
        p = 0
        for i in range(0, 120, 2):
            p = p + rng.choice([0, 3, -10, 11]) if rng.random() < .8 else None or 0
            rows.append((s, i, rng.choice(["chr1", "1", "Chr01 ", "chr2"]) if rng.random() < .95 else None, p if rng.random() < .95 else None))
    rows += [(None, 1, "chr1", 5), (None, 2, "chr1", 5), ("d", None, "chr1", 5), ("e", 1, "chrMT", 1), ("e", 9, "M", 1), ("f", 1, "chr1", 1)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "sample string, line bigint, chrom string, pos int").withColumn("ptr", F.lit("clash"))
    got = collapse_runs(df, "sample", "line", same_chromosome(F.col("chrom")), F.col("pos"), 10, block=block)
    found = {(r["seq"], r["first"], r["last"], r["n_events"], r["span"]) for r in got.collect()}
    norm = {"chr1": "1", "1": "1", "Chr01 ": "1", "chr2": "2", None: None, "chrMT": "m", "M": "m"}
    assert found == brute_runs([(s, o, norm[k], p) for s, o, k, p in rows], 10)
    assert got.count() == len(found)


@pytest.mark.parametrize("block", [3, 32_768])
def test_sparse_numbers_meet_in_wider_blocks(spark, block):
    rng = random.Random(block)
    lines = sorted([rng.randint(-(2**62), 2**62) for _ in range(60)] + rng.sample(range(-10**9, 10**9), 60) + list(range(-9, 0)) + [-(2**63), 2**63 - 1])
    rows = [("s", o, rng.choice(["1", "1", "1", "2"]), rng.choice([0, 5, 20])) for o in lines]
    df = spark.createDataFrame(rows, "sample string, line bigint, chrom string, pos int")
    got = {tuple(r)[:4] for r in collapse_runs(df, "sample", "line", F.col("chrom"), F.col("pos"), 10, block=block).select("seq", "first", "last", "n_events").collect()}
    assert got == {x[:4] for x in brute_runs(rows, 10)}


def test_runs_of_nothing(spark):
    df = spark.createDataFrame([], "sample string, line bigint, chrom string, pos int")
    assert collapse_runs(df, "sample", "line", F.col("chrom"), F.col("pos")).count() == 0


def rank_error(values, q, share):
    low, high = (values < q).mean(), (values <= q).mean()
    return max(low - share, share - high, 0)


@pytest.mark.parametrize("kind", ["normal", "ties", "one", "inf"])
def test_digest_rank_error(kind):
    rng = np.random.default_rng(3)
    v = {"normal": rng.normal(size=20000), "ties": rng.integers(0, 4, 20000).astype(float), "one": np.array([2.5]),
         "inf": np.r_[rng.normal(size=500), np.inf, -np.inf, np.inf]}[kind]
    parts = [cluster(np.zeros(len(p), int), p, np.ones(len(p))) for p in np.array_split(v, min(len(v), 37))]
    n, low, high, means, weights = merge(pd.concat(parts))
    assert n == len(v) and low == v.min() and high == v.max() and weights.sum() == len(v)
    assert len(means) < 250
    shares = [0, .001, .01, .25, .5, .75, .99, 1]
    for share, q in zip(shares, estimate(low, high, means, weights, shares)):
        assert rank_error(v, q, share) <= max(1 / len(v), 1.6 / DELTA), share


def test_percentiles_certify(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x), None) for x in rng.exponential(size=3000)] + [(None, 1.0, float("nan")), ("x", None, 2.0), ("x", float("nan"), 4.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(7)
    groups, values = {"k": F.col("k"), "all": F.lit("all")}, {"a": F.col("a"), "b": F.col("b")}
    for most in (1000, 0):
        got = percentiles(df, groups, values, shares=(0.1, 0.5), max_broadcast_groups=most, salts=3).collect()
        assert {(r["by"], r["key"], r["field"], r["n"]) for r in got} == {
            ("k", "hot", "a", 3000), ("k", None, "a", 1), ("all", "all", "a", 3001), ("k", "x", "b", 2), ("all", "all", "b", 2)}
        hot = np.array([x[1] for x in rows[:3000]])
        for r in got:
            assert r["rank_error"] <= max(1.6 / DELTA, 1 / r["n"])
            if r["key"] == "hot":
                assert r["n_below"] == (hot < r["estimate"]).sum() and r["n_at"] == (hot == r["estimate"]).sum()
    assert percentiles(df.limit(0), groups, values).count() == 0


def test_number_of_clusters():
    one = cluster(np.zeros(200_000, np.int64), np.linspace(0, 1, 200_000), np.ones(200_000)).iloc[0]
    assert DELTA - 2 <= len(one["means"]) <= DELTA + 3 and one["weights"].max() <= 200_000 * 1.6 / DELTA


def test_layers_merge_until_few_are_left(spark, monkeypatch):
    from varloom.llm import digests

    monkeypatch.setattr(digests, "FAN_IN", 3)
    df = spark.range(4000, numPartitions=20).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 4000).cast("double").alias("v"))
    got = digest_groups(df, {"g": F.col("g")}, {"v": F.col("v")}).collect()
    assert sorted(r["n"] for r in got) == [1333, 1333, 1334]
    for r in got:
        middle = estimate(r["low"], r["high"], np.array(r["means"]), np.array(r["weights"]), [.5])[0]
        assert abs(middle / 4000 - .5) < 1.6 / DELTA


def test_registered_percentiles_keep_the_bound(spark):
    from varloom.llm.queries import p3_percentiles

    rows = p3_percentiles(spark, "/root/testdata/sf0.01").where(F.col("rank_error") > F.greatest(F.lit(1.6 / DELTA), 1 / F.col("n")))
    assert rows.count() == 0


def test_parts_combine(spark):
    df = spark.range(5000).select((F.col("id") % 5).alias("day"), F.col("id").cast("double").alias("v"))
    days = digest_groups(df, {"day": F.col("day")}, {"v": F.col("v")})
    assert days.count() == 5
    one = merge_digests(days, ["field"]).first()
    assert one["n"] == 5000 and (one["low"], one["high"]) == (0, 4999)
    assert abs(estimate(one["low"], one["high"], np.array(one["means"]), np.array(one["weights"]), [.5])[0] - 2499.5) < 25


def _random_terms(rng, n=3000):
    return ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) + ("q" * 70 + rng.choice("xyz") if rng.random() < .1 else "") for _ in range(n)]


def test_burst_trie():
    trie, want = BurstTrie(burst=3), {}
    rng = random.Random(1)
    for t in _random_terms(rng):
        trie.add(t, 2, 1)
        o, r = want.get(t, (0, 0))
        want[t] = (o + 2, r + 1)
    got = {p + s: (o, r) for p, _, ss, os, rs in trie.subtrees() for s, o, r in zip(ss, os, rs)}
    assert got == want and trie.size == len(want)
    assert max(len(b) for b in trie.containers.values()) <= 3
    assert all(way[-1] == len(p) and way[0] == 0 for p, way, *_ in trie.subtrees())
    deep = BurstTrie(burst=3)  # no prefix is too long to burst
    terms = ["x" * 5000 + str(i) for i in range(20)] + ["x" * 4000 + "y" * i for i in range(20)] + ["x" * i for i in range(20)]
    for t in terms:
        deep.add(t, 1, 1)
    assert max(map(len, deep.containers.values())) <= 3 and {p + x for p, _, s, _, _ in deep.subtrees() for x in s} == set(terms)


def test_subtrees_are_routed_whole_and_merged():
    rng, want, trees = random.Random(3), {}, []
    for burst in (3, 5, 50, 4000):  # tries that burst at different places
        trie = BurstTrie(burst)
        for t in _random_terms(rng, 800):
            trie.add(t, 1, 1)
            want[t] = want.get(t, 0) + 1
        trees += [(p, s, np.array(o), np.array(r)) for p, _, s, o, r in trie.subtrees()]
    routes = ["", "a", "aab", "ab", "abba", "b", "bq"]
    cut, routed = 0, {}
    for p, s, o, r in trees:
        parts = list(split_by_route(p, s, routes))
        cut += len(parts) > 1
        assert sorted((a, b) for _, a, b in parts) == list(zip([0, *sorted(b for _, _, b in parts)], sorted(b for _, _, b in parts)))
        for to, a, b in parts:
            assert all(route_of(routes, p + x) == to for x in s[a:b])
            routed.setdefault(to, []).append((p, s[a:b], o[a:b], r[a:b]))
    assert 0 < cut < len(trees) / 2
    got = {}
    for to, parts in routed.items():
        for p, s, o, r in merge_subtrees(iter(parts)):
            assert s == sorted(set(s)) and not any(p + x in got for x in s)
            got.update(zip((p + x for x in s), o.tolist()))
    assert got == want


def test_routes():
    weights = [("f", "", 954), ("f", "a", 950), ("f", "ab", 900), ("f", "abc", 400), ("f", "b", 3)]
    found = choose_routes(weights, 100, 64)["f"]
    assert found == {"": 1, "a": 1, "ab": 5, "abc": 4, "b": 1}  # 500 terms of small branches stay with "ab"
    routes = list(found)
    for term, want in (("abcd", "abc"), ("abd", "ab"), ("ax", "a"), ("zz", ""), ("", ""), ("b", "b"), ("abcz", "abc")):
        assert route_of(routes, term) == want
    assert choose_routes([("f", "", 5)], 100, 64) == {"f": {"": 1}}


@pytest.mark.parametrize("burst, hold, route_terms", [(4096, 500000, 200000), (2, 5, 4)])
def test_counts_match_brute_force(spark, burst, hold, route_terms):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(60)] + ["é" * 300, "é" * 2000 + "a", "é" * 2000 + "b", "\U0010ffff", "\U0010ffffa", "", "w1x"]
    rows = [(["hot"] if i % 3 else []) + [rng.choice(words) for _ in range(rng.randint(0, 4))] for i in range(400)] + [None, []]
    df = spark.createDataFrame([(r,) for r in rows], "terms array<string>").withColumn("field", F.lit("clash")).repartition(5)
    got = count_terms(df, {"x": F.col("terms")}, burst, hold, route_terms)
    want = {}
    for r in rows:
        for t in set(r or []):
            o, n = want.get(t, (0, 0))
            want[t] = (o + r.count(t), n + 1)
    rows_got = got.collect()
    assert {r["term"]: (r["occurrences"], r["records"]) for r in rows_got} == want and len(rows_got) == len(want)
    marks = {r["term"]: r["mark"] for r in mark_terms(got, 402).collect()}
    assert marks["hot"] == "common" and all((m == "rare") == (want[t][1] < 3) for t, m in marks.items())
    assert count_terms(df.limit(0), {"x": F.col("terms")}).count() == 0


def test_term_rules(spark):
    cases = [("A1(dist=5);B2 (alt;2) / 'c3' | \"D\"", ["a1", "b2", "c3", "d"]), (".", []), ("NONE, A", ["a"]), (None, None), (" ", []), ("X(dist=", ["x"])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(symbol_terms(F.col("v"))).collect()] == [w for _, w in cases]
    df = spark.createDataFrame([(" UTR3 ",), ("upstream;Downstream",), ("None",), (None,)], "v string")
    assert [r[0] for r in df.select(F.coalesce(whole_term(F.col("v")), F.array())).collect()][:3] == [["utr3"], ["upstream;downstream"], []]
