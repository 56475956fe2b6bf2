"""The region caller against a plain, site-by-site version of its rules, on called sites and on random ones."""

import math
import os
import random

import pytest
from oracle import DATA

from varloom.operators import segment as X
from varloom.queries import sites as Q

LISTS = [[0.5], [0.4, 0.6], [1 / 3, 2 / 3], [0.3, 0.7], [0.25, 0.75], [0.2, 0.8], [0.15, 0.85], [0.1, 0.9], [0.05, 0.95], [0.005, 0.995], [0.0001, 0.9999]]
CN_EVENTS = {"LOH", "cnLOH", "GainSomatic", "GainGermline"}


def pmf(means, x):
    best = None
    for m in sorted(means):
        p = math.exp(x * math.log(100 * m) - 100 * m - math.lgamma(x + 1))
        if best is not None and p <= best:
            break
        best = p
    return best


PMF = [[pmf(c, x) for x in range(101)] for c in LISTS]


def het(s):
    return s["cov_n"] > 0 and 10 * s["cov_n"] < 100 * s["var_n"] <= 90 * s["cov_n"]


def mean_cn(sites):
    return sum(s["cn"] for s in sites) / len(sites)


def is_event(sites, target):
    if len(sites) < 2:
        return False
    v = [s["adj_vaf_t"] for s in sites if het(s) and 0 < s["var_n"] < s["cov_n"] and s["adj_vaf_t"] is not None]
    if not v:
        return False
    scores = [sum(row[min(max(math.floor(100 * a + 0.5), 0), 100)] for a in v) for row in PMF]
    winner = scores.index(max(scores))
    if winner == 0:
        return False
    bins = [0] * 11
    for a in v:
        bins[min(int(a * 11), 10)] += 1
    shares = [math.floor(100 * b / len(v) + 0.5) for b in bins]  # whole percentages, against equal ones of the same sum
    stat = sum((x - sum(shares) / 11) ** 2 / (sum(shares) / 11) for x in shares)
    if math.exp(-stat / 2) * sum((stat / 2) ** i / math.factorial(i) for i in range(5)) >= 0.05:
        return False
    if target == "cnLOH" and 1.25 < mean_cn(sites) < 2.5:
        near = lambda c: sum(c - 0.04 < a <= c + 0.04 for a in v)
        return all(near(m) > near(0.5) for m in LISTS[winner])
    return True


def rule(target, cn):
    return {"LOH": 1.1 < cn <= 1.8, "cnLOH": 1.8 < cn < 2.2, "GainSomatic": cn >= 2.2}[target]


def regions_of(sites):
    out, last = [], None
    for i, s in enumerate(sites):
        if s["event"] in ("Noise", "Ignored", "HETSomatic") or s["pos"] == last:
            continue
        last = s["pos"]
        if out and out[-1][2] == s["event"]:
            out[-1][1] = i
        else:
            out.append([i, i, s["event"]])
    return out


def merged(sites, target):
    def combine(a, b, same):
        between = sites[a[1] + 1 : b[0]]
        k = sum(map(het, between))
        if same and k == 0:
            return True
        return is_event(sites[a[0] : b[1] + 1] if k < 8 else between, target)

    out, ext = [], None
    for r in regions_of(sites):
        if r[2] == target:
            ok = ext is not None and combine(ext, r, True)
            if ok and sites[ext[1] + 1 : r[0]]:
                ok = rule(target, mean_cn(sites[ext[1] + 1 : r[0]]))
            if ok:
                ext[1] = r[1]
            else:
                ext = list(r)
                out.append(ext)
        elif r[2] in CN_EVENTS:
            ext = None
        elif ext is not None and r[2] == "HETGermline" and combine(ext, r, False) and rule(target, mean_cn(sites[r[0] : r[1] + 1])):
            ext[1] = r[1]
    return out


def brute(sites):
    for _ in range(3):
        for target in ("GainSomatic", "LOH", "cnLOH"):
            for a, b, _ in merged(sites, target):
                inside = sites[a : b + 1]
                good = is_event(inside, target)
                for s in inside:
                    if good and s["event"] in ("HETGermline", "Noise", "Ignored"):
                        s["event"] = target
                    elif not good and s["event"] == target and s["cn"] < 3.8:
                        s["event"] = "HETGermline"
    for a, b, _ in regions_of(sites):
        m = mean_cn(sites[a : b + 1])
        for s in sites[a : b + 1]:
            s["cn"] = m
    return sites


def compare(spark, rows):
    schema = "sample string, chrom int, pos int, event string, cn double, adj_vaf_t double, var_n int, cov_n int"
    names = [c.split()[0] for c in schema.split(", ")]
    groups, want, moved = {}, {}, 0
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[:2], []).append(dict(zip(names, r)))
    for group in groups.values():
        before = [s["event"] for s in group]
        for s, e in zip(brute(group), before):
            want[s["sample"], s["chrom"], s["pos"]] = (s["event"], round(s["cn"], 9))
            moved += s["event"] != e
    got = {(r["sample"], r["chrom"], r["pos"]): (r["event"], round(r["cn"], 9)) for r in X.call_regions(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    return moved


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_called_sites(spark, folder):
    called = Q.C.call_events(Q._prepared(spark, folder, True)).select("sample", "chrom", "pos", "event", "cn", "adj_vaf_t", "var_n", "cov_n")
    rows = [tuple(r) for r in called.collect()]
    assert len(rows) > 1000 and compare(spark, rows) > 0


def test_random_chromosomes(spark):
    rng = random.Random(4)
    rows = []
    for c in range(1, 23):
        pos, event, cn, f = 0, "HETGermline", 2.0, 0.5
        for _ in range(rng.randint(5, 150)):
            pos += rng.randint(1, 1000)
            if rng.random() < 0.08:
                event = rng.choice(["HETGermline", "LOH", "cnLOH", "GainSomatic"])
                cn, f = {"HETGermline": (2.0, 0.5), "LOH": (1.4, 0.8), "cnLOH": (2.0, 0.85), "GainSomatic": (3.0, 0.67)}[event]
            vaf = min(max((f if rng.random() < 0.5 else 1 - f) + rng.gauss(0, 0.05), 0.0), 1.0)
            seen = event if rng.random() < 0.8 else rng.choice(["HETGermline", "Noise", "Ignored", "HETSomatic", "LOH", "DELHom", "GainGermline"])
            rows.append(("s", c, pos, seen, max(0.1, cn + rng.gauss(0, 0.2)), vaf if rng.random() < 0.97 else None, rng.choice([45, 50, 60, 5, 100]), 100))
    assert compare(spark, rows) > 100
