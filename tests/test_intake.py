import random
import re

import pytest

from varloom.operators.packed import Segmenter, frequency_words, learn_dictionary, shape_of, split_packed
from varloom.operators.rejects import WIDTH, judge_lines, parse_quoted, rejected_lines, typed_sites

LINE = "chr1\t5\tA\tC\tC\tC\tAAA\tAAA\t10\t20\t5\t6\t0.5\t0.3\trs1,by,A|0.5\tintronic\tABC1"


@pytest.mark.parametrize("text, want", [
    ("rs1", ["rs1"]),
    ("", []), ("  ", []), (",;/", []),
    ("rs1,byfreq,A|0.9;C|0.1,.", ["rs1", "byfreq", "A|0.9", "C|0.1", "."]),
    ("rs1|byfreq|A|0.9|C|1e-3|.", ["rs1", "byfreq", "A|0.9", "C|1e-3", "."]),
    ("rs1 :: kg1:eur\nA|0,5 , -|0.5", ["rs1", "kg1:eur", "A|0,5", "-|0.5"]),
    ("rs1;;by-pool,,\t.", ["rs1", "by-pool", "."]),
    ('"rs1","a ""b"" c";"x, y"', ["rs1", 'a "b" c', "x, y"]),
    ("rs1,'m; s','t',d'loop,utr3'", ["rs1", "m; s", "t", "d'loop", "utr3'"]),
    ("rs1 “two / both” \"\\\"common\\\" in pool\"", ["rs1", "two / both", '"common" in pool']),
    ('rs1,"open, x', ["rs1", '"open', "x"]),
    ("rs1,near 5' end,x", ["rs1", "near 5' end", "x"]),
    ("A|1,T|0", ["A|1", "T|0"]),
])
def test_segments(text, want):
    assert Segmenter(frequency_words() | {"near 5' end", "by"}).split(text) == want


def test_random_round_trip():
    rng = random.Random(7)
    values = ["rs12", "rs-1", "byfreq", "kg1:all", "A|0.25", "CCA|3e-2", "-|0,5", ".", "d'loop"]
    split = Segmenter(frequency_words()).split
    for _ in range(3000):
        items = [rng.choice(values) for _ in range(rng.randint(1, 9))]
        gaps = [rng.choice([";", " | ", "/", "\t", "\n", " ; ", "；", "&", "::", " ", "|"]) for _ in items[1:]]
        assert split("".join(a + b for a, b in zip(items, [*gaps, ""]))) == items


def test_dictionary_keeps_phrases_not_lists(spark):
    rows = [(i, "rs%d;near 5' end;bypool" % i) for i in range(50)] + [(i, "bypool;bytrio") for i in range(50)]
    rows += [(i, '"bypool;bytrio", "seen; twice", "rs1, gone"') for i in range(5)] + [(i, "T|0.%d,rs2" % i) for i in range(10)]
    rows += [(i, '"too; rare"') for i in range(2)] + [(i, "rs%d,'%s, b'" % (i, "a" * 90)) for i in range(3)] + [(9, None), (9, " ")]
    df = spark.createDataFrame(rows, "k int, v string")
    words = learn_dictionary(df, "v")
    assert words == {"near 0' end": 50, "near 0'": 50, "0' end": 50, "seen; twice": 5, "A|0.0": 10, "a" * 90 + ", b": 3}
    assert learn_dictionary(df.union(df), "v").keys() == words.keys() | {"too; rare"}  # support counts rows, not shares
    with pytest.raises(ValueError):
        learn_dictionary(df, "v", max_words=5)
    assert learn_dictionary(df.limit(0), "v") == {}


def test_dictionary_decides(spark):
    rows = [(i, 'rs%d,"weight 2, 3"' % i) for i in range(5)] + [(9, "rs7/weight 8, 9/C|0.5/.")]
    df = spark.createDataFrame(rows, "k bigint, v string")

    def items(dictionary):
        return [r["item"] for r in split_packed(df, "k", "v", dictionary).where("k = 9").orderBy("item_no").collect()]

    assert items(None) == ["rs7", "weight 8, 9", "C|0.5", "."]
    assert items({"weight 1, 1"}) == ["rs7", "weight 8, 9", "C", "0.5", "."]
    assert items(()) == ["rs7", "weight", "8", "9", "C", "0.5", "."]


def test_dictionary_splits_the_table(spark):
    from pyspark.sql import functions as F

    raw = spark.read.parquet("/root/testdata/sf0.001/naf_taf_inputs.parquet")
    learned, built = learn_dictionary(raw, "dbsnp"), frequency_words()
    texts = [r[0] for r in raw.where(F.col("dbsnp").isNotNull()).select("dbsnp").collect()]
    split = {name: list(map(Segmenter(words).split, texts)) for name, words in (("all", built | set(learned)), ("learned", learned), ("none", ()))}
    assert "A|0.0" in learned and len(learned) > 5
    differ = {name: sum(a != b for a, b in zip(split["all"], split[name])) for name in ("learned", "none")}
    assert differ["none"] > len(texts) // 3 and differ["learned"] < len(texts) // 20


def test_split_packed_edges(spark):
    long = ",".join(["rs%d" % i for i in range(20000)])
    rows = [(1, None, "a"), (2, "", "a"), (3, "rs1", "a"), (4, "rs1,rs1", "a"), (4, "rs1,rs1", "a"), (5, long, None)]
    df = spark.createDataFrame(rows, "k bigint, v string, item string")
    got = split_packed(df, "k", "v", min_items=2)
    assert got.columns == ["k", "item_no", "item"]
    counts = {r["k"]: r["count"] for r in got.groupBy("k").count().collect()}
    assert counts == {4: 4, 5: 20000}
    assert split_packed(df.limit(0), "k", "v").count() == 0
    with pytest.raises(ValueError):
        split_packed(df, "item", "v")


def test_frequency_words():
    assert {shape_of(x) for x in ("A|0.5", "AT|1e-5", "-|.5", "N|0,008", "C|<0.01", "G|5%", "t|0,5E+1")} <= frequency_words()
    assert shape_of("rs12,kg1:eur") == "rs0,kg0:eur"


@pytest.mark.parametrize("line, cols, n, broken", [
    ("", [""], 1, False),
    ("a\tb", ["a", "b"], 2, False),
    ("a\t", ["a", ""], 2, False),
    ('"a\tb"\tc', ["a\tb", "c"], 2, False),
    ('"a""b"\t""', ['a"b', ""], 2, False),
    ('"a', [], 0, True), ('a"b', [], 0, True), ('"a"b\tc', [], 0, True),
])
def test_parse_quoted(line, cols, n, broken):
    got = parse_quoted(line)
    assert got[1:] == (n, broken) and (broken or got[0] == cols)


def test_reasons(spark):
    def swap(at, value):
        cols = LINE.split("\t")
        cols[at] = value
        return "\t".join(cols)

    cases = [
        (1, LINE, None), (2, LINE + "\r", None), (3, None, "column_count"), (4, "", "column_count"),
        (5, LINE + "\tx", "column_count"), (6, swap(0, '"chr1'), "broken_quoting"), (7, swap(9, "32768"), "invalid_totcov_t"),
        (8, swap(9, "0000000032767"), None), (9, swap(9, "７"), "invalid_totcov_t"), (10, swap(9, '"."'), None),
        (11, swap(14, "rs1,A|1.01"), "invalid_dbsnp"), (12, swap(14, "rs1;A|1.0;near 5' end,"), None),
        (13, swap(14, "rs1,A|zero"), "invalid_dbsnp"), (14, swap(14, "RS1"), "invalid_dbsnp"), (15, swap(14, "rs-1"), None),
        (16, swap(16, "A1(dist=5);B-2.3"), None), (17, swap(16, "A1,,B"), "invalid_hugo_symbol"), (18, swap(16, "1A"), "invalid_hugo_symbol"),
        (19, swap(9, "x") + "\n", "invalid_totcov_t"), (20, swap(16, "A\n"), "invalid_hugo_symbol"),
        (21, "\t".join('"%s"' % x for x in LINE.split("\t")), None), (22, swap(14, '"' + "rs1" + '""' * 20000 + '"'), "invalid_dbsnp"),
        (23, swap(16, ";".join(["AB1"] * 20000)), None),
    ]
    df = spark.createDataFrame([(i, x, "s", "r") for i, x, _ in cases] + [(90, "refName\tx", "s", "r"), (91, '"refName"', "s", "r")],
                               "line_id bigint, raw_line string, sample_id string, reason string")
    got = {r["line_id"]: r["reason"] for r in rejected_lines(df).collect()}
    assert got == {i: r for i, _, r in cases if r}
    assert judge_lines(df.limit(0)).count() == 0
    sites = typed_sites(df, keep=("sample_id",))
    assert len(sites.columns) == 3 + WIDTH
    assert {r["line_id"] for r in sites.collect()} == {i for i, _, r in cases if not r}
    assert sites.where("line_id = 10").first()["q20_totcov_t"] is None and sites.where("not_cast IS NOT NULL").count() == 0
    odd = spark.createDataFrame([(1, swap(1, "5x"), "s"), (2, swap(12, "."), "s"), (3, swap(12, "high"), "s")], "line_id bigint, raw_line string, sample_id string")
    assert [r["not_cast"] for r in typed_sites(odd, keep=("sample_id",)).orderBy("line_id").collect()] == ["coordinate", None, "q20_variantratio_n"]
