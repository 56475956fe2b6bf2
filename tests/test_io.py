import os

import pytest
from pyspark.sql import functions as F

from varloom.sources import tables as T
from varloom.streaming import windows as W

HEADER = "refName\tcoordinate\trefBase\tvarBase\tvariantBase-N\tvariantBase-T\trefEnv-N\trefEnv-T\tQ20_TotCov_N\tQ20_TotCov_T\tQ20_VarCov_N\tQ20_VarCov_T\tQ20_VariantRatio_N\tQ20_VariantRatio_T\tdbsnp\tMutationType\tHugo_Symbol"
LINE = "chr%s\t%d\tA\tC\tC\tC\tAAA\tAAA\t10\t20\t5\t6\t0.5\t0.3\trs1\tintronic\tABC1"


def test_read_sites(spark, tmp_path):
    (tmp_path / "S1.lohInput.txt").write_text("\n".join([HEADER, LINE % ("1", 5), HEADER, LINE % ("Y", 6), LINE % ("2", 7), "bad"]) + "\n")
    (tmp_path / "S2.lohInput.txt").write_text("")
    got = T.read_sites(spark, str(tmp_path)).collect()
    assert sorted((r["sample_id"], r["refname"], r["coordinate"], r["q20_totcov_t"]) for r in got) == [("S1", "chr1", 5, 20), ("S1", "chr2", 7, 20)]
    assert T.read_lines(spark, str(tmp_path / "none.txt")).count() == 0
    assert not T.exists(spark, str(tmp_path / "none.txt"))


def test_tables(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    r = T.read_regions(spark, put("r.txt", "p\tchr1\t5\t9\np\tX\t1\t2\t7\t0.5\tLOH\np\tbad\t1\t2\n")).orderBy("chrom").collect()
    assert [tuple(x) for x in r] == [("p", 1, 5, 9, 0, 0.0, "Ignored"), ("p", 23, 1, 2, 7, 0.5, "LOH")]
    bands = T.read_cytobands(spark, put("b.txt", "chr1\t0\t100\tp1\nchr1\t100\t300\tq1\n"))
    assert {(x["band"], x["start"], x["end"]) for x in bands.collect()} == {("p1", 1, 100), ("q1", 101, 300), ("pter", 0, 0), ("qter", 301, 301)}
    assert {(x["arm"], x["broad_length"]) for x in T.broad_thresholds(bands).collect()} == {("p", 50), ("q", 100)}
    good, bad = T.read_gene_locations(spark, put("g.txt", "1\tA\t+\tchr1\t\t5\t9\n1\tA\t+\tchr1\t\t5\t9\n2\tB\t+\tzz\t\t5\t9\n"))
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError):
        T.read_gene_locations(spark, put("g2.txt", "1\tA\t+\tchr1\t\t5\t9\n1\tA\t+\tchr2\t\t5\t9\n"))
    seg = T.read_segments(spark, put("s.txt", "ID\tchrom\ts\te\tn\tv\na\t1\t1\t9\t3\t0.5\na\t1\t10\t19\t2\tNA\na\t2\t1\t9\t300\t0.7\n"), 1, 100)
    assert sorted((x["chrom"], x["value"]) for x in seg.collect()) == [(1, 0.5), (2, 0.0)]
    m = T.read_marker_matrix(spark, put("m.txt", "Marker\tChr\tPos\tScore1\tS1\tS2\nm1\t1\t5\t9\t0.5\tNA\n"))
    assert {(x["sample"], x["value"]) for x in m.collect()} == {("S1", 0.5), ("S2", None)}
    assert T.read_settings(spark, put("spec.txt", "a 1\n# no\nb  x y\nc\n")) == {"a": "1", "b": "x y", "c": ""}
    a = T.read_allelic_bias(spark, put("ab.txt", "chr1\t5\trs\t3\t0.5\t2.0\n")).first()
    assert (a["chrom"], a["pos"], a["n_samples"], a["avg_abs_cn"]) == (1, 5, 3, 2.0)
    assert T.read_mutation_bed(spark, put("mb.txt", "chr1\t5\t6\tx\t-1\n")).first()["value"] == -1.0
    assert T.read_transcripts(spark, put("t.txt", "\t".join(["0", "1", "chr1_x", "3", "5", "9", "6", "7", "8", "9", "10", "11", "G"]) + "\n")).first()["gene"] == "G"
    assert T.read_region_list(spark, put("l.txt", "chr3\t1\t2\n")).first()["chrom"] == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 10), (1, 7, None), (2, 1, -1), (1, 5, None)], "chrom int, pos int, rs int")
    assert {(r["probe"], r["pos"]) for r in T.probe_map(df).collect()} == {("rs10", 5), ("novel_1", 7), ("novel_2", 1)}
    T.write_tsv(df.na.fill(0), str(tmp_path / "o"), True, "chrom")
    assert spark.read.csv(str(tmp_path / "o"), sep="\t", header=True).count() == 4
    T.write_track(spark.createDataFrame([(1, 5, "x")], "chrom int, start int, value string"), str(tmp_path / "t"), "track")
    assert {r[0] for r in spark.read.text(str(tmp_path / "t")).collect()} == {"track", "x"}
    wide = T.pivot_matrix(df.select("chrom", F.col("pos").cast("string").alias("p"), F.lit(1).alias("n")), "chrom", "p", "n")
    assert wide.columns == ["chrom", "1", "5", "7"]
    with pytest.raises(ValueError):
        T.pivot_matrix(df.select("chrom", "pos", F.lit(1).alias("n")), "chrom", "pos", "n", 1)
    assert [r[0] for r in T.sorted_copy(spark.createDataFrame([("10",), ("9",)], "x string"), [("x", "number", True)]).collect()] == ["9", "10"]


def run_stream(spark, tmp_path, parts, schema, build, mode="append"):
    src = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"{i}"))
        for f in (src / f"{i}").glob("*.parquet"):
            os.utime(f, (1_000_000_000 + 100 * i,) * 2)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    q = build(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        return spark.sql("SELECT * FROM out").collect()
    finally:
        q.stop()


def test_streaming_runs_and_windows(spark, tmp_path):
    rows = [[("k", 1, "x"), ("k", 2, "x")], [("k", 3, "x"), ("k", 4, "y"), ("k", 5, "x")]]
    got = run_stream(spark, tmp_path / "a", rows, "k string, t bigint, v string", lambda s: W.runs(s, "k", "t", "v"))
    assert {(r["v"], r["first"], r["last"], r["n"]) for r in got} == {("x", 1, 3, 3), ("y", 4, 4, 1)}
    rows = [[("k", 1, True), ("k", 2, False)], [("k", 3, True), ("k", 4, True)]]
    got = run_stream(spark, tmp_path / "b", rows, "k string, t bigint, f boolean", lambda s: W.last_rows(s, "k", "t", "f", 3))
    assert {(r["t"], r["n"], r["n_flagged"]) for r in got} == {(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 3, 2)}


def test_streaming_late_rows(spark, tmp_path):
    from datetime import datetime

    t = lambda h, m=0: datetime(2031, 1, 1, h, m)
    rows = [[(t(1), "a", 1.0), (t(1, 30), "a", 2.0)], [(t(9), "a", 5.0)], [(t(9, 10), "a", 5.0)], [(t(1, 10), "a", 100.0)], [(t(20), "a", 1.0)]]
    got = run_stream(spark, tmp_path / "c", rows, "ts timestamp, k string, v double", lambda s: W.event_counts(s, "ts", "k", "v"))
    assert (t(1), 2, 3.0) in {(r["start"], r["n"], r["total"]) for r in got}


def test_cuts_lie_in_the_shared_folder(spark):
    from varloom.plans.cut import cut, drop, root_of, shared_dir

    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir") + "/varloom-")
    table = cut(spark.range(5))
    assert table.count() == 5 and table.inputFiles()[0].startswith("file:///") and "/shared" in table.inputFiles()[0]
    drop(table)
    assert root_of("hdfs://x/y/", "spark://m:7077") == "hdfs://x/y" and root_of(None, "local[4]").startswith("file://")
    for master in ("spark://m:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            root_of(None, master)


def test_broadcast_by_rows_and_characters(spark):
    from varloom.plans.joins import sized_join, small

    wide = spark.createDataFrame([(1, "a" * 1000), (2, None)], "k int, v string")
    assert small(wide) and not small(wide, max_rows=1) and not small(wide, max_chars=900)
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    for chars in (900, 10_000):
        assert sorted((r["k"] or 0, len(r["v"] or "")) for r in sized_join(left, wide, ["k"], max_broadcast_chars=chars).collect()) == [(0, 0), (1, 1000), (2, 0), (3, 0)]


def test_settings_are_read_whole(spark, tmp_path):
    from varloom.sources.tables import read_settings

    (tmp_path / "s.txt").write_text("# c\n\n  # d\n" + "".join(f"k{i} v {i}\n" for i in range(12_000)) + "k5\n")
    got = read_settings(spark, str(tmp_path / "s.txt"))
    assert len(got) == 12_000 and got["k11999"] == "v 11999" and got["k5"] == ""


def test_smaller_readers_and_writers(spark, tmp_path):
    from varloom.operators import origins as O

    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert [tuple(r) for r in T.read_groups(spark, put("g", "a\t1\nb\t2\nc\t3\nd\n")).orderBy("sample").collect()] == [("a", 1), ("b", 2)]
    assert [tuple(r) for r in T.read_driver_map(spark, put("d", "t1\td1\nt1\td1\nt2\n \td\n")).collect()] == [("t1", "d1")]
    roster = T.read_roster(spark, put("p", "P\tx\tx\ty\tx\n\nQ\n"))
    assert [tuple(r) for r in roster.orderBy("pathway", "gene").collect()] == [("P", "x"), ("P", "x"), ("P", "y")]
    assert T.read_roster(spark, str(tmp_path / "p"), skip_adjacent=False).count() == 4
    assert {tuple(r) for r in T.read_table(spark, put("h", "k\tv\na\t1\nb\t2\na\t3\n"), "k").collect()} == {("a", "3"), ("b", "2")}
    assert T.read_table(spark, str(tmp_path / "h")).count() == 3
    signed = O.read_signed(T.read_mutation_bed(spark, put("m", "chr1\t5\t6\tx\t-1\nchrX\t7\t8\tx\t2\n"))).orderBy("pos").collect()
    assert [tuple(r) for r in signed] == [(1, 5, False), (23, 7, True)]
    sites = spark.createDataFrame([("s", 1, 5, 10, "LOH"), ("t", 1, 9, -1, "cnLOH")], "sample string, chrom int, pos int, rs int, event string")
    T.write_probes(sites, str(tmp_path / "probes"))
    assert {tuple(r) for r in T.read_probes(spark, str(tmp_path / "probes")).collect()} == {("rs10", 1, 5), ("novel_1", 1, 9)}
    T.write_classified(sites, str(tmp_path / "classified"))
    assert sorted(p.name for p in (tmp_path / "classified").glob("sample=*")) == ["sample=s", "sample=t"]
    assert {r["event"] for r in spark.read.csv(str(tmp_path / "classified"), sep="\t", header=True).collect()} == {"LOH", "cnLOH"}
    regions = spark.createDataFrame([("p", 1, 5, 9, 3, 0.5, "LOH")], "sample string, chrom int, start int, end int, n int, value double, event string")
    T.write_regions(regions, str(tmp_path / "regions"))
    assert [tuple(r) for r in T.read_regions(spark, str(tmp_path / "regions")).collect()] == [("p", 1, 5, 9, 3, 0.5, "LOH")]
    paths = T.write_tables({"a": sites, "b": regions}, str(tmp_path / "run"))
    assert [spark.read.csv(p, sep="\t", header=True).count() for p in paths] == [2, 1]
    lines = T.bedgraph_lines(regions.withColumn("score", F.lit(7)).withColumn("chrom", F.lit(23)))
    assert [r["value"] for r in lines.collect()] == ["chrX 4 9 7"]
    assert T.track_header("n", "d") == 'track name="n" description="d" useScore=1'
    assert T.session_xml("hg", ["a&b.bed"]).count("<Resource path=\"a&amp;b.bed\"/>") == 1


def test_streaming_deduplicates_within_the_watermark(spark, tmp_path):
    from datetime import datetime

    t = lambda h: datetime(2031, 1, 1, h)
    rows = [[(t(1), "a"), (t(1), "a"), (t(1), "b")], [(t(2), "a")], [(t(8), "c")], [(t(8), "d")], [(t(9), "a")]]
    got = run_stream(spark, tmp_path / "d", rows, "ts timestamp, k string", lambda s: W.deduplicate(s, "ts", ["k"]))
    assert sorted((r["k"], r["ts"].hour) for r in got) == [("a", 1), ("a", 9), ("b", 1), ("c", 8), ("d", 8)]
