"""Reading and writing the project's tab-separated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.genomics import chrom_code
from ..operators.qc import drop_headers
from ..operators.rejects import typed_sites

SITE_SUFFIX = "Input.txt"
REGION_COLUMNS = ("sample", "chrom", "start", "end", "n_markers", "log2_ratio", "event", "genes")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_lines(spark: SparkSession, path: str, trim: bool = False, skip_blank: bool = False) -> DataFrame:
    """Lines with their file and the file's order kept in ``line_no``; a missing path gives no lines.

    Order within a file is that of the file's splits and offsets, as the reader's ids grow along them.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "file_name string, line_no bigint, raw_line string")
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw_line"))
    if trim:
        lines = lines.withColumn("raw_line", F.trim("raw_line"))
    return lines.where(F.trim("raw_line") != "") if skip_blank else lines


def read_sites(spark: SparkSession, folder: str, suffix: str = SITE_SUFFIX) -> DataFrame:
    """Typed sites of every file of a folder with the suffix; the sample is the name before its first dot."""
    lines = drop_headers(read_lines(spark, f"{folder}/*{suffix}"), "raw_line")
    lines = lines.withColumn("sample_id", F.substring_index("file_name", ".", 1)).withColumn("line_id", F.col("line_no"))
    return typed_sites(lines)


def _read(spark: SparkSession, path: str, columns: int, header: bool = False) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(columns))
    return spark.read.csv(path, sep="\t", schema=schema, header=header, mode="PERMISSIVE", enforceSchema=True)


def read_allelic_bias(spark: SparkSession, path: str, copy_number: bool = True) -> DataFrame:
    """chrom, pos, n_samples, avg_vaf_n and, unless the file lacks it, avg_abs_cn."""
    t = _read(spark, path, 6)
    out = t.select(chrom_code(F.col("c0")).alias("chrom"), F.col("c1").try_cast("bigint").alias("pos"), F.col("c3").try_cast("int").alias("n_samples"),
                   F.col("c4").try_cast("double").alias("avg_vaf_n"), (F.col("c5").try_cast("double") if copy_number else F.lit(None).cast("double")).alias("avg_abs_cn"))
    return out.where("chrom IS NOT NULL AND pos IS NOT NULL")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """patient, chrom, start, end and, where given, markers (else 0), log2 ratio (else 0) and event (else Ignored)."""
    t = _read(spark, path, 7)
    return t.select(F.col("c0").alias("patient"), chrom_code(F.col("c1")).alias("chrom"), F.col("c2").try_cast("bigint").alias("start"), F.col("c3").try_cast("bigint").alias("end"),
                    F.coalesce(F.col("c4").try_cast("int"), F.lit(0)).alias("n_markers"), F.coalesce(F.col("c5").try_cast("double"), F.lit(0.0)).alias("log2_ratio"),
                    F.coalesce("c6", F.lit("Ignored")).alias("event")).where("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")


def read_region_list(spark: SparkSession, path: str) -> DataFrame:
    t = _read(spark, path, 3)
    return t.select(chrom_code(F.col("c0")).alias("chrom"), F.col("c1").try_cast("bigint").alias("list_start"), F.col("c2").try_cast("bigint").alias("list_end")).where("chrom IS NOT NULL")


def read_mutation_bed(spark: SparkSession, path: str) -> DataFrame:
    t = _read(spark, path, 5)
    return t.select(chrom_code(F.col("c0")).alias("chrom"), F.col("c1").try_cast("bigint").alias("start"), F.col("c2").try_cast("bigint").alias("end"), F.col("c4").try_cast("double").alias("value"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    t = _read(spark, path, 13)
    return t.select(F.regexp_replace("c2", "_.*$", "").alias("chrom"), F.col("c4").try_cast("bigint").alias("start"), F.col("c5").try_cast("bigint").alias("end"), F.col("c12").alias("gene"))


def read_gene_locations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Genes and the rows that don't parse. One id at two places is an error, twice at one place is dropped."""
    t = _read(spark, path, 7)
    rows = t.select(F.col("c0").alias("gene_id"), F.col("c1").alias("symbol"), chrom_code(F.col("c3")).alias("chrom"), F.col("c5").try_cast("bigint").alias("start"), F.col("c6").try_cast("bigint").alias("end"))
    bad = F.col("chrom").isNull() | F.col("start").isNull() | F.col("end").isNull()
    good = rows.where(~bad).dropDuplicates(["gene_id", "chrom", "start", "end"])
    again = good.groupBy("gene_id").count().where("count > 1").take(5)
    if again:
        raise ValueError(f"genes at several places: {[r['gene_id'] for r in again]}")
    return good, rows.where(bad)


def read_cytobands(spark: SparkSession, path: str) -> DataFrame:
    """Bands with 1-based starts, their arm, and a pter and qter band at either end of each chromosome."""
    t = _read(spark, path, 4)
    bands = t.select(chrom_code(F.col("c0")).alias("chrom"), (F.col("c1").try_cast("bigint") + 1).alias("start"), F.col("c2").try_cast("bigint").alias("end"), F.col("c3").alias("band")).where("chrom IS NOT NULL AND start IS NOT NULL")
    ends = bands.groupBy("chrom").agg(F.max("end").alias("e"))
    outer = ends.select("chrom", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit("pter").alias("band")),
                                                    F.struct((F.col("e") + 1).alias("start"), (F.col("e") + 1).alias("end"), F.lit("qter").alias("band")))).alias("x")).select("chrom", "x.*")
    return bands.unionByName(outer).withColumn("arm", F.substring("band", 1, 1))


def broad_thresholds(bands: DataFrame, share: float = 0.5) -> DataFrame:
    """Per chromosome arm the length from which a region is broad: a share of the arm."""
    return bands.where("band NOT IN ('pter', 'qter')").groupBy("chrom", "arm").agg(((F.max("end") - F.min("start") + 1) * share).cast("bigint").alias("broad_length"))


def read_segments(spark: SparkSession, path: str, least: int = 0, most: int | None = None) -> DataFrame:
    """SEG rows; NA segments and those of fewer than ``least`` markers are dropped, those of more than ``most`` become 0."""
    t = _read(spark, path, 6, header=True)
    out = t.select(F.col("c0").alias("sample"), chrom_code(F.col("c1")).alias("chrom"), F.col("c2").try_cast("bigint").alias("start"), F.col("c3").try_cast("bigint").alias("end"),
                   F.col("c4").try_cast("int").alias("n_markers"), F.col("c5").try_cast("double").alias("value")).where("value IS NOT NULL AND chrom IS NOT NULL")
    out = out.where(F.col("n_markers") >= least)
    return out if most is None else out.withColumn("value", F.when(F.col("n_markers") > most, 0.0).otherwise(F.col("value")))


def read_marker_matrix(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.gscore import unpivot_markers

    wide = spark.read.csv(path, sep="\t", header=True)
    names = wide.columns
    wide = wide.select(F.col(names[0]).alias("marker"), chrom_code(F.col(names[1])).alias("chrom"), F.col(names[2]).cast("double").cast("bigint").alias("pos"),
                       *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names[3:] if not c.startswith(("Genetic", "Score"))])
    return unpivot_markers(wide)


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """``key value`` lines of a settings file, all of them; of a key named again the last value."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|\z)")).toLocalIterator()
    pairs = (r["value"].split(None, 1) for r in rows)
    return {p[0]: p[1].strip() if len(p) > 1 else "" for p in pairs}


def write_tsv(df: DataFrame, path: str, header: bool = True, *partition_by: str) -> None:
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", header)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_classified(sites: DataFrame, path: str) -> None:
    """Classified sites, one folder per sample."""
    write_tsv(sites, path, True, "sample")


def probe_map(sites: DataFrame) -> DataFrame:
    """Probe, chrom, pos of all positions; those without an identifier are numbered novel_1, novel_2, ... along the genome.

    Numbers come from counts per chromosome and block plus ranks within a block, never one ordered task.
    """
    rows = sites.groupBy("chrom", "pos").agg(F.max("rs").alias("rs")).withColumn("blk", F.floor(F.col("pos") / 5_000_000))
    novel = rows.where("rs IS NULL OR rs <= 0")
    counts = novel.groupBy("chrom", "blk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("chrom", "blk", (F.sum("n").over(Window.orderBy("chrom", "blk")) - F.col("n")).alias("before"))
    ranked = novel.withColumn("r", F.row_number().over(Window.partitionBy("chrom", "blk").orderBy("pos"))).join(before, ["chrom", "blk"])
    named = ranked.select(F.concat(F.lit("novel_"), (F.col("before") + F.col("r")).cast("string")).alias("probe"), "chrom", "pos")
    return named.unionByName(rows.where("rs > 0").select(F.concat(F.lit("rs"), F.col("rs").cast("string")).alias("probe"), "chrom", "pos"))


def write_track(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Text lines of a track, ordered within files; the header is a file of its own that sorts first."""
    body = lines.sortWithinPartitions("chrom", "start") if {"chrom", "start"} <= set(lines.columns) else lines
    body.select("value").write.mode("overwrite").text(path)
    if header:
        lines.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(path)


def pivot_matrix(long: DataFrame, row: str, column: str, value: str, max_columns: int = 10_000) -> DataFrame:
    """Long rows as a matrix for a sink, absent cells 0; the number of columns is checked first."""
    names = [r[0] for r in long.select(column).distinct().limit(max_columns + 1).collect()]
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    return long.groupBy(row).pivot(column, sorted(names)).agg(F.first(value)).na.fill(0)


def sorted_copy(df: DataFrame, columns: list[tuple[str, str, bool]]) -> DataFrame:
    """Rows ordered by (column, ``number`` or ``text``, ascending)."""
    keys = [F.col(c).try_cast("double") if kind == "number" else F.col(c) for c, kind, _ in columns]
    return df.orderBy(*[k.asc() if up else k.desc() for k, (_, _, up) in zip(keys, columns)])


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """marker, chrom, pos of a probe file with a header."""
    t = _read(spark, path, 3, header=True)
    return t.select(F.col("c0").alias("marker"), chrom_code(F.col("c1")).alias("chrom"), F.col("c2").try_cast("bigint").alias("pos")).where("chrom IS NOT NULL AND pos IS NOT NULL")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """sample and group (1 or 2) of a comparison, one sample a line."""
    t = _read(spark, path, 2)
    return t.select(F.col("c0").alias("sample"), F.col("c1").try_cast("int").alias("group")).where("group IN (1, 2)")


def read_driver_map(spark: SparkSession, path: str) -> DataFrame:
    """tumor and driver of a mapping file: two tab-separated names a line, lines of fewer columns left out."""
    t = _read(spark, path, 2)
    return t.select(F.trim("c0").alias("tumor"), F.trim("c1").alias("driver")).where("tumor <> '' AND driver <> ''").distinct()


def read_roster(spark: SparkSession, path: str, skip_adjacent: bool = True) -> DataFrame:
    """pathway and gene from lines of a pathway followed by its genes; a gene named twice in a row counts once unless told otherwise."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", "\t")
    rows = lines.select(F.trim(F.get(parts, F.lit(0))).alias("pathway"), F.posexplode(F.slice(parts, 2, 1_000_000_000)).alias("at", "gene"), parts.alias("p"))
    rows = rows.withColumn("gene", F.trim("gene")).withColumn("before", F.when(F.col("at") > 0, F.trim(F.get("p", F.col("at")))))
    rows = rows.where("gene <> ''")
    return (rows.where(~F.col("gene").eqNullSafe(F.col("before"))) if skip_adjacent else rows).select("pathway", "gene")


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A table with a header line as text columns; with ``key`` the last line of each key, as a look-up table has it."""
    t = spark.read.csv(path, sep="\t", header=True)
    if key is None:
        return t
    numbered = t.withColumn("__at", F.monotonically_increasing_id())
    rest = [c for c in t.columns if c != key]
    return numbered.groupBy(key).agg(*[F.max_by(c, "__at").alias(c) for c in rest]).select(*t.columns)


def bedgraph_lines(pieces: DataFrame, value: str = "score") -> DataFrame:
    """``chrom start end value`` lines; starts are 0-based and ends exclusive there."""
    code = F.when(F.col("chrom") == 23, "X").when(F.col("chrom") == 24, "Y").when(F.col("chrom") == 25, "M").otherwise(F.col("chrom").cast("string"))
    return pieces.select("chrom", "start", F.concat_ws(" ", F.concat(F.lit("chr"), code), F.col("start") - 1, F.col("end"), F.col(value)).alias("value"))


def write_tables(tables: dict[str, DataFrame], folder: str, header: bool = True) -> list[str]:
    """The tables of one run, each in a folder of its name; their paths."""
    for name, df in tables.items():
        write_tsv(df, f"{folder}/{name}", header)
    return [f"{folder}/{name}" for name in tables]


def write_probes(sites: DataFrame, path: str) -> None:
    """The probe map of all positions as a file that ``read_probes`` reads."""
    write_tsv(probe_map(sites), path)


def write_regions(regions: DataFrame, path: str) -> None:
    """Regions (sample, chrom, start, end, n, value, event) as a file that ``read_regions`` reads."""
    write_tsv(regions.select("sample", "chrom", "start", "end", "n", "value", "event"), path, False)


def track_header(name: str, description: str) -> str:
    return f'track name="{name}" description="{description}" useScore=1'


def session_xml(genome: str, tracks: list[str]) -> str:
    """A browser session that loads the given tracks."""
    from xml.sax.saxutils import quoteattr

    body = "".join(f"    <Resource path={quoteattr(t)}/>\n" for t in tracks)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<Session genome={quoteattr(genome)} version="8">\n  <Resources>\n{body}  </Resources>\n</Session>\n'
