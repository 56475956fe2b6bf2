"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import encode_corpus
from .digests import digest_groups, merge_digests, percentiles
from .packing import pack_documents, shared_containers
from .runs import collapse_runs, same_chromosome
from .splitting import split_documents
from .terms import count_terms, mark_terms, symbol_terms, whole_term


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/naf_taf_inputs.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _limits(spark: SparkSession, sf_dir: str, purpose: str) -> list:
    """The limits of a purpose: a small table of parameters."""
    rows = spark.read.parquet(f"{sf_dir}/token_limits.parquet").where(F.col("purpose") == purpose).orderBy("limit_id").take(101)
    if len(rows) > 100:
        raise ValueError("token_limits holds parameters, not data: at most 100 rows of a purpose")
    return rows


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(_inputs(spark, sf_dir), "sample_id", "line_no", same_chromosome(F.col("refname")), F.col("coordinate"),
                         near=10, tie_cols=("loaded_at", "site_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("seq").alias("sample_id"), F.col("first").alias("first_line"), F.col("last").alias("last_line"))


def p2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("seq").alias("sample_id"), F.col("first").alias("first_line"), F.col("last").alias("last_line"),
                                       F.col("n_events").alias("n_lines"), F.col("span").alias("span_bp"))


def _groupings() -> dict:
    return {"sample_id": F.col("sample_id"), "mutationtype": F.lower(F.trim("mutationtype")), "day": F.to_date("loaded_at")}


def _ratios() -> dict:
    return {c: F.col(c) for c in ("q20_variantratio_t", "q20_variantratio_n")}


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(_inputs(spark, sf_dir), _groupings(), _ratios())


def p3_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of separate days combined into one per column: their counts and smallest and largest values."""
    days = digest_groups(_inputs(spark, sf_dir), {"day": F.to_date("loaded_at")}, _ratios())
    return merge_digests(days, ["field"]).select("field", "n", "low", "high")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _inputs(spark, sf_dir)
    counts = count_terms(df, {"hugo_symbol": symbol_terms(F.col("hugo_symbol")), "mutationtype": whole_term(F.col("mutationtype"))})
    return mark_terms(counts, df.count())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_counts(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_documents(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {r["limit_id"]: r["max_tokens"] for r in _limits(spark, sf_dir, "container")}
    return pack_documents(_documents(spark, sf_dir), limits)


def p7_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are and how many documents share one with a copy or with their source, per limit."""
    return shared_containers(p7_containers(spark, sf_dir), _documents(spark, sf_dir))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {r["limit_id"]: (r["max_tokens"], r["overlap_tokens"]) for r in _limits(spark, sf_dir, "piece")}
    return split_documents(_documents(spark, sf_dir), limits)


QUERIES = {f.__name__: f for f in (p2_found, p2_events, p3_percentiles, p3_combined, p5_found, p5_counts, p6_ids, p7_containers, p7_shared, p8_pieces)}

_P2 = r"""
WITH lines AS (
  SELECT DISTINCT ON (sample_id, line_no) sample_id, line_no, coordinate AS pos,
    regexp_replace(regexp_replace(regexp_replace(lower(refname), '\s+', '', 'g'), '^(chrom|chr)?[_.-]?0*(.)', '\2'), '^mt$', 'm') AS chrom
  FROM naf_taf_inputs WHERE sample_id IS NOT NULL AND line_no IS NOT NULL ORDER BY sample_id, line_no, loaded_at, site_id),
flagged AS (
  SELECT *, coalesce(chrom = lag(chrom) OVER w AND abs(pos - lag(pos) OVER w) <= 10, false) AS goes_on
  FROM lines WINDOW w AS (PARTITION BY sample_id ORDER BY line_no)),
numbered AS (
  SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY line_no) AS run FROM flagged),
runs AS (
  SELECT sample_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines, CAST(max(pos) - min(pos) AS BIGINT) AS span_bp
  FROM numbered GROUP BY sample_id, run HAVING count(*) > 1)
"""

_P5 = r"""
WITH symbols AS (
  SELECT site_id, unnest(list_transform(regexp_split_to_array(regexp_replace(hugo_symbol, '\([^()]*(\)|$)', '', 'g'), '[,;|/]'),
    lambda x: lower(regexp_replace(x, '^[\s"''“”]+|[\s"''“”]+$', '', 'g')))) AS term FROM naf_taf_inputs),
terms AS (
  SELECT 'hugo_symbol' AS field, site_id, term FROM symbols
  UNION ALL SELECT 'mutationtype', site_id, lower(regexp_replace(mutationtype, '^[\s"''“”]+|[\s"''“”]+$', '', 'g')) FROM naf_taf_inputs),
counts AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT site_id) AS records FROM terms
  WHERE term IS NOT NULL AND term NOT IN ('', '.', 'none') GROUP BY field, term),
marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM naf_taf_inputs) THEN 'common' END AS mark FROM counts)
"""

ORACLES = {
    "p2_found": f"{_P2} SELECT sample_id, first_line, last_line FROM runs",
    "p2_events": f"{_P2} SELECT * FROM runs",
    "p3_combined": " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) AS n, min({c}) AS low, max({c}) AS high FROM naf_taf_inputs WHERE NOT isnan({c})"
        for c in ("q20_variantratio_t", "q20_variantratio_n")),
    "p5_found": f"{_P5} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p5_counts": f"{_P5} SELECT field, term, occurrences, records, mark FROM marked",
}
