"""Queries over raw and packed input: splitting packed fields, separating lines that don't parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.packed import split_packed
from ..operators.rejects import SITE_COLUMNS, rejected_lines, typed_sites


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(spark.read.parquet(f"{sf_dir}/naf_taf_inputs.parquet"), "site_id", "dbsnp", min_items=2)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(spark.read.parquet(f"{sf_dir}/naf_taf_lines.parquet"))


def p4_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_sites(spark.read.parquet(f"{sf_dir}/naf_taf_lines.parquet"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_sites": p4_sites}

_LINES = r"""
lines AS (
  SELECT *, regexp_replace(coalesce(raw_line, ''), '\r$', '') AS line FROM naf_taf_lines),
fields AS (
  SELECT *, NOT regexp_full_match(line, '("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*', 's') AS broken,
    list_transform(regexp_extract_all(line || chr(9), '("(?:[^"]|"")*"|[^"\t]*)\t', 1),
      lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS c
  FROM lines WHERE NOT regexp_matches(line, '^(refName|"refName")(\t|$)')),
judged AS (
  SELECT *, CASE
    WHEN broken THEN 'broken_quoting'
    WHEN len(c) <> 17 THEN 'column_count'
    WHEN NOT (c[10] = '.' OR (regexp_full_match(c[10], '[0-9]+') AND try_cast(c[10] AS HUGEINT) <= 32767)) THEN 'invalid_totcov_t'
    WHEN NOT (c[15] IN ('.', 'novel') OR (regexp_full_match(c[15], 'rs(-1|[0-9]+)([,;].*)?', 's')
      AND len(list_filter(regexp_split_to_array(c[15], '[,;]'), lambda x: contains(x, '|') AND NOT coalesce(
        regexp_full_match(x, '[^|]*\|\s*[+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')
        AND try_cast(trim(regexp_extract(x, '\|(.*)$', 1)) AS DOUBLE) BETWEEN 0 AND 1, false))) = 0)) THEN 'invalid_dbsnp'
    WHEN NOT (c[17] = '.' OR regexp_full_match(c[17],
      '[A-Za-z][A-Za-z0-9._-]*(\(dist=[0-9]+\))?([,;][A-Za-z][A-Za-z0-9._-]*(\(dist=[0-9]+\))?)*')) THEN 'invalid_hugo_symbol'
    END AS reason
  FROM fields)
"""

_TYPED = ",\n  ".join(
    f"c[{i}] AS {name}" if kind == "string"
    else f"CASE WHEN c[{i}] <> '.' THEN try_cast(trim(c[{i}]) AS {'INTEGER' if kind == 'int' else 'DOUBLE'}) END AS {name}"
    for i, (name, kind) in enumerate(SITE_COLUMNS, 1))

_NOT_CAST = "nullif(concat_ws(',', " + ", ".join(
    f"CASE WHEN c[{i}] <> '.' AND try_cast(trim(c[{i}]) AS {'INTEGER' if kind == 'int' else 'DOUBLE'}) IS NULL THEN '{name}' END"
    for i, (name, kind) in enumerate(SITE_COLUMNS, 1) if kind != "string") + "), '') AS not_cast"

# values by one alternation: quoted text, an allele with its number, else whatever holds no delimiter
_VALUE = (r'"(?:[^"\\]|\\.|"")*"' + r"|'[^']*'|“[^”]*”|(?:[ACGTN]+|-)\|[0-9]+(?:[.,][0-9]+)?(?:e[+-]?[0-9]+)?|[^\s,;/|&；，:](?:[^\s,;/|&；，:]|:[^:\s,;/|&；，])*").replace("'", "''")

ORACLES = {
    "p1_found": rf"""
WITH found AS (SELECT site_id, regexp_extract_all(dbsnp, '{_VALUE}') AS v FROM naf_taf_inputs WHERE dbsnp IS NOT NULL),
listed AS (SELECT site_id, unnest(v) AS x, CAST(generate_subscripts(v, 1) AS BIGINT) AS item_no FROM found WHERE len(v) > 1)
SELECT site_id, item_no, CASE WHEN length(x) > 1 AND x[1] = '"' AND x[-1] = '"' THEN replace(replace(x[2:-2], '""', '"'), '\"', '"')
  WHEN length(x) > 1 AND x[1] IN (chr(39), '“') AND x[-1] IN (chr(39), '”') THEN x[2:-2] ELSE x END AS item FROM listed""",
    "p4_found": f"WITH {_LINES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_sites": f"WITH {_LINES} SELECT line_id, sample_id, line_no,\n  {_TYPED},\n  {_NOT_CAST}\nFROM judged WHERE reason IS NULL",
}
