"""Rows that fail to parse: structural checks per line, value checks per distinct value.

Each distinct value of a judged column is cast once; what fails goes into a dictionary of invalid
values with reasons, which is joined back. Lines that pass everything come out as typed sites.

Defined results: a null line counts as one empty column (``column_count``); a carriage return at the
end is no part of a line; repeated headers are neither valid nor rejected; repeated lines are judged
one by one; an empty table gives empty results; other columns are carried or ignored, never parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.cut import cut
from ..plans.joins import sized_join

#: The columns of a raw line in order, with the type each is loaded as.
SITE_COLUMNS = (
    ("refname", "string"), ("coordinate", "int"), ("refbase", "string"), ("varbase", "string"),
    ("variantbase_n", "string"), ("variantbase_t", "string"), ("refenv_n", "string"), ("refenv_t", "string"),
    ("q20_totcov_n", "int"), ("q20_totcov_t", "int"), ("q20_varcov_n", "int"), ("q20_varcov_t", "int"),
    ("q20_variantratio_n", "double"), ("q20_variantratio_t", "double"), ("dbsnp", "string"),
    ("mutationtype", "string"), ("hugo_symbol", "string"),
)
WIDTH = len(SITE_COLUMNS)
TOTCOV_T, DBSNP, HUGO = 9, 14, 16

_PARSED = T.StructType([
    T.StructField("cols", T.ArrayType(T.StringType())),
    T.StructField("n_cols", T.IntegerType()),
    T.StructField("broken", T.BooleanType()),
])


def parse_quoted(line: str, width: int = WIDTH) -> tuple[list[str], int, bool]:
    """Columns of a tab-separated line with quoting, their number, and whether the quoting is broken."""
    cols: list[str] = []
    n, at, size = 0, 0, len(line)
    while True:
        if line.startswith('"', at):
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return cols, n, True
                if line.startswith('"', end + 1):
                    end += 2
                    continue
                break
            if end + 1 < size and line[end + 1] != "\t":
                return cols, n, True
            value, at = line[at + 1 : end].replace('""', '"'), end + 1
        else:
            end = line.find("\t", at)
            end = size if end < 0 else end
            value = line[at:end]
            if '"' in value:
                return cols, n, True
            at = end
        n += 1
        if n <= width:
            cols.append(value)
        if at >= size:
            return cols, n, False
        at += 1  # the tab; a tab at the very end opens one more, empty column
        if at == size:
            if n < width:
                cols.append("")
            return cols, n + 1, False


@F.pandas_udf(_PARSED)
def _parse_quoted(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in lines:
        yield pd.DataFrame([(None, None, None) if x is None else parse_quoted(x) for x in series],
                           columns=["cols", "n_cols", "broken"])


def totcov_ok(v: Column) -> Column:
    """``.`` or digits alone with a value up to 32767."""
    digits = F.regexp_replace(v, "^0+", "")
    return (v == ".") | (v.rlike(r"^[0-9]+\z") & (F.length(digits) <= 5)
                         & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 32767))


def dbsnp_ok(v: Column) -> Column:
    """``.``, ``novel`` or a list led by an rs number, every ``|`` followed by a number from 0 to 1."""
    def share(item: Column) -> Column:
        number = F.trim(F.substring_index(item, "|", -1))
        one = F.size(F.split(item, r"\|")) == 2
        good = one & number.rlike(r"^[+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z") \
            & number.try_cast("double").between(0.0, 1.0)
        return ~item.contains("|") | F.coalesce(good, F.lit(False))

    return v.isin(".", "novel") | (v.rlike(r"(?s)^rs(-1|[0-9]+)([,;].*)?\z") & F.forall(F.split(v, "[,;]", -1), share))


def hugo_ok(v: Column) -> Column:
    """``.`` or a list of symbols, each possibly with its distance."""
    return (v == ".") | F.forall(F.split(v, "[,;]", -1),
                                 lambda x: x.rlike(r"^[A-Za-z][A-Za-z0-9._-]*(\(dist=[0-9]+\))?\z"))


#: Judged columns: place in the line, the test, the reason of failure; in the order reasons hold.
CHECKS = (
    (TOTCOV_T, totcov_ok, "invalid_totcov_t"),
    (DBSNP, dbsnp_ok, "invalid_dbsnp"),
    (HUGO, hugo_ok, "invalid_hugo_symbol"),
)


def parse_lines(df: DataFrame, line_col: str = "raw_line") -> DataFrame:
    """``df`` without header lines, plus ``__cols`` (at most 17), ``__n`` and ``__broken``.

    Lines without a quote are split in the JVM; only lines with one go through the quoting parser.
    """
    line = F.coalesce(F.regexp_replace(F.col(line_col), r"\r\z", ""), F.lit(""))
    df = df.withColumn("__line", line).where(~F.col("__line").rlike(r'^(refName|"refName")(\t|\z)'))
    plain = F.split("__line", "\t", -1)
    quoted = F.col("__line").contains('"')
    df = df.withColumn("__p", _parse_quoted(F.when(quoted, F.col("__line"))))
    return df.select(
        "*",
        F.when(quoted, F.col("__p.cols")).otherwise(F.slice(plain, 1, WIDTH)).alias("__cols"),
        F.when(quoted, F.col("__p.n_cols")).otherwise(F.size(plain)).alias("__n"),
        F.coalesce(F.col("__p.broken"), F.lit(False)).alias("__broken"),
    ).drop("__p", "__line")


def judge_lines(df: DataFrame, id_col: str = "line_id", line_col: str = "raw_line",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Each non-header line with ``reason`` (null when valid) and its columns ``__cols``."""
    parsed = cut(parse_lines(df.select(id_col, line_col, *keep), line_col).drop(line_col))
    whole = parsed.where(~F.col("__broken") & (F.col("__n") == WIDTH))
    values = whole.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("at"), F.get("__cols", F.lit(at)).alias("value")) for i, (at, _, _) in enumerate(CHECKS)
    ])).alias("x")).select("x.*").distinct()
    test = F.lit(None).cast("boolean")
    for i, (_, ok, _) in enumerate(CHECKS):
        test = F.when(F.col("at") == i, ok(F.col("value"))).otherwise(test)
    invalid = cut(values.where(~F.coalesce(test, F.lit(False))))
    judged = parsed.withColumn("__fits", ~F.col("__broken") & (F.col("__n") == WIDTH))
    for i, (at, _, reason) in enumerate(CHECKS):
        bad = invalid.where(F.col("at") == i).select(F.col("value").alias("__v"), F.lit(reason).alias(f"__r{i}"))
        judged = sized_join(judged.withColumn("__v", F.when(F.col("__fits"), F.get("__cols", F.lit(at)))), bad, ["__v"]).drop("__v")
    reason = F.when(F.col("__broken"), "broken_quoting").when(F.col("__n") != WIDTH, "column_count")
    return judged.withColumn("reason", F.coalesce(reason, *[F.col(f"__r{i}") for i in range(len(CHECKS))])).drop(
        "__fits", *[f"__r{i}" for i in range(len(CHECKS))])


def rejected_lines(df: DataFrame, id_col: str = "line_id", line_col: str = "raw_line") -> DataFrame:
    """The lines that don't load: id and first reason."""
    return judge_lines(df, id_col, line_col).where(F.col("reason").isNotNull()).select(id_col, "reason")


def typed_sites(df: DataFrame, id_col: str = "line_id", line_col: str = "raw_line",
                keep: tuple[str, ...] = ("sample_id", "line_no")) -> DataFrame:
    """The valid lines as typed sites; ``.`` and unjudged values that don't cast become null, and ``not_cast`` names the
    columns of the latter, comma-separated (null when there are none)."""
    good = judge_lines(df, id_col, line_col, keep).where(F.col("reason").isNull())
    out, lost = [], []
    for i, (name, kind) in enumerate(SITE_COLUMNS):
        v = F.get("__cols", F.lit(i))
        cast = F.when(v != ".", F.trim(v)).try_cast(kind)
        out.append((v if kind == "string" else cast).alias(name))
        if kind != "string":
            lost.append(F.when((v != ".") & cast.isNull(), F.lit(name)))
    return good.select(id_col, *keep, *out, F.nullif(F.concat_ws(",", *lost), F.lit("")).alias("not_cast"))
