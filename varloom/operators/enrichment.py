"""Enrichment of pathways and terms, top genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def pathway_tau(genes: DataFrame, roster: DataFrame, value: str = "value", compat: bool = False) -> DataFrame:
    """Per pathway tau = (g_p / g_x) (X / P): genes at or above the global mean within it, against all.

    ``compat`` leaves out each pathway's first gene (by name) when counting g_p, but not P.
    """
    totals = genes.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("x"))
    marked = genes.crossJoin(F.broadcast(totals)).withColumn("high", (F.col(value) >= F.col("mean")).cast("int"))  # one row on the right
    g_x = marked.agg(F.sum("high").alias("g_x"))
    rows = roster.select("gene", "pathway").distinct().join(marked.select("gene", "high", "x"), "gene")
    high = F.sum("high") - (F.min_by("high", "gene") if compat else F.lit(0))
    by = rows.groupBy("pathway").agg(high.alias("g_p"), F.count(F.lit(1)).alias("p"), F.max("x").alias("x")).crossJoin(F.broadcast(g_x))
    return by.select("pathway", "g_p", "p", "g_x", "x", F.try_divide(F.col("g_p").cast("double") * F.col("x"), F.col("g_x").cast("double") * F.col("p")).alias("tau"))


def term_counts(genes: DataFrame, associations: DataFrame) -> DataFrame:
    """Genes per term."""
    return associations.select("gene", "term").distinct().join(genes.select("gene").distinct(), "gene").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_fold(top: DataFrame, every: DataFrame) -> DataFrame:
    """Counts of terms among top genes over those among all."""
    return top.withColumnRenamed("n", "n_top").join(every.withColumnRenamed("n", "n_all"), "term").withColumn("fold", F.col("n_top") / F.col("n_all"))


def pathway_scores(genes: DataFrame, roster: DataFrame, score: str) -> DataFrame:
    """Per pathway the sorted list of its genes' scores; a pathway's list is bounded by the roster."""
    rows = roster.select("gene", "pathway").distinct().join(genes.select("gene", score), "gene")
    return rows.groupBy("pathway").agg(F.concat_ws(";", F.array_sort(F.collect_list(F.concat_ws(":", "gene", F.col(score).cast("string"))))).alias("scores"))


def top_genes(genes: DataFrame, value: str, n: int = 20, blacklist: tuple[str, ...] = (), most: float | None = None) -> DataFrame:
    """The ``n`` largest, named genes outside the blacklist; ties by name. ``most`` leaves out larger values."""
    rows = genes.where(~F.col("gene").isin(".", *blacklist))
    if most is not None:
        rows = rows.where(F.col(value) <= most)
    return rows.orderBy(F.desc(value), "gene").limit(n)


def top_per_group(df: DataFrame, keys: list[str], value: str, n: int, ties: list[str]) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(F.desc(value), *ties)
    return df.withColumn("place", F.row_number().over(over)).where(F.col("place") <= n)
