"""Comparing call sets: genes and patients, variant files, regions, truth tables, callers' combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.intervals import overlapping_intervals

#: How two call sets agree on a gene and patient.
MATCHES = ("MatchCall", "MatchNoCall", "MismatchCallDiffCall", "MismatchCallNoCall", "MismatchNoCallCall")


def _calls(df: DataFrame) -> DataFrame:
    event = F.when(F.col("event").isNull() | (F.col("event") == "NA"), "Ignored").otherwise(F.col("event"))
    return df.select(F.col("gene"), F.col("patient"), event.alias("event")).where("gene IS NOT NULL AND patient IS NOT NULL")


def compare_calls(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each call of ``a`` (gene, event, patient) with the other set's event and how they match.

    Names are compared without case. Of several calls of ``b`` for one gene and patient the first event by name counts.
    """
    keys = [F.lower("gene").alias("g"), F.lower("patient").alias("p")]
    other = _calls(b).groupBy(*keys).agg(F.min("event").alias("other_event"))
    own = _calls(a).withColumns({"g": F.lower("gene"), "p": F.lower("patient")})
    e, o = F.col("event"), F.col("other_event")
    match = (F.when(o.isNull(), F.when(e != "Ignored", "MismatchCallNoCall").otherwise("MatchNoCall")).when(e == o, "MatchCall")
             .when(e == "Ignored", "MismatchNoCallCall").otherwise("MismatchCallDiffCall"))
    return own.join(other, ["g", "p"], "left").withColumn("match", match).drop("g", "p")


def match_tallies(compared: DataFrame) -> DataFrame:
    """Per gene the number of each match, totals and the share of calls that match."""
    out = compared.groupBy(F.lower("gene").alias("gene")).agg(*[F.count_if(F.col("match") == m).alias(m) for m in MATCHES])
    return out.select("*", (F.col("MatchCall") + F.col("MatchNoCall")).alias("n_match"),
                      (F.col("MismatchCallDiffCall") + F.col("MismatchCallNoCall") + F.col("MismatchNoCallCall")).alias("n_mismatch"),
                      F.try_divide("MatchCall", F.col("MatchCall") + F.col("MismatchCallDiffCall") + F.col("MismatchCallNoCall")).alias("match_fraction"))


def annotate_variants(test: DataFrame, validation: DataFrame, keys: list[str], status: str, copied: list[str], order: list[str]) -> DataFrame:
    """``test`` with the validation columns of the first (by ``order``) row of equal keys, else status ``DeNovo``. Text keys ignore case."""
    def norm(df: DataFrame) -> list[Column]:
        return [(F.lower(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c)).alias(f"__k{i}") for i, c in enumerate(keys)]

    ks = [f"__k{i}" for i in range(len(keys))]
    first = F.struct(*order, *[F.col(c).alias(f"__v_{c}") for c in (status, *copied)])
    right = validation.select(*norm(validation), first.alias("__s")).groupBy(*ks).agg(F.min("__s").alias("__s"))
    left = test.select("*", *norm(test))
    joined = left.join(right, ks, "left")
    found = F.col("__s").isNotNull()
    out = {status: F.when(found, F.col(f"__s.__v_{status}")).otherwise("DeNovo")}
    out |= {c: F.when(found, F.col(f"__s.__v_{c}")).otherwise(F.col(c) if c in test.columns else F.lit(None)) for c in copied}
    return joined.withColumns(out).drop("__s", *ks)


def compare_regions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Regions of ``a`` (patient, chrom, start, end, event) with the number of overlapping regions of ``b`` and of those whose event agrees.

    LOH agrees with LOH and homozygous loss, a gain with a gain; ``germline`` tells whether a germline gain overlaps. Unmatched rows stay.
    """
    left = a.select("patient", "chrom", "start", "end", "event").distinct()
    right = b.select("patient", "chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("event").alias("b_event"))
    pairs = overlapping_intervals(left, right, ["patient", "chrom"], ("start", "end"), ("b_start", "b_end"))
    agree = ((F.col("event").isin("LOH") & F.col("b_event").isin("LOH", "DELHom")) | (F.col("event").isin("GainSomatic", "GainGermline")
             & F.col("b_event").isin("GainSomatic", "GainGermline")) | (F.col("event") == F.col("b_event")))
    keys = ["patient", "chrom", "start", "end", "event"]
    found = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_overlap"), F.count_if(agree).alias("n_agree"),
                                     F.max((F.col("b_event") == "GainGermline").cast("int")).alias("germline"))
    zero = F.lit(0).cast("bigint")
    return left.join(found, keys, "left").select(*keys, F.coalesce("n_overlap", zero).alias("n_overlap"), F.coalesce("n_agree", zero).alias("n_agree"),
                                                            (F.coalesce("germline", F.lit(0)) == 1).alias("germline"))


def confusion(df: DataFrame, truth: str, test: str) -> DataFrame:
    """Per event TP, FP, FN, TN and the derived rates. Rows of a germline gain that were ignored don't count."""
    counts = df.where(~((F.col(truth) == "GainGermline") & (F.col(test) == "Ignored"))).groupBy(F.col(truth).alias("t"), F.col(test).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    by = counts.select(F.explode(F.array_distinct(F.array("t", "p"))).alias("event"), "t", "p", "n").groupBy("event").agg(
        F.sum(F.when((F.col("t") == F.col("event")) & (F.col("p") == F.col("event")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("t") != F.col("event")) & (F.col("p") == F.col("event")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("t") == F.col("event")) & (F.col("p") != F.col("event")), F.col("n")).otherwise(0)).alias("fn"))
    by = by.crossJoin(F.broadcast(total)).withColumn("tn", F.col("all") - F.col("tp") - F.col("fp") - F.col("fn")).drop("all")  # one row on the right
    return contingency_rates(by)


def contingency_rates(df: DataFrame) -> DataFrame:
    """Sensitivity, specificity, predictive values and F1 from tp, fp, fn, tn; null where undefined."""
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.select("*", d(tp, tp + fn).alias("sensitivity"), d(tn, tn + fp).alias("specificity"), d(tp, tp + fp).alias("ppv"),
                     d(tn, tn + fn).alias("npv"), d(2 * tp, 2 * tp + fp + fn).alias("f1"))


def caller_masks(df: DataFrame, keys: list[str], caller: str, callers: list[str]) -> DataFrame:
    """mask (one bit per caller) -> number of items with exactly that set of callers."""
    bit = F.element_at(F.create_map(*[x for i, c in enumerate(callers) for x in (F.lit(c), F.lit(1 << i))]), F.col(caller))
    return df.groupBy(*keys).agg(F.bit_or(bit).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n")).where("mask IS NOT NULL")


def caller_metrics(masks: DataFrame, n_callers: int, scaled: bool = False) -> DataFrame:
    """Per least number of agreeing callers and caller: share of its calls confirmed (ppv), of confirmed calls it made (sens), F1."""
    k = F.bit_count("mask")
    bits = F.array(*[F.lit(i) for i in range(n_callers)])
    weight = (k * F.col("n")) if scaled else F.col("n")
    whole = (F.lit(n_callers) * F.col("n")) if scaled else F.col("n")
    rows = masks.withColumn("caller", F.explode(bits)).withColumn("least", F.explode(F.array(*[F.lit(i) for i in range(1, n_callers + 1)])))
    rows = rows.withColumn("has", F.expr("(mask >> caller) & 1") == 1).withColumn("ok", k >= F.col("least"))
    s = lambda c, w: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    out = rows.groupBy("least", "caller").agg(s(F.col("has") & F.col("ok"), weight).alias("score"), s(F.col("has"), whole).alias("calls"), s(F.col("ok"), weight).alias("confirmed"))
    ppv, sens = F.try_divide(F.col("score").cast("double"), F.col("calls").cast("double")), F.try_divide(F.col("score").cast("double"), F.col("confirmed").cast("double"))
    return out.select("least", "caller", "score", "calls", "confirmed", ppv.alias("ppv"), sens.alias("sens"), F.try_divide(2 * ppv * sens, ppv + sens).alias("f1"))


def superset_counts(masks: DataFrame) -> DataFrame:
    """Per set of callers the items whose callers include all of it. At most one row per set, so the self-join is of a small table."""
    a, b = masks.select(F.col("mask").alias("subset")), masks.select(F.col("mask").alias("superset"), "n")
    if masks.limit(1 << 16).count() >= 1 << 16:
        raise ValueError("more than sixteen callers")
    pairs = F.broadcast(a).join(b, F.col("subset").bitwiseAND(F.col("superset")) == F.col("subset"))
    return pairs.groupBy("subset").agg(F.sum("n").alias("n_including"))


def caller_correlation(df: DataFrame, keys: list[str], caller: str, callers: list[str]) -> DataFrame:
    """Pearson correlation of each pair of callers over all items (called or not)."""
    wide = df.groupBy(*keys).agg(*[F.max((F.col(caller) == c).cast("int")).alias(f"c{i}") for i, c in enumerate(callers)])
    pairs = [(i, j) for i in range(len(callers)) for j in range(i + 1, len(callers))]
    one = wide.agg(*[F.corr(f"c{i}", f"c{j}").alias(f"r_{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(callers[i]).alias("a"), F.lit(callers[j]).alias("b"), F.col(f"r_{i}_{j}").alias("r")) for i, j in pairs])).alias("x")).select("x.*")


def paste(parts: list[DataFrame], line: str = "line_no", fill: str = "NA") -> DataFrame:
    """Tables side by side by line number, missing lines filled."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, [line], "full")
    return out.na.fill(fill)


def matrix_union(a: DataFrame, b: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Two long matrices as one: rows and columns of both, values added; absent cells are 0 when pivoted."""
    return a.unionByName(b).groupBy(row, column).agg(F.sum(value).alias(value))


def regulator_sets(regions: DataFrame) -> DataFrame:
    """Genes per aberration (and ALL) by their highest region class: Broad holds all, NonBroad class 2 and 3, Peak class 3."""
    best = regions.groupBy("aberration", "gene").agg(F.max("class").alias("class"))
    both = best.unionByName(best.groupBy("gene").agg(F.max("class").alias("class")).withColumn("aberration", F.lit("ALL")))
    names = F.filter(F.array(F.when(F.col("class") >= 1, "Broad"), F.when(F.col("class") >= 2, "NonBroad"), F.when(F.col("class") >= 3, "Peak")), lambda x: x.isNotNull())
    return both.select("aberration", "gene", F.explode(names).alias("set"))


def mutation_permutation(spark, lengths: list[float], counts: list[int], n_genes: int, target: float, trials: int = 1_000_000, seed: int = 7, by: str = "length") -> DataFrame:
    """p of a mutation frequency among ``n_genes`` genes drawn without replacement, by length or evenly; trials are spread over tasks."""
    import numpy as np
    import pandas as pd

    per, weights = 10_000, (np.asarray(lengths, float) / sum(lengths) if by == "length" else None)
    sizes, hits = np.asarray(lengths, float), np.asarray(counts, float)

    def run(batches):
        for b in batches:
            below = []
            for task in b["id"]:
                rng = np.random.default_rng([seed, int(task)])
                n = min(per, trials - int(task) * per)
                # the largest keys of an exponential race are a weighted draw without replacement
                keys = rng.exponential(size=(n, len(sizes))) / (weights if weights is not None else 1.0)
                drawn = np.argpartition(keys, n_genes - 1, axis=1)[:, :n_genes]
                below.append(int((hits[drawn].sum(1) / sizes[drawn].sum(1) >= target).sum()))
            yield pd.DataFrame({"n": below})

    return spark.range(0, -(-trials // per)).mapInPandas(run, "n bigint").agg(F.least((F.sum("n") + 1) / F.lit(float(trials)), F.lit(1.0)).alias("p_value"))
