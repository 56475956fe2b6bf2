"""Interval algebra on DataFrames: islands, range joins, as-of look-ups, sweeps, gaps.

Intervals are closed on both ends. Range joins become equi-joins on fixed-width bins, so no nested
loop is ever planned; ordered look-ups and islands split each key into blocks of the order column, so
one hot key never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cut import cut

#: Width of a bin of a range join, about the length of a usual interval.
BIN = 1_000_000
#: Length of a block of the order column; a key's rows are cut into these.
BLOCK = 50_000_000


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.sequence(F.floor(low / width), F.floor(high / width))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, low: str, high: str,
                        how: str = "inner", width: int = BIN) -> DataFrame:
    """Points joined to every interval of their key that holds them; ``how``: inner, left, semi or anti.

    Intervals are repeated once per bin they touch; a point is in one bin, so pairs come out once.
    Columns of ``intervals`` other than the keys must not clash with those of ``points``.
    """
    right = intervals.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(_bins(F.col(low), F.col(high), width)))
    right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    left = points.withColumn("__at", F.floor(F.col(pos) / width))
    on = [left[k] == right[f"__{k}"] for k in keys] + [left["__at"] == right["__bin"], left[pos].between(right[low], right[high])]
    kind = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    return left.join(right, on, kind).drop("__at", "__bin", *[f"__{k}" for k in keys])


def overlapping_intervals(a: DataFrame, b: DataFrame, keys: list[str], a_ends: tuple[str, str], b_ends: tuple[str, str],
                          how: str = "inner", width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals of equal keys; ``how``: inner, semi or anti. A pair is kept in its first common bin only."""
    left = a.withColumn("__bin", F.explode(_bins(F.col(a_ends[0]), F.col(a_ends[1]), width)))
    right = b.withColumn("__bbin", F.explode(_bins(F.col(b_ends[0]), F.col(b_ends[1]), width)))
    right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k] == right[f"__{k}"] for k in keys] + [left["__bin"] == right["__bbin"]]
    on += [left[a_ends[0]] <= right[b_ends[1]], right[b_ends[0]] <= left[a_ends[1]]]
    if how in ("semi", "anti"):
        # an interval lies in several bins: it overlaps when any of its bins does
        names = a.columns
        hit = left.join(right, on, "left_semi").select(*names).distinct()
        if how == "semi":
            return hit
        same = [a[c].eqNullSafe(hit[c]) for c in names]
        return a.join(hit, same, "left_anti")
    first = F.greatest(F.floor(F.col(a_ends[0]) / width), F.floor(F.col(b_ends[0]) / width))
    return left.join(right, on).where(F.col("__bin") == first).drop("__bin", "__bbin", *[f"__{k}" for k in keys])


def ordered_islands(df: DataFrame, keys: list[str], order: str, same: list[str], ties: tuple[str, ...] = (),
                    extra_break: Column | None = None, block: int = BLOCK, out: str = "island") -> DataFrame:
    """``df`` with a number per run of equal ``same`` columns along ``order`` within ``keys``.

    ``extra_break`` may use ``prev_<order>`` to break runs too. Each key is cut into blocks of ``block``
    along the order; runs are numbered within blocks, and one row per block carries the numbers on. The numbered rows
    are written once, so what lies below is computed once.
    """
    here = df.withColumn("__blk", F.floor(F.col(order) / block))
    local = Window.partitionBy(*keys, "__blk").orderBy(order, *ties)
    label = F.struct(*[F.col(c) for c in same])
    here = here.withColumn("__p", F.lag(F.struct(label.alias("l"), F.col(order).alias(f"o"))).over(local))
    prev = f"prev_{order}"

    def broken(before: Column) -> Column:
        b = ~label.eqNullSafe(before["l"])
        return b

    here = here.withColumn(prev, F.col("__p.o"))
    breaks = broken(F.col("__p"))
    if extra_break is not None:
        breaks = breaks | F.coalesce(extra_break, F.lit(False))
    here = here.withColumn("__cut", F.when(F.col("__p").isNull(), 0).otherwise(breaks.cast("int")))
    here = here.withColumn("__n", F.sum("__cut").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    here = cut(here.drop("__p", prev))
    edge = F.struct(F.col(order).alias("o"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)])
    blocks = here.groupBy(*keys, "__blk").agg(
        F.sum("__cut").alias("__cuts"), F.min_by(label, edge).alias("__head"), F.max_by(label, edge).alias("__tail"),
        F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    over = Window.partitionBy(*keys).orderBy("__blk")
    blocks = blocks.withColumn("__pt", F.lag("__tail").over(over)).withColumn(prev, F.lag("__hi").over(over))
    starts = ~F.col("__head").eqNullSafe(F.col("__pt"))
    if extra_break is not None:
        # the break's columns of the block's first row: its order and its own label
        first = blocks.select(*keys, "__blk", prev, F.col("__lo").alias(order), F.col("__head.*"), "__cuts", "__head", "__pt")
        first = first.withColumn("__b", (~F.col("__head").eqNullSafe(F.col("__pt"))) | F.coalesce(extra_break, F.lit(False)))
        blocks = first.select(*keys, "__blk", "__cuts", F.col("__b").cast("int").alias("__b"))
    else:
        blocks = blocks.select(*keys, "__blk", "__cuts", starts.cast("int").alias("__b"))
    blocks = blocks.withColumn("__base", F.sum(F.col("__cuts") + F.col("__b")).over(over) - F.col("__cuts"))
    blocks = blocks.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__blk").alias("__kb"), "__base")
    # one row per block: broadcast or sorted as its size at run time says
    joined = here.join(blocks, [here[k].eqNullSafe(blocks[f"__k_{k}"]) for k in keys] + [here["__blk"] == blocks["__kb"]])
    return joined.withColumn(out, (F.col("__base") + F.col("__n")).cast("bigint")).drop(
        "__blk", "__cut", "__n", "__kb", "__base", *[f"__k_{k}" for k in keys])


def collapse_islands(df: DataFrame, keys: list[str], order: str, same: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """keys, same, ``start``, ``end`` and ``n`` of each run."""
    runs = ordered_islands(df, keys, order, same, ties)
    return runs.groupBy(*keys, *same, "island").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def asof_floor(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str, out: str, default: Column | None = None,
               block: int = BLOCK) -> DataFrame:
    """Each left row with the value of the last right row at or before it (``on``, same name on both sides).

    Both sides become one ordered stream per key, cut along ``on`` into blocks; the last value of each block is
    carried to the next ones.
    """
    a = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, on, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    blk = F.floor(F.col(on) / block)
    both = both.withColumn("__blk", blk)
    local = Window.partitionBy(*keys, "__blk").orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__f", F.last("__v", ignorenulls=True).over(local))
    # one row per block that holds right rows, valid from there to the next one: what a block begins with
    ends = b.where(F.col(on).isNotNull()).withColumn("__blk", blk).groupBy(*keys, "__blk").agg(F.max_by("__v", on).alias("__e"))
    span = Window.partitionBy(*keys).orderBy("__blk")
    grid = a.select(*keys, blk.alias("__blk")).distinct().withColumn("__e", F.lit(None).cast(right.schema[value].dataType)).unionByName(ends)
    grid = grid.groupBy(*keys, "__blk").agg(F.first("__e", ignorenulls=True).alias("__e"))
    grid = grid.select(*keys, "__blk", F.last("__e", ignorenulls=True).over(span.rowsBetween(Window.unboundedPreceding, -1)).alias("__c"))
    both = both.join(grid, [*keys, "__blk"], "left").withColumn("__f", F.coalesce("__f", "__c")).drop("__c")
    found = F.col("__f") if default is None else F.coalesce("__f", default)
    return both.where(F.col("__side") == 1).withColumn(out, found).drop("__side", "__v", "__blk", "__f")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str) -> DataFrame:
    """Each left row with the nearest right row on either side: ``value`` and ``distance``; ties go to the one before."""
    down = asof_floor(left, right.withColumn("__b", F.struct(F.col(on).alias("p"), F.col(value).alias("v"))), keys, on, "__b", "__before")
    flip = lambda d: d.withColumn(on, -F.col(on))
    up = asof_floor(flip(down), flip(right).withColumn("__b", F.struct((-F.col(on)).alias("p"), F.col(value).alias("v"))), keys, on, "__b", "__after")
    both = flip(up)
    back, ahead = F.col(on) - F.col("__before.p"), F.col("__after.p") - F.col(on)
    before = F.col("__after").isNull() | F.coalesce(back <= ahead, F.lit(False))
    return both.select(*left.columns, F.when(before, F.col("__before.v")).otherwise(F.col("__after.v")).alias(value),
                       F.when(before, back).otherwise(ahead).alias("distance"))


def disjoin(df: DataFrame, keys: list[str], low: str, high: str, block: int = BLOCK, **aggregates: Column) -> DataFrame:
    """Pieces between all boundaries of a key's intervals, with ``recurrence`` (how many cover each) and other
    aggregates of those that do. Uncovered pieces don't come out; the result is the same in any order.

    A running sum of openings minus closings gives the coverage, so intervals are never joined to the
    pieces unless other aggregates ask for it.
    """
    edges = df.select(*keys, F.explode(F.array(
        F.struct(F.col(low).alias("at"), F.lit(1).alias("d")), F.struct((F.col(high) + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    edges = edges.groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d")).withColumn("__blk", F.floor(F.col("start") / block))
    edges = cut(edges)
    # each block's coverage before it and the boundary after it
    over = Window.partitionBy(*keys).orderBy("__blk")
    blocks = edges.groupBy(*keys, "__blk").agg(F.sum("d").alias("__d"), F.min("start").alias("__lo"))
    blocks = blocks.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__blk").alias("__kb"),
                           (F.sum("__d").over(over) - F.col("__d")).alias("__before"), F.lead("__lo").over(over).alias("__next"))
    local = Window.partitionBy(*keys, "__blk").orderBy("start")
    edges = edges.withColumn("__to", F.lead("start").over(local)).withColumn("__sum", F.sum("d").over(local))
    edges = edges.join(blocks, [edges[k].eqNullSafe(blocks[f"__k_{k}"]) for k in keys] + [edges["__blk"] == blocks["__kb"]])
    pieces = edges.select(*keys, "start", (F.coalesce("__to", "__next") - 1).alias("end"), (F.col("__before") + F.col("__sum")).cast("bigint").alias("recurrence"))
    pieces = pieces.where((F.col("recurrence") > 0) & F.col("end").isNotNull())
    if not aggregates:
        return pieces
    own = df.withColumnRenamed(low, "__lo").withColumnRenamed(high, "__hi")
    joined = points_in_intervals(pieces, own, keys, "start", "__lo", "__hi")
    return joined.groupBy(*keys, "start", "end", "recurrence").agg(*[c.alias(n) for n, c in aggregates.items()])


def gap_regions(sites: DataFrame, regions: DataFrame, keys: list[str], pos: str, low: str, high: str) -> DataFrame:
    """Regions and, between them, runs of sites in no region as regions of their own: keys, start, end, n_sites, is_gap."""
    tagged = points_in_intervals(sites.select(*keys, pos), regions.select(*keys, F.col(low).alias("__lo"), F.col(high).alias("__hi")),
                                 keys, pos, "__lo", "__hi", "left")
    tagged = tagged.groupBy(*keys, pos).agg(F.min("__lo").alias("region"), F.count(F.lit(1)).alias("__c"))
    runs = ordered_islands(tagged, keys, pos, ["region"])
    out = runs.groupBy(*keys, "island", "region").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n_sites"))
    return out.select(*keys, "start", "end", "n_sites", F.col("region").isNull().alias("is_gap"))


def overlap_class(chrom1: Column, low1: Column, high1: Column, chrom2: Column, low2: Column, high2: Column) -> Column:
    """How the first interval lies to the second: one of fifteen relations (fixed values, as the names tell)."""
    left = F.when(high1 == high2, "Equals").when(high1 < high2, "ConsumedByAlignedLeft").otherwise("SubsumesAlignedLeft")
    before = (F.when(high1 == high2, "SubsumesAlignedRight").when(high1 > high2, "SubsumesTotal").when(high1 >= low2, "BeforeWithOverlap")
              .when(low2 - high1 == 1, "AdjacentBefore").otherwise("BeforeWithoutOverlap"))
    after = (F.when(high1 == high2, "ConsumedByAlignedRight").when(high1 < high2, "ConsumedByTotal").when(low1 <= high2, "AfterWithOverlap")
             .when(low1 - high2 == 1, "AdjacentAfter").otherwise("AfterWithoutOverlap"))
    return (F.when(chrom1 < chrom2, "BeforeViaDiffChromosome").when(chrom1 > chrom2, "AfterViaDiffChromosome")
            .when(low1 == low2, left).when(low1 < low2, before).otherwise(after))


def interval_distance(chrom1: Column, low1: Column, high1: Column, chrom2: Column, low2: Column, high2: Column) -> Column:
    """0 when they overlap, the largest int across chromosomes, else the distance of the nearer ends."""
    return F.when(chrom1 != chrom2, F.lit(2**31 - 1)).otherwise(F.greatest(low1 - high2, low2 - high1, F.lit(0)))


def overlap_length(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """Positions two intervals share."""
    return F.greatest(F.least(high1, high2) - F.greatest(low1, low2) + 1, F.lit(0))


def splice_scores(df: DataFrame, keys: list[str], low: str, high: str, score: str) -> DataFrame:
    """Overlaid intervals as pieces with the highest score, the sum of scores and the depth."""
    return disjoin(df, keys, low, high, max_score=F.max(score), sum_score=F.sum(score), depth=F.count(F.lit(1)))


def sample_points(regions: DataFrame, low: str, high: str, n: int = 20) -> DataFrame:
    """About ``n`` evenly spaced positions per region, its start first."""
    step = F.greatest(F.floor((F.col(high) - F.col(low)) / n), F.lit(1)).cast("bigint")
    return regions.withColumn("position", F.explode(F.sequence(F.col(low).cast("bigint"), F.col(high).cast("bigint"), step)))


def fill_midpoints(segments: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Segments stretched over the gaps between consecutive ones, each gap split at its middle."""
    over = Window.partitionBy(*keys).orderBy(low)
    ahead, behind = F.lead(low).over(over), F.lag(high).over(over)
    return segments.select(*segments.columns, F.when(behind.isNull(), F.col(low)).otherwise(F.floor((behind + F.col(low)) / 2) + 1).alias("fill_start"),
                           F.when(ahead.isNull(), F.col(high)).otherwise(F.floor((F.col(high) + ahead) / 2)).alias("fill_end"))


def anchor_groups(df: DataFrame, keys: list[str], order: list[str], position: str, reach: int, out: str = "anchor") -> DataFrame:
    """``df`` with the number of the greedy window each row falls into: a window opens at a row and takes the rows of
    its keys less than ``reach`` on; the next row opens the next one.

    Rows stream through in order and only the open window's start is remembered, so a group of any size passes.
    Rows without a position are left out.
    """
    import pyarrow as pa

    names = df.columns
    at = [names.index(k) for k in keys]
    place = names.index(position)

    def run(batches):
        key, start, number = None, 0, 0
        for batch in batches:
            ids = []
            for *k, p in zip(*[batch.column(i).to_pylist() for i in (*at, place)]):
                if k != key:
                    key, start, number = k, p, number + 1
                elif p - start >= reach:
                    start, number = p, number + 1
                ids.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], [*names, out])

    schema = ", ".join(f"`{n}` {k}" for n, k in df.dtypes) + f", `{out}` bigint"
    rows = df.where(F.col(position).isNotNull()).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, schema)


def markers_of_intervals(intervals: DataFrame, markers: DataFrame, keys: list[str], low: str, high: str, pos: str) -> DataFrame:
    """Each interval with the markers inside it; without any, with the next marker after its start, else the last one before.

    ``markers`` may have no column of ``intervals`` but the keys; intervals of a key without markers are left out.
    """
    names = intervals.columns
    extra = [c for c in markers.columns if c not in keys]
    inside = points_in_intervals(markers, intervals.distinct(), keys, pos, low, high).select(*names, *extra)
    hit = inside.select(*names).distinct()
    lone = intervals.distinct().join(hit, [intervals[c].eqNullSafe(hit[c]) for c in names], "left_anti")
    row = F.struct(*extra)
    probes = markers.select(*keys, F.col(pos).cast("bigint").alias("__p"), row.alias("__m"))
    starts = lone.withColumn("__p", F.col(low).cast("bigint"))
    before = asof_floor(starts, probes, keys, "__p", "__m", "__before")
    flip = lambda d: d.withColumn("__p", -F.col("__p"))
    both = asof_floor(flip(before), flip(probes), keys, "__p", "__m", "__after")
    chosen = both.withColumn("__m", F.coalesce("__after", "__before")).where("__m IS NOT NULL")
    return inside.unionByName(chosen.select(*names, *[F.col(f"__m.{c}").alias(c) for c in extra]))


def neighbours_of_intervals(a: DataFrame, b: DataFrame, keys: list[str], a_ends: tuple[str, str], b_ends: tuple[str, str], reach: int = 100_000) -> DataFrame:
    """Each interval of ``a`` with those of ``b`` that overlap it and the nearest ones on either side closer than ``reach``: ``distance`` 0 or more."""
    names = a.columns
    wide = a.distinct().withColumn("__lo", F.col(a_ends[0]) - reach + 1).withColumn("__hi", F.col(a_ends[1]) + reach - 1)
    near = overlapping_intervals(wide, b, keys, ("__lo", "__hi"), b_ends)
    side = F.when(F.col(b_ends[0]) > F.col(a_ends[1]), 1).when(F.col(b_ends[1]) < F.col(a_ends[0]), -1).otherwise(0)
    gap = F.greatest(F.col(b_ends[0]) - F.col(a_ends[1]), F.col(a_ends[0]) - F.col(b_ends[1]), F.lit(0)).cast("bigint")
    near = near.withColumn("__side", side).withColumn("distance", gap)
    least = F.min("distance").over(Window.partitionBy(*names, "__side"))
    return near.withColumn("__least", least).where("distance = __least").drop("__lo", "__hi", "__side", "__least")
