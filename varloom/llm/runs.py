"""Repeated consecutive events of a sequence, collapsed into runs by pointer doubling.

A matching event points to its predecessor. Self-joins replace pointers by the pointers' pointers,
so after k rounds a pointer spans 2^k events, until all reach the start of their run. Join keys are
unique (sequence, order), so no round is skewed, however long a run or a sequence is.

Finding the predecessor needs order, not one task per sequence: sequences are cut into blocks of the
order column, at most ``block`` distinct positions each; only block edges meet in blocks ``block`` times
as wide, and so on until one block holds a sequence, however far apart its numbers lie.

Defined results: rows with the same sequence and order are one event (the smallest by ``tie_cols``);
rows with a null sequence or order belong to no sequence and are left out; a null kind or position
matches nothing and so ends a run; an empty table gives no runs; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.cut import cut, drop

#: Distinct positions of a sequence that one task orders at once.
BLOCK = 32_768


def same_chromosome(name: Column) -> Column:
    """A chromosome's name without case, blanks, the chr prefix and leading zeros; M is MT."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"\s+", ""), "^(chrom|chr)?[_.-]?0*(?=.)", "")
    return F.when(bare == "mt", "m").otherwise(bare)


def _block(order: str, width: int) -> Column:
    """Which stretch of ``width`` whole numbers a number lies in."""
    return F.expr(f"IF({order} < 0, ({order} + 1) div {width}L - 1, {order} div {width}L)") if width < 2**63 else F.lit(0)


def link_events(df: DataFrame, seq: str, order: str, kind: Column, position: Column, near: int,
                tie_cols: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """The events that continue the run of the event before: seq, ord, ptr (the predecessor's ord), pos, prev_pos."""
    events = df.select(
        F.col(seq).alias("seq"), F.col(order).cast("bigint").alias("ord"), kind.alias("kind"),
        position.cast("bigint").alias("pos"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie_cols)],
    ).where(F.col("seq").isNotNull() & F.col("ord").isNotNull())
    events = events.withColumn("blk", _block("ord", block))
    ties = [f"t{i}" for i in range(len(tie_cols))]
    within = Window.partitionBy("seq", "blk").orderBy("ord", *ties)
    # one shuffle and one sort serve both windows: repeated lines first, then the neighbours
    events = events.withColumn("again", F.lag("ord").over(within) == F.col("ord")).where(
        ~F.coalesce(F.col("again"), F.lit(False))).drop("again")
    events = events.select(
        "seq", "blk", "ord", "kind", "pos",
        F.lag("ord").over(within).alias("p_ord"), F.lag("kind").over(within).alias("p_kind"),
        F.lag("pos").over(within).alias("p_pos"), F.lead("ord").over(within).isNull().alias("last"))
    first = F.col("p_ord").isNull()
    matches = F.coalesce((F.col("kind") == F.col("p_kind")) & (F.abs(F.col("pos") - F.col("p_pos")) <= near), F.lit(False))
    kept = cut(events.withColumn("matches", matches).where(first | F.col("last") | F.col("matches")))
    columns = ["seq", "ord", F.col("p_ord").alias("ptr"), "pos", F.col("p_pos").alias("prev_pos")]
    found = [kept.where(F.col("matches")).select(*columns)]
    # edges of blocks meet in wider blocks, whose edges meet again: no window holds more than two rows a narrower block
    ends = kept.agg(F.min("ord"), F.max("ord")).first()
    edges, width = kept.where(first | F.col("last")).select("seq", "ord", "kind", "pos", first.alias("lone")), block
    while ends[0] is not None and width < 2**63 and ends[0] // width != ends[1] // width:
        width *= block
        across = Window.partitionBy("seq", _block("ord", width)).orderBy("ord")
        edges = edges.select(
            "seq", "ord", "kind", "pos", "lone", F.lag("ord").over(across).alias("p_ord"), F.lag("kind").over(across).alias("p_kind"),
            F.lag("pos").over(across).alias("p_pos"), F.lead("ord").over(across).isNull().alias("last"))
        found.append(edges.where(F.col("lone")).where(matches).select(*columns))
        edges = edges.where(F.col("p_ord").isNull() | F.col("last")).select(
            "seq", "ord", "kind", "pos", (F.col("lone") & F.col("p_ord").isNull()).alias("lone"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    out = cut(out)
    drop(kept)
    return out


def double_pointers(links: DataFrame) -> DataFrame:
    """``links`` (seq, ord, ptr) with ``ptr`` moved to the start of each run; as many rounds as log2 of the longest run."""
    done, active = [], links.select("seq", "ord", "ptr")
    while True:
        # every event's pointer as of this round; an event that is no link is a start
        state = active
        for part in done:
            state = state.unionByName(part)
        beyond = state.select("seq", F.col("ord").alias("ptr"), F.col("ptr").alias("next"))
        moved = active.join(beyond, ["seq", "ptr"], "left").select(
            "seq", "ord", F.coalesce("next", "ptr").alias("ptr"), F.col("next").isNull().alias("at_start"))
        table = cut(moved, "at_start")
        finished = table.where(F.col("at_start")).drop("at_start")
        left = table.where(~F.col("at_start")).drop("at_start")
        done.append(finished)
        if left.isEmpty():
            break
        active = left
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def collapse_runs(df: DataFrame, seq: str, order: str, kind: Column, position: Column, near: int = 10,
                  tie_cols: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """One row per longest run of two or more matching events: seq, first and last order, number of
    events, smallest and largest position and the span between them."""
    links = link_events(df, seq, order, kind, position, near, tie_cols, block)
    starts = double_pointers(links).withColumnRenamed("ptr", "start")
    runs = starts.join(links, ["seq", "ord"]).groupBy("seq", "start").agg(
        F.max("ord").alias("last"), (F.count(F.lit(1)) + 1).alias("n_events"),
        F.min(F.least("pos", "prev_pos")).alias("low"), F.max(F.greatest("pos", "prev_pos")).alias("high"))
    return runs.select("seq", F.col("start").alias("first"), "last", "n_events", "low", "high",
                       (F.col("high") - F.col("low")).alias("span"))
