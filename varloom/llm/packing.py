"""Filling containers of fixed capacity: conflict-constrained best fit.

Open containers are ordered by what room they have left: a bitmap over the residuals finds the
tightest one that fits by find-first-set, and the successor search goes on to wider ones until a
container is met whose bitmap of duplicate clusters and sources has no conflict with the item. While
containers are needed anyway an item without a compatible one opens a new one; after that (the total
size would fit into those open) it takes the tightest one without a copy of it, else the tightest, so
conflicts never cost space.

Items are packed in shards of bounded size that a hash fills evenly, whatever sources and copies
there are. Containers left with room are dissolved and packed again in other mixtures, in shards as
bounded as before, until a lower bound shows that nothing can be won or a round wins next to nothing;
a round that wins nothing is thrown away. The rule is the same at every size of the table.

Defined results: items of size 0 (null and empty texts) need no container and get none; an item above
the capacity is split into full containers and a rest that is packed like an item, any other is never
split; ties go to larger items, then smaller ids; repeated rows are items of their own, under equal ids
too; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.cut import cut
from ..plans.spread import spread
from .bpe import VOCABULARY, token_counts

#: Items that one task packs at once.
SHARD_ITEMS = 20_000
#: Containers filled below this share are packed again with those of other shards.
FILL = 0.98
#: Share of the dissolved containers that a round must save for another one to follow.
GAIN = 0.005


def best_fit(sizes: list[int], clusters: list, sources: list, capacity: int, distinct_sources: bool = True) -> list[int]:
    """The container number of each item, items taken from the largest to the smallest."""
    held = Counter(("cluster", c) for c in clusters if c is not None)
    if distinct_sources:
        held.update(("source", s) for s in sources if s is not None)
    bit = {k: 1 << i for i, k in enumerate(k for k, n in held.items() if n > 1)}
    needed = -(-sum(sizes) // capacity)
    # what may lie in every other container has a bitmap of its own: the residuals at which a container lacks it
    heavy = [bit[k] for k, n in held.items() if n > 1 and 2 * n > needed]
    lacking = dict.fromkeys(heavy, 0)
    lacks: dict[int, Counter] = {b: Counter() for b in heavy}
    rooms = 0  # bit r: some container has r left
    by_room: dict[int, dict[int, list[int]]] = defaultdict(dict)  # residual -> what containers hold -> these
    room: list[int] = []
    holds: list[int] = []

    def take_out(b: int) -> None:
        nonlocal rooms
        r, held_by = room[b], holds[b]
        same = by_room[r]
        same[held_by].pop()
        if not same[held_by]:
            del same[held_by]
            if not same:
                rooms &= ~(1 << r)
            for h in heavy:
                if not held_by & h:
                    lacks[h][r] -= 1
                    if not lacks[h][r]:
                        lacking[h] &= ~(1 << r)

    def put_in(b: int) -> None:
        nonlocal rooms
        r, held_by = room[b], holds[b]
        same = by_room[r]
        if held_by not in same:
            same[held_by] = []
            rooms |= 1 << r
            for h in heavy:
                if not held_by & h:
                    lacks[h][r] += 1
                    lacking[h] |= 1 << r
        same[held_by].append(b)

    def search(size: int, conflicts: int) -> int:
        left = rooms >> size
        for h in heavy:
            if conflicts & h:
                left &= lacking[h] >> size
        at = size
        while left:
            step = (left & -left).bit_length() - 1
            at += step
            for held_by, same in by_room[at].items():
                if not held_by & conflicts:
                    return same[-1]
            left >>= step + 1
            at += 1
        return -1

    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda x: -sizes[x]):
        size, cluster, source = sizes[i], bit.get(("cluster", clusters[i]), 0), bit.get(("source", sources[i]), 0)
        chosen = search(size, cluster | source)
        if chosen < 0 and len(room) >= needed and cluster | source:
            chosen = search(size, cluster) if source else -1
            if chosen < 0:
                chosen = search(size, 0)
        if chosen < 0:
            chosen = len(room)
            room.append(capacity)
            holds.append(0)
        else:
            take_out(chosen)
        room[chosen] -= size
        holds[chosen] |= cluster | source
        if room[chosen]:
            put_in(chosen)
        out[i] = chosen
    return out


def _shard(level: int, fill: float, distinct_sources: bool):
    """Packs one shard of a limit; items of containers with much room are marked to be packed again."""
    def plain(column: pd.Series) -> list:
        return [None if v is None or v != v else v for v in column.tolist()]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["item_id", "row", "part_no"], ignore_index=True)
        capacity, shard = int(part["capacity"].iloc[0]), int(part["shard"].iloc[0])
        sizes = part["n_tokens"].to_numpy(np.int64)
        bins = np.array(best_fit(sizes.tolist(), plain(part["cluster"]), plain(part["source"]), capacity, distinct_sources))
        filled = np.bincount(bins, weights=sizes)
        part["container"] = [f"{level}-{shard}-{b}" for b in bins]
        part["opens"] = ~pd.Series(bins).duplicated()
        part["again"] = filled[bins] < fill * capacity
        return part.drop(columns="shard")

    return run


def pack_items(items: DataFrame, capacities: dict[int, int], distinct_sources: bool = True,
               shard_items: int = SHARD_ITEMS, fill: float = FILL, gain: float = GAIN) -> DataFrame:
    """``items`` (item_id, size, cluster, source) in containers of each capacity (limit_id -> capacity).

    Returns limit_id, capacity, item_id, part_no, first_token, n_tokens and container.
    """
    if "row" not in items.columns:  # a number per row, so that repeated ids stay apart
        items = cut(items.select("item_id", "size", "cluster", "source", F.monotonically_increasing_id().alias("row")))
    limits = F.explode(F.array(*[F.struct(F.lit(int(k)).cast("bigint").alias("limit_id"), F.lit(int(c)).cast("bigint").alias("capacity"))
                                 for k, c in sorted(capacities.items())]))
    each = items.withColumn("l", limits).select("l.*", "item_id", "row", "size", "cluster", "source")
    full = F.floor(F.col("size") / F.col("capacity")).cast("bigint")
    rest = F.col("size") - full * F.col("capacity")
    label = F.concat(F.lit("item-"), F.col("row").cast("string"), F.lit("-"))
    fulls = each.where(full > 0).withColumn("part_no", F.explode(F.sequence(F.lit(1).cast("bigint"), full))).select(
        "limit_id", "capacity", "item_id", "part_no", ((F.col("part_no") - 1) * F.col("capacity")).alias("first_token"),
        F.col("capacity").alias("n_tokens"), F.concat(label, F.col("part_no").cast("string")).alias("container"))
    none = each.where(F.coalesce(F.col("size"), F.lit(0)) == 0).select(
        "limit_id", "capacity", "item_id", F.lit(1).cast("bigint").alias("part_no"), F.lit(0).cast("bigint").alias("first_token"),
        F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("string").alias("container"))
    todo = each.where(rest > 0).select(
        "limit_id", "capacity", "item_id", "row", (full + 1).alias("part_no"), (full * F.col("capacity")).alias("first_token"),
        rest.alias("n_tokens"), "cluster", "source")
    kinds = ", ".join(f"{n} {k}" for n, k in todo.dtypes)
    waiting = {r["limit_id"]: r["n"] for r in todo.groupBy("limit_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    dissolved: dict[int, int] = {}
    parts, level, before = [fulls, none], 0, None
    while waiting:
        shards = {k: -(-n // shard_items) for k, n in waiting.items()}
        of_limit = F.create_map(*[F.lit(x) for x in chain.from_iterable(shards.items())])[F.col("limit_id")]
        todo = todo.withColumn("shard", F.pmod(F.xxhash64("item_id", "row", "part_no", F.lit(level)), of_limit).cast("int"))
        packed = cut(todo.groupBy("limit_id", "shard").applyInPandas(
            _shard(level, fill, distinct_sources), f"{kinds}, container string, opens boolean, again boolean"))
        again = F.col("again")
        stats = packed.groupBy("limit_id").agg(
            F.count_if("opens").alias("used"), F.count_if(again & F.col("opens")).alias("loose"), F.count_if(again).alias("n"),
            F.sum(F.when(again, F.col("n_tokens"))).alias("tokens"), F.count_if(again & (2 * F.col("n_tokens") > F.col("capacity"))).alias("halves"))
        keep, worse, waiting = [], [], {}
        for r in stats.collect():
            k, won = r["limit_id"], dissolved.get(r["limit_id"], r["used"] + 1) - r["used"]
            if won <= 0:
                worse.append(k)
                continue
            keep.append(k)
            bound = max(-(-(r["tokens"] or 0) // capacities[k]), r["halves"])
            if shards[k] > 1 and r["loose"] > bound and (level == 0 or won >= gain * dissolved[k]):
                waiting[k], dissolved[k] = r["n"], r["loose"]
        if worse:  # mixing these again didn't help: they stay as they were
            parts.append(before.where(F.col("again") & F.col("limit_id").isin(worse)).select(fulls.columns))
        parts.append(packed.where(F.col("limit_id").isin(keep) & ~(again & F.col("limit_id").isin(list(waiting)))).select(fulls.columns))
        before, todo = packed, packed.where(again & F.col("limit_id").isin(list(waiting))).drop("container", "opens", "again")
        level += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(docs: DataFrame, capacities: dict[int, int], id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source", vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """Documents by the tokens of their text; copies of a text are a duplicate cluster."""
    rows = spread(docs.select(F.col(id_col).alias("item_id"), F.md5(text_col).alias("cluster"), F.col(source_col).alias("source"), F.col(text_col).alias("text")))
    sizes = token_counts(rows, ("item_id", "cluster", "source"), "text", vocabulary).withColumnRenamed("n_tokens", "size")
    sizes = cut(sizes.withColumn("row", F.monotonically_increasing_id()))
    return pack_items(sizes, capacities, **options).withColumnRenamed("item_id", id_col)


def shared_containers(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per limit the containers, the share of their room used, and how many items share theirs with a copy or with their source
    (those beyond the first of each text or source in a container)."""
    known = docs.select(id_col, F.md5(text_col).alias("cluster"), F.col(source_col).alias("source"))
    rows = packed.where("container IS NOT NULL").join(known, id_col)
    boxes = rows.groupBy("limit_id", "container").agg(
        F.first("capacity").alias("capacity"), F.sum("n_tokens").alias("tokens"),
        (F.count("cluster") - F.count_distinct("cluster")).alias("copies"), (F.count("source") - F.count_distinct("source")).alias("same_source"))
    return boxes.groupBy("limit_id").agg(
        F.count(F.lit(1)).alias("n_containers"), (F.sum("tokens") / F.sum("capacity")).alias("fill"),
        F.sum("copies").alias("n_shared_copies"), F.sum("same_source").alias("n_shared_sources"))
