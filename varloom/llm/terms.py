"""Frequency of every distinct term: burst tries per task, merged by matching subtrees.

A task counts terms in a burst trie: containers hold the rest of a term after their prefix with its
counters, and a container that grows beyond a limit bursts into containers of longer prefixes (the
next character after all that its terms share). Tasks write their containers as compact subtrees:
a prefix and sorted suffixes. Routes, prefixes as long as the terms below them demand, are chosen from
the subtrees' sizes. A subtree goes to its route whole, only one that a route cuts is split, into
ranges. Subtrees under one route meet in one task, where those of equal prefix merge as sorted runs.

Defined results: a null array or term counts nothing; empty terms are counted like others (callers
drop them); a term twice in a record counts two occurrences and one record; repeated rows count each;
very long terms are kept whole; an empty table gives no terms.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.cut import cut
from ..plans.spread import spread

#: Terms of a container before it bursts.
BURST = 4096
#: Terms a task's trie holds before it is written out and begun again.
HOLD = 500_000
#: Most routes, and characters of one; they are the only thing sent to all tasks. What lies below a longer
#: prefix is dealt to buckets like any route's heavy remainder.
ROUTES, ROUTE_CHARS = 16_384, 1_000
#: Terms that should meet in one route's task at most.
ROUTE_TERMS = 200_000

SUBTREE = "suffixes array<string>, occurrences array<bigint>, records array<bigint>"
CONTAINER = f"field string, prefix string, path array<int>, n int, {SUBTREE}"


def _shared(a: str, b: str) -> str:
    """What two strings begin with alike."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return a[:n]


class BurstTrie:
    """Occurrence and record counters per term, in containers by adaptive prefixes.

    An inner node skips what all terms below it share; terms that end or branch off inside that stay in a
    container of the node's own prefix, which bursts like any other and so splits the node.
    """

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.size = burst, 0
        self.skips: dict[str, str] = {}  # prefix of an inner node -> what is skipped before the next character
        self.containers: dict[str, dict[str, list[int]]] = {}

    def add(self, term: str, occurrences: int, records: int) -> None:
        prefix, skips = "", self.skips
        while prefix in skips:
            skip = skips[prefix]
            at = len(prefix) + len(skip)
            if len(term) <= at or not term.startswith(skip, len(prefix)):
                break
            prefix = term[: at + 1]
        box = self.containers.setdefault(prefix, {})
        suffix = term[len(prefix) :]
        counter = box.get(suffix)
        if counter is None:
            box[suffix] = [occurrences, records]
            self.size += 1
            if len(box) > self.burst:
                self._burst(prefix)
        else:
            counter[0] += occurrences
            counter[1] += records

    def _burst(self, prefix: str) -> None:
        todo = [prefix]
        while todo:
            prefix = todo.pop()
            box = self.containers.get(prefix, {})
            if len(box) <= self.burst:
                continue
            del self.containers[prefix]
            skip, old = _shared(min(box), max(box)), self.skips.get(prefix)
            if old is not None:  # the node splits where these terms leave what it skipped
                skip = _shared(skip, old)
                self.skips[prefix + old[: len(skip) + 1]] = old[len(skip) + 1 :]
            self.skips[prefix] = skip
            at = len(skip) + 1
            for suffix, counter in box.items():
                longer = prefix + suffix[:at] if len(suffix) >= at else prefix
                self.containers.setdefault(longer, {})[suffix[at:] if longer != prefix else suffix] = counter
            todo += {prefix + suffix[:at] for suffix in box if len(suffix) >= at}

    def path(self, prefix: str) -> list[int]:
        """Lengths of the prefixes of the nodes above a container, and of its own."""
        out, at = [], 0
        while at < len(prefix):
            out.append(at)
            at += len(self.skips[prefix[:at]]) + 1
        return [*out, at]

    def subtrees(self) -> Iterator[tuple[str, list[int], list[str], list[int], list[int]]]:
        """Each container: its prefix and path, sorted suffixes and their counters."""
        for prefix, box in self.containers.items():
            if box:
                suffixes = sorted(box)
                yield prefix, self.path(prefix), suffixes, [box[s][0] for s in suffixes], [box[s][1] for s in suffixes]


def _batch_counts(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct terms of a batch of lists with their occurrences and records."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten()
    if len(flat) == 0:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = lists.value_parent_indices().to_numpy() if hasattr(lists, "value_parent_indices") else \
        pc.list_parent_indices(lists).to_numpy()
    coded = flat.dictionary_encode()
    codes = coded.indices
    if codes.null_count:
        keep = codes.is_valid().to_numpy(zero_copy_only=False)
        row, codes = row[keep], codes.drop_null()
    codes = codes.to_numpy()
    k = len(coded.dictionary)
    pairs = np.unique(row.astype(np.int64) * k + codes)
    return coded.dictionary.to_pylist(), np.bincount(codes, minlength=k), np.bincount(pairs % k, minlength=k)


def choose_routes(weights: list[tuple[str, str, int]], route_terms: int, max_routes: int) -> dict[str, dict[str, int]]:
    """Per field the routes (prefix -> buckets) from the terms below each known prefix.

    A prefix is a route of its own where the next shorter one known holds more than one task should. What a route keeps
    after its longer routes are taken away may still be too much (many small branches): its terms are dealt to buckets.
    """
    routes: dict[str, dict[str, int]] = {}
    whole = sum(n for _, prefix, n in weights if not prefix)
    limit = max(route_terms, whole // max(1, max_routes // 2))
    for field in sorted({f for f, _, _ in weights}):
        weight = {p: n for f, p, n in weights if f == field}
        rest: dict[str, int] = {}
        open_: list[str] = []  # known prefixes of the one at hand
        for p in sorted(weight):
            while open_ and not p.startswith(open_[-1]):
                open_.pop()
            if not open_:
                rest[p] = weight[p]
            elif weight[open_[-1]] > limit and open_[-1] in rest:
                rest[p] = weight[p]
                rest[open_[-1]] -= weight[p]
            open_.append(p)
        routes[field] = {p: max(1, -(-n // limit)) for p, n in rest.items()}
    return routes


def route_of(routes: list[str], term: str) -> str:
    """The longest of some sorted routes that begins ``term``."""
    at = bisect_right(routes, term)
    while at:
        candidate = routes[at - 1]
        if term.startswith(candidate):
            return candidate
        # shorten to what the two share: no longer route can begin the term
        at = bisect_right(routes, term[: len(_shared(candidate, term))])
    return ""


def span_of(suffixes: list[str], begin: str) -> tuple[int, int]:
    """The range of sorted suffixes that begin so."""
    low = bisect_left(suffixes, begin)
    if ord(begin[-1]) < 0x10FFFF:
        return low, bisect_left(suffixes, begin[:-1] + chr(ord(begin[-1]) + 1), low)
    high = low
    while high < len(suffixes) and suffixes[high].startswith(begin):
        high += 1
    return low, high


def ranges_by_prefix(prefix: str, suffixes: list[str], longer: list[str]) -> list[tuple[str | None, int, int]]:
    """Sorted suffixes in ranges: those below the outermost of some sorted longer prefixes, and what lies between (None)."""
    out, at, i = [], 0, 0
    while i < len(longer):
        outer = longer[i]
        low, high = span_of(suffixes, outer[len(prefix) :])
        if low < high:
            if at < low:
                out.append((None, at, low))
            out.append((outer, low, high))
            at = high
        while i < len(longer) and longer[i].startswith(outer):
            i += 1
    if at < len(suffixes):
        out.append((None, at, len(suffixes)))
    return out


def below(prefixes: list[str], prefix: str) -> list[str]:
    """Those of some sorted prefixes that are longer than ``prefix`` and begin with it."""
    low = high = bisect_right(prefixes, prefix)
    while high < len(prefixes) and prefixes[high].startswith(prefix):
        high += 1
    return prefixes[low:high]


def split_by_route(prefix: str, suffixes: list[str], routes: list[str]) -> Iterator[tuple[str, int, int]]:
    """(route, range) of a subtree's parts: one part unless a route cuts it."""
    todo = [(route_of(routes, prefix), prefix, 0, len(suffixes))]
    while todo:
        route, at, low, high = todo.pop()
        longer = below(routes, at)
        if not longer:
            yield route, low, high
            continue
        part = suffixes[low:high]
        for outer, a, b in ranges_by_prefix(prefix, part, longer):
            if outer is None:
                yield route, low + a, low + b
            else:
                todo.append((outer, outer, low + a, low + b))


def merge_runs(runs: list[tuple[list[str], np.ndarray, np.ndarray]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Sorted runs of suffixes as one, the counters of equal ones added."""
    if len(runs) == 1:
        return runs[0]
    flat = list(chain.from_iterable(r[0] for r in runs))
    order = sorted(range(len(flat)), key=flat.__getitem__)  # the sort takes sorted runs as they are and merges them
    flat = [flat[i] for i in order]
    firsts = [0, *(i for i in range(1, len(flat)) if flat[i] != flat[i - 1])]
    at = np.array(order)
    return [flat[i] for i in firsts], *(np.add.reduceat(np.concatenate([r[c] for r in runs])[at], firsts) for c in (1, 2))


def merge_subtrees(trees: Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]:
    """Subtrees of several tries as one trie's: those of equal prefix merge; where one has burst and another hasn't,
    the other's range of that prefix moves down."""
    runs: dict[str, list] = {}
    for prefix, suffixes, o, r in trees:
        runs.setdefault(prefix, []).append((suffixes, o, r))
    prefixes = sorted(runs)  # shorter ones first, so what moves down moves on
    for prefix in prefixes:
        longer, own = below(prefixes, prefix), []
        for suffixes, o, r in runs[prefix]:
            for outer, a, b in ranges_by_prefix(prefix, suffixes, longer) if longer else [(None, 0, len(suffixes))]:
                if outer is None:
                    own.append((suffixes[a:b], o[a:b], r[a:b]))
                else:
                    gone = len(outer) - len(prefix)
                    runs[outer].append(([x[gone:] for x in suffixes[a:b]], o[a:b], r[a:b]))
        if own:
            yield prefix, *merge_runs(own)


def count_terms(df: DataFrame, fields: dict[str, Column], burst: int = BURST, hold: int = HOLD,
                route_terms: int = ROUTE_TERMS, max_routes: int = ROUTES) -> DataFrame:
    """field, term, occurrences, records of every distinct term; ``fields``: name -> array of the row's terms."""
    names = list(fields)
    source = df.select(*[F.coalesce(c, F.array().cast("array<string>")).alias(f"f{i}") for i, c in enumerate(fields.values())])
    lists = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def dump(tries: list[BurstTrie]) -> Iterator[pa.RecordBatch]:
        for name, trie in zip(names, tries):
            rows = list(trie.subtrees())
            for at in range(0, len(rows), 64):
                p, way, *columns = zip(*rows[at : at + 64])
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(p)), pa.array(p), pa.array(way, pa.list_(pa.int32())), pa.array([len(x) for x in columns[0]], pa.int32()),
                    *map(pa.array, columns, lists)], ["field", "prefix", "path", "n", "suffixes", "occurrences", "records"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [BurstTrie(burst) for _ in names]
        for batch in batches:
            for i, trie in enumerate(tries):
                terms, occurrences, records = _batch_counts(batch.column(i))
                for term, o, r in zip(terms, occurrences.tolist(), records.tolist()):
                    if o:
                        trie.add(term, o, r)
            if sum(t.size for t in tries) > hold:
                yield from dump(tries)
                tries = [BurstTrie(burst) for _ in names]
        yield from dump(tries)

    trees = cut(spread(source).mapInArrow(count, CONTAINER))
    # terms below the prefixes of each trie's nodes; only heavy ones are gathered, at most 4 * max_routes a level of nodes
    sizes = trees.select("field", "prefix", "n", F.explode("path").alias("at")).where(F.col("at") <= ROUTE_CHARS)
    sizes = sizes.groupBy("field", F.substring("prefix", F.lit(1), F.col("at")).alias("prefix")).agg(F.sum("n").cast("long").alias("n"))
    total = trees.agg(F.sum("n")).first()[0] or 0
    least = max(1, total // (4 * max_routes))
    known = [(r["field"], r["prefix"], r["n"]) for r in sizes.where((F.col("n") >= least) | (F.col("prefix") == "")).collect()]
    routes = choose_routes(known, route_terms, max_routes)
    ordered = {f: sorted(r) for f, r in routes.items()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]

            def put(field: str, to: str, bucket: int, prefix: str, *columns: list) -> None:
                for column, value in zip(out, (field, to, bucket, prefix, *columns)):
                    column.append(value)

            for field, prefix, _, _, *columns in zip(*[c.to_pylist() for c in batch.columns]):
                for to, low, high in split_by_route(prefix, columns[0], ordered[field]):
                    part, k = [c[low:high] for c in columns], routes[field][to]
                    if k == 1:
                        put(field, to, 0, prefix, *part)
                        continue
                    dealt: dict[int, list[int]] = {}
                    for i, suffix in enumerate(part[0]):
                        dealt.setdefault(zlib.crc32((prefix + suffix).encode()) % k, []).append(i)
                    for bucket, places in dealt.items():
                        put(field, to, bucket, prefix, *[[c[i] for i in places] for c in part])
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), *lists]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             ["field", "route", "bucket", "prefix", "suffixes", "occurrences", "records"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        trees = zip(part["prefix"], (list(x) for x in part["suffixes"]), part["occurrences"], part["records"])
        terms, occurrences, records = [], [], []
        for prefix, suffixes, o, r in merge_subtrees(trees):
            terms += [prefix + x for x in suffixes]
            occurrences.append(o)
            records.append(r)
        return pd.DataFrame({"field": part["field"].iloc[0], "term": terms, "occurrences": np.concatenate(occurrences), "records": np.concatenate(records)})

    return trees.mapInArrow(split, f"field string, route string, bucket int, prefix string, {SUBTREE}").groupBy("field", "route", "bucket").applyInPandas(
        merge, "field string, term string, occurrences bigint, records bigint")


def mark_terms(counts: DataFrame, n_records: int, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """``counts`` with ``mark``: rare in fewer than ``rare_below`` records, common in more than the share, else null."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * n_records, "common")
    return counts.withColumn("mark", mark)


def symbol_terms(column: Column) -> Column:
    """The symbols a gene field names: remarks in parentheses dropped, blanks and quotes around removed, lower case."""
    bare = F.regexp_replace(column, r"\([^()]*(\)|\z)", "")
    parts = F.transform(F.split(bare, r"[,;|/]"), lambda x: F.lower(F.regexp_replace(x, r"""^[\s"'“”]+|[\s"'“”]+\z""", "")))
    return F.filter(parts, lambda x: ~x.isin("", ".", "none"))


def whole_term(column: Column) -> Column:
    """The field as one term in lower case, without blanks and quotes around it."""
    term = F.lower(F.regexp_replace(column, r"""^[\s"'“”]+|[\s"'“”]+\z""", ""))
    return F.when(term.isin("", ".", "none"), F.array().cast("array<string>")).otherwise(F.array(term))
