"""Streaming forms of ordered operators: event-time counts with late data, last-n-rows windows, runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window of event time; rows later than ``late`` are left out, windows come out once closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def deduplicate(stream: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Rows delivered again within the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def last_rows(stream: DataFrame, key: str, order: str, flag: str, size: int = 20) -> DataFrame:
    """For each arriving row the number of flagged ones among its key's last ``size``; state is ``size`` flags per key."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for part in parts:
            part = part.sort_values(order, kind="stable")
            rows = []
            for o, f in zip(part[order], part[flag]):
                held = [*held, int(bool(f))][-size:]
                rows.append((k[0], o, len(held), sum(held)))
            yield pd.DataFrame(rows, columns=[key, order, "n", "n_flagged"])
        state.update((held,))

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, n int, n_flagged int", "held array<int>", "append", GroupStateTimeout.NoTimeout)


def runs(stream: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Closed runs of equal labels per key: label, first and last order, number of rows. The open run is kept as state."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        here = tuple(state.get) if state.exists else None
        out = []
        for part in parts:
            part = part.sort_values(order, kind="stable")
            for o, v in zip(part[order], part[label]):
                if here is not None and here[0] == v:
                    here = (v, here[1], o, here[3] + 1)
                else:
                    if here is not None:
                        out.append((k[0], *here))
                    here = (v, o, o, 1)
        if here is not None:
            state.update(here)
        yield pd.DataFrame(out, columns=[key, label, "first", "last", "n"])

    schema = f"{label} {kinds[label]}, first {kinds[order]}, last {kinds[order]}, n bigint"
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {schema}", schema, "append", GroupStateTimeout.NoTimeout)
