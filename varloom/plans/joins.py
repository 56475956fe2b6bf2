"""Joins against a side whose size decides the strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Most rows, and characters of all their values, of a side that is broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 32_000_000


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_chars: int = BROADCAST_CHARS) -> bool:
    """Whether a table that is cheap to read keeps both bounds."""
    width = F.lit(0)
    for c in df.columns:
        width = width + F.coalesce(F.length(F.col(c).cast("string")), F.lit(0))
    got = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("chars")).first()
    return got["n"] <= max_rows and got["chars"] <= max_chars


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
               max_broadcast_rows: int = BROADCAST_ROWS, salts: int = 16, max_broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Equi-join with ``right`` broadcast only when its rows and characters are counted to be few, else salted.

    ``right`` must be cheap to count (a cut or an aggregate). Beyond the bounds every
    right row is repeated ``salts`` times and left rows are spread over the salts, so that a key with
    a third of the left rows is shared by ``salts`` tasks. Null keys match nothing in either form.
    """
    if how not in ("left", "inner"):
        raise ValueError("sized_join supports left and inner joins")
    if small(right, max_broadcast_rows, max_broadcast_chars):
        return left.join(F.broadcast(right), on, how)
    salt = "__salt"
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    wide = right.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.withColumn(salt, spread).join(wide, [*on, salt], how).drop(salt)
