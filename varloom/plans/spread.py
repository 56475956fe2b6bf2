"""Work per row spread over all cores when the table comes in too few parts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """``scan`` in no fewer partitions than the session has cores.

    For a scan (no shuffle below it) ahead of work that takes far longer than moving its rows. A table of many
    row groups passes as it is; one of few is dealt out. Rows are the same either way.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
