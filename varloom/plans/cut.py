"""Lineage cuts that survive the loss of executors.

A cut is a table written into the shared folder named by ``spark.checkpoint.dir``. Where that setting is
absent a local folder takes its place if all tasks run in this one process; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folder of each application met, so that its cuts can be deleted at exit.
_FOLDERS: dict[str, str] = {}


def root_of(where: str | None, master: str) -> str:
    """The shared folder, or one of this machine for a local master without it."""
    if where:
        return where.rstrip("/")
    if master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="varloom-")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder for cuts below the shared folder that the session names."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{root_of(spark.conf.get('spark.checkpoint.dir', None), spark.sparkContext.master)}/varloom-{app}"
        atexit.register(_delete, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once and return it as read from the written table (columnar, no lineage)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._varloom_path = path
    return out


#: Tables that several queries of a session begin with, by what they were made from.
_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A cut that is written once per session as long as the files of the folder ``source`` stay as they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, name, source, state)
    if key not in _KEPT:
        _KEPT[key] = cut(build())
    return _KEPT[key]


def forget() -> None:
    """Deletes the tables that ``kept`` holds, so that the next query makes its own."""
    for df in _KEPT.values():
        drop(df)
    _KEPT.clear()


def drop(df: DataFrame | None) -> None:
    """Delete the table behind a cut that nothing reads any more."""
    path = getattr(df, "_varloom_path", None)
    if path is not None:
        _delete(df.sparkSession, path)
