"""Tables written once and read back: a plan's lineage ends there, and later plans scan what is written."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_made: set[str] = set()
_kept: dict[tuple, Any] = {}


def _path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession) -> None:
    try:
        for uri in _made:
            path, store = _path(spark, uri)
            store.delete(path, True)
    except Exception:  # noqa: BLE001 - the session is gone at exit; the cluster's own cleaning takes over
        pass


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local mode only) a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = "file://" + tempfile.mkdtemp(prefix="crosscut-")
            _made.add(_folders[app])
        root = _folders[app]
    return root.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    if not _made:
        atexit.register(_remove, spark)
    uri = f"{folder(spark)}/crosscut/{name}-{uuid.uuid4().hex}"
    _made.add(uri)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def settled_and_released(df: DataFrame, name: str) -> DataFrame:
    """settled(), and the shuffles of df's plan are let go: Spark removes them once the JVM has seen that nothing refers to them."""
    kept = settled(df, name)
    del df
    gc.collect()
    kept.sparkSession.sparkContext._jvm.System.gc()
    return kept


def _stamp(spark: SparkSession, uri: str) -> tuple | None:
    path, store = _path(spark, uri)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in store.listStatus(path))) if store.exists(path) else None


def once(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], Any], keep: Callable[[Any, str], Any] = settled) -> Any:
    """make()'s table (or what keep makes of it), settled once in an application for as long as its input files stay as they are; anew each time
    where an input has no files of its own."""
    stamps = [_stamp(spark, i) for i in inputs]
    if None in stamps:
        return keep(make(), name)
    key = (spark.sparkContext.applicationId, name, *zip(inputs, stamps))
    if key not in _kept:
        _kept[key] = keep(make(), name)
    return _kept[key]
