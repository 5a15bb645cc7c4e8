"""What the operators of this subpackage share: reading tables, the shared folder, text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D], as the contracts of this subpackage use it.
WS = " \t\n\x0b\f\r"
#: The same as a Java regular expression.
WS_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LONG = (1 << 63) - 1

#: Texts handed to a Python kernel at once, in characters; a longer text comes alone and whole.
SLICE_CHARS = 2_000_000
#: Bytes in one Arrow batch to a Python worker, which ends with the row that reaches them, whole. Executor and worker both hold a batch, the
#: executor with room to grow, so that Spark's 64 MB for each of its tasks cost several hundred MB.
BATCH_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: str, name: str, body: str) -> str:
    """SQL text that evaluates `value` once, binds it to `name` and returns `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sql_string(text: str) -> str:
    """`text` as a Spark SQL literal."""
    return "'" + "".join(f"\\u{ord(c):04x}" if c < " " or c in "'\\" else c for c in text) + "'"


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, other letters untouched. Pure ASCII strings take the engine's quick lower()."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def word_count(col: Column) -> Column:
    """Runs of anything but ASCII white space; null counts as 0."""
    trimmed = F.btrim(F.coalesce(col, F.lit("")), F.lit(WS))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, WS_RE, -1))).cast("long")


# ---------------------------------------------------------------- the shared folder


_made: set[str] = set()


def _remove_all(spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        for p in list(_made):
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session is gone at exit; the cluster's own cleaning takes over
        pass


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local mode only) a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="crosscut-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; removed when the program ends."""
    if not _made:
        atexit.register(_remove_all, spark)
    path = f"{shared_root(spark)}/crosscut/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path of shared_path before the program ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made.discard(path)


def settle(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or a bare path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def put_file(uri: str, name: str, parts: Iterable) -> None:
    """Write byte blocks, taken one by one, as uri/name, seen whole or not at all: retried tasks replace the same content."""
    if (base := local_path(uri)) is not None:
        os.makedirs(base, exist_ok=True)
        tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            for p in parts:
                f.write(p)
        os.replace(tmp, f"{base}/{name}")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        for p in parts:
            f.write(p)
    store.move(tmp, f"{base}/{name}")


def mapped_file(uri: str, name: str, dtype: str):
    """uri/name as a read-only memory map; from a remote store it is copied to a temporary file first."""
    if (base := local_path(uri)) is not None:
        path = f"{base}/{name}"
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as local, store.open_input_stream(f"{base}/{name}") as f:
        while block := f.read(1 << 22):
            local.write(block)
        size = local.tell()
        return np.memmap(local, dtype=dtype, mode="r") if size else np.zeros(0, dtype)


# ---------------------------------------------------------------- Python kernels over texts


def text_slices(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of an Arrow string column, null as '', cut between rows at about `limit` characters."""
    start, total, texts = 0, 0, []
    for i, x in enumerate(column):
        text = x.as_py() or ""
        if texts and total + len(text) > limit:
            yield start, texts
            start, total, texts = i, 0, []
        texts.append(text)
        total += len(text)
    if texts:
        yield start, texts


def arrow_slices(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """column cut between rows at about `limit` bytes; a longer text comes alone and whole."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        end = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + limit, side="right"))
        end = max(end, start + 1)
        yield column.slice(start, end - start)
        start = end


def numbered_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    start = 0
    for part in arrow_slices(column, limit):
        yield start, part
        start += len(part)


_kernels: dict[tuple, Any] = {}


def worker_kernel(key: tuple, make: Callable[[], Any]) -> Any:
    """make()'s result, kept for all tasks that this worker runs, until another key is asked for: workers outlive a query,
    and what one operator holds would stand beside the next one's."""
    if key not in _kernels:
        _kernels.clear()
        give_back()
        _kernels[key] = make()
    return _kernels[key]


def give_back() -> None:
    """Freed memory goes back to the system, where the allocators would keep it for this worker's next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit; it counts when a plan runs, and so stays. A lower one is left as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], dict]], fields: str, keep: list[str], text: str = "text", limit: int = SLICE_CHARS, arrow: bool = False) -> DataFrame:
    """`keep` columns of df beside what the kernel returns for its texts, a list of strings or (arrow) an Arrow array. make() builds the kernel once in each worker
    task; fields is its schema as DDL. Rows stream in Arrow batches; memory is bounded by a batch and a slice (or one text).
    A text among `keep` is sent once for both. The session's limit of bytes in a batch is lowered to BATCH_BYTES."""
    spark = df.sparkSession
    small_batches(spark)
    added = spark.createDataFrame([], fields).schema
    base = df.select(*keep) if text in keep else df.select(*keep, F.col(text).alias("__text"))
    at = keep.index(text) if text in keep else len(keep)
    kept = len(keep)
    schema = type(added)(base.select(*keep).schema.fields + added.fields)
    names = added.names

    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches):
        kernel = make()
        try:
            for batch in batches:
                column = batch.column(at)
                for start, texts in numbered_slices(column, limit) if arrow else text_slices(column, limit):
                    got = kernel(texts)
                    arrays = [batch.column(i).slice(start, len(texts)) for i in range(kept)]
                    arrays += [pa.array(got[n], type=out.field(n).type) for n in names]
                    yield pa.RecordBatch.from_arrays(
                        [a.cast(out.field(i).type) if a.type != out.field(i).type else a for i, a in enumerate(arrays)], schema=out
                    )
        finally:
            batch = column = texts = got = arrays = None
            give_back()

    return base.mapInArrow(run, schema)
