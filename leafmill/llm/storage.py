"""Shared working storage: tables and files that every executor and the driver can see.

The folder is the cluster's ``spark.checkpoint.dir``. Only where that setting
is missing and the master is local (tests) a folder of our own is made and set.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from leafmill.session import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path, without a trailing slash."""
    return shared_folder(spark)


#: Rows and bytes of a batch that is handed to Python: texts may be long, and executors have little memory beside the heap.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """(key, other columns) of each run of rows with equal leading columns, over batch bounds; rows do not become objects."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def columns() -> list[pa.Array]:
        return [pa.concat_arrays([p.column(k) for p in held]) for k in range(keys, held[0].num_columns)]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        new[0] = True
        for c in batch.columns[:keys]:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            key = tuple(c[a].as_py() for c in batch.columns[:keys])
            if held and key != last:
                yield last, columns()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, columns()


def packed(column: pa.Array, dtype: str) -> np.ndarray:
    """All bytes of a binary column as one array of numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(dtype)


_held: tuple[object, Callable[[], None]] | None = None


def claim(owner: object, clear: Callable[[], None]) -> None:
    """Called by a Python worker's task before it uses a cache: workers outlive stages, so another operator's cache is
    cleared and its memory given back."""
    global _held
    if _held is not None and _held[0] is not owner:
        _held[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the memory for later
            ctypes.CDLL(None).malloc_trim(0)
    _held = (owner, clear)


class Scratch:
    """Tables written to the shared folder, to cut lineage; drop() frees what is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/leafmill/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._made: list[str] = []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: a lost executor costs a reread, not a recomputation."""
        path = self.path(name)
        df.write.option("parquet.block.size", 32 << 20).parquet(path)  # less of a row group is held while it is written
        back = self.spark.read.schema(df.schema).parquet(path)
        back._leafmill_path = path
        self._made.append(path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, df._leafmill_path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but those that a result is still read from."""
        wanted = {df._leafmill_path for df in tables}
        for path in self._made:
            if path not in wanted:
                delete(self.spark, path)
        self._made = sorted(wanted)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mkdirs(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def local_path(uri: str) -> str | None:
    """The path of a file URI (also a shared mount); None for a store that needs a client."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def arrow_fs(uri: str):
    """(file system, path) of a URI, for stores other than a mounted folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
