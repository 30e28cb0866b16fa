"""What the operators share: tables, shared folders, Arrow columns as flat bytes."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows with a null id are kept; inside an operator they carry this id, the smallest.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset and all runs in this process one is made
    and set; on a cluster a folder of this machine would lose data, so there it must be set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="regionlake-checkpoint-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage that is used no more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared folder, so that a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, whatever their working folder is."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.join(root, "regionlake")
    out = os.path.join(tempfile.mkdtemp(prefix="regionlake-code-"), "regionlake_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, root))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_GIVEN_BACK = 0.0


def give_back(at_once: bool) -> None:
    """Memory that this process has freed goes back to the system; unless at_once, once a second at most."""
    global _GIVEN_BACK
    if not at_once and time.monotonic() < _GIVEN_BACK + 1:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass
    _GIVEN_BACK = time.monotonic()


def frugal(run: Callable) -> Callable:
    """run, for mapInArrow or applyInArrow; what it frees goes back to the system while it runs and at its end.

    Workers outlive their tasks, and idle ones share the executor's memory with the tasks of later stages.
    """
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                for batch in run(batches):
                    yield batch
                    del batch
                    give_back(False)
            finally:
                give_back(True)

        return tidy

    if len(inspect.signature(run).parameters) == 1:

        @functools.wraps(run)
        def tidy(t: pa.Table) -> pa.Table:
            out = run(t)
            give_back(t.nbytes >= 1 << 20)
            return out

    else:

        @functools.wraps(run)
        def tidy(a: tuple | pa.Table, b: pa.Table) -> pa.Table:
            out = run(a, b)
            give_back(sum(t.nbytes for t in (a, b) if isinstance(t, pa.Table)) >= 1 << 20)
            return out

    return tidy


def slim(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Only the wanted columns: whatever else a table has, however named, cannot clash."""
    return df.select(F.col(key).cast("long").alias(key), *[F.col(c) for c in columns])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's bounds in them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NULL_ID).cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)


def back(values: np.ndarray) -> pa.Array:
    """Ids as an Arrow column, NULL_ID as null again."""
    values = np.asarray(values, np.int64)
    return pa.array(values, pa.int64(), mask=values == NULL_ID)


def groups(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose bytes together stay near limit; a longer row is alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
