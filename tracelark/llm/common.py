"""Helpers shared by the training-data operators: table access, durable cuts of the lineage, Arrow text access."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts, as a Java/Python character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


#: Rows of an Arrow batch: texts run to many kilobytes, and a task holds several copies of a batch on either side.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches at BATCH_ROWS rows or fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a folder of our own only where none is set and all runs in one process, as in tests."""
    small_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-checkpoint-"))  # one process: any folder is shared
    return sc.getCheckpointDir()


#: Folders of the tables that were written within each open scope.
_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again: a cut of the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Deletes tables that ``materialize`` wrote, or their folders: for those whose every reader has been written itself."""
    for x in tables:
        spark = spark if isinstance(x, str) else x.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x._folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(folders: list[str]) -> Iterator[None]:
    """Notes in ``folders`` where ``materialize`` writes meanwhile, so that the tables can go when what was made of them has been written."""
    _SCOPES.append(folders)
    try:
        yield
    finally:
        _SCOPES.pop()


def release(spark: SparkSession) -> None:
    """Lets the driver notice shuffles that no DataFrame needs any more: their files go now, not at its next full collection."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_count(text: Column) -> Column:
    """Number of words of the contracts; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no label may be learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def utf8_slices(column, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """An Arrow string array as (first row, bytes, offsets) in slices of whole rows of about ``most`` bytes.

    A null row is an empty run of bytes. A row longer than ``most`` is a slice of its own.
    """
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, n)
        own = offsets[at : to + 1]
        if not valid[at:to].all():  # a null may own bytes in a sliced buffer: drop them
            sizes = np.where(valid[at:to], np.diff(own), 0)
            parts = [data[own[i] : own[i + 1]] for i in range(to - at) if valid[at + i]]
            yield at, np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        else:
            yield at, data[own[0] : own[-1]], own - own[0]
        at = to
