"""What several operators need: shared storage, bounded text batches, joins that stand hot keys."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow slice that is turned into Python strings at a time; a longer text is a slice by itself.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 21
#: While a table is stored: few rows go to a Python worker at a time, as the JVM and the worker each hold several such
#: batches, and small partitions are put together, as each becomes a file.
WHILE_STORED = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
#: About what a task of a table of a known size makes.
TASK_BYTES = 8 << 20
#: A key is hot when it holds at least one in HOT_SHARE rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder of spark.checkpoint.dir; only a local master may do without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="driftline-")
    return f"{base.rstrip('/')}/driftline-{uuid.uuid4().hex}"


_writers, _lock = {}, threading.Lock()


@contextlib.contextmanager
def settings_while_stored(spark: SparkSession) -> Iterator[None]:
    """WHILE_STORED holds in the session until the last of its threads that store tables is done."""
    with _lock:
        count, before = _writers.get(id(spark), (0, None))
        _writers[id(spark)] = count + 1, before or {key: spark.conf.get(key) for key in WHILE_STORED}
        for key, value in WHILE_STORED.items():
            spark.conf.set(key, value)
    try:
        yield
    finally:
        with _lock:
            count, before = _writers.pop(id(spark))
            if count > 1:
                _writers[id(spark)] = count - 1, before
            else:
                for key, value in before.items():
                    spark.conf.set(key, value)


def stored(df: DataFrame, rows: int | None = None, row_bytes: int = 40) -> DataFrame:
    """df written to shared storage and read again: later jobs neither repeat its work nor depend on executors that did it.

    rows: if known, a bound of df's rows, of which each takes about row_bytes to make; then a small table is made by few
    tasks and kept in few files, however many partitions shuffles have.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    if rows is not None:
        df = df.coalesce(rows * row_bytes // TASK_BYTES + 1)
    with settings_while_stored(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these frames, which nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
        to = min(max(to, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def with_small_offsets(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts and binaries with offsets of 32 bits, which the operators read, whatever the session's Arrow settings are."""
    kinds = {pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}
    columns = [c.cast(kinds[c.type]) if c.type in kinds else c for c in batch.columns]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow in slices of at most SLICE_ROWS rows and about SLICE_BYTES, so that a worker holds few Python objects at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(with_small_offsets(batch)):
                out = work(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def join_grouped(left: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with groups (one row a key, size: the key's number of rows on the left, of total rows).

    Keys with at least total / HOT_SHARE rows, of which there can't be more than HOT_SHARE, are broadcast, so no
    task gets all rows of a hot key; the other keys are joined by a shuffle.
    """
    least = max(1.0, total / HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(size) >= least))
    warm = left.join(F.broadcast(groups.filter(F.col(size) >= least).select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(warm.join(groups.filter(F.col(size) < least), key, how), allowMissingColumns=True)
