"""Where streams go: the console, memory, files, a snapshot that follows a changelog, and a log of rates."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.changelog import materialize

log = logging.getLogger("driftline")


def to_console(df: DataFrame, name: str) -> StreamingQuery:
    return df.writeStream.format("console").queryName(name).outputMode("update").start()


def print_rows(df: DataFrame, label: str, n: int = 20) -> None:
    """The first rows of a batch relation, with a label."""
    print(f"{label}:")
    df.show(n, truncate=False)


def counted(df: DataFrame, label: str, *more: Column) -> tuple[DataFrame, Observation]:
    """df, and what is observed when it is read: rows and more; the batch form of RateLog."""
    seen = Observation(label)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen


def to_memory(df: DataFrame, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_batches(df: DataFrame, path: str, checkpoint: str, once: bool = True, mode: str = "update") -> StreamingQuery:
    """Each micro-batch's rows as Parquet with their batch number; a batch that is repeated replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def snapshot(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What the changes under path lead to."""
    return materialize(spark.read.parquet(path), key, order)


class RateLog(StreamingQueryListener):
    """Logs rows a second of each query, recent and since the start, every so many rows."""

    def __init__(self, interval: int = 100_000):
        super().__init__()
        self.interval, self.rows, self.seconds, self.logged = interval, {}, {}, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[p.id] = self.rows.get(p.id, 0) + p.numInputRows
        self.seconds[p.id] = self.seconds.get(p.id, 0) + p.batchDuration / 1000
        if self.rows[p.id] - self.logged.get(p.id, 0) >= self.interval:
            self.logged[p.id] = self.rows[p.id]
            log.info("%s: %.0f rows/s recently, %.0f rows/s overall", p.name or p.id, p.processedRowsPerSecond, self.rows[p.id] / max(self.seconds[p.id], 1e-3))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
