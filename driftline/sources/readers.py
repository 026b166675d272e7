"""Sources: tables, collections, sequences, streams of files and of ticks, and chains of sources."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changelog import concatenated


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def collection(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sequence(spark: SparkSession, n: int, name: str = "number") -> DataFrame:
    """1 to n."""
    return spark.range(1, n + 1).withColumnRenamed("id", name)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def files(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = 1, format: str = "parquet") -> DataFrame:
    """A stream of files in the order of their times, so many a micro-batch (None: all there are)."""
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """tick: 0, 1, 2 and so on as time goes by."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("tick"))


def bounded(stream_writer):
    """A writer that reads what there is and then ends: the first part of a relation, before its live part."""
    return stream_writer.trigger(availableNow=True)


def started_after(first: list[StreamingQuery], start: Callable[[], StreamingQuery], timeout: float | None = None) -> StreamingQuery:
    """Starts a query of facts once the given queries, of what the facts refer to, have ended; bounded() makes these end."""
    for query in first:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"{query.name or query.id} is still running")
    return start()


@dataclass(frozen=True)
class Chain:
    """Sources one after another, with waits between: start(), then(), delay(), and at the end batch() or play() and stream()."""

    spark: SparkSession
    schema: str
    parts: tuple[DataFrame | float, ...] = field(default=())

    def then(self, part: DataFrame | list) -> Chain:
        part = part if isinstance(part, DataFrame) else collection(self.spark, part, self.schema)
        return Chain(self.spark, self.schema, (*self.parts, part))

    def delay(self, seconds: float) -> Chain:
        return Chain(self.spark, self.schema, (*self.parts, float(seconds)))

    def batch(self) -> DataFrame:
        """All rows, with seq, the number of their part; waits count for nothing."""
        rows = [x for x in self.parts if isinstance(x, DataFrame)]
        return concatenated(*rows) if rows else empty(self.spark, f"{self.schema}, seq int")

    def play(self, folder: str) -> None:
        """Puts one part after another, and after its wait, into the folder that a stream of files reads. For tests and demonstrations."""
        for part in self.parts:
            if isinstance(part, DataFrame):
                part.coalesce(1).write.mode("append").parquet(folder)
            else:
                time.sleep(part)

    def stream(self, folder: str) -> DataFrame:
        """The folder as a stream, a part a micro-batch; it may be read while the chain plays."""
        empty(self.spark, self.schema).write.mode("append").parquet(folder)
        return files(self.spark, folder, self.schema)


def start(spark: SparkSession, schema: str) -> Chain:
    """A chain of no rows yet."""
    return Chain(spark, schema)
