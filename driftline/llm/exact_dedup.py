"""Exact deduplication against a persistent index of text digests.

The index is a table bucketed and sorted by digest. A batch is reduced to one row a digest before anything is
shuffled, the digests the index lacks are found by a sort-merge anti-join (whose index side needs no exchange) and
appended in the same bucketing. DataFrame operations only.

Texts are equal when they are identical after each run of [\\x20\\x09-\\x0D] has become one space; null is as the empty
text. Rows without an id never stay if an equal one has an id. An empty batch changes nothing. Of equal texts, one that
the index has from an earlier batch stays, else the one with the smallest id in the batch; rows that repeat an id
stay or go together, and so do equal rows of which none has an id, as nothing tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_grouped, release, stored

#: How the name of the folder that holds an index's files ends, after the number of buckets.
FOLDER = "-buckets"


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


class DigestIndex:
    """Digests of all texts seen so far, each with the id of the row that stays; the files outlive the session.

    The number of buckets is part of the folder's name: an index that is opened again keeps the number it was made with.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        made = [int(x.removesuffix(FOLDER)) for x in found if x.endswith(FOLDER)]
        if made and buckets and buckets != made[0]:
            raise ValueError(f"the index has {made[0]} buckets, not {buckets}")
        self.buckets = made[0] if made else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        place = f"{path}/{self.buckets}{FOLDER}"
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(place))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Appends the batch's new digests; id, digest, keep_id, group_size (equal rows of the batch), kept for every row of the batch."""
        digests = stored(docs.select(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest")))
        groups = stored(digests.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("group_size")))
        new = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        new.select("digest", F.col("first_id").alias("keep_id")).repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        found = stored(groups.drop("first_id").join(self.rows().hint("merge"), "digest"))
        release(groups)
        joined = join_grouped(digests, found, "digest", "group_size", digests.count())
        return joined.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def dedup_in_batches(index: DigestIndex, batches: list[DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The batches one after another into one index; as add() for all rows, with group_size over all batches."""
    out = None
    for batch in batches:
        one = index.add(batch, id_col, text_col)
        out = one if out is None else out.unionByName(one)
    out = stored(out)
    sizes = stored(out.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")))
    return join_grouped(out.drop("group_size"), sizes, "digest", "group_size", out.count()).select("id", "digest", "keep_id", "group_size", "kept")


def halves(docs: DataFrame, id_col: str = "doc_id") -> list[DataFrame]:
    """Rows with ids up to about the middle one, and the rest with those that have none; so no later batch has a smaller id."""
    middle = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), 0.5, 1000)).first()[0]
    if middle is None:
        return [docs]
    early = F.coalesce(F.col(id_col) <= middle, F.lit(False))
    return [docs.filter(early), docs.filter(~early)]
