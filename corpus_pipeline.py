"""From raw documents to packed sequences: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. Rows that repeat an id stay or go together; rows without an id go through every stage. Null texts are as the
empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import common, exact_dedup, hyperminhash, packing, pii, quality, queries


def kept_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs whose id (null too) is kept."""
    ids = decisions.filter("kept").select(F.col("id").alias("kept_id"))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network doesn't reject; it learns from the labels of ids that aren't held out."""
    labels = queries.table(spark, sf_dir, "labels")
    network = quality.train(quality.sample_texts(docs, labels, queries.MAX_LABELLED))
    return docs if network is None else quality.keep_good(docs, network, queries.LEAST_QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    path = common.scratch(spark)
    index = exact_dedup.DigestIndex(spark, "digests_" + path.rpartition("-")[2], path)
    return kept_rows(docs, index.add(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, four fifths), the document with the smallest id."""
    return kept_rows(docs, hyperminhash.near_duplicates(docs, words=5, percent=80))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; n_chars follows."""
    return pii.mask_pii(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed."""
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), queries.SEQUENCE_TOKENS, queries.END_ID)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [("quality", good_quality), ("exact", exact_copies), ("near", near_copies), ("pii", personal_data), ("packing", sequences)]
#: The stages' models and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
