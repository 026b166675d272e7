"""Exact top-k search by inner product of integer vectors, block at a time.

Vectors are sorted by id and cut into blocks of an id range. A block has a forward index (its vectors as a matrix) and,
for each dimension, the largest and smallest component. The sum over a query's dimensions of the larger product with
these bounds every score in the block. For each query blocks are taken by falling bound, and scored until the bound
falls below the k-th score so far (a block whose bound equals it may hold a tie with a smaller id).

Queries and vectors meet in a grid of query chunks and vector parts, each of a bounded number of rows; a cell gives at
most k rows a query, and the cells' results are merged by rank. Vectors that are null, or hold null or non-finite
components, and rows without an id take no part; missing components count as zero; repeated rows are candidates each,
but rows with the query's own id never are, and of rows that repeat a query's id the smallest vector asks. Ties go to
the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK_ROWS = 512
PART_ROWS = 32_768
CHUNK_ROWS = 4096


def integer_vector(v: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix, filled up with zeros."""
    rows = [np.asarray(x, np.int64) for x in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for to, row in zip(out, rows, strict=True):
        to[: len(row)] = row
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[-1] == width else np.concatenate([m, np.zeros((*m.shape[:-1], width - m.shape[-1]), m.dtype)], -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: by floating point only where no sum can leave its whole numbers."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a @ b.T


class Part:
    """Blocks of vectors in order of their ids."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]]):
        self.width = max((m.shape[1] for _, m in blocks), default=0)
        self.blocks = [(ids, widened(m, self.width)) for ids, m in sorted(blocks, key=lambda b: b[0][0])]
        self.scored = 0  # blocks that were scored, counted once for each query

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, vector id and score of each query's k best here."""
        width = max(self.width, queries.shape[1])
        queries, blocks = widened(queries, width), [(ids, widened(m, width)) for ids, m in self.blocks]
        largest, smallest = (np.stack([f(m, 0) for _, m in blocks]) for f in (np.max, np.min))
        bounds = products(np.maximum(queries, 0), largest) + products(np.minimum(queries, 0), smallest)
        order = np.argsort(-bounds, 1, kind="stable")
        none = np.iinfo(np.int64).min
        scores, found = np.full((len(queries), k), none), np.zeros((len(queries), k), np.int64)
        alive = np.arange(len(queries))
        for step in range(len(blocks)):
            block_of = order[alive, step]
            alive = alive[fine := bounds[alive, block_of] >= scores[alive, k - 1]]
            block_of = block_of[fine]
            if not len(alive):
                break
            for b in np.unique(block_of):
                rows, (ids, vectors) = alive[block_of == b], blocks[b]
                self.scored += len(rows)
                own = products(queries[rows], vectors)
                own[ids[None, :] == query_ids[rows, None]] = none
                all_scores, all_ids = np.concatenate([scores[rows], own], 1), np.concatenate([found[rows], np.broadcast_to(ids, own.shape)], 1)
                least = np.partition(all_scores, -k, 1)[:, -k]  # only what reaches the k-th score needs sorting
                wanted = min(all_scores.shape[1], int((all_scores >= least[:, None]).sum(1).max()))
                if wanted < all_scores.shape[1]:
                    pick = np.argsort(all_scores < least[:, None], 1, kind="stable")[:, :wanted]
                    all_scores, all_ids = np.take_along_axis(all_scores, pick, 1), np.take_along_axis(all_ids, pick, 1)
                best = np.lexsort((all_ids, -np.maximum(all_scores, none + 1)), axis=1)[:, :k]
                scores[rows], found[rows] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
        real = scores > none
        return np.repeat(query_ids, real.sum(1)), found[real], scores[real]


def as_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) in order of id as rows (ids, width, vectors)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            m = matrix(part.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([m.shape[1]]), pa.array([m.astype("<i8").tobytes() if m.size and np.abs(m).max() > 32767 else m.astype("<i2").tobytes()], pa.binary())], ["ids", "width", "vectors"])


def unpacked(ids: bytes, width: int, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(ids, "<i8")
    return n, np.frombuffer(vectors, "<i2" if len(vectors) == 2 * width * len(n) else "<i8").reshape(len(n), width).astype(np.int64)


def search(vectors: DataFrame, is_query: Column, k: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best other rows for each row that is a query."""
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vector_col), scale).alias("v"), is_query.alias("query")).filter("v IS NOT NULL")
    rows = stored(rows)
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("query")).first()
    parts, chunks = -(-n // PART_ROWS) or 1, -(-asked // CHUNK_ROWS) or 1
    cells = 4 * parts  # finer than parts: ranges are cut by a sample
    blocks = rows.repartitionByRange(cells, "id").sortWithinPartitions("id").select("id", "v").mapInArrow(as_blocks, "ids binary, width long, vectors binary")
    # part by the place of the block, not by the task that made it
    blocks = stored(blocks).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts))).select("part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "ids", "width", "vectors")
    asking = rows.filter("query").groupBy("id").agg(F.min("v").alias("v"))
    queries = asking.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "chunk", "id", "v").withColumn("part", F.col("part").cast("long"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            part = Part([unpacked(*x) for x in zip(left["ids"].to_pylist(), left["width"].to_pylist(), left["vectors"].to_pylist(), strict=True)])
            out = part.search(right["id"].to_numpy(), matrix(right["v"]), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out), strict=True)))

    found = blocks.groupBy("chunk", "part").cogroup(queries.groupBy("chunk", "part")).applyInArrow(cell, "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
