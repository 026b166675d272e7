"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

A text's UTF-8 bytes are cut into chunks that overlap by one filter's width, so every window of the whole text is seen.
Learned byte vectors and filters give each window its features; each feature's maximum is kept for each chunk, and
the chunks' mean and maximum are combined into one probability. Nothing but the text goes into a score.

Labels come from a bounded sample of rows (max_rows, in the order of a hash of the id) whose ids aren't held out;
training and scoring cover every chunk of every text. Null is as the empty text, which is one chunk of zeros; if no
label is usable, every score is one half.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, stored

VECTOR, WIDTH, STRIDE, FILTERS, CHUNK = 6, 8, 1, 24, 256
STEP = CHUNK - WIDTH
#: Chunks that are worked on at a time.
BLOCK = 256
HELD_OUT_OF, HELD_OUT = 4, 2
#: Bytes of texts that training takes from Spark at a time; and of a text, about, which decides how many tasks gather them.
PART_BYTES, TEXT_BYTES = 16 << 20, 32 << 10


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == HELD_OUT


def chunk_starts(size: int) -> np.ndarray:
    return np.arange(max(1, -(-(size - WIDTH) // STEP))) * STEP


def chunks_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunks of data from starts, zero from ends on."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    return np.where(inside, data[np.where(inside, at, 0)], 0) if len(data) else np.zeros(at.shape, np.uint8)


def windows(vectors: np.ndarray) -> np.ndarray:
    """Windows as rows, for chunks of byte vectors."""
    n = len(vectors)
    flat = vectors.reshape(n, CHUNK * VECTOR)
    shape, strides = (n, (CHUNK - WIDTH) // STRIDE + 1, WIDTH * VECTOR), (flat.strides[0], STRIDE * VECTOR * flat.itemsize, flat.itemsize)
    return np.lib.stride_tricks.as_strided(flat, shape, strides)


class Network:
    """Weights; pooled() are features of chunks, logit() combines a text's."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.weights = {
            "bytes": r.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
            "filters": r.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "base": np.zeros(1, np.float32),
        }

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest feature of each chunk, and the window that has it."""
        w = self.weights
        x = windows(w["bytes"][chunks])
        z = (x.reshape(-1, WIDTH * VECTOR) @ w["filters"]).reshape(len(chunks), -1, FILTERS)
        best = z.argmax(1)
        return np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0] + w["bias"], 0), best

    def probability(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        logit = np.concatenate([mean, most], 1) @ self.weights["out"] + self.weights["base"]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logarithmic loss of whole texts, in blocks of their chunks."""
        w = self.weights
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        begins, own = ends - [len(t) for t in texts], [chunk_starts(len(t)) for t in texts]
        n = np.array([len(x) for x in own])
        first, text, starts = np.cumsum(n) - n, np.repeat(np.arange(len(texts)), n), np.concatenate(own)
        blocks = [slice(at, at + BLOCK) for at in range(0, len(text), BLOCK)]

        def chunks(block: slice) -> np.ndarray:
            return chunks_at(data, begins[text[block]] + starts[block], ends[text[block]])

        pooled = [self.pooled(chunks(block)) for block in blocks]
        h, best = (np.concatenate(x) for x in zip(*pooled, strict=True))
        mean, most = np.add.reduceat(h, first) / n[:, None], np.maximum.reduceat(h, first)
        d = ((self.probability(mean, most) - labels) / len(labels)).astype(np.float32)
        dh = d[text, None] * (w["out"][:FILTERS] / n[text, None] + w["out"][FILTERS:] * (h == most[text])) * (h > 0)
        out = {k: np.zeros_like(v) for k, v in w.items()}
        out["out"], out["base"], out["bias"] = np.concatenate([d @ mean, d @ most]), d.sum(keepdims=True), dh.sum(0)
        for block in blocks:
            seen = np.take_along_axis(chunks(block)[:, None], best[block][:, :, None] * STRIDE + np.arange(WIDTH), 2)  # bytes of the best windows
            x = w["bytes"][seen].reshape(len(seen), FILTERS, WIDTH * VECTOR)
            dx = (dh[block][:, :, None] * w["filters"].T[None]).reshape(-1, VECTOR)
            out["filters"] += np.einsum("nf,nfk->kf", dh[block], x)
            out["bytes"] += np.stack([np.bincount(seen.ravel(), dx[:, i], 256) for i in range(VECTOR)], 1).astype(np.float32)
        return out


def train(sample: DataFrame, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network | None:
    """sample: doc_id, data (bytes) and quality of each text, stored. Adam, with the rate falling to zero.

    Each epoch reads the sample again in another order, in parts of about PART_BYTES, so the driver holds but a part of it.
    """
    n, good, size = sample.agg(F.count(F.lit(1)), F.sum("quality"), F.sum(F.octet_length("data"))).first()
    if not n:
        return None
    parts = size // PART_BYTES + 1
    network, share, step, steps = Network(seed), np.clip(good / n, 0.01, 0.99), 0, epochs * -(-n // batch)
    network.weights["base"][:] = np.log(share / (1 - share))
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.weights.items()}
    for epoch in range(epochs):
        order = F.xxhash64("doc_id", F.lit(seed), F.lit(epoch))
        mixed = sample.repartition(parts, F.pmod(order, F.lit(parts))) if parts > 1 else sample.coalesce(1)
        rows = mixed.sortWithinPartitions(order, "doc_id").toLocalIterator()
        while own := list(itertools.islice(rows, batch)):
            found = network.gradients([bytes(x.data) for x in own], np.array([x.quality for x in own], np.float32))
            step += 1
            for k, g in found.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.weights[k] -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return network


def sample_texts(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, data (the whole text's bytes) and quality of at most max_rows labelled rows whose ids aren't held out; stored.

    Of rows that repeat an id, the smallest text and the smallest label count.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return stored(rows.groupBy("doc_id").agg(F.min("text").cast("binary").alias("data"), F.first("quality").alias("quality")), max_rows, TEXT_BYTES)


def score_batch(network: Network | None, texts: pa.Array) -> np.ndarray:
    """Probabilities of texts; every chunk of each counts."""
    if network is None or not len(texts):
        return np.full(len(texts), 0.5)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets) * np.asarray(texts.is_valid())
    number = np.maximum(1, -(-(sizes - WIDTH) // STEP))
    first = np.concatenate([[0], np.cumsum(number)])
    total, most = np.zeros((len(texts), FILTERS), np.float32), np.zeros((len(texts), FILTERS), np.float32)
    for at in range(0, first[-1], BLOCK):
        chunk = np.arange(at, min(at + BLOCK, first[-1]))
        text = np.searchsorted(first, chunk, "right") - 1
        starts = offsets[text] + (chunk - first[text]) * STEP
        h, _ = network.pooled(chunks_at(data, starts, offsets[text] + sizes[text]))
        own, begins = np.unique(text, return_index=True)
        total[own] += np.add.reduceat(h, begins)
        most[own] = np.maximum(most[own], np.maximum.reduceat(h, begins))
    return network.probability(total / number[:, None], most)


def score(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_batch(network, batch.column(1)))], ["id", "score"])

    kind = dict(docs.dtypes)[id_col]
    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, score double")


def keep_good(docs: DataFrame, network: Network | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is at least least."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        parts = [score_batch(network, pa.array(texts.iloc[at : at + 256], pa.string())) for at in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(scored(F.coalesce(F.col(text_col), F.lit(""))) >= least)
