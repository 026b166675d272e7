"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

Long texts are first split at safe boundaries, which every text has between a character that isn't white space and
one that is: no match of the pattern spans one, and no alternative looks behind. So the pieces' ids joined are the
whole text's ids, and pieces that come again are taken from a bounded cache. Null and empty texts give no ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: The Unicode White_Space characters, which are what \s matches in the pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
CACHE = 300_000
#: Longer pieces aren't cached.
CACHED_LENGTH = 64


class Codec:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers, and back."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in ranks.items()}
        codec = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = codec.encoding.encode_to_numpy(piece, disallowed_special=()).astype("<u4").tobytes()
                if len(piece) <= CACHED_LENGTH:
                    if len(self) >= CACHE:
                        self.clear()
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, SAFE.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes: ids may end inside a character."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """Made once in each worker process."""
    return Codec(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (binary, little-endian unsigned 32 bit) of every row; null is as the empty text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [codec(ranks_path, pattern).encode(x or "") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    kind = dict(df.dtypes)[id_col]
    return map_slices(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, n_tokens long, ids binary")


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, bytes of every row's ids; null is as no ids."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [codec(ranks_path, pattern).decode(x or b"") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    kind = dict(df.dtypes)[id_col]
    return map_slices(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), work, f"id {kind}, bytes binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids and of the bytes decoded from them, in one pass."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, counts, of_ids, of_bytes = codec(ranks_path, pattern), [], [], []
        for text in batch.column(1).to_pylist():
            ids = c.encode(text or "")
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[id_col]
    return map_slices(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
