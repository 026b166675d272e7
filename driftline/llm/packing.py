"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous sweeps.

Documents are tokenised and cut into pieces of at most the capacity. Pieces of equal length are interchangeable, and so
are sequences with equal gaps; so both sides are held sorted by size as runs (a size and a range of ranks), of which
there are as many as sizes, however many documents there are. A sweep goes down the sorted piece lengths: each length's
successor among the gaps (the smallest that is no smaller) takes pieces, conflicts are resolved by rank (the i-th piece
goes to the i-th sequence of that gap), gaps are updated, and the sweep is repeated until no gap is left for the length;
what is left opens new sequences. Pieces find their places by the rank they have among those of their length, which
is counted in a distributed way: by shard, then within the shard.

Null is as the empty text; the end token makes every document at least one token long. Empty tables give no pieces.
Repeated rows are packed each. Rows may have null ids.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, stored

CACHE = 800_000
#: Characters of texts whose letter runs are looked up by themselves: ASCII and the precomposed letters of Latin-1.
LETTERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
SIMPLE = re.compile(r"[\x21-\x7e\xa1-\xff]*")
RUN = re.compile(rf"[{LETTERS}]+")
#: Bytes by kind: white space that parts words, letters, others that stand for themselves; lower case of the letters.
BYTES = np.arange(256, dtype=np.uint8)
SPACE, PLAIN = np.isin(BYTES, [9, 10, 32]), (BYTES >= 0x21) & (BYTES <= 0x7E)
UPPER = (BYTES >= 65) & (BYTES <= 90)
LETTER = UPPER | (BYTES >= 97) & (BYTES <= 122)
LOWER = np.where(UPPER, BYTES + 32, BYTES)
#: Bytes of a long text that are split at a time; a block ends between words.
BLOCK = 1 << 21
#: Pieces of one shard, and so of one task, about.
SHARD_ROWS = 500_000


def units(data: np.ndarray, starts: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """What is looked up of adjacent texts in UTF-8, and the number of each text's first unit.

    Units are runs of letters and runs of other characters, which bind the letters after their last apostrophe, in lower
    case. Words with special tokens or characters outside Latin-1 are left as they are, as one unit each.
    """
    before, after = np.append(np.uint8(0), data[:-1]), np.append(data[1:], np.uint8(0))
    two = (data == 0xC3) | (data == 0xC2) & (after >= 0xA1)  # first bytes of Latin-1's upper half
    letter_two = (data == 0xC3) & (after != 0x97) & (after != 0xB7) | (data == 0xC2) & ((after == 0xAA) | (after == 0xB5) | (after == 0xBA))
    space = SPACE[data]
    letter = LETTER[data] | letter_two | np.append(False, letter_two[:-1])
    odd = ~(space | PLAIN[data] | two | np.append(False, two[:-1])) | (data == ord("<")) & (after == ord("|"))
    low = LOWER[data] + np.uint8(32) * ((before == 0xC3) & (data <= 0x9E) & (data != 0x97))
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    word = ~space & (first[:-1] | SPACE[before])
    last_letter = np.append(False, letter[:-1])
    cut = np.where(letter, ~last_letter & (before != ord("'")), last_letter) & ~space
    if odd.any():
        number = np.cumsum(word) - 1
        whole = np.zeros(number[-1] + 1, bool)
        whole[number[odd]] = True
        whole = whole[number]
        low, cut = np.where(whole, data, low), cut & ~whole
    begin, kept = np.flatnonzero(word | cut), ~space
    offsets = np.append(np.cumsum(kept)[begin] - 1, kept.sum()).astype(np.int32)
    made = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(low[kept])])
    return made, np.searchsorted(begin, starts)


def blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """One text in parts that end after white space."""
    at = 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        while to < len(data) and not len(gap := np.flatnonzero(SPACE[data[to - BLOCK : to]])):
            to = min(to + BLOCK, len(data))
        end = to if to == len(data) else to - BLOCK + int(gap[-1]) + 1
        yield data[at:end]
        at = end


class Words:
    """Ids of texts by the tokenizers library, looked up by parts of words.

    The tokenizer drops white space and its merges stay inside runs of letters, so these can be encoded each by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)  # ids that end a run
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[bytes]) -> None:
        """Puts units into the cache; those of simple characters are encoded together, as one text."""
        runs, simple = [], []
        for unit, text in zip(new, b"\n".join(new).decode().split("\n"), strict=True):
            if RUN.fullmatch(text):
                runs.append(unit)
            elif "<|" in text or not SIMPLE.fullmatch(text):
                self.known[unit] = self.ids(text)
            else:
                simple.append(unit)
        for own, ended in ((runs, True), (simple, False)):
            for at in range(0, len(own), 2000):
                part = own[at : at + 2000]
                joined = b" ".join(part).decode()
                if ended:  # a run of letters ends with the only id in it that can end one
                    found = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0]
                    ids = np.array(found.ids, "<u4")
                    ends = np.append(0, np.flatnonzero(self.last[ids]) + 1)
                    assert len(ends) == len(part) + 1 and ends[-1] == len(ids)
                else:
                    found = self.tokenizer.encode(joined, add_special_tokens=False)
                    ids = np.array(found.ids, "<u4")
                    ends = np.searchsorted([start for start, _ in found.offsets], np.cumsum([0, *(len(unit.decode()) + 1 for unit in part)]))
                data, ends = ids.tobytes(), (4 * ends).tolist()
                self.known.update((unit, data[a:b]) for unit, a, b in zip(part, ends, ends[1:], strict=False))

    def block(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Ids of adjacent texts."""
        if not len(data):
            return [b""] * len(starts)
        made, first = units(data, starts)
        coded = made.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        if len(self.known) >= CACHE:
            self.known.clear()
        if new := [unit for unit in keys if unit not in self.known]:
            self.learn(new)
        found = pa.array([self.known[unit] for unit in keys], pa.binary()).take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1]
        ids = found.buffers()[2].to_pybytes() if len(found) else b""
        ends = ends[np.append(first, len(found))].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: pa.StringArray | list[str]) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(texts):
            return []
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        if len(texts) == 1:
            return [b"".join(self.block(part, np.zeros(1, np.int64))[0] for part in blocks(data))]
        return self.block(data, offsets[:-1] - offsets[0])


@functools.lru_cache(2)
def words(path: str) -> Words:
    """Made once in each worker process."""
    return Words(path)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if wanted, ids of every document's pieces."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, encoded = [], words(tokenizer_path).encode(batch.column(1))
        for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
            ids += end_id.to_bytes(4, "little")
            for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + capacity)]
                rows.append((doc, piece, start, len(own) // 4, zlib.crc32(own), own))
        made = list(zip(*rows, strict=True))
        columns = [pa.array(made[0], batch.schema.field(0).type), pa.array(made[1], pa.int32()), *(pa.array(x, pa.int64()) for x in made[2:5]), *[pa.array(made[5], pa.binary())] * keep_ids]
        return pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    kind = dict(df.dtypes)[id_col]
    return map_slices(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class Plan:
    """Where the pieces of each length go, by rank. counts: pieces by length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        gaps: dict[int, list[tuple[int, int]]] = {}  # runs (first sequence, number) by gap
        sizes: list[int] = []  # gaps that there are, sorted
        steps: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces a sequence, offset

        def release(gap: int, first: int, n: int) -> None:
            if gap and n:
                if gap not in gaps:
                    bisect.insort(sizes, gap)
                    gaps[gap] = []
                gaps[gap].append((first, n))

        for length in sorted(counts, reverse=True):
            rank, left = 0, counts[length]
            while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
                each = min(gap // length, -(-left // n))  # pieces that fit a sequence, if there are so many
                full = min(n, left // each)
                steps.append((length, rank, first, each, capacity - gap))
                release(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
                if full < n and left:  # fewer pieces are left than the next sequence takes
                    steps.append((length, rank, first + full, left, capacity - gap))
                    release(gap - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                release(gap, first + full, n - full)
            if left:
                each = capacity // length
                full, rest = divmod(left, each)
                steps.append((length, rank, self.sequences, each, 0))
                release(capacity - each * length, self.sequences, full)
                if rest:
                    steps.append((length, rank + full * each, self.sequences + full, rest, 0))
                    release(capacity - rest * length, self.sequences + full, 1)
                self.sequences += full + bool(rest)
        steps = sorted(steps)
        #: Of each length, the ranks from which the steps hold; steps of a length follow those of shorter ones.
        self.lengths, self.ranks, self.firsts, self.each, self.offsets = (np.array(x, np.int64) for x in (zip(*steps, strict=True) if steps else [[]] * 5))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for one in np.unique(length):
            rows = length == one
            a, b = np.searchsorted(self.lengths, [one, one + 1])
            step = a + np.searchsorted(self.ranks[a:b], rank[rows], "right") - 1
            turn = rank[rows] - self.ranks[step]
            sequence[rows] = self.firsts[step] + turn // self.each[step]
            offset[rows] = self.offsets[step] + turn % self.each[step] * one
        return sequence, offset


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (id, piece, length and more) with sequence_id and offset; what is packed must be stored, for it is read twice."""
    by_shard = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(-(-pieces.count() // SHARD_ROWS) * 8 or 1)))
    counts = by_shard.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")))
    plan = Plan({x.length: x.n for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # at most capacity rows
    by_rank = Window.partitionBy("shard", "length").orderBy("id", "piece")
    ranked = by_shard.withColumn("rank", F.row_number().over(by_rank) - 1).join(counts.drop("n"), ["shard", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "shard")
    names = ranked.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column(names.index("length")).to_numpy(), batch.column(names.index("rank")).to_numpy())
            kept = [(c, n) for c, n in zip(batch.columns, names, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), pa.array(sequence), pa.array(offset)], [*(n for _, n in kept), "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {k}" for n, k in ranked.dtypes if n != "rank")
    return ranked.mapInArrow(work, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(stored(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col)), capacity)
