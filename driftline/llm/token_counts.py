"""Exact token counts at every prefix of a text, by dynamic programming over the prefixes.

In a BPE encoding every two neighbouring tokens form a valid pair on their own, and any sequence of valid pairs is
the encoding of its text. So the last token of a prefix's encoding is the one token that ends the prefix and forms a
valid pair with the last token of the prefix before it; the count is one more than there. Characters outside the
vocabulary count as their UTF-8 bytes. A text's counts are kept as one signed byte a character (the difference to
the count of the prefix before), so truncation and budget questions are answered by sums, without encoding again.

No piece has a space after another character, so a text falls into parts that begin with spaces. Parts that come
again are taken from a bounded cache; the new ones of a batch are worked on together: a trie finds every piece in them,
then each step takes all prefixes of one length. Null is as the empty text, which has no tokens.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import map_slices

BAR = "▁"
PARTS = re.compile(f"{BAR}*[^{BAR}]+|{BAR}+")
#: Parts that are remembered; the older half goes when there are more.
CACHE = 400_000
PAIR_BITS = 21
#: Characters of parts that are worked on together and remembered, and how many of these at a time.
SHORT, TOGETHER = 48, 50_000


class Trie:
    """The pieces of a vocabulary by their characters, walked for many positions at once."""

    def __init__(self, pieces: list[str]):
        edges: dict[tuple[int, int], int] = {}
        ends: list[int] = [-1]
        for number, piece in enumerate(pieces):
            at = 0
            for c in map(ord, piece):
                to = edges.setdefault((at, c), len(ends))
                if to == len(ends):
                    ends.append(-1)
                at = to
            ends[at] = number
        keys = np.array([state << 21 | c for state, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.next, self.ends = keys[order], np.array(list(edges.values()), np.int64)[order], np.array(ends, np.int64)

    def matches(self, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of every piece in chars; room: how many characters a piece from there may have."""
        at, state, length, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0, []
        while len(at):
            key = state << 21 | chars[at + length]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = self.keys[place] == key
            at, state, length = at[fits], self.next[place[fits]], length + 1
            whole = self.ends[state] >= 0
            found.append((at[whole], at[whole] + length, self.ends[state[whole]]))
            more = room[at] > length
            at, state = at[more], state[more]
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3


class Pairs:
    """Which pieces may follow which. What the library said is kept by the pair's hash; a later pair of that hash takes the place."""

    def __init__(self, ask):
        self.ask, self.keys, self.fine = ask, np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.fine[place]
        unknown = self.keys[place] != keys
        if unknown.any():
            own, first, back = np.unique(keys[unknown], return_index=True, return_inverse=True)
            found = np.array(self.ask(own.tolist()), bool)
            out[unknown], at = found[back], place[unknown][first]
            self.keys[at] = own
            kept = self.keys[at] == own  # of several new pairs of one hash one is kept
            self.fine[at[kept]] = found[kept]
        return out


class PrefixCounts:
    def __init__(self, model_path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        self.pieces = [p.piece for p in model.pieces if p.type == 1]
        if trained.model_type != 2 or not trained.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or any(BAR in p.lstrip(BAR) for p in self.pieces) or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only BPE models with byte fallback, plain characters and spaces at the beginnings of pieces are supported")
        self.numbers = {piece: i for i, piece in enumerate(self.pieces)}
        #: Instead of the number of the piece before: of what begins a part, and of a character outside the vocabulary.
        self.start, self.outside = len(self.pieces), len(self.pieces) + 1
        self.longest, self.dummy = max(map(len, self.pieces)), bool(spec.add_dummy_prefix)
        spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.trie, self.pairs, self.parts = Trie(self.pieces), Pairs(self.ask), {}

    def ask(self, keys: list[int]) -> list[bool]:
        """Whether pairs (numbers of the piece before and of the piece, in one number) are encodings by themselves."""
        both = [divmod(k, self.outside + 1) for k in keys]
        names = [["" if a == self.start else self.pieces[a], self.pieces[b]] for a, b in both]
        found = self.plain.encode(["".join(x) for x in names], out_type=str, num_threads=1)
        return [got == (x if x[0] else x[1:]) for got, x in zip(found, names, strict=True)]

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        out = before == self.outside  # nothing merges with such a character
        out[~out] = self.pairs(before[~out] * (self.outside + 1) + piece[~out])
        return out

    def learn(self, parts: list[str]) -> None:
        """Puts the steps of parts, which are short, into the cache: a step for each end, for all parts at once."""
        sizes = np.array([len(p) for p in parts])
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(len(chars)) - np.repeat(first, sizes)  # in its part
        start, end, piece = self.trie.matches(chars, np.repeat(sizes, sizes) - place)
        place = place.astype(np.uint8)
        turn = place[end - 1]
        order = np.argsort(turn, kind="stable")
        start, end, piece, edges = start[order], end[order], piece[order], np.searchsorted(turn[order], np.arange(sizes.max() + 1))
        by_place = np.argsort(place, kind="stable")
        ends_at = np.searchsorted(place[by_place], np.arange(sizes.max() + 1))
        utf8 = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        # of the prefix that ends with each character: the count, and the number of the last piece
        counts, last = np.zeros(len(chars), np.int64), np.full(len(chars), self.outside)
        for t in range(sizes.max()):
            own = slice(edges[t], edges[t + 1])
            at, to, p = start[own], end[own] - 1, piece[own]
            head = place[at] == 0
            fits = self.may_follow(np.where(head, self.start, last[at - 1]), p)
            here = by_place[ends_at[t] : ends_at[t + 1]]
            counts[here] = utf8[here] + (counts[here - 1] if t else 0)
            to, at, p, head = to[fits], at[fits], p[fits], head[fits]
            counts[to], last[to] = 1 + np.where(head, 0, counts[at - 1]), p
        steps = np.diff(counts, prepend=0)
        steps[first] = counts[first]
        steps, ends = steps.astype(np.int8).tobytes(), np.append(first, len(chars)).tolist()
        self.parts.update((part, steps[a:b]) for part, a, b in zip(parts, ends, ends[1:], strict=False))

    def long_steps(self, text: str) -> bytes:
        """The steps of one long part, character by character."""
        numbers, counts, lengths = self.numbers, [0], [0]
        for end in range(1, len(text) + 1):
            count, length = counts[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass")), 1
            for start in range(max(0, end - self.longest), end):
                if (piece := numbers.get(text[start:end])) is not None:
                    before = numbers.get(text[start - lengths[start] : start], self.outside) if start else self.start
                    if before == self.outside or self.known_pair(before, piece):
                        count, length = counts[start] + 1, end - start
                        break
            counts.append(count)
            lengths.append(length)
        return np.diff(np.array(counts, np.int64)).astype(np.int8).tobytes()

    @functools.lru_cache(200_000)  # noqa: B019
    def known_pair(self, before: int, piece: int) -> bool:
        return bool(self.pairs(np.array([before * (self.outside + 1) + piece]))[0])

    def tables(self, texts: list[str]) -> list[bytes]:
        """Of each text one signed byte a character: the difference of the token counts of the prefixes with and without it."""
        split = [PARTS.findall(text.replace(" ", BAR)) for text in texts]
        for parts in split:
            if parts and self.dummy:
                parts[0] = BAR + parts[0]
        if len(self.parts) >= CACHE:  # those that came first go first
            for part in list(itertools.islice(self.parts, CACHE // 2)):
                del self.parts[part]
        new, known, longs = set().union(*split).difference(self.parts), self.parts, {}
        if short := [p for p in new if len(p) <= SHORT]:
            for at in range(0, len(short), TOGETHER):
                self.learn(short[at : at + TOGETHER])
        if len(short) < len(new):
            longs = {p: self.long_steps(p) for p in new if len(p) > SHORT}
        out = []
        for parts in split:
            steps = b"".join([known[p] if p in known else longs[p] for p in parts] if longs else map(known.__getitem__, parts))
            if steps and self.dummy:  # the character that stands before the text has no place of its own
                steps = bytes(((steps[0] + steps[1]) & 255,)) + steps[2:]
            out.append(steps)
        return out

    def table(self, text: str) -> bytes:
        return self.tables([text])[0]


def totals(table: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2 and more characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)])


def longest_within(table: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most so many tokens."""
    return int(np.flatnonzero(totals(table) <= budget)[-1])


@functools.lru_cache(2)
def prefix_counter(model_path: str) -> PrefixCounts:
    """Made once in each worker process."""
    return PrefixCounts(model_path)


def count_tokens(df: DataFrame, model_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text", keep_tables: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, fits_chars (the longest prefix within the budget) and, if wanted, prefix_steps (the table) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows = [x or "" for x in batch.column(1).to_pylist()], []
        for text, table in zip(texts, prefix_counter(model_path).tables(texts), strict=True):
            n = int(np.frombuffer(table, np.int8).sum(dtype=np.int64))
            rows.append((len(text.encode()), n, len(text) if n <= budget else longest_within(table, budget), table))
        made = list(zip(*rows, strict=True))
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in made[:3])]
        return pa.RecordBatch.from_arrays(columns + [pa.array(made[3], pa.binary())] * keep_tables, ["id", "n_bytes", "n_tokens", "fits_chars", "prefix_steps"][: 4 + keep_tables])

    kind = dict(df.dtypes)[id_col]
    return map_slices(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, n_bytes long, n_tokens long, fits_chars long" + ", prefix_steps binary" * keep_tables)
