"""Near-duplicate groups by HyperMinHash.

A text's shingles fall into buckets; a bucket's register keeps the smallest hash as its count of leading zeros and a few
mantissa bits. Buckets that a small set leaves empty are filled by further rounds of hashing, which two sets share as
far as their elements do. Bands of registers make the candidates; the share of equal registers, corrected for registers
that agree by chance, estimates their similarity; candidates near or above the threshold are verified on the full sets.

Texts with equal sets form a class, of which only one text is compared; classes are numbered (node) in the order of their
smallest ids. A bucket's pivot is the member that meets others most often over all bands, so one of the most central.
First each class is compared with the foremost of its pivots. Then, while that still links many, the members of a bucket
that are outside its largest component are compared with one of them. What is left open, members of one bucket in
different components, is settled exactly by their differences from the bucket's pivot: two sets that don't both link
with it can only link if their differences have enough in common, so only pairs that share rare elements among these are
compared. So every pair that shares a bucket is linked through others, or compared, or known to be too far apart.

Null texts, and texts without words, have no shingles and link with nothing. Of rows that repeat an id
each distinct text is compared; ids only give groups their names. Rows without an id are compared too, but can't name a
group; a group of only such rows has no name. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_grouped, map_slices, release, stored
from .graphs import components
from .shingles import U, mix, shingle_sets

REGISTERS, BAND = 256, 6
BANDS = REGISTERS // BAND
#: A register: exponent (leading zeros, or from ROUNDS on the round that filled it) and mantissa.
MANTISSA, ROUNDS, EXPONENTS = 10, 40, 64
ROUND_SALT = U(0xA0761D6478BD642F)
#: Standard errors of the estimate below the threshold at which candidates are still verified.
MARGIN = 5.0
#: Rounds of further pivots at most, which end early when a round links less than this share of its pairs.
TURNS, LEAST_GAIN = 4, 0.1
#: About what it takes to verify a pair, which decides how many tasks do it.
TEXT_BYTES = 8192


def registers(hashes: np.ndarray) -> np.ndarray:
    """Of a sorted, non-empty set of 64-bit hashes."""
    edges = np.searchsorted(hashes >> U(56), np.arange(REGISTERS + 1))
    out, full = np.zeros(REGISTERS, np.uint16), edges[1:] > edges[:-1]
    low = (hashes[edges[:-1][full]] & U(2**56 - 1)).astype(np.int64)
    length = np.frexp(low.astype(np.float64))[1]  # bits up to the first one; rounding up to a power of two is alike for equal hashes
    zeros = np.minimum(56 - np.minimum(length, 56), ROUNDS - 1)
    shift = np.maximum(length - 1 - MANTISSA, 0)
    out[full] = zeros << MANTISSA | (low >> shift) & (2**MANTISSA - 1)
    empty, at = ~full, 1
    while empty.any() and at < REGISTERS:
        to = min(REGISTERS, at + max(1, int(2 * REGISTERS / len(hashes)) + 1))
        turn = np.arange(at, to, dtype=U)
        x = mix(hashes[None, :] + turn[:, None] * ROUND_SALT)
        bucket = (x >> U(56)).astype(np.int64)
        key = (bucket.astype(U) << U(56)) | (turn[:, None] << U(40)) | ((x >> U(16)) & U(2**40 - 1))
        key = np.sort(key[empty[bucket]])
        own, first = np.unique((key >> U(56)).astype(np.int64), return_index=True)
        turns, value = ((key[first] >> U(40)) & U(0xFFFF)).astype(np.int64), key[first]
        out[own] = np.minimum(ROUNDS + turns - 1, EXPONENTS - 1) << MANTISSA | ((value >> U(40 - MANTISSA)) & U(2**MANTISSA - 1)).astype(np.int64)
        empty[own] = False
        at = to
    for b in np.flatnonzero(empty):  # the last rounds have a bucket each
        value = mix(hashes + np.array([REGISTERS + b], U) * ROUND_SALT).min()
        out[b] = (EXPONENTS - 1) << MANTISSA | int(value >> U(64 - MANTISSA))
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, for registers of many sets."""
    parts = regs[:, : BANDS * BAND].reshape(len(regs), BANDS, BAND).astype(U)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), parts.shape[:2]).copy()
    for j in range(BAND):
        h = mix(h * U(0xD6E8FEB86659FD93) + parts[:, :, j])
    return h.astype(np.int64)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree though the sets have nothing in common: equal exponents and mantissas."""

    def exponents(n: np.ndarray) -> np.ndarray:
        edge = 2.0 ** -np.arange(ROUNDS + 1) / REGISTERS
        above = (1 - edge[None, :]) ** n[:, None]
        return above[:, 1:] - above[:, :-1]

    return (exponents(n_a) * exponents(n_b)).sum(1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sets by their registers, corrected for chance."""
    extra = chance(n_a.astype(np.float64), n_b.astype(np.float64))
    return np.clip(((a == b).mean(1) - extra) / (1 - extra), 0, 1)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """id, text_key, n (size of the set), set_key (equal for equal sets), registers; for an empty set the last two are null."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2), words)
        keys = [None if not len(s) else np.array([mix(s ^ U(0x1D8E4E27C47D124F)).sum(dtype=U), mix(s ^ U(0xEB44ACCAB455D165)).sum(dtype=U)], "<u8").tobytes() for s in sets]
        regs = [registers(s).astype("<u2").tobytes() if len(s) else None for s in sets]
        arrays = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["id", "text_key", "n", "set_key", "registers"])

    return map_slices(docs.select("id", "text_key", "text"), work, "id long, text_key long, n long, set_key binary, registers binary")


def as_matrix(column: pa.Array) -> np.ndarray:
    """Registers as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def buckets(reps: DataFrame) -> DataFrame:
    """key, node, size of the bands' buckets that have several members; of buckets with the same members, one."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = band_keys(as_matrix(batch.column(1)))
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"])

    rows = map_slices(reps.select("node", "registers"), work, "key long, node long")
    seen = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"members_{i}") for i in range(2)]
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *seen).filter("size > 1")
    counts = stored(counts.groupBy("size", "members_0", "members_1").agg(F.min("key").alias("key")).select("key", "size"))
    out = stored(rows.join(counts, "key"))  # as many tasks as the bands' rows need, of which most go
    release(counts)
    return out


def first(*columns: str) -> Column:
    """The row with the largest first column, of equal ones with the smallest second."""
    return F.max(F.struct(F.col(columns[0]).alias("order"), (-F.col(columns[1])).alias("least"), *columns))


def ranked(members: DataFrame, rows: int) -> DataFrame:
    """members with share (how often the node meets others, over all buckets) and the pivot: of each bucket the node with the largest share.

    The share grows with a node's likeness to the others, so the pivot is one of the most central members.
    """
    shares = members.groupBy("node").agg(F.sum(F.col("size") - 1).alias("share"))
    known = stored(members.join(shares, "node"), rows)
    pivots = known.groupBy("key").agg(first("share", "node").alias("best")).select("key", F.col("best.node").alias("pivot"), F.col("best.share").alias("pivot_share"))
    out = stored(known.join(pivots, "key").select("key", "node", "share", "pivot", "pivot_share"), rows)
    release(known)
    return out


#: What tells the rows of one id and text: an id's place (0 for none), and whether it has none.
SOURCE = ("place", "unnamed")


def source(id_col: str) -> tuple[Column, Column]:
    return F.coalesce(id_col, F.lit(0)).alias("place"), F.col(id_col).isNull().alias("unnamed")


class Sets:
    """Candidate classes (node): their registers and texts, stored, to compare pairs of them."""

    def __init__(self, reps: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int):
        self.words, self.percent = words, percent
        own = reps.join(nodes, "node", "left_semi")
        self.registers = stored(own.select("node", "n", "registers"))
        self.count = self.registers.count()
        wanted = own.select("node", *source("first"), "text_key")
        rows = docs.select(*source("id"), "text_key", "text").join(wanted, [*SOURCE, "text_key"])
        self.texts = stored(rows.groupBy(*SOURCE, "text_key").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"))

    def release(self) -> None:
        release(self.registers, self.texts)

    def with_texts(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """pairs with text_a and text_b."""
        return pairs.join(self.texts.toDF(b, "text_b"), b).join(self.texts.toDF(a, "text_a"), a)

    def linked(self, pairs: DataFrame, rows: int) -> DataFrame:
        """Those of the pairs (a, b), at most so many rows, that link: estimated by their registers, then verified on the full sets."""
        least, words, percent = self.percent / 100, self.words, self.percent
        error = MARGIN * (least * (1 - least) / REGISTERS) ** 0.5

        def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            near = estimate(as_matrix(batch.column(4)), as_matrix(batch.column(5)), n_a, n_b) + error >= least
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

        def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, place, back = np.unique(batch.column(0).to_numpy(), return_index=True, return_inverse=True)
            ones, fits = shingle_sets(batch.column(2).take(pa.array(place)), words), []
            for x, y in zip(back, shingle_sets(batch.column(3), words), strict=True):
                shared = len(np.intersect1d(ones[x], y, assume_unique=True))
                fits.append(100 * shared >= percent * (len(ones[x]) + len(y) - shared))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fits, pa.bool_()))

        inside = pairs.join(self.registers.toDF("b", "n_b", "r_b"), "b").join(self.registers.toDF("a", "n_a", "r_a"), "a")
        inside = inside.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        close = stored(map_slices(inside.select("a", "b", "n_a", "n_b", "r_a", "r_b"), judge, "a long, b long"), rows, 4 * REGISTERS)
        both = self.with_texts(close, "a", "b").select("a", "b", "text_a", "text_b")
        out = stored(map_slices(both, verify, "a long, b long"), rows, TEXT_BYTES)
        release(close)
        return out


def grown(found: DataFrame, nodes: int, *more: DataFrame) -> DataFrame:
    """Components (node, component) of so many nodes with further links (a, b); what was given is released."""
    edges = None
    for one in more:
        edges = one if edges is None else edges.unionByName(one)
    ends = edges.join(found.toDF("a", "u"), "a").join(found.toDF("b", "v"), "b").filter("u <> v").select("u", "v").distinct()
    edges = stored(ends, nodes)
    if edges.take(1):
        joined = components(edges, "u", "v", nodes)
        old, found = found, stored(found.join(joined.toDF("component", "whole"), "component", "left").select("node", F.coalesce("whole", "component").alias("component")), nodes)
        release(old, joined)
    release(edges, *more)
    return found


def links(members: DataFrame, rows: int, sets: Sets) -> DataFrame:
    """node, component of all candidates, linked as far as comparisons with pivots go. rows: of members."""
    n = sets.count
    stars = members.filter("node <> pivot").groupBy("node").agg(first("pivot_share", "pivot").alias("best"))
    tested = stored(stars.select(F.col("best.pivot").alias("a"), F.col("node").alias("b")), n)
    found = stored(sets.registers.select("node", F.col("node").alias("component")), n)
    found, pivots = grown(found, n, sets.linked(tested, n)), tested.select(F.col("a").alias("node")).distinct()
    for _ in range(TURNS):
        known = members.join(found, "node")
        parts = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        largest = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), first("size", "component").alias("best")).filter("parts > 1")
        # members outside the largest component of their bucket; components that had a pivot lend none again
        outside = stored(known.join(largest.select("key", F.col("best.component").alias("largest")), "key").filter("component <> largest").select("key", "node", "share", "component"), rows)
        had = found.join(pivots, "node", "left_semi").select("component").distinct()
        heads = outside.join(had, "component", "left_anti").groupBy("key").agg(F.max(F.struct("share", (-F.col("node")).alias("least"), "node", "component")).alias("head"))
        stars = outside.join(heads, "key").filter("component <> head.component").groupBy("node").agg(F.max("head").alias("head"))
        pairs = stored(stars.select(F.col("head.node").alias("a"), F.col("node").alias("b")), n)
        tries = pairs.count()
        linked = sets.linked(pairs, tries) if tries else None
        more = linked.count() if tries else 0
        if tries:
            found = grown(found, n, linked)
            pivots = stored(pivots.unionByName(pairs.select(F.col("a").alias("node"))).distinct(), n)
            release(tested)
            tested = pivots
        release(outside, pairs)
        if more <= LEAST_GAIN * tries:
            break
    release(tested)
    return found


def remaining(members: DataFrame, rows: int, found: DataFrame, sets: Sets) -> DataFrame:
    """found, after all pairs of one bucket in different components have been compared or shown to be too far apart."""
    known = members.join(found, "node")
    open_ = stored(known.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other")).filter("one <> other").select("key"), rows)
    if open_.take(1):
        differ = deltas(known.join(open_, "key").select("pivot", "node", "component").distinct(), sets)
        pairs = open_pairs(differ, sets.percent)
        linked = sets.linked(pairs, pairs.count())
        direct = stored(differ.filter("linked AND node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), rows)
        release(differ, pairs)
        found = grown(found, sets.count, linked, direct)
    release(open_)
    return found


def deltas(members: DataFrame, sets: Sets) -> DataFrame:
    """Of members (pivot, node, component): n, far (distance of the pivot), linked, keys (of the elements in which the two sets differ).

    joint and apart are how many keys it must share to link with a set that is not, or is, linked with the pivot.
    """
    words, percent = sets.words, sets.percent
    g = (100 - percent) / (100 + percent)  # sets link if they differ in at most this share of the sum of their sizes

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pivots, place, back = np.unique(batch.column(0).to_numpy(), return_index=True, return_inverse=True)
        firsts, out = shingle_sets(batch.column(3).take(pa.array(place)), words), []
        salts = mix(pivots.view(U))
        for p, x in zip(back, shingle_sets(batch.column(4), words), strict=True):
            differ = np.setxor1d(x, firsts[p], assume_unique=True)
            extra, least = len(differ) - g * len(x), g * len(firsts[p])
            linked = extra <= least + 1e-9
            joint = max(1, int(np.ceil((extra + least) / 2 - 1e-6)))
            apart = joint if linked else max(1, int(np.ceil((extra - least) / (1 + g) - 1e-6)))
            out.append((len(x), 2 * len(differ) / (len(x) + len(firsts[p]) + len(differ)), linked, mix(differ ^ salts[p]).view(np.int64), joint, apart))
        kinds = (pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        arrays = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["pivot", "node", "component", "n", "far", "linked", "keys", "joint", "apart"])

    both = sets.with_texts(members, "pivot", "node").select("pivot", "node", "component", "text_a", "text_b")
    return stored(map_slices(both, work, "pivot long, node long, component long, n long, far double, linked boolean, keys array<long>, joint long, apart long"))


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of deltas' rows of one pivot that may link.

    Sets of which one at least isn't linked with their pivot can only link if they share a number of the elements in
    which they differ from it. So each keeps but its rarest differing elements, as many as any partner must meet.
    """
    each = rows.select(F.explode("keys").alias("key"), "pivot", "node")
    counts = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
    shared = each.join(counts, "key")
    # elements that no other set has come first in the order and meet nothing, so only their number counts
    last = F.row_number().over(Window.partitionBy("pivot", "node").orderBy(F.desc("held"), F.desc("key")))  # the element and those that come after it
    kept = shared.withColumn("last", last).join(rows.drop("keys"), ["pivot", "node"]).filter("last >= apart")
    kept = stored(kept.select("key", "node", "n", "component", "far", "linked", (F.col("last") >= F.col("joint")).alias("strict")))
    x, y = kept.filter("NOT linked").alias("x"), kept.alias("y")
    fits = (F.abs(F.col("x.far") - F.col("y.far")) <= 1 - percent / 100 + 1e-9) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    kinds = F.col("y.linked") | (F.col("x.strict") & F.col("y.strict") & (F.col("x.node") < F.col("y.node")))
    both = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & kinds & fits)
    out = stored(both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    release(counts, kept)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links lead to), kept for every row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = stored(sketches(docs, words))
    smallest = F.min(F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("first"), "text_key")).alias("row")
    classes = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(smallest, F.count(F.lit(1)).alias("size")).select("set_key", "size", "row.*")
    classes = stored(classes.orderBy("unnamed", "first", "set_key").withColumn("node", F.monotonically_increasing_id()))
    # the row that stands for a class; copies of one set have ids of their own, so this join meets no hot key
    held = classes.select("set_key", *source("first"), "text_key", "node", "first")
    reps = rows.select("set_key", *source("id"), "text_key", "n", "registers").join(held, ["set_key", *SOURCE, "text_key"])
    reps = stored(reps.dropDuplicates(["set_key", *SOURCE, "text_key"]).select("node", "first", "text_key", "n", "registers"))
    met = buckets(reps)
    size = met.count()
    members = ranked(met, size)
    release(met)
    sets = Sets(reps, docs, members.select("node").distinct(), words, percent)
    release(reps)
    groups = remaining(members, size, links(members, size, sets), sets)
    release(members)
    sets.release()
    names = groups.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("name"))
    named = classes.join(groups.join(names, "component"), "node", "left")
    named = stored(named.select("set_key", "size", F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("name")).alias("component_id")))
    release(groups, classes)
    small = rows.select("id", "n", "set_key")
    out = join_grouped(small.filter("set_key IS NOT NULL"), named, "set_key", "size", rows.count()).select("id", "n", "component_id")
    out = out.unionByName(small.filter("set_key IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
