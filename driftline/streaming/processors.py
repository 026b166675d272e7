"""Live forms of the operators: stateful processors that emit changes (+I, -U, +U, -D) of what the batch form defines.

Input rows of a micro-batch are sorted by their order columns before they are applied, as arrival says nothing. States
hold only what later rows need, and may expire (ttl_ms). Keys are columns; state is keyed and kept in the state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from ..operators.aggregates import Aggregation, Sum, of_each_set
from ..schemas import AFTER, BEFORE, DELETE, INSERT, OP


def struct_of(df: DataFrame, columns: Sequence[str]) -> StructType:
    """Of columns that are kept or emitted; Spark's Python states lose maps, so these are refused."""
    if maps := [c for c in columns if isinstance(df.schema[c].dataType, MapType)]:
        raise TypeError(f"maps can't be kept, use arrays of structs: {maps}")
    return StructType([StructField(c, df.schema[c].dataType, True) for c in columns])


def values_of(row: Row, columns: Sequence[str]) -> tuple:
    return tuple(row[c] for c in columns)


def as_in_rows(value):
    """A value of a state as input rows have it: nested structs as dicts."""
    if isinstance(value, Row):
        return {k: as_in_rows(v) for k, v in value.asDict().items()}
    return [as_in_rows(v) for v in value] if isinstance(value, list) else value


def held(state) -> tuple | None:
    """What a value state holds."""
    return tuple(map(as_in_rows, state.get())) if state.exists() else None


def run(df: DataFrame, key: Sequence[str], processor: StatefulProcessor, schema: StructType, timed: bool = False, mode: str = "update") -> DataFrame:
    """timed: states expire or timers fire, which goes by processing time. mode: append, if another live operator follows."""
    return df.groupBy(*key).transformWithState(processor, schema, mode, "processingTime" if timed else "none")


def ordered(rows: Iterator[Row], order: Sequence[str]) -> list[Row]:
    return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in order))


class Normalize(StatefulProcessor):
    """Upserts and deletes of a key as a full changelog; a delete clears, and an equal upsert is suppressed if wanted."""

    def __init__(self, key, order, values, state: StructType, suppress_equal: bool, ttl_ms: int | None):
        self.key, self.order, self.columns, self.state, self.suppress, self.ttl = key, order, values, state, suppress_equal, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", self.state, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = held(self.live)
        out = Row(*self.key, *self.order, OP, *self.columns)
        for row in ordered(rows, self.order):
            at, new = (*key, *values_of(row, self.order)), values_of(row, self.columns)
            if row[OP] == BEFORE:
                continue
            if row[OP] == DELETE:
                if old is not None:
                    yield out(*at, DELETE, *old)
                old = None
            elif old is None:
                yield out(*at, INSERT, *new)
                old = new
            elif not (self.suppress and old == new):
                yield out(*at, BEFORE, *old)
                yield out(*at, AFTER, *new)
                old = new
        if old is None:
            self.live.clear()
        else:
            self.live.update(old)

    def close(self) -> None:
        pass


def normalize(changes: DataFrame, key: Sequence[str], order: Sequence[str], suppress_equal: bool = False, ttl_ms: int | None = None) -> DataFrame:
    values = [c for c in changes.columns if c not in (*key, *order, OP)]
    schema = StructType([*struct_of(changes, [*key, *order]), StructField(OP, StringType()), *struct_of(changes, values)])
    return run(changes, key, Normalize(list(key), list(order), values, struct_of(changes, values), suppress_equal, ttl_ms), schema, ttl_ms is not None)


class LiveJoin(StatefulProcessor):
    """All live left rows of a join key, by primary key, with the key's live right row.

    A micro-batch is applied as a whole, then the difference between the joined rows before and after it is emitted, so
    nothing half-updated shows. combine makes any number of rows of a left and a right one; without it their columns
    stand side by side, and rows of equal number are updates of each other.
    """

    def __init__(self, key, left_key, order, left, right, types, out, ttl_ms, outer, combine):
        self.key, self.left_key, self.order, self.left, self.right, self.types, self.out, self.ttl, self.outer, self.combine = key, left_key, order, left, right, types, out, ttl_ms, outer, combine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lefts = handle.getMapState("left", self.types[0], self.types[1], self.ttl)
        self.rights = handle.getValueState("right", self.types[2], self.ttl)

    def joined(self, left: tuple | None, right: tuple | None) -> list[tuple]:
        if left is None or (right is None and not self.outer):
            return []
        right = right or (None,) * len(self.right)
        return [tuple(x) for x in self.combine(left, right)] if self.combine else [(*left, *right)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        right_before = held(self.rights)
        right_now, touched = right_before, {}
        # what goes at one place of the order goes before what comes there, so an update to an equal value keeps its row
        for row in sorted(rows, key=lambda r: (*((r[c] is not None, r[c]) for c in self.order), r[OP] not in (DELETE, BEFORE))):
            gone = row[OP] in (DELETE, BEFORE)
            if row["tag"] == "right":
                if not gone or row[OP] == DELETE:
                    right_now = None if gone else values_of(row, self.right)
            else:
                pk, value = values_of(row, self.left_key), values_of(row, self.left)
                before, now = touched.get(pk) or ((tuple(map(as_in_rows, self.lefts.getValue(pk))) if self.lefts.containsKey(pk) else None),) * 2
                # a row that goes by -U only goes if nothing newer replaced it
                touched[pk] = (before, value if not gone else None if row[OP] == DELETE or now == value else now)
        for pk, (_, now) in touched.items():
            if now is None:
                if self.lefts.containsKey(pk):
                    self.lefts.removeKey(pk)
            else:
                self.lefts.updateValue(pk, now)
        if right_now is None:
            self.rights.clear()
        elif right_now != right_before:
            self.rights.update(right_now)
        if right_now != right_before:
            for pk, now in self.lefts.iterator():
                touched.setdefault(tuple(pk), (tuple(map(as_in_rows, now)),) * 2)
        out = Row(*self.key, *self.left_key, OP, *self.out)
        for pk, (left_before, left_now) in touched.items():
            before, now = self.joined(left_before, right_before), self.joined(left_now, right_now)
            if before == now:
                continue
            paired = len(before) == len(now)
            for row in before:
                yield out(*key, *pk, BEFORE if paired else DELETE, *row)
            for row in now:
                yield out(*key, *pk, AFTER if paired else INSERT, *row)

    def close(self) -> None:
        pass


def live_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], left_key: Sequence[str], order: Sequence[str], ttl_ms: int | None = None, outer: bool = False,
    combine: Callable[[tuple, tuple], Sequence[tuple]] | None = None, result: str | None = None, mode: str = "update",
) -> DataFrame:
    """Many to one on key; both sides have op, and the order's columns unless a side needs none.

    Left rows that change their join key must come as a full changelog, so that the old key sees the row go. combine:
    from the values of a left and a right row to the rows of the schema result.
    """
    lefts = [c for c in left.columns if c not in (*key, *left_key, *order, OP)]
    rights = [c for c in right.columns if c not in (*key, *order, OP)]
    if shared := {*lefts, *left_key} & {*rights}:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    both = left.withColumn("tag", F.lit("left")).unionByName(right.withColumn("tag", F.lit("right")), allowMissingColumns=True)
    made = StructType.fromDDL(result) if combine else StructType([*struct_of(left, lefts), *struct_of(right, rights)])
    schema = StructType([*struct_of(left, [*key, *left_key]), StructField(OP, StringType()), *made])
    types = struct_of(left, left_key), struct_of(left, lefts), struct_of(right, rights)
    return run(both, key, LiveJoin(list(key), list(left_key), list(order), lefts, rights, types, made.names, ttl_ms, outer, combine), schema, ttl_ms is not None, mode)


def live_one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[str], ttl_ms: int | None = None, **options) -> DataFrame:
    """The live rows of both sides that share a key; options as for live_join."""
    own = [f"_own_{c}" for c in key]
    out = live_join(left.withColumns({o: F.col(c) for o, c in zip(own, key, strict=True)}), right, key, own, order, ttl_ms, **options)
    return out.drop(*own)


class MultiLeft(StatefulProcessor):
    """The latest row of each of several relations of one key; emits when the left one is there and something changed."""

    def __init__(self, key, order, sides, types, accept, ttl_ms):
        self.key, self.order, self.sides, self.types, self.accept, self.ttl = key, order, sides, types, accept, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = [handle.getValueState(f"side{i}", t, self.ttl) for i, t in enumerate(self.types)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = [held(s) for s in self.states]
        now = list(before)
        for row in ordered(rows, self.order):
            i = int(row["tag"])
            value = None if row[OP] in (DELETE, BEFORE) else values_of(row, self.sides[i])
            accept = self.accept.get(i)
            if row[OP] != BEFORE and (value is None or now[i] is None or accept is None or accept(now[i], value)):
                now[i] = value
        for state, old, new in zip(self.states, before, now, strict=True):
            if new is None:
                state.clear()
            elif new != old:
                state.update(new)

        def flat(values):
            return None if values[0] is None else [x for v, names in zip(values, self.sides, strict=True) for x in (v or (None,) * len(names))]

        out, old, new = Row(*self.key, OP, *[c for side in self.sides for c in side]), flat(before), flat(now)
        if old != new:
            if old is not None:
                yield out(*key, DELETE if new is None else BEFORE, *old)
            if new is not None:
                yield out(*key, INSERT if old is None else AFTER, *new)

    def close(self) -> None:
        pass


def multi_left(relations: Sequence[DataFrame], key: Sequence[str], order: Sequence[str], accept: dict[int, Callable[[tuple, tuple], bool]] | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The first relation with all others, in one shuffle. accept: by side, whether a value differs from the one before."""
    sides = [[c for c in r.columns if c not in (*key, *order, OP)] for r in relations]
    both = None
    for i, r in enumerate(relations):
        r = r.withColumn("tag", F.lit(str(i)))
        both = r if both is None else both.unionByName(r, allowMissingColumns=True)
    types = [struct_of(r, side) for r, side in zip(relations, sides, strict=True)]
    schema = StructType([*struct_of(relations[0], key), StructField(OP, StringType()), *[f for t in types for f in t]])
    return run(both, key, MultiLeft(list(key), list(order), sides, types, accept or {}, ttl_ms), schema, ttl_ms is not None)


class Gate(StatefulProcessor):
    """Rows of an id pass once the id has been seen; of those before, the one that later() picks is released then."""

    def __init__(self, key, order, columns, state, later, ttl_ms):
        self.key, self.order, self.columns, self.state, self.later, self.ttl = key, order, columns, state, later, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "open boolean", self.ttl)
        self.waiting = handle.getValueState("waiting", self.state, self.ttl)

    def picked(self, kept: tuple | None, new: tuple) -> tuple:
        if kept is None:
            return new
        one, other = (dict(zip(self.columns, x, strict=True)) for x in (kept, new))
        if self.later:
            return new if self.later(one, other) else kept
        place = lambda x: tuple((x[c] is not None, x[c]) for c in self.order)
        return new if place(other) >= place(one) else kept

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows, out = list(rows), Row(*self.key, *self.columns)
        new = [values_of(r, self.columns) for r in ordered([r for r in rows if r["tag"] == "row"], self.order)]
        if self.open.exists():
            for row in new:
                yield out(*key, *row)
            return
        kept = held(self.waiting)
        for row in new:
            kept = self.picked(kept, row)
        if any(r["tag"] == "id" for r in rows):
            self.open.update((True,))
            self.waiting.clear()
            if kept is not None:
                yield out(*key, *kept)
        elif new:
            self.waiting.update(kept)

    def close(self) -> None:
        pass


def gate(df: DataFrame, ids: DataFrame, column: str, order: Sequence[str], later: Callable[[dict, dict], bool] | None = None, ttl_ms: int | None = None) -> DataFrame:
    """df's rows whose column is among the ids (a stream with that column). later: whether the second row replaces the first while they wait."""
    columns = [c for c in df.columns if c != column]
    both = df.withColumn("tag", F.lit("row")).unionByName(ids.select(column).withColumn("tag", F.lit("id")), allowMissingColumns=True)
    return run(both, [column], Gate([column], list(order), columns, struct_of(df, columns), later, ttl_ms), struct_of(df, [column, *columns]), ttl_ms is not None)


class LiveAggregate(StatefulProcessor):
    """Any aggregations by key with retraction, published as changes of the last published row.

    Without an interval each micro-batch publishes. With one, a change of a key arms a timer unless one is armed; later
    changes coalesce, and the timer publishes. A key whose rows are all retracted goes, state and all.
    """

    def __init__(self, key, order, aggs, state, results, interval_ms, ttl_ms):
        self.key, self.order, self.aggs, self.state, self.results, self.interval, self.ttl = key, order, aggs, state, results, interval_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", StructType([StructField("live", LongType()), *self.state]), self.ttl)
        self.published = handle.getValueState("published", self.results, self.ttl)
        self.armed = handle.getValueState("armed", "at long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        live, *values = held(self.now) or (0, *[None] * len(self.aggs))
        for row in ordered(rows, self.order):
            retract = row[OP] in (BEFORE, DELETE)
            live += -1 if retract else 1
            values = [agg.init(row[c], retract) if old is None else agg.update(row[c], old, retract) for old, (c, agg) in zip(values, self.aggs.items(), strict=True)]
        if live or not all(agg.nothing(x) for x, agg in zip(values, self.aggs.values(), strict=True)):
            self.now.update((live, *values))
        else:
            self.now.clear()
        if not self.interval:
            yield from self.publish(key)
        elif not self.armed.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.interval
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.armed.clear()
        yield from self.publish(key)

    def publish(self, key) -> Iterator[Row]:
        live, *values = held(self.now) or (0,)
        old = held(self.published)
        new = tuple(agg.result(x) for x, agg in zip(values, self.aggs.values(), strict=True)) if live > 0 else None
        if old == new:
            return
        out = Row(*self.key, OP, *self.aggs)
        if old is not None:
            yield out(*key, DELETE if new is None else BEFORE, *old)
        if new is None:
            self.published.clear()
        else:
            yield out(*key, INSERT if old is None else AFTER, *new)
            self.published.update(new)

    def close(self) -> None:
        pass


def live_aggregate(changes: DataFrame, key: Sequence[str], aggs: dict[str, tuple[str, Aggregation]], order: Sequence[str] = (), interval_ms: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """As aggregates.aggregate, live: key, op and one column for each output name of aggs (input column, aggregation)."""
    if clash := {*aggs} & {*key, *order, OP}:
        raise ValueError(f"output names are taken: {sorted(clash)}")
    rows = changes.select(*key, *[c for c in order if c not in key], OP, *[agg.prepare(F.col(c)).alias(name) for name, (c, agg) in aggs.items()])
    kept = {name: agg for name, (_, agg) in aggs.items()}
    state = StructType([StructField(name, agg.state_type(rows.schema[name].dataType)) for name, agg in kept.items()])
    results = StructType([StructField(name, agg.result_type(rows.schema[name].dataType)) for name, agg in kept.items()])
    schema = StructType([*struct_of(rows, key), StructField(OP, StringType()), *results])
    return run(rows, key, LiveAggregate(list(key), list(order), kept, state, results, interval_ms, ttl_ms), schema, bool(interval_ms) or ttl_ms is not None)


def live_grouping_sets(changes: DataFrame, sets: Sequence[Sequence[str]], dims: Sequence[str], aggs: dict[str, tuple[str, Aggregation]], order: Sequence[str] = (), interval_ms: int = 0) -> DataFrame:
    """As aggregates.grouping_sets_of_changes, live: dims and gset make the key."""
    return live_aggregate(of_each_set(changes, sets, dims), [*dims, "gset"], aggs, order, interval_ms)


def throttled_sums(changes: DataFrame, key: Sequence[str], fields: Sequence[str], interval_ms: int = 0, digits: int | None = None) -> DataFrame:
    return live_aggregate(changes, key, {c: (c, Sum(digits)) for c in fields}, interval_ms=interval_ms)


class BatchLines(StatefulProcessor):
    """The latest batch and position of a uid as live lines, by issuer and place in the batch."""

    def __init__(self, key, order, position, line, types, ttl_ms):
        self.key, self.order, self.position, self.line, self.types, self.ttl = key, order, position, line, types, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.positions = handle.getValueState("position", self.types[0], self.ttl)
        self.lines = handle.getMapState("lines", "place int", self.types[1], self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        position_before = held(self.positions)
        before = {tuple(k)[0]: tuple(map(as_in_rows, v)) for k, v in self.lines.iterator()}
        position, lines = position_before, before
        for row in ordered(rows, self.order):
            if row["tag"] == "position":
                position = values_of(row, self.position)
            else:
                lines = {i: values_of(x, self.line) for i, x in enumerate(row["lines"] or [])}
        if position is not None and position != position_before:
            self.positions.update(position)
        for i in before.keys() - lines.keys():
            self.lines.removeKey((i,))
        for i, x in lines.items():
            if before.get(i) != x:
                self.lines.updateValue((i,), x)
        out, gone, new = Row(*self.key, "place", OP, *self.position, *self.line), [], []
        for i in sorted(before.keys() | lines.keys()):
            old = (*position_before, *before[i]) if position_before is not None and i in before else None
            now = (*position, *lines[i]) if position is not None and i in lines else None
            if old != now:
                issuer = len(self.position)  # a line that moves to another issuer goes there and comes here
                moves = old is not None and now is not None and old[issuer] != now[issuer]
                if old is not None:
                    gone.append(out(*key, i, DELETE if now is None or moves else BEFORE, *old))
                if now is not None:
                    new.append(out(*key, i, INSERT if old is None or moves else AFTER, *now))
        yield from gone  # all retractions come before all additions
        yield from new

    def close(self) -> None:
        pass


def batch_lines(batches: DataFrame, positions: DataFrame, key: Sequence[str], order: Sequence[str], lines: str, ttl_ms: int | None = None, mode: str = "update") -> DataFrame:
    """Line changes of batches (key, order, array of line structs whose first field is the issuer) and positions (key, order, columns)."""
    position = [c for c in positions.columns if c not in (*key, *order)]
    line = batches.schema[lines].dataType.elementType
    both = batches.select(*key, *order, F.col(lines).alias("lines"), F.lit("batch").alias("tag")).unionByName(positions.withColumn("tag", F.lit("position")), allowMissingColumns=True)
    schema = StructType([*struct_of(batches, key), *StructType.fromDDL(f"place int, {OP} string"), *struct_of(positions, position), *line])
    return run(both, key, BatchLines(list(key), list(order), position, line.names, (struct_of(positions, position), line), ttl_ms), schema, ttl_ms is not None, mode)


def live_risk_lines(batches: DataFrame, positions: DataFrame, issuers: DataFrame, key: Sequence[str], order: Sequence[str], lines: str, issuer: str) -> DataFrame:
    """As joins.risk_lines, live: line changes joined with issuers (issuer, order, op and columns).

    An update of an issuer gives changes of all its live lines: they are the state of that issuer's key, so no other
    state is searched. To be written in append mode, as one live operator follows another.
    """
    held = batch_lines(batches, positions, key, order, lines, mode="append")
    return live_join(held, issuers, [issuer], [*key, "place"], order, mode="append")
