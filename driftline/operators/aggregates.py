"""Aggregates over changelogs: retractions count negatively, groups without live rows go."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType

from ..schemas import OP
from .changelog import weight


class Aggregation(Protocol):
    """An aggregate of one column that knows retraction: in batch by value and weight, in streams by init and update.

    prepare: what a stream gives init and update of each row. An accumulator has the state type of the prepared type,
    is never None once it holds something, and result() makes the output of it. Structs are dicts everywhere.
    """

    def batch(self, value: Column, w: Column) -> Column: ...

    def prepare(self, value: Column) -> Column: ...

    def state_type(self, prepared: DataType) -> DataType: ...

    def result_type(self, prepared: DataType) -> DataType: ...

    def init(self, value, retract: bool): ...

    def update(self, value, accumulator, retract: bool): ...

    def result(self, accumulator): ...

    def nothing(self, accumulator) -> bool: ...


class Plain:
    """What most aggregations share: values as they are, the accumulator as the result, of the same type."""

    def batch(self, value: Column, w: Column) -> Column:
        raise TypeError(f"{type(self).__name__} has only a live form")

    def prepare(self, value: Column) -> Column:
        return value

    def state_type(self, prepared: DataType) -> DataType:
        return prepared

    def result_type(self, prepared: DataType) -> DataType:
        return self.state_type(prepared)

    def result(self, accumulator):
        return accumulator

    def nothing(self, accumulator) -> bool:
        """Whether no trace of a row is left, so that the key can start anew."""
        return not accumulator


class Sum(Plain):
    """The sum of what is live; nulls are skipped. digits: exact by decimals of so many places, so that order doesn't matter."""

    def __init__(self, digits: int | None = None):
        self.digits = digits

    def batch(self, value: Column, w: Column) -> Column:
        if self.digits is None:
            return F.sum(value * w)
        return F.sum(self.prepare(value) * w).cast("double")

    def prepare(self, value: Column) -> Column:
        return value.cast("double" if self.digits is None else f"decimal(18,{self.digits})")

    def state_type(self, prepared: DataType) -> DataType:
        return DoubleType() if self.digits is None else DecimalType(38, self.digits)

    def result_type(self, prepared: DataType) -> DataType:
        return DoubleType()

    def init(self, value, retract: bool):
        return None if value is None else -value if retract else value

    def update(self, value, accumulator, retract: bool):
        step = self.init(value, retract)
        return accumulator if step is None else accumulator + step

    def result(self, accumulator):
        return None if accumulator is None else float(accumulator)


class Last(Plain):
    """The last added value by an order that must be total within a group; what it was stays when it is retracted."""

    def __init__(self, *order: str):
        self.order = order

    def batch(self, value: Column, w: Column) -> Column:
        return F.max_by(F.when(w > 0, value), F.when(w > 0, F.struct(*self.order)))

    def prepare(self, value: Column) -> Column:
        return F.struct(value.alias("value"), *[F.col(c).alias(f"order_{i}") for i, c in enumerate(self.order)])

    def result_type(self, prepared: DataType) -> DataType:
        return prepared["value"].dataType

    def init(self, value, retract: bool):
        return None if retract else value

    def update(self, value, accumulator, retract: bool):
        place = lambda x: tuple((x[f"order_{i}"] is not None, x[f"order_{i}"]) for i in range(len(self.order)))
        return accumulator if retract or place(value) < place(accumulator) else value

    def result(self, accumulator):
        return None if accumulator is None else accumulator["value"]

    def nothing(self, accumulator) -> bool:
        return True


class Rolldown(Plain):
    """The sum of step functions, arrays of (Date, JTD); its dates are those of all that were added or retracted.

    The batch form is rolldown_deltas and rolldown_sum. digits: places to which each step is rounded.
    """

    def __init__(self, digits: int = 2):
        self.unit = Decimal(1).scaleb(-digits)

    def steps(self, function: Sequence) -> dict:
        final = {date: value for date, value in sorted((x["Date"], x["JTD"]) for x in function or ())}  # the last value of a date counts
        values = [Decimal(repr(value)) for value in final.values()]
        return {date: (new - old).quantize(self.unit, ROUND_HALF_UP) for date, new, old in zip(final, values, [Decimal(0), *values[:-1]], strict=False)}

    def init(self, value, retract: bool):
        return self.update(value, [], retract)

    def update(self, value, accumulator, retract: bool):
        total = self.steps(accumulator)
        for date, step in self.steps(value).items():
            total[date] = total.get(date, Decimal(0)) + (-step if retract else step)
        dates = sorted(total)
        return [{"Date": date, "JTD": float(x)} for date, x in zip(dates, itertools.accumulate(total[date] for date in dates), strict=True)]

    def nothing(self, accumulator) -> bool:
        return not any(x["JTD"] for x in accumulator or ())


def aggregate(changes: DataFrame, dims: Sequence[str], aggs: dict[str, tuple[str, Aggregation]] | Sequence[Column], keep_empty: bool = False) -> DataFrame:
    """dims and one column for each output name of aggs (input column, aggregation), or for each given Column.

    changes may have ops; without them all rows count. Groups whose live rows are all retracted go, unless kept.
    """
    w = weight() if OP in changes.columns else F.lit(1)
    columns = [agg.batch(F.col(c), w).alias(name) for name, (c, agg) in aggs.items()] if isinstance(aggs, dict) else list(aggs)
    out = changes.groupBy(*dims).agg(*columns, F.sum(w).alias("_live"))
    names = out.columns
    if len(set(names)) < len(names):
        raise ValueError(f"output names repeat: {names}")
    return (out if keep_empty else out.filter("_live > 0")).drop("_live")


def aggregate_sums(changes: DataFrame, dims: Sequence[str], fields: Sequence[str], digits: int | None = None) -> DataFrame:
    return aggregate(changes, dims, {c: (c, Sum(digits)) for c in fields})


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], dims: Sequence[str], aggs: Sequence[Column], gset: str | None = "gset") -> DataFrame:
    """One row for each group of each set; absent dims are null, and gset (grouping id) tells them from real nulls."""
    out = df.groupingSets([[F.col(c) for c in one] for one in sets], *dims).agg(*aggs, F.grouping_id().cast("long").alias(gset or "_gset"))
    return out if gset else out.drop("_gset")


def grouping_sets_of_changes(changes: DataFrame, sets: Sequence[Sequence[str]], dims: Sequence[str], aggs: dict[str, tuple[str, Aggregation]]) -> DataFrame:
    """As grouping_sets, over a changelog: each row once for each set, then aggregated with retraction."""
    return aggregate(of_each_set(changes, sets, dims), [*dims, "gset"], aggs)


def of_each_set(changes: DataFrame, sets: Sequence[Sequence[str]], dims: Sequence[str]) -> DataFrame:
    """Each row once for each grouping set: dims that the set lacks are null, gset is the grouping id."""
    ids = [sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in one) for one in sets]
    rows = changes.withColumn("gset", F.explode(F.array(*[F.lit(i).cast("long") for i in ids])))
    for i, d in enumerate(dims):
        rows = rows.withColumn(d, F.when(F.col("gset").bitwiseAND(1 << (len(dims) - 1 - i)) == 0, F.col(d)))
    return rows


def throttled(df: DataFrame, key: Sequence[str], time: str, order: Sequence[str], interval: str) -> DataFrame:
    """What a throttle lets through: of each key and interval, the last row; bucket is the interval's start."""
    rows = df.withColumn("bucket", F.window(time, interval).start)
    rest = [c for c in rows.columns if c not in (*key, "bucket")]
    out = rows.groupBy(*key, "bucket").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(*key, "bucket", "_r.*")


def rolldown_deltas(df: DataFrame, rolldown: str, w: Column | None = None, date: str = "Date", value: str = "JTD") -> DataFrame:
    """The breakpoints of a step function as date and delta; the function is sorted first, and zero before it.

    Steps of one date add up to that of its last value, so they needn't be told apart.
    """
    others = [c for c in df.columns if c != rolldown]
    steps = df.withColumn("_s", F.sort_array(rolldown)).withColumn("_w", w if w is not None else F.lit(1))
    each = steps.select(*others, "_s", "_w", F.posexplode("_s").alias("_i", "_e")).filter(F.col("_e").isNotNull())
    before = F.coalesce(F.when(F.col("_i") > 0, F.get("_s", F.col("_i") - 1)[value]), F.lit(0.0))
    return each.select(*others, F.col(f"_e.{date}").alias("date"), (F.col("_w") * (F.col(f"_e.{value}") - before)).alias("delta"))


def rolldown_sum(deltas: DataFrame, dims: Sequence[str], delta: str = "delta", date: str = "date", digits: int | None = 2) -> DataFrame:
    """dims, date, jtd: the sum of step functions, at every date at which one of them changes."""
    value = F.col(delta) if digits is None else F.col(delta).cast(f"decimal(18,{digits})")
    by_date = deltas.groupBy(*dims, date).agg(F.sum(value).alias("_d"))
    running = F.sum("_d").over(Window.partitionBy(*dims).orderBy(date).rowsBetween(Window.unboundedPreceding, 0))
    return by_date.select(*dims, F.col(date).alias("date"), running.cast("double").alias("jtd"))


def as_rolldown(sums: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The exploded sums as one sorted array a group."""
    return sums.groupBy(*dims).agg(F.array_sort(F.collect_list(F.struct(F.col("date").alias("Date"), F.col("jtd").alias("JTD")))).alias("rolldown"))
