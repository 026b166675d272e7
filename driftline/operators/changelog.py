"""Relations as changelogs: rows with an op (+I, -U, +U, -D), their weights, and the ways between modes.

A changelog is a DataFrame with the column op. Where order matters it is given by columns, never by arrival; pass enough
of them for a total order within a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import AFTER, BEFORE, DELETE, INSERT, OP, WEIGHT


@dataclass(frozen=True)
class Relation:
    """A DataFrame with its mode (append, changelog, keyed), primary key and order; df is the escape hatch.

    The mode says what the ops mean: only inserts; all changes, each with the row before; or upserts and deletes.
    """

    df: DataFrame
    mode: str = "append"
    key: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def select(self, *columns: Column | str) -> Relation:
        return replace(self, df=self.df.select(*columns, *([OP] if OP not in columns and "*" not in columns else [])))

    def where(self, condition: Column | str) -> Relation:
        return replace(self, df=self.df.filter(condition))

    def name(self, label: str) -> Relation:
        """Named in plans; jobs that are started afterwards have the label as their description."""
        self.df.sparkSession.sparkContext.setJobDescription(label)
        return replace(self, df=self.df.alias(label))

    def keyed_by(self, *key: str, order: Sequence[str]) -> Relation:
        """Rows as upserts by a primary key, in an order."""
        return replace(self, df=to_keyed(self.df), mode="keyed", key=tuple(key), order=tuple(order))

    def changelog(self, suppress_equal: bool = False) -> Relation:
        """As all changes; a relation without a key only has inserts, which are that already."""
        if self.mode == "keyed":
            return replace(self, df=to_changelog(self.df, self.key, self.order, suppress_equal), mode="changelog")
        return replace(self, mode="changelog")

    def keyed(self) -> Relation:
        if not self.key:
            raise ValueError("a keyed relation needs a primary key")
        return replace(self, df=to_keyed(self.df), mode="keyed")

    def append(self) -> Relation:
        """Additions only, as inserts."""
        return replace(self, df=to_append(self.df), mode="append", key=())

    def snapshot(self) -> DataFrame:
        """The rows that the changes lead to, all rows where there is no key."""
        return materialize(self.df, self.key, self.order) if self.key else to_append(self.df).drop(OP)


def from_rows(df: DataFrame, **columns: Column) -> Relation:
    """An append relation of the given columns (all, if none are given)."""
    df = df.select(*[c.alias(n) for n, c in columns.items()]) if columns else df
    return Relation(df.withColumn(OP, F.lit(INSERT)))


def weight(op: Column | str = OP) -> Column:
    """-1 for rows that retract, 1 for rows that add."""
    op = F.col(op) if isinstance(op, str) else op
    return F.when(op.isin(BEFORE, DELETE), F.lit(-1)).otherwise(F.lit(1))


def with_weight(df: DataFrame) -> DataFrame:
    return df.withColumn(WEIGHT, weight())


def to_append(df: DataFrame) -> DataFrame:
    """Additions only, as inserts; deletes are dropped."""
    return df.filter(F.col(OP).isin(INSERT, AFTER)).withColumn(OP, F.lit(INSERT))


def to_keyed(df: DataFrame) -> DataFrame:
    """Upserts (+U) and deletes only."""
    return df.filter(F.col(OP) != BEFORE).withColumn(OP, F.when(F.col(OP) == INSERT, AFTER).otherwise(F.col(OP)))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. Rows are reduced before they are shuffled; select the columns that are needed before."""
    rest = [c for c in df.columns if c not in key and c not in order]
    last = [F.col(c) for c in order if c not in key]
    if rest:  # the order's columns are carried once
        best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
        top = F.max(F.struct(*order)).alias("_order")
        out = df.groupBy(*key).agg(best, top) if last else df.groupBy(*key).agg(best)
    else:
        out = df.groupBy(*key).agg(F.max(F.struct(*order)).alias("_order"))
    place = lambda c: F.col(c) if c in key else F.col(f"_row.{c}" if c in rest else f"_order.{c}").alias(c)
    return out.select(*map(place, df.columns))


def materialize(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The snapshot that a keyed changelog leads to: each key's last row, unless that is a retraction."""
    last = latest(changes.filter(F.col(OP) != BEFORE), key, order)
    return last.filter(F.col(OP).isin(INSERT, AFTER)).drop(OP)


def to_changelog(changes: DataFrame, key: Sequence[str], order: Sequence[str], suppress_equal: bool = False) -> DataFrame:
    """Upserts and deletes as +I, -U with the row before, +U, and -D with the row that was there.

    A delete without a live row gives nothing, and what follows a delete is an insert. suppress_equal: an upsert that
    changes nothing but its order gives nothing.
    """
    values = [c for c in changes.columns if c not in (*key, *order, OP)]
    ordered = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(F.struct(OP, *values)).over(ordered)
    rows = changes.filter(F.col(OP) != BEFORE).withColumn("_before", before)
    live = F.col("_before").isNotNull() & (F.col(f"_before.{OP}") != DELETE)
    deletes = F.col(OP) == DELETE
    old = lambda op: F.struct(F.lit(op).alias(OP), *[F.col(f"_before.{c}").alias(c) for c in values])
    new = lambda op: F.struct(F.lit(op).alias(OP), *values)
    none = F.array().cast("array<struct<" + f"{OP}:string" + "".join(f",`{c}`:{t}" for c, t in changes.dtypes if c in values) + ">>")
    out = F.when(deletes & live, F.array(old(DELETE))).when(deletes, none).when(live, F.array(old(BEFORE), new(AFTER))).otherwise(F.array(new(INSERT)))
    if suppress_equal:
        same = F.struct(*values).eqNullSafe(F.struct(*[F.col(f"_before.{c}") for c in values]))
        out = F.when(live & ~deletes & same, none).otherwise(out)
    return rows.select(*key, *order, F.explode(out).alias("_c")).select(*key, *order, "_c.*")


def changed(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows that differ in values from the row before of their key; first rows always count."""
    ordered = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(F.struct(*values)).over(ordered)
    return df.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.struct(*values).eqNullSafe(F.col("_before"))).drop("_before")


def diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The changelog from one snapshot to another: +I, -D, and -U, +U where rows of a key differ."""
    values = [c for c in new.columns if c not in key]
    on = old.select(*key, F.struct(*values).alias("_old")).join(new.select(*key, F.struct(*values).alias("_new")), list(key), "full")
    one = lambda op, side: F.struct(F.lit(op).alias(OP), F.col(side).alias("_v"))
    out = F.when(F.col("_old").isNull(), F.array(one(INSERT, "_new"))).when(F.col("_new").isNull(), F.array(one(DELETE, "_old"))).otherwise(F.array(one(BEFORE, "_old"), one(AFTER, "_new")))
    changes = on.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(*key, F.explode(out).alias("_c"))
    return changes.select(*key, f"_c.{OP}", "_c._v.*")


def concatenated(*parts: DataFrame) -> DataFrame:
    """Relations one after another: seq tells which comes first."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("seq", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def tagged_union(**parts: DataFrame) -> DataFrame:
    """Relations of different columns as one, with a tag."""
    out = None
    for tag, part in parts.items():
        part = part.withColumn("tag", F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
