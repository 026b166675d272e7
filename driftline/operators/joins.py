"""Joins of live relations, as joins of what their changelogs lead to.

The right side's columns replace the left's columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changelog import latest

#: Estimated bytes up to which a side is broadcast.
BROADCAST_BYTES = 64 << 20
#: How much larger than its files a relation may be that has been read and got some columns by joins.
BOUND_FACTOR = 8


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES, bound: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if its size is within the limit.

    The size is the optimizer's estimate, which for joins is the product of their sides. bound: a relation that has at
    least as many rows, such as the scan that df only filters or joins many to one; then its size times BOUND_FACTOR counts.
    """
    size = estimated_bytes(df) if bound is None else BOUND_FACTOR * estimated_bytes(bound)
    return F.broadcast(df) if size <= limit else df


def _merged(left: DataFrame, right: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns and c not in key]
    return left.drop(*shared).join(right, list(key), how)


def many_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], left_key: Sequence[str] = (), left_order: Sequence[str] = (), right_order: Sequence[str] = (), combine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each left row (the latest of its primary key, if given) with the latest right row of its join key; inner."""
    left = latest(left, left_key, left_order) if left_key else left
    right = latest(right, key, right_order) if right_order else right
    out = _merged(left, right, key, "inner")
    return combine(out) if combine else out


def one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], left_order: Sequence[str] = (), right_order: Sequence[str] = (), combine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The latest rows of both sides; inner."""
    return many_to_one(left, right, key, key if left_order else (), left_order, right_order, combine)


def multi_left(left: DataFrame, rights: Sequence[DataFrame], key: Sequence[str], orders: Sequence[Sequence[str]] = ()) -> DataFrame:
    """left with the latest row of each right relation, null where there is none; all share the key, so left is shuffled once."""
    for i, right in enumerate(rights):
        left = _merged(left, latest(right, key, orders[i]) if orders and orders[i] else right, key, "left")
    return left


def gate(df: DataFrame, ids: DataFrame, column: str, id_column: str, key: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Rows (the latest of each key, if given) whose column has ever been among the ids."""
    df = latest(df, key, order) if key else df
    return df.join(ids.select(F.col(id_column).alias(column)), column, "left_semi")


def risk_lines(batches: DataFrame, positions: DataFrame, issuers: DataFrame, uid: Sequence[str], issuer: str, lines: str, issuer_id: str, batch_order: Sequence[str] = (), position_order: Sequence[str] = (), issuer_bound: DataFrame | None = None) -> DataFrame:
    """The latest batch and position of each uid, a row for each line of the batch, with the line's issuer; inner. issuer_bound: as in small()."""
    batches = latest(batches, uid, batch_order) if batch_order else batches
    positions = latest(positions, uid, position_order) if position_order else positions
    one = _merged(positions, batches, uid, "inner")
    kept = [c for c in one.columns if c != lines]
    exploded = one.select(*kept, F.posexplode(lines).alias("line", "_l")).select(*kept, "line", "_l.*")
    return _merged(exploded, small(issuers.withColumnRenamed(issuer_id, issuer), bound=issuer_bound), [issuer], "inner")


def two_dimensions(facts: DataFrame, accounts: DataFrame, issuers: DataFrame, account: str, issuer: str) -> DataFrame:
    """Facts for which both dimensions are known."""
    return _merged(_merged(facts, small(accounts), [account], "inner"), small(issuers), [issuer], "inner")


def default_parent(parent: Column | str, own: Column | str) -> Column:
    """The ultimate parent, or the entity itself."""
    return F.coalesce(parent, own)
