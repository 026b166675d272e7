"""The scalar expressions of the flows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utilization(exposure: Column, threshold: Column) -> Column:
    """Per cent of a limit; null where the limit is zero."""
    return F.lit(100.0) * F.abs(F.try_divide(exposure, threshold))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def threshold_of(thresholds: Column, measure: str) -> Column:
    """Null for a measure that has no limit."""
    return thresholds[measure]


def known(value: Column, allowed: tuple[str, ...]) -> Column:
    """value if it is one of the allowed names, else null."""
    return F.when(value.isin(*allowed), value)


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the parts and the seed alone."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
