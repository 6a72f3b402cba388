"""Column expressions over the discount text.

The text is a rate (``0.9``), a threshold coupon (``100:10``: spend 100, get
10 off) or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has_threshold(raw: Column) -> Column:
    return F.coalesce(F.contains(raw, F.lit(":")), F.lit(False))


def _part(raw: Column, position: int, dtype: str) -> Column:
    return F.substring_index(raw, ":", 1 if position == 1 else -1).try_cast(dtype)


def is_manjian(raw: Column) -> Column:
    """1 for a threshold coupon, else 0 (null counts as 0)."""
    return _has_threshold(raw).cast("int")


def discount_rate(raw: Column, default: float | None = 1.0) -> Column:
    """Share of the price still paid; ``default`` stands in for null."""
    spend, off = _part(raw, 1, "double"), _part(raw, 2, "double")
    rate = F.when(_has_threshold(raw), F.try_divide(spend - off, spend)).otherwise(raw.try_cast("double"))
    return rate if default is None else F.coalesce(rate, F.lit(default))


def converted_rate(raw: Column) -> Column:
    """The same rate in the ``1 - off/spend`` form; null counts as 1.0."""
    spend, off = _part(raw, 1, "double"), _part(raw, 2, "double")
    rate = F.when(_has_threshold(raw), 1 - F.try_divide(off, spend)).otherwise(raw.try_cast("double"))
    return F.coalesce(rate, F.lit(1.0))


def spend_threshold(raw: Column, default: int = -1) -> Column:
    """Amount to spend, ``default`` where there is no threshold."""
    return F.coalesce(F.when(_has_threshold(raw), _part(raw, 1, "int")), F.lit(default))


def reduction(raw: Column, default: int = -1) -> Column:
    """Amount taken off, ``default`` where there is no threshold."""
    return F.coalesce(F.when(_has_threshold(raw), _part(raw, 2, "int")), F.lit(default))


def discount_type(raw: Column) -> Column:
    """1 threshold, 0 rate, null when there is no discount."""
    return F.when(raw.isNotNull(), is_manjian(raw))


def reduction_share(raw: Column) -> Column:
    """Reduction over threshold, 0 for plain rates and null."""
    spend, off = _part(raw, 1, "double"), _part(raw, 2, "double")
    return F.coalesce(F.when(_has_threshold(raw), F.try_divide(off, spend)), F.lit(0.0))
