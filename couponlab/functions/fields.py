"""Typed, null-free working columns of a coupon log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponlab.functions import discount, labels

#: Columns of a raw log, in order.  A scoring log has no ``date_used``.
RAW_COLUMNS = ["user_id", "merchant_id", "coupon_id", "discount_raw", "distance", "date_received", "date_used"]

#: Columns ``clean`` derives.
DERIVED_COLUMNS = [
    "is_manjian",
    "discount_rate",
    "min_cost_of_manjian",
    "reduce_manjian",
    "null_distance",
    "coupon0",
]


def clean(log: DataFrame) -> DataFrame:
    """Add the derived columns and fill ``distance`` with -1.

    The fill values count as values in distinct counts, minima, means and
    medians, so they are set here, before any aggregate.
    """
    raw = F.col("discount_raw")
    if "date_used" not in log.columns:
        log = log.withColumn("date_used", F.lit(None).cast("date"))
    return log.withColumns(
        {
            "is_manjian": discount.is_manjian(raw),
            "discount_rate": discount.discount_rate(raw),
            "min_cost_of_manjian": discount.spend_threshold(raw),
            "reduce_manjian": discount.reduction(raw),
            "null_distance": F.col("distance").isNull().cast("int"),
            "distance": F.coalesce(F.col("distance"), F.lit(-1)).cast("int"),
            "coupon0": F.coalesce(F.col("coupon_id"), F.lit(0)).cast("bigint"),
        }
    )


def stage(log: DataFrame) -> DataFrame:
    """The staged table: discount fields with default 0, and the 3-way label."""
    raw = F.col("discount_raw")
    return log.withColumns(
        {
            "discount_rate": discount.converted_rate(raw),
            "discount_man": discount.spend_threshold(raw, 0),
            "discount_jian": discount.reduction(raw, 0),
            "discount_type": discount.discount_type(raw),
            "distance": F.coalesce(F.col("distance"), F.lit(-1)).cast("int"),
            "label": labels.redeemed_or_no_receipt(F.col("date_received"), F.col("date_used")),
        }
    )


def received():
    return F.col("date_received").isNotNull()


def used():
    return F.col("date_used").isNotNull()


def with_label(rows: DataFrame) -> DataFrame:
    """Add the 15-day ``label``."""
    return rows.withColumn("label", labels.redeemed(F.col("date_received"), F.col("date_used")))
