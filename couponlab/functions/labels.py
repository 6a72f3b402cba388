"""Redemption labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDEEM_DAYS = 15


def gap_days(date_received: Column, date_used: Column) -> Column:
    """Days from receipt to purchase, null when either is missing."""
    return F.datediff(date_used, date_received)


def redeemed(date_received: Column, date_used: Column) -> Column:
    """1 when bought at most 15 days after receipt, else 0.

    There is no lower bound: a purchase before the receipt scores 1.
    """
    within = gap_days(date_received, date_used) <= REDEEM_DAYS
    return F.coalesce(within, F.lit(False)).cast("int")


def redeemed_or_no_receipt(date_received: Column, date_used: Column) -> Column:
    """-1 without a receipt, otherwise the 15-day label."""
    return F.when(date_received.isNull(), F.lit(-1)).otherwise(redeemed(date_received, date_used))


def purchase_quadrant(coupon_id: Column, date_used: Column) -> Column:
    """-1 bought without coupon, 1 coupon used, 0 coupon unused, -2 neither."""
    return (
        F.when(coupon_id.isNull() & date_used.isNotNull(), F.lit(-1))
        .when(coupon_id.isNotNull() & date_used.isNotNull(), F.lit(1))
        .when(coupon_id.isNotNull(), F.lit(0))
        .otherwise(F.lit(-2))
    )
