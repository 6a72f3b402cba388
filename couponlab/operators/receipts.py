"""Receipt-order features within a user and coupon.

The order of receipts matters by day only, so receipts are first reduced to one
row per user, coupon and day; a window over those holds at most one row per
calendar day, whatever the number of receipts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponlab.operators import skew
from couponlab.operators.counts import COUPON_REPEAT, MERCHANT_REPEAT, attach_repeats

SEQUENCE_COLUMNS = [
    "this_month_user_receive_same_coupon_lastone",
    "this_month_user_receive_same_coupon_firstone",
    "is_first_receipt",
    "day_gap_before",
    "day_gap_after",
    "gap_sum",
    "gap_mean",
]


(_REPEATED,) = COUPON_REPEAT


def _by_day(rows: DataFrame, within: Sequence[str]) -> DataFrame:
    """Receipts with the columns of their user, coupon and day.

    Days are counted before they are shuffled, and a group of days is bounded
    by the calendar.  The window's partitioning is not that of the join, so
    the join shuffles both sides itself and adaptive execution can split a
    day with very many copies.
    """
    group = [*within, "user_id", "coupon0"]
    days = rows.groupBy(*group, "date_received").agg(F.count(F.lit(1)).alias("receipts"))
    day = F.unix_date("date_received")
    whole = Window.partitionBy(*group)
    ordered = whole.orderBy("date_received")
    first, last = F.min(day).over(whole), F.max(day).over(whole)
    columns = {
        _REPEATED: (F.col("receipts") > 1).cast("int"),
        "this_month_user_receive_same_coupon_lastone": (day == last).cast("int"),
        # Kept as it is defined: the complement of the column above.
        "this_month_user_receive_same_coupon_firstone": (day != last).cast("int"),
        "is_first_receipt": (day == first).cast("int"),
        "day_gap_before": F.coalesce(day - F.lag(day).over(ordered), F.lit(-1)),
        "day_gap_after": F.coalesce(F.lead(day).over(ordered) - day, F.lit(-1)),
        # Gaps between neighbours add up to the span.
        "gap_sum": last - first,
        "gap_mean": (last - first) / F.sum("receipts").over(whole),
    }
    return rows.join(days.withColumns(columns).drop("receipts"), [*group, "date_received"], "left")


def attach_sequence(rows: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Add the receipt-order columns to receipts (``date_received`` present)."""
    return _by_day(rows, within).drop(_REPEATED)


def attach_receipt_features(rows: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Receipt order and both same-day repeat flags."""
    return attach_repeats(_by_day(rows, within), MERCHANT_REPEAT, within, source=rows)


def first_dates(*logs: DataFrame) -> DataFrame:
    """Earliest receipt of each coupon over all ``logs``; null if never received.

    Purchases without coupon form group 0.
    """
    united = None
    for log in logs:
        part = log.select(F.coalesce("coupon_id", F.lit(0)).cast("bigint").alias("coupon0"), "date_received")
        united = part if united is None else united.unionByName(part)
    return united.groupBy("coupon0").agg(F.min("date_received").alias("first_date_received"))


def attach_first_receipt(rows: DataFrame, firsts: DataFrame, hot_coupons: DataFrame | None = None) -> DataFrame:
    """Add ``is_first_date_received``: received on the coupon's first day."""
    joined = skew.join_entities(rows, firsts, ["coupon0"], hot_coupons)
    same_day = F.coalesce(F.col("date_received") == F.col("first_date_received"), F.lit(False))
    return joined.withColumn("is_first_date_received", same_day.cast("int")).drop("first_date_received")
