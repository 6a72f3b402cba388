"""A coupon log derived from the ``lineitem`` and ``orders`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_DAYS = 213
LOG_START = "2016-01-01"


def coupon_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, read as a receipt or a purchase.

    ``row_id`` joins the four line columns that are unique together, since
    exact copies of the seven log columns are legal.
    """
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    percent = F.round(F.col("l_discount") * 100).cast("int")
    merchant = F.col("l_suppkey") % 40
    day = F.date_add(
        F.lit(LOG_START).cast("date"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % LOG_DAYS,
    )
    base = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        merchant.alias("merchant_id"),
        percent.alias("pct"),
        F.when(merchant % 3 == 0, 50).when(merchant % 3 == 1, 100).otherwise(200).alias("man"),
        (F.col("l_partkey") % 12).cast("int").alias("band"),
        F.col("l_returnflag").alias("flag"),
        day.alias("day"),
        (F.col("l_quantity").cast("int") % 25).alias("gap"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
    )
    with_coupon = F.col("pct") != 0
    threshold = F.concat_ws(":", F.col("man").cast("string"), F.col("pct").cast("string"))
    rate = F.concat(F.lit("0."), (100 - F.col("pct")).cast("string"))
    return base.select(
        "user_id",
        "merchant_id",
        F.when(with_coupon, F.col("merchant_id") * 100 + F.col("pct")).alias("coupon_id"),
        F.when(with_coupon, F.when(F.col("pct") % 2 == 0, threshold).otherwise(rate)).alias("discount_raw"),
        F.when(F.col("band") != 11, F.col("band")).alias("distance"),
        F.when(with_coupon, F.col("day")).alias("date_received"),
        F.when(~with_coupon, F.col("day"))
        .when(F.col("flag") == "R", F.date_add(F.col("day"), F.col("gap")))
        .alias("date_used"),
        "row_id",
    )


def scoring_log(log: DataFrame, since: str = "2016-07-01") -> DataFrame:
    """Receipts from ``since`` on with the purchase date taken away."""
    return log.where(F.col("date_received") >= F.lit(since).cast("date")).drop("date_used")
