"""Readers for coupon logs kept as CSV or parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column names of the contest files.
_RECEIPT_FIELDS = [
    T.StructField("User_id", T.LongType(), False),
    T.StructField("Merchant_id", T.LongType(), False),
    T.StructField("Coupon_id", T.LongType()),
    T.StructField("Discount_rate", T.StringType()),
    T.StructField("Distance", T.IntegerType()),
    T.StructField("Date_received", T.StringType()),
]
SCORING_SCHEMA = T.StructType(_RECEIPT_FIELDS)
RECEIPT_SCHEMA = T.StructType([*_RECEIPT_FIELDS, T.StructField("Date", T.StringType())])


def _typed(frame: DataFrame, with_purchase: bool) -> DataFrame:
    columns = [
        F.col("User_id").alias("user_id"),
        F.col("Merchant_id").alias("merchant_id"),
        F.col("Coupon_id").alias("coupon_id"),
        F.col("Discount_rate").alias("discount_raw"),
        F.col("Distance").alias("distance"),
        F.try_to_date(F.col("Date_received"), "yyyyMMdd").alias("date_received"),
    ]
    if with_purchase:
        columns.append(F.try_to_date(F.col("Date"), "yyyyMMdd").alias("date_used"))
    return frame.select(*columns)


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Read a receipts-and-purchases CSV; ``null`` and empty both mean null."""
    frame = spark.read.schema(RECEIPT_SCHEMA).csv(path, header=True, nullValue="null", mode="FAILFAST")
    return _typed(frame, with_purchase=True)


def read_scoring(spark: SparkSession, path: str) -> DataFrame:
    """Read a scoring CSV, which has no purchase date; it is added as null."""
    frame = spark.read.schema(SCORING_SCHEMA).csv(path, header=True, nullValue="null", mode="FAILFAST")
    return _typed(frame, with_purchase=False).withColumn("date_used", F.lit(None).cast("date"))


#: Column that takes the text of a line the CSV parser cannot read whole.
_BROKEN = "_broken_line"


def read_with_rejects(spark: SparkSession, path: str, with_purchase: bool = True, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of a receipts CSV (or, without purchases, of a scoring CSV), and its rejected lines.

    Rejects have the ``line`` and a ``reason``: ``fields`` (too few or too many, or
    text where a number belongs), ``key`` (no user or merchant) or ``date`` (a date
    that is none); the first that applies.  A line of the second and third kind is
    put together again from its fields.  Every line is in exactly one of the two.
    Both read the file when they are used; write them if it may change between.
    """
    schema = RECEIPT_SCHEMA if with_purchase else SCORING_SCHEMA
    # All columns are parsed whatever a query needs, so that it does not decide which lines are broken.
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])).option("columnPruning", False)
    frame = reader.csv(path, header=header, nullValue="null", mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN)
    dates = [c for c in ("Date_received", "Date") if c in frame.columns]
    wrong = [F.col(c).isNotNull() & F.try_to_date(F.col(c), "yyyyMMdd").isNull() for c in dates]
    no_date = wrong[0] | wrong[-1]
    reason = (
        F.when(F.col(_BROKEN).isNotNull(), "fields")
        .when(F.col("User_id").isNull() | F.col("Merchant_id").isNull(), "key")
        .when(no_date, "date")
    )
    judged = frame.withColumn("reason", reason)
    again = F.array_join(F.array(*[F.col(f.name).cast("string") for f in schema.fields]), ",", "null")
    rows = _typed(judged.where(F.col("reason").isNull()), with_purchase)
    if not with_purchase:
        rows = rows.withColumn("date_used", F.lit(None).cast("date"))
    return rows, judged.where(F.col("reason").isNotNull()).select(F.coalesce(_BROKEN, again).alias("line"), "reason")


def read_online(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an online-channel CSV.  Its columns are the caller's to name."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="null", mode="FAILFAST")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a staged parquet table."""
    return spark.read.parquet(path)


def with_row_id(rows: DataFrame) -> DataFrame:
    """Number the rows so that exact copies stay apart.

    Ids are unique and need no shuffle.  They depend on how the files are
    split, so mint them once and keep them: write the table with its ids.
    """
    return rows.withColumn("row_id", F.monotonically_increasing_id().cast("string"))
