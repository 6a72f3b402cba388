"""Writers."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_staged(rows: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a staged table as parquet, or as CSV with a header."""
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "null").csv(path)
    else:
        writer.format(fmt).save(path)


def write_sets(sets: Mapping[str, DataFrame], path: str) -> None:
    """Write train, validate and test sets as one table partitioned by ``split``."""
    tagged = [frame.withColumn("split", F.lit(name)) for name, frame in sets.items()]
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).write.mode("overwrite").partitionBy(
        "split"
    ).parquet(path)


def write_submission(scores: DataFrame, path: str) -> None:
    """Write scores as CSV without a header, dates as ``yyyyMMdd``."""
    dated = scores.withColumn("date_received", F.date_format("date_received", "yyyyMMdd"))
    dated.select("user_id", "coupon_id", "date_received", "prob").write.mode("overwrite").option("header", False).csv(
        path
    )


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Write the predicted label only."""
    predictions.select("prediction").write.mode("overwrite").option("header", False).csv(path)
