"""Table profiles and small relational reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponlab.functions import fields


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def null_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: whether it has nulls, and their share.  One scan."""
    shares = rows.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_ratio")) for c in columns])
    return shares.select(F.inline(pairs)).select(
        "column_name", (F.col("null_ratio") > 0).cast("int").alias("has_null"), "null_ratio"
    )


def value_domain(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def quadrants(rows: DataFrame) -> DataFrame:
    """Row counts by receipt and purchase; four rows, absent ones with 0."""
    received, used = fields.received(), fields.used()
    counted = rows.agg(
        F.count_if(received & used).alias("yes_yes"),
        F.count_if(received & ~used).alias("yes_no"),
        F.count_if(~received & used).alias("no_yes"),
        F.count_if(~received & ~used).alias("no_no"),
    )
    cells = [("yes_yes", 1, 1), ("yes_no", 1, 0), ("no_yes", 0, 1), ("no_no", 0, 0)]
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(r).alias("received"), F.lit(u).alias("used"), F.col(name).alias("rows"))
                    for name, r, u in cells
                ]
            )
        )
    )


def date_span(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.min("date_received").alias("first_received"),
        F.max("date_received").alias("last_received"),
        F.min("date_used").alias("first_used"),
        F.max("date_used").alias("last_used"),
    )


def only_in(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` present in ``left`` and absent from ``right``.

    Both sides are made distinct first, so no key is heavy in the join.
    """
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")


def shared_columns(*frames: DataFrame) -> list[str]:
    """Column names all frames have, in the order of the first."""
    return [c for c in frames[0].columns if all(c in frame.columns for frame in frames[1:])]


def preview(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows, as a look at the data."""
    return rows.limit(n)
