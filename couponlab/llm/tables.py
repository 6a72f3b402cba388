"""Tables written between steps, and rows handled in Arrow batches.

A written table cuts the lineage: steps behind it read it back, however many
executors have been lost since.  Tables go below ``spark.checkpoint.dir``, which
is shared storage on a cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from couponlab.session import fresh_path, scratch

#: Name of the column that tells rows apart, repeated ones too.
ROW = "__row"

#: Shuffle files go at the end of the query that wrote them, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """While inside, a query's shuffle files are removed as soon as it has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``rows`` as a parquet table of its own, read back."""
    spark = rows.sparkSession
    path = path or fresh_path(spark, name)
    with shuffles_dropped(spark):
        rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame], path: str | None = None) -> DataFrame:
    """What ``make`` returns as a table, read back; the tables written on the way to it are removed."""
    path = path or fresh_path(spark, name)
    with scratch(spark):
        return written(make(), name, path)


def numbered(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns behind a row number.  The number is stable only in a table that is written next."""
    return rows.select(F.monotonically_increasing_id().alias(ROW), *columns)


def set_aside(rows: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``rows`` with columns of these names renamed, and the columns that bring the rows back as they were."""
    hidden = {c: f"__own_{c}" for c in rows.columns if c in names}
    return rows.withColumnsRenamed(hidden), [F.col(hidden.get(c, c)).alias(c) for c in rows.columns]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def running_starts(lengths: Column) -> Column:
    """For each length the sum of those before it.

    Sums run within pieces of 256 and over the pieces, so a long array takes little more than linear time.
    """

    def over(v):
        pieces = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.shiftright(F.size(v) - 1, 8))).otherwise(
            F.array().cast("array<int>")
        )
        totals = F.transform(pieces, lambda c: total(F.slice(v, c * 256 + 1, F.lit(256))))

        def within(bases):
            def start(x, i):
                piece = F.shiftright(i, 8)
                return F.get(bases, piece) + total(F.slice(v, piece * 256 + 1, i.bitwiseAND(F.lit(255))))

            return F.transform(v, start)

        return bound(totals, lambda t: bound(F.transform(pieces, lambda c: total(F.slice(t, F.lit(1), c))), within))

    return bound(lengths.cast("array<bigint>"), over)
