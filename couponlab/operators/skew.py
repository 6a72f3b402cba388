"""Hot keys: finding them and joining around them.

A key is hot when it has more rows than one task should sort or join.  Hot
keys are found by one aggregate that reads the key columns only, and are kept
as a table with their row counts, however many there are.  The list decides
only *how* a row is processed, never whether, so results do not depend on it;
how it is joined is left to Spark, which knows its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponlab.session import stored

#: Rows of one key a single task handles comfortably.
HOT_ROWS = 1_000_000


#: Rows that a task sorts or counts, key by key, where tasks are dealt by their number of rows.
TASK_ROWS = 150_000
#: Rows of a table of entities that is sent to all tasks.
SMALL_TABLE = 20_000


def tasks(rows: DataFrame) -> int:
    """Tasks for all rows, TASK_ROWS each; few rows are still spread over the cores.  Counts the rows, so give a written table."""
    n, slots = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // TASK_ROWS), min(slots, n // 10_000))


def hot_keys(rows: DataFrame, keys: list[str], floor: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``floor`` rows and their ``rows_of_key``, or None when there are none."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_of_key")).where(F.col("rows_of_key") > floor)
    found = stored(counted, "hot-keys")
    return None if found.isEmpty() else found


def hot_ids(rows: DataFrame, columns: list[str], floor: int = HOT_ROWS) -> dict[str, DataFrame | None]:
    """Hot values of several bigint columns, found in one pass.

    A value that is not hot in a log is not hot in any window of it, so one
    call serves every window.
    """
    tagged = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("id")) for c in columns]))
    counted = rows.select(tagged).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("rows_of_key"))
    heavy = stored(counted.where(F.col("rows_of_key") > floor), "hot-keys")
    kinds = {row["kind"] for row in heavy.select("kind").distinct().collect()}
    return {
        column: heavy.where(F.col("kind") == column).select(F.col("id").alias(column), "rows_of_key") if column in kinds else None
        for column in columns
    }


def split_hot(rows: DataFrame, keys: list[str], hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of hot keys (None when there are none)."""
    if hot is None:
        return rows, None
    return rows.join(hot, keys, "left_anti"), rows.join(hot, keys, "left_semi")


def left_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], hot: DataFrame | None = None, share: int = HOT_ROWS // 4
) -> DataFrame:
    """Left join to a table with one row per ``keys``; ``hot`` is keyed by some of them.

    Rows of a hot key are spread by a hash of the row, as thin as ``share``
    rows to a salt by the key's counted rows, and its lookup row is repeated
    for each salt; all other rows keep salt 0.  The hash is the same on every
    retry of a task.  Copies of one row share a salt.
    """
    if hot is None:
        return rows.join(lookup, keys, "left")
    by = [c for c in hot.columns if c != "rows_of_key"]
    marks = hot.select(*by, F.ceil(F.col("rows_of_key") / share).cast("int").alias("spread"))
    own = F.when(F.col("spread").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("spread")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1))
    left = rows.join(marks, by, "left").withColumn("salt", own).drop("spread")
    right = lookup.join(marks, by, "left").withColumn("salt", every).drop("spread")
    return left.join(right, [*keys, "salt"], "left").drop("salt")


def join_entities(rows: DataFrame, lookup: DataFrame, keys: list[str], hot: DataFrame | None = None) -> DataFrame:
    """``left_join`` to a table that is far smaller than what it was made from.

    The table is written, so its size is known: up to SMALL_TABLE rows go to all
    tasks and ``rows`` stay where they are, however wide or skewed.
    """
    table = stored(lookup, "entities")
    if table.count() <= SMALL_TABLE:
        return rows.join(F.broadcast(table), keys, "left")
    return left_join(rows, table, keys, hot)
