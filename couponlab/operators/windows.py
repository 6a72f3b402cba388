"""Date windows and train/validate splits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponlab.operators import selection
from couponlab.session import stored


@dataclass(frozen=True)
class Span:
    """An inclusive range of days."""

    first: dt.date
    last: dt.date

    @classmethod
    def of(cls, first: str, last: str) -> Span:
        return cls(dt.date.fromisoformat(first), dt.date.fromisoformat(last))

    @classmethod
    def starting(cls, first: str, days: int) -> Span:
        start = dt.date.fromisoformat(first)
        return cls(start, start + dt.timedelta(days=days - 1))

    def covers(self, day: Column) -> Column:
        return day.between(F.lit(self.first), F.lit(self.last))


# The windows of the final pipeline.
DATASET_1 = Span.of("2016-04-14", "2016-05-14")
#: Window 1 with the start its date text really selects; it overlaps feature
#: window 1 and so leaks labels.
DATASET_1_AS_WRITTEN = Span.of("2016-04-02", "2016-05-14")
DATASET_2 = Span.of("2016-05-15", "2016-06-15")
FEATURE_1 = Span.of("2016-01-01", "2016-04-13")
FEATURE_2 = Span.of("2016-02-01", "2016-05-14")
FEATURE_3 = Span.of("2016-03-15", "2016-06-30")

# The three-field windows.  The third label field is the
# scoring log.
HISTORY_FIELDS = {
    "train": Span.starting("2016-03-02", 60),
    "validate": Span.starting("2016-01-16", 60),
    "test": Span.starting("2016-04-17", 60),
}
MIDDLE_FIELDS = {
    "train": Span.starting("2016-05-01", 15),
    "validate": Span.starting("2016-03-16", 15),
    "test": Span.starting("2016-06-16", 15),
}
LABEL_FIELDS = {
    "train": Span.starting("2016-05-16", 31),
    "validate": Span.starting("2016-03-31", 31),
}


def is_received_in(span: Span) -> Column:
    return span.covers(F.col("date_received"))


def is_active_in(span: Span) -> Column:
    """Bought in the span, or received in it and never used.

    Two plain comparisons, so that both reach the file scan.
    """
    return span.covers(F.col("date_used")) | (F.col("date_used").isNull() & span.covers(F.col("date_received")))


def received_in(log: DataFrame, span: Span) -> DataFrame:
    """Receipts in the span."""
    return log.where(is_received_in(span))


def bought_in(log: DataFrame, span: Span) -> DataFrame:
    """Purchases in the span."""
    return log.where(span.covers(F.col("date_used")))


def active_in(log: DataFrame, span: Span) -> DataFrame:
    """Purchases in the span, and receipts in it that were never used."""
    return log.where(is_active_in(span))


def tagged(log: DataFrame, spans: Mapping[int, Column], name: str = "window") -> DataFrame:
    """Rows of any span, once for each span they lie in, with its number."""
    numbers = F.array(*[F.when(inside, F.lit(number)) for number, inside in spans.items()])
    return log.where(reduce(or_, spans.values())).withColumn(name, F.explode(F.array_compact(numbers)))


def date_split(log: DataFrame, cut: str = "2016-05-30", last: str = "2016-06-15") -> DataFrame:
    """Receipts before ``cut`` as train, from there to ``last`` as validate."""
    day, cut_day, last_day = F.col("date_received"), F.lit(cut).cast("date"), F.lit(last).cast("date")
    part = F.when(day < cut_day, "train").when(day <= last_day, "validate")
    return log.withColumn("split", part).where(F.col("split").isNotNull())


def exact_parts(rows: DataFrame, by: list[str], quotas: list[Column], order: list[Column]) -> DataFrame:
    """Number the parts of each group: 0 up to the first quota, 1 up to the next, ...

    Rows of a group are ranked by ``order``, which must tell rows apart and
    hold no nulls; a quota is a number of rows, as a column that may use
    ``rows_of_group``.  The result is exact, yet no group is sorted or moved:
    the last row inside each quota is searched for, and all rows are compared
    with those few.  Groups are few.  The rows are written once and read back,
    so what they come from is worked out once.
    """
    kept = stored(rows, "split")
    edges = selection.places(kept, by, quotas, order)
    part = F.lit(0)
    for i in range(len(quotas)):
        inside = F.col(f"e.edge_{i}").isNull() | (F.struct(*order) <= F.col(f"e.edge_{i}"))
        part = part + (F.col(f"e.none_{i}") | ~inside).cast("int")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    # One row per group.
    return kept.alias("r").join(F.broadcast(edges).alias("e"), same, "left").select("r.*", part.alias("part"))


def _hash_order(row_id: str) -> list[Column]:
    return [F.md5(F.col(row_id)), F.col(row_id)]


def stratified_split(
    rows: DataFrame, label: str = "label", row_id: str = "row_id", share: tuple[int, int] = (1, 5)
) -> DataFrame:
    """Exactly ``share`` of each label, rounded up, as validate; the rest train.

    The choice is by hash of the row id: repeatable, and the same for any
    partitioning of the input.
    """
    numerator, denominator = share
    quota = F.expr(f"(rows_of_group * {numerator} + {denominator - 1}) div {denominator}")
    parted = exact_parts(rows, [label], [quota], _hash_order(row_id))
    return parted.withColumn("split", F.when(F.col("part") == 0, "validate").otherwise("train")).drop("part")


def stratified_folds(rows: DataFrame, folds: int, label: str = "label", row_id: str = "row_id") -> DataFrame:
    """Add ``fold``: near-equal parts of every label, chosen by hash."""
    quotas = [F.expr(f"rows_of_group * {i} div {folds}") for i in range(1, folds)]
    return exact_parts(rows, [label], quotas, _hash_order(row_id)).withColumnRenamed("part", "fold")


def positional_split(
    rows: DataFrame, at: int | Column, lead: str = "date_received", row_id: str = "row_id"
) -> DataFrame:
    """The first ``at`` rows by ``lead`` (null first) as train, the rest test.

    ``at`` is a number, or a column that may use ``rows_of_group``.  A Spark
    table has no row order, so the order is stated: by ``lead``, then by hash
    of the row id.
    """
    leading = F.coalesce(F.col(lead).cast("string"), F.lit(""))
    quota = at if isinstance(at, Column) else F.lit(at).cast("bigint")
    whole = rows.withColumn("everything", F.lit(1))
    parted = exact_parts(whole, ["everything"], [quota], [leading, *_hash_order(row_id)])
    split = F.when(F.col("part") == 0, "train").otherwise("test")
    return parted.withColumn("split", split).drop("part", "everything")
