"""Training and scoring sets assembled from a coupon log.

``hot`` is what ``operators.skew.hot_ids`` returns for the whole log; without
it every key is taken as ordinary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponlab.functions import calendar, fields
from couponlab.operators import counts, entities, profile, receipts, skew, windows
from couponlab.session import stored

Hot = Mapping[str, DataFrame | None]

KEYS = ["user_id", "merchant_id", "coupon0"]

#: Columns that are not model inputs: user, coupon and date, raw texts, the
#: label, the gaps that the final pipeline drops, and ``is_first_receipt``,
#: which is no contest feature but the correction of one.
NOT_MODEL_INPUTS = {
    "user_id",
    "coupon_id",
    "coupon0",
    "discount_raw",
    "date_received",
    "date_used",
    "row_id",
    "split",
    "label",
    "day_gap_before",
    "day_gap_after",
    "is_first_receipt",
}


def find_hot(log: DataFrame, floor: int = skew.HOT_ROWS) -> dict[str, DataFrame | None]:
    """Hot users, merchants and coupons of a cleaned log, in one pass."""
    return skew.hot_ids(log, KEYS, floor)


def encode(rows: DataFrame) -> DataFrame:
    """Calendar columns, one-hot weekday and one-hot distance of receipts."""
    day, distance = F.col("date_received"), F.col("distance")
    return rows.select(
        "*",
        calendar.week(day).alias("week"),
        calendar.is_holiday(day).alias("is_holiday"),
        calendar.is_weekend(day).alias("is_weekend"),
        *calendar.week_columns(day),
        *calendar.distance_columns(distance),
    )


#: What the first pipeline leaves out besides.
FIRST_PIPELINE_LEAVES_OUT = ("distance",)


def model_inputs(rows: DataFrame, leave_out: Sequence[str] = ()) -> list[str]:
    """Columns a model may use, in table order, without those of ``leave_out``."""
    return [c for c in rows.columns if c not in NOT_MODEL_INPUTS and c not in leave_out]


def label_last(rows: DataFrame) -> DataFrame:
    """Move ``label`` to the end, as an integer."""
    others = [c for c in rows.columns if c != "label"]
    return rows.select(*others, F.col("label").cast("int"))


def attach_entities(
    rows: DataFrame,
    history: DataFrame,
    hot: Hot,
    users: list = entities.USER_FEATURES,
    merchants: list = entities.MERCHANT_FEATURES,
    coupon_rate: bool = True,
    prefix: str = "",
    within: Sequence[str] = (),
) -> DataFrame:
    """Join user, merchant and coupon features of ``history`` to ``rows``.

    Added columns, and only those, are 0 for entities without history.
    Columns ``rows`` already has are not added again.  Both are read several
    times and should come from a written table.
    """
    tables = {
        "user_id": entities.user_features(history, users, hot.get("user_id"), within),
        "merchant_id": entities.merchant_features(history, merchants, within),
        "coupon0": entities.coupon_features(history, coupon_rate, within),
    }
    added = []
    for key, table in tables.items():
        keys = [*within, key]
        if prefix:
            table = table.withColumnsRenamed({c: prefix + c for c in table.columns if c not in keys})
        repeated = [c for c in profile.shared_columns(table, rows) if c not in keys]
        table = table.drop(*repeated) if repeated else table
        added += [c for c in table.columns if c not in keys]
        join = skew.left_join if key == "user_id" else skew.join_entities
        rows = join(rows, table, keys, hot.get(key))
    return rows.na.fill(0, subset=added)


def assemble(
    history: DataFrame,
    dataset: DataFrame,
    hot: Hot | None = None,
    distinct: bool = False,
    within: Sequence[str] = (),
) -> DataFrame:
    """Row features of ``dataset`` with entity features of ``history``, both cleaned.

    ``within`` names columns, such as a window number, that keep several
    windows apart while they are built in one pass.  Exact copies count in the
    row features; ``distinct`` then drops them.  All added columns are
    functions of the row and its log, so dropping copies before the entity
    joins gives the same rows as after.
    """
    hot = hot or {}
    rows = receipts.attach_receipt_features(dataset.where(fields.received()), within)
    if distinct:
        rows = rows.dropDuplicates([*within, *(c for c in fields.RAW_COLUMNS if c in rows.columns)])
    return attach_entities(encode(rows), history, hot, within=within)


def training_set(log: DataFrame, scoring: DataFrame, hot: Hot | None = None, as_written: bool = False) -> DataFrame:
    """Dataset windows 1 and 2 with their features, copies dropped, labelled.

    ``as_written`` keeps the start of window 1 that overlaps its own feature
    window; the default is the intended one.
    """
    log = stored(fields.clean(log).drop("row_id"), "log")
    hot = find_hot(log) if hot is None else hot
    first = windows.DATASET_1_AS_WRITTEN if as_written else windows.DATASET_1
    dataset = windows.tagged(
        log, {1: windows.is_received_in(first), 2: windows.is_received_in(windows.DATASET_2)}
    )
    history = windows.tagged(
        log, {1: windows.is_active_in(windows.FEATURE_1), 2: windows.is_active_in(windows.FEATURE_2)}
    )
    flagged = receipts.attach_first_receipt(dataset, receipts.first_dates(log, scoring), hot.get("coupon0"))
    built = assemble(history, flagged, hot, distinct=True, within=["window"])
    return label_last(fields.with_label(built.drop("window")))


def scoring_set(log: DataFrame, scoring: DataFrame, hot: Hot | None = None) -> DataFrame:
    """The scoring log with the features of window 3.  Copies are kept."""
    log, rows = stored(fields.clean(log), "log"), stored(fields.clean(scoring), "log")
    hot = find_hot(log.select(*KEYS).unionByName(rows.select(*KEYS))) if hot is None else hot
    flagged = receipts.attach_first_receipt(rows, receipts.first_dates(log, rows), hot.get("coupon0"))
    return assemble(windows.active_in(log, windows.FEATURE_3), flagged, hot)


def basic_set(rows: DataFrame, hot: Hot | None = None) -> DataFrame:
    """The first pipeline: basic counts and encodings of cleaned receipts."""
    hot = hot or {}
    return encode(counts.attach_basic_counts(rows.where(fields.received()), hot.get("user_id")))


def assemble_v0(sets: Mapping[str, DataFrame], hot: Hot | None = None, fit_on: str = "train") -> DataFrame:
    """The smaller feature set: features of the train rows on all sets.

    The sets become one table with a ``split`` column, so each entity table
    is built and joined once; row counts stay within a set.
    """
    hot = hot or {}
    tagged = [frame.withColumn("split", F.lit(name)) for name, frame in sets.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    counted = counts.attach_row_counts_v0(rows, hot.get("user_id"), within=["split"])
    return attach_entities(
        encode(counted),
        sets[fit_on],
        hot,
        users=entities.USER_FEATURES_V0,
        merchants=entities.MERCHANT_FEATURES_V0,
        coupon_rate=False,
    )


def three_fields(
    history: DataFrame, middle: DataFrame, label_rows: DataFrame, hot: Hot | None = None, labelled: bool = True
) -> DataFrame:
    """History, middle and label blocks side by side for the label rows.

    Blocks meet by entity key, never by position.  Columns the blocks share
    appear once, from the label block.  ``labelled`` is False for a scoring log.
    """
    hot = hot or {}
    rows = basic_set(label_rows, hot)
    for prefix, block in (("history_", history), ("middle_", middle)):
        rows = attach_entities(
            rows,
            block,
            hot,
            users=entities.USER_FEATURES_V0,
            merchants=entities.MERCHANT_FEATURES_V0,
            prefix=prefix,
        )
    kept = rows if not labelled else label_last(fields.with_label(rows))
    return kept.drop("merchant_id", "discount_raw", "date_used")
