"""Hand-written rows with results worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from couponlab.functions import calendar, discount, fields, labels
from couponlab.operators import entities, profile, receipts, windows
from couponlab.plans import datasets
from conftest import bag, day, make_log


def by_id(frame, *columns):
    return {int(r["row_id"]): tuple(r[c] for c in columns) for r in frame.collect()}


def test_clean_fills_every_field(edge_log):
    found = by_id(
        fields.clean(edge_log),
        "is_manjian",
        "discount_rate",
        "min_cost_of_manjian",
        "reduce_manjian",
        "distance",
        "null_distance",
        "coupon0",
    )
    assert found[1] == (1, 0.9, 100, 10, 0, 0, 100)
    assert found[3] == (1, 0.9, 100, 10, -1, 1, 100)
    assert found[4] == (0, 1.0, -1, -1, 3, 0, 0)
    assert found[5] == (0, 0.9, -1, -1, 10, 0, 101)
    assert found[7][1] == 25 / 30


def test_clean_accepts_a_log_without_purchases(edge_log):
    cleaned = fields.clean(edge_log.drop("date_used"))
    assert cleaned.where(F.col("date_used").isNotNull()).count() == 0


def test_malformed_discounts_do_not_fail(spark):
    log = make_log(spark, [(1, 1, 1, "x:y", 0, "20160101", None), (1, 1, 1, "0:5", 0, "20160101", None)])
    rows = fields.clean(log).collect()
    assert [r["discount_rate"] for r in rows] == [1.0, 1.0]
    assert rows[0]["min_cost_of_manjian"] == -1


def test_other_discount_forms(edge_log):
    raw = F.col("discount_raw")
    found = by_id(
        edge_log.select(
            "row_id",
            discount.converted_rate(raw).alias("rate"),
            discount.discount_type(raw).alias("type"),
            discount.spend_threshold(raw, 0).alias("man"),
            discount.reduction(raw, 0).alias("jian"),
            discount.reduction_share(raw).alias("share"),
        ),
        "rate",
        "type",
        "man",
        "jian",
        "share",
    )
    assert found[1] == (0.9, 1, 100, 10, 0.1)
    assert found[4] == (1.0, None, 0, 0, 0.0)
    assert found[5] == (0.9, 0, 0, 0, 0.0)


def test_labels(edge_log):
    received, used = F.col("date_received"), F.col("date_used")
    found = by_id(
        edge_log.select(
            "row_id",
            labels.redeemed(received, used).alias("two"),
            labels.redeemed_or_no_receipt(received, used).alias("three"),
            labels.purchase_quadrant(F.col("coupon_id"), used).alias("four"),
        ),
        "two",
        "three",
        "four",
    )
    assert found[1] == (1, 1, 1)  # exactly 15 days
    assert found[2] == (0, 0, 0)
    assert found[3] == (0, 0, 1)  # 16 days
    assert found[4] == (0, -1, -1)
    assert found[5] == (1, 1, 1)  # bought the day before receipt
    assert found[9] == (0, -1, -2)


def test_windows(edge_log):
    def ids(frame):
        return sorted(int(r["row_id"]) for r in frame.collect())

    assert ids(windows.received_in(edge_log, windows.DATASET_1)) == [3, 5, 6]
    assert ids(windows.received_in(edge_log, windows.DATASET_1_AS_WRITTEN)) == [1, 2, 3, 5, 6, 8, 10, 11]
    # Used rows count by purchase day, unused ones by receipt day; row 9 by neither.
    assert ids(windows.active_in(edge_log, windows.FEATURE_1)) == [2, 4, 7, 8, 10, 11]
    assert ids(windows.bought_in(edge_log, windows.MIDDLE_FIELDS["train"])) == [3]


def test_window_lengths():
    assert windows.HISTORY_FIELDS["train"].last == day("20160430")
    assert windows.MIDDLE_FIELDS["test"].last == day("20160630")
    assert windows.LABEL_FIELDS["validate"].last == day("20160430")


def test_receipt_order(edge_log):
    rows = receipts.attach_receipt_features(fields.clean(edge_log).where(fields.received()))
    found = by_id(rows, *receipts.SEQUENCE_COLUMNS, "simple_user_id_coupon_id_date_received_receive_receive")
    # last, first (its complement), truly first, before, after, sum, mean, repeated
    assert found[1] == (0, 1, 1, -1, 18, 18, 6.0, 1)
    assert found[2] == (0, 1, 1, -1, 18, 18, 6.0, 1)
    assert found[3] == (1, 0, 0, 18, -1, 18, 6.0, 0)
    assert found[5] == (0, 1, 1, -1, 14, 14, 7.0, 0)
    assert found[6] == (1, 0, 0, 14, -1, 14, 7.0, 0)
    assert found[10] == (1, 0, 1, -1, -1, 0, 0.0, 1)


def test_calendar(edge_log):
    received = F.col("date_received")
    found = by_id(
        edge_log.select(
            "row_id",
            calendar.week(received).alias("week"),
            calendar.weekday(received).alias("weekday"),
            calendar.is_weekend(received).alias("weekend"),
            calendar.is_holiday(received).alias("holiday"),
            *calendar.weekday_columns(received),
        ),
        "week",
        "weekday",
        "weekend",
        "holiday",
        "weekday_1",
    )
    assert found[7] == (5, 6, 1, 0, 0)  # a working Saturday
    assert found[8] == (0, 1, 0, 1, 1)  # a Monday off
    assert found[4] == (None, None, 0, 0, 0)


def test_holidays_are_sixty_nine_days(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2015-12-01', DATE'2016-12-31')) AS d")
    assert days.where(calendar.is_holiday(F.col("d")) == 1).count() == 69


def test_user_features(edge_log):
    table = {r["user_id"]: r for r in entities.user_features(fields.clean(edge_log)).collect()}
    one, four = table[1], table[4]
    assert one["field_user_id_record_cnt"] == 4
    assert one["field_user_id_received_cnt"] == 3
    assert one["field_user_id_consume_cnt"] == 3
    assert one["field_user_id_receive_and_not_consume_cnt"] == 1
    # The missing coupon is one value more.
    assert one["field_user_id_differ_coupon_id_cnt"] == 2
    assert one["field_user_id_receive_differ_coupon_id_cnt"] == 1
    assert one["field_user_id_distance_cnt"] == 3
    assert one["field_user_id_distance_mean"] == 0.5
    assert one["field_user_id_distance_median"] == 0.0
    assert one["field_user_id_repair_merchant_cnt"] == 1
    assert one["field_user_id_mean_time_gap_15"] == 15.0
    # "Not consumed" does not ask for a receipt.
    assert four["field_user_id_receive_and_not_consume_cnt"] == 1
    assert four["field_user_id_receive_not_consume_distance_cnt"] == 0
    assert four["field_user_id_max_time_gap_15"] == 0
    assert table[2]["field_user_id_min_time_gap_15"] == -1


def test_merchant_and_coupon_features(edge_log):
    rows = fields.clean(edge_log)
    merchants = {r["merchant_id"]: r for r in entities.merchant_features(rows).collect()}
    assert merchants[11]["feature_merchant_iddiffer_user_cnt"] == 2
    assert merchants[11]["feature_merchant_idnotreceived_and_consume_cnt"] == 1
    coupons = {r["coupon0"]: r for r in entities.coupon_features(rows).collect()}
    assert coupons[100]["feature_coupon_id_received_cnt"] == 3
    assert coupons[100]["feature_coupon_id_received_and_consume_rate"] == 2 / 3
    assert coupons[100]["feature_coupon_id_median_of_min_cost_of_manjian"] == 100.0
    assert coupons[0]["feature_coupon_id_received_cnt"] == 2
    assert coupons[0]["feature_coupon_id_received_and_consume_rate"] == 0.0


def test_first_receipt(edge_log):
    rows = fields.clean(edge_log)
    flagged = receipts.attach_first_receipt(rows, receipts.first_dates(rows))
    found = {k: v[0] for k, v in by_id(flagged, "is_first_date_received").items()}
    assert [i for i, flag in sorted(found.items()) if flag] == [1, 2, 5, 7, 10, 11]


def test_copies_are_dropped_once(edge_log):
    log = fields.clean(edge_log).drop("row_id")
    dataset = windows.received_in(log, windows.Span.of("2016-04-13", "2016-04-13"))
    kept = datasets.assemble(log, dataset)
    distinct = datasets.assemble(log, dataset, distinct=True)
    assert kept.count() == 2 and distinct.count() == 1
    assert distinct.first()["simple_user_id_coupon_id_date_received_receive_receive"] == 1
    assert bag(kept.distinct()) == bag(distinct)


def test_label_is_last_and_inputs_exclude_identifiers(edge_log):
    log = fields.clean(edge_log)
    built = datasets.label_last(fields.with_label(datasets.assemble(log, log)))
    assert built.columns[-1] == "label"
    inputs = datasets.model_inputs(built)
    assert "discount_rate" in inputs and "gap_mean" in inputs
    assert not {"user_id", "coupon_id", "date_used", "label", "day_gap_before"} & set(inputs)


def test_profiles(edge_log):
    cells = {(r["received"], r["used"]): r["rows"] for r in profile.quadrants(edge_log).collect()}
    assert cells == {(1, 1): 4, (1, 0): 5, (0, 1): 1, (0, 0): 1}
    shares = {r["column_name"]: (r["has_null"], r["null_ratio"]) for r in profile.null_profile(edge_log, ["user_id", "coupon_id"]).collect()}
    assert shares == {"user_id": (0, 0.0), "coupon_id": (1, 2 / 11)}
    only = profile.only_in(edge_log, edge_log.where("user_id < 4"), "user_id")
    assert bag(only) == [(4,), (5,)]


def test_rate_means_keep_all_digits_and_sizes(spark):
    rates = ["0.00000000000123", "0.00000000000125", "250000000000", "0.9"]
    rows = [(u, 1, 100, r, 1, "20160402", None) for u, r in ((1, rates[0]), (1, rates[1]), (1, rates[1]), (2, rates[2]), (2, rates[3]))]
    table = {r["user_id"]: r for r in entities.user_features(fields.clean(make_log(spark, rows))).collect()}
    name = next(f.name for f in entities.USER_STATS if f.kind == "mean" and f.value == "discount_rate")
    assert abs(table[1][name] - 3.73e-12 / 3) < 1e-24
    assert table[2][name] == 250000000000.9 / 2
