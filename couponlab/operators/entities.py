"""Feature tables for users, merchants and coupons.

Column names are the contest names in lower case, which Spark resolves
without regard to case.  Two differ: of the two receipt-and-purchase discount
counts that shared a name, the one over all receipts is called
``field_user_id_receive_diff_discount_rate_cnt``, and the merchant redemption
rate has a name of its own instead of replacing its count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from couponlab.operators.features import Feature, Ratio, entity_features, ratio_columns

_U = "field_user_id_"
_M = "feature_merchant_id"
_C = "feature_coupon_id_"


def _spread(prefix: str, value: str, names: tuple[str, str, str, str]) -> list[Feature]:
    kinds = ("min", "max", "mean", "median")
    return [Feature(prefix + name, kind, "all", value) for name, kind in zip(names, kinds)]


def _gaps(prefix: str, mean_name: str = "mean_time_gap_15") -> list[Feature]:
    return [
        Feature(prefix + mean_name, "mean", "all", "redeem_gap"),
        Feature(prefix + "max_time_gap_15", "max", "all", "redeem_gap"),
        Feature(prefix + "min_time_gap_15", "min", "all", "redeem_gap"),
        Feature(prefix + "median_time_gap_15", "median", "all", "redeem_gap"),
    ]


USER_COUNTS = [
    Feature(_U + "record_cnt", "count", "all"),
    Feature(_U + "consume_cnt", "count", "used"),
    Feature(_U + "receive_and_consume_cnt", "count", "recv_used"),
    # "Not consumed" asks for no purchase only, not for a receipt.
    Feature(_U + "receive_and_not_consume_cnt", "count", "not_used"),
    Feature(_U + "not_receive_and_consume_cnt", "count", "not_recv_used"),
    Feature(_U + "received_cnt", "count", "recv"),
]

USER_MERCHANTS = [
    Feature(_U + "differ_merchant_cnt", "distinct", "all", "merchant_id"),
    Feature(_U + "receive_differ_merchant_cnt", "distinct", "recv", "merchant_id"),
    Feature(_U + "receive_and_consume_differ_merchant_cnt", "distinct", "recv_used", "merchant_id"),
    Feature(_U + "consume_differ_merchant_cnt", "distinct", "used", "merchant_id"),
]

USER_DISTINCTS = [
    *USER_MERCHANTS,
    Feature(_U + "not_receive_differ_merchant_cnt", "distinct", "not_recv", "merchant_id"),
    Feature(_U + "differ_coupon_id_cnt", "distinct", "all", "coupon0"),
    Feature(_U + "receive_differ_coupon_id_cnt", "distinct", "recv", "coupon0"),
    Feature(_U + "not_receive_differ_coupon_id_cnt", "distinct", "not_recv", "coupon0"),
    Feature(_U + "receive_consume_differ_coupon_id_cnt", "distinct", "recv_used", "coupon0"),
    Feature(_U + "consume_differ_coupon_id_cnt", "distinct", "used", "coupon0"),
    Feature(_U + "receive_not_consume_differ_coupon_id_cnt", "distinct", "recv_not_used", "coupon0"),
    Feature(_U + "distance_cnt", "distinct", "all", "distance"),
    Feature(_U + "consume_distance_cnt", "distinct", "recv_used", "distance"),
    Feature(_U + "not_consume_distance_cnt", "distinct", "not_used", "distance"),
    Feature(_U + "receive_distance_cnt", "distinct", "recv", "distance"),
    Feature(_U + "not_receive_distance_cnt", "distinct", "not_recv", "distance"),
    Feature(_U + "receive_not_consume_distance_cnt", "distinct", "recv_not_used", "distance"),
    Feature(_U + "diff_discount_rate_cnt", "distinct", "all", "discount_rate"),
    Feature(_U + "consume_diff_discount_rate_cnt", "distinct", "used", "discount_rate"),
    Feature(_U + "receive_consume_diff_discount_rate_cnt", "distinct", "recv_used", "discount_rate"),
    Feature(_U + "receive_diff_discount_rate_cnt", "distinct", "recv", "discount_rate"),
    Feature(_U + "receive_not_consume_diff_discount_rate_cnt", "distinct", "recv_not_used", "discount_rate"),
    Feature(_U + "not_receive_diff_discount_rate_cnt", "distinct", "not_recv", "discount_rate"),
]

USER_STATS = [
    *_spread(_U, "distance", ("distance_min", "distance_max", "distance_mean", "distance_median")),
    *_spread(
        _U,
        "discount_rate",
        ("discount_rate_min", "discount_rate_max", "discount_rate_mean", "discount_rate_median"),
    ),
    *_spread(
        _U,
        "min_cost_of_manjian",
        (
            "min_cost_of_manjian_min",
            "min_cost_of_manjian_max",
            "min_cost_of_manjian_mean",
            "min_cost_of_manjian_median",
        ),
    ),
    *_spread(
        _U,
        "reduce_manjian",
        ("reduce_manjian_mmin", "reduce_manjian_mmax", "reduce_manjian_mmean", "reduce_manjian_median"),
    ),
]

# The three classes count the same rows, and so are always equal.
USER_FREQUENCY = [
    Feature(_U + "repair_merchant_cnt", "frequency_class"),
    Feature(_U + "repair_consume_merchant_cnt", "frequency_class"),
    Feature(_U + "repair_receive_merchant_cnt", "frequency_class"),
]

USER_GAPS = _gaps(_U)

USER_FEATURES = [*USER_COUNTS, *USER_DISTINCTS, *USER_STATS, *USER_FREQUENCY, *USER_GAPS]

#: The earlier, smaller user table.
USER_FEATURES_V0 = [*USER_COUNTS, *USER_MERCHANTS]

USER_REDEEMED_MERCHANTS = [
    Feature(_U + "receive_and_consume_differ_merchant_cnt_15", "distinct", "redeemed", "merchant_id")
]

MERCHANT_COUNTS = [
    Feature(_M + "received_cnt", "count", "recv"),
    Feature(_M + "record_cnt", "count", "all"),
    Feature(_M + "consume_cnt", "count", "used"),
    Feature(_M + "received_and_consume_cnt", "count", "recv_used"),
    Feature(_M + "notreceived_and_consume_cnt", "count", "not_recv_used"),
    Feature(_M + "notconsume_cnt", "count", "not_used"),
    Feature(_M + "received_differ_user_cnt", "distinct", "recv", "user_id"),
    Feature(_M + "differ_user_cnt", "distinct", "all", "user_id"),
    Feature(_M + "received_and_consume_differ_user_cnt", "distinct", "recv_used", "user_id"),
    Feature(_M + "received_and_notconsume_differ_user_cnt", "distinct", "recv_not_used", "user_id"),
    Feature(_M + "differ_coupon_cnt", "distinct", "all", "coupon0"),
]

MERCHANT_STATS = [
    *_spread(_M, "distance", ("distance_min", "distance_max", "distance_mean", "distance_median")),
    *_spread(
        _M,
        "discount_rate",
        ("discount_rate_min", "discount_rate_max", "discount_rate_mean", "discount_rate_median"),
    ),
    *_spread(
        _M,
        "min_cost_of_manjian",
        (
            "min_cost_of_manjian_min",
            "min_cost_of_manjian_max",
            "min_cost_of_manjian_mean",
            "min_cost_of_manjian_median",
        ),
    ),
    *_spread(
        _M,
        "reduce_manjian",
        ("reduce_manjian_min", "reduce_manjian_max", "reduce_manjian_mean", "reduce_manjian_median"),
    ),
]

MERCHANT_GAPS = _gaps(_M, "marchant_mean_time_gap_15")

MERCHANT_FEATURES = [*MERCHANT_COUNTS, *MERCHANT_STATS, *MERCHANT_GAPS]

#: The earlier merchant table, with its own spelling of the names.
MERCHANT_FEATURES_V0 = [
    Feature("feature_merchant_id_received_cnt", "count", "recv"),
    Feature("feature_merchant_id_record_cnt", "count", "all"),
    Feature("feature_merchant_id_consume_cnt", "count", "used"),
    Feature("feature_merchant_id_received_and_consume_cnt", "count", "recv_used"),
    Feature("feature_merchant_id_not_received_and_consume_cnt", "count", "not_recv_used"),
    Feature("feature_merchant_id_not_consume_cnt", "count", "not_used"),
    Feature("feature_merchant_id_received_differ_user_cnt", "distinct", "recv", "user_id"),
    Feature("feature_merchant_id_differ_user_cnt", "distinct", "all", "user_id"),
    Feature("feature_merchant_id_received_and_consume_differ_user_cnt", "distinct", "recv_used", "user_id"),
    Feature("feature_merchant_id_received_and_not_consume_differ_user_cnt", "distinct", "recv_not_used", "user_id"),
    Feature("feature_merchant_id_differ_coupon_cnt", "distinct", "all", "coupon0"),
]

COUPON_FEATURES_V0 = [
    Feature(_C + "received_cnt", "count", "all"),
    Feature(_C + "received_and_consume_cnt", "count", "recv_used"),
    Feature(_C + "consume_mean_time_gap_15", "mean", "all", "redeem_gap"),
    Feature(_C + "median_of_min_cost_of_manjian", "median", "all", "threshold_cost"),
]

COUPON_RATE = Ratio(_C + "received_and_consume_rate", _C + "received_and_consume_cnt", _C + "received_cnt")

USER_RATES = [
    Ratio(_U + "receive_and_consumer_rate", _U + "receive_and_consume_cnt", _U + "received_cnt"),
    Ratio(_U + "consumer_rate", _U + "consume_cnt", _U + "record_cnt"),
    Ratio(_U + "receive_rate", _U + "received_cnt", _U + "record_cnt"),
]

MERCHANT_RATES = [
    Ratio(_M + "received_and_consume_rate", _M + "received_and_consume_cnt", _M + "received_cnt"),
    Ratio(_M + "consumer_rate", _M + "consume_cnt", _M + "record_cnt"),
    Ratio(_M + "receive_rate", _M + "received_cnt", _M + "record_cnt"),
]


def user_features(
    rows: DataFrame,
    features: list[Feature] = USER_FEATURES,
    hot: DataFrame | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    return entity_features(rows, "user_id", features, many=True, hot=hot, within=within)


def merchant_features(
    rows: DataFrame, features: list[Feature] = MERCHANT_FEATURES, within: Sequence[str] = ()
) -> DataFrame:
    return entity_features(rows, "merchant_id", features, within=within)


def coupon_features(rows: DataFrame, with_rate: bool = True, within: Sequence[str] = ()) -> DataFrame:
    """Coupon table keyed by ``coupon0``; purchases without coupon are key 0."""
    table = entity_features(rows, "coupon0", COUPON_FEATURES_V0, within=within)
    return table.select("*", *ratio_columns([COUPON_RATE])) if with_rate else table


def user_rates(rows: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The user ratios, and the merchants redeemed at within 15 days."""
    table = user_features(rows, [*USER_COUNTS, *USER_REDEEMED_MERCHANTS], hot)
    return table.select(
        "user_id", *ratio_columns(USER_RATES), *[feature.name for feature in USER_REDEEMED_MERCHANTS]
    )


def merchant_rates(rows: DataFrame) -> DataFrame:
    table = merchant_features(rows, MERCHANT_COUNTS)
    return table.select("merchant_id", *ratio_columns(MERCHANT_RATES))
