"""

Every query reads the whole tables of the folder it is given.  Doubles are
rounded to six places for comparison.
"""

from __future__ import annotations

import importlib.util
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_queries
from couponlab.functions import calendar, discount, fields, labels
from couponlab.operators import boosting, counts, entities, evaluation, models, neighbours, penalised, profile, receipts, skew, windows
from couponlab.plans import datasets, scoring
from couponlab.session import checkpoint_dir, stored
from couponlab.sources import log_files, sinks
from couponlab.sources.star_tables import coupon_log, scoring_log

ENTRY_FOLDER = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]

RECEIPT_KEYS = ["user_id", "merchant_id", "coupon0", "discount_rate", "distance", "date_received"]


def _rounded(rows: DataFrame) -> DataFrame:
    doubles = {name for name, kind in rows.dtypes if kind == "double"}
    return rows.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in rows.columns])


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return coupon_log(spark, folder)


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return fields.clean(coupon_log(spark, folder))


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned log, written: it is joined from two tables, and read several times."""
    return stored(_clean(spark, folder), "log")


def _receipts(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(spark, folder).where(fields.received())


def _raw(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(*fields.RAW_COLUMNS, *extra)


def _hot_users(rows: DataFrame) -> DataFrame | None:
    return skew.hot_keys(rows, ["user_id"])


# --- parsing, labels, profiles ------------------------------------------------


def clean_discounts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    return _rounded(
        rows.select(
            "user_id",
            "merchant_id",
            "coupon0",
            "is_manjian",
            "discount_rate",
            "min_cost_of_manjian",
            "reduce_manjian",
            "distance",
            "null_distance",
            "date_received",
            "date_used",
        )
    )


def staged_discounts(spark: SparkSession, folder: str) -> DataFrame:
    staged = fields.stage(_log(spark, folder)).withColumn("discount_share", discount.reduction_share(F.col("discount_raw")))
    return _rounded(
        staged.select(
            "user_id",
            "merchant_id",
            "coupon_id",
            "discount_rate",
            "discount_man",
            "discount_jian",
            "discount_type",
            "discount_share",
            "distance",
            "label",
        )
    )


def date_numbers(spark: SparkSession, folder: str) -> DataFrame:
    def number(name: str):
        return F.coalesce(F.date_format(name, "yyyyMMdd").cast("int"), F.lit(0))

    numbered = _log(spark, folder).select(
        "user_id", number("date_received").alias("received_number"), number("date_used").alias("used_number")
    )
    parsed = F.try_to_date(F.col("received_number").cast("string"), "yyyyMMdd")
    return numbered.withColumn("parsed_received", parsed)


def label_15d(spark: SparkSession, folder: str) -> DataFrame:
    gap = labels.gap_days(F.col("date_received"), F.col("date_used")).alias("gap")
    return fields.with_label(_log(spark, folder)).select(
        "user_id", "coupon_id", "date_received", "date_used", gap, "label"
    )


def label_3way(spark: SparkSession, folder: str) -> DataFrame:
    label = labels.redeemed_or_no_receipt(F.col("date_received"), F.col("date_used"))
    return _raw(_log(spark, folder)).withColumn("label", label)


def label_4way(spark: SparkSession, folder: str) -> DataFrame:
    label = labels.purchase_quadrant(F.col("coupon_id"), F.col("date_used"))
    return _raw(_log(spark, folder)).withColumn("label", label)


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return profile.label_distribution(label_3way(spark, folder))


def labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return label_3way(spark, folder).where(F.col("label") != -1)


def quadrants(spark: SparkSession, folder: str) -> DataFrame:
    return profile.quadrants(_log(spark, folder))


def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profile.null_profile(_log(spark, folder), fields.RAW_COLUMNS))


def value_domain(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profile.value_domain(_clean(spark, folder), "discount_rate"))


def distance_domain(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_domain(_clean(spark, folder), "distance")


def date_span(spark: SparkSession, folder: str) -> DataFrame:
    return profile.date_span(_log(spark, folder))


def cold_users(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return profile.only_in(scoring_log(log), windows.received_in(log, windows.DATASET_2), "user_id")


def cold_merchants(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return profile.only_in(log, windows.bought_in(log, windows.MIDDLE_FIELDS["validate"]), "merchant_id")


def preview(spark: SparkSession, folder: str) -> DataFrame:
    return profile.preview(_raw(_log(spark, folder), "row_id").orderBy("row_id"), 10)


# --- windows and splits -------------------------------------------------------


def _window(pick, span) -> Query:
    return lambda spark, folder: _raw(pick(_log(spark, folder), span))


def _fields(pick, spans) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        log = _raw(_log(spark, folder))
        parts = [pick(log, span).withColumn("split", F.lit(name)) for name, span in spans.items()]
        return reduce(DataFrame.unionByName, parts)

    return run


def scoring_rows(spark: SparkSession, folder: str) -> DataFrame:
    return scoring_log(_log(spark, folder)).drop("row_id")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    label = labels.redeemed_or_no_receipt(F.col("date_received"), F.col("date_used"))
    return log.withColumn("label", label).where(F.col("label") != -1)


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return windows.stratified_split(_labelled(spark, folder)).select("row_id", "user_id", "label", "split")


def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    return windows.stratified_folds(_labelled(spark, folder), 3).select("row_id", "user_id", "label", "fold")


def date_split(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(windows.date_split(_log(spark, folder)), "split")


#: The split position as a share of the rows: 1,500,000 of 1,754,884.
SPLIT_POSITION = "rows_of_group * 1500000 div 1754884"


def _event_date():
    return F.coalesce("date_received", "date_used").alias("event_date")


def positional_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = _log(spark, folder).select("row_id", "user_id", _event_date())
    return windows.positional_split(rows, F.expr(SPLIT_POSITION), lead="event_date")


# --- entity features ----------------------------------------------------------


def _users(features) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = stored(_clean(spark, folder).drop("row_id"), "log")
        return _rounded(entities.user_features(rows, features, _hot_users(rows)))

    return run


def _merchants(features) -> Query:
    return lambda spark, folder: _rounded(entities.merchant_features(_clean(spark, folder), features))


def coupon_features(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(entities.coupon_features(_clean(spark, folder)))


def coupon_features_v0(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(entities.coupon_features(_clean(spark, folder), with_rate=False))


def redemption_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(_clean(spark, folder).drop("row_id"), "log")
    return _rounded(entities.user_rates(rows, _hot_users(rows)))


def merchant_rates(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(entities.merchant_rates(_clean(spark, folder)))


# --- row features -------------------------------------------------------------


def basic_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(_receipts(spark, folder).select(*RECEIPT_KEYS), "receipts")
    return _rounded(counts.attach_basic_counts(rows, _hot_users(rows)))


def v0_row_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(_receipts(spark, folder).select(*RECEIPT_KEYS), "receipts")
    return _rounded(counts.attach_row_counts_v0(rows, _hot_users(rows)))


def _interaction(size: int) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = stored(_receipts(spark, folder).select(*RECEIPT_KEYS), "receipts")
        return _rounded(counts.attach_counts(rows, counts.interaction_counts(size), _hot_users(rows)))

    return run


def receipt_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = _receipts(spark, folder)
    ordered = receipts.attach_sequence(rows.select("user_id", "merchant_id", "coupon0", "date_received"))
    return ordered.select(
        "user_id",
        "merchant_id",
        "coupon0",
        "date_received",
        "this_month_user_receive_same_coupon_lastone",
        "this_month_user_receive_same_coupon_firstone",
        "is_first_receipt",
    )


def receipt_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = _receipts(spark, folder)
    ordered = receipts.attach_sequence(rows.select("user_id", "merchant_id", "coupon0", "date_received"))
    return _rounded(
        ordered.select(
            "user_id",
            "coupon0",
            "date_received",
            "day_gap_before",
            "day_gap_after",
            "gap_sum",
            "gap_mean",
        )
    )


def receipt_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _receipts(spark, folder)
        .groupBy("user_id", "coupon0")
        .agg(F.max("date_received").alias("max_date_received"), F.min("date_received").alias("min_date_received"))
    )


def repeat_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = _receipts(spark, folder).select("user_id", "merchant_id", "coupon0", "date_received")
    return counts.attach_repeats(rows, {**counts.COUPON_REPEAT, **counts.MERCHANT_REPEAT})


def first_receipt(spark: SparkSession, folder: str) -> DataFrame:
    log = _kept(spark, folder)
    hot = datasets.find_hot(log)
    firsts = receipts.first_dates(log, scoring_log(log))
    flagged = receipts.attach_first_receipt(log, firsts, hot["coupon0"])
    return flagged.select("user_id", "coupon0", "date_received", "is_first_date_received")


def first_dates(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return receipts.first_dates(log, scoring_log(log))


def weekday_onehot(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("date_received")
    return _log(spark, folder).select(
        "user_id",
        "date_received",
        calendar.week(day).alias("week"),
        calendar.weekday(day).alias("weekday"),
        calendar.is_weekend(day).alias("is_weekend"),
        *calendar.week_columns(day),
        *calendar.weekday_columns(day),
    )


def distance_onehot(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(spark, folder).select("user_id", "distance", *calendar.distance_columns(F.col("distance")))


def holiday_flag(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select(
        "user_id", "date_received", calendar.is_holiday(F.col("date_received")).alias("is_holiday")
    )


def day_of_month(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select(
        "user_id", "date_received", calendar.day_of_month(F.col("date_received")).alias("day_of_month")
    )


# --- assembled sets -----------------------------------------------------------


def assemble_window(spark: SparkSession, folder: str) -> DataFrame:
    log = _kept(spark, folder)
    dataset = windows.received_in(log, windows.DATASET_2).drop("row_id")
    history = windows.active_in(log, windows.FEATURE_2)
    return _rounded(datasets.assemble(history, dataset, datasets.find_hot(log)))


def training_set(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return _rounded(datasets.training_set(log, scoring_log(log)))


def training_set_as_written(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return _rounded(datasets.training_set(log, scoring_log(log), as_written=True))


def scoring_set(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder).drop("row_id")
    return _rounded(datasets.scoring_set(log, scoring_log(log)))


def basic_set(spark: SparkSession, folder: str) -> DataFrame:
    log = _kept(spark, folder).drop("row_id")
    history = windows.received_in(log, windows.HISTORY_FIELDS["train"])
    return _rounded(fields.with_label(datasets.basic_set(history, datasets.find_hot(log))))


def assemble_v0(spark: SparkSession, folder: str) -> DataFrame:
    log = _kept(spark, folder).drop("row_id")
    sets = {name: windows.received_in(log, span) for name, span in windows.HISTORY_FIELDS.items()}
    return _rounded(datasets.assemble_v0(sets, datasets.find_hot(log)))


def _three_fields(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        log = _kept(spark, folder)
        built = datasets.three_fields(
            windows.received_in(log, windows.HISTORY_FIELDS[name]),
            windows.bought_in(log, windows.MIDDLE_FIELDS[name]),
            windows.received_in(log, windows.LABEL_FIELDS[name]),
            datasets.find_hot(log),
        )
        return _rounded(built)

    return run


def three_fields_test(spark: SparkSession, folder: str) -> DataFrame:
    log, label_rows = _kept(spark, folder), fields.clean(scoring_log(_log(spark, folder)))
    built = datasets.three_fields(
        windows.received_in(log, windows.HISTORY_FIELDS["test"]),
        windows.bought_in(log, windows.MIDDLE_FIELDS["test"]),
        label_rows,
        datasets.find_hot(log),
        labelled=False,
    )
    return _rounded(built)


# --- files --------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, folder: str, with_purchase: bool = True) -> str:
    """The log as lines of text, those of some users broken; the folder they are in."""
    group = F.col("user_id") % 50
    received = F.when((group == 9) & F.col("date_received").isNotNull(), "20160231").otherwise(F.date_format("date_received", "yyyyMMdd"))
    columns = [
        F.when(group == 7, F.concat(F.lit("u"), F.col("user_id"))).otherwise(F.col("user_id").cast("string")),
        F.when(group == 8, "").otherwise(F.col("merchant_id").cast("string")),
        F.col("coupon_id").cast("string"),
        F.col("discount_raw"),
        F.col("distance").cast("string"),
        received,
    ]
    if with_purchase:
        columns.append(F.date_format("date_used", "yyyyMMdd"))
    cells = F.array(*columns)
    whole = F.when(group == 10, F.slice(cells, 1, 4)).otherwise(cells)
    path = _scratch(spark, "lines")
    _log(spark, folder).select(F.array_join(whole, ",", "null").alias("line")).write.text(path)
    return path


def read_receipts(spark: SparkSession, folder: str) -> DataFrame:
    return log_files.read_with_rejects(spark, _lines(spark, folder), header=False)[0]


def read_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return log_files.read_with_rejects(spark, _lines(spark, folder, False), with_purchase=False, header=False)[0]


def rejected_lines(spark: SparkSession, folder: str) -> DataFrame:
    return log_files.read_with_rejects(spark, _lines(spark, folder), header=False)[1]


def staged_read_back(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark, "staged")
    sinks.write_staged(label_3way(spark, folder), path, partition_by=["label"])
    return log_files.read_table(spark, path)


def sets_read_back(spark: SparkSession, folder: str) -> DataFrame:
    log, path = _raw(_log(spark, folder)), _scratch(spark, "sets")
    spans = {"train": windows.received_in(log, windows.DATASET_1), "validate": windows.received_in(log, windows.DATASET_2)}
    sinks.write_sets(spans, path)
    return log_files.read_table(spark, path).select(*fields.RAW_COLUMNS, "split")


def submission_read_back(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark, "submission")
    scored = _log(spark, folder).where(fields.received()).withColumn("prob", F.coalesce(F.col("distance"), F.lit(0)) / 16)
    sinks.write_submission(scored, path)
    return spark.read.schema("user_id bigint, coupon_id bigint, date_received string, prob double").csv(path)


# --- evaluation ---------------------------------------------------------------


def _pseudo_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts with a score that needs no model, for the evaluation queries."""
    score = F.pmod(F.col("user_id") * 31 + F.col("coupon0"), F.lit(101)) / 101
    return fields.with_label(_receipts(spark, folder)).select("coupon0", "label", score.alias("prob"))


def coupon_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.coupon_auc(_pseudo_scores(spark, folder)))


def mean_coupon_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.mean_coupon_auc(_pseudo_scores(spark, folder)))


def mismatch_count(spark: SparkSession, folder: str) -> DataFrame:
    predicted = (F.col("prob") > 0.5).cast("double")
    return evaluation.mismatches(_pseudo_scores(spark, folder).withColumn("prediction", predicted))


def global_auc(spark: SparkSession, folder: str) -> DataFrame:
    # Many thousands of distinct scores, so that a thinned curve would show.
    score = F.pmod(F.col("user_id") * 7919 + F.col("coupon0") * 31, F.lit(100003)) / 100003
    scores = fields.with_label(_receipts(spark, folder)).select("label", score.alias("prob"))
    auc = evaluation.global_auc(scores, raw="prob")
    return _rounded(spark.createDataFrame([(auc,)], "auc double"))


# --- models -------------------------------------------------------------------


def scaled_predictors(spark: SparkSession, folder: str) -> DataFrame:
    rows = fields.stage(_log(spark, folder)).withColumn("discount_type", F.coalesce("discount_type", F.lit(0)))
    return _rounded(models.standardised(rows, models.LINEAR_PREDICTORS, ["user_id", "merchant_id"]))


def _gbt(spark: SparkSession, folder: str) -> tuple[DataFrame, boosting.Booster]:
    # Written raw: both sets and their first receipts read it, and it is joined from two tables.
    log = stored(_log(spark, folder), "log")
    return log, scoring.fit(datasets.training_set(log, scoring_log(log)))


def gbt_score(spark: SparkSession, folder: str) -> DataFrame:
    log, fitted = _gbt(spark, folder)
    return scoring.score(fitted, datasets.scoring_set(log, scoring_log(log)))


def gbt_importance(spark: SparkSession, folder: str) -> DataFrame:
    _, fitted = _gbt(spark, folder)
    return boosting.split_importance(fitted)


def gbt_offline_auc(spark: SparkSession, folder: str) -> DataFrame:
    log = _kept(spark, folder)
    hot = datasets.find_hot(log)

    def built(name: str) -> DataFrame:
        rows = windows.received_in(log, windows.HISTORY_FIELDS[name])
        return fields.with_label(datasets.basic_set(rows, hot))

    return scoring.evaluate_offline(
        built("train"), built("validate"), datasets.FIRST_PIPELINE_LEAVES_OUT, **scoring.FIRST_BOOSTER
    )


def _linear_rows(spark: SparkSession, folder: str) -> DataFrame:
    return fields.stage(_log(spark, folder)).where(F.col("label") != -1)


def elastic_net_cv(spark: SparkSession, folder: str) -> DataFrame:
    split = windows.stratified_split(_linear_rows(spark, folder))
    return penalised.fit_grid(split.where(F.col("split") == "train")).table(spark)


def _linear_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    split = models.cut_lineage(windows.stratified_split(_linear_rows(spark, folder)))
    return split.where(F.col("split") == "train"), split.where(F.col("split") == "validate")


def linear_score(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_linear(*_linear_split(spark, folder))


def linear_auc(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.evaluate_linear(*_linear_split(spark, folder))


def _exploration(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    log = _log(spark, folder)
    rows = log.select(
        "row_id",
        _event_date(),
        "user_id",
        "merchant_id",
        F.coalesce("coupon_id", F.lit(0)).cast("bigint").alias("coupon0"),
        discount.reduction_share(F.col("discount_raw")).alias("discount_share"),
        F.coalesce("distance", F.lit(0)).alias("distance"),
        labels.purchase_quadrant(F.col("coupon_id"), F.col("date_used")).alias("label"),
    )
    split = models.cut_lineage(windows.positional_split(rows, F.expr(SPLIT_POSITION), lead="event_date"))
    return split.where(F.col("split") == "train"), split.where(F.col("split") == "test")


def _predicted(fit) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        train, test = _exploration(spark, folder)
        model = fit(train)
        return models.predict_labels(model, test, ["user_id", "coupon0", "label"])

    return run


def knn_vote(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    held_out = F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1).isin("0", "1", "2")
    rows = vectors.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", held_out.alias("held_out")
    )
    train, test = rows.where(~F.col("held_out")), rows.where(F.col("held_out"))
    return neighbours.knn_vote(train, test.select("id", "vector"), k=5)


_FEATURE_SPANS = {1: windows.FEATURE_1, 2: windows.FEATURE_2, 3: windows.FEATURE_3}

_QUERIES: dict[str, Query] = {
    "training_set": training_set,
    "clean_discounts": clean_discounts,
    "staged_discounts": staged_discounts,
    "date_numbers": date_numbers,
    "label_15d": label_15d,
    "label_3way": label_3way,
    "label_4way": label_4way,
    "label_distribution": label_distribution,
    "labelled_rows": labelled_rows,
    "quadrants": quadrants,
    "null_profile": null_profile,
    "value_domain": value_domain,
    "distance_domain": distance_domain,
    "date_span": date_span,
    "cold_users": cold_users,
    "cold_merchants": cold_merchants,
    "preview": preview,
    **{f"feature_window_{i}": _window(windows.active_in, span) for i, span in _FEATURE_SPANS.items()},
    "dataset_window_1": _window(windows.received_in, windows.DATASET_1),
    "dataset_window_1_as_written": _window(windows.received_in, windows.DATASET_1_AS_WRITTEN),
    "dataset_window_2": _window(windows.received_in, windows.DATASET_2),
    "scoring_rows": scoring_rows,
    "history_field": _fields(windows.received_in, windows.HISTORY_FIELDS),
    "middle_field": _fields(windows.bought_in, windows.MIDDLE_FIELDS),
    "label_field": _fields(windows.received_in, windows.LABEL_FIELDS),
    "stratified_split": stratified_split,
    "stratified_folds": stratified_folds,
    "date_split": date_split,
    "positional_split": positional_split,
    "user_counts": _users(entities.USER_COUNTS),
    "user_distincts": _users(entities.USER_DISTINCTS),
    "user_stats": _users(entities.USER_STATS),
    "user_frequency": _users(entities.USER_FREQUENCY),
    "user_gaps": _users(entities.USER_GAPS),
    "user_features": _users(entities.USER_FEATURES),
    "user_features_v0": _users(entities.USER_FEATURES_V0),
    "merchant_counts": _merchants(entities.MERCHANT_COUNTS),
    "merchant_stats": _merchants(entities.MERCHANT_STATS),
    "merchant_gaps": _merchants(entities.MERCHANT_GAPS),
    "merchant_features_v0": _merchants(entities.MERCHANT_FEATURES_V0),
    "coupon_features": coupon_features,
    "coupon_features_v0": coupon_features_v0,
    "redemption_rates": redemption_rates,
    "merchant_rates": merchant_rates,
    "basic_counts": basic_counts,
    "v0_row_features": v0_row_features,
    **{f"interaction_{size}": _interaction(size) for size in range(1, 6)},
    "receipt_order": receipt_order,
    "receipt_gaps": receipt_gaps,
    "receipt_bounds": receipt_bounds,
    "repeat_flags": repeat_flags,
    "first_receipt": first_receipt,
    "first_dates": first_dates,
    "weekday_onehot": weekday_onehot,
    "distance_onehot": distance_onehot,
    "holiday_flag": holiday_flag,
    "day_of_month": day_of_month,
    "assemble_window": assemble_window,
    "training_set_as_written": training_set_as_written,
    "scoring_set": scoring_set,
    "basic_set": basic_set,
    "assemble_v0": assemble_v0,
    "three_fields": _three_fields("train"),
    "three_fields_validate": _three_fields("validate"),
    "three_fields_test": three_fields_test,
    "read_receipts": read_receipts,
    "read_scoring": read_scoring,
    "rejected_lines": rejected_lines,
    "staged_read_back": staged_read_back,
    "sets_read_back": sets_read_back,
    "submission_read_back": submission_read_back,
    "coupon_auc": coupon_auc,
    "mean_coupon_auc": mean_coupon_auc,
    "mismatch_count": mismatch_count,
    "global_auc": global_auc,
    "scaled_predictors": scaled_predictors,
    "knn_vote": knn_vote,
    "gbt_score": gbt_score,
    "gbt_importance": gbt_importance,
    "gbt_offline_auc": gbt_offline_auc,
    "elastic_net_cv": elastic_net_cv,
    "linear_score": linear_score,
    "linear_auc": linear_auc,
    "naive_bayes_gaussian": _predicted(
        lambda train: models.fit_naive_bayes(train, models.EXPLORATION_PREDICTORS, kind="gaussian")
    ),
    "naive_bayes_multinomial": _predicted(
        lambda train: models.fit_naive_bayes(train, models.EXPLORATION_PREDICTORS, kind="multinomial", smoothing=0.1)
    ),
    "linear_svc": _predicted(lambda train: models.fit_linear_svc(train, models.EXPLORATION_PREDICTORS)),
}


def entry(spark: SparkSession) -> DataFrame:
    """The flagship job: the labelled training set of the coupon log."""
    return training_set(spark, ENTRY_FOLDER)


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the training-data operators, where that subpackage and its pipeline are there."""
    try:
        found = importlib.util.find_spec("couponlab.llm.queries") and importlib.util.find_spec("corpus_pipeline")
    except ModuleNotFoundError:
        found = None
    if not found:
        return {}, {}
    import corpus_pipeline
    from couponlab.llm import queries as training_data

    sql = dict(training_data.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**training_data.QUERIES, "pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Query]:
    """Every query, by name; each takes a session and a folder of tables."""
    return {**_QUERIES, **_training_data()[0]}


def oracle_sql() -> dict[str, str]:
    """Equivalent SQL for the queries that have one; models have none."""
    return {**oracle_queries.sql(), **_training_data()[1]}
