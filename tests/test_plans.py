"""Physical plans have the shape the scale notes promise."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from couponlab.functions import fields
from couponlab.operators import counts, entities, receipts, windows
from couponlab.plans import datasets
from couponlab.sources import log_files, sinks


def plan(frame) -> str:
    frame.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange (?:hash|range|single|roundrobin)\w*\(?[^\n]*", text)


def stored_log(spark, star_log, folder):
    sinks.write_staged(star_log, str(folder))
    return log_files.read_table(spark, str(folder))


def test_user_features_shuffle_the_log_once(spark, star_log, tmp_path):
    log = fields.clean(stored_log(spark, star_log, tmp_path / "log"))
    text = plan(entities.user_features(log))
    assert "Expand" not in text
    assert len(exchanges(text)) == 1
    assert "PythonUDF" not in text


def test_merchant_features_combine_before_each_shuffle(spark, star_log, tmp_path):
    log = fields.clean(stored_log(spark, star_log, tmp_path / "log"))
    text = plan(entities.merchant_features(log))
    assert "Expand" not in text
    assert len(exchanges(text)) == 2
    assert text.count("partial_") > 0


def test_user_counts_share_one_shuffle(spark, star_log, tmp_path):
    rows = fields.clean(stored_log(spark, star_log, tmp_path / "log")).where(fields.received())
    wanted = {
        name: keys
        for size in range(1, 6)
        for name, keys in counts.interaction_counts(size).items()
        if "user_id" in keys
    }
    text = plan(counts.attach_counts(rows, wanted))
    assert len(exchanges(text)) == 1
    assert len(re.findall(r"\bSort \[", text)) <= 14


def test_receipt_order_counts_days_before_its_window(spark, star_log, tmp_path):
    rows = fields.clean(stored_log(spark, star_log, tmp_path / "log")).where(fields.received())
    text = plan(receipts.attach_receipt_features(rows, within=["discount_raw"]))
    assert "partial_count" in text
    # A frame from the next row on would be read again for every row.
    assert not re.search(r"specifiedwindowframe\((Row|Range)Frame, (currentrow\$\(\)|-?\d+), unboundedfollowing\$\(\)\)", text)
    # The sides of the join back are shuffled for it, so a day of very many copies can be split.
    assert len(re.findall(r"ENSURE_REQUIREMENTS", text)) == len(exchanges(text))


def test_many_receipts_of_one_coupon(spark):
    rows = spark.range(200_000).select(
        F.lit(1).cast("bigint").alias("user_id"),
        F.lit(2).cast("bigint").alias("coupon0"),
        F.date_add(F.lit("2016-01-01"), (F.col("id") % 150).cast("int")).alias("date_received"),
    )
    start = time.perf_counter()
    found = receipts.attach_sequence(rows).agg(F.count("*"), F.sum("gap_sum"), F.sum("day_gap_after")).first()
    assert time.perf_counter() - start < 60
    last = 200_000 // 150
    assert tuple(found) == (200_000, 200_000 * 149, 200_000 - 2 * last)


def test_windows_reach_the_scan(spark, star_log, tmp_path):
    log = stored_log(spark, star_log, tmp_path / "log")
    text = plan(windows.active_in(log, windows.FEATURE_1).select("user_id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: (.*)", text)
    assert "GreaterThanOrEqual(date_used" in pushed.group(1)
    assert "GreaterThanOrEqual(date_received" in pushed.group(1)
    assert "merchant_id" not in pushed.group(2)


def test_assembly_keeps_copies_out_in_one_shuffle(spark, star_log, tmp_path):
    log = fields.clean(stored_log(spark, star_log, tmp_path / "log").drop("row_id"))
    kept = datasets.assemble(log, windows.received_in(log, windows.DATASET_2))
    distinct = datasets.assemble(log, windows.received_in(log, windows.DATASET_2), distinct=True)
    assert len(exchanges(plan(distinct))) <= len(exchanges(plan(kept))) + 1


def test_no_python_in_assembly(spark, star_log, tmp_path):
    log = stored_log(spark, star_log, tmp_path / "log")
    text = plan(datasets.training_set(log, log.drop("date_used")))
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_hot_keys_do_not_multiply_the_plan(spark, star_log, tmp_path):
    log = fields.clean(stored_log(spark, star_log, tmp_path / "log").drop("row_id"))
    hot = datasets.find_hot(log, floor=60)
    assert hot["user_id"] is not None and hot["merchant_id"] is not None
    dataset = windows.received_in(log, windows.DATASET_2)
    # The rows, their days and their merchant days; each entity table reads the
    # history once, and the user table once more for its hot keys.
    assert plan(datasets.assemble(log, dataset)).count("FileScan") == 6
    assert plan(datasets.assemble(log, dataset, hot)).count(str(tmp_path)) <= 8
