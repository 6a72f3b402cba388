"""Readers and writers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponlab.functions import fields
from couponlab.sources import log_files, sinks
from couponlab.sources.star_tables import scoring_log
from conftest import bag, day

TRAIN = """User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received,Date
1,10,100,100:10,0,20160402,20160417
2,11,null,null,null,null,20160405
3,12,102,0.9,3,20160206,null
4,12,,,,,20160405
"""
TEST = """User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received
1,10,100,100:10,null,20160702
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "train.csv").write_text(TRAIN)
    (tmp_path / "test.csv").write_text(TEST)
    return tmp_path


def test_read_receipts(spark, files):
    log = log_files.read_receipts(spark, str(files / "train.csv"))
    assert log.columns == fields.RAW_COLUMNS
    rows = {r["user_id"]: r for r in log.collect()}
    assert rows[1]["date_used"] == day("20160417") and rows[1]["discount_raw"] == "100:10"
    assert tuple(rows[2])[2:6] == (None, None, None, None)
    assert tuple(rows[4])[2:6] == (None, None, None, None)
    assert rows[3]["date_used"] is None and rows[3]["distance"] == 3


def test_read_scoring(spark, files):
    (row,) = log_files.read_scoring(spark, str(files / "test.csv")).collect()
    assert row["date_received"] == day("20160702") and row["date_used"] is None and row["distance"] is None


def test_read_online_takes_a_schema(spark, files):
    schema = T.StructType([T.StructField("User_id", T.LongType()), T.StructField("Action", T.StringType())])
    (files / "online.csv").write_text("User_id,Action\n1,null\n2,1\n")
    assert bag(log_files.read_online(spark, str(files / "online.csv"), schema)) == [("1", 2), (None, 1)]


def test_row_ids_tell_copies_apart(spark, edge_log):
    numbered = log_files.with_row_id(edge_log.drop("row_id"))
    assert numbered.select("row_id").distinct().count() == 11


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc"])
def test_staged_table_round_trip(spark, edge_log, tmp_path, fmt):
    staged = fields.stage(edge_log)
    path = str(tmp_path / fmt)
    sinks.write_staged(staged, path, fmt)
    if fmt == "csv":
        back = spark.read.schema(staged.schema).csv(path, header=True, nullValue="null")
    else:
        back = spark.read.format(fmt).load(path)
    assert bag(back) == bag(staged)


def test_sets_are_partitioned_by_split(spark, edge_log, tmp_path):
    path = str(tmp_path / "sets")
    sinks.write_sets({"train": edge_log, "test": scoring_log(edge_log, "2016-04-30")}, path)
    back = log_files.read_table(spark, path)
    assert {(r["split"], r["count"]) for r in back.groupBy("split").count().collect()} == {("train", 11), ("test", 2)}


def test_submission_and_predictions_have_no_header(spark, tmp_path):
    scores = spark.createDataFrame([(1, 100, day("20160702"), 0.25)], "user_id bigint, coupon_id bigint, date_received date, prob double")
    sinks.write_submission(scores, str(tmp_path / "scores"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "scores")).collect()] == ["1,100,20160702,0.25"]
    sinks.write_predictions(scores.select(F.lit(1).alias("prediction")), str(tmp_path / "labels"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "labels")).collect()] == ["1"]


BROKEN = """User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received,Date
1,10,100,100:10,0,20160402,20160417
x,10,100,100:10,0,20160402,null
2,,100,0.9,0,20160402,null
3,10,100,0.9,0,20160231,null
4,10,100,0.9,0,20160402,2016-05-01
5,10,100
6,10,100,0.9,0,20160402,null,7

7,10,null,null,null,null,20160405
"""


def test_every_line_is_a_row_or_a_reject(spark, tmp_path):
    (tmp_path / "broken.csv").write_text(BROKEN)
    rows, rejects = log_files.read_with_rejects(spark, str(tmp_path / "broken.csv"))
    assert rows.columns == fields.RAW_COLUMNS
    assert sorted(r["user_id"] for r in rows.collect()) == [1, 7]
    assert {r["line"][:2]: r["reason"] for r in rejects.collect()} == {
        "x,": "fields", "2,": "key", "3,": "date", "4,": "date", "5,": "fields", "6,": "fields"
    }
    # No column asked for changes what is broken.
    assert (rows.count(), rows.select("merchant_id").count(), rejects.count(), rejects.select("line").count()) == (2, 2, 6, 6)
    reasons = {r["reason"]: r["count"] for r in rejects.groupBy("reason").count().collect()}
    assert reasons == {"fields": 3, "key": 1, "date": 2}


def test_scoring_lines_are_judged_too(spark, tmp_path):
    (tmp_path / "test.csv").write_text(TEST + "2,10,100,0.9,1,2016\n3,10,100,0.9,1\n")
    rows, rejects = log_files.read_with_rejects(spark, str(tmp_path / "test.csv"), with_purchase=False)
    assert [r["user_id"] for r in rows.collect()] == [1] and rows.columns == fields.RAW_COLUMNS
    assert sorted(r["reason"] for r in rejects.collect()) == ["date", "fields"]
    (tmp_path / "none.csv").write_text(TEST.splitlines()[0] + "\n")
    rows, rejects = log_files.read_with_rejects(spark, str(tmp_path / "none.csv"), with_purchase=False)
    assert (rows.count(), rejects.count()) == (0, 0)
