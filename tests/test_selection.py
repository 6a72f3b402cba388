"""Exact splits by repeated refinement."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from couponlab.operators import selection, windows


def by_hand(rows, lead, at):
    ordered = sorted(rows, key=lambda r: ("" if r[lead] is None else str(r[lead]), r["h"], r["row_id"]))
    return {r["row_id"]: "train" if i < at else "test" for i, r in enumerate(ordered)}


@pytest.fixture(params=[3, 40, 10_000])
def small(request, monkeypatch):
    """Intervals that need many passes, a few, and none."""
    monkeypatch.setattr(selection, "SMALL", request.param)
    monkeypatch.setattr(selection, "SPLITTERS", 8)


LEADS = {
    "one day": "DATE '2016-05-01'",
    "timestamps": "timestamp_micros(1450000000000000 + pmod(xxhash64(id), 1000000000000))",
    "days and nulls": "if(id % 7 > 0, date_add(DATE '2016-01-01', int(id % 50)), NULL)",
}


@pytest.mark.parametrize("lead", LEADS)
def test_positional_split(spark, small, lead):
    rows = spark.range(700).select(F.col("id").cast("string").alias("row_id"), F.expr(LEADS[lead]).alias("lead"))
    known = rows.select("row_id", F.col("lead").cast("string").alias("lead"), F.md5("row_id").alias("h")).collect()
    for at in (0, 1, 333, 699, 700, 900):
        found = {r["row_id"]: r["split"] for r in windows.positional_split(rows, at, lead="lead").collect()}
        assert found == by_hand(known, "lead", at), at


def test_stratified_folds_with_a_null_group(spark, small):
    label = F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2).alias("label")
    rows = spark.range(600).select(F.col("id").cast("string").alias("row_id"), label)
    folds = windows.stratified_folds(rows, 4).withColumn("h", F.md5("row_id")).collect()
    for label in (None, 0, 1):
        mine = sorted((r for r in folds if r["label"] == label), key=lambda r: (r["h"], r["row_id"]))
        edges = [len(mine) * i // 4 for i in range(1, 4)]
        assert [r["fold"] for r in mine] == [sum(i >= e for e in edges) for i in range(len(mine))]


def test_rows_the_order_does_not_tell_apart(spark, small):
    rows = spark.range(90).select(F.lit("same").alias("row_id"), F.lit(None).cast("date").alias("lead"))
    assert windows.positional_split(rows, 30, lead="lead").count() == 90


def test_the_input_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(500).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 2).alias("label"))
    split = windows.stratified_split(rows.mapInArrow(count, rows.schema))
    assert split.where("split = 'validate'").count() == 100 and split.count() == 500
    assert seen.value == 500


def test_empty_rows(spark):
    rows = spark.createDataFrame([], "row_id string, label int, lead date")
    assert windows.stratified_split(rows).collect() == [] and windows.positional_split(rows, 5, lead="lead").collect() == []
