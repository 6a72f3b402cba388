"""Work and memory of a task as tables grow: what is dealt by rows, what is read once, what is not moved."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from couponlab.operators import counts, entities, models, selection, skew, windows
from couponlab.functions import fields


def log_of(spark, n: int):
    """A raw log of ``n`` rows, ten to a user."""
    day = F.date_add(F.lit("2016-01-01").cast("date"), (F.col("id") % 200).cast("int"))
    return spark.range(n).select(
        F.col("id").cast("string").alias("row_id"),
        (F.col("id") / 10).cast("bigint").alias("user_id"),
        (F.col("id") % 7).alias("merchant_id"),
        (F.col("id") % 13).alias("coupon_id"),
        F.lit("100:10").alias("discount_raw"),
        (F.col("id") % 11).cast("int").alias("distance"),
        day.alias("date_received"),
        F.when(F.col("id") % 3 == 0, day).alias("date_used"),
    )


@pytest.mark.parametrize("n, tasks", [(990, 10), (5000, 50)])
def test_tasks_follow_the_rows(spark, monkeypatch, n, tasks):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    log = fields.clean(log_of(spark, n))
    assert skew.tasks(log) == tasks and skew.tasks(log.limit(0)) == 1
    counted = counts.attach_counts(log, counts.BASIC_COUNTS)
    assert counted.rdd.getNumPartitions() == tasks and counted.count() == n
    assert entities.user_features(log).rdd.getNumPartitions() == tasks


def counting(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(count, rows.schema), seen


def test_cut_lineage_works_its_rows_out_once(spark):
    rows, seen = counting(spark, spark.range(500).toDF("id"))
    kept = models.cut_lineage(rows)
    assert kept.count() == 500 and kept.agg(F.sum("id")).head()[0] == 500 * 499 // 2
    assert seen.value == 500


@pytest.mark.parametrize("small", [0, 100])
def test_rows_stay_where_a_small_table_meets_them(spark, monkeypatch, small):
    monkeypatch.setattr(skew, "SMALL_TABLE", small)
    rows = spark.range(900).select("id", (F.col("id") % 7).alias("key")).unionByName(spark.sql("SELECT 900L AS id, NULL AS key"))
    lookup = spark.range(5).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.join_entities(rows, lookup, ["key"])
        found = {r["id"]: r["twice"] for r in joined.collect()}
        moved = "hashpartitioning" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {i: 2 * (i % 7) if i < 900 and i % 7 < 5 else None for i in range(901)}
    assert moved == (small == 0)


def test_copies_of_a_place_reach_the_driver_once(spark, monkeypatch):
    """And later passes read what the earlier ones left."""
    monkeypatch.setattr(selection, "SMALL", 100)
    monkeypatch.setattr(selection, "SPLITTERS", 64)
    kept, drawn, stored, cuts = [], [], selection.stored, selection._cuts
    monkeypatch.setattr(selection, "stored", lambda rows, name: (table := stored(rows, name), kept.append(table.count()))[0])
    monkeypatch.setattr(selection, "_cuts", lambda rows, search: (drawn.append(len(rows)), cuts(rows, search))[1])
    rows = spark.range(8000).select(F.when(F.col("id") < 4000, "same").otherwise(F.col("id").cast("string")).alias("row_id"))
    split = windows.positional_split(rows.withColumn("lead", F.lit("day")), 3000, lead="lead")
    order = sorted((r["h"], r["row_id"]) for r in rows.withColumn("h", F.md5("row_id")).collect())
    edge = order[2999]
    train = sorted((r["h"], r["row_id"]) for r in split.where("split = 'train'").withColumn("h", F.md5("row_id")).collect())
    assert train == [o for o in order if o <= edge]
    assert max(drawn) < 300 and all(n < 8000 / 4 for n in kept)


def test_counts_of_few_keys_are_sent_to_the_rows(spark, monkeypatch):
    log = fields.clean(log_of(spark, 900)).select("user_id", "merchant_id", "coupon0", "discount_rate", "distance", "date_received")
    log = log.withColumn("merchant_id", F.when(F.col("user_id") > 3, F.col("merchant_id")))
    some = {"of_distance": ["distance"], "of_day": ["merchant_id", "date_received"]}
    sets, found = {}, {}
    grained = counts._from_grain
    monkeypatch.setattr(counts, "_from_grain", lambda rows, asked, source: (sets.update({small: sorted(asked)}), grained(rows, asked, source))[1])
    for small in (0, 50, 5000):
        monkeypatch.setattr(skew, "SMALL_TABLE", small)
        made = counts.attach_counts(log, some)
        found[small] = made.columns, sorted(map(str, made.collect()))
    assert sets == {0: ["of_day", "of_distance"], 50: ["of_day"]}
    assert found[0] == found[50] == found[5000]
