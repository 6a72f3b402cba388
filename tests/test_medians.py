"""Medians and sums in order, from ranks in sorted frequency tables."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from couponlab.functions import fields
from couponlab.operators import entities, features, skew
from couponlab.operators.features import Feature, entity_features
from conftest import bag, make_log

SPREAD = [
    Feature("middle", "median", "all", "min_cost_of_manjian"),
    Feature("middle_received", "median", "recv", "min_cost_of_manjian"),
    Feature("rate_middle", "median", "all", "discount_rate"),
    Feature("rate_mean", "mean", "all", "discount_rate"),
    Feature("rate_mean_received", "mean", "recv", "discount_rate"),
]


def cleaned(spark, rows):
    """Cleaned rows of (user, threshold, rate, received)."""
    schema = "user_id bigint, min_cost_of_manjian int, discount_rate double, received boolean"
    frame = spark.createDataFrame(rows, schema)
    day = F.when(F.col("received"), F.to_date(F.lit("2016-04-02")))
    return frame.withColumn("date_received", day).withColumn("date_used", F.lit(None).cast("date"))


def both_ways(rows, of=SPREAD):
    """The features ranked bin by bin, in one sort, and from counters."""
    return [
        entity_features(rows, "user_id", of, few_values=False),
        entity_features(rows, "user_id", of, many=True),
        entity_features(rows, "user_id", of),
    ]


def test_ranks_equal_plain_medians(spark):
    draw = random.Random(5)
    sizes = {1: 1, 2: 2, 3: 7, 4: 64, 5: 401}
    value = lambda: draw.choice([-1, 0, 5, 5, 30, 31, draw.randrange(10**6), -draw.randrange(10**4)])
    rate = lambda: draw.choice([0.9, 1.0, draw.random(), draw.random() * 1e-9, draw.random() * 1e12, -draw.random()])
    rows = [(u, value(), rate(), draw.random() < 0.5) for u, n in sizes.items() for _ in range(n)]
    rows += [(6, 4, 0.5, False)]
    for found in both_ways(cleaned(spark, rows)):
        table = {r["user_id"]: r for r in found.collect()}
        assert set(table) == {r[0] for r in rows}
        for user, row in table.items():
            mine = [r for r in rows if r[0] == user]
            got = [r for r in mine if r[3]]
            assert row["middle"] == statistics.median(r[1] for r in mine)
            assert row["middle_received"] == (statistics.median(r[1] for r in got) if got else 0)
            assert row["rate_middle"] == pytest.approx(statistics.median(r[2] for r in mine), rel=1e-15)
            assert row["rate_mean"] == pytest.approx(math.fsum(r[2] for r in mine) / len(mine), rel=1e-9)
            assert row["rate_mean_received"] == pytest.approx(math.fsum(r[2] for r in got) / len(got) if got else 0, rel=1e-9)


def test_missing_keys_and_special_values(spark):
    top, low = float("inf"), float("-inf")
    rows = [(None, 3, 0.5, True), (None, 5, 0.7, True), (1, 7, None, True), (2, 1, top, True), (2, 1, 0.5, True), (2, 1, low, True)]
    rows += [(3, 2, float("nan"), True), (3, 2, 4.0, True), (3, 2, top, True), (4, -(2**31), 0.0, True), (4, 2**31 - 1, -0.0, True)]
    for found in both_ways(cleaned(spark, rows)):
        table = {r["user_id"]: r for r in found.collect()}
        assert (table[None]["middle"], table[None]["rate_middle"]) == (4.0, 0.6)
        assert (table[1]["middle"], table[1]["rate_middle"], table[1]["rate_mean"]) == (7.0, 0.0, 0.0)
        # A nan lies above infinity, as Spark sorts it.
        assert (table[2]["rate_middle"], table[3]["rate_middle"]) == (0.5, top)
        assert (table[4]["middle"], table[4]["rate_middle"]) == (-0.5, 0.0)
    assert all(found.count() == 0 for found in both_ways(cleaned(spark, rows).limit(0)))


def test_bins_never_fall(spark):
    draw = random.Random(8)
    values = sorted([draw.choice([-1, 1]) * math.exp(draw.uniform(-700, 700)) for _ in range(4000)] + [0.0, 5e-324, 1.7e308, -1.7e308])
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "at int, real double").withColumn("whole", F.lit(None).cast("bigint"))
    bins = [r["bin"] for r in frame.select("at", features._bin().alias("bin")).orderBy("at").collect()]
    assert bins == sorted(bins) and len(set(bins)) > 1000


def test_a_million_values_of_one_entity(spark):
    """Every value is new and one entity has them all: bins spread over the tasks, and nothing is kept in memory."""
    count = 1_000_000
    prices = spark.range(0, count, 1, 8).select(
        F.lit(1).cast("bigint").alias("user_id"),
        F.pmod(F.col("id") * 7919, F.lit(count)).cast("int").alias("min_cost_of_manjian"),
        (F.col("id") / 3).alias("discount_rate"),
        F.to_date(F.lit("2016-04-02")).alias("date_received"),
        F.lit(None).cast("date").alias("date_used"),
    )
    counted = features._frequencies(prices, ["user_id"], ["min_cost_of_manjian"]).withColumn("bin", features._bin())
    per_bin = counted.groupBy("bin").count()
    assert per_bin.count() > 2000 and per_bin.agg(F.max("count")).first()[0] < count / 200
    row = entity_features(prices, "user_id", SPREAD, few_values=False).first()
    assert row["middle"] == (count - 1) / 2
    assert row["rate_middle"] == pytest.approx((count - 1) / 6, rel=1e-15)
    assert row["rate_mean"] == pytest.approx((count - 1) / 6, rel=1e-9)


def test_no_aggregate_holds_objects(spark, star_log):
    log = fields.clean(star_log)
    wide = entity_features(log, "merchant_id", entities.MERCHANT_FEATURES, few_values=False)
    for table in (entities.user_features(log), wide):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "percentile" not in plan
    assert bag(wide) == bag(entity_features(log, "merchant_id", entities.MERCHANT_FEATURES))


def test_hot_users_are_ranked_in_bins(spark, star_log):
    log = fields.clean(star_log)
    hot = skew.hot_keys(log, ["user_id"], floor=60)
    assert hot is not None
    assert bag(entities.user_features(log, hot=hot)) == bag(entities.user_features(log))


def test_edge_rows_either_way(spark):
    log = fields.clean(make_log(spark, [(1, 1, 100, r, 1, "20160402", None) for r in ("0.9", "0.8", "100:30", "30:1")]))
    for found in both_ways(log):
        assert found.first()["rate_middle"] == statistics.median([0.9, 0.8, 0.7, 29 / 30])
