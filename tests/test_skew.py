"""The hot-key paths give the rows of the ordinary paths."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from couponlab.functions import fields
from couponlab.operators import counts, entities, receipts, skew, windows
from couponlab.plans import datasets
from conftest import bag


@pytest.fixture(scope="module")
def skewed(spark, star_log):
    """A log in which one user holds a third of the rows, many of them copies."""
    moved = star_log.withColumn(
        "user_id", F.when(F.pmod(F.xxhash64("row_id"), F.lit(3)) == 0, F.lit(-7)).otherwise(F.col("user_id"))
    )
    copies = moved.where("user_id = -7").limit(50).withColumn("row_id", F.concat("row_id", F.lit("-copy")))
    return fields.clean(moved.unionByName(copies)).cache()


@pytest.fixture(scope="module")
def hot(skewed):
    return datasets.find_hot(skewed, floor=60)


def test_hot_keys_are_found(skewed, hot):
    expected = skewed.groupBy("user_id").count().where("count > 60").select("user_id")
    assert bag(hot["user_id"].select("user_id")) == bag(expected)
    assert (-7,) in bag(hot["user_id"].select("user_id"))
    assert bag(skew.hot_keys(skewed, ["user_id"], floor=60).select("user_id")) == bag(expected)
    assert skew.hot_keys(skewed, ["user_id"]) is None
    assert datasets.find_hot(skewed) == {"user_id": None, "merchant_id": None, "coupon0": None}


def test_left_join(skewed, hot):
    table = entities.merchant_features(skewed.where("merchant_id < 6"), entities.MERCHANT_COUNTS)
    rows = skewed.select("row_id", "merchant_id")
    plain = rows.join(table, ["merchant_id"], "left")
    assert bag(skew.left_join(rows, table, ["merchant_id"], hot["merchant_id"])) == bag(plain)
    assert hot["merchant_id"] is not None
    thin = skew.left_join(rows, table, ["merchant_id"], hot["merchant_id"], share=20)
    assert bag(thin) == bag(plain)


def test_user_features(skewed, hot):
    assert bag(entities.user_features(skewed, hot=hot["user_id"])) == bag(entities.user_features(skewed))


@pytest.mark.parametrize("size", [1, 3, 4])
def test_interaction_counts(skewed, hot, size):
    rows = skewed.where(fields.received()).select("row_id", *counts.COLUMNS.values())
    wanted = counts.interaction_counts(size)
    assert bag(counts.attach_counts(rows, wanted, hot["user_id"])) == bag(counts.attach_counts(rows, wanted))


def test_assembled_window(skewed, hot):
    log = skewed.drop("row_id")
    dataset, history = windows.received_in(log, windows.DATASET_2), windows.active_in(log, windows.FEATURE_2)
    assert bag(datasets.assemble(history, dataset, hot, distinct=True)) == bag(
        datasets.assemble(history, dataset, distinct=True)
    )


def test_interaction_names():
    names = [name for size in range(1, 6) for name in counts.interaction_counts(size)]
    assert [len(counts.interaction_counts(size)) for size in range(1, 6)] == [6, 14, 10, 15, 5]
    assert len(set(names)) == 50
    assert "unite_user_id_merchant_id_date_received_receive_cnt" in names


def test_chains_cover_all_sets_in_few_sorts():
    led = [k for size in range(1, 6) for k in counts.interaction_counts(size).values() if "user_id" in k]
    chains = counts._chains(led, list(counts.COLUMNS.values()))
    assert sorted(map(tuple, led)) == sorted(tuple(s) for chain in chains for s in chain)
    assert len(led) == 30 and len(chains) <= 14


def joins_of(frame) -> list[str]:
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    return [line for line in plan.splitlines() if "SortMergeJoin" in line]


def test_no_count_joins_on_a_bare_key(spark, skewed, hot):
    """Nine tenths of the rows are one user's; all joins of counts are spread by a salt."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = skewed.where(fields.received()).select("row_id", *counts.COLUMNS.values())
        heavy = rows.withColumn("user_id", F.when(F.pmod(F.xxhash64("row_id"), F.lit(10)) > 0, F.lit(-7)).otherwise(F.col("user_id")))
        for size in (1, 2, 5):
            wanted = counts.interaction_counts(size)
            spread = counts._from_grain(heavy, wanted)
            assert len(joins_of(spread)) == len(wanted) + 1
            assert all("__salt" in j or "__copy" in j for j in joins_of(spread))
            assert bag(spread) == bag(counts.attach_counts(heavy, wanted))
        repeats = counts.attach_repeats(heavy, {**counts.COUPON_REPEAT, **counts.MERCHANT_REPEAT})
        assert len(joins_of(repeats)) == 2 and all("__salt" in j for j in joins_of(repeats))
        for keys in (*counts.COUPON_REPEAT.items(), *counts.MERCHANT_REPEAT.items()):
            name, by = keys
            alike = heavy.groupBy(*by).agg((F.count("*") > 1).cast("int").alias(name))
            assert bag(repeats.select("row_id", name)) == bag(heavy.join(alike, by).select("row_id", name))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_one_key_are_spread_evenly(skewed):
    rows = skewed.where("user_id = -7").select("row_id", *counts.COLUMNS.values())
    of = rows.withColumn("salt", counts._salt(["row_id"])).groupBy("salt").count().collect()
    assert len(of) == counts.SALTS and max(r["count"] for r in of) < 4 * rows.count() / counts.SALTS
