"""Results against brute force on generated rows."""

from __future__ import annotations

import itertools
import statistics
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from couponlab.functions import fields
from couponlab.operators import counts, entities, evaluation, neighbours, receipts, windows
from conftest import bag, make_log

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

dates = st.one_of(st.none(), st.integers(0, 40).map(lambda i: f"2016{4 + i // 30:02d}{i % 30 + 1:02d}"))
log_rows = st.lists(
    st.tuples(
        st.integers(1, 3),
        st.integers(1, 3),
        st.one_of(st.none(), st.integers(1, 3)),
        st.sampled_from([None, "0.9", "100:10", "30:5", "200:20"]),
        st.one_of(st.none(), st.integers(0, 3)),
        dates,
        dates,
    ),
    min_size=1,
    max_size=40,
)


@FEW
@given(rows=log_rows)
def test_sequence_matches_brute_force(spark, rows):
    log = fields.clean(make_log(spark, rows)).where(fields.received())
    days = defaultdict(list)
    for r in log.collect():
        days[r["user_id"], r["coupon0"]].append(r["date_received"])
    for r in receipts.attach_sequence(log).collect():
        own, all_days = r["date_received"], sorted(days[r["user_id"], r["coupon0"]])
        before = [(own - d).days for d in all_days if d < own]
        after = [(d - own).days for d in all_days if d > own]
        gaps = [(b - a).days for a, b in itertools.pairwise(all_days)]
        assert r["day_gap_before"] == (min(before) if before else -1)
        assert r["day_gap_after"] == (min(after) if after else -1)
        assert r["gap_sum"] == sum(gaps)
        assert r["gap_mean"] == pytest.approx(sum(gaps) / len(all_days))
        assert r["is_first_receipt"] == int(own == all_days[0])
        assert r["this_month_user_receive_same_coupon_lastone"] == int(own == all_days[-1])


@FEW
@given(rows=log_rows)
def test_user_features_match_brute_force(spark, rows):
    log = fields.clean(make_log(spark, rows))
    groups = defaultdict(list)
    for r in log.collect():
        groups[r["user_id"]].append(r)
    for f in entities.user_features(log).collect():
        mine = groups[f["user_id"]]
        used = [r for r in mine if r["date_used"]]
        assert f["field_user_id_record_cnt"] == len(mine)
        assert f["field_user_id_record_cnt"] == (
            f["field_user_id_consume_cnt"] + f["field_user_id_receive_and_not_consume_cnt"]
        )
        assert f["field_user_id_consume_differ_coupon_id_cnt"] == len({r["coupon0"] for r in used})
        assert f["field_user_id_consume_diff_discount_rate_cnt"] == len({r["discount_rate"] for r in used})
        assert f["field_user_id_discount_rate_median"] == pytest.approx(
            statistics.median(r["discount_rate"] for r in mine)
        )
        assert f["field_user_id_discount_rate_mean"] == pytest.approx(
            statistics.mean(r["discount_rate"] for r in mine)
        )
        assert f["field_user_id_reduce_manjian_median"] == statistics.median(r["reduce_manjian"] for r in mine)
        redeemed = [
            (r["date_used"] - r["date_received"]).days
            for r in mine
            if r["date_used"] and r["date_received"] and (r["date_used"] - r["date_received"]).days <= 15
        ]
        assert f["field_user_id_median_time_gap_15"] == (statistics.median(redeemed) if redeemed else 0)
        assert f["field_user_id_min_time_gap_15"] == (min(redeemed) if redeemed else 0)


@FEW
@given(rows=log_rows)
def test_grain_counts_equal_window_counts(spark, rows):
    log = fields.clean(make_log(spark, rows)).where(fields.received())
    wanted = {name: keys for size in (1, 2) for name, keys in counts.interaction_counts(size).items()}
    attached = counts._from_grain(log, wanted)
    direct = log.withColumns(
        {name: F.count(F.lit(1)).over(Window.partitionBy(*keys)) for name, keys in wanted.items()}
    )
    assert bag(attached) == bag(direct)


@FEW
@given(rows=log_rows)
def test_active_window_equals_its_coalesced_form(spark, rows):
    log = make_log(spark, rows)
    span = windows.Span.of("2016-04-05", "2016-05-02")
    merged = log.where(span.covers(F.coalesce("date_used", "date_received")))
    assert bag(windows.active_in(log, span)) == bag(merged)


scored = st.lists(
    st.tuples(st.integers(1, 3), st.integers(0, 1), st.integers(0, 5)), min_size=1, max_size=60
)


@FEW
@given(rows=scored)
def test_coupon_auc_counts_ordered_pairs(spark, rows):
    frame = spark.createDataFrame([(c, y, s / 5) for c, y, s in rows], "coupon0 bigint, label int, prob double")
    expected = {}
    for coupon in {r[0] for r in rows}:
        pos = [s for c, y, s in rows if c == coupon and y == 1]
        neg = [s for c, y, s in rows if c == coupon and y == 0]
        if pos and neg:
            good = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
            expected[coupon] = good / (len(pos) * len(neg))
    found = {r["coupon0"]: r["auc"] for r in evaluation.coupon_auc(frame).collect()}
    assert found == pytest.approx(expected)
    mean = evaluation.mean_coupon_auc(frame).first()
    assert mean["coupons"] == len(expected)
    if expected:
        assert mean["mean_auc"] == pytest.approx(statistics.mean(expected.values()))


def test_auc_with_ties(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.9), (1, 0, 0.1), (1, 1, 0.4), (2, 1, 0.3), (2, 1, 0.2)]
    frame = spark.createDataFrame(rows, "coupon0 bigint, label int, prob double")
    assert [(r["coupon0"], r["auc"]) for r in evaluation.coupon_auc(frame).collect()] == [(1, 0.625)]


def test_auc_of_one_large_group_over_many_pieces(spark):
    frame = spark.range(20_000).select(
        F.lit(7).cast("bigint").alias("coupon0"),
        (F.xxhash64("id") % 3 == 0).cast("int").alias("label"),
        (F.pmod(F.hash("id"), F.lit(5_000)) / 5_000).alias("prob"),
    )
    rows = frame.collect()
    below = Counter(r["prob"] for r in rows if r["label"] == 0)
    running, ordered = 0, 0.0
    for prob, group in itertools.groupby(sorted(rows, key=lambda r: r["prob"]), key=lambda r: r["prob"]):
        pos = sum(r["label"] for r in group)
        ordered += pos * (running + below[prob] / 2)
        running += below[prob]
    positives = sum(r["label"] for r in rows)
    (found,) = evaluation.coupon_auc(frame).collect()
    assert found["positives"] == positives and found["negatives"] == running
    assert found["auc"] == pytest.approx(ordered / (positives * running), rel=1e-12)


@pytest.mark.parametrize("size", [1, 7, 250])
def test_stratified_parts_are_exact(spark, size):
    rows = spark.range(size).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label")
    )
    split = windows.stratified_split(rows).collect()
    assert len(split) == size
    for label in (0, 1):
        mine = [r["split"] for r in split if r["label"] == label]
        assert mine.count("validate") == -(-len(mine) // 5)
    folds = windows.stratified_folds(rows, 3).collect()
    for label in (0, 1):
        mine = Counter(r["fold"] for r in folds if r["label"] == label)
        if mine:
            sizes = [mine.get(i, 0) for i in range(3)]
            assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("at", [0, 1, 40, 100, 1000])
def test_positional_split_takes_the_first_rows(spark, at):
    rows = spark.range(100).select(
        F.col("id").cast("string").alias("row_id"),
        F.when(F.col("id") % 10 != 0, F.date_add(F.lit("2016-01-01").cast("date"), (F.col("id") % 4).cast("int"))).alias(
            "date_received"
        ),
    )
    split = windows.positional_split(rows, at).collect()
    train = [r["date_received"] for r in split if r["split"] == "train"]
    test = [r["date_received"] for r in split if r["split"] == "test"]
    assert len(train) == min(at, 100) and len(train) + len(test) == 100
    if train and test:
        assert max(str(d or "") for d in train) <= min(str(d or "") for d in test)


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_knn_matches_brute_force(spark, block_rows):
    def points(start, n):
        return [(start + i, [float((start * 7 + i * 13) % 11), float((i * 5) % 7), float(i % 3)], i % 3) for i in range(n)]

    train, test = points(0, 40), points(100, 9)
    schema = "id bigint, vector array<double>, label int"
    found = neighbours.nearest(
        spark.createDataFrame(train, schema),
        spark.createDataFrame(test, schema).select("id", "vector"),
        k=5,
        block_rows=block_rows,
    )
    got = defaultdict(list)
    for r in found.orderBy("test_id", "place").collect():
        got[r["test_id"]].append(r["train_id"])
    for tid, vector, _ in test:
        ranked = sorted(train, key=lambda p: (sum((a - b) ** 2 for a, b in zip(p[1], vector)) ** 0.5, p[0]))
        assert got[tid] == [p[0] for p in ranked[:5]]
    votes = neighbours.knn_vote(
        spark.createDataFrame(train, schema),
        spark.createDataFrame(test, schema).select("id", "vector"),
        block_rows=block_rows,
    ).collect()
    by_id = {p[0]: p[2] for p in train}
    for r in votes:
        tally = Counter(by_id[t] for t in got[r["test_id"]])
        assert r["prediction"] == min(tally, key=lambda y: (-tally[y], y))


def test_knn_with_fewer_rows_than_neighbours(spark):
    schema = "id bigint, vector array<float>, label int"
    train = spark.createDataFrame([(1, [0.0], 1)], schema)
    test = spark.createDataFrame([(5, [2.0], 0)], schema).select("id", "vector")
    assert [(r["test_id"], r["prediction"], r["votes"]) for r in neighbours.knn_vote(train, test).collect()] == [(5, 1, 1)]
