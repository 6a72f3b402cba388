"""Models: shapes, ranges and persistence, no fixed scores."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from couponlab.functions import fields
from couponlab.operators import evaluation, models, windows
from couponlab.plans import datasets, scoring
from couponlab.session import checkpoint_dir
from conftest import bag


@pytest.fixture(scope="module")
def learnable(spark):
    """Rows whose label depends on two of three inputs."""
    rows = spark.range(2_000).select(
        F.col("id").cast("string").alias("row_id"),
        (F.col("id") % 40).alias("coupon0"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100).alias("a"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) / 100).alias("b"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(100)) / 100).alias("noise"),
    )
    return rows.withColumn("label", (F.col("a") + F.col("b") > 1.0).cast("int")).cache()


INPUTS = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def trees(learnable):
    return models.fit_gbt(learnable, INPUTS, rounds=5, depth=3, step=0.3)


def test_gbt_scores(learnable, trees):
    scored = models.score(trees, learnable, ["coupon0", "label"])
    low, high, n = scored.agg(F.min("prob"), F.max("prob"), F.count("*")).first()
    assert 0 <= low < high <= 1 and n == 2_000
    assert evaluation.mean_coupon_auc(scored).first()["mean_auc"] > 0.9


def test_importance(spark, trees, tmp_path):
    table = models.split_importance(trees, INPUTS, str(tmp_path / "trees"), spark).collect()
    names = [r["feature_name"] for r in table]
    assert set(names) <= set(INPUTS) and {"a", "b"} <= set(names)
    assert [r["importance"] for r in table] == sorted((r["importance"] for r in table), reverse=True)
    gains = models.gain_importance(trees, INPUTS, spark).collect()
    assert len(gains) == 3 and gains[0]["feature_name"] in ("a", "b")


def test_saved_model_is_reused(learnable, trees, tmp_path):
    path, fits = str(tmp_path / "model"), []

    def fit():
        fits.append(1)
        return trees

    first = models.load_or_fit(path, fit)
    second = models.load_or_fit(path, fit)
    assert fits == [1]
    keep = ["row_id"]
    assert bag(models.score(first, learnable, keep)) == bag(models.score(second, learnable, keep))


def test_grid_search(spark, learnable):
    search = models.fit_elastic_net(learnable, INPUTS, grid=(0.001, 0.1), folds=2, iterations=20)
    table = models.grid_results(search, spark).collect()
    assert len(table) == 4 and table[0]["mean_auc"] > 0.9
    assert evaluation.global_auc(search.transform(learnable)) > 0.9


@pytest.mark.parametrize(
    "fit",
    [
        lambda rows: models.fit_naive_bayes(rows, INPUTS),
        lambda rows: models.fit_naive_bayes(rows, INPUTS, kind="multinomial", smoothing=0.1),
        lambda rows: models.fit_linear_svc(rows, INPUTS, iterations=10),
    ],
)
def test_classifiers_return_the_labels_they_saw(learnable, fit):
    rows = learnable.withColumn("label", F.when(F.col("label") == 1, 1).otherwise(-1))
    predicted = models.predict_labels(fit(rows), rows, ["row_id", "label"])
    assert {r["prediction"] for r in predicted.select("prediction").distinct().collect()} <= {-1, 1}
    result = evaluation.mismatches(predicted).first()
    assert result["rows"] == 2_000 and result["mismatches"] < 1_000


def test_offline_evaluation(star_log):
    log = fields.clean(star_log)
    sets = {
        name: fields.with_label(datasets.basic_set(windows.received_in(log, windows.HISTORY_FIELDS[name])))
        for name in ("train", "validate")
    }
    result = scoring.evaluate_offline(sets["train"], sets["validate"], rounds=2, depth=2).first()
    assert 0 <= result["mean_auc"] <= 1 and result["coupons"] > 0


def test_checkpoint_folder_is_set_once(spark):
    folder = checkpoint_dir(spark)
    assert folder == checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_named_checkpoint_folder_is_used(tmp_path):
    """In a process of its own, since a session keeps its first folder."""
    code = (
        "from couponlab.session import build_session, checkpoint_dir;"
        f"s = build_session(master='local[1]', spark__checkpoint__dir='{tmp_path}', spark__ui__enabled='false');"
        f"assert str('{tmp_path}') in checkpoint_dir(s), checkpoint_dir(s)"
    )
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_first_booster_runs_all_rounds(monkeypatch, spark):
    import __spark_entry__ as entry

    asked = {}
    monkeypatch.setattr(scoring, "evaluate_offline", lambda train, validate, leave_out, **settings: asked.update(settings))
    entry.gbt_offline_auc(spark, "/root/testdata/sf0.001")
    assert asked == {"rounds": 5167, "subsample": 0.9, "min_instances": 4}


def test_trees_split_between_256_bins(trees):
    assert trees.stages[-1].getMaxBins() == 256
