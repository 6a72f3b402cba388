"""The grid of elastic nets against separate fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from couponlab.operators import evaluation, penalised, windows

INPUTS = ["a", "b", "far", "noise", "same"]


def _noise(seed: int):
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(1_500).select(
        F.concat(F.lit("r"), F.col("id")).alias("row_id"),
        _noise(1).alias("a"),
        (_noise(1) * 0.9 + _noise(2)).alias("b"),
        (_noise(3) * 50 + 10_000).alias("far"),
        _noise(4).alias("noise"),
        F.lit(7).alias("same"),
        _noise(5).alias("u"),
    )
    odds = 4 * F.col("a") - 3 * F.col("b") + 0.04 * (F.col("far") - 10_000)
    return made.withColumn("label", (1 / (1 + F.exp(-odds)) > F.col("u")).cast("int")).drop("u").cache()


@pytest.fixture(scope="module")
def grid(rows):
    return penalised.fit_grid(rows, INPUTS, grid=(0.001, 0.1), folds=2)


def _objective(x, y, weights, reg, share):
    """Mean log loss plus penalty, from weights of unscaled inputs."""
    scaled = weights[1:] * x.std(axis=0, ddof=1)
    margins = weights[0] + x @ weights[1:]
    loss = np.mean(np.logaddexp(0, margins) - y * margins)
    return loss + reg * (share * np.abs(scaled).sum() + (1 - share) / 2 * (scaled**2).sum())


def test_equals_separate_fits(rows, grid):
    """Coefficients agree with MLlib's to 1e-3 of a scaled input, and the objective is nowhere greater."""
    folded = windows.stratified_folds(rows, 2).cache()
    for s in range(3):
        mine = folded.where(F.col("fold") != s)
        table = mine.select(*INPUTS, "label").toPandas()
        x, y = table[INPUTS].to_numpy(float), table["label"].to_numpy(float)
        for g, (reg, share) in enumerate(grid.points):
            stages = [
                VectorAssembler(inputCols=INPUTS, outputCol="raw"),
                StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                LogisticRegression(regParam=reg, elasticNetParam=share, maxIter=300, tol=1e-10),
            ]
            fitted = Pipeline(stages=stages).fit(mine).stages[-1]
            spread = x.std(axis=0, ddof=1)
            scaled = grid.weights[s, g, 1:] * spread
            assert np.abs(scaled - fitted.coefficients.toArray()).max() < 1e-3
            theirs = np.where(spread > 0, fitted.coefficients.toArray() / np.where(spread > 0, spread, 1), 0)
            theirs = np.r_[fitted.intercept - theirs @ x.mean(axis=0), theirs]
            assert _objective(x, y, grid.weights[s, g], reg, share) <= _objective(x, y, theirs, reg, share) + 1e-9


def test_constant_input_gets_nothing(grid):
    assert np.all(grid.weights[:, :, 1 + INPUTS.index("same")] == 0)


def test_aucs_are_those_of_the_folds_left_out(rows, grid):
    table = windows.stratified_folds(rows, 2).toPandas()
    for g in range(len(grid.points)):
        aucs = []
        for s in range(2):
            out = table[table["fold"] == s]
            margins = grid.weights[s, g, 0] + out[INPUTS].to_numpy(float) @ grid.weights[s, g, 1:]
            ones, zeros = margins[out["label"] == 1], margins[out["label"] == 0]
            above = (ones[:, None] > zeros[None, :]).mean() + (np.isclose(ones[:, None], zeros[None, :], atol=1e-12)).mean() / 2
            aucs.append(above)
        assert grid.aucs[g] == pytest.approx(np.mean(aucs), abs=1e-5)


def test_passes_are_those_of_one_fit(rows, grid):
    """Twelve fits take no more passes than the slowest of them takes alone."""
    alone = [penalised.fit_grid(rows, INPUTS, grid=(reg,), folds=2).passes for reg in (0.001, 0.1)]
    assert grid.passes <= max(alone) + 2 <= 15


def test_partitioning_does_not_matter(rows, grid):
    again = penalised.fit_grid(rows.repartition(7, "noise"), INPUTS, grid=(0.001, 0.1), folds=2)
    assert np.allclose(again.weights, grid.weights, rtol=1e-6, atol=1e-9)


def test_scores(spark, rows, grid):
    scored = grid.score(rows, ["row_id", "label"])
    low, high, n = scored.agg(F.min("prob"), F.max("prob"), F.count("*")).first()
    assert 0 < low < high < 1 and n == 1_500
    table = grid.table(spark).collect()
    assert [r["mean_auc"] for r in table] == sorted(grid.aucs, reverse=True)
    one = scored.withColumn("coupon0", F.lit(1))
    assert evaluation.mean_coupon_auc(one).first()["mean_auc"] > 0.6


@pytest.mark.parametrize("change", ["null", "nan", "label", "empty"])
def test_refused_rows(rows, change):
    wrong = {
        "null": lambda: rows.withColumn("a", F.when(F.col("row_id") != "r5", F.col("a"))),
        "nan": lambda: rows.withColumn("a", F.when(F.col("row_id") == "r5", float("nan")).otherwise(F.col("a"))),
        "label": lambda: rows.withColumn("label", F.when(F.col("row_id") == "r5", 2).otherwise(F.col("label"))),
        "empty": lambda: rows.where("row_id = 'none'"),
    }[change]()
    with pytest.raises(ValueError):
        penalised.fit_grid(wrong, INPUTS, grid=(0.1,), folds=2)
