"""Elastic-net logistic regression over a grid of penalties and folds, all fits in the same passes.

Each pass reads the rows once.  For every fit that has not ended a task adds up the loss, the
gradient and the weighted Gram matrix of its rows; Spark sums them by fit, and what reaches the
driver is a matrix of inputs by inputs a fit, however many rows there are.  There the Newton model
of each fit is minimised with its penalty by coordinate descent.  A step that does not lower the
objective is halved and tried again in the next pass.  So the passes are those of the slowest fit,
not the sum over all fits.

The objective is the mean log loss plus ``reg * (share * |b| + (1 - share) / 2 * b^2)`` over inputs
shifted and scaled to mean 0 and sample deviation 1 in the rows fitted to; the intercept is free.
Besides one fit a fold and point there is one a point on all rows, so the best point needs no
further fit.

Rows: labels are 0 or 1; a null label or input, or one that is not finite, is refused; an input that
does not vary gets coefficient 0; an empty table is refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from couponlab.operators.evaluation import coupon_auc
from couponlab.operators.models import LINEAR_PREDICTORS, cut_lineage
from couponlab.operators.windows import stratified_folds

#: A fit has ended when a step would change no coefficient of a scaled input by more.
TOLERANCE = 1e-8
#: Halvings of one step before it is given up.
HALVINGS = 30


@dataclass(frozen=True)
class Grid:
    """Fits of a grid: ``weights[set, point]`` holds the intercept and the coefficients of unscaled inputs.

    Sets 0 up to the number of folds leave out that fold; the last one has all rows.
    """

    features: tuple[str, ...]
    points: tuple[tuple[float, float], ...]
    weights: np.ndarray
    aucs: tuple[float, ...]
    passes: int

    @property
    def best(self) -> int:
        """The point of the greatest mean AUC, the first of equals."""
        return int(np.argmax(self.aucs))

    def table(self, spark: SparkSession) -> DataFrame:
        """Mean held-out AUC of each point, greatest first."""
        rows = [(reg, share, auc) for (reg, share), auc in zip(self.points, self.aucs)]
        named = spark.createDataFrame(rows, "reg_param double, elastic_net_param double, mean_auc double")
        return named.orderBy(F.desc("mean_auc"), "reg_param", "elastic_net_param")

    def margin(self, point: int | None = None) -> Column:
        """Log odds of label 1 by the fit of all rows."""
        return _margin(self.features, [F.lit(float(w)) for w in self.weights[-1, self.best if point is None else point]])

    def score(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns and ``prob``, the probability of label 1 at the best point."""
        return rows.select(*keep, (1 / (1 + F.exp(-self.margin()))).alias("prob"))


def _margin(features: Sequence[str], weights: Sequence[Column]) -> Column:
    return reduce(add, [w * F.col(f).cast("double") for f, w in zip(features, weights[1:])], weights[0])


def _moments(rows: DataFrame, features: Sequence[str], label: str, folds: int) -> list[tuple[int, float, np.ndarray, np.ndarray]]:
    """Rows, share of label 1, means and sample deviations of each set."""
    values = [F.col(f).cast("double") for f in features]
    bad = [F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)) for v in values]
    refused = reduce(lambda a, b: a | b, bad, ~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))
    columns = [F.avg(v) for v in values] + [F.var_pop(v) for v in values]
    found = rows.groupBy("fold").agg(F.count(F.lit(1)), F.count_if(refused), F.avg(F.col(label).cast("double")), *columns).collect()
    if not found:
        raise ValueError("no rows to fit to")
    if any(r[2] for r in found):
        raise ValueError("labels must be 0 or 1, and inputs finite numbers")
    p = len(features)
    out = []
    for left_out in range(folds + 1):
        parts = [r for r in found if r[0] != left_out]
        if not parts:
            raise ValueError("every fold must leave rows to fit to")
        n = np.array([r[1] for r in parts], np.float64)
        means, spreads = (np.array([r[i : i + p] for r in parts], np.float64) for i in (4, 4 + p))
        mean = n @ means / n.sum()
        spread = n @ (spreads + (means - mean) ** 2)
        ones = float(n @ np.array([r[3] for r in parts]) / n.sum())
        out.append((int(n.sum()), ones, mean, np.sqrt(spread / max(n.sum() - 1, 1))))
    return out


def _sums(features: Sequence[str], label: str, shift: np.ndarray, scale: np.ndarray, asked: np.ndarray, weights: np.ndarray):
    """For each fit asked for: loss, gradient and upper half of the Gram matrix of a task's rows, one row a number.

    ``asked`` holds the fold that each fit leaves out, ``weights`` its coefficients of shifted and scaled inputs.
    """
    p = len(features) + 1
    upper = np.triu_indices(p)

    def run(batches):
        loss, slope = np.zeros(len(asked)), np.zeros((len(asked), p))
        gram = np.zeros((len(asked), len(upper[0])))
        some = False
        for batch in batches:
            if not batch.num_rows:
                continue
            some = True
            column = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
            x = np.column_stack([np.ones(batch.num_rows), *[column[f] for f in features]])
            x[:, 1:] = (x[:, 1:] - shift) / scale
            y = column[label]
            margins = x @ weights.T
            share = 0.5 * (1 + np.tanh(margins / 2))
            for k, fold in enumerate(asked):
                mine = (column["fold"] != fold).astype(np.float64)
                loss[k] += mine @ (np.logaddexp(0, margins[:, k]) - y * margins[:, k])
                slope[k] += (mine * (share[:, k] - y)) @ x
                gram[k] += ((x.T * (mine * share[:, k] * (1 - share[:, k]))) @ x)[upper]
        if some:
            numbers = np.column_stack([loss, slope, gram])
            fit, place = np.divmod(np.arange(numbers.size), numbers.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(fit), pa.array(place), pa.array(numbers.ravel())], names=["fit", "place", "value"])

    return run


def descend(slope: np.ndarray, gram: np.ndarray, at: np.ndarray, reg: float, share: float, free: np.ndarray, sweeps: int = 10_000):
    """The coefficients that minimise the quadratic model around ``at`` plus the penalty; only ``free`` ones move."""
    now, pull = at.copy(), slope.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in free:
            bend = gram[j, j]
            if j == 0:
                new = now[0] - pull[0] / bend if bend > 0 else now[0]
            else:
                lean = bend * now[j] - pull[j]
                new = np.sign(lean) * max(abs(lean) - reg * share, 0.0) / (bend + reg * (1 - share)) if bend > 0 else 0.0
            if new != now[j]:
                moved = max(moved, abs(new - now[j]))
                pull += gram[:, j] * (new - now[j])
                now[j] = new
        if moved <= TOLERANCE / 100:
            break
    return now


def _penalty(weights: np.ndarray, reg: float, share: float) -> float:
    return reg * (share * np.abs(weights[1:]).sum() + (1 - share) / 2 * (weights[1:] ** 2).sum())


def fit_grid(
    train: DataFrame,
    features: Sequence[str] = tuple(LINEAR_PREDICTORS),
    label: str = "label",
    *,
    grid: Sequence[float] = (0.001, 0.01, 0.1),
    folds: int = 3,
    row_id: str = "row_id",
    passes: int = 100,
) -> Grid:
    """Fit every point of the grid on every fold's rest and on all rows, and measure held-out AUC.

    ``grid`` is used for the penalty and for its L1 share.  Folds hold equal parts of each label.
    """
    features, points = tuple(features), tuple((reg, share) for reg in grid for share in grid)
    folded = stratified_folds(train.select(row_id, label, *features), folds, label, row_id)
    narrow = cut_lineage(folded.select("fold", F.col(label).cast("double").alias(label), *[F.col(f).cast("double").alias(f) for f in features]))
    sets = _moments(narrow, features, label, folds)
    p = len(features) + 1
    # All rows are shifted and scaled alike while sums are taken; each set's own scaling is a small turn from there.
    _, _, shift, spread = sets[-1]
    scale = np.where(spread > 0, spread, 1.0)
    turns, frees = [], []
    for _, _, mean, own in sets:
        turn = np.eye(p)
        vary = own > 0
        unit = np.where(vary, own, 1.0)
        turn[1:, 0] = np.where(vary, (shift - mean) / unit, 0.0)
        turn[1:, 1:] = np.diag(np.where(vary, scale / unit, 0.0))
        turns.append(turn)
        frees.append(np.r_[0, np.flatnonzero(vary) + 1])

    fits = [(s, reg, share) for s in range(len(sets)) for reg, share in points]
    before = np.zeros((len(fits), p))
    for i, (s, _, _) in enumerate(fits):
        ones = np.clip(sets[s][1], 1e-9, 1 - 1e-9)
        before[i, 0] = np.log(ones / (1 - ones))
    tried, best, halved = before.copy(), np.full(len(fits), np.inf), np.zeros(len(fits), int)
    active, done = list(range(len(fits))), 0
    upper = np.triu_indices(p)
    while active and done < passes:
        done += 1
        weights = np.array([tried[i] @ turns[fits[i][0]] for i in active])
        asked = np.array([fits[i][0] for i in active])
        run = _sums(features, label, shift, scale, asked, weights)
        rows = narrow.mapInArrow(run, "fit bigint, place bigint, value double").groupBy("fit", "place").agg(F.sum("value").alias("value"))
        numbers = np.zeros((len(active), 1 + p + len(upper[0])))
        for fit, place, value in rows.collect():
            numbers[fit, place] = value
        left = []
        for i, found in zip(active, numbers):
            s, reg, share = fits[i]
            n, turn = sets[s][0], turns[s]
            aim = found[0] / n + _penalty(tried[i], reg, share)
            if aim > best[i] + 1e-13 * abs(best[i]):
                halved[i] += 1
                tried[i] = (before[i] + tried[i]) / 2
                if halved[i] < HALVINGS and np.abs(tried[i] - before[i]).max() > TOLERANCE:
                    left.append(i)
                else:
                    tried[i] = before[i]
                continue
            half = np.zeros((p, p))
            half[upper] = found[1 + p :]
            gram = turn @ (half + np.triu(half, 1).T) @ turn.T / n
            best[i], before[i], halved[i] = aim, tried[i], 0
            tried[i] = descend(turn @ found[1 : 1 + p] / n, gram, before[i], reg, share, frees[s])
            if np.abs(tried[i] - before[i]).max() > TOLERANCE:
                left.append(i)
        active = left

    weights = np.zeros((len(sets), len(points), p))
    for i, (s, _, _) in enumerate(fits):
        own = tried[i] @ turns[s]
        own[1:] /= scale
        own[0] -= own[1:] @ shift
        weights[s, i % len(points)] = own
    return Grid(features, points, weights, _held_out(narrow, features, label, points, weights), done)


def _held_out(rows: DataFrame, features, label: str, points, weights: np.ndarray) -> tuple[float, ...]:
    """Mean over the folds of the AUC of each point on the fold left out, ties counted half."""
    folds = len(weights) - 1

    def margin(point: int) -> Column:
        by_fold = [F.array(*[F.lit(float(weights[s, point, j])) for s in range(folds)]) for j in range(weights.shape[2])]
        return _margin(features, [F.get(values, F.col("fold")) for values in by_fold])

    scored = rows.select(label, "fold", F.posexplode(F.array(*[margin(g) for g in range(len(points))])).alias("point", "prob"))
    named = scored.select((F.col("point") * folds + F.col("fold")).alias("fit"), label, "prob")
    # Range partitioning samples its input; written scores are not computed twice.
    found = {r["fit"]: r["auc"] for r in coupon_auc(cut_lineage(named), "fit", label).collect()}
    return tuple(float(np.mean([found.get(g * folds + s, np.nan) for s in range(folds)])) for g in range(len(points)))
