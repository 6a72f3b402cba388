"""Nearest-neighbour vote: exact, over cells around pivots.

Pivots are a bounded sample of the training rows.  Each training row belongs to the cell
of its nearest pivot; of a cell the number of rows and the least and greatest distance
from the pivot are known.  A test row first visits the nearest cells that together hold
``k`` rows, which bounds its k-th distance from above.  By the triangle inequality it
then needs to visit only cells that can hold something as near; all others are passed
over.  The result is exact, however many cells that leaves: vectors that cluster leave
few, vectors without any structure nearly all.

A visit is a row of test vector and cell.  Cells are cut into blocks and the visits of a
cell into chunks, so that a task holds a bounded number of rows of each side; a training
row is sent once to each chunk that visits its cell.  No pair of rows leaves a task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponlab.session import fresh_path

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows per block of a cell, and visits per chunk.
BLOCK_ROWS = 20_000
#: Test rows compared at a time inside a task, to bound the distance matrix.
CHUNK_ROWS = 256
#: Most pivots; the driver holds them, and a row is compared with each.
PIVOTS = 2048
#: Distances are rounded; what is this much farther still counts as near.
_SLACK = 1e-9


def _nearest(k: int):
    def meet(test: pd.DataFrame, train: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        empty = pd.DataFrame({"test_id": [], "train_id": [], "label": [], "distance": []})
        if test.empty or train.empty:
            return empty
        # By id, so that the nearest of equally near rows is the lowest id.
        train = train.sort_values("id", kind="stable")
        ids, labels = train["id"].to_numpy(), train["label"].to_numpy()
        points = np.stack(train["vector"].to_numpy()).astype("float64")
        keep = min(k, len(ids))
        found = []
        for start in range(0, len(test), CHUNK_ROWS):
            part = test.iloc[start : start + CHUNK_ROWS]
            queries = np.stack(part["vector"].to_numpy()).astype("float64")
            squares = np.zeros((len(part), len(ids)))
            for axis in range(points.shape[1]):
                squares += (queries[:, axis, None] - points[None, :, axis]) ** 2
            order = np.argsort(squares, axis=1, kind="stable")[:, :keep]
            found.append(
                pd.DataFrame(
                    {
                        "test_id": np.repeat(part["id"].to_numpy(), keep),
                        "train_id": ids[order].ravel(),
                        "label": labels[order].ravel(),
                        "distance": np.sqrt(np.take_along_axis(squares, order, axis=1)).ravel(),
                    }
                )
            )
        return pd.concat(found, ignore_index=True)

    return meet


def _stored(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _pivots(train: DataFrame, count: int) -> np.ndarray:
    """Vectors of the rows whose ids have the lowest hashes, without repeats."""
    rows = train.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(count).collect()
    return np.unique(np.array([r["vector"] for r in rows], np.float64), axis=0)


def _distances(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    points = np.stack(vectors.to_numpy()).astype("float64")
    squares = np.zeros((len(points), len(pivots)))
    for axis in range(points.shape[1]):
        squares += (points[:, axis, None] - pivots[None, :, axis]) ** 2
    return np.sqrt(squares)


def _parts(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for start in range(0, len(part), CHUNK_ROWS):
        yield part.iloc[start : start + CHUNK_ROWS]


def _in_cells(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Training rows with ``cell`` and ``radius``, their distance from its pivot."""

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for part in _parts(whole):
                away = _distances(part["vector"], pivots)
                yield part.assign(cell=away.argmin(1), radius=away.min(1))

    rows = train.select("id", "vector", "label")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "cell int", "radius double"])
    return rows.mapInPandas(assign, schema)


def _visits(test: DataFrame, pivots: np.ndarray, cells: pd.DataFrame, k: int, bounded: bool) -> DataFrame:
    """A row for each test row and cell to visit: the first cells, or (``bounded``) those left that may hold something near.

    ``cells`` has ``n``, ``low`` and ``high`` for each pivot; ``limit`` of a bounded test row is its k-th distance so far.
    """
    n, low, high = (cells[c].to_numpy() for c in ("n", "low", "high"))

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for part in _parts(whole):
                away = _distances(part["vector"], pivots)
                order = np.argsort(away, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                # The nearest cells up to the one that makes k rows; they have been visited when the limit is known.
                first = np.zeros(away.shape, bool)
                np.put_along_axis(first, order, held - n[order] < k, axis=1)
                chosen = first & (n > 0)
                if bounded:
                    least = np.maximum(np.maximum(away - high, low - away), 0.0)
                    limit = part["limit"].fillna(np.inf).to_numpy()[:, None]
                    chosen = ~first & (n > 0) & (least <= limit + _SLACK * (1 + limit + away))
                row, cell = np.nonzero(chosen)
                yield pd.DataFrame({"id": part["id"].to_numpy()[row], "vector": part["vector"].to_numpy()[row], "cell": cell})

    fields = {f.name: f.dataType.simpleString() for f in test.schema}
    return test.mapInPandas(visit, f"id {fields['id']}, vector {fields['vector']}, cell int")


def _met(visits: DataFrame, train: DataFrame, cells: pd.DataFrame, k: int, block_rows: int) -> DataFrame:
    """The ``k`` nearest rows of each block that a test row visits."""
    spark = visits.sparkSession
    asked = dict(visits.groupBy("cell").count().toPandas().itertuples(index=False, name=None))
    # One row for each pivot.
    rows = [(int(c), -(-int(n) // block_rows), -(-int(asked.get(c, 0)) // block_rows)) for c, n in enumerate(cells["n"])]
    sizes = F.broadcast(spark.createDataFrame([r for r in rows if r[1] and r[2]], "cell int, blocks int, chunks int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    left = visits.join(sizes, "cell").select("id", "vector", "cell", own("chunks").alias("chunk"), every("blocks").alias("block"))
    right = train.join(sizes, "cell").select("id", "vector", "label", "cell", own("blocks").alias("block"), every("chunks").alias("chunk"))
    keys = ["cell", "block", "chunk"]
    schema = "test_id bigint, train_id bigint, label int, distance double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_nearest(k), schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("test_id").orderBy("distance", "train_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def nearest(
    train: DataFrame, test: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, pivots: int | None = None
) -> DataFrame:
    """The ``k`` nearest training rows of each test row by Euclidean distance.

    ``train`` has ``id`` bigint, ``vector`` array and ``label`` int; ``test``
    has ``id`` and ``vector``.  Equal distances are settled by the lower id.
    Rows without a vector take no part.
    """
    train, test = (rows.where(F.col("vector").isNotNull()) for rows in (train, test))
    count = pivots or min(PIVOTS, max(1, int(train.count() ** 0.5)))
    chosen = _pivots(train, count)
    if not len(chosen):
        return train.sparkSession.createDataFrame([], "test_id bigint, train_id bigint, label int, distance double, place int")
    placed = _stored(_in_cells(train, chosen), "cells")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    cells = stats.toPandas().set_index("cell").reindex(range(len(chosen)))
    cells["n"] = cells["n"].fillna(0).astype("int64")
    asked = test.select("id", "vector")
    first = _stored(_visits(asked, chosen, cells, k, bounded=False), "first-visits")
    near = _stored(_best(_met(first, placed, cells, k, block_rows), k), "near")
    limits = near.groupBy("test_id").agg(F.max(F.when(F.col("place") == k, F.col("distance"))).alias("limit"))
    limited = asked.join(limits.withColumnRenamed("test_id", "id"), "id", "left")
    rest = _stored(_visits(limited, chosen, cells, k, bounded=True), "visits")
    return _best(near.drop("place").unionByName(_met(rest, placed, cells, k, block_rows)), k)


def knn_vote(train: DataFrame, test: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Majority label of the ``k`` nearest rows; the lower label on a draw."""
    votes = nearest(train, test, k, block_rows).groupBy("test_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = F.max(F.struct("votes", (-F.col("label")).alias("minus_label")))
    chosen = votes.groupBy("test_id").agg(best.alias("best"))
    return chosen.select("test_id", (-F.col("best.minus_label")).alias("prediction"), F.col("best.votes").alias("votes"))
