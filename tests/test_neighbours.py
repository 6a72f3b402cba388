"""Exact nearest neighbours over pivot cells."""

from __future__ import annotations

import numpy as np
import pytest

from couponlab.operators import neighbours


def by_hand(train, test, k):
    out = set()
    for i, v in test:
        ranked = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w, _ in train)[:k]
        out |= {(i, j, place + 1) for place, (_, j) in enumerate(ranked)}
    return out


def frames(spark, train, test):
    return (
        spark.createDataFrame(train, "id bigint, vector array<double>, label int"),
        spark.createDataFrame(test, "id bigint, vector array<double>"),
    )


def found_rows(frame):
    return {(r["test_id"], r["train_id"], r["place"]) for r in frame.collect()}


def clustered(n: int, centres: int, draw) -> list[list[float]]:
    middle = draw.normal(size=(centres, 6)) * 50
    return (middle[draw.integers(0, centres, n)] + draw.normal(size=(n, 6)).round(3)).round(3).tolist()


@pytest.mark.parametrize(("k", "pivots", "block_rows"), [(5, None, 20_000), (3, 7, 10), (60, 20, 15), (1, 1, 1000)])
def test_nearest_is_exact(spark, k, pivots, block_rows):
    draw = np.random.default_rng(k)
    points = clustered(250, 9, draw) + draw.integers(0, 3, (60, 6)).astype(float).tolist()
    train = [(i, v, i % 3) for i, v in enumerate(points)]
    test = [(1000 + i, v) for i, v in enumerate(clustered(30, 9, draw) + points[:10] + points[250:260])]
    assert found_rows(neighbours.nearest(*frames(spark, train, test), k, block_rows, pivots)) == by_hand(train, test, k)


def test_fewer_rows_than_asked_for_and_none(spark):
    train, test = [(1, [0.0, 0.0], 1), (2, [0.0, 0.0], 0), (3, None, 1)], [(7, [1.0, 1.0]), (8, None)]
    rows = frames(spark, train, test)
    assert found_rows(neighbours.nearest(*rows, 5)) == {(7, 1, 1), (7, 2, 2)}
    assert neighbours.nearest(rows[0].limit(0), rows[1]).collect() == []
    assert neighbours.nearest(rows[0], rows[1].limit(0)).collect() == []


def test_clustered_rows_visit_few_cells(spark, monkeypatch):
    draw = np.random.default_rng(1)
    points = clustered(3200, 40, draw)
    train, test = [(i, v, 0) for i, v in enumerate(points[:3000])], [(5000 + i, v) for i, v in enumerate(points[3000:])]
    stored, visited = neighbours._stored, {}

    def counting(rows, name):
        made = stored(rows, name)
        visited[name] = made.count()
        return made

    monkeypatch.setattr(neighbours, "_stored", counting)
    found = found_rows(neighbours.nearest(*frames(spark, train, test), 5))
    assert found == by_hand(train, test, 5)
    pairs = 200 * int(3000**0.5)
    assert visited["first-visits"] + visited["visits"] < 0.15 * pairs


def test_a_hot_cell_is_cut_into_blocks(spark):
    points = [[0.0, 0.0]] * 400 + [[float(i), 1.0] for i in range(100)]
    train, test = [(i, v, 0) for i, v in enumerate(points)], [(900 + i, [0.0, 0.1 * i]) for i in range(40)]
    assert found_rows(neighbours.nearest(*frames(spark, train, test), 3, block_rows=25)) == by_hand(train, test, 3)
    rows = frames(spark, train, test)
    pivots = neighbours._pivots(rows[0], 5)
    placed = neighbours._in_cells(rows[0], pivots)
    assert placed.groupBy("cell").count().agg({"count": "max"}).head()[0] >= 400
