"""Scratch folders."""

from __future__ import annotations

import pytest

from couponlab import session
from couponlab.operators import windows


def test_tables_written_inside_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    rows = spark.range(30).selectExpr("cast(id as string) row_id", "id % 3 label")
    kept = session.fresh_path(spark, "kept")
    with session.scratch(spark) as outer:
        with session.scratch(spark) as inner:
            assert inner.startswith(outer)
            windows.stratified_split(rows).write.parquet(kept)
        assert session.fresh_path(spark, "x").startswith(f"{outer}/x-")
    assert [str(p) for p in tmp_path.iterdir()] == [kept]
    assert spark.read.parquet(kept).count() == 30


def test_tables_go_when_work_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        spark.range(3).write.parquet(session.fresh_path(spark, "t"))
        1 / 0
    assert list(tmp_path.iterdir()) == []
