from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from couponlab.session import build_session  # noqa: E402
from couponlab.sources.star_tables import coupon_log  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

LOG_SCHEMA = (
    "row_id string, user_id bigint, merchant_id bigint, coupon_id bigint, discount_raw string, distance int, "
    "date_received date, date_used date"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "couponlab-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str | None) -> dt.date | None:
    return dt.datetime.strptime(text, "%Y%m%d").date() if text else None


def make_log(spark, rows):
    """Rows of (user, merchant, coupon, discount, distance, received, used), dates as yyyymmdd."""
    filled = [(str(i + 1), u, m, c, r, d, day(a), day(b)) for i, (u, m, c, r, d, a, b) in enumerate(rows)]
    return spark.createDataFrame(filled, LOG_SCHEMA)


@pytest.fixture(scope="session")
def edge_log(spark):
    return make_log(
        spark,
        [
            (1, 10, 100, "100:10", 0, "20160402", "20160417"),
            (1, 10, 100, "100:10", 0, "20160402", None),
            (1, 10, 100, "100:10", None, "20160420", "20160506"),
            (1, 11, None, None, 3, None, "20160405"),
            (2, 11, 101, "0.9", 10, "20160430", "20160429"),
            (2, 11, 101, "0.9", 10, "20160514", None),
            (3, 12, 102, "30:5", 1, "20160206", None),
            (3, 12, 102, "30:5", 1, "20160404", "20160404"),
            (4, 12, None, None, None, None, None),
            (5, 13, 103, "0.95", 2, "20160413", None),
            (5, 13, 103, "0.95", 2, "20160413", None),
        ],
    )


@pytest.fixture(scope="session")
def star_log(spark):
    return coupon_log(spark, FOLDER)


def bag(frame, digits: int = 9):
    """Rows as a sorted list, doubles rounded, columns by name."""
    names = sorted(frame.columns)

    def plain(value):
        return round(value, digits) if isinstance(value, float) else value

    return sorted((tuple(plain(row[n]) for n in names) for row in frame.collect()), key=repr)
