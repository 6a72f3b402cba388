"""Session settings and the checkpoint folder."""

from __future__ import annotations

import re
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_FOLDER: ContextVar[str | None] = ContextVar("scratch folder", default=None)

#: Runtime settings the jobs are written for.  Shuffle partition counts are
#: left to the cluster; adaptive execution coalesces and splits them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(name: str = "couponlab", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or get) a session with the settings above.

    ``extra`` takes further settings with ``__`` for the dots, for example
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, from ``spark.checkpoint.dir``.

    On a cluster the setting must name shared storage.  A session on one
    machine without the setting uses a folder below its warehouse.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder on a cluster")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, below the checkpoint folder or, inside ``scratch``, below its folder."""
    return f"{_FOLDER.get() or checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table on shared storage, read back: what they come from is worked out once."""
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """A folder of its own for the tables written inside, removed with them at the end.

    Results that were not written, to a path from before, cannot be read afterwards.
    """
    folder = fresh_path(spark, "scratch")
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``fresh_path`` named, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
