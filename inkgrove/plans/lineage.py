"""Where jobs keep intermediate tables, and how lineage is cut.

The folder comes from ``spark.checkpoint.dir``.  Only a local master may fall
back to a temporary folder; on a cluster an unset folder is an error, because a
machine-local path would be lost with its executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables of this application."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = configured or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="run-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/{app}/{label}-{uuid.uuid4().hex[:12]}"


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs that start in here go as soon as their job is done.

    Otherwise they stay until the driver happens to collect its garbage, and those of all
    tables that are stored on the way pile up.  For jobs whose result is stored: who ran the
    same frame again would compute it again.
    """
    before = spark.conf.get(_DROP)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` reliably, so later plans start from stored rows."""
    scratch_root(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        # A frame of its own, as how its shuffles end is settled when it is made.
        return df.select("*").checkpoint(eager=True)


def round_stored(df: DataFrame) -> DataFrame:
    """``df`` of one round of a loop, written as Parquet and read again.

    A checkpoint keeps what the optimizer knows of the rows (constraints); joined with itself
    in every round that doubles, and so does the time to plan the next.  Files start anew.
    """
    path = scratch_path(df.sparkSession, "round")
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
