"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names; a temporary one only in local mode without setting."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get(CHECKPOINT_SETTING, None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="arcwindow-")
        sc.setCheckpointDir(folder)
    return folder


#: How tables of texts and token arrays are compressed: smaller than by default.
DENSE = "zstd"


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Unlike a checkpoint this computes the rows once, and what follows reads only the
    columns it needs. The tables stay until the folder is cleared after the job. What was
    shuffled for a table is removed when the table is written: nothing else reads it.
    """
    return _written(df, scratch_path(df.sparkSession, "table"), compression)


def _written(df: DataFrame, path: str, compression: str | None) -> DataFrame:
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a write is removed when it is written."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


@contextlib.contextmanager
def passing_table(df: DataFrame, compression: str | None = DENSE) -> Iterator[DataFrame]:
    """A table as of :func:`cut_lineage` that is removed at the end of the block: nothing may read it later."""
    spark = df.sparkSession
    path = scratch_path(spark, "passing")
    try:
        yield _written(df, path, compression)
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
