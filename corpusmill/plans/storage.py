"""Where intermediate and prepared tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Only a local session that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Whether an execution removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files, which else stay until the driver's garbage is collected: disks hold one step's, not all steps'."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again: computed once, and not lost with an executor."""
    return _written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    with without_leftovers(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As :func:`stash`, for as long as the block lasts: what is read from it has to be stashed inside."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    try:
        yield _written(df, path)
    finally:
        hadoop.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop.Path(path), True)


def modified(spark: SparkSession, path: str) -> int:
    """When the newest file at or below ``path`` was written."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return max([fs.getFileStatus(place).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(place))])
