"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a null id: less than any other.
NO_ID = -(2**63)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none, as in a test, a temporary folder is set for the
    session; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it as read back.

    Cuts the lineage, computes ``df`` once and survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_bounds(df: DataFrame, column: str, pieces: int) -> list:
    """At most ``pieces - 1`` ascending values that cut ``column`` into ranges of like counts.

    One aggregation job; what comes to the driver is bounded by ``pieces``.
    """
    if pieces < 2:
        return []
    shares = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(column, shares, 100 * pieces)).first()[0]
    return sorted(set(found or []))


def range_bucket(column: Column, bounds: list, kind: str) -> Column:
    """The number of ``bounds`` that are at most ``column`` (null: 0), by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.lit(bounds).cast(f"array<{kind}>")
    found = F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) <= column, at + step).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until it is no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "~"
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def values(column: pa.Array, step: int = 256) -> Iterator:
    """The values of a column as Python objects, a few at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def give_back() -> None:
    """Give memory that this worker holds, but does not use, back to the system: Arrow's pool, and what the C library keeps of numpy's arrays."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def frugal(run: Batches) -> Batches:
    """As :func:`lean`, and the rest of the memory too."""

    @wraps(run)
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return both


def frugal_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of a group."""

    def both(rows: pa.Table) -> pa.Table:
        out = run(rows)
        give_back()
        return out

    return both


def frugal_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return both


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Batches) -> Batches:
    """``run``, and once its task is done, Arrow's pool gives back what it keeps: workers wait for other stages, where it would count."""

    @wraps(run)
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return both
