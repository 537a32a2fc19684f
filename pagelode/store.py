"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``; the session's
own setting is used and a default exists only for local masters (tests).
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_DEFAULT = "file:///tmp/checkpoints"
_written: dict[str, SparkSession] = {}
#: Tables of more rows are joined by shuffles.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; local masters may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL_DEFAULT


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/pagelode-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    return path


def release_memory() -> None:
    """Give freed memory back, so that a worker that later tasks use again stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def by_shuffle(df: DataFrame) -> DataFrame:
    """The table, never broadcast by Spark's own choice.

    Spark judges a table by its files, which are compressed, and by its rows before they are
    exploded; what it takes for a few MB may be hundreds, and a broadcast goes through the driver.
    """
    return df.hint("merge")


def join_rule(*tables: DataFrame, each: int = 1) -> Callable[[DataFrame], DataFrame]:
    """:func:`by_shuffle` if one of the tables (written ones, or ones that are cheap to count) has many rows, else what leaves a table as it is; a row counts as ``each``."""
    most = BROADCAST_ROWS // each
    many = any(t.limit(most + 1).count() > most for t in tables)
    return by_shuffle if many else lambda df: df


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Add ``name``: 1, 2, ... over all rows in an order. A range sort numbers each partition; the partitions' counts, one row each, give the rest."""
    at, part, before = "row at", "row part", "rows before"
    rows = materialize(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    of = F.shiftrightunsigned(F.col(at), 33)
    counts = rows.groupBy(of.alias(part)).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = F.col(at).bitwiseAND(F.lit(2**33 - 1))
    return rows.join(counts, of == F.col(part)).withColumn(name, F.col(before) + inside + 1).drop(at, part, before)


def settle(spark: SparkSession) -> None:
    """Let go of finished shuffles: their files are deleted once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "written_path", None)
        if path in _written:
            _delete(_written.pop(path), path)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete on leaving what was written inside; for work whose results stand elsewhere by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return
