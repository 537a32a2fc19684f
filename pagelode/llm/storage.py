"""What the operators share about batches, names, row order and written tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import discard, materialize, settle, shared_dir

__all__ = ["discard", "materialize", "settle", "shared_dir", "small_batches", "unused", "with_read_order"]


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes, so that what Python workers and the JVM hold of long texts stays small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of ``df`` has one already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_read_order(df: DataFrame, name: str = "order_no") -> DataFrame:
    """Add the place (from 0) of every row among all, as a table was written; without files, in some order of partitions.

    Files of a table are numbered in their names; the rows of the files before, one number a
    file, are broadcast (a file holds a task's rows, so they are few).
    """
    file, row, of, before = unused(df, "file", "row_in_file", "of_file", "before")
    try:
        read = df.select("*", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:  # not read from files
        at = F.monotonically_increasing_id()
        read = df.select("*", F.lpad(F.shiftrightunsigned(at, 33).cast("string"), 10, "0").alias(file), at.bitwiseAND(F.lit(2**33 - 1)).alias(row))
    sizes = read.groupBy(F.col(file).alias(of)).agg((F.max(row) + 1).alias(before))
    earlier = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    joined = read.join(F.broadcast(sizes), F.col(file) == F.col(of))
    return joined.withColumn(name, F.col(before) + F.col(row)).drop(file, row, of, before)
