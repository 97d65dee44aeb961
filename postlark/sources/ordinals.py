"""The order of the input as numbers: file, place in the file, and how many rows the files before have.

Spark reads the files of a table in an order of its own, and parts of a file in several tasks. Numbers come from
where a row is stored, so they are the same on any number of partitions and need no sort of the rows: one
grouping counts the rows of each file (or part of a text file), a running sum over these few rows gives their
first numbers, and each row adds its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _with_offsets(placed: DataFrame, counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row a file or part is sorted in one task and sent to all; rows stay where they are read, or those of one file would meet in one task."""
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return placed.join(F.broadcast(offsets), keys).withColumn(name, F.col("_offset") + F.col("_at")).drop(*keys, "_at", "_offset", "_first")


def parquet_in_order(spark: SparkSession, *paths: str, name: str = "ordinal") -> DataFrame:
    """The rows of Parquet files with their number from 0, files by path; an existing column of that name gives way."""
    read = spark.read.parquet(*paths)
    columns = [c for c in read.columns if c != name]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    counts = read.select(*place).groupBy("_file").agg((F.max("_at") + 1).alias("_rows"))
    return _with_offsets(read.select(*columns, *place), counts, ["_file"], name).select(*columns, name)


def lines_in_order(spark: SparkSession, *paths: str, name: str = "ordinal") -> DataFrame:
    """(value, ordinal): the lines of text files, files by path.

    A part of a file is read by one task from its first line to its last; a line's place is its distance from the first
    in the numbers that the task deals. Both readings deal them alike, as they read the same listed files under the same settings.
    """
    read = spark.read.text(list(paths))
    placed = read.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_dealt"))
    counts = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_dealt").alias("_first"))
    joined = placed.join(F.broadcast(counts.select("_file", "_block", "_first")), ["_file", "_block"]).withColumn("_at", F.col("_dealt") - F.col("_first")).drop("_dealt")
    return _with_offsets(joined, counts.drop("_first"), ["_file", "_block"], name).select("value", name)


def first_rows(df: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The first n rows of the input's order, whatever order they are read in: each task keeps n at the most."""
    return df.orderBy(ordinal).limit(n)
