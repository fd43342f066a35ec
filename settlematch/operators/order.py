"""Whole orders of a table, worked on in ranges.

Ranges of the order are found by sampling and cut where sizes ask for it, inside a day or a price
as well, so no value of a key makes one task large. The ranges are written, which pins them;
sums and counts of whole ranges are then small tables, and rows add up within their range.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlematch.storage import written


def in_ranges(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """``rows`` as a written table with ``_range``: ranges are numbered in order of ``keys``, whose ties must not matter."""
    return written(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))


def running_sum(rows: DataFrame, by: list[str], keys: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` from the first row of the order up to the row itself, per value of ``by``.

    Two levels: totals of ranges before a range, then rows within it. Rows that agree in all
    ``keys`` are taken in any order.
    """
    ranged = in_ranges(rows.withColumn("_value", value), [F.col(c) for c in (*by, *keys)])
    totals = ranged.groupBy(*by, "_range").agg(F.sum("_value").alias("_moved"))  # a row per range and group in it
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_{c}") for c in (*by, "_range")], F.coalesce(F.sum("_moved").over(before), F.lit(0)).alias("_start"))
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "_range")])
    inside = Window.partitionBy(*by, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(starts, same)
    return joined.withColumn(name, F.col("_start") + F.sum("_value").over(inside)).select(*[c for c in rows.columns if c != name], name)


def line_numbers(lines: DataFrame) -> DataFrame:
    """``lines`` (with ``place`` of :func:`with_place`) with ``line``, from 1, over all files in order of their names."""
    parts = lines.groupBy(F.col("place.file").alias("_file"), F.col("place.start").alias("_from")).agg(F.count("*").alias("_n"))  # a row per split of a file
    before = Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_file", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = lines.withColumns({"_file": F.col("place.file"), "_from": F.col("place.start")}).join(starts, ["_file", "_from"])
    inside = Window.partitionBy("_file", "_from").orderBy("place.row")
    return rows.withColumn("line", F.col("_before") + F.row_number().over(inside)).drop("_file", "_from", "_before")


def with_place(scan: DataFrame) -> DataFrame:
    """A file scan with ``place``: file, start of the split in it, and a number that grows with the lines of a split.

    Places compare as lines do, for any way of cutting the files into splits.
    """
    return scan.withColumn("place", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")))
