"""Sorted rows of any number, cut into ranges of bounded size, however the keys and values are distributed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.sources.stable import written

#: Rows of a range at most, about: Spark draws the bounds from a sample, so ranges are planned half as large.
RANGE_ROWS = 1_000_000


def planned_ranges(rows: int, bound: int) -> int:
    return 1 if rows <= bound else math.ceil(2 * rows / bound)


def in_ranges(df: DataFrame, order: Sequence[str | Column], rows: int, bound: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``_range``: numbers that rise with ``order`` and that rows with equal order share.

    The bounds follow the data, so neither a hot key nor values that crowd into a small interval make a range large. Runs Spark
    jobs when called: the result is written, since a repeated task must not see other bounds.
    """
    cut = df.repartitionByRange(planned_ranges(rows, bound), *order).withColumn("_range", F.spark_partition_id())
    return written(cut, "ranges")


def positions(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], rows: int, bound: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``_position``: the place, from 1, of each row among those of its key. Rows equal in ``order`` get any order.

    A key with all rows spreads over all ranges: a place is the number of the key's rows in earlier ranges (a window
    over one row per range) plus the place in the range. Runs Spark jobs when called.
    """
    # Equal rows would share a range; which of them comes first makes no difference, so their number may decide.
    numbered = df.withColumn("_row_number", F.monotonically_increasing_id())
    cut = in_ranges(numbered, [*key, *order, "_row_number"], rows, bound)
    earlier = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.groupBy(*key, "_range").agg(F.count("*").alias("_in_ranges"))
    sizes = sizes.select(*key, "_range", F.coalesce(F.sum("_in_ranges").over(earlier), F.lit(0)).alias("_earlier"))
    inside = F.row_number().over(W.partitionBy(*key, "_range").orderBy(*order, "_row_number"))
    placed = cut.withColumn("_in_range", inside).join(sizes, [*key, "_range"])
    return placed.withColumn("_position", F.col("_earlier") + F.col("_in_range")).drop("_row_number", "_range", "_earlier", "_in_range")
