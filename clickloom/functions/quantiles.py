"""Exact quantiles of groups of any size, from counts of their different values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions.ranges import RANGE_ROWS, in_ranges, planned_ranges
from clickloom.sources.stable import written

def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row (``by``, ``value``, n) per different value, nulls left out; written once, for several readers."""
    present = df.where(F.col(value).isNotNull())
    return written(present.groupBy(*by, value).agg(F.count("*").alias("n")), "value-counts")


def quantiles(
    counts: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], rows: int | None = None, bound: int = RANGE_ROWS,
) -> DataFrame:
    """``by`` and an array ``q``: for each share p the smallest value that at least p of the group's rows don't exceed.

    ``counts`` has one row (``by``, ``value``, n) per different value, ``rows`` of them at most (else they are counted).
    Up to ``bound`` rows, a window per group adds them up. Beyond, they are sorted by range partitioning into ranges of
    about that size at most, whatever the values are; sums of ranges tell which range holds a quantile, and only that one is
    looked into. Rows that repeat a value were counted before they moved. Group columns must not be null.
    """
    rows = counts.count() if rows is None else rows
    whole = W.partitionBy(*by)

    def ranks(total: Column) -> list[Column]:
        return [F.greatest(F.ceil(total * F.lit(p)), F.lit(1)) for p in shares]

    if planned_ranges(rows, bound) == 1:
        ended = counts.select(
            *by, value, "n", F.sum("n").over(whole).alias("_total"), F.sum("n").over(whole.orderBy(value)).alias("_end"))
    else:
        cut = in_ranges(counts, [*by, value], rows, bound)
        sums = cut.groupBy(*by, "_range").agg(F.sum("n").alias("_rows"))
        below = F.sum("_rows").over(whole.orderBy("_range")) - F.col("_rows")
        placed = sums.select(*by, "_range", "_rows", below.alias("_below"), F.sum("_rows").over(whole).alias("_total"))
        holds = [(r > F.col("_below")) & (r <= F.col("_below") + F.col("_rows")) for r in ranks(F.col("_total"))]
        wanted = placed.where(reduce(Column.__or__, holds)).drop("_rows")
        inside = W.partitionBy(*by, "_range").orderBy(value)
        ended = cut.join(wanted, [*by, "_range"]).withColumn("_end", F.col("_below") + F.sum("n").over(inside))
    picks = [
        F.max(F.when((r > F.col("_end") - F.col("n")) & (r <= F.col("_end")), F.col(value))) for r in ranks(F.col("_total"))
    ]
    return ended.groupBy(*by).agg(F.array(*picks).alias("q"))
