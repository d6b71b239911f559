"""What several of the operators share: words, size-checked broadcasts, ordered buckets."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from clickloom.sources.stable import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A table is sent to every executor only if it was counted and has at most so many rows.
BROADCAST_ROWS = 1_000_000
#: Characters of an ordered bucket, about.
BUCKET_CHARS = 16_000_000


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint at a broadcast of a written table if it has at most ``limit`` rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (upper and lower case are alike to Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_ordered_bucket(df: DataFrame, by: str, name: str, text: str, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Add ``name``: an int that never falls as ``by`` rises, with about equally many rows of each, nulls first.

    There are as many buckets as ``text`` has ``bucket_chars`` characters in all rows, so their size does not grow with the
    table; equal values share one. For numbers the only thing the driver holds is one bound per bucket; the bucket is a
    function of the value, the same in a repeated task. Other ids are cut by range partitioning, and the result is written.
    """
    wanted = max(16, -(-(df.agg(F.sum(F.length(text))).first()[0] or 0) // bucket_chars))
    if not isinstance(df.schema[by].dataType, NumericType):
        cut = df.repartitionByRange(wanted, F.col(by).asc_nulls_first())
        return written(cut.withColumn(name, F.when(F.col(by).isNull(), -1).otherwise(F.spark_partition_id())), "ordered")
    shares = ", ".join(str(i / wanted) for i in range(1, wanted))
    bounds = df.agg(F.expr(f"percentile_approx(cast({by} as double), array({shares}), {wanted * 20})")).first()[0] or []
    splits = [float("-inf"), *sorted(set(bounds) or {0.0}), float("inf")]
    cast = df.withColumn(name + "_value", F.col(by).cast("double"))
    cut = Bucketizer(splits=splits, inputCol=name + "_value", outputCol=name, handleInvalid="keep").transform(cast)
    return cut.withColumn(name, F.when(F.col(by).isNull(), -1).otherwise(F.col(name).cast("int"))).drop(name + "_value")


__all__ = ["SPACE_WORD", "ascii_lower", "if_small", "table", "unused", "with_ordered_bucket", "written"]
