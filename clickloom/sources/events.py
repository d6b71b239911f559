"""Readers, writers and load checks for the events table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.sources import versions
from clickloom.sources.schema import CSV_EVENTS, EVENT_TIME_FORMAT, EVENTS


def read_events_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Text files (plain or .gz) with a header line, read with the fixed schema.

    Plain files are split and read in parallel. A quoted field that holds a line
    break needs ``multi_line=True``, which makes each file one task; without it
    such a line raises. That check needs all columns of every line, so columns
    are not pruned while parsing.
    """
    raw = (
        spark.read.schema(CSV_EVENTS)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .csv(path)
    )
    return raw.withColumn("event_time", F.to_timestamp("event_time", EVENT_TIME_FORMAT))


def write_csv(df: DataFrame, path: str) -> None:
    """A query result as CSV with a header."""
    df.write.option("header", True).csv(path)


def write_events_csv(ev: DataFrame, path: str) -> None:
    """Events in the text form ``read_events_csv`` understands (whole seconds)."""
    text = ev.select(
        F.date_format("event_time", EVENT_TIME_FORMAT).alias("event_time"),
        *[F.col(f.name) for f in EVENTS.fields[1:]],
    )
    text.write.option("header", True).option("escape", '"').csv(path)


def _laid_out(ev: DataFrame) -> DataFrame:
    """Few, well filled files per day, rows of one event type next to each other.

    The rebalance hint gathers a day's rows but splits a day that is too large
    for one task, so a day holding a third of all rows is written by many tasks.
    """
    return (
        ev.withColumn("event_date", C.event_date())
        .hint("rebalance", F.col("event_date"))
        .sortWithinPartitions("event_date", "event_type", "event_time")
    )


def write_events(ev: DataFrame, path: str) -> None:
    """Day-partitioned parquet table, sorted by event type inside each file. Replaces the table as a whole."""
    versions.replace(_laid_out(ev), path, partition_by=["event_date"])


def append_events(ev: DataFrame, path: str, load: str) -> bool:
    """Add a load (for example one month, ``load="2019-10"``) to the table, creating it if it is missing.

    A load that is already there changes nothing and gives False, so a repeated job is harmless; one that fails half-way
    shows nothing and can be run again.
    """
    return versions.append(_laid_out(ev), path, load, partition_by=["event_date"])


def read_events(
    spark: SparkSession,
    path: str,
    start: date | None = None,
    end: date | None = None,
    event_type: str | None = None,
) -> DataFrame:
    """Table scan; a date range prunes folders, an event type prunes row groups."""
    ev = versions.read(spark, path)
    if start is not None:
        ev = ev.where(F.col("event_date") >= F.lit(start))
    if end is not None:
        ev = ev.where(F.col("event_date") <= F.lit(end))
    if event_type is not None:
        ev = ev.where(F.col("event_type") == event_type)
    return ev


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Create or replace a derived table and return it read back.

    Readers see the old table until the new one is complete; a failing job leaves the old one. ``df`` may read the
    table it replaces. ``versions.clean`` deletes what was replaced.
    """
    versions.replace(df, path)
    return read_table(df.sparkSession, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``save_table`` has written, as it is now."""
    return versions.read(spark, path)


def events_per_month(ev: DataFrame) -> DataFrame:
    return ev.groupBy(C.year_month().alias("month")).agg(F.count("*").alias("cnt")).orderBy("month")


def event_type_distribution(ev: DataFrame) -> DataFrame:
    """Rows and share per event type. The share's window runs over one row per event type."""
    counts = ev.groupBy("event_type").agg(F.count("*").alias("cnt"))
    total = F.sum("cnt").over(W.partitionBy())
    return counts.withColumn("pct", C.pct(F.col("cnt"), total)).orderBy(F.desc("cnt"), "event_type")
