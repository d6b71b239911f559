"""Tables in versions: a manifest lists the folders that make up the table, and each change is one new manifest.

    <table>/manifests/00000003.json   {"loads": {"2019-10": "load=<name>", ...}}
    <table>/data/load=<name>/...      parquet, never changed after it was listed

A change writes its data first and then creates the next manifest, which fails if somebody else has created it; the
change is then tried again on top of theirs. Readers take the highest whole manifest. So a table is never seen
half-written or missing, a job that fails shows nothing, and a table can be its own source.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.sources import files

ONLY = "all"


def _manifests(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names(spark, f"{path}/manifests") if n.endswith(".json") and n[:-5].isdigit())


def _loads(spark: SparkSession, path: str, number: int) -> dict[str, str] | None:
    """What a manifest lists; None while it is being written."""
    try:
        return json.loads(files.read_text(spark, f"{path}/manifests/{number:08d}.json"))["loads"]
    except ValueError:
        return None


def current(spark: SparkSession, path: str) -> dict[str, str]:
    """Load id -> folder of the table as it is now; empty if there is no table."""
    for number in reversed(_manifests(spark, path)):
        loads = _loads(spark, path, number)
        if loads is not None:
            return loads
    return {}


def _publish(spark: SparkSession, path: str, change: Callable[[dict[str, str]], dict[str, str] | None]) -> bool:
    """Make ``change`` of the listed loads the next manifest; None means that there is nothing to change."""
    while True:
        last = max(_manifests(spark, path), default=0)
        loads = change(current(spark, path))
        if loads is None:
            return False
        if files.create_text(spark, f"{path}/manifests/{last + 1:08d}.json", json.dumps({"loads": loads})):
            return True


def _written(df: DataFrame, path: str, partition_by: list[str]) -> str:
    folder = f"load={uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*partition_by).parquet(f"{path}/data/{folder}")
    except BaseException:
        files.delete(df.sparkSession, f"{path}/data/{folder}")
        raise
    return folder


def append(df: DataFrame, path: str, load: str, partition_by: list[str] = []) -> bool:
    """Add ``df`` as the load ``load``. A load that the table already has changes nothing; False then."""
    spark = df.sparkSession
    if load in current(spark, path):
        return False
    folder = _written(df, path, partition_by)
    added = _publish(spark, path, lambda loads: None if load in loads else {**loads, load: folder})
    if not added:  # the same load from elsewhere was faster
        files.delete(spark, f"{path}/data/{folder}")
    return added


def replace(df: DataFrame, path: str, load: str = ONLY, partition_by: list[str] = []) -> None:
    """Make ``df`` the whole table. The version before stays readable until ``clean``."""
    folder = _written(df, path, partition_by)
    _publish(df.sparkSession, path, lambda _: {load: folder})


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now. Later changes do not touch what was read here."""
    loads = current(spark, path)
    if not loads:
        raise FileNotFoundError(f"no table at {path}")
    folders = [f"{path}/data/{folder}" for _, folder in sorted(loads.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("load")


def clean(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the folders that only manifests before the last ``keep`` list; returns how many. Running writers are not touched."""
    numbers = _manifests(spark, path)
    listed = {n: set((_loads(spark, path, n) or {}).values()) for n in numbers}
    kept = set().union(*(listed[n] for n in numbers[-keep:]))
    gone = set().union(*(listed[n] for n in numbers[:-keep])) - kept
    for folder in gone:
        files.delete(spark, f"{path}/data/{folder}")
    for n in numbers[:-keep]:
        files.delete(spark, f"{path}/manifests/{n:08d}.json")
    return len(gone)
