"""Written intermediate results that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from clickloom.sources import files


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="clickloom-")


def scratch_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set with setCheckpointDir.

    Only a session on one machine may do without it. On a cluster it has to be one that all executors share; a folder
    for temporary files is refused there.
    """
    one_machine = spark.sparkContext.master.startswith("local")
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not one_machine:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = (folder or _local_folder()).rstrip("/")
    if not one_machine and (folder.removeprefix("file://") + "/").startswith((tempfile.gettempdir() + "/", "/tmp/")):
        raise RuntimeError(f"{folder} is local to each machine; name a shared folder in spark.checkpoint.dir")
    return folder


def remove_scratch(spark: SparkSession) -> None:
    """Delete everything this library has written below the scratch folder. Call it when no result is read any more."""
    files.delete(spark, f"{scratch_folder(spark)}/clickloom")
    _STORED.clear()
    _REPLACED.clear()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody used before."""
    return f"{scratch_folder(spark)}/clickloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet and return the table read back.

    Use it where later steps must see exactly the same rows (positions in a
    sorted table), or where a small result takes part in a join: Spark then
    knows its real size and broadcasts it only below
    spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@dataclass(frozen=True)
class _Copy:
    inputs: str  # digest of the input's files
    path: str
    schema: StructType


# Where a session keeps the tables that many operators read: (application, what it was made from, name) -> the copy.
_STORED: dict[tuple[str, tuple[str, ...], str], _Copy] = {}
# Copies that a newer one has replaced.
_REPLACED: dict[tuple[str, tuple[str, ...], str], list[str]] = {}
_TRIES = 3


def stored_once(spark: SparkSession, made_from: Sequence[str], name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``make()`` gives, written at its first use in the session and read back.

    ``made_from`` names every file or folder that ``make`` reads. Their files' paths, lengths and modification times are
    compared at each call, so the copy is made again after a write to one of them (or if the copy was deleted); a write
    while the copy is being made is noticed too. A replaced copy stays for tables read before, until the next
    replacement or ``remove_replaced``.
    """
    key = (spark.sparkContext.applicationId, tuple(made_from), name)
    inputs, copy = files.fingerprint(spark, made_from), _STORED.get(key)
    if copy is None or copy.inputs != inputs or not files.exists(spark, copy.path):
        for _ in range(_TRIES):
            df, path = make(), scratch_path(spark, name)
            df.write.parquet(path)
            before, inputs = inputs, files.fingerprint(spark, made_from)
            if before == inputs:
                break
            files.delete(spark, path)
        else:
            raise RuntimeError(f"{', '.join(made_from)} changed each time {name} was made from it")
        for old in _REPLACED.pop(key, []):
            files.delete(spark, old)
        if copy is not None:
            _REPLACED[key] = [copy.path]
        copy = _STORED[key] = _Copy(inputs, path, df.schema)
    return spark.read.schema(copy.schema).parquet(copy.path)


def remove_replaced(spark: SparkSession) -> int:
    """Delete the copies that a newer one has replaced; returns how many. Tables read from them fail from then on."""
    old = [path for paths in _REPLACED.values() for path in paths]
    for path in old:
        files.delete(spark, path)
    _REPLACED.clear()
    return len(old)
