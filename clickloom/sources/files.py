"""Small helpers on the file system that Spark uses (local, HDFS, object stores)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import SparkSession


def of(spark: SparkSession, path: str):
    """The file system of a path, and the path as an object of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = of(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = of(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move ``source`` to ``target``, which must not exist."""
    fs, at = of(spark, target)
    if fs.exists(at):
        raise FileExistsError(target)
    if at.getParent() is not None:
        fs.mkdirs(at.getParent())
    if not fs.rename(of(spark, source)[1], at):
        raise OSError(f"could not move {source} to {target}")


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in a folder; nothing if there is no such folder."""
    fs, at = of(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = of(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet; False if somebody else has made it."""
    fs, at = of(spark, path)
    try:
        stream = fs.create(at, False)
    except Exception as error:  # py4j hands Java's exceptions on as one type
        if fs.exists(at):
            return False
        raise error
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> str:
    """A digest of path, length and modification time of every file below the paths; a path without files counts too."""
    digest = hashlib.sha256()
    for path in sorted(set(paths)):
        fs, at = of(spark, path)
        found = []
        if fs.exists(at):
            files = fs.listFiles(at, True)
            while files.hasNext():
                file = files.next()
                found.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
        digest.update("\n".join([path, *sorted(found), ""]).encode())
    return digest.hexdigest()
