"""Data dictionary built from the tables' own schemas and the measures' own docstrings."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession

from clickloom.plans import measures


def column_dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: table, name, type, comment."""
    rows = [
        (table, f.name, f.dataType.simpleString(), f.metadata.get("comment", ""))
        for table, df in tables.items()
        for f in df.schema.fields
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, description string")


def measure_dictionary(spark: SparkSession) -> DataFrame:
    """One row per measure: name, the mart tables it needs, its definition."""
    rows = []
    for name, function in sorted(vars(measures).items()):
        if name.startswith("_") or not inspect.isfunction(function) or function.__module__ != measures.__name__:
            continue
        inputs = ", ".join(p for p in inspect.signature(function).parameters if p != "by")
        rows.append((name, inputs, (inspect.getdoc(function) or "").split("\n")[0]))
    return spark.createDataFrame(rows, "measure string, inputs string, description string")
