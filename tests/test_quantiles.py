"""Exact quantiles against sorting, with skew: one group holds a third of the rows, one value most of another."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clickloom.functions.quantiles import quantiles, value_counts
from clickloom.functions.ranges import in_ranges, positions


@pytest.mark.parametrize("kind, bound", [("double", 10**6), ("int", 10**6), ("double", 200), ("int", 50)])
def test_quantiles_equal_sorting(spark, kind, bound):
    draw = random.Random(4)
    cast = float if kind == "double" else int
    rows = [("hot", cast(draw.choice([draw.uniform(-50, 1e6), draw.expovariate(0.1)]))) for _ in range(4000)]
    rows += [("flat", cast(7))] * 3000 + [("flat", cast(v)) for v in range(40)]
    rows += [(f"g{i % 500}", cast(draw.uniform(-3, 3) * 10 ** draw.randrange(6))) for i in range(5000)] + [("hot", None)]
    shares = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    df = spark.createDataFrame(rows, f"g string, v {kind}")
    got = {r["g"]: r["q"] for r in quantiles(value_counts(df, ["g"], "v"), ["g"], "v", shares, bound=bound).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        values.sort()
        assert got[g] == [values[max(1, math.ceil(len(values) * p)) - 1] for p in shares], g


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles(value_counts(df, ["g"], "v"), ["g"], "v", [0.5]).collect() == []


def test_crowded_values_stay_below_the_bound(spark):
    """A million different values, all but a few inside 0.1% of their span: no range holds more than the bound."""
    n, bound = 1_000_000, 100_000
    df = spark.range(n).select(F.lit("g").alias("g"), (F.lit(1000.0) + F.col("id") / n).alias("v"), F.lit(1).cast("long").alias("n"))
    df = df.unionByName(spark.createDataFrame([("g", -1e6, 1), ("g", 1e6, 1)], df.schema))
    cut = in_ranges(df, ["g", "v"], n + 2, bound)
    assert cut.groupBy("_range").count().agg(F.max("count")).first()[0] <= bound
    got = quantiles(df, ["g"], "v", [0.5, 0.9], bound=bound).first()["q"]
    values = [-1e6, *(1000.0 + i / n for i in range(n)), 1e6]
    assert got == [values[math.ceil((n + 2) * p) - 1] for p in (0.5, 0.9)]


def test_positions_with_hot_key_and_equal_rows(spark):
    """One key has all but a few rows, most of them equal in the order: places are still 1 to n, and no range is large."""
    rows = [("hot", 5)] * 3000 + [("hot", i) for i in range(500)] + [("cold", 1), ("cold", 0)]
    df = spark.createDataFrame(rows, "k string, t int").repartition(6)
    got = positions(df, ["k"], ["t"], len(rows), bound=200).collect()
    for k in ("hot", "cold"):
        own = sorted((r["_position"], r["t"]) for r in got if r["k"] == k)
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert [t for _, t in own] == sorted(t for key, t in rows if key == k)
