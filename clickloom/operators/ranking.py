"""NTILE over a whole table without pulling it into one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.sources.stable import written

# monotonically_increasing_id() keeps the task number above these bits and the row number below.
_ROW_BITS = 33


@dataclass(frozen=True)
class Score:
    """A score to be computed: rows in ascending order of ``value`` (numeric), ties by the id column."""

    name: str
    value: Column


def _tile_ends(rows: int, k: int) -> list[int]:
    """Rank of the last row of tiles 1..k-1; the first rows % k tiles hold one row more."""
    size, longer = divmod(rows, k)
    return [t * size + min(t, longer) for t in range(1, k)]


def add_ntiles(df: DataFrame, scores: list[Score], id_col: str, k: int) -> DataFrame:
    """Add one integer column per score holding NTILE(k) in the score's order.

    All scores share one sort: the rows are put below each other as
    (score, value, id), sorted by range partitioning and written, so positions
    are fixed. From the row count of each sorted part (one number per task) the
    positions of the k-1 tile ends follow; just those rows are read back, and
    tiles are then assigned by comparing every row with the ends, without
    moving ``df`` at all.  The id column must be unique.
    """
    source = written(df, "ntile-input")
    stacked = source.select(
        F.col(id_col).alias("_id"),
        F.posexplode(F.array(*[s.value.cast("double") for s in scores])).alias("_score", "_value"),
    )
    placed = written(
        stacked.orderBy("_score", "_value", "_id").withColumn("_place", F.monotonically_increasing_id()),
        "ntile-order",
    )
    parts = (
        placed.groupBy("_score", F.shiftrightunsigned("_place", _ROW_BITS).alias("_part"))
        .agg(F.count("*").alias("rows"), F.min("_place").alias("first"))
        .orderBy("_score", "_part")
        .collect()  # one row per task of the sort
    )
    places: dict[int, tuple[int, int]] = {}
    for number in range(len(scores)):
        own = [p for p in parts if p["_score"] == number]
        ends = _tile_ends(sum(p["rows"] for p in own), k)
        before = 0
        for part in own:
            for tile, end in enumerate(ends):
                if before < end <= before + part["rows"]:
                    places.setdefault(part["first"] + end - before - 1, (number, tile))
            before += part["rows"]
    found = placed.where(F.col("_place").isin(list(places))).collect() if places else []
    out = source
    for number, score in enumerate(scores):
        ends = sorted((r["_value"], r["_id"]) for r in found if r["_score"] == number)
        value = score.value.cast("double")
        tile = F.lit(1)
        for end_value, end_id in ends:
            beyond = (value > end_value) | ((value == end_value) & (F.col(id_col) > F.lit(end_id)))
            tile = tile + F.when(beyond, 1).otherwise(0)
        out = out.withColumn(score.name, tile)
    return out
