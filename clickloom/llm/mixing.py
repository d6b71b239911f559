"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's budget.

Every source gets a budget of words (``source_targets``). Its documents are put in the order of a seeded hash. Whole
passes over the source are taken as long as they fit; the last, partial pass takes the documents from the front of that
order up to the cut. The order is cut into ranges of the hash; their sums, a few thousand for each source whatever the
number of documents, give the prefix sums at the ranges' ends. Only documents in the one range that holds a source's cut
have to be sorted, so a source with a third of all documents costs no more than the others.

Defined cases: a null text has no words; a null source is a source of its own, after all others; documents without words
take no budget; a null id is an id like any other; rows equal in id and text are interchangeable; an empty table gives
an empty result. A document is taken whole or not at all in the partial pass: the one on the cut is taken if at least
half of it lies before the cut, so a source misses its target by at most half a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.llm.common import SPACE_WORD, written

#: Hexadecimal digits of the hash that name a range: 4096 ranges.
RANGE_DIGITS = 3


def sized(docs: DataFrame, seed: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row`` (all columns of ``docs``, which so may have any name), __source, __size (words), __key (hash) and __range (the
    range that the key is in)."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(text_col, F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).alias("__source"), size.alias("__size"),
        key.alias("__key"), F.substring(key, 1, RANGE_DIGITS).alias("__range"))


def source_targets(sums: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """Budgets from ``sums`` (source, source_size), one row per source.

    Sources in order of code points, null last, weigh ``weights`` in turn. ``share`` of all words is dealt out by weight;
    no source gets more than ``max_repeats`` times its size, and what it can't use goes to the others by weight. In the
    order of limit per weight, the sources before some point are at their limit and all later ones are below, so one
    running sum finds the point. One task sees one row per source here, never documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    limit = F.col("source_size") * max_repeats
    filling = W.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    level = (
        (F.sum("source_size").over(W.partitionBy()) * F.lit(share) - F.coalesce(F.sum(limit).over(before), F.lit(0)))
        / F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing))
    )
    tested = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= limit)
    final = F.min(F.when(~F.col("full"), F.struct(limit / F.col("weight"), F.col("level")))).over(W.partitionBy())["level"]
    return tested.withColumn("final", final).select(
        "source", "source_size",
        F.when(F.col("full"), limit.cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"),
    )


def source_cuts(rows: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """One row per source of ``rows`` (from ``sized``): size, target, whole passes, words of the last pass, the last
    range that this pass takes whole, and the range that holds the cut. Written; runs Spark jobs."""
    ranges = rows.groupBy(F.col("__source").alias("source"), F.col("__range").alias("range")).agg(F.sum("__size").alias("words"))
    along = W.partitionBy("source").orderBy("range")
    ranges = written(
        ranges.withColumn("end", F.sum("words").over(along.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("source_size", F.sum("words").over(W.partitionBy("source"))), "mix-ranges",
    )
    targets = source_targets(ranges.select("source", "source_size").distinct(), weights, share, max_repeats)
    budget, size = F.floor("target"), F.col("source_size")
    passes = F.when(size > 0, F.floor(budget / size)).otherwise(0).cast("long")
    parts = targets.withColumn("passes", passes).withColumn("rest", (budget - F.col("passes") * size).cast("long"))
    placed = ranges.drop("source_size").alias("r").join(parts.alias("c"), F.expr("r.source <=> c.source")).select(
        "c.*", "range", (F.col("end") - F.col("words")).alias("start"), "end")
    cut = (F.col("start") < F.col("rest")) & (F.col("rest") < F.col("end"))
    return written(placed.groupBy("source", "source_size", "target", "passes", "rest").agg(
        F.max(F.when(F.col("end") <= F.col("rest"), F.col("range"))).alias("last_whole"),
        F.min(F.when(cut, F.struct("range", "start"))).alias("cut"),
    ), "mix-cuts")


def with_copies(rows: DataFrame, cuts: DataFrame, max_repeats: int) -> DataFrame:
    """``rows`` (from ``sized``) with __source_size, __target and __copies. Only rows in a cut range are moved and sorted."""
    joined = rows.alias("d").join(cuts.alias("c"), F.expr("d.__source <=> c.source")).select(
        "d.*", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("passes").alias("__passes"),
        F.col("rest").alias("__rest"), F.col("cut").alias("__cut"),
        F.coalesce(F.col("__range") <= F.col("last_whole"), F.lit(False)).alias("__whole"),
    )
    on_cut = F.coalesce(F.col("__range") == F.col("__cut.range"), F.lit(False))
    order = W.partitionBy("__source").orderBy("__key", "__size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("__cut.start") + F.coalesce(F.sum("__size").over(order), F.lit(0))
    near = joined.filter(on_cut).withColumn("__more", (2 * start + F.col("__size") <= 2 * F.col("__rest")).cast("long"))
    far = joined.filter(~on_cut).withColumn("__more", F.col("__whole").cast("long"))
    copies = F.least(F.col("__passes") + F.col("__more"), F.lit(max_repeats)).cast("long")
    return far.unionByName(near).withColumn("__copies", copies).drop("__passes", "__rest", "__cut", "__whole", "__more")


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often each document is taken: id, source, size, source_size, target, copies, taken (size times copies).

    Runs Spark jobs when called: sizes are counted once and written.
    """
    rows = written(sized(docs, seed, id_col, text_col, source_col).select(
        F.col("row").getField(id_col).alias("id"), "__source", "__size", "__key", "__range"), "mix-sizes")
    copied = with_copies(rows, source_cuts(rows, weights, share, max_repeats), max_repeats)
    return copied.select(
        "id", F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def mixed_rows(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken. Runs Spark jobs when called."""
    rows = sized(docs, seed, id_col, text_col, source_col)
    copied = with_copies(rows, source_cuts(rows, weights, share, max_repeats), max_repeats)
    taken = copied.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")))
    return taken.select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS most FROM sums
), levels AS (
  SELECT a.source, a.source_size, a.weight, a.most,
         ((SELECT sum(source_size) FROM sums)
           - coalesce(sum(b.most) FILTER (WHERE b.most / b.weight < a.most / a.weight), 0))
         / sum(b.weight) FILTER (WHERE b.most / b.weight >= a.most / a.weight) AS level
  FROM weighed a CROSS JOIN weighed b GROUP BY ALL
), fill AS (
  SELECT min_by(level, most / weight) FILTER (WHERE level * weight < most) AS level FROM levels
), targets AS (
  SELECT source, source_size,
         CASE WHEN levels.level * weight >= most THEN most::DOUBLE ELSE fill.level * weight END AS target
  FROM levels, fill
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END::BIGINT AS passes,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (passes + (2 * before + size <= 2 * (floor(target)::BIGINT - passes * source_size))::INT))::BIGINT AS taken
FROM placed
"""
