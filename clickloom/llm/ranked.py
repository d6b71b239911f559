"""Ranked lexical search by NRA: impact-sorted lists, score intervals, reads until nothing about the result is open.

1. One pass over the whole texts keeps, for each document, its number of terms and how often each query term occurs in it
   (written as a table). From that table Spark counts documents, terms, and documents per query term.
2. Shards: the table is scored in shards of documents (Arrow batches, cut further at SHARD_POSTINGS). In a shard every query
   term has a list of (document, impact), sorted by falling impact; the impact is the whole share of that term in a score.
3. NRA for each item: rounds read all its lists on, entry by entry from the top, down to a common impact level. A document's
   lower bound is the sum of the impacts read for it; its upper bound adds, for each list where it was not met yet, the
   impact that comes next there. The k-th largest lower bound (or the k-th score of earlier shards of the task) is the mark:
   documents whose upper bound lies below it are out. Reading ends when every other document's interval is one number; so
   members, their order, ties and scores are final, and no list is read further than that.
4. Spark merges the shards' results: a rank per item over at most k rows from each shard.

Items are scored in blocks of about BLOCK_TERMS (item, term) pairs, by hash; only one block's items, its terms' counts and
its weights are ever on the driver and in a task. All documents meet all items, whatever the number of either. No posting
list is in one place as a whole: a term in every document is as many short lists as there are shards.

Weights and scores are integers: w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 50 + (50 * n * N) div L, and a document's
score is the sum of w * ((10**9 * tf) div (1000 * tf + 20 * m)) over the item's different terms.

Defined cases: null, empty and term-less texts match nothing and count in no statistic; an item without terms, or with
terms that no document holds, has no result; rows with equal item ids are one item with all their terms, null ids too; rows
with equal document ids are documents of their own; equal scores are ranked by id, nulls last; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import ascii_lower, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_TERMS = 100_000
SHARD_POSTINGS = 2_000_000
#: Each round of reads goes down to this part of the level of the round before.
NEXT_LEVEL = 0.25
#: For bytes.translate: A-Z lowered, other ASCII letters and digits and all bytes of other characters kept, the rest to spaces.
_TABLE = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _lists(lengths: list[int], values: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values, pa.int32()))


def _counted(number_of: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lengths, numbers, counts = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                terms = terms_of(text)
                known = [(number_of[t], c) for t, c in Counter(terms).items() if t in number_of]
                n.append(len(terms))
                lengths.append(len(known))
                numbers.extend(k for k, _ in known)
                counts.extend(c for _, c in known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), _lists(lengths, numbers), _lists(lengths, counts)],
                names=["id", "n", "terms", "tfs"])
    return run


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents (0 to size - 1) that can be among the k best with at least the score ``least``, and their exact scores.

    ``lists``: for each term the documents that hold it and their impacts, falling. All of the k best are returned, with
    everything that ties with the last of them.
    """
    read = np.zeros(len(lists), np.int64)
    falling = [-impacts for _, impacts in lists]
    next_up = np.array([impacts[0] for _, impacts in lists], np.float64)  # sums stay below 2**53, so they are exact
    lower, unseen = np.zeros(size), np.ones((len(lists), size))
    level = next_up.max()
    while True:
        upper = lower + next_up @ unseen
        mark = max(least, np.partition(lower, size - k)[size - k]) if size >= k else least
        open_ = upper >= mark
        if not (upper[open_] > lower[open_]).any():
            found = np.flatnonzero(open_)
            return found, lower[found].astype(np.int64)
        level = min(level * NEXT_LEVEL, next_up.max())
        for t, (documents, impacts) in enumerate(lists):
            if next_up[t] >= level and read[t] < len(documents):
                end = int(np.searchsorted(falling[t], -level, side="right"))
                some = documents[read[t]:end]
                lower[some] += impacts[read[t]:end]
                unseen[t, some] = 0
                read[t] = end
                next_up[t] = impacts[end] if end < len(documents) else 0


def impacts_of(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((10**9 * tf) // (1000 * tf + 20 * m))


def _best(found: np.ndarray, scores: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((rank[found], -scores))[:k]
    return found[order], scores[order]


def _searched(items: list[list[int]], weights: list[int], documents: int, all_terms: int, k: int):
    """items: the term numbers of each; weights: of each term number."""
    weight, wanted = np.array(weights, np.int64), [np.array(sorted(i), np.int64) for i in items]

    def shards(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([len(x) for x in batch.column("terms")])
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + SHARD_POSTINGS, side="right")))
            yield batch.slice(start, end - start)
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [np.empty(0, np.int64) for _ in items]  # the k best scores of this task so far
        for shard in (s for b in batches for s in shards(b)):
            size = shard.num_rows
            lengths = np.array([len(x) for x in shard.column("terms")])
            m = np.array([50 + 50 * n * documents // all_terms for n in shard.column("n").to_pylist()], np.int64)
            term, tf = (shard.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            document = np.repeat(np.arange(size), lengths)
            impact = impacts_of(weight[term], tf, m[document])
            order = np.lexsort((-impact, term))
            term, document, impact = term[order], document[order], impact[order]
            rank = np.empty(size, np.int64)
            rank[pc.sort_indices(shard.column("id"), null_placement="at_end").to_numpy()] = np.arange(size)
            out: tuple[list, list, list] = ([], [], [])
            for number, own in enumerate(wanted):
                low, high = np.searchsorted(term, own), np.searchsorted(term, own, side="right")
                lists = [(document[a:b], impact[a:b]) for a, b in zip(low, high) if a < b and impact[a] > 0]
                if not lists:
                    continue
                least = int(top[number][0]) if len(top[number]) == k else 1
                found, scores = _best(*nra(lists, size, k, least), rank, k)
                top[number] = np.sort(np.concatenate([top[number], scores]))[-k:]
                for into, values in zip(out, (np.full(len(found), number), found, scores)):
                    into.append(values)
            if out[0]:
                number, found, scores = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int32()), shard.column("id").take(pa.array(found)), pa.array(scores, pa.int64())],
                    names=["number", "id", "score"])
    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """item, rank, id and score of the k best documents of each item. Runs Spark jobs when called."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, item_type = keyed.schema["id"].dataType, items.schema[item_col].dataType
    found_schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])
    term_in = F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(item_text_col)), F.lit(TERM), 0)))
    pairs = written(items.select(F.col(item_col).alias("item"), term_in.alias("term")).distinct(), "item-terms")
    blocks = math.ceil(pairs.count() / block_terms)
    out = spark.createDataFrame([], T.StructType([
        T.StructField("item", item_type), T.StructField("rank", T.IntegerType()), *found_schema.fields[1:]]))
    of_item = F.pmod(F.xxhash64("item"), F.lit(max(1, blocks)))
    statistics = None
    for block in range(blocks):
        # About ``block_terms`` pairs of item and term, or one item that has more.
        own = pairs.filter(of_item == block).groupBy("item").agg(F.collect_set("term").alias("terms")).collect()
        names = sorted({t for r in own for t in r["terms"]})
        if not names:
            continue
        number_of = {t: i for i, t in enumerate(names)}
        schema = T.StructType([
            T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("tfs", T.ArrayType(T.IntegerType()))])
        counted = written(keyed.mapInArrow(_counted({t.encode(): i for t, i in number_of.items()}), schema), "term-counts")
        if statistics is None:
            statistics = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        documents, all_terms = statistics
        df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect())  # one row per term of the block
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(names))]
        searched = _searched([[number_of[t] for t in r["terms"]] for r in own], weights, documents, all_terms, k)
        found = counted.filter(F.size("terms") > 0).mapInArrow(searched, found_schema)
        # Rows past the k-th of an item go before the shuffle, partition by partition.
        rank = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        numbers = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(own)], T.StructType([
            T.StructField("number", T.IntegerType()), T.StructField("item", item_type)]))
        part = written(ranked.join(F.broadcast(numbers), "number").select("item", "rank", "id", "score"), "ranked")
        out = part if blocks == 1 else out.unionByName(part)
    return out


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), totals AS (
  SELECT count(*) FILTER (WHERE len(t) > 0) AS docs, sum(len(t))::BIGINT AS terms FROM d
), held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term
), weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, totals WHERE term IN (SELECT term FROM q) GROUP BY term
), scored AS (
  SELECT item_id, doc_id, r,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * docs) // terms))))::BIGINT AS score
  FROM q JOIN weighed USING (term) JOIN held USING (term) JOIN d USING (r), totals GROUP BY item_id, doc_id, r
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
