"""Benchmark decontamination by a prefix-filtered join of shingles, in DataFrame operations only.

A benchmark item is cut into windows of ``window`` consecutive words; a shorter item is one window. A document is hit
where a whole window occurs word for word.

1. Shingles (runs of ``shingle`` words; as many as the window has if it has fewer) of the benchmark are looked up in
   every document, which gives the positions of all benchmark shingles in the corpus.
2. Those positions give each shingle's frequency. The shingles of a window are ordered by rarity. As all of them have to
   occur, the necessary prefix has one token: the rarest shingle. It alone is joined.
3. A found shingle fixes where its window would have to lie. Positional and length bounds drop windows that would stick
   out of the document.
4. What is left is verified: the document's words over the window's length must be the window's words.

The benchmark side is broadcast only if it was counted and is small, else both sides are shuffled. The corpus is exploded
to (position, 64-bit hash) rows which go no further than that lookup; texts are shuffled once, to meet their candidates.

Defined cases: null or empty texts and items have no words and no hits; equal rows get equal results each; a null
document id or item id is an id of its own (the item is written as an empty string); an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import ascii_lower, if_small, unused, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 4


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingle_hashes(words: Column, size: int) -> Column:
    """A hash for every position; at the end of the text of fewer words, which verification sorts out."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, size))))


def windows_of(benchmark: DataFrame, window: int, shingle: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Every different window: text (words joined by a space), length, shingle size and hashes, and the items it is from."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("n", F.least(F.lit(window), F.size("w")))
    cut = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    cut = cut.select("item", "n", F.slice("w", F.col("at"), F.col("n")).alias("w"))
    same = cut.groupBy("w", "n").agg(F.collect_set(F.coalesce("item", F.lit(""))).alias("items"))
    size = F.least(F.lit(shingle), F.col("n"))
    hashes = F.lit(None).cast("array<bigint>")
    for k in range(1, shingle + 1):
        hashes = F.when(size == k, F.slice(shingle_hashes(F.col("w"), k), 1, F.col("n") - k + 1)).otherwise(hashes)
    return same.select(F.array_join("w", " ").alias("window"), "n", size.alias("size"), hashes.alias("hashes"), "items")


def _covered(spans: Column) -> Column:
    """Words in the union of (start, n) spans sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["start"] + s["n"])
        return F.struct(end.alias("end"), (acc["total"] + end - F.greatest(acc["end"], F.least(s["start"], end))).alias("total"))

    return F.aggregate(spans, zero, add, lambda acc: acc["total"])


def find(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``key`` (hash of the text), n_words, ``spans`` (start, n, items) and sorted ``items``.

    Runs Spark jobs when called: the windows and the places of their shingles are written.
    """
    windows = written(windows_of(benchmark, window, shingle, item_col, item_text_col), "windows")
    tokens = written(windows.select("size", F.explode("hashes").alias("h")).distinct(), "window-shingles")
    used = [r[0] for r in tokens.select("size").distinct().collect()]  # at most ``shingle`` numbers
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("key"), F.col(text_col).alias("text"))
    keyed = texts.select("id", "key", words_of(F.col("text")).alias("w"))
    places = None
    for size in sorted(used):
        at = keyed.select("id", "key", F.size("w").alias("n_words"), F.posexplode(shingle_hashes(F.col("w"), size)).alias("pos", "h"))
        some = if_small(tokens.filter(F.col("size") == size).select("h"))
        found = at.join(some, "h").withColumn("size", F.lit(size))
        places = found if places is None else places.unionByName(found)
    if places is None:
        none = F.array().cast("array<struct<start:int,n:int,items:array<string>>>")
        return keyed.select("id", "key", F.size("w").alias("n_words"), none.alias("spans"), F.array().cast("array<string>").alias("items"))
    places = written(places.distinct(), "shingle-places")
    rarity = places.groupBy("size", "h").agg(F.count("*").alias("seen"))
    # A window with a shingle that is nowhere in the corpus can't occur: the inner join by all its shingles drops it.
    ranked = windows.select("window", "n", "size", "items", F.size("hashes").alias("wanted"), F.posexplode("hashes").alias("offset", "h"))
    rarest = (
        ranked.join(rarity, ["size", "h"]).groupBy("window", "n", "size", "items", "wanted")
        .agg(F.count("*").alias("present"), F.min(F.struct("seen", "h", "offset")).alias("first"))
        .filter(F.col("present") == F.col("wanted"))
        .select("window", "n", "size", "items", F.col("first.h").alias("h"), F.col("first.offset").alias("offset"))
    )
    prefix = if_small(written(rarest, "rarest-shingles"))
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    candidates = places.join(prefix, ["size", "h"]).filter(fits).groupBy("id", "key").agg(
        F.collect_set(F.struct(start.alias("start"), "n", "window", "items")).alias("candidates")
    )
    met = texts.alias("d").join(candidates.alias("c"), F.expr("d.id <=> c.id AND d.key = c.key"), "left").select(
        "d.id", "d.key", words_of(F.col("d.text")).alias("w"), F.coalesce("candidates", F.array()).alias("candidates"))
    same = F.filter("candidates", lambda c: F.array_join(F.slice(F.col("w"), c["start"] + 1, c["n"]), " ") == c["window"])
    spans = F.array_sort(F.transform(same, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["items"].alias("items"))))
    verified = met.select("id", "key", F.size("w").alias("n_words"), spans.alias("spans"))
    return verified.withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["items"])))))


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Add n_hit, n_items and ``contaminated``: at least one word in ``share`` is hit."""
    hit = found.withColumn("n_hit", _covered(F.col("spans")).cast("long"))
    return hit.withColumn("n_words", F.col("n_words").cast("long")).withColumn("n_items", F.size("items").cast("long")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; its columns may have any name. Runs Spark jobs when called."""
    found = judged(find(docs, benchmark, window, shingle, id_col, text_col), share)
    bad = written(found.filter("contaminated").select("id", "key").distinct(), "contaminated")
    key = unused(docs, "key")
    keyed = docs.withColumn(key, F.coalesce(F.xxhash64(text_col), F.lit(0))).alias("d")
    return keyed.join(bad.alias("b"), F.expr(f"d.`{id_col}` <=> b.id AND d.`{key}` = b.key"), "left_anti").drop(key)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS t
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0
), starts AS (
  SELECT r, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS t
  FROM d, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - n + 2)) AS u(p)
), hits AS (
  SELECT r, p, s.n, item_id FROM starts s JOIN windows USING (n, t)
), covered AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + n)) AS u(q) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
