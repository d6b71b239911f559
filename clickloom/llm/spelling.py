"""Spelling variants by dense prefix-suffix tiling: frequent words, their near words, and the form each one stands for.

1. Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. They are counted in a dictionary
   per batch of texts, then by Spark; a word that is a third of all words is one row per batch before it moves.
2. Two words are near if one inserted, deleted or replaced code point tells them apart. For lengths m <= n <= m + 1 that is
   so exactly if their common prefix and common suffix together reach n - 1.
3. Blocks: the position of that edit lies in one of PARTS parts of the shorter word, and outside of that part both words
   are equal. So each word goes, as the shorter (m = its length) and as the longer (m = its length - 1), to one bucket
   for each part, named by what lies outside of it. Two near words share the bucket of their edit's part; a pair is
   counted there and in no other. Nothing is compared that differs outside of one part.
4. Tiles: a bucket of more than TILE words is dealt by hash into tiles, and every pair of tiles is a block of its own, so
   no task holds more than two tiles of a bucket, however many words share it. In a task, the words of some blocks form a
   padded matrix of code points (and one of the reversed words); whole columns of pairs are compared at once, and the first
   unequal column gives the prefix and the suffix. CELLS bounds the matrices. No bucket is capped or skipped.
5. Only a count and the best partner per word leave a task; they are added up by word. Chains of forms are followed by
   doubling: each round joins the forms with themselves, so a chain of k steps takes log2(k) rounds.

Defined cases: null and empty texts have no words; a null id counts as an empty id; repeated rows count repeatedly; of near
words with equal counts the smallest in code-point order is the form; an empty table gives an empty result; a run of any
length is a word. Other columns of the table are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import written

PARTS = 4
TILE = 256
#: Code points of one padded matrix, and pairs compared at once times their width.
CELLS = 4_000_000
#: Different words a task holds before it hands their counts on.
HELD_WORDS = 200_000


def _typo(id_: str, word: bytes, every: int) -> bytes:
    """The word without one letter if the hash of id and word is divisible by ``every``."""
    utf8 = word if word.isascii() else word.decode("latin-1").encode()
    h = zlib.crc32(utf8, zlib.crc32(id_.encode() + b":"))
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _counted(least: int, typo_every: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)
        counts: Counter[bytes] = Counter()

        def held() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("latin-1") for w in counts], "n": list(counts.values())}).astype({"n": "int64"})

        for frame in frames:
            for id_, text in zip(frame["id"], frame["text"]):
                # One byte for each code point; bytes.lower knows A-Z only, and what is no Latin letter becomes a question mark.
                for word, n in Counter(runs.findall((text or "").encode("latin-1", "replace").lower())).items():
                    counts[_typo(id_, word, typo_every) if typo_every else word] += n
                if len(counts) >= HELD_WORDS:
                    yield held()
                    counts.clear()
        if counts:
            yield held()
    return run


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
    typo_every: int | None = None,
) -> DataFrame:
    """(word, n) of the words with at least ``min_length`` code points and ``min_count`` occurrences.

    ``typo_every``: leave one letter out of a document's word where the hash of both is divisible by it.
    """
    keyed = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counts = keyed.mapInPandas(_counted(min_length, typo_every), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= min_count) & (F.length("word") >= min_length))


def part_bounds(m: int) -> list[int]:
    """Where the parts of the positions 0 to m of an edit begin, and their end."""
    return [j * (m + 1) // PARTS for j in range(PARTS + 1)]


def _matrix(words: list[str]) -> np.ndarray:
    """One row of code points for each word, filled with zeros."""
    wide = np.array(words)
    return wide.view(np.uint32).reshape(len(words), -1) if wide.itemsize else np.zeros((len(words), 1), np.uint32)


def _first_unequal(matrix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of rows the first column that differs; words that differ do so in some column."""
    step, out = max(1, CELLS // matrix.shape[1]), np.empty(len(i), np.int64)
    for at in range(0, len(i), step):
        out[at:at + step] = (matrix[i[at:at + step]] != matrix[j[at:at + step]]).argmax(axis=1)
    return out


def near_pairs(words: list[str], sizes: np.ndarray, m: np.ndarray, part: np.ndarray, tile: np.ndarray, split: np.ndarray):
    """Index pairs of near words inside blocks. ``sizes``, ``m``, ``part`` and ``split`` (two different tiles) are per block."""
    block = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rest = sizes[block] - 1 - place
    i = np.repeat(np.arange(len(words)), rest)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(rest) - rest, rest)
    length, of = np.array([len(w) for w in words]), block[i]
    fit = (np.minimum(length[i], length[j]) == m[of]) & (~split[of] | (tile[i] != tile[j]))
    i, j, of = i[fit], j[fit], of[fit]
    prefix = _first_unequal(_matrix(words), i, j)
    bounds = {k: part_bounds(k) for k in set(m.tolist())}
    low = np.array([bounds[k][p] for k, p in zip(m.tolist(), part.tolist())])
    high = np.array([bounds[k][p + 1] for k, p in zip(m.tolist(), part.tolist())])
    here = (prefix >= low[of]) & (prefix < high[of])  # elsewhere the pair belongs to the bucket of another part
    i, j, prefix = i[here], j[here], prefix[here]
    suffix = _first_unequal(_matrix([w[::-1] for w in words]), i, j)
    near = prefix + suffix >= np.maximum(length[i], length[j]) - 1
    return i[near], j[near]


def _best(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict:
    """For each word of a pair: its near words, counted, and the one with the largest count (ties: the smallest)."""
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    return {
        "word": [words[k] for k in a[first]], "n_near": np.diff(np.r_[first, len(a)]),
        "best_n": n[b[first]], "best": [words[k] for k in b[first]],
    }


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    for batch in batches:
        # Words of like length share a matrix.
        batch = batch.take(pa.array(np.argsort(batch.column("m").to_numpy(), kind="stable")))
        m, part = batch.column("m").to_numpy(), batch.column("part").to_numpy()
        split = batch.column("low").to_numpy() != batch.column("high").to_numpy()
        sizes = np.array([len(x) for x in batch.column("members")], np.int64)
        start = 0
        while start < len(m):
            end, held, pairs = start, 0, 0
            while end < len(m) and (end == start or (held + sizes[end]) * (m[end] + 1) <= CELLS and pairs + sizes[end] ** 2 <= CELLS):
                held, pairs, end = held + sizes[end], pairs + sizes[end] ** 2, end + 1
            flat = batch.column("members").slice(start, end - start).flatten()
            words, n, tile = flat.field("word").to_pylist(), flat.field("n").to_numpy(), flat.field("tile").to_numpy()
            i, j = near_pairs(words, sizes[start:end], m[start:end], part[start:end], tile, split[start:end])
            yield pa.RecordBatch.from_pydict(_best(words, n, i, j), schema=schema)
            start = end


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best, best_n) for the words that have a near word: how many, and the one of largest n."""
    buckets = []
    for longer in (0, 1):
        m = F.length("word") - longer
        for p in range(PARTS):
            low, high = (F.floor((m + 1) * F.lit(k) / PARTS).cast("int") for k in (p, p + 1))
            outside = F.struct(F.substring("word", F.lit(1), low), F.right("word", F.greatest(m - high, F.lit(0))))
            buckets.append(F.struct(m.alias("m"), F.lit(p).alias("part"), F.xxhash64(outside).alias("outside")))
    placed = words.select("word", "n", F.explode(F.array(*buckets)).alias("b")).select("word", "n", "b.*")
    key = ["m", "part", "outside"]
    sizes = placed.groupBy(key).agg(F.count("*").alias("c"), F.min(F.length("word")).alias("shortest"))
    sizes = sizes.filter((F.col("c") > 1) & (F.col("shortest") == F.col("m"))).select(*key, F.ceil(F.col("c") / tile).cast("int").alias("tiles"))
    dealt = placed.join(sizes, key).withColumn("tile", F.pmod(F.xxhash64("word", F.lit("tile")), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    blocks = dealt.groupBy(*key, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")).agg(
        F.collect_list(F.struct("word", "n", "tile")).alias("members"))
    found = blocks.filter(F.size("members") > 1).mapInArrow(_compared, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form: no cycles): the end of each chain. Runs Spark jobs when called."""
    hops = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("to"))
        moved = written(
            hops.join(further, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("went_on")), "forms")
        hops = moved.drop("went_on")
        if moved.filter("went_on").isEmpty():
            return hops


def variants(words: DataFrame, ratio: int = 5, tile: int = TILE) -> DataFrame:
    """Every word of ``words`` (word, n) with form, root, n_near and form_n: its form is the near word of largest n if that
    is at least ``ratio`` times the word's own. Runs Spark jobs when called."""
    words = written(words, "words")
    found = words.join(near_words(words, tile), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = written(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ), "variants")
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
