"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(part | class, context) * P(word | part).

* Words are cut once. A word is a token of 64 bits, its hash with its shape in the lowest four; the documents' tokens are
  written, and all later steps read them as arrays.
* Counts. Every word of the training texts is counted; the table grows with the corpus.
* Classes. The ``top`` most frequent words are clustered by the frequent words beside them into CLUSTERS classes; all
  others, known or not, belong to one of SHAPES classes by their letters and ending; the text's end is a class of its own.
  Each class has PARTS parts: the words of a cluster are dealt by rank, the others by hash, so that frequent words have a
  part to themselves. P(word | part) are smoothed counts; each part of a shape class keeps one share for unknown words.
* Context features. For the class: the word before, and as symbols (a frequent word is its own, others share that of their
  shape) the one before, the one before that, and the pair before. For the part: the class with the word before, and the class with
  the pair of symbols before. Features are hashed into 2**bits rows of weights for classes and as many for parts. ``bits`` follows from the number of
  different words counted (a row for ``WORDS_PER_ROW``), so what is learned of contexts grows with the corpus, up to
  MAX_BITS, where weights of 64 MB are sent to each task.
* Training: in each round every task of the training corpus starts from the common weights, takes AdaGrad steps over
  batches of its tokens, and sends the rows it touched as fixed-point numbers, in blocks; the new common weights are the
  averages, by tokens, of each row, exact sums in any order. There are as many tasks as give each TOKENS_PER_ROW tokens
  for a row of weights, so what they send grows with the tokens, not with tasks times rows.
* Scoring: sparse batches in numpy. Weights and the counts of the most frequent words (``head``: at most ``head_words``,
  chosen by a threshold on the count) are at hand in every task. The other words of a document meet the table of counts
  in a join; being rare, none of them is a hot key.

No row is sampled (``head_words`` only chooses between broadcast and join; ``top`` only which words are clustered).

Defined cases: a null or empty text has the end token only; a null id is the empty string for the split; equal rows get
equal scores each; without any training document all scores are 0 (one unknown token, of probability 1). Columns other
than id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import written

SHAPES, CLUSTERS, PARTS = 14, 17, 32
CLASSES = 1 + CLUSTERS + SHAPES  # as many as PARTS: both kinds of rows are equally wide
MIN_BITS, MAX_BITS, WORDS_PER_ROW = 14, 18, 64
STEP, BATCH, SLICE = 0.5, 4096, 400_000
TOP, HEAD = 1000, 500_000
KNOWN_WORDS = 200_000
#: A task of the training sees so many tokens for each row of weights, so what tasks send follows the tokens.
TOKENS_PER_ROW, BLOCK_BITS = 16, 8
#: Weights are sent as whole numbers of this part of one.
UNIT = 1 / 1024
#: Stands before a text, and for its end; no word has these lowest bits.
BEFORE, END = np.int64(15), np.int64(14)
_ASCII = bytes(range(128))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def words_of(text: str | bytes | None) -> list[bytes]:
    """ASCII letters lowered, cut at ASCII white space."""
    return (text.encode("utf-8", "replace") if isinstance(text, str) else text or b"").lower().split()


def shape(word: bytes) -> int:
    """Which letters beyond ASCII it has first (8 kinds), else how it ends (digit, sign, or 4 kinds of letters)."""
    foreign = word.translate(None, _ASCII)
    if len(foreign) > 1:
        return (foreign[1] >> 2) & 7
    last = word[-1]
    if 48 <= last <= 57:
        return 8
    return 10 + (last & 3) if 97 <= last <= 122 else 9


class Tokens(dict):
    """Word to token: hash and shape in 64 bits, signed. Remembers up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        token = xxhash.xxh3_64_intdigest(word) & ~15 | shape(word)
        self[word] = token = token - (1 << 64) if token >> 63 else token
        return token

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), pa.array(values))


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            some = batch.slice(first, 500)
            cut = [tokens.of(words_of(t)) for t in some.column("text").cast(pa.binary()).to_pylist()]
            lists = _lists(np.concatenate(cut), np.array([len(c) for c in cut]))
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("train"), lists], names=["id", "train", "words"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with about SLICE words together (or one longer document), their words, and how many each has."""
    for batch in batches:
        ends = batch.column("words").offsets.to_numpy().astype(np.int64)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1)
            yield batch.slice(first, last - first), batch.column("words").values.to_numpy()[ends[first]:ends[last]], np.diff(ends[first:last + 1])
            first = last


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, words, _ in _slices(batches):
        h, c = np.unique(words, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])


def _place(sorted_words: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word is, and whether it is."""
    if not len(sorted_words):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    return at, sorted_words[at] == words


def _pairs(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, lengths in _slices(batches):
            at, known = _place(frequent, words)
            both = known[:-1] & known[1:]
            ends = np.cumsum(lengths)
            both[ends[(ends > 0) & (ends < len(words))] - 1] = False  # of two documents
            pair, n = np.unique(at[:-1][both] * len(frequent) + at[1:][both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
    return run


def clusters(pairs: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """A cluster for each frequent word, from counts of neighbouring pairs: k-means on projected neighbour profiles."""
    if top <= CLUSTERS:
        return np.arange(top)
    beside = np.zeros((top, top))
    beside[pairs // top, pairs % top] = counts
    profile = np.concatenate([beside, beside.T], axis=1)
    profile = np.sqrt(profile / np.maximum(profile.sum(axis=1, keepdims=True), 1))
    draw = np.random.default_rng(0)
    basis, _ = np.linalg.qr(profile @ (profile.T @ draw.standard_normal((top, 24))))
    points = basis.T @ profile  # 24 x 2 top
    points = profile @ np.linalg.qr(points.T)[0]
    centers = [points[0]]
    for _ in range(CLUSTERS - 1):  # farthest first
        away = np.min([((points - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(points[int(np.argmax(away))])
    centers = np.array(centers)
    for _ in range(30):
        of = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array([points[of == k].mean(axis=0) if (of == k).any() else centers[k] for k in range(CLUSTERS)])
    return of


@dataclass
class Classes:
    """The frequent words (sorted tokens) with their classes and parts, and the bits of a feature's row."""

    frequent: np.ndarray
    class_of: np.ndarray
    part_of: np.ndarray
    bits: int

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, class and part of each word."""
        at, known = _place(self.frequent, words)
        kind = np.where(known, self.class_of[at] if len(self.frequent) else 0, 1 + CLUSTERS + (words & 15))
        part = np.where(known, self.part_of[at] if len(self.frequent) else 0, (words >> 4) & (PARTS - 1))
        return np.where(known, 16 + at, words & 15), kind, part

    def rows(self, one: np.ndarray, near: np.ndarray, far: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the class features (n x 4) and of the part features (n x 2), from the word before, the two symbols
        before and the class of each token."""
        a, b, c, d, e = _ODD
        one, near, far = one.view(np.uint64), near.view(np.uint64) + np.uint64(1), far.view(np.uint64) + np.uint64(1)
        pair, with_class = near * b ^ far * c, (kind.astype(np.uint64) + np.uint64(1)) * d
        mixed = np.stack([one, near * e, far * d, pair, one * b ^ with_class, pair * e ^ with_class], axis=1)
        mixed ^= mixed >> np.uint64(32)
        found = ((mixed * a) >> np.uint64(64 - self.bits)).astype(np.int32)
        return found[:, :4], found[:, 4:] + np.int32(1 << self.bits)


def _laid_out(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, two starts before and the end after each; the places of the tokens; which are ends."""
    tokens = lengths + 1
    stop = np.cumsum(tokens)
    at = np.arange(stop[-1]) + 2 * np.repeat(np.arange(1, len(lengths) + 1), tokens)
    is_end = np.zeros(len(at), bool)
    is_end[stop - 1] = True
    flat = np.full(len(at) + 2 * len(lengths), BEFORE)
    flat[at[~is_end]], flat[at[is_end]] = words, END
    return flat, at, is_end


def _batches(classes: Classes, words: np.ndarray, lengths: np.ndarray):
    """Rows of class and part features, classes and parts of BATCH tokens at a time."""
    flat, places, is_end = _laid_out(words, lengths)
    symbols, kinds, parts = classes.of(flat)
    kinds[places[is_end]], parts[places[is_end]] = 0, 0
    for a in range(0, len(places), BATCH):
        at = places[a:a + BATCH]
        yield (*classes.rows(flat[at - 1], symbols[at - 1], symbols[at - 2], kinds[at]), kinds[at], parts[at])


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Softmax of the bias (one for all or one for each token) and the summed weights of the rows of each token. One
    more row, of zeros, stands below."""
    p = np.zeros((len(rows) + 1, PARTS), weights.dtype)
    z, more = p[:-1], np.empty((len(rows), PARTS), weights.dtype)
    np.add(weights.take(rows[:, 0], axis=0), bias, out=z)
    for k in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, k], axis=0, out=more, mode="clip")
    np.minimum(z, 80, out=z)  # as a float, e**80 is still finite
    np.exp(z, out=z)
    z *= (1 / np.maximum(z @ np.ones(PARTS, z.dtype), np.float32(1e-30)))[:, None]
    return p


def _sums(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the first ``n[0]`` of the rows ``at`` of ``values``, of the ``n[1]`` after them, and so on. Rows are added
    in fours, level by level; the last row of ``values`` is of zeros and fills up."""
    while len(at) > len(n):
        fours = (n + 3) // 4
        first = np.repeat(np.cumsum(n) - n - 4 * (np.cumsum(fours) - fours), fours) + 4 * np.arange(fours.sum())
        end, padded = np.repeat(np.cumsum(n), fours), np.append(at, [len(values) - 1] * 3)
        added = np.zeros((len(first) + 1, values.shape[1]), values.dtype)
        for k in range(4):
            added[:-1] += values.take(np.where(first + k < end, padded[first + k], len(values) - 1), axis=0)
        values, at, n = added, np.arange(len(first)), fours
    return values.take(at, axis=0)


def _step(weights: np.ndarray, squares: np.ndarray, seen: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step over a batch."""
    slope, width = probabilities(weights, bias, rows), rows.shape[1]
    slope[np.arange(len(target)), target] -= 1
    packed = np.sort(rows.ravel().astype(np.int64) << 32 | np.arange(rows.size))  # by row, then by token
    touched, order = packed >> 32, (packed & 0xFFFFFFFF) // width
    begin = np.flatnonzero(np.append(True, touched[1:] != touched[:-1]))
    at, n = touched[begin], np.diff(np.append(begin, len(touched)))
    sums = slope.take(order[begin], axis=0)
    often = n > 1  # most rows occur once in a batch
    sums[often] = _sums(slope, order[np.repeat(often, n)], n[often])
    squares[at] += np.einsum("ij,ij->i", sums, sums)
    seen[at] += n
    sums *= (-STEP / np.sqrt(squares[at]))[:, None]
    sums += weights.take(at, axis=0)
    whole = np.dtype((np.void, weights.itemsize * PARTS))  # a row as one item is faster to put
    weights.view(whole).ravel()[at] = sums.view(whole).ravel()


def _trained(classes: Classes, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, bias, part_bias = shared.value
        weights = start.copy()
        squares, seen = np.full(len(weights), 1e-6, np.float32), np.zeros(len(weights), np.int64)
        for _, words, lengths in _slices(batches):
            for rows, part_rows, kind, part in _batches(classes, words, lengths):
                _step(weights, squares, seen, bias, rows, kind)
                _step(weights, squares, seen, part_bias.take(kind, axis=0), part_rows, part)
        used = np.flatnonzero(seen)
        block = used >> BLOCK_BITS
        begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(used) else used
        size = np.diff(np.append(begin, len(used)))
        for some in np.array_split(np.arange(len(begin)), 1 + len(begin) // 64) if len(begin) else ():
            rows = used[begin[some[0]]:begin[some[-1]] + size[some[-1]]]
            fixed = np.clip(np.rint(weights[rows] / UNIT), -32767, 32767).astype(np.int16)
            lists = [_lists(rows.astype(np.int32), size[some]), _lists(seen[rows], size[some]), _lists(fixed.ravel(), size[some] * PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(block[begin[some]].astype(np.int32)), *lists], names=["block", "row", "n", "w"])
    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Averages, by tokens, of the rows of whole blocks: exact sums of whole numbers, in any order."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            block, rows, n, w = (batch.column(c)[k] for c in ("block", "row", "n", "w"))
            at = rows.values.to_numpy() & ((1 << BLOCK_BITS) - 1)
            total, seen = sums.setdefault(block.as_py(), (np.zeros((1 << BLOCK_BITS, PARTS), np.int64), np.zeros(1 << BLOCK_BITS, np.int64)))
            n = n.values.to_numpy()
            total[at] += n[:, None] * w.values.to_numpy().reshape(-1, PARTS)
            seen[at] += n
    for block, (total, seen) in sums.items():
        at = np.flatnonzero(seen)
        mean = (total[at] / seen[at][:, None]).astype(np.float32)
        rows = pa.array((at + (block << BLOCK_BITS)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([rows, _lists(mean.ravel(), np.full(len(at), PARTS))], names=["row", "w"])


@dataclass
class Model:
    classes: Classes
    weights: np.ndarray  # rows of classes, then rows of parts
    bias: np.ndarray
    part_bias: np.ndarray
    part_total: np.ndarray  # what P(word | part) is divided by, for each class and part
    head: tuple[np.ndarray, np.ndarray]  # sorted tokens and counts
    tokens: int
    distinct: int
    ends: int
    tail: DataFrame | None  # h, c of the words that aren't in the head


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, train (not held out), words (tokens) of every document, written. Runs a Spark job."""
    rows = docs.select(F.col(id_col).alias("id"), (~is_held_out(F.col(id_col))).alias("train"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(_tokenized, f"id {kind}, train boolean, words array<bigint>"), "tokens")


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, top: int = TOP, head_words: int = HEAD,
    bits: int | None = None, cut: DataFrame | None = None,
) -> Model:
    """Learn from the documents that aren't held out. ``cut`` is ``tokenized(docs)``, if at hand. Runs Spark jobs."""
    spark = docs.sparkSession
    train = (tokenized(docs, id_col, text_col) if cut is None else cut).filter("train").select("words")
    counts = train.mapInArrow(_counted, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    counts = written(counts, "word-counts")
    ends = train.count()
    # How many words have each count: at most sqrt(2 * tokens) rows, here only as thresholds.
    often = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(head_words + 1).collect()
    words, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    tokens, distinct = tokens + ends, words + (1 if ends else 0)
    if bits is None:
        bits = min(max((distinct // WORDS_PER_ROW).bit_length(), MIN_BITS), MAX_BITS)

    def threshold(most: int) -> int:
        total, last = 0, math.inf
        for r in often:
            total += r["n"]
            if total > most:
                break
            last = r["c"]
        return last if last < math.inf else (often[0]["c"] + 1 if often else 1)

    least, frequent_from = threshold(head_words), max(threshold(min(top, head_words)), 2)
    head = counts.filter(F.col("c") >= least).orderBy("h").toArrow()  # head_words rows at most
    head = (head.column("h").to_numpy(), head.column("c").to_numpy())
    often_seen = head[1] >= frequent_from
    frequent, count_of = head[0][often_seen], head[1][often_seen]
    pairs = train.mapInArrow(_pairs(frequent), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # top**2 rows at most
    of = clusters(pairs.column("pair").to_numpy(), pairs.column("n").to_numpy(), len(frequent))
    class_of, part_of = (1 + of).astype(np.int64), np.zeros(len(frequent), np.int64)
    for k in np.unique(class_of):
        members = np.flatnonzero(class_of == k)
        part_of[members[np.lexsort((frequent[members], -count_of[members]))]] = np.arange(len(members)) % PARTS
    classes = Classes(frequent, class_of, part_of, bits)

    seen, kinds = np.zeros((CLASSES, PARTS)), np.zeros((CLASSES, PARTS))
    np.add.at(seen, (class_of, part_of), count_of)
    np.add.at(kinds, (class_of, part_of), 1)
    shape_of, part = F.col("h").bitwiseAND(F.lit(15)), F.shiftright("h", 4).bitwiseAND(F.lit(PARTS - 1))
    rare = counts.filter(F.col("c") < frequent_from).groupBy(shape_of.alias("shape"), part.alias("part"))
    for r in rare.agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # SHAPES * PARTS rows at most
        seen[1 + CLUSTERS + r["shape"], r["part"]], kinds[1 + CLUSTERS + r["shape"], r["part"]] = r["c"], r["n"]
    kinds[1 + CLUSTERS:] += 1  # the unknown words
    seen[0, 0], kinds[0, 0] = ends, 1
    total = seen + kinds
    of_class = seen.sum(axis=1) + 1
    bias = np.log(of_class / of_class.sum()).astype(np.float32)
    part_bias = np.where(total > 0, np.log(np.maximum(total, 1) / np.maximum(total.sum(axis=1, keepdims=True), 1)), -1e4).astype(np.float32)

    weights = np.zeros((2 << bits, PARTS), np.float32)
    tasks = max(1, tokens // (TOKENS_PER_ROW * len(weights)))
    for _ in range(rounds if ends else 0):
        sent = spark.sparkContext.broadcast((weights, bias, part_bias))
        learned = train.coalesce(tasks).mapInArrow(_trained(classes, sent), "block int, row array<int>, n array<bigint>, w array<smallint>")
        got = learned.repartition("block").mapInArrow(_averaged, "row int, w array<float>").toArrow().combine_chunks()  # 2 * 2**bits rows at most
        weights = weights.copy()
        if len(got):
            new = got.column("w").combine_chunks().values.to_numpy().reshape(-1, PARTS)
            weights[got.column("row").to_numpy()] = new * np.float32(UNIT)
    tail = written(counts.filter(F.col("c") < least).select("h", "c"), "tail-counts")
    return Model(classes, weights, bias, part_bias, total, head, tokens, distinct, ends, tail)


def _scored(classes: Classes, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(classes, *shared.value, None)
        head, count = m.head
        log_count, unit = np.log10(count + 1.0), math.log10(m.ends + 1)
        base_total, inside = math.log10(m.tokens + m.distinct + 1), np.log10(np.maximum(m.part_total, 1))
        for some, words, lengths in _slices(batches):
            found = []
            for rows, part_rows, kind, part in _batches(classes, words, lengths):
                every = np.arange(len(kind))
                p = probabilities(m.weights, m.bias, rows)[every, kind].astype(float)
                p *= probabilities(m.weights, m.part_bias.take(kind, axis=0), part_rows)[every, part]
                found.append(np.log10(np.maximum(p, 1e-30)) - inside[kind, part])
            tokens = lengths + 1
            begin, ends = np.cumsum(tokens) - tokens, np.cumsum(tokens) - 1
            at, known = _place(head, words)
            common, there = np.full(int(tokens.sum()), unit), np.full(int(tokens.sum()), 1, np.int64)
            is_word = np.ones(len(common), bool)
            is_word[ends] = False
            if len(head):
                common[is_word] = np.where(known, log_count[at], 0.0)  # counts: shared by both scores
            else:
                common[is_word] = 0.0
            there[is_word] = known
            away = np.zeros(len(common), np.int64)
            away[is_word] = ~known
            columns = {
                "id": some.column("id"), "train": some.column("train"), "known": pa.array(np.add.reduceat(there, begin)),
                "common": pa.array(np.add.reduceat(common, begin)), "model": pa.array(np.add.reduceat(np.concatenate(found), begin)),
                "tail": _lists(words[~known], np.add.reduceat(away, begin)), "n": pa.array(tokens), "base": pa.array(-tokens * base_total),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def score(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: DataFrame | None = None) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). ``cut`` as in ``fit``.
    Runs Spark jobs."""
    spark = docs.sparkSession
    if not model.ends:
        count = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
        return docs.select(
            F.col(id_col).alias("id"), is_held_out(F.col(id_col)).alias("held_out"), count.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
            F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"),
        )
    m = model
    shared = spark.sparkContext.broadcast((m.weights, m.bias, m.part_bias, m.part_total, m.head, m.tokens, m.distinct, m.ends))
    words = tokenized(docs, id_col, text_col) if cut is None else cut
    kind = words.schema["id"].dataType.simpleString()
    schema = f"id {kind}, train boolean, known bigint, common double, model double, tail array<bigint>, n bigint, base double"
    found = written(words.mapInArrow(_scored(model.classes, shared), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = found.select("row", F.explode("tail").alias("h"))
    met = rest.join(model.tail, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("less_common"))
    full = found.drop("tail").join(met, "row", "left")
    common = F.col("common") + F.coalesce("less_common", F.lit(0.0))
    return full.select(
        "id", (~F.col("train")).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (common + F.col("base")).alias("base_score"), (common + F.col("model")).alias("score"),
    )
