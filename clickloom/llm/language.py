"""Language identification as a mixture: the proportions of all languages in each document, by expectation-maximisation.

1. Features: texts are lower-cased, everything that isn't a letter becomes a space, and every three neighbouring
   characters (word ends included) are hashed to one of 2**BITS numbers.
2. Learning: Spark adds up, for each language, how often each number occurs in its training documents (counted in tasks
   batch by batch, so the hottest language is a few rows for each); smoothed shares are P(n-gram | language).
3. Inference: a document's n-grams are drawn from a mixture of languages. EM estimates its proportions, starting from all
   languages alike; the expectation shares each n-gram out among the languages, the maximisation adds the shares up.
4. Selection: a set of languages costs PENALTY * ln(n-grams) for each language. If even all languages together gain less
   over the best single one than a second language costs, the document has one language. Otherwise languages
   leave, the one with the smallest proportion first, EM refits after each, and the set of best penalised likelihood stays.
   The prediction is its language of largest proportion, the score that proportion.

The model has 2**BITS numbers for each language, whatever the corpus; more than MAX_LANGUAGES labels raise an error. Inference
needs no shuffle; documents are worked on in chunks of CHUNK n-grams, a longer document being a chunk of its own.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was learned;
rows without a label teach nothing; repeated rows teach repeatedly; equal proportions go to the smaller label in
code-point order; a null id counts as empty text when the fold is chosen; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import written

BITS = 16
SMOOTHING = 0.3
STEPS, SETTLED = 20, 1e-3
#: Cost of one more language in units of ln(n-grams). Three n-grams share a letter, so likelihoods count it three times.
PENALTY = 3.0
CHUNK = 1_000_000
MAX_LANGUAGES = 1000
UNKNOWN = "und"
SPACE = 32


@dataclass
class Model:
    languages: list[str]
    shares: np.ndarray  # P(n-gram | language), one row for each number


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all n-grams of the texts, and which text each belongs to. A text without letters has none."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    points = np.where(_is_letter()[points], points, SPACE).astype(np.uint64)
    # Of neighbouring spaces inside a text the first stays; texts keep a space at both ends.
    keep = np.r_[True, (points[1:] != SPACE) | (points[:-1] != SPACE) | (owner[1:] != owner[:-1])]
    points, owner = points[keep], owner[keep]
    a, b, c = points[:-2], points[1:-1], points[2:]
    whole = (owner[:-2] == owner[2:]) & (b != SPACE)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9) + c
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (mixed[whole] >> np.uint64(64 - BITS)).astype(np.int64), owner[1:-1][whole]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        own = len(t or "") + 2
        if total and total + own > CHUNK:
            yield start, i
            start, total = i, 0
        total += own
    if start < len(texts):
        yield start, len(texts)


def _tallied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, own in frame.groupby("lang")["text"]:
            texts = own.tolist()
            sums = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for start, end in _chunks(texts):
                sums += np.bincount(ngrams(texts[start:end])[0], minlength=1 << BITS)
        if len(counts) > 50:  # some dozens of tables of 2**BITS numbers at a time
            yield from map(_rows, counts.items())
            counts.clear()
    yield from map(_rows, counts.items())


def _rows(item: tuple[str, np.ndarray]) -> pd.DataFrame:
    at = np.flatnonzero(item[1])
    return pd.DataFrame({"lang": np.full(len(at), item[0], object), "ngram": at, "n": item[1][at]})


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``docs`` that have a label. Runs Spark jobs."""
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = labelled.mapInPandas(_tallied, "lang string, ngram bigint, n bigint").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-ngrams")
    languages = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different languages")
    table = np.zeros((1 << BITS, len(languages)))
    for k, lang in enumerate(languages):  # at most 2**BITS rows each
        own = counts.filter(F.col("lang") == lang).select("ngram", "n").toPandas()
        table[own["ngram"].to_numpy(), k] = own["n"].to_numpy()
    table += SMOOTHING
    return Model(languages, (table / table.sum(axis=0)).astype(np.float32))


def mixtures(p: np.ndarray, counts: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document by EM.

    p: P(n-gram | language) of each different n-gram of each document, counts: how often it occurs there, starts: the first
    n-gram of each document, allowed: per document and language.
    """
    sizes = np.diff(np.r_[starts, len(p)])
    totals = np.add.reduceat(counts, starts)
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(STEPS):
        joint = p * np.repeat(shares, sizes, axis=0)
        joint *= (counts / joint.sum(axis=1))[:, None]
        new = np.add.reduceat(joint, starts, axis=0) / totals[:, None]
        settled = np.abs(new - shares).max() < SETTLED
        shares = new
        if settled:
            break
    likely = np.log((p * np.repeat(shares, sizes, axis=0)).sum(axis=1))
    return shares, np.add.reduceat(counts * likely, starts)


def _some(starts: np.ndarray, total: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the chosen documents, and where each of them starts among those rows."""
    sizes = np.diff(np.r_[starts, total])[chosen]
    new = np.cumsum(sizes) - sizes
    return np.repeat(starts[chosen] - new, sizes) + np.arange(sizes.sum()), new


def proportions(model: Model, texts: list[str | None]) -> np.ndarray:
    """One row per text: the proportions of its languages, 0 for those not selected; all 0 without a letter."""
    out = np.zeros((len(texts), len(model.languages)))
    numbers, owner = ngrams(texts)
    if not len(numbers) or not model.languages:
        return out
    key, counts = np.unique(owner.astype(np.int64) << BITS | numbers, return_counts=True)
    counts = counts.astype(np.float64)
    who = key >> BITS
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    documents = who[starts]
    p = model.shares[key & ((1 << BITS) - 1)].astype(np.float64)
    n = np.add.reduceat(counts, starts)
    cost = PENALTY * np.log(n + 1)
    single = np.add.reduceat(np.log(p) * counts[:, None], starts, axis=0)
    shares = np.zeros((len(documents), len(model.languages)))
    shares[np.arange(len(documents)), single.argmax(axis=1)] = 1
    best = single.max(axis=1) - cost
    allowed = np.ones_like(shares)
    fitted, likely = mixtures(p, counts, starts, allowed)
    left = np.flatnonzero(likely - 2 * cost > best)  # no set of two or more can be better elsewhere
    fitted, allowed = fitted[left], allowed[left]
    while len(left):
        # A language with less than one n-gram goes with the others like it, else the smallest goes.
        weight = np.where(allowed > 0, fitted, np.inf)
        gone = (allowed > 0) & (fitted * n[left, None] < 1)
        none = ~gone.any(axis=1)
        gone[none, weight[none].argmin(axis=1)] = True
        allowed = np.where(gone, 0, allowed)
        many = allowed.sum(axis=1) > 1
        left, allowed = left[many], allowed[many]
        if not len(left):
            break
        rows, new = _some(starts, len(p), left)
        fitted, likely = mixtures(p[rows], counts[rows], new, allowed)
        worth = likely - allowed.sum(axis=1) * cost[left]
        better = worth > best[left]
        shares[left[better]], best[left[better]] = fitted[better], worth[better]
    out[documents] = shares
    return out


def _predicted(model: Model):
    names = np.array([*model.languages, UNKNOWN], object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for start, end in _chunks(texts):
                mix = proportions(model, texts[start:end])
                known = mix.sum(axis=1) > 0
                top = np.where(known, mix.argmax(axis=1) if mix.shape[1] else 0, len(model.languages))
                score = np.where(known, mix.max(axis=1, initial=0), 0.0)
                yield pd.DataFrame({
                    "id": frame["id"].iloc[start:end].to_numpy(), "held_out": frame["held_out"].iloc[start:end].to_numpy(),
                    "lang": names[top], "score": np.clip(score, 0, 1),
                    "languages": [[{"lang": names[k], "share": float(row[k])} for k in np.flatnonzero(row)] for row in mix],
                })
    return run


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def predict(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang (the prediction), score and languages (lang, share: the selected mixture) of each document."""
    keyed = docs.select(F.col(id_col).alias("id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInPandas(
        _predicted(model), f"id {kind}, held_out boolean, lang string, score double, languages array<struct<lang:string,share:double>>")
