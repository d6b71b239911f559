"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on posterior labels.

1. Marks. A mark is a word, or a stem: the first 3 to 6 letters of a longer word. On a bounded sample of labelled
   documents (``max_labelled``), every mark that at least MIN_TOXIC toxic ones hold (a twentieth of them in a sample with
   few, 2 at least) and that is MIN_RATIO times as frequent in them as in clean ones is in the lexicon.
2. Voters. The lexicon is dealt out to several word voters and stem voters, which vote "toxic" or abstain; pattern voters
   look at shouting, runs of exclamation marks, symbol noise and length. A label, where there is one, is one more voter.
3. Label model. Every training document votes; only the counts of the different vote patterns reach the driver (at most
   3**voters, whatever the number of documents). EM estimates the class prior and each voter's accuracy; voters that
   depend on each other beyond the class are linked to a tree by their conditional mutual information, and EM goes on
   with P(vote | vote of the linked voter, class), so that doubled evidence is not counted twice.
4. Classifier. Logistic regression (pyspark.ml) on marks and patterns, with posteriors as soft labels: of the labelled sample,
   and of unlabelled documents, ``max_unlabelled`` by the hash of their text from those with a mark and as many from those
   without. Each of the two stands for its whole stratum, and all unlabelled documents together weigh as much as the labelled.

Fitting is bounded by ``max_labelled`` and ``max_unlabelled``; vote patterns are counted over all training documents. Words are
read from whole texts: ASCII letters are lowered, runs of letters, digits and non-ASCII characters count as words.

Defined cases: null and empty texts have no marks and get the score of a text without marks; labels that are null are
left out, repeated labels of a document count as toxic if one is; without toxic or without clean labels in the sample,
every document gets the smoothed share of toxic labels; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import written

MAX_LABELLED, MAX_UNLABELLED = 20_000, 10_000
MIN_TOXIC, MIN_RATIO = 4, 20.0
WORD_VOTERS, STEM_VOTERS = 4, 4
STEMS = (3, 4, 5, 6)
PATTERNS = 4
VOTERS = WORD_VOTERS + STEM_VOTERS + PATTERNS
EM_STEPS = 200
#: Byte table for bytes.translate: A-Z lowered, other ASCII letters and digits kept, the rest of ASCII to a space.
_TABLE = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else (i if i >= 128 else 32) for i in range(256))


def marks_in(text: str | None) -> tuple[set[bytes], list[set[str]]]:
    """The different words of a text (as bytes), and for each stem length the stems of longer words."""
    words = set((text or "").encode("utf-8", "replace").translate(_TABLE).split())
    letters = [w.decode("utf-8", "replace") for w in words]
    return words, [{w[:k] for w in letters if len(w) > k} for k in STEMS]


def all_marks(text: str | None) -> set[str]:
    words, stems = marks_in(text)
    return {w.decode("utf-8", "replace") for w in words}.union(*({s + "*" for s in some} for some in stems))


@dataclass
class Lexicon:
    """Marks in order of weight; ``stem*`` is a stem. ``words`` and ``stems`` look them up."""

    marks: list[str]
    words: dict[bytes, int] = field(default_factory=dict)
    stems: list[dict[str, int]] = field(default_factory=list)

    def __post_init__(self):
        self.words = {m.encode(): i for i, m in enumerate(self.marks) if not m.endswith("*")}
        self.stems = [{m[:-1]: i for i, m in enumerate(self.marks) if m.endswith("*") and len(m) == k + 1} for k in STEMS]

    def found(self, text: str | None) -> list[int]:
        words, stems = marks_in(text)
        hits = [self.words[w] for w in words & self.words.keys()]
        for known, some in zip(self.stems, stems):
            hits += [known[s] for s in some & known.keys()]
        return sorted(hits)

    def votes(self, hits: list[int], patterns: list[int]) -> list[int]:
        """-1 (clean), 0 (abstains) or 1 (toxic) for each voter."""
        votes = [0] * (WORD_VOTERS + STEM_VOTERS)
        for i in hits:
            stem = self.marks[i].endswith("*")
            votes[WORD_VOTERS + zlib.crc32(self.marks[i].encode()) % STEM_VOTERS if stem else zlib.crc32(self.marks[i].encode()) % WORD_VOTERS] = 1
        return votes + patterns


def pattern_votes(text: str | None) -> list[int]:
    """Shouting, exclamations and symbol noise may vote either way (EM finds out which); so may very short texts."""
    raw = (text or "").encode("utf-8", "replace")
    upper, lower = (len(raw) - len(raw.translate(None, letters)) for letters in (_UPPER, _LOWER))
    symbols = sum(map(raw.count, (b"#", b"$", b"%", b"&", b"*")))
    return [int(upper > lower), int(raw.count(b"!!") > 2), -int(20 * symbols > len(raw)), -int(len(raw) < 40)]


_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _toxic_marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        count = Counter()
        for text in frame["text"]:
            count.update(all_marks(text))
        if count:
            yield pd.DataFrame({"mark": list(count), "n": list(count.values())})


def _clean_marks(known: frozenset[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            count = Counter()
            for text in frame["text"]:
                count.update(all_marks(text) & known)
            if count:
                yield pd.DataFrame({"mark": list(count), "n": list(count.values())})
    return run


def mined(sample: DataFrame, toxic: int, clean: int) -> list[str]:
    """The marks of the lexicon, from the labelled sample (text, toxic); bounded by the sample."""
    schema = "mark string, n bigint"
    marks = sample.filter("toxic = 1").select("text").mapInPandas(_toxic_marks, schema).groupBy("mark").agg(F.sum("n").alias("n"))
    hot = {r[0]: r[1] for r in marks.filter(F.col("n") >= min(MIN_TOXIC, max(2, toxic // 20))).collect()}
    counted = sample.filter("toxic = 0").select("text").mapInPandas(_clean_marks(frozenset(hot)), schema)
    cold = {r[0]: r[1] for r in counted.groupBy("mark").agg(F.sum("n").alias("n")).collect()}
    return sorted(m for m, n in hot.items() if ((n + 0.5) / (toxic + 1)) / ((cold.get(m, 0) + 0.5) / (clean + 1)) >= MIN_RATIO)


def _voted(lexicon: Lexicon):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hits = [lexicon.found(t) for t in frame["text"]]
            votes = [bytes(v + 1 for v in lexicon.votes(h, pattern_votes(t))) for h, t in zip(hits, frame["text"])]
            order = [zlib.crc32((t or "").encode("utf-8", "replace")) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "votes": votes, "hits": hits, "order": order})
    return run


class LabelModel:
    """P(class) and P(vote | parent's vote, class); a voter without a parent has itself as parent, with one vote value."""

    def __init__(self, votes: np.ndarray, count: np.ndarray, start: np.ndarray):
        self.parent = [-1] * votes.shape[1]
        self.fit(votes, count, start)
        self.parent = self._tree(votes, count, self.posterior(votes))
        self.fit(votes, count, self.posterior(votes))

    def fit(self, votes: np.ndarray, count: np.ndarray, q: np.ndarray) -> None:
        for _ in range(EM_STEPS):
            weight = np.stack([count * (1 - q), count * q])
            self.prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
            self.tables = []
            for j, p in enumerate(self.parent):
                table = np.full((2, 3, 3), 0.1)
                for y in range(2):
                    np.add.at(table[y], (votes[:, p] if p >= 0 else np.zeros(len(votes), int), votes[:, j]), weight[y])
                self.tables.append(table / table.sum(axis=2, keepdims=True))
            new = self.posterior(votes)
            if np.abs(new - q).max() < 1e-6:
                break
            q = new

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.repeat(np.log(self.prior)[:, None], len(votes), axis=1)
        for j, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            log += np.log(self.tables[j][:, given, votes[:, j]])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))

    @staticmethod
    def _tree(votes: np.ndarray, count: np.ndarray, q: np.ndarray) -> list[int]:
        """Link each voter to the tree by its strongest dependence, if that is significant."""
        n = votes.shape[1]
        link = np.zeros((n, n))
        for a in range(n):
            for b in range(a):
                for w in (count * (1 - q), count * q):
                    joint = np.zeros((3, 3))
                    np.add.at(joint, (votes[:, a], votes[:, b]), w)
                    total = joint.sum()
                    if total > 0:
                        expected = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True) / total
                        seen = joint > 0
                        link[a, b] += (joint[seen] * np.log(joint[seen] / expected[seen])).sum()
                link[b, a] = link[a, b]
        parent, inside = [-1] * n, {0}
        while len(inside) < n:
            a, b = max(((a, b) for a in range(n) if a not in inside for b in inside), key=lambda ab: link[ab])
            parent[a] = b if link[a, b] > 10 else -1
            inside.add(a)
        return parent


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            at = _features(len(self.lexicon.marks), self.lexicon.found(text), pattern_votes(text))
            out[k] += self.weights[at].sum() if at else 0.0
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))


def _features(marks: int, hits: list[int], patterns: list[int]) -> list[int]:
    """Positions of the ones among marks, the number of marks (1, 2, 3 or more) and patterns."""
    return [*hits, *(marks + k for k in range(min(3, len(hits)))), *(marks + 3 + k for k, v in enumerate(patterns) if v)]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learn from the documents that aren't held out. Runs Spark jobs. ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    train = docs.select("doc_id", "text").filter(~is_held_out(F.col("doc_id")))
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "toxic-labels")  # the documented bound
    sample = written(train.join(F.broadcast(known), "doc_id"), "toxic-sample")
    of = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = of.get(1, 0), of.get(0, 0)
    marks = mined(sample, toxic, clean) if toxic and clean else []
    lexicon, size = Lexicon(marks), len(marks) + 3 + PATTERNS
    if not marks:
        share = (toxic + 0.5) / (toxic + clean + 10)
        return Model(lexicon, np.zeros(size), float(np.log(share / (1 - share))))

    voted = train.mapInPandas(_voted(lexicon), f"doc_id {train.schema['doc_id'].dataType.simpleString()}, votes binary, hits array<int>, order bigint")
    # A label votes as well: 2 toxic, 0 clean, 1 unknown.
    voted = voted.join(F.broadcast(known), "doc_id", "left").withColumn("label", F.coalesce(2 * F.col("toxic"), F.lit(1)))
    voted = written(voted.select("doc_id", "votes", "hits", "label", "order"), "votes")
    counts = voted.groupBy("votes", "label").count().collect()  # at most 3 ** (VOTERS + 1) patterns
    votes = np.array([[*r["votes"], r["label"]] for r in counts])
    start = np.where(votes[:, -1] == 1, np.where((votes[:, :WORD_VOTERS + STEM_VOTERS] == 2).any(axis=1), 0.7, 0.05), 0.02 + 0.48 * votes[:, -1])
    model = LabelModel(votes, np.array([r["count"] for r in counts], float), start)
    columns = ("votes", "hits", "label")
    rows = voted.filter("label <> 1").select(*columns).collect()  # the bounded sample
    labelled, weights, drawn = len(rows), [1.0] * len(rows), []
    for stratum in (F.size("hits") > 0, F.size("hits") == 0):
        some = voted.filter("label = 1").filter(stratum)
        own = some.orderBy("order", "doc_id").limit(max_unlabelled).select(*columns).collect()  # the documented bound
        drawn.append((own, some.count()))
    unlabelled = sum(total for _, total in drawn)
    for own, total in drawn:
        rows += own
        weights += [total / len(own) * labelled / unlabelled for _ in own]
    q = model.posterior(np.array([[*r["votes"], r["label"]] for r in rows]))
    soft = []
    for r, p, weight in zip(rows, q.tolist(), weights):
        at = _features(len(marks), list(r["hits"]), [v - 1 for v in r["votes"][WORD_VOTERS + STEM_VOTERS:]])
        vector = SparseVector(size, at, [1.0] * len(at))
        soft += [(vector, 1.0, p * weight), (vector, 0.0, (1.0 - p) * weight)]
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType())])
    data = docs.sparkSession.createDataFrame(soft, schema)
    linear = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=200, standardization=False).fit(data)
    return Model(lexicon, linear.coefficients.toArray(), float(linear.intercept))


def scores(model: Model, text: Column) -> Column:
    return F.pandas_udf(lambda texts: model.score(texts), "double")(text)
