"""Language model: exact base scores, a proper distribution over classes, held-out gain, odd rows."""

import collections
import math
import zlib

import numpy as np
import pytest

from clickloom.llm import maxent_lm
from clickloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute(rows):
    count = collections.Counter()
    for doc_id, text in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2:
            count.update(maxent_lm.words_of(text))
            count[None] += 1
    total, distinct = sum(count.values()), len(count)
    out = []
    for doc_id, text in rows:
        words = [*maxent_lm.words_of(text), None]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words)
        out.append((doc_id, len(words), sum(count[w] > 0 for w in words), total, base))
    return out


def check(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    got = sorted(((r[0], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) <= 1e-9 * abs(w[4]) + 1e-9


def test_query_has_exact_base_scores_and_gains_on_held_out(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op6_language_model"](spark, FOLDER).collect()
    check(got, brute(docs))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("head", [0, 3, 500_000])
def test_odd_rows_with_and_without_head(spark, head):
    rows = [(i, f"Lorem ipsum w{i % 5} ÄÖ {i}.") for i in range(40)] + [(None, "lorem"), (None, None), (41, ""), (41, ""), (42, "ipsum " * 30_000), (9, "x y \x1c")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n int, known string")
    model = maxent_lm.fit(docs, head_words=head, top=5)
    got = maxent_lm.score(model, docs).collect()
    check(got, brute(rows))
    same = [r["score"] for r in got if r["id"] == 41]
    assert same[0] == same[1]


def test_without_training_documents(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = maxent_lm.score(maxent_lm.fit(docs), docs).first()
    assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == (3, 0, 0.0, 0.0)
    assert maxent_lm.score(maxent_lm.fit(docs.limit(0)), docs.limit(0)).collect() == []


def small(spark):
    rows = [(i, f"the cat {'sat' if i % 2 else 'ran'} on w{i} éa{i}" + " the dog" * (i % 3)) for i in range(60)] + [(60, ""), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = collections.Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(maxent_lm.words_of(text))
            count[None] += 1
    return rows, docs, count


def softmax(z):
    z = [math.exp(x - max(z)) for x in z]
    return [x / sum(z) for x in z]


def plain(model, count, before, word):
    """P(word | words before) from the weights, one token at a time; None is the end, b"" any unknown word of a part."""
    tokens, frequent = maxent_lm.Tokens(), model.classes.frequent.tolist()

    def symbol(w):
        t = int(maxent_lm.BEFORE) if w is None else tokens[w]
        return 16 + frequent.index(t) if t in frequent else t & 15

    def place(w):
        t = tokens[w]
        if t in frequent:
            return int(model.classes.class_of[frequent.index(t)]), int(model.classes.part_of[frequent.index(t)])
        return 1 + maxent_lm.CLUSTERS + (t & 15), (t >> 4) & 31

    kind, part = (0, 0) if word is None else word if isinstance(word, tuple) else place(word)
    two, one = [None, None, *before][-2:]
    at = [np.array([x], np.int64) for x in (int(maxent_lm.BEFORE) if one is None else tokens[one], symbol(one), symbol(two), kind)]
    rows, part_rows = model.classes.rows(*at)
    of_class = softmax([float(model.bias[k]) + sum(float(model.weights[r, k]) for r in rows[0]) for k in range(32)])
    of_part = softmax([float(model.part_bias[kind, k]) + sum(float(model.weights[r, k]) for r in part_rows[0]) for k in range(32)])
    c = 0 if isinstance(word, tuple) else count[word]
    return of_class[kind] * of_part[part] * (c + 1) / model.part_total[kind, part]


@pytest.mark.parametrize("head", [0, 500_000])
def test_scores_are_those_of_a_plain_sum(spark, head):
    rows, docs, count = small(spark)
    model = maxent_lm.fit(docs, top=4, head_words=head)
    got = {r["id"]: r["score"] for r in maxent_lm.score(model, docs).collect()}
    for i, text in rows:
        words = [*maxent_lm.words_of(text), None]
        want = sum(math.log10(plain(model, count, words[:k], w)) for k, w in enumerate(words))
        assert abs(got[i] - want) < 1e-3 * len(words)  # the operator computes in single precision


def test_chances_of_all_next_words_sum_to_one(spark):
    _, docs, count = small(spark)
    model = maxent_lm.fit(docs, top=4)
    unknown = [(k, p) for k in range(1 + maxent_lm.CLUSTERS, maxent_lm.CLASSES) for p in range(maxent_lm.PARTS)]
    for before in ([], [b"the"], [b"the", b"cat"], [b"never", b"seen"]):
        # clusters without words keep a small share of their own
        assert abs(sum(plain(model, count, before, w) for w in [*count, *unknown]) + empty(model, before) - 1) < 1e-6


def empty(model, before):
    """What goes to clusters without words: none of the next words can be in them."""
    count = collections.Counter()
    return sum(plain_class(model, count, before, k) for k in range(1, 1 + maxent_lm.CLUSTERS) if not model.part_total[k].sum())


def plain_class(model, count, before, kind):
    tokens, frequent = maxent_lm.Tokens(), model.classes.frequent.tolist()
    two, one = [None, None, *before][-2:]
    words = [int(maxent_lm.BEFORE) if w is None else tokens[w] for w in (one, two)]
    near, far = (16 + frequent.index(t) if t in frequent else t & 15 for t in words)
    rows, _ = model.classes.rows(*(np.array([x], np.int64) for x in (words[0], near, far, kind)))
    return softmax([float(model.bias[k]) + sum(float(model.weights[r, k]) for r in rows[0]) for k in range(32)])[kind]


def test_rows_of_weights_grow_with_the_vocabulary(spark):
    few = spark.range(50).selectExpr("id as doc_id", "concat('w', id) as text")
    many = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 500), k -> concat('w', id, 'x', k))) as text")
    assert maxent_lm.fit(few).classes.bits == maxent_lm.MIN_BITS
    assert maxent_lm.fit(many, rounds=0).classes.bits == (1_280_000 // maxent_lm.WORDS_PER_ROW).bit_length() > maxent_lm.MIN_BITS


def test_long_text_is_cut_into_batches(spark):
    words = [f"a{k % 50}" for k in range(450_000)]
    rows = [(0, " ".join(words)), (1, "a1 a2"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(maxent_lm.score(maxent_lm.fit(docs), docs).collect(), brute(rows))


def test_sums_of_rows_are_those_of_a_plain_loop():
    draw = np.random.default_rng(1)
    values = np.append(draw.integers(-9, 9, (50, maxent_lm.PARTS)), np.zeros((1, maxent_lm.PARTS), int), axis=0)
    for n in ([1], [2, 5, 4, 17, 2, 300], [64, 3]):
        at = draw.integers(0, 50, sum(n))
        ends = np.cumsum(n)
        want = [values[at[e - k:e]].sum(axis=0) for e, k in zip(ends, n, strict=True)]
        assert (maxent_lm._sums(values, at, np.array(n)) == want).all()


def test_averages_of_several_tasks_are_weighted_by_tokens(monkeypatch, spark):
    """With a row for a task each, what is averaged equals the plain mean of what tasks send, whatever their order."""
    monkeypatch.setattr(maxent_lm, "TOKENS_PER_ROW", 1)
    rows = [(i, f"a{i % 7} b{i % 3} c{i % 11}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sent, average = [], maxent_lm._averaged

    class Shared:
        value = None

    model = maxent_lm.fit(docs, top=4, rounds=0, bits=4)
    Shared.value = (model.weights, model.bias, model.part_bias)
    cut = maxent_lm.tokenized(docs).toArrow().combine_chunks().to_batches()[0].select(["words"])
    for part in range(0, 200, 40):
        sent += maxent_lm._trained(model.classes, Shared)(iter([cut.slice(part, 40)]))
    total, seen = collections.defaultdict(float), collections.Counter()
    for batch in sent:
        for r in batch.to_pylist():
            for k, (row, n) in enumerate(zip(r["row"], r["n"], strict=True)):
                total[row] += n * np.array(r["w"][k * maxent_lm.PARTS:(k + 1) * maxent_lm.PARTS])
                seen[row] += n
                assert row >> maxent_lm.BLOCK_BITS == r["block"]
    for order in (sent, sent[::-1]):
        got = {r["row"]: r["w"] for b in average(iter(order)) for r in b.to_pylist()}
        assert got.keys() == seen.keys()
        assert all(np.allclose(got[r], total[r] / seen[r], rtol=1e-6) for r in got)
    assert maxent_lm.fit(docs, top=4, bits=4).weights.any()
