"""Weak supervision: label model against planted accuracies, classifier against held-out labels, odd rows."""

import re
import zlib

import numpy as np
import pytest

from clickloom.llm import toxicity
from clickloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    rows = QUERIES["op9_toxicity"](spark, FOLDER).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)
    assert sum(p for p, t in held if t == 0) <= 0.03 * len(held)


def test_label_model_recovers_planted_voters():
    draw = np.random.default_rng(3)
    y = draw.random(20_000) < 0.2
    votes = np.ones((len(y), 6), int)
    for j, (hit, false) in enumerate([(0.8, 0.02), (0.6, 0.01), (0.5, 0.05), (0.7, 0.03), (0.6, 0.04)]):
        votes[:, j] += draw.random(len(y)) < np.where(y, hit, false)
    votes[:, 5] = votes[:, 2]  # a copy: its evidence must not count twice
    patterns, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    start = np.where((patterns == 2).sum(axis=1) >= 1, 0.7, 0.05)
    model = toxicity.LabelModel(patterns, count.astype(float), start)
    assert abs(model.prior[1] - 0.2) < 0.03
    assert model.parent[5] == 2 or model.parent[2] == 5
    q = model.posterior(patterns)
    for k in range(len(patterns)):
        if count[k] > 200:
            assert abs(q[k] - y[at.ravel() == k].mean()) < 0.12


def test_posterior_and_em_equal_a_plain_version():
    """Posteriors by multiplying plain probabilities; at the end the tables are the shares counted with these posteriors."""
    draw = np.random.default_rng(5)
    votes = draw.integers(0, 3, (12, 4))
    count = draw.integers(1, 50, 12).astype(float)
    model = toxicity.LabelModel(votes, count, draw.random(12))
    model.parent = [-1, 0, -1, 2]
    model.fit(votes, count, model.posterior(votes))
    plain = []
    for row in votes.tolist():
        p = list(model.prior)
        for y in range(2):
            for j, parent in enumerate(model.parent):
                p[y] *= model.tables[j][y][row[parent] if parent >= 0 else 0][row[j]]
        plain.append(p[1] / sum(p))
    assert np.allclose(model.posterior(votes), plain)
    for j, parent in enumerate(model.parent):
        for y in range(2):
            for given in range(3):
                own = [0.1 + sum(c * (q if y else 1 - q) for row, c, q in zip(votes.tolist(), count, plain)
                                 if row[j] == v and (row[parent] if parent >= 0 else 0) == given) for v in range(3)]
                assert np.allclose(model.tables[j][y][given], np.array(own) / sum(own), atol=0.02)


def test_scores_equal_a_plain_sum(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    marks = model.lexicon.marks
    for r in docs.withColumn("s", toxicity.scores(model, docs.text)).limit(200).collect():
        words = {w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", r["text"].encode().lower()) if w}
        letters = [w.decode() for w in words]
        hits = [k for k, m in enumerate(marks) if (any(w.startswith(m[:-1]) and len(w) > len(m) - 1 for w in letters) if m.endswith("*") else m in letters)]
        upper, lower = (sum(c in cases for c in r["text"]) for cases in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        size = len(r["text"].encode())
        patterns = [upper > lower, r["text"].count("!!") > 2, 20 * sum(c in "#$%&*" for c in r["text"]) > size, size < 40]
        z = model.bias + sum(model.weights[k] for k in hits) + sum(model.weights[len(marks) + k] for k in range(min(3, len(hits))))
        z += sum(model.weights[len(marks) + 3 + k] for k, p in enumerate(patterns) if p)
        assert abs(r["s"] - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-9


def test_unlabelled_documents_teach(spark):
    """A word that labelled documents do not hold gets weight from unlabelled ones, through the words beside it."""
    rows = [(i, f"you idiot fool number{i}" if i % 3 == 0 else f"a fine day number{i}") for i in range(90)]
    rows += [(1000 + i, f"you idiot fool moron number{i}" if i % 3 == 0 else f"a fine day number{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    fitted = [toxicity.fit(docs, labels, max_unlabelled=n) for n in (0, 10_000)]
    probe = spark.createDataFrame([("you idiot",), ("a fine day",)], "text string")
    for model in fitted:
        high, low = (r["s"] for r in probe.withColumn("s", toxicity.scores(model, probe.text)).collect())
        assert high > 0.5 > 0.3 > low
    assert not np.allclose(fitted[0].weights, fitted[1].weights)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert docs.withColumn("s", toxicity.scores(toxicity.fit(docs, labels), docs.text)).collect() == []
    some = spark.createDataFrame([(1, "a b")], docs.schema)
    assert 0 <= some.withColumn("s", toxicity.scores(toxicity.fit(some, labels), some.text)).first()["s"] <= 1


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, f"you idiot number{i}" if i % 3 == 0 else f"a fine day number{i}", "m") for i in range(90)]
        + [(None, None, "m"), (91, "", "m"), (92, "idiot " * 50_000, "m"), (0, "you idiot number0", "m")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(5, 0, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {(r["doc_id"], r["text"]): r["s"] for r in docs.withColumn("s", toxicity.scores(model, docs.text)).collect()}
    assert all((s >= 0.3) == ("idiot" in (t or "")) for (_, t), s in got.items())
    assert got[(None, None)] == got[(91, "")]


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 0)]])
def test_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = docs.withColumn("s", toxicity.scores(model, docs.text)).collect()
    assert len(rows) == 2 and rows[0]["s"] == rows[1]["s"]


def test_marks():
    words, stems = toxicity.marks_in("Öl-Preis ÄÖ IDIOTisch")
    assert words == {"Öl".encode(), b"preis", "ÄÖ".encode(), b"idiotisch"}
    assert stems[2] == {"idiot"} and stems[0] == {"pre", "idi"}
