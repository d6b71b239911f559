"""Language mixtures: held-out accuracy, planted mixtures, EM against a plain version, odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import language
from clickloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs.filter(~language.is_held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, docs):
    rows = QUERIES["op12_language"](spark, FOLDER).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {*truth.values(), "und"} for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert 250 < len(held) < 420
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)


def test_planted_mixtures(docs, model):
    """Texts put together from held-out documents of two languages: both are found, with about their shares of the letters."""
    held = docs.filter(language.is_held_out(F.col("doc_id"))).filter("n_chars > 2000").orderBy("doc_id").collect()
    by = {lang: [r["text"][:2000] for r in held if r["lang"] == lang] for lang in ("en", "de", "fr", "es")}
    good = 0
    for (a, b), part in ((p, s) for p in (("en", "de"), ("fr", "es"), ("de", "es")) for s in (500, 1000, 1500)):
        text = by[a][0][:part] + " " + by[b][1][:2000 - part]
        found = dict(zip(model.languages, language.proportions(model, [text])[0]))
        good += {k for k, v in found.items() if v} == {a, b} and abs(found[a] - part / 2000) < 0.1
    assert good >= 8
    alone = language.proportions(model, [t for texts in by.values() for t in texts])
    assert ((alone > 0).sum(axis=1) == 1).mean() > 0.9


def test_ngrams_of_letters_only():
    numbers, owner = language.ngrams(["Ab, cd-1 E", None, "", "123 !", "ab CD e", "\U0001d400日本"])
    assert owner.tolist() == [0] * 5 + [4] * 5 + [5] * 3  # ' ab', 'ab ', ' cd', 'cd ', ' e '
    assert numbers[:5].tolist() == numbers[5:10].tolist() and len(set(numbers[:5].tolist())) == 5


def test_em_equals_a_plain_version():
    draw = np.random.default_rng(1)
    p, counts, starts = draw.random((30, 3)) / 40, draw.integers(1, 5, 30).astype(float), np.array([0, 4, 20])
    allowed = np.array([[1, 1, 1], [1, 0, 1], [0, 1, 1.0]])
    shares, likely = language.mixtures(p, counts, starts, allowed)
    for d, (a, b) in enumerate(((0, 4), (4, 20), (20, 30))):
        pi = [x / allowed[d].sum() for x in allowed[d]]
        for _ in range(200):
            new = [0.0] * 3
            for v in range(a, b):
                total = sum(pi[k] * p[v, k] for k in range(3))
                for k in range(3):
                    new[k] += counts[v] * pi[k] * p[v, k] / total / counts[a:b].sum()
            pi = new
        best = sum(counts[v] * math.log(sum(pi[k] * p[v, k] for k in range(3))) for v in range(a, b))
        assert likely[d] <= best + 1e-9 and best - likely[d] < 0.2 and np.abs(shares[d] - pi).max() < 0.15
        assert shares[d].sum() == pytest.approx(1) and all(shares[d][allowed[d] == 0] == 0)


def test_selected_sets_beat_single_languages(model):
    """The penalised likelihood of what stays is at least that of the best single language."""
    for text in ("Thatist der eau onshti " * 4, "the " * 30 + "der die ungsch " * 30, "eau"):
        numbers = language.ngrams([text])[0]
        mix = language.proportions(model, [text])[0]
        p = model.shares[numbers].astype(float)
        cost = language.PENALTY * math.log(len(numbers) + 1)
        assert mix.sum() == pytest.approx(1)
        assert np.log(p @ mix).sum() - (mix > 0).sum() * cost >= np.log(p).sum(axis=0).max() - cost - 1e-6


def test_odd_rows(spark, model):
    schema = "doc_id long, text string, lang string, score double, held_out string, id string"
    rows = [(1, None, "en"), (2, "", "de"), (3, "12 :-)", None), (None, "the and of", None), (None, "the and of", None), (4, "der die das " * 50_000, "de"), (5, "日本語", "en")]
    frame = spark.createDataFrame([(*r, 0.5, "x", "y") for r in rows], schema)
    got = language.predict(model, frame).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["lang"]) for r in got if r["id"] != 5) == [
        (False, 1, "und"), (False, 2, "und"), (False, 3, "und"), (False, 4, "de"), (True, 0, "en"), (True, 0, "en")]
    assert all((r["score"] == 0) == (r["lang"] == "und") == (not r["languages"]) for r in got)
    learned = language.fit(frame)
    assert learned.languages == ["de", "en"]
    nothing = language.fit(frame.filter("lang IS NULL"))
    assert nothing.languages == [] and {r["lang"] for r in language.predict(nothing, frame).collect()} == {"und"}
    empty = language.fit(frame.limit(0))
    assert language.predict(empty, frame.limit(0)).collect() == []
    named = frame.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert language.predict(model, named).count() == len(rows)


def test_counts_are_those_of_all_training_texts(spark):
    frame = spark.createDataFrame([("aaaa", "x"), ("aaaa", "x"), ("aaaa b", "y")], "text string, lang string").repartition(3)
    model = language.fit(frame)
    number = language.ngrams(["aaa"])[0][1]
    total = lambda n: n + language.SMOOTHING * (1 << language.BITS)
    assert model.shares[number].tolist() == pytest.approx([(4 + 0.3) / total(8), (2 + 0.3) / total(5)], rel=1e-5)
