"""Near-duplicate components against brute force over full sets."""

import itertools
import random

import numpy as np
import pytest

from clickloom.llm import minhash
from clickloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def word_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        out.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def brute(ids, texts, k, percent=80):
    sets = word_sets(texts, k)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [(ids[i], len(sets[i]), min(groups[find(i)], key=lambda x: (x is None, x or 0))) for i in range(len(ids))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = QUERIES["op2_minhash_near_dedup"](spark, FOLDER).collect()
    want = brute([d["doc_id"] for d in docs], [d["text"] for d in docs], 4)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.fixture(scope="module")
def odd(spark):
    """Chains of near copies, a group around a common base, a shared passage, odd rows."""
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(10**6)}"
    texts = []
    text = [word() for _ in range(120)]
    for _ in range(25):  # each like the one before, the ends unlike
        texts.append(" ".join(text))
        text = text[6:] + [word() for _ in range(6)]
    base = [word() for _ in range(200)]
    for _ in range(60):  # like the base, mostly less like each other
        copy = list(base)
        for _ in range(draw.randrange(1, 7)):
            copy[draw.randrange(200)] = word()
        texts.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    for _ in range(60):
        texts.append(" ".join([word() for _ in range(draw.randrange(5, 60))] + passage + [word() for _ in range(10)]))
    texts += [None, "", " \t\n", "one", "ONE", "one two", "One  two", "a b c d e", "a b c d e", "word " * 5000]
    rows = [(i * 7 % len(texts), t) for i, t in enumerate(texts)] + [(None, "a b c d e"), (3, "one"), (3, "one"), (None, None)]
    draw.shuffle(rows)
    return spark.createDataFrame([(*r, "n", 3, "c") for r in rows], "doc_id long, text string, node string, n int, comp string"), rows


@pytest.mark.parametrize("leaders, tile, percent", [(True, 512, 80), (False, 512, 80), (True, 4, 80), (False, 3, 80), (True, 7, 60), (True, 512, 95)])
def test_odd_rows_equal_brute_force(odd, monkeypatch, leaders, tile, percent):
    frame, rows = odd
    monkeypatch.setattr(minhash.open_links, "__defaults__", (tile,))
    got = minhash.components(frame, shingle=5, percent=percent, leaders=leaders).collect()
    want = brute([r[0] for r in rows], [r[1] for r in rows], 5, percent)
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(((r["id"], r["n"], r["first"]["id"]) for r in got), key=key) == sorted(want, key=key)


def test_one_of_each_keeps_columns(odd):
    frame, rows = odd
    got = minhash.one_of_each(frame).collect()
    assert list(got[0].asDict()) == frame.columns
    want = brute([r[0] for r in rows], [r[1] for r in rows], 5)
    groups = {tuple(r["comp"]) for r in minhash.components(frame).collect() if r["comp"]}  # ids alone are not unique here
    assert len([r for r in got if (r["text"] or "").strip()]) == len(groups)
    assert len([r for r in got if not (r["text"] or "").strip()]) == len([w for w in want if not w[1]])


def test_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 7), (2, "A b c d e f", 8), (3, None, 9)]
    frame = spark.createDataFrame(rows, "id long, text_hash string, g long").withColumnsRenamed({"text_hash": "Text_Hash"})
    got = minhash.one_of_each(frame, id_col="id", text_col="Text_Hash").collect()
    assert sorted(tuple(r) for r in got) == [rows[0], rows[2]]


def test_intersections_equal_plain_sets(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    draw = np.random.default_rng(3)
    left, right = ([np.unique(draw.integers(0, 60, draw.integers(1, 40)).astype(np.uint64)) for _ in range(9)] for _ in "ab")
    plain = lambda x, y: [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]
    assert minhash.intersections(left, right).tolist() == plain(left, right)
    off = ~np.eye(9, dtype=bool)
    assert (minhash.intersections(left)[off] == np.array(plain(left, left))[off]).all()


def test_similarities_with_too_many_bands_are_refused(odd):
    assert minhash.bands_for(80) == 42
    with pytest.raises(ValueError):
        minhash.components(odd[0], percent=40)


def test_empty_table(odd):
    assert minhash.components(odd[0].limit(0)).collect() == []
    assert minhash.one_of_each(odd[0].limit(0)).collect() == []


def test_sketch_estimates_similarity():
    draw = np.random.default_rng(1)
    a = np.unique(draw.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(draw.integers(0, 2**63, 200).astype(np.uint64))])
    for x, y in ((a, b), (a[:3], a[:3]), (a[:1], a[1:2])):
        true = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
        sx, sy = minhash.sketch([np.sort(x), np.sort(y)], 252)
        assert abs((sx == sy).mean() - true) < 0.12
    assert (minhash.sketch([a, b], 252)[0] == minhash.sketch([a], 252)[0]).all()
