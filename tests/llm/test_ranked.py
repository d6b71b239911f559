"""NRA against full scoring: on random lists, on hand-made tables (the SQL test is in test_native)."""

import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=50):
    terms = [cut(t) for _, t in docs]
    some, total = sum(1 for t in terms if t), sum(map(len, terms))
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(cut(text))
    out = []
    for item, own in wanted.items():
        scores = []
        for (doc, _), t in zip(docs, terms):
            score = 0
            for q in own:
                tf, df = t.count(q), sum(1 for x in terms if q in x)
                if tf:
                    w = math.floor(1000 * math.log((2 * some + 2) / (2 * df + 1)))
                    score += w * (10**9 * tf // (1000 * tf + 20 * (50 + 50 * len(t) * some // total)))
            if score:
                scores.append((score, doc))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank, doc, score) for rank, (score, doc) in enumerate(scores[:k], 1)]
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("item", "rank", "id", "score").collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.integers(1, 8), st.lists(st.dictionaries(st.integers(0, 29), st.integers(1, 9), min_size=1), min_size=1, max_size=6))
def test_nra_finds_the_best_and_their_ties(size, k, terms):
    lists, want = [], np.zeros(size, np.int64)
    for impacts in terms:
        held = sorted(((d % size, x) for d, x in impacts.items()), key=lambda p: -p[1])
        held = list({d: (d, x) for d, x in reversed(held)}.values())[::-1]
        held.sort(key=lambda p: -p[1])
        lists.append((np.array([d for d, _ in held]), np.array([x for _, x in held])))
        for d, x in held:
            want[d] += x
    for least in (1, 7):
        mark = max(least, np.sort(want)[-k] if size >= k else least)
        found, scores = ranked.nra(lists, size, k, least)
        assert dict(zip(found.tolist(), scores.tolist())) == {d: s for d, s in enumerate(want.tolist()) if s >= mark}


def test_nra_stops_before_the_end_of_the_lists(monkeypatch):
    """The best document is known from the top of two lists; the long tail of small impacts is not read."""
    long = np.arange(100_000)
    rare, common = (np.array([5, 6]), np.array([10**6, 10])), (np.r_[5, 6, np.delete(long, [5, 6])], np.r_[10**6, 90, np.ones(len(long) - 2, np.int64)])
    reads = []
    monkeypatch.setattr(np, "searchsorted", lambda a, v, side, f=np.searchsorted: reads.append(f(a, v, side=side)) or reads[-1])
    found, scores = ranked.nra([rare, common], len(long), 1)
    assert (found.tolist(), scores.tolist()) == ([5], [2 * 10**6]) and max(reads) < 100


def test_search_equals_full_scoring(spark):
    draw = random.Random(2)
    words = ["the", "of", "Über", "日本", "x1", *(f"w{i}" for i in range(40))]
    text = lambda: " ".join(draw.choices(words, range(len(words), 0, -1), k=draw.choice((1, 4, 30))))
    docs = [(i, text()) for i in range(300)] + [(i, "the of w1, w1") for i in range(400, 470)]
    docs += [(1000, None), (1001, ""), (1002, "--"), (None, "w1 the of"), (None, "w1 the of"), (7, "w1 the"), (1003, "the w39 " * 3000)]
    items = [(i, text()) for i in range(12)] + [(20, None), (21, "!"), (22, "nowhere"), (3, "w39 w38"), (None, "THE w39"), (30, "the of W1")]
    d = spark.createDataFrame([(*r, "s", 1, 2) for r in docs], "doc_id long, text string, item string, n int, score int").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain(docs, items), key=repr)
    assert got(ranked.search(d, i)) == want
    assert got(ranked.search(d, i, block_terms=7)) == want
    assert got(ranked.search(d, i, k=3)) == sorted(plain(docs, items, 3), key=repr)
    named = got(ranked.search(d.selectExpr("concat('d', doc_id) AS doc_id", "text"), i.selectExpr("concat('i', item_id) AS item_id", "text")))
    assert len(named) == len(want)


def test_shards_of_few_postings(spark, monkeypatch):
    """Cutting shards changes nothing: in one task the marks of earlier shards go on."""
    draw = random.Random(4)
    docs = [(i, " ".join(draw.choices("a b c d e f g".split(), k=9))) for i in range(500)]
    items = [(1, "a b"), (2, "c d e f"), (3, "g")]
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", 30)
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert got(ranked.search(d, spark.createDataFrame(items, "item_id long, text string"), k=5)) == sorted(plain(docs, items, 5), key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert got(ranked.search(docs.limit(0), items)) == [] and got(ranked.search(docs, items.limit(0))) == []
    assert got(ranked.search(docs.selectExpr("doc_id", "cast(null AS string) AS text"), items)) == []
    assert len(got(ranked.search(docs, items))) == 1
