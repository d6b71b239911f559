"""Spelling variants against brute force: every pair of words, by an edit-distance rule of its own."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import spelling
from clickloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_counts(rows, least=6, at_least=5, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                word = "".join(c for k, c in enumerate(word) if k != h % len(word))
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= at_least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def plain_variants(counts, ratio=5):
    words, near = sorted(counts), {w: [] for w in counts}
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), form[w] and counts[form[w]]) for w in words)


def got(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = plain_variants(plain_counts([(d["doc_id"], d["text"]) for d in docs]))
    assert len(want) > 500 and any(w[1] for w in want)
    assert got(QUERIES["op13_spelling_variants"](spark, FOLDER)) == want


@pytest.mark.parametrize("tile", [2, 256])
def test_dense_neighbourhoods_in_tiles(spark, tile):
    """Hundreds of words that share most letters, long ones too; one word is a third of all rows."""
    draw = random.Random(3)
    words = {"".join(draw.choice("abé") for _ in range(draw.choice((6, 7)))) for _ in range(400)}
    base = "x" * 300
    words |= {base, base[:-1], base + "y", base[:100] + "q" + base[101:], "abababab", "aabababab"}
    rows = [(k, f"{w} " * draw.choice((5, 6, 30, 200))) for k, w in enumerate(sorted(words))] + [(10**6, "ababab! " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_variants(plain_counts(rows, every=None))
    assert got(spelling.variants(spelling.count_words(docs), tile=tile)) == want


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "12 34 !!"), (None, "Straße STRASSE Ärgerärger " * 7), (None, "Straße STRASSE Ärgerärger " * 7),
        (4, "\U0001f600abcdefĀabcdefg×abcdef " * 5), (5, "abcdefh " * 30), (5, "short words only"),
    ]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, word string, n int, m int")
    counts = plain_counts(rows, every=3)
    assert got(spelling.variants(spelling.count_words(docs, typo_every=3))) == plain_variants(counts)
    texts = docs.selectExpr("concat('id', doc_id) AS doc_id", "text")
    assert spelling.variants(spelling.count_words(texts, typo_every=3)).count() > 0
    assert got(spelling.variants(spelling.count_words(docs.limit(0)))) == []


def test_chains_end_at_the_root(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(13)] + [("v", "w5")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {*((f"w{k}", "w13") for k in range(13)), ("v", "w13")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=4, max_size=7), min_size=2, max_size=30, unique=True))
def test_blocks_hold_each_near_pair_once(words):
    """All words in the bucket of each (m, part): every near pair is found in exactly one of them."""
    found = Counter()
    for m in range(3, 8):
        some = [w for w in words if len(w) in (m, m + 1)]
        for part in range(spelling.PARTS):
            if len(some) > 1:
                one = lambda x: np.array([x])
                i, j = spelling.near_pairs(some, one(len(some)), one(m), one(part), np.zeros(len(some), int), one(False))
                found.update(frozenset((some[a], some[b])) for a, b in zip(i, j))
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert found == Counter({pair: 1 for pair in want})
