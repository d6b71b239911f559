"""Token counts against greedy cutting that builds the pieces."""

from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import token_counts
from clickloom.llm.queries import QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"


def greedy(word, pieces, longest):
    rest, n = (*word, token_counts.END), 0
    while rest:
        size = next((k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in pieces), 0)
        if not size:
            return 1
        rest, n = rest[size:], n + 1
    return n


def test_query_equals_greedy_cutting(spark):
    pieces = set(token_counts.vocabulary(tokenizer_path()))
    longest = max(map(len, pieces))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op8_token_counts"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = (texts[r["doc_id"]] or "").encode().lower().split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(greedy(w, pieces, longest) for w in words))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abc", min_size=1, max_size=5), max_size=8), st.text("abcd", max_size=14))
def test_any_vocabulary(inner, final, word):
    pieces = {tuple(p.encode()) for p in inner} | {(*p.encode(), token_counts.END) for p in final} | {(token_counts.END,)}
    assert token_counts.Automaton(sorted(pieces)).count(word.encode()) == greedy(word.encode(), pieces, 9)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a" * 300_000), (None, "The CAT"), (5, "x y"), (5, "x y"), (6, "日本 é\x00")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n_words int, id string")
    pieces = token_counts.vocabulary(tokenizer_path())
    got = {r["id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count(docs, pieces).collect()}
    assert got[1] == got[2] == got[3] == (0, 0)
    assert got[4] == (1, greedy(b"a" * 300_000, set(pieces), 40)) and got[None] == (2, 2) and got[5] == (2, 2)
    assert token_counts.count(docs.limit(0), pieces).collect() == []
