"""Token files: exact round trips, damage, and the index against a plain tokenizer."""

import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from clickloom.llm import token_files
from clickloom.llm.queries import QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"


def plain_index(rows):
    tokenizer, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_plain_tokenizer(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op7_token_files"](spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == plain_index(docs)


def test_odd_texts_and_small_segments(spark):
    texts = [None, "", " \t\n", "x <|endoftext|>y z<|startoftext|> <|startoftext|>", "it's don't 's we'll", "a b c \x1c e\x85f", "İstanbul ẞ ﬁ é e ́",
             "日本 語 12345 3.14", "a\x0bb\x00c", "ΣΑΣ ǅ", "word " * 30_000, "same", "same"]
    rows = [(n // 2 * 5 - 20, t) for n, t in enumerate(texts)] + [(None, "none"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, bucket int, data string")
    segments = token_files.write(docs, tokenizer_path(), 2, segment=50)
    assert segments.count() > 5
    got = [tuple(r) for r in token_files.read_index(segments).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == plain_index(rows)
    assert token_files.read_index(token_files.write(docs.limit(0), tokenizer_path(), 2)).collect() == []


def test_text_ids(spark):
    rows = [("b", "one two"), ("a", "three"), (None, "none"), ("", "empty id"), ("aa", None), ("a", "another")]
    segments = token_files.write(spark.createDataFrame(rows, "doc_id string, text string"), tokenizer_path(), 2)
    got = token_files.read_index(segments).orderBy("start").select("doc_id", "start").collect()
    want = plain_index([(None if i is None else f"x{i}", t) for i, t in rows])
    assert [(r["doc_id"] if r["doc_id"] is None else f"x{r['doc_id']}", r["start"]) for r in got] == [w[:2] for w in want]


@pytest.mark.parametrize("n", [0, 1, 2, 4095, 4096, 4097, 9001])
@pytest.mark.parametrize("kinds", [1, 2, 300, 30_000])
def test_round_trip(n, kinds):
    ids = np.random.default_rng(n).integers(0, kinds, n)
    assert (token_files.decode(token_files.encode(ids)) == ids).all()


@pytest.mark.parametrize("block", [1, 2, 7, 100])
def test_small_blocks(block):
    ids = np.random.default_rng(block).zipf(1.3, 333) % 1000
    assert (token_files.decode(token_files.encode(ids, block)) == ids).all()


def test_contexts_that_change_their_habits():
    """Long habits make a prediction's share tiny, and then it comes true after all."""
    draw = np.random.default_rng(8)
    parts = [np.tile(p, 300) for p in ([1, 2, 3], [1, 2, 4], [5, 2, 3], [2, 3, 2, 4])]
    ids = np.concatenate([parts[k] for k in draw.integers(0, 4, 40)])
    ids[draw.integers(0, len(ids), 300)] = draw.integers(0, 9, 300)
    assert (token_files.decode(token_files.encode(ids)) == ids).all()
    for seed in range(20):
        few = np.random.default_rng(seed).choice([1, 1, 1, 1, 1, 1, 2, 3], 6000)
        assert (token_files.decode(token_files.encode(few)) == few).all()


def test_repeats_compress_and_damage_shows():
    ids = np.tile(np.random.default_rng(0).integers(0, 40_000, 50), 400)
    data = token_files.encode(ids)
    assert len(data) < len(ids) * 2 / 8
    broken = bytearray(data)
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        token_files.decode(bytes(broken))


@pytest.mark.parametrize("kinds", [32_768, 32_769, 49_406, 65_536, 65_537, 1_100_000])
def test_any_number_of_different_ids_in_a_segment(kinds):
    draw = np.random.default_rng(kinds)
    ids = np.concatenate([draw.permutation(kinds), np.full(5000, 7), draw.integers(0, kinds, 5000)])
    assert (token_files.decode(token_files.encode(ids)) == ids).all()


def test_one_text_with_most_of_the_vocabulary(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [(1, " ".join(w.removesuffix("</w>") for w in tokenizer.get_vocab())), (2, "after it")]
    assert len(set(tokenizer.encode(rows[0][1], add_special_tokens=False).ids)) > 32_768
    segments = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), 2)
    got = [tuple(r) for r in token_files.read_index(segments).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == plain_index(rows)


def test_segments_coded_side_by_side_are_those_coded_alone():
    draw = np.random.default_rng(3)
    some = [draw.zipf(1.3, n) % 1000 for n in (333, 0, 1, 500, 100)] + [np.arange(33_000), np.array([5] * 40)]
    for block in (7, 100, 4096):
        alone = [token_files.encode(ids, block) for ids in some]
        assert token_files.encode_all(some, block) == alone
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(token_files.decode_all(alone), some))
    broken = bytearray(alone[3])
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_all([alone[0], bytes(broken), alone[5]])


def _coded(encoder, texts):
    ids, lengths = encoder.encode(pa.array(texts, pa.large_string()), 2)
    return [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]


def _plainly(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_library_is_called_for_many_new_pieces_at_once(monkeypatch):
    encoder, calls = token_files.Encoder(tokenizer_path()), []
    model, whole = encoder.model, encoder.tokenizer
    monkeypatch.setattr(encoder, "model", type("M", (), {"encode_batch_fast": lambda self, t, **k: calls.append(t) or model.encode_batch_fast(t, **k)})())
    monkeypatch.setattr(encoder, "tokenizer", type("T", (), {"encode": lambda self, t, **k: calls.append(t) or whole.encode(t, **k)})())
    words = [f"w{chr(97 + n // 26 % 26)}{chr(97 + n % 26)}é{chr(97 + n // 676)}" for n in range(3000)]
    texts = [" ".join(words), "", "Straße, ÉCOLE! x2y²½ ªƁ", "it's <b>", " ".join(words[::-1])]
    assert _coded(encoder, texts) == _plainly(tokenizer_path(), texts)
    assert 0 < len(calls) < 25
    calls.clear()
    assert _coded(encoder, [texts[4], texts[3]]) == _plainly(tokenizer_path(), [texts[4], texts[3]])
    assert not calls
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 10)
    assert _coded(encoder, texts[2:4]) == _plainly(tokenizer_path(), texts[2:4])
    assert _coded(encoder, ["", " \n"]) == [[2], [2]]


def test_file_with_other_steps_is_left_to_the_library(tmp_path):
    steps = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    steps["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": "x"}, "content": "ab"}, steps["normalizer"]]}
    path = str(tmp_path / "other.json")
    Tokenizer.from_str(json.dumps(steps)).save(path)
    texts = ["xenon Box\tto it's", "", "xx x"]
    assert _coded(token_files.Encoder(path), texts) == _plainly(path, texts)


def test_runs_of_texts_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "TEXT_BYTES", 10)
    texts = pa.array(["abc", "", "defghijklmnop", "q", "é" * 4, "rs", ""], pa.large_string())
    assert list(token_files._slices(texts)) == [(0, 2), (2, 3), (3, 5), (5, 7)]
    assert list(token_files._slices(texts.slice(3))) == [(0, 2), (2, 4)]
    assert list(token_files._slices(texts.slice(0, 0))) == []
