"""Each stage of the pipeline on its own input, against brute force."""

import re

import corpus_pipeline
import pytest
from test_minhash import brute
from test_token_files import plain_index

from clickloom.llm import mixing
from clickloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        out.append((name, docs.columns, [r.asDict() for r in docs.collect()]))
    return out


def ids(stage):
    return sorted(r["doc_id"] for r in stage[2])


def test_stages_in_order_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert [s[0] for s in stages] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    assert all(s[1] == columns for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    """The few labels of this folder don't show every toxic word: what counts is that the scores decide."""
    kept = [r["doc_id"] for r in QUERIES["op9_toxicity"](spark, FOLDER).collect() if not r["predicted"]]
    assert ids(stages[0]) == sorted(kept)
    assert 160 <= len(kept) < 200


def test_known_toxic_documents_go(spark):
    """Independent of the model's scores, at a size whose labels show each of these words in ten toxic documents or more."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    rows = docs.collect()
    word = re.compile(r"\b(idiot|moron|scum)\b", re.IGNORECASE)
    toxic = {r["doc_id"] for r in rows if word.search(r["text"] or "")}
    assert len(toxic) >= 20 and not toxic & kept
    assert len(kept) >= 0.85 * len(rows)


@pytest.fixture
def odd_folder(spark, tmp_path):
    """Nulls in every column, blank texts, repeated rows; or no rows at all. Extra columns named like the stages' own."""

    def made(rows):
        extra = "id string, key string, row string, text_hash string, __key string, __score double"
        docs = [(*r, "i", "k", "r", "h", "k", 0.5) for r in rows]
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
        spark.createDataFrame(docs, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        bench = [(1, "one two three four five six"), (None, None)] if rows else []
        spark.createDataFrame(bench, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        labels = [(1, 1, 1), (None, None, None), (2, None, 0)] if rows else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return made


def test_odd_documents_go_through(spark, odd_folder):
    same = (5, "a b c d e f g", "en", None, 1)
    rows = [(None, None, None, None, None), (1, "", None, "s", 0), (2, " \t ", "en", "s", 3), same, same, (6, "A b c d e f g", "en", "s", 13),
            (7, "before one two three four five six after", "en", "s", 40), (8, "w " * 30_000, "en", None, 60_000)]
    folder = odd_folder(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert len(docs.columns) == 11
        kept.append(sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is None, i or 0)))
    assert kept[1] == [1, 2, 5, 7, 8, None] and kept[2] == [1, 2, 5, 8, None]
    assert {r["key"] for r in docs.collect()} == {"k"}
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["start"] for r in run)[0] == 0


def test_empty_tables_go_through(spark, odd_folder):
    assert corpus_pipeline.run(spark, odd_folder([])).collect() == []


def test_one_of_each_group_stays(stages):
    rows = stages[0][2]
    assert ids(stages[1]) == sorted({c for _, _, c in brute([r["doc_id"] for r in rows], [r["text"] for r in rows], 5)})


def test_contaminated_documents_go(spark, stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = cut(r["text"])
        windows |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    kept = []
    for r in stages[1][2]:
        w, hit = cut(r["text"]), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append(r["doc_id"])
    assert ids(stages[2]) == sorted(kept)


def test_mix_takes_what_it_planned(spark, stages):
    docs = spark.createDataFrame(stages[2][2], "doc_id long, text string, lang string, source string, n_chars long")
    wanted = sorted(r["id"] for r in mixing.mix(docs).collect() for _ in range(r["copies"]))
    assert ids(stages[3]) == wanted


def test_token_files_hold_the_mix(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[3][2]]
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in stages[4][2]]
    assert sorted(got, key=lambda r: r[1]) == plain_index(rows)
