"""Mixing, decontamination and fingerprints against SQL, brute force and hand-made frames."""

import hashlib
import re
import struct

import compare
import pytest
import xxhash
from pyspark.sql import functions as F

from clickloom.llm import decontaminate, fingerprint, mixing
from clickloom.llm.common import with_ordered_bucket
from clickloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, words string, range string, size int, key string"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) == ""


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "k") for r in rows], SCHEMA)


def test_mixing_shares_and_limits(spark):
    docs = frame(spark, [(i, "w " * (i % 7), "abc"[min(i % 10, 2)]) for i in range(900)] + [(5000, "one two", None), (5000, "one two", None), (None, None, None)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == 903
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v)
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1 + max(r["size"] for r in v) / 2
    assert by[None][0]["target"] == 12.0  # the fourth source weighs 1, but has only 4 words


def test_mixing_empty_tables_and_texts(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    rows = mixing.mix(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [(r["size"], r["taken"]) for r in rows] == [(0, 0), (0, 0)]


def test_decontamination_cases(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "Short ITEM"), (3, None), (4, "..."), (2, "Short ITEM"), (None, "nobody")], "item_id long, text string")
    first, last = " ".join(f"w{i}" for i in range(13)), " ".join(f"w{i}" for i in range(7, 20))
    docs = frame(spark, [
        (1, f"a {first} b", "s"), (2, f"{last}, {first}", "s"), (3, " ".join(f"w{i}" for i in range(12)), "s"),
        (4, "x short-item y", "s"), (5, None, "s"), (6, "", "s"), (7, "nobody " + "z " * 100, "s"), (1, f"a {first} b", "s"), (None, "short item", None),
    ])
    out = decontaminate.judged(decontaminate.find(docs, bench)).collect()
    got = sorted((str(r["id"]), r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in out)
    assert got == sorted([
        ("1", 15, 13, ("1",), True), ("1", 15, 13, ("1",), True), ("2", 26, 26, ("1",), True), ("3", 12, 0, (), False),
        ("4", 4, 2, ("2",), True), ("5", 0, 0, (), False), ("6", 0, 0, (), False), ("7", 101, 1, ("",), False), ("None", 2, 2, ("2",), True),
    ])
    assert decontaminate.find(docs, bench.limit(0)).filter("size(items) > 0").count() == 0
    assert decontaminate.find(docs.limit(0), bench).collect() == []


def vector(text):
    pieces = re.findall(fingerprint.PIECE, text)
    out = [0] * (fingerprint.SUMS + fingerprint.LANES)
    for p in pieces:
        hs = [xxhash.xxh64_intdigest(p.encode(), seed=xxhash.xxh64_intdigest(struct.pack("<i", k), seed=42)) for k in range(4)]
        add = [1, *(h & 0xFFFFFFFF for h in hs), *(h >> 32 for h in hs)]
        add += [1 if h >> j & 1 else -1 for h in hs[:2] for j in range(64)]
        out = [a + b for a, b in zip(out, add)]
    return [x % 2**32 for x in out[:9]] + [(x + 32768) % 65536 - 32768 for x in out[9:]]


def test_fingerprints_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    rows = {r["doc_id"]: r for r in QUERIES["op3_document_fingerprints"](spark, FOLDER).collect()}
    assert len(rows) == len(docs)
    for i, d in enumerate(docs):
        r, text, after = rows[d["doc_id"]], d["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        half = len(text) // 2
        edit = text[:len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        form = lambda v: "".join(f"{x:08X}" for x in v[:9]) + "".join(f"{x % 65536:04X}" for x in v[9:])
        assert r["fingerprint"] == form(vector(text)) and r["edited_fingerprint"] == form(vector(edit))
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    mean = lambda c: sum(r[c] for r in rows.values()) / len(rows)
    assert mean("near_edited") > 0.4 and mean("near_next") < 0.1


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("a. b.", "b. a.", "c!\n", "a. b.c!\n")], "x string, y string, z string, xz string")
    x, y, z, xz = (fingerprint.lanes(F.col(c)) for c in ("x", "y", "z", "xz"))
    r = df.select(x.alias("x"), y.alias("y"), fingerprint.combine(x, z).alias("sum"), xz.alias("xz"), fingerprint.combine(xz, z, -1).alias("less")).first()
    assert r["sum"] == r["xz"] and r["less"] == r["x"]


def test_many_pieces_use_wide_counters(spark):
    df = spark.createDataFrame([("a!b?" * 20_000,)], "t string")
    assert df.select(fingerprint.lanes(F.col("t")).alias("v")).first()["v"] == vector("a!b?" * 20_000)


@pytest.mark.parametrize("ids", [[], [7], [None], [3, 1, 2, 2, None, 9, 8], list(range(500, 0, -1))])
def test_next_row(spark, ids):
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    got = fingerprint.with_next(df, "doc_id", ["text"]).collect()
    order = sorted(((i is not None, i or 0, f"t{n}") for n, i in enumerate(ids)))
    want = {a[2]: order[(k + 1) % len(order)][2] for k, a in enumerate(order)}
    assert {r["text"]: r["next"]["text"] for r in got} == want


@pytest.mark.parametrize("ids", [[], [None], ["b"], ["b", "a", "aa", "", None, "é", "a", None, *(f"d{i}" for i in range(300))]])
def test_next_row_with_text_ids(spark, ids):
    df = spark.createDataFrame([(i, f"t{n:03}") for n, i in enumerate(ids)], "doc_id string, text string").repartition(3)
    got = fingerprint.with_next(df, "doc_id", ["text"]).collect()
    order = sorted(((i is not None, i or "", f"t{n:03}") for n, i in enumerate(ids)))
    assert {r["text"]: r["next"]["text"] for r in got} == {a[2]: order[(k + 1) % len(order)][2] for k, a in enumerate(order)}


def test_buckets_follow_the_size_of_the_texts(spark):
    """Four times the text makes four times the buckets, whatever the number of shuffle partitions."""
    for times in (1, 4):
        df = spark.range(400 * times).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text"))
        sizes = [r["count"] for r in with_ordered_bucket(df, "doc_id", "b", "text", 10_000).groupBy("b").count().collect()]
        assert 30 * times <= len(sizes) <= 45 * times and max(sizes) <= 20
    named = with_ordered_bucket(df.selectExpr("concat('d', doc_id) AS doc_id", "text"), "doc_id", "b", "text", 10_000)
    assert max(r["count"] for r in named.groupBy("b").count().collect()) <= 60


def test_stages_keep_columns_of_any_name(spark):
    """Columns that look like the operators' own stay as they are."""
    names = ["id", "key", "row", "__key", "__source", "__size", "__range", "__copies", "n", "windows"]
    docs = spark.createDataFrame([(i, f"w{i} common words of text {i}", "ab"[i % 2], *[f"{c}{i}" for c in names]) for i in range(40)],
                                 f"doc_id long, text string, source string, {', '.join(f'{c} string' for c in names)}")
    bench = spark.createDataFrame([(1, "w3 common words of text 3")], "item_id long, text string")
    clean = decontaminate.without_contaminated(docs, bench)
    mixed = mixing.mixed_rows(docs)
    assert clean.columns == mixed.columns == docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i in range(40) if i != 3]
    assert all(r == rows[r["doc_id"]] for r in [*clean.collect(), *mixed.collect()])
