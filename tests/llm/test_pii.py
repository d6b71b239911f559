"""Personal data: base spans against the plain patterns, planted candidates, odd rows."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import pii
from clickloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    found = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(c) for c in digits[-2::-2]]
            ok = (
                True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                14 <= len(digits) <= 19 and (sum(int(c) for c in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in odd)) % 10 == 0,
                10 <= len(digits) <= 15,
            )[kind]
            if ok:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_query_equals_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op5_personal_data"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]] or "")
        form = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(form).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(form) <= set(spans)
        order = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@@..+ -()019255é\n", max_size=60))
def test_base_equals_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)
    assert pii.base_spans("4" * 15 + "6 " + text) == plain("4" * 15 + "6 " + text)


def test_long_texts_take_linear_time():
    for part in ("a", "1", "1 ", "a@", "1.", "+1", "(1"):
        text = part * 200_000
        pii.base_spans(text)
        pii.candidates(text)


def test_trees_add_phones_without_plus(spark):
    docs = [(i, f"please call +1 ({i:03d}) 555-{i * 37 % 10000:04d} today or lot {i * 7919 % 10**7:07d} of x{i}") for i in range(600)]
    docs += [(1000, "please call 1 (077) 555-1234 today or lot 1234567 of x7"), (1001, None), (1001, None), (None, "nothing, 1234567")]
    frame = spark.createDataFrame([(*d, "b", "s") for d in docs], "doc_id long, text string, base string, spans string")
    trees = pii.fit(frame)
    got = {(r["id"], len(r["spans"]) - len(r["base"])) for r in pii.find(frame, trees).collect()}
    assert (1000, 1) in got and (1001, 0) in got and (None, 0) in got
    assert sum(n for i, n in got if i != 1000) == 0


def test_rare_kinds_get_thresholds_from_all_documents(spark):
    """One phone in 100 documents; the sample has about 15, a quarter of which is kept apart."""
    call = lambda i: f"please call +1 ({i % 900:03d}) 555-{i * 37 % 10000:04d} today" if i % 100 == 0 else f"write u{i}@site.example.com"
    docs = [(i, f"{call(i)} or lot {i * 7919 % 10**7:07d} of x{i}") for i in range(6000)]
    trees = pii.fit(spark.createDataFrame(docs, "doc_id long, text string"), max_docs=1500)
    assert trees.thresholds[3] < float("inf")
    more = spark.createDataFrame([*docs[:200], (9000, "please call 1 (077) 555-1234 today or lot 1234567 of x7")], "doc_id long, text string")
    assert {r["id"] for r in pii.find(more, trees).collect() if len(r["spans"]) > len(r["base"])} == {9000}


def test_trees_add_what_base_rules_cannot_see(spark):
    """Base spans teach each kind; planted ones are written in ways that no base rule finds."""
    def card(i: int) -> str:
        head = f"4{i * 7919 % 10**14:014d}"
        return head + next(d for d in "0123456789" if pii.luhn(head + d))

    docs = []
    for i in range(600):
        docs.append(f"mail jo{i}@site{i}.example.com now, host 10.{i % 250}.3.{i % 200} up, pay by card {card(i)} soon, call +1 ({i:03d}) 555-{i * 37 % 10000:04d} today")
        docs.append(f"lot {i * 7919 % 10**7:07d} of size x{i}@home or build 10.{i}.400.{i + 300} and order ref {i * 104729 % 10**13:013d}")
    planted = {0: "mail ann (at) corp (dot) com now", 1: "host 10[.]7[.]3[.]9 up", 2: "pay by card " + "/".join(card(77)[k:k + 4] for k in (0, 4, 8, 12)) + " soon",
               3: "call 1 (077) 555-1234 today"}
    rows = [*enumerate(docs, 10), *planted.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in pii.find(frame, pii.fit(frame)).collect()}
    for kind, text in planted.items():
        assert not got[kind]["base"]
        assert [s["kind"] for s in got[kind]["spans"]] == [pii.KINDS[kind]], text
    assert all(r["base"] == r["spans"] for i, r in got.items() if i >= 10)


def test_rewritings_are_candidates_and_read_back():
    for text, kind in (("jo.b@site.example.com", 0), ("10.0.3.99", 1), ("4111 1111 1111 1111", 2), ("+1 (077) 555-1234", 3)):
        new = pii.rewritten(text, kind)
        assert (5, kind, 5 + len(new)) in pii.candidates(f"now: {new} then")
        assert not any(b[1] == kind for b in pii.base_spans(new))
        assert any(b[1] == kind for b in pii.base_spans(pii.plain(new, kind)))


def test_without_accepted_candidates(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "1234567 and 12.13.14.15.16")], "doc_id long, text string")
    trees = pii.fit(frame)
    assert all(r["base"] == r["spans"] for r in pii.find(frame, trees).collect())
    assert pii.find(frame.limit(0), pii.fit(frame.limit(0))).collect() == []


def test_redaction():
    assert pii.redacted("ab cd ef", [("x", 0, 2), ("y", 1, 4), ("z", 6, 8)]) == "[x]d [z]"
