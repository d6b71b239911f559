"""Personal data by candidate gradient boosting.

1. Base rules find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers; their spans always stay.
2. High-recall generators propose overlapping candidates of the same kinds: addresses with spelled-out signs or without a
   domain ending, any four numbers between plain, bracketed or spelled-out dots, any number of 12 to 19 digits with up to
   two signs between them, any grouped number of 7 to 15 digits.
3. Boosted trees (pyspark.ml) see a candidate's format and its context, but not what the base rule decides by (the plus of
   a phone, the check digit of a card, the range of IP parts, the @ of an address). They learn from a bounded sample of
   candidates (of about ``max_docs`` documents). Positives are base spans and, for each of them, its rewriting in place
   that no base rule sees (``rewritten``): spelled-out address, IP with bracketed dots, card grouped by dots or slashes,
   phone without its plus. Negatives are candidates that stay no personal data when such writing is undone (``plain``);
   the others, which may be personal data that base rules miss, are unknown and left out.
4. In one pass over all documents, candidates the trees didn't learn from (all but three quarters of the sample) are
   counted by kind, score (in steps of 1 / BINS) and whether they are positives; base spans, which stay anyway, do not
   count, only their rewritings. From these counts a threshold is set for each kind: the lowest score from which on at
   least ``precision`` of the candidates are positives, 10 at least; a kind that never gets there adds nothing.
5. Candidates above their threshold that overlap no base span are added, best first, without overlaps.

The trees travel to the tasks as small arrays; each document is read once and gives one row. All patterns take time in
proportion to the text. Offsets are code points, ends are exclusive.

Defined cases: null is the empty text, without spans; without positives or without negatives in the sample nothing
is added; equal rows give equal results each; a null id is an id.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import written

KINDS = ("email", "ip", "card", "phone")
MAX_DOCS, PRECISION = 20_000, 0.98
BINS = 1024  # a power of two, so that scores and thresholds compare exactly
#: The base patterns. E-mails are found from the @ outwards and IPs from the start of a number on, which
#: gives the same matches without trying every start.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The generators.
LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?(?:@|\(at\)|\[at\]|[ ]at[ ])[ ]?[A-Za-z0-9-]{1,63}(?:(?:\.|[ ]?\(dot\)[ ]?|[ ]?\[dot\][ ]?|[ ]dot[ ])[A-Za-z0-9-]{1,63}){0,8}")
LOOSE_IP = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}(?:(?:\.|\[\.\]|\(\.\)|[ ]?\(dot\)[ ]?|[ ]?\[dot\][ ]?|[ ]dot[ ])[0-9]{1,5}){3}(?![0-9A-Za-z])")
LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9][0-9\x20().-]{5,30}[0-9](?![0-9A-Za-z])")
LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])")
#: How spelled-out signs are written and read back.
SPELLED = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"))
READ_AT, READ_DOT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?| at "), re.compile(r" ?(?:\(dot\)|\[dot\]|\[\.\]|\(\.\)) ?| dot ")
WORDS = ("mail", "contact", "phone", "tel", "call", "fax", "card", "visa", "pay", "account", "host", "server", "address", "version", "token", "id")
FEATURES = 4 + 14 + len(WORDS)
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the base rules find, by start, then kind."""
    found, cursor = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > cursor and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            found.append((begin, 0, domain.end()))
            cursor = domain.end()
        at = text.find("@", max(at + 1, cursor))
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def candidates(text: str) -> list[Span]:
    """Overlapping proposals."""
    found = set()
    if "@" in text or "at" in text:
        found.update((m.start(), 0, m.end()) for m in LOOSE_EMAIL.finditer(text))
    found.update((m.start(), 1, m.end()) for m in IP.finditer(text))
    if "dot" in text or "[.]" in text or "(.)" in text:
        found.update((m.start(), 1, m.end()) for m in LOOSE_IP.finditer(text))
    found.update((m.start(), 2, m.end()) for m in LOOSE_CARD.finditer(text))
    found.update((m.start(), 3, m.end()) for m in LOOSE_PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 15)
    return sorted(s for s in found if s[1] or "@" in text[s[0]:s[2]] or "dot" in text[s[0]:s[2]] or "(at" in text[s[0]:s[2]] or "[at" in text[s[0]:s[2]])


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, without the sign its base rule asks for."""
    start, kind, end = span
    s = text[start:end].lstrip("+").replace("@", " ")
    digits = _digits(s)
    groups = re.split(r"[^0-9A-Za-z]+", s)
    before, after = text[max(0, start - 40):start], text[end:end + 40]
    near = before.lower()
    return [
        *(float(kind == k) for k in range(4)),
        float(len(s)), float(len(digits)), float(sum(c.isalpha() for c in s)), float(len(groups)), float(max(map(len, groups))),
        float(min(map(len, groups))), float(s.count(" ")), float(s.count("-")), float(s.count(".")), float(s.count("(") + s.count(")")),
        len(set(digits)) / (len(digits) or 1), float(bool(before) and not before[-1].isspace()), float(bool(after) and not after[0].isspace()),
        float(sum(c.isdigit() for c in before + after)),
        *(float(w in near) for w in WORDS),
    ]


def rewritten(s: str, kind: int) -> str | None:
    """A base span written so that its base rule doesn't see it; None where that would leave an ambiguous number."""
    way = zlib.crc32(s.encode("utf-8", "replace"))
    if kind == 0:
        at, dot = SPELLED[way % len(SPELLED)]
        local, domain = s.split("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return s.replace(".", ("[.]", "(.)", " dot ", "[dot]")[way % 4])
    if kind == 2:
        digits = _digits(s)
        return ("./"[way % 2]).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return s[1:] if len(_digits(s)) < len(s) - 1 else None


def plain(s: str, kind: int) -> str:
    """What the base rule is asked about a candidate: its spelled-out signs read back, its plus added if it has groups."""
    if kind < 2:
        return READ_AT.sub("@", READ_DOT.sub(".", s), count=1) if kind == 0 else READ_DOT.sub(".", s)
    if kind == 2:
        return _digits(s)
    return s if s.startswith("+") or s.isdigit() else "+" + s.lstrip("(")


def judged(text: str) -> Iterator[tuple[bool, bool, int, list[float]]]:
    """Whether positive, whether a base span, kind and features of the candidates, unknown ones left out, and of rewritings."""
    base = base_spans(text)
    known = set(base)
    for c in candidates(text):
        if c in known:
            yield True, True, c[1], features(text, c)
        elif not any(b[1] == c[1] for b in base_spans(plain(text[c[0]:c[2]], c[1]))):
            yield False, False, c[1], features(text, c)
    for start, kind, end in base:
        if new := rewritten(text[start:end], kind):
            before = text[max(0, start - 40):start]
            there = before + new + text[end:end + 40]
            c = (len(before), kind, len(before) + len(new))
            if c in candidates(there) and c not in base_spans(there):
                yield True, False, kind, features(there, c)


def _training_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text in frame["text"]:
            rows += [(float(good), x) for good, _, _, x in judged(text) if not _apart(x)]
        if rows:
            yield pd.DataFrame({"label": [r[0] for r in rows], "x": [r[1] for r in rows]})


def _apart(x: list[float]) -> bool:
    """Whether the trees don't learn from these features. Equal candidates, as exact copies make them, fall on the same side."""
    return zlib.crc32(np.array(x).tobytes()) % 4 == 0


def _counted(trees: Trees):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kinds, labels, rows = [], [], []
            for text, sampled in zip(frame["text"], frame["sampled"]):
                for good, seen, kind, x in judged(text):
                    if not seen and (not sampled or _apart(x)):
                        kinds.append(kind)
                        labels.append(good)
                        rows.append(x)
            if rows:
                bins = np.floor(trees.margin(np.array(rows)) * BINS).astype(np.int64)
                by, count = np.unique(np.stack([kinds, bins, labels], axis=1), axis=0, return_counts=True)
                yield pd.DataFrame({"kind": by[:, 0], "bin": by[:, 1], "accepted": by[:, 2] * count, "n": count})
    return run


@dataclass
class Trees:
    """Boosted trees as arrays: feature (-1: leaf), bound, left, right, value, weight of each tree; and thresholds by kind."""

    trees: list[tuple[np.ndarray, ...]]
    thresholds: list[float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, bound, left, right, value, weight in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] <= bound[node], left[node], right[node])
            total += weight * value[at]
        return total


def _arrays(root, weight: float) -> tuple:
    """A tree of pyspark.ml as arrays."""
    feature, bound, left, right, value = [], [], [], [], []

    def add(node) -> int:
        at = len(feature)
        for column, x in ((feature, -1), (bound, 0.0), (left, 0), (right, 0), (value, node.prediction())):
            column.append(x)
        if node.subtreeDepth():
            feature[at], bound[at] = node.split().featureIndex(), node.split().threshold()
            left[at] = add(node.leftChild())
            right[at] = add(node.rightChild())
        return at

    add(root)
    return (*map(np.array, (feature, bound, left, right, value)), weight)


def fit(docs: DataFrame, text_col: str = "text", max_docs: int = MAX_DOCS, precision: float = PRECISION) -> Trees:
    """Learn from the candidates of about ``max_docs`` documents, those with the smallest hashes; set thresholds on all. Runs Spark jobs."""
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    share = min(1.0, max_docs / max(1, texts.count()))
    sampled = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    learn = written(texts.filter(sampled).mapInPandas(_training_rows, "label double, x array<double>"), "pii-candidates")
    if learn.select("label").distinct().count() < 2:
        return Trees([], [float("inf")] * len(KINDS))
    rows = learn.select("label", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=7, maxBins=64).fit(rows.coalesce(4))
    fitted = Trees([_arrays(t._java_obj.rootNode(), w) for t, w in zip(model.trees, model.treeWeights)], [])
    counted = texts.withColumn("sampled", sampled).mapInPandas(_counted(fitted), "kind int, bin bigint, accepted bigint, n bigint")
    # Scores are bounded by the trees' leaves, so this has a few thousand rows at most.
    counts = counted.groupBy("kind", "bin").agg(F.sum("accepted").alias("accepted"), F.sum("n").alias("n")).toPandas()
    fitted.thresholds = [_threshold(counts[counts["kind"] == kind], precision) for kind in range(len(KINDS))]
    return fitted


def _threshold(counts: pd.DataFrame, precision: float) -> float:
    """The lowest score from which on enough candidates are accepted ones; ``counts`` has bin, accepted, n."""
    down = counts.sort_values("bin", ascending=False)
    right, total = down["accepted"].cumsum().to_numpy(), down["n"].cumsum().to_numpy()
    ok = np.flatnonzero((right >= precision * total) & (right >= 10))
    return float(down["bin"].iloc[ok[-1]]) / BINS if len(ok) else float("inf")


def all_spans(text: str, base: list[Span], trees: Trees) -> list[Span]:
    """Base spans and the candidates that the trees add."""
    if not trees.trees:
        return base
    taken = sorted((s[0], s[2]) for s in base)
    ends = np.maximum.accumulate([t[1] for t in taken]) if taken else []
    starts = [t[0] for t in taken]
    free = [c for c in candidates(text) if not (k := bisect.bisect_left(starts, c[2])) or ends[k - 1] <= c[0]]
    if not free:
        return base
    margin = trees.margin(np.array([features(text, c) for c in free]))
    best = sorted((-m, c) for m, c in zip(margin.tolist(), free) if m >= trees.thresholds[c[1]])
    used, added = [], []
    for _, c in best:
        k = bisect.bisect_left(used, (c[2],))
        if not k or used[k - 1][1] <= c[0]:
            bisect.insort(used, (c[0], c[2]))
            added.append(c)
    return sorted(base + added)


def _found(trees: Trees):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base = [base_spans(t) for t in frame["text"]]
            both = [all_spans(t, b, trees) for t, b in zip(frame["text"], base)]
            yield pd.DataFrame({"id": frame["id"], "base": [_form(b) for b in base], "spans": [_form(b) for b in both]})
    return run


def _form(spans: list[Span]) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]


def find(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``base`` and ``spans`` (arrays of kind, start, end)."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    span = "array<struct<kind:string,start:int,end:int>>"
    return texts.mapInPandas(_found(trees), f"id {texts.schema['id'].dataType.simpleString()}, base {span}, spans {span}")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every (kind, start, end) replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
