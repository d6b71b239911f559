"""Token ids in files compressed by an adaptive context-mixing range coder.

Documents in ascending order of id are turned into token ids, an end id after each, and packed into segments: rows of a
parquet table with the columns bucket, seq (their order), doc_ids, lengths, tokens and ``data``, which is

    magic "CMR1", block size, tokens, blocks, entries (4 x uint32), ids and frequencies of the order-0 table (uint32 and
    uint16 each, frequencies uint32 beyond 2**15 entries), digits and CRC-32 of the ids of each block (2 x uint32), then
    each block's digits (uint16). All numbers are little-endian.

A segment holds whole documents. Its ids are cut into blocks; every block is coded with a fresh model, so it can be
decoded alone, and is checked against its CRC. The model of a block:

* order 2 and order 1: a table by the last two ids (hashed) and one by the last id, each with the id that followed
  last and a confidence from 0 to 3. Both adapt with every id.
* order 0: the segment's id frequencies, stored ahead of its blocks. They are scaled to 2**16 or, beyond 2**15 different
  ids, to the power of two that leaves at least half of it to share out, so a segment may hold any number of them.
* mixing: for each state (both confidences, and whether both predict the same id) adaptive 12-bit weights say how much
  of the interval goes to the order-2 prediction, how much to the order-1 prediction, and what is left for order 0.

The interval drives a range coder with 64-bit bounds and digits of 16 bits. All blocks of a few segments are coded in
lockstep: one numpy operation does a step for every block, which makes an adaptive coder affordable in Python.

Ids are made from a tokenizer file word by word: texts are cut at ASCII white space, where this tokenizer always cuts,
and the different words are found in Arrow buffers. Simple words are lowered and cut into pieces here, and the library's
model encodes pieces not seen before, many in a call. Other words, or all if the file has other steps before its model,
are encoded by the whole tokenizer, many in a call, separated by a special token. Both are remembered up to a bound.

Defined cases: null is the empty text, which has the end id only; null document ids come first; equal ids are ordered by
text; an empty table makes an empty table of segments. A text of any length stays in one segment. Ids may be numbers or
texts (in code-point order); other columns are not looked at.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from clickloom.llm.common import if_small, with_ordered_bucket, written

MAGIC = b"CMR1"
BLOCK, SEGMENT = 4096, 4096 * 768
LANES = 768 * 2  # blocks coded side by side; the blocks of one segment are never parted
SLOTS1, SLOTS2 = 12, 13  # bits of the tables' sizes
KNOWN_WORDS = 400_000
TEXT_BYTES = 8_000_000  # of texts that are cut into words together
U64 = np.uint64
_LOW, _16, _48 = U64(1 << 48), U64(16), U64(48)


def _scale0(entries: int) -> tuple[int, str]:
    """Bits of the sum of the order-0 frequencies and the type each is stored as."""
    bits = max(16, 1 + (entries - 1).bit_length())
    return bits, "<u2" if bits == 16 else "<u4"


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and frequencies that sum to a power of two (see ``_scale0``); each at least 1, stored less 1."""
    known, count = np.unique(ids, return_counts=True)
    bits, kind = _scale0(len(known))
    freq = 1 + (count * ((1 << bits) - len(known))) // max(1, len(ids))
    if len(known):
        freq[np.argmax(count)] += (1 << bits) - freq.sum()
    return known.astype(np.uint32), (freq - 1).astype(kind)  # 2**16 itself must fit


#: Change of a confidence from 0 to 3, first after a wrong prediction, then after a right one.
_SURER = np.array([0, -1, -1, -1, 1, 1, 1, 0], np.int32)


class _Model:
    """Predictions and weights of ``n`` blocks side by side. In arrays of two rows the first is of order 1, the second of order 2."""

    def __init__(self, n: int):
        self.table = np.zeros((n << SLOTS1) + (n << SLOTS2), np.int32)  # id * 4 + confidence
        self.p2 = np.full(n * 32, 1024, np.int32)
        self.p1 = np.full(n * 32, 1024, np.int32)
        lanes = np.arange(n, dtype=np.int64)
        # The same slot of all blocks lies together, so that the frequent ones stay in the cache.
        self.n, self.places, self.off = n, np.stack([lanes, lanes + (n << SLOTS1)]), lanes * 32

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Where the table keeps what followed the ids ``one`` and, before it, ``two``; either for one step or for some."""
        at = np.empty((*one.shape[:-1], 2, one.shape[-1]), np.int64)
        at1, at2, last = at[..., 0, :], at[..., 1, :], one * 0x9E3779B1
        np.right_shift(last, 8, out=at1)
        at1 &= (1 << SLOTS1) - 1
        np.bitwise_xor(last, two * 0x85EBCA6B, out=at2)
        at2 >>= 7
        at2 &= (1 << SLOTS2) - 1
        at *= self.n
        at += self.places[:, :one.shape[-1]]
        return at

    def predict(self, at: np.ndarray) -> None:
        """Predicted ids ``said`` and weights ``w2``, ``w1``."""
        self.at, self.old = at, self.table[at]
        self.said, self.sure = self.old >> 2, self.old.astype(np.int8) & np.int8(3)
        ctx = (self.said[0] == self.said[1]).view(np.int8) << np.int8(4)
        self.ctx = self.off[:at.shape[1]] + (ctx + (self.sure[1] << np.int8(2)) + self.sure[0])
        self.w2, self.w1 = self.p2[self.ctx], self.p1[self.ctx]

    def update(self, ids: np.ndarray, right: np.ndarray) -> None:
        """``right``: which of ``said`` are the ids. A weight moves a sixteenth of its way to 4064 or 32, rounded towards itself."""
        goal = np.where(right, np.int32(4064), np.int32(47))
        self.p2[self.ctx] = self.w2 + ((goal[1] - self.w2) >> 4)
        self.p1[self.ctx] = self.w1 + ((goal[0] - self.w1) >> 4) * ~right[1]
        case = self.sure + (right.view(np.int8) << np.int8(2))
        new = self.old + _SURER.take(case)
        np.putmask(new, case == 0, ids << 2)  # for both rows
        self.table[self.at] = new


def _shares(w2: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit shares of order 1 and order 0. Weights are from 32 to 4064, so none of the shares is empty."""
    left = 4096 - w2
    share1 = np.maximum((left * w1) >> 12, 1)
    return share1, left - share1


class _Lanes:
    """The blocks of some segments, longest first, so that those that end leave from the end."""

    def __init__(self, totals: list[int], blocks: list[int]):
        self.count = [-(-t // b) for t, b in zip(totals, blocks)]
        size = np.array([min(b, t - s) for t, b in zip(totals, blocks) for s in range(0, t, b)], np.int64)
        self.order = np.argsort(-size, kind="stable")  # the block of each lane
        self.of_block = np.argsort(self.order)
        self.segment, self.size = np.repeat(np.arange(len(totals)), self.count)[self.order], size[self.order]
        self.steps = int(self.size[0]) if len(size) else 0
        self.live = np.searchsorted(-self.size, -np.arange(self.steps))  # lanes at each step

    def chunks(self) -> Iterator[tuple[int, int, int]]:
        """Ranges of steps with the same lanes, and their number; short enough for what is computed ahead to stay small."""
        step = 0
        while step < self.steps:
            n = int(self.live[step])
            end = min(int(self.size[n - 1]), step + max(1, 40_000 // n))
            yield step, end, n
            step = end


def encode_all(segments: list[np.ndarray], block: int = BLOCK) -> list[bytes]:
    """The ``data`` of each segment."""
    segments = [np.asarray(ids, np.uint32) for ids in segments]
    lanes, tables = _Lanes([len(ids) for ids in segments], [block] * len(segments)), [_order0(ids) for ids in segments]
    if not lanes.steps:
        return [MAGIC + struct.pack("<4I", block, 0, 0, 0) for _ in segments]
    freq0, cum0, first = [], [], [0]
    for known, less in tables:
        freq = np.zeros(int(known[-1]) + 1 if len(known) else 0, np.int64)
        freq[known] = less.astype(np.int64) + 1
        freq0.append(freq)
        cum0.append(np.cumsum(freq) - freq)
        first.append(first[-1] + len(freq))
    freq0, cum0, first = np.concatenate(freq0), np.concatenate(cum0), np.array(first)[lanes.segment]
    bits = np.array([_scale0(len(known))[0] for known, _ in tables])[lanes.segment]
    cut, whole = (12 + bits).astype(U64), 1 << bits
    n, steps = len(lanes.size), lanes.steps
    parts = [ids[at:at + block] for ids in segments for at in range(0, len(ids), block)]
    by_step = np.zeros((2 + steps, n), np.int32)  # ahead of the first ids two zeros, their context
    for begin in range(0, n, 64):
        some = np.zeros((min(64, n - begin), steps), np.int32)
        for row, k in zip(some, lanes.order[begin:begin + 64]):
            row[:len(parts[k])] = parts[k]
        by_step[2:, begin:begin + 64] = some.T
    model, low, span = _Model(n), np.zeros(n, U64), np.full(n, U64(2**64 - 1))
    width = steps // 2 + 64
    digits, begin = np.zeros(n * width, np.uint32), np.arange(n) * width
    at, live = begin.copy(), n
    for step, end, n in lanes.chunks():
        # A step leaves a span of at least 2**(36 - bits), which takes two digits up to 20 bits and three beyond.
        if (more := int((at - begin).max()) + 3 * (end - step) + 8 - width) > 0:
            digits = np.pad(digits.reshape(-1, width), ((0, 0), (0, more + width // 4))).reshape(-1)
            at += np.arange(len(at)) * (more + width // 4)
            width += more + width // 4
            begin = np.arange(len(at)) * width
        if n < live:
            _flush(low[n:live], digits, at[n:live])
            live = n
        x = by_step[step:end + 2, :n].astype(np.int64)
        slots, right = model.slots(x[1:-1], x[:-2]), np.empty((end - step, 2, n), bool)
        w2, w1 = np.empty((2, end - step, n), np.int32)
        for k in range(end - step):
            ids = by_step[2 + step + k, :n]
            model.predict(slots[k])
            np.equal(model.said, ids, out=right[k])
            w2[k], w1[k] = model.w2, model.w1
            model.update(ids, right[k])
        share1, share0 = _shares(w2, w1)
        hit2, hit = right[:, 1], right[:, 0] | right[:, 1]
        share = np.where(hit2, w2, np.where(hit, share1, share0)).astype(np.int64)
        ahead = np.where(hit2, 0, np.where(hit, w2, w2 + share1)).astype(np.int64)
        x = x[2:] + first[:n]
        start = ((ahead << bits[:n]) + share * np.where(hit, 0, cum0[x])).astype(U64)
        size = (share * np.where(hit, whole[:n], freq0[x])).astype(U64)
        low, span, at_, cut_ = low[:n], span[:n], at[:n], cut[:n]
        for k in range(end - step):
            unit = span >> cut_
            moved = low + unit * start[k]
            carry = np.flatnonzero(moved < low)
            if len(carry):
                digits[at_[carry] - 1] += 1
            low, span = moved, unit * size[k]
            short = span < _LOW
            while short.any():
                digits[at_] = low >> _48  # where no digit is due, the next one takes its place
                at_ += short
                by = short * _16
                low <<= by
                span <<= by
                short = span < _LOW
    del model, by_step
    _flush(low, digits, at[:live])
    of_lane = digits.reshape(-1, width)
    _carried(of_lane[:, :int((at - begin).max())])
    out, lane, used = [], iter(lanes.of_block), at - begin
    for ids, (known, less), n in zip(segments, tables, lanes.count):
        mine, raw = list(itertools.islice(lane, n)), ids.astype("<u4")
        heads = np.array([[used[j], zlib.crc32(raw[k * block:(k + 1) * block])] for k, j in enumerate(mine)], "<u4")
        table = known.astype("<u4").tobytes() + less.tobytes()
        body = b"".join(of_lane[j, :used[j]].astype("<u2").tobytes() for j in mine)
        out.append(MAGIC + struct.pack("<4I", block, len(ids), n, len(known)) + table + heads.tobytes() + body)
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The ``data`` of a segment."""
    return encode_all([ids], block)[0]


def _flush(low: np.ndarray, digits: np.ndarray, at: np.ndarray) -> None:
    for shift in (48, 32, 16, 0):
        digits[at] = (low >> U64(shift)) & U64(0xFFFF)
        at += 1


def _carried(digits: np.ndarray) -> None:
    """Add what digits have beyond 16 bits to those before them."""
    while len(rows := np.flatnonzero((digits > 0xFFFF).any(axis=1))):
        for k in rows:
            over = digits[k] > 0xFFFF
            digits[k] -= over.astype(np.uint32) << np.uint32(16)
            digits[k, :-1] += over[1:]


def decode_all(segments: list[bytes]) -> list[np.ndarray]:
    """The ids of each segment; raises ValueError where a block does not match its checksum."""
    totals, blocks, heads, known, freq, streams = [], [], [], [], [], []
    for data in segments:
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        block, total, n, entries = struct.unpack_from("<4I", data, 4)
        kind = _scale0(entries)[1]
        at = 20 + (4 + np.dtype(kind).itemsize) * entries
        totals.append(total)
        blocks.append(block)
        known.append(np.frombuffer(data, "<u4", entries, 20).astype(np.int32))
        freq.append(np.frombuffer(data, kind, entries, 20 + 4 * entries).astype(np.int64) + 1)
        heads.append(np.frombuffer(data, "<u4", 2 * n, at).reshape(n, 2).astype(np.int64))
        streams.append(np.frombuffer(data[at + 8 * n:], "<u2"))
    lanes = _Lanes(totals, blocks)
    n, steps = len(lanes.size), lanes.steps
    if not steps:
        return [np.empty(0, np.uint32) for _ in segments]
    entry, begin = np.cumsum([0, *map(len, known)]), np.cumsum([0, *map(len, streams)])
    of_slot = np.concatenate([np.repeat(np.arange(e, e + len(f), dtype=np.int32), f) for e, f in zip(entry, freq)])
    slot0 = np.cumsum([0, *(int(f.sum()) for f in freq)])[lanes.segment]
    bits = np.array([_scale0(len(k))[0] for k in known])[lanes.segment]
    cut, most, bits = (12 + bits).astype(U64), ((1 << bits) - 1).astype(U64), bits.astype(U64)
    cum, freq, known = np.concatenate([np.cumsum(f) - f for f in freq]).astype(U64), np.concatenate(freq).astype(U64), np.concatenate(known)
    pos = np.concatenate([b + np.cumsum(h[:, 0]) - h[:, 0] for b, h in zip(begin, heads)])[lanes.order]
    stream = np.concatenate([*streams, np.zeros(8, np.uint16)])  # damaged blocks may run on; their checksum tells
    model, span, code = _Model(n), np.full(n, U64(2**64 - 1)), np.zeros(n, U64)
    for _ in range(4):
        code = (code << _16) | stream.take(pos, mode="clip")
        pos += 1
    by_step = np.empty((steps, n), np.int32)
    one = two = np.zeros(n, np.int64)
    for step in range(steps):
        if lanes.live[step] < n:
            n = int(lanes.live[step])
            span, code, pos, one, two = span[:n], code[:n], pos[:n], one[:n], two[:n]
            cut, most, bits, slot0 = cut[:n], most[:n], bits[:n], slot0[:n]
        model.predict(model.slots(one, two))
        share1, share0 = _shares(model.w2, model.w1)
        unit = span >> cut
        wide, each = unit << bits, unit * share0.astype(U64)
        up2 = wide * model.w2.astype(U64)
        span1 = wide * share1.astype(U64)
        up1 = up2 + span1
        hit2, hit, rest = code < up2, code < up1, code - up1
        k = of_slot[np.minimum(rest // each, most).astype(np.int64) + slot0]
        x = np.where(hit2, model.said[1], np.where(hit, model.said[0], known[k]))
        code = np.where(hit2, code, np.where(hit, code - up2, rest - each * cum[k]))
        span = np.where(hit2, up2, np.where(hit, span1, each * freq[k]))
        model.update(x, model.said == x)
        by_step[step, :n] = x
        one, two = x.astype(np.int64), one
        short = span < _LOW
        while short.any():
            by = short * _16
            code <<= by
            code |= stream.take(pos, mode="clip") * short
            pos += short
            span <<= by
            short = span < _LOW
    del model
    parts: list = [None] * len(lanes.size)
    for begin in range(0, len(parts), 64):
        some = np.ascontiguousarray(by_step[:, begin:begin + 64].T).astype("<u4")
        for ids, k, size in zip(some, lanes.order[begin:begin + 64], lanes.size[begin:begin + 64]):
            parts[k] = ids[:size]
    out, part = [], iter(parts)
    for head in heads:
        mine = list(itertools.islice(part, len(head)))
        for k, ids in enumerate(mine):
            if zlib.crc32(ids) != head[k, 1]:
                raise ValueError(f"block {k} does not match its checksum")
        out.append(np.concatenate(mine) if mine else np.empty(0, np.uint32))
    return out


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError where a block does not match its checksum."""
    return decode_all([data])[0]


#: Words for which the tokenizer's own steps before its model are simple: Latin letters, digits and signs that are
#: normalised by lowering, without the apostrophes and brackets that its patterns and special tokens start with.
SIMPLE = "^[!-&(-;=-~\u00a1-\u00ac\u00ae-\u012f\u0132-\u01c3]+$"
#: The steps this holds for. With others, no word is simple.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def _cutter() -> re.Pattern:
    """Cuts lowered simple words into pieces, and keeps the line ends between them."""
    chars = sorted(set("".join(map(chr, range(33, 0x1C4))).lower()))
    letters, digits = (re.escape("".join(c for c in chars if unicodedata.category(c)[0] == kind)) for kind in "LN")
    return re.compile(f"[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+|\n")


def _words(texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    is_space = np.zeros(256, bool)
    is_space[[9, 10, 11, 12, 13, 32]] = True
    space, first, last = is_space[data], np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:], last[:-1] = space[:-1], space[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    first[edges] = last[edges - 1] = True
    first, last = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space)
    offsets = np.append(0, np.cumsum(last - first + 1))
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])
    return words, np.diff(np.searchsorted(first, ends))


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin there and have that size, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Texts to ids, by a tokenizer file that cuts at white space and knows ``separator``."""

    def __init__(self, path: str, separator: str = "<|startoftext|>"):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.separator, self.mark = separator, self.tokenizer.token_to_id(separator)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        suffix = steps["model"].get("end_of_word_suffix")
        self.has_simple = bool(suffix) and all(steps[name] == STEPS[name] for name in STEPS)
        if self.has_simple:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = CharDelimiterSplit(" ")
            # How byte-level tokenizers write bytes as characters. The blank stays, to cut at.
            hidden = [b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)}]
            self.letters = {b: 256 + k for k, b in enumerate(hidden) if b != 32}
            self.is_last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.is_last[[i for token, i in steps["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.cut = _cutter()
        self.forget()

    def forget(self) -> None:
        self.known = {"\n": 0}  # pieces, and words that are not simple with a blank ahead -> their places in ``begin`` and ``size``
        self.flat, self.begin, self.size = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, names: list[str], ids: list[np.ndarray], size: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names))))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
        self.size, self.flat = np.append(self.size, size), np.concatenate([self.flat, *ids])

    def learn_pieces(self, pieces: list[str]) -> None:
        texts = (" ".join(pieces[k:k + 200]) for k in range(0, len(pieces), 200))
        texts = (t if t.isascii() else t.encode().decode("latin-1").translate(self.letters) for t in texts)
        ids = [np.array(self.model.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in texts]
        size = np.diff(np.flatnonzero(self.is_last[np.concatenate(ids)]), prepend=-1)
        if len(size) != len(pieces):
            raise ValueError("the tokenizer's model does not end pieces with its suffix")
        self.learn(pieces, ids, size)

    def learn_words(self, words: list[str]) -> None:
        plain = [w for w in words if self.separator not in w]
        for some in [plain[k:k + 2000] for k in range(0, len(plain), 2000)] + [[w] for w in words if self.separator in w]:
            ids = np.array(self.tokenizer.encode(self.separator.join(some), add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(ids == self.mark) if len(some) > 1 else np.empty(0, np.int64)
            size = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
            self.learn([" " + w for w in some], [np.delete(ids, at)], size)

    def encode(self, texts: pa.LargeStringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id after each, and how many each has."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        words, count = _words(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_string())
        simple = pc.match_substring_regex(distinct, SIMPLE) if self.has_simple else pa.repeat(False, len(distinct))
        plain = distinct.filter(pc.invert(simple)).to_pylist()
        lines = [*distinct.filter(simple).to_numpy(zero_copy_only=False).tolist(), ""]
        pieces = self.cut.findall("\n".join(lines).lower())  # a line end after each word
        pieces = pa.array(pieces, pa.large_string()).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [p for p in names if p not in self.known]:
            self.learn_pieces(new)
        if new := [w for w in plain if " " + w not in self.known]:
            self.learn_words(new)
        rows = np.fromiter(map(self.known.__getitem__, names), np.int64)[pieces.indices.to_numpy()]
        rows = np.append(rows, np.array([k for w in plain for k in (self.known[" " + w], 0)], np.int64))
        size = self.size[rows]
        ends = np.cumsum(size)[rows == 0]
        flat = np.append(_gathered(self.flat, self.begin[rows], size), np.uint32(end_id))
        size, is_simple = np.append(np.diff(ends, prepend=0), 1), simple.to_numpy(zero_copy_only=False)
        place = np.where(is_simple, np.cumsum(is_simple), np.cumsum(~is_simple) + (len(lines) - 1)) - 1
        at = np.insert(place[coded.indices.to_numpy()], np.cumsum(count), len(distinct))
        begin, size = (np.cumsum(size) - size)[at], size[at]
        after = np.append(0, np.cumsum(size))[np.cumsum(count + 1)]
        return _gathered(flat, begin, size), np.diff(after, prepend=0)


def _slices(texts: pa.LargeStringArray) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of texts with ``TEXT_BYTES`` bytes, about."""
    start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(start, start[at] + TEXT_BYTES, side="right")) - 1)
        yield at, end
        at = end


def _written_segments(path: str, end_id: int, most: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, bucket, seq, size = Encoder(path), [], None, 0, 0
        full, blocks = [], 0

        def close() -> None:
            nonlocal held, size, blocks
            full.append((bucket, seq, [d for d, _ in held], np.concatenate([ids for _, ids in held])))
            full[-1] += ([len(ids) for _, ids in held],)
            blocks += -(-size // BLOCK)
            held, size = [], 0

        def rows() -> pa.RecordBatch:
            nonlocal blocks
            data = encode_all([ids for _, _, _, ids, _ in full])
            out = [(b, s, docs, lengths, len(ids), d) for (b, s, docs, ids, lengths), d in zip(full, data)]
            full.clear()
            blocks = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            buckets, docs = batch.column("bucket").to_pylist(), batch.column("id").to_pylist()
            for start, end in _slices(texts):
                ids, lengths = encoder.encode(texts.slice(start, end - start), end_id)
                ends = np.cumsum(lengths).tolist()
                for b, doc, first, last in zip(buckets[start:end], docs[start:end], [0, *ends], ends):
                    if held and (b != bucket or size + last - first > most):
                        if blocks and blocks - (-size // BLOCK) > LANES:
                            yield rows()
                        close()
                        seq = seq + 1 if b == bucket else 0
                    bucket = b
                    held.append((doc, ids[first:last]))
                    size += last - first
        if held:
            close()
        if full:
            yield rows()
    return run


def write(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Write the segments below the scratch folder and return the table read back. Runs Spark jobs when called."""
    numbers = isinstance(docs.schema[id_col].dataType, NumericType)
    kind, arrow = ("bigint", pa.int64()) if numbers else ("string", pa.string())
    texts = docs.select(F.col(id_col).cast(kind).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    placed = with_ordered_bucket(texts, "id", "bucket", "text")
    dealt = placed.repartition("bucket").sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "text")
    schema = f"bucket int, seq int, doc_ids array<{kind}>, lengths array<bigint>, tokens bigint, data binary"
    rows = pa.schema({
        "bucket": pa.int32(), "seq": pa.int32(), "doc_ids": pa.list_(arrow), "lengths": pa.list_(pa.int64()), "tokens": pa.int64(), "data": pa.binary(),
    })
    return written(dealt.select("bucket", "id", "text").mapInArrow(_written_segments(tokenizer_path, end_id, segment, rows), schema), "token-ids")


def _read_documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, blocks = [], 0

    def documents() -> Iterator[pd.DataFrame]:
        for (bucket, seq, lengths, _), ids in zip(held, decode_all([data for *_, data in held])):
            raw, ends = ids.tobytes(), np.cumsum(lengths)
            begin = ends - lengths
            crc = [zlib.crc32(raw[4 * b:4 * e]) for b, e in zip(begin.tolist(), ends.tolist())]
            yield pd.DataFrame({"bucket": bucket, "seq": seq, "place": range(len(crc)), "offset": begin, "n_tokens": lengths, "crc": crc})

    for frame in frames:
        for row in zip(frame["bucket"], frame["seq"], frame["lengths"], frame["data"]):
            mine = struct.unpack_from("<I", row[3], 12)[0]
            if held and blocks + mine > LANES:
                yield from documents()
                held, blocks = [], 0
            held.append(row)
            blocks += mine
    yield from documents()


def read_index(segments: DataFrame) -> DataFrame:
    """Decode all segments: doc_id, start (ids before the document in the whole table), n_tokens, ids_crc32.

    Sums of buckets, a few for each partition, are added up in one place; the rest happens within a bucket or segment.
    """
    sizes = segments.select("bucket", "seq", "tokens", "doc_ids")
    of_bucket = sizes.groupBy("bucket").agg(F.sum("tokens").alias("all"))
    before = of_bucket.select("bucket", (F.sum("all").over(W.orderBy("bucket")) - F.col("all")).alias("before"))
    along = W.partitionBy("bucket").orderBy("seq")
    begun = written(sizes.join(before, "bucket").select(
        "bucket", "seq", (F.col("before") + F.sum("tokens").over(along) - F.col("tokens")).alias("begin")), "segment-starts")
    schema = "bucket int, seq int, place int, offset bigint, n_tokens bigint, crc bigint"
    decoded = segments.select("bucket", "seq", "lengths", "data").mapInPandas(_read_documents, schema)
    named = segments.select("bucket", "seq", F.posexplode("doc_ids").alias("place", "doc_id"))
    met = decoded.join(named, ["bucket", "seq", "place"]).join(if_small(begun), ["bucket", "seq"])
    return met.select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))
