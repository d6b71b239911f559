"""Token counts by a linear longest-match automaton.

A word is cut greedily: always the longest piece of the vocabulary that the rest of the word begins with. Only the number
of pieces is wanted, so none is built:

* The vocabulary is a trie over bytes; a piece that ends a word ends with the symbol END.
* Each node has a failure link to the node for what is left of its string after the greedy pieces are taken off, as far
  as they are already certain, and the precomputed number of pieces that are taken off on the way.
* A word is read once, byte by byte: along the trie where it goes on, else along failure links, adding their counts.
  Every link shortens the string that is still open, so the time is proportional to the word's length.

A byte that no piece begins with makes the word unknown: one piece, as word-piece tokenizers do. The vocabulary of the
tokenizer file has all bytes, alone and at the end of a word, so this does not occur with it.

Words are cut at ASCII white space, ASCII letters lowered, and go over as UTF-8 bytes. Words seen before are remembered
up to a bound. The automaton is sent to all tasks; it grows with the vocabulary file only.

Defined cases: null, empty and blank texts have no words and no tokens; a text or word of any length is counted whole;
equal rows get equal counts each; a null id is an id.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 256
KNOWN_WORDS = 400_000
WORD_END = "</w>"


def vocabulary(tokenizer_path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level tokenizer file as tuples of bytes, with END where the piece ends a word."""
    with open(tokenizer_path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"] for t in file.get("added_tokens", ())}
    # How byte-level tokenizers write bytes as characters.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    pieces = []
    for token in file["model"]["vocab"]:
        if token not in special:
            stem = token.removesuffix(WORD_END)
            pieces.append((*(byte[c] for c in stem), *([END] if stem != token else [])))
    return pieces


class Automaton:
    """``step``: (node * 257 + symbol) -> node; ``link`` and ``taken`` of every node; node 0 is the root."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.step: dict[int, int] = {}
        parent, symbol, whole = [0], [0], [False]
        for piece in pieces:
            node = 0
            for c in piece:
                key = node * 257 + c
                if key not in self.step:
                    self.step[key] = len(parent)
                    parent.append(node)
                    symbol.append(c)
                    whole.append(False)
                node = self.step[key]
            whole[node] = bool(piece)
        self.link, self.taken = [-1] * len(parent), [0] * len(parent)
        # Children were numbered after their parents, but links need breadth-first order.
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if whole[v]:
                self.link[v], self.taken[v] = 0, 1
                continue
            z, n = self.link[parent[v]], self.taken[parent[v]]
            while z >= 0 and z * 257 + symbol[v] not in self.step:
                n += self.taken[z]
                z = self.link[z]
            if z >= 0:
                self.link[v], self.taken[v] = self.step[z * 257 + symbol[v]], n

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of a word; 1 if it cannot be cut."""
        step, link, taken, node, n = self.step, self.link, self.taken, 0, 0
        for c in (*word, END):
            while (to := step.get(node * 257 + c, -1)) < 0:
                n += taken[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node:
            n += taken[node]
            node = link[node]
            if node < 0:
                return 1
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = n = self.automaton.count(word)
        return n


def _counted(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(())
        automaton.step, automaton.link, automaton.taken = shared.value
        known = _Counts(automaton)
        for frame in frames:
            words = [(t or "").encode("utf-8", "replace").lower().split() for t in frame["text"]]
            tokens = [sum(map(known.__getitem__, w)) for w in words]
            yield pd.DataFrame({"id": frame["id"], "n_words": np.array(list(map(len, words)), np.int64), "n_tokens": np.array(tokens, np.int64)})
    return run


def count(docs: DataFrame, pieces: Iterable[tuple[int, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_tokens."""
    automaton = Automaton(pieces)
    shared = docs.sparkSession.sparkContext.broadcast((automaton.step, automaton.link, automaton.taken))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(_counted(shared), f"id {texts.schema['id'].dataType.simpleString()}, n_words bigint, n_tokens bigint")
