"""Problem 6: the corpus as token ids of a public byte-level BPE vocabulary.

Method: a tokenization automaton. It starts as one state with an arc for each byte. The merges are worked in, in order
of rank, by one gadget each: for (u, v) -> w, every path p -u-> q -v-> r gets an arc p -w-> r, and the arcs labelled u
are led to a copy of q that has no arc v. After all merges the automaton accepts just the token sequences that the
vocabulary makes. All arcs with one label lead to one state, so a state is named by the label that led there; a copy
differs from its original by one missing arc, so the states are kept as the arcs they lost and when, and an arc that
is asked for is worked out once and then kept in the transition table. A word is encoded by following, from each place
in it, the arcs whose label stands there; one path reaches the end. Decoding emits the labels of the arcs.

The words come from the vocabulary's public split pattern. Defined results: an empty list for an empty or null text;
texts of any length are encoded whole; repeated rows give their row again; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 1 << 19  # a worker's table of encoded words is begun anew beyond this many
NEVER = 1 << 60


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file of a public vocabulary: in $SAMEWISE_TOKENIZERS if that is set, else in the installed package."""
    folder = os.environ.get("SAMEWISE_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each token, by id, from a file of base64 tokens and ranks."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    return [found[k] for k in range(len(found))]


class Automaton:
    """The states and arcs for a vocabulary; ``tokens``: the bytes of each token in order of rank."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: k for k, t in enumerate(tokens)}
        self.longest = max(map(len, tokens), default=0)
        self.left, self.right = [-1] * len(tokens), [-1] * len(tokens)
        self.lost: dict[int, dict[int, int]] = {}  # of the state that label u leads to: the arcs it lost, and at which rank
        self.arcs: dict[int, bool] = {}
        for w, t in enumerate(tokens):
            if len(t) > 1:
                self._gadget(w, t)

    def _gadget(self, w: int, text: bytes) -> None:
        """Works in the merge that makes token w: its two parts are the path that the automaton so far accepts."""
        path = self._path(text, w)
        if len(path) != 2:
            raise ValueError(f"token {w} isn't a merge of two earlier tokens")
        self.left[w], self.right[w] = path
        self.lost.setdefault(path[0], {})[path[1]] = w

    def has_arc(self, state: int, label: int, before: int = NEVER) -> bool:
        """Whether the state that label ``state`` leads to has an arc ``label``, when the merges below ``before`` are in.

        The state began as a copy for its last part, and that for its own last part: what each lost until it was copied
        is lost. The arc was added where there was one for its first part, and so on down.
        """
        u, copied = state, before
        while u >= 0:
            if (lost := self.lost.get(u)) is not None:
                x, added = label, before - 1
                while x >= 0:
                    if (at := lost.get(x)) is not None and at < copied and at <= added:
                        return False
                    x, added = self.left[x], x
            u, copied = self.right[u], u
        return True

    def _path(self, word: bytes, before: int = NEVER) -> list[int]:
        ids, arcs, final = self.ids, self.arcs, before == NEVER
        last, back = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ids.get(word[start:end])
                if token is None or token >= before or start and last[start] < 0:
                    continue
                if start:
                    if final:
                        key = last[start] << 32 | token
                        if (ok := arcs.get(key)) is None:
                            ok = arcs[key] = self.has_arc(last[start], token)
                    else:
                        ok = self.has_arc(last[start], token, before)
                    if not ok:
                        continue
                last[end], back[end] = token, start
                break
        path, end = [], len(word)
        while end:
            if last[end] < 0:
                raise ValueError("a byte isn't in the vocabulary")
            path.append(last[end])
            end = back[end]
        return path[::-1]

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The ids of a word."""
        return tuple(self._path(word))

    def decode(self, ids) -> bytes:
        """The labels of the arcs, one after another."""
        return b"".join(self.tokens[k] for k in ids)


class _Words(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(self.automaton.arcs) >= 4 * KEPT_WORDS:
            self.automaton.arcs.clear()
        ids = self[word] = self.automaton.encode(word.encode("utf-8", "surrogatepass"))
        return ids


def encode_text(words: _Words, text: str | None, split) -> list[int]:
    return list(chain.from_iterable(map(words.__getitem__, split(text)))) if text else []


@cache
def _compiled(path: str) -> Automaton:
    return Automaton(read_ranks(path))


def tokenize(texts: DataFrame, key: str, text: str, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``key, ids`` for each row. The automaton is compiled once on the driver and broadcast; its size is the vocabulary's."""
    compiled = _compiled(path or vocabulary_path())
    shared = texts.sparkSession.sparkContext.broadcast(compiled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        words = getattr(automaton, "words", None)  # lives on with the worker
        if words is None:
            words = automaton.words = _Words(automaton)
        split = regex.compile(pattern).findall
        get = words.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat, ends = array("i"), [0]
                for t in part.column(1).to_pylist():
                    if t:
                        flat.extend(chain.from_iterable(map(get, split(t))))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
