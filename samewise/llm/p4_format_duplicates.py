"""Problem 4: records that say the same in another format.

Method: the characters of a text stream through a skip-and-fold table (what is no letter or digit is skipped, the rest
folded to lower case) into rolling polynomial hashes; no canonical string is made. Rows whose two hashes agree are
then compared with two pointers that skip and fold as they go. A content that consists of fields only is hashed as the
sum over its fields, so their order and notation do not count.

Texts move only to be compared: hashes are counted first, and of the texts only those go on whose hash is in a bitmap of the
hashes that several rows have (see _bitmap: its size is bounded).

Defined results: null keys and contents, and contents without any word, are left out; repeated rows of an id count
once; texts of any length are hashed and compared whole; other columns of the input are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import HOT_ROWS, lookup, materialise, small
from . import _text as T
from ._bitmap import bitmap, passes

SET_ROWS = 2000  # rows of a set that are compared in one task; a larger set is split
PIECE = 4096  # characters each pointer advances by in the comparison
_FIELD = re.compile(r"\s*([^\s:=]+)(?::|\s*=)(?:\s+(.*))?", re.S)
_LINES = re.compile(r"\r\n|\r|\n")
_WORD = re.compile(r"[^\W_]")
_AROUND = re.compile(r"\A[\s﻿]+|[\s﻿]+\Z")


@cache
def fold_table() -> np.ndarray:
    """For each code point the one it is folded to, or 0 if it is skipped. Both small sigmas are one letter."""
    table = np.zeros(T.CODE_POINTS, np.uint32)
    for c in np.flatnonzero(T.is_word_char()).tolist():
        table[c] = ord(chr(c).lower()[0])
    table[ord("ς")] = ord("σ")
    return table


def _flatten(value) -> str:
    """The text of a field's value: scalars as written, members of nested values in order."""
    if isinstance(value, tuple):
        return " ".join(f"{k} {_flatten(v)}" for k, v in value)
    if isinstance(value, list):
        return " ".join(map(_flatten, value))
    return {None: "null", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else value


def fields(text: str) -> list[tuple[str, str]] | None:
    """Key and value of each field if the text consists of fields only, else None."""
    body = _AROUND.sub("", text)
    if body.startswith("{"):
        try:
            found = json.loads(body, object_pairs_hook=tuple, parse_int=str, parse_float=str, parse_constant=str)
        except (ValueError, RecursionError):
            return None
        return [(k, _flatten(v)) for k, v in found] or None
    found = []
    for line in _LINES.split(body):
        if _WORD.search(line):
            m = _FIELD.fullmatch(_AROUND.sub("", line))
            if not m or not _WORD.search(m[1]):
                return None
            found.append((m[1], m[2] or ""))
    return found if len(found) >= 2 else None


def stream_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of the words of each text, and the number of word characters it has."""
    data, begins = T.code_points(texts)
    folded = fold_table()[data]
    kept = folded != 0
    first = kept & ~np.concatenate(([False], kept[:-1]))
    at = np.flatnonzero(kept)
    # the start of a word is one more symbol before its first letter
    value = T.char_values()[folded[at]]
    with np.errstate(over="ignore"):
        value = np.where(first[at], value + np.uint64(0xA24BAED4963EE407), value)
    ends = np.searchsorted(at, begins)
    one = T.span_hashes(value, ends[:-1], ends[1:])
    two = T.span_hashes(T.mix(value, 3), ends[:-1], ends[1:], T.WORD_BASE)
    return T.mix(one, 11), T.mix(two, 12), np.diff(ends)


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As stream_hashes, but texts of fields only are hashed field by field and summed."""
    one, two, n = stream_hashes(texts)
    split = [(i, f) for i, t in enumerate(texts) if (f := fields(t))]
    if split:
        a, b, m = stream_hashes([x for _, f in split for kv in f for x in kv])
        with np.errstate(over="ignore"):
            pair = [T.mix(h[::2] * np.uint64(3) + h[1::2], 21) for h in (a, b)]
            stops = np.cumsum([0, *(len(f) for _, f in split)])
            rows = np.array([i for i, _ in split])
            for out, h in ((one, pair[0]), (two, pair[1])):
                out[rows] = T.mix(np.add.reduceat(h, stops[:-1]), 22)
        n[rows] = np.add.reduceat(m, 2 * stops[:-1])
    return one, two, n


def same_words(a: str, b: str) -> bool:
    """Whether two texts have the same words in the same order, by two pointers that skip what is in no word."""

    def pieces(text: str) -> Iterator[np.ndarray]:
        inside = False
        for i in range(0, len(text), PIECE):
            folded = fold_table()[np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
            kept = folded != 0
            first = kept & ~np.concatenate(([inside], kept[:-1]))
            inside = bool(kept[-1])
            yield folded[kept].astype(np.int64) | first[kept].astype(np.int64) << 32

    none = np.zeros(0, np.int64)
    left, right, x, y = pieces(a), pieces(b), none, none
    while True:
        while not len(x) and (x := next(left, None)) is not None and not len(x):
            pass
        while not len(y) and (y := next(right, None)) is not None and not len(y):
            pass
        if x is None or y is None:
            return x is None and y is None
        k = min(len(x), len(y))
        if not np.array_equal(x[:k], y[:k]):
            return False
        x, y = x[k:], y[k:]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What the two pointers stop at: the folded word characters of the texts, the first of each word marked, and where
    those of each text begin."""
    data, begins = T.code_points(texts)
    folded = fold_table()[data]
    kept = folded != 0
    first = kept & ~np.concatenate(([False], kept[:-1]))
    at = np.flatnonzero(kept)
    return folded[at] | first[at].astype(np.uint32) << 31, np.searchsorted(at, begins)


def _sayings(texts: list[str]) -> list[tuple | None]:
    """For texts of fields only, the symbols of their fields in an order of their own; None for all others."""
    split = [fields(t) for t in texts]
    flat = [x for f in split if f for kv in f for x in kv]
    marks, bounds = symbols(flat)
    parts = iter([marks[a:z].tobytes() for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
    return [tuple(sorted((next(parts), next(parts)) for _ in f)) if f else None for f in split]


def same(a: str, b: str) -> bool:
    """Whether two texts say the same: the fields if both have only fields, else the words in order."""
    if a == b:
        return True
    f, g = _sayings([a, b])
    return f == g if f or g else same_words(a, b)


def same_as_first(texts: list[str], first: np.ndarray) -> np.ndarray:
    """Whether each text says the same as the one numbered ``first`` for it: all texts at once."""
    sayings = _sayings(texts)
    marks, bounds = symbols(texts)
    size = np.diff(bounds)
    own = np.arange(len(texts))
    by_fields = np.array([s is not None for s in sayings], bool)
    out = ~by_fields & ~by_fields[first] & (size == size[first])
    walk = np.flatnonzero(out & (first != own) & (size > 0))
    if len(walk):
        n = size[walk]
        begin = np.cumsum(n) - n
        here = np.arange(int(n.sum())) - np.repeat(begin - bounds[walk], n)
        out[walk] = np.logical_and.reduceat(marks[here] == marks[here - np.repeat(bounds[walk] - bounds[first[walk]], n)], begin)
    both = np.flatnonzero(by_fields & by_fields[first])
    out[both] = [sayings[k] == sayings[f] for k, f in zip(both.tolist(), first[both].tolist(), strict=True)]
    return out


_LIGHT = ["src", "id", "h1", "h2"]


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for i, j in T.blocks(texts):
            one, two, n = hashes(texts[i:j])
            keep = np.flatnonzero(n)
            at = pa.array(keep + i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(one[keep].view(np.int64)), pa.array(two[keep].view(np.int64))], _LIGHT)


def _filtered_rows(shared):
    """Rows with their texts whose first hash is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, j in T.blocks(texts):
                one, two, n = hashes(texts[i:j])
                keep = np.flatnonzero((n > 0) & passes(bits, one))
                at = pa.array(keep + i)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:3]), pa.array(one[keep].view(np.int64)), pa.array(two[keep].view(np.int64))], ["src", "id", "text", "h1", "h2"])

    return run


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (src, h1, h2, salt, id): each is compared with the first text of its hashes, a block at once; what
    differs from it, as only colliding hashes do, with the firsts of further classes. Gives each id once with its class's
    first, smallest, id; the text too for the first row of a class whose set is split over several tasks."""
    at, firsts, last = None, [], None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for i, j in T.blocks(columns[2]):
            src, ids, texts, h1, h2, salt, split = (c[i:j] for c in columns)
            keys = list(zip(src, h1, h2, salt, strict=True))
            held = [firsts[0][1]] if firsts and keys[0] == at else []  # the open set's first text
            number, first = -1, []
            for k, key in enumerate(keys):
                if key != (keys[k - 1] if k else at if held else None):
                    number = k + len(held)
                first.append(max(number, 0))
            hit = same_as_first(held + texts, np.array([0] * len(held) + first))[len(held) :]
            out = []
            for k, key in enumerate(keys):
                if key != at:
                    at, firsts, last = key, [], None
                if ids[k] == last:
                    continue
                last = ids[k]
                of = firsts[0] if firsts and hit[k] else next((f for f in firsts if same(f[1], texts[k])), None)
                if of is None:
                    firsts.append(of := (ids[k], texts[k]))
                out.append((src[k], ids[k], h1[k], h2[k], of[0], texts[k] if split[k] and of[0] == ids[k] else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["src", "id", "h1", "h2", "first", "text"])


_SET = ["src", "h1", "h2"]
_ROW = ["src", "id", "text", "h1", "h2", "salt", "split"]


def _verify(rows: DataFrame) -> DataFrame:
    by = [*_SET, "salt"]
    rows = rows.select(_ROW).repartition(*by).sortWithinPartitions(*by, "id")
    return rows.mapInArrow(_verify_rows, "src string, id string, h1 long, h2 long, first string, text string")


def format_duplicates(texts: DataFrame, set_rows: int = SET_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Members of the sets of two or more rows of ``texts`` (src, id, text) that say the same.

    Gives ``src, keep_id, id, copies``: keep_id is the set's smallest id, copies the number of its ids. A set of more
    than ``set_rows`` rows is split over several tasks, whose first texts are compared once more.
    """
    texts = texts.select("src", "id", "text").where("id is not null and text is not null")
    light = texts.mapInArrow(_hash_rows, "src string, id string, h1 long, h2 long")
    sets = materialise(light.groupBy(_SET).agg(F.count("*").alias("n")).where("n > 1"))
    if sets.isEmpty():
        return texts.select("src", F.col("id").alias("keep_id"), "id", F.lit(1).cast("long").alias("copies")).where("false")
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(sets, "h1"))
    rows = texts.mapInArrow(_filtered_rows(shared), "src string, id string, text string, h1 long, h2 long")
    large = sets.where(F.col("n") > set_rows).select(*_SET, F.ceil(F.col("n") / set_rows).cast("int").alias("salts"))
    some = not large.isEmpty()
    rows = rows.join(small(large), _SET, "left") if some else rows.withColumn("salts", F.lit(None).cast("int"))
    rows = rows.withColumn("split", F.col("salts").isNotNull())
    rows = rows.withColumn("salt", F.when(F.col("split"), F.pmod(F.xxhash64("id"), F.col("salts"))).otherwise(F.lit(0)).cast("int"))
    found = _verify(rows)
    if some:
        # the first texts of the parts, one for each part unless hashes collide
        found = materialise(found)
        parts = found.where("text is not null").withColumns({"salt": F.lit(0), "split": F.lit(False)})
        whole = _verify(parts).select("src", F.col("id").alias("first"), F.col("first").alias("whole"))
        found = found.join(small(materialise(whole)), ["src", "first"], "left").withColumn("first", F.coalesce("whole", "first"))
    member = materialise(found.select("src", F.col("first").alias("keep_id"), "id"))
    counted = materialise(member.groupBy("src", "keep_id").agg(F.count("*").alias("copies")).where("copies > 1").withColumn("n", F.col("copies")))
    return lookup(member, counted, ["src", "keep_id"], hot_rows).select("src", "keep_id", "id", "copies")
