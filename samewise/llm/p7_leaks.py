"""Problem 7: held-out items that leaked into the corpus.

Method: greedy string tiling. Items and documents that share a run of ``least`` words (a seed, found by its
Karp-Rabin hash) are joined; for each such pair the longest matches that do not overlap are marked again and again, from
the longest down to ``least`` words; matches are runs of windows with equal Karp-Rabin hashes, and what is left of a
match that others cut is a match again. The tiles may stand in any order; the share of the item's words that tiles
cover tells how much of it leaked, and pairs below ``coverage`` are left out. With short tiles and a coverage passages come
out whose parts were put in another order, which hold no long run.

Words are of letters and digits, after compatibility decomposition, without accents, lower-cased. Items whose words
are the same are worked on once and reported each. The windows of the items are broadcast while there are at most
``broadcast_windows`` of them; a larger set of items is joined instead.

Defined results: null keys and texts, items of fewer than ``least`` words and empty tables give no rows; repeated rows
count once; documents are taken whole; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import HOT_ROWS, lookup, materialise, small
from . import _text as T
from ._bitmap import bitmap, passes

LEAST = 12
BROADCAST_WINDOWS = 1 << 21  # 16 MB of hashes
KEPT_TEXTS = 2000


@cache
def _marks() -> re.Pattern:
    marks = [chr(c) for c in range(0x300, T.CODE_POINTS) if unicodedata.combining(chr(c)) or unicodedata.category(chr(c)) == "Mn"]
    return re.compile("[" + "".join(map(re.escape, marks)) + "]+")


def plain(text: str) -> str:
    """The text after compatibility decomposition, without accents, lower-cased."""
    if not text.isascii():
        text = _marks().sub("", unicodedata.normalize("NFKD", text))
    return text.lower()


MARK, SEVERAL = 0, T.CODE_POINTS - 1  # in the table: left out; becomes several characters


@cache
def fold_table() -> np.ndarray:
    """What ``plain`` makes of each code point, as a code point. Both small sigmas are one letter."""
    table = np.arange(T.CODE_POINTS, dtype=np.uint32)
    for c in range(1, T.CODE_POINTS):
        if c < 128 or unicodedata.category(ch := chr(c)) not in ("Cn", "Co", "Cs"):
            to = plain(chr(c)) if c >= 128 else chr(c).lower()
            table[c] = MARK if not to else ord(to) if len(to) == 1 else SEVERAL if any(map(str.isalnum, to)) else ord(" ")
    table[0], table[ord("ς")] = ord(" "), ord("σ")
    return table


def plain_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the plain texts, and the number of words before each text."""
    data, begins = T.code_points(texts)
    folded = fold_table()[data]
    several = np.flatnonzero(folded == SEVERAL)
    if len(several):
        texts = list(texts)
        for i in np.unique(np.searchsorted(begins, several, "right") - 1).tolist():
            texts[i] = plain(texts[i])
        data, begins = T.code_points(texts)
        folded = fold_table()[data]
        folded[folded == SEVERAL] = data[folded == SEVERAL]
    kept = folded != MARK
    if not kept.all():
        begins = np.concatenate(([0], np.cumsum(kept)))[begins]
        folded = folded[kept]
    starts, ends = T.spans(T.is_word_char()[folded])
    return T.mix(T.span_hashes(T.char_values()[folded], starts, ends)), np.searchsorted(starts, begins)


def runs_of_hits(group: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Hits (windows at i and j with one hash, of a pair numbered ``group``) as matches: hits that follow one another on a
    diagonal are one match. Gives group, start, start and length of each match, by group."""
    order = np.lexsort((i, i - j, group))
    group, i, j = group[order], i[order], j[order]
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + 1))) if len(i) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return group[first], i[first], j[first], np.diff(np.append(first, len(i))) + least - 1


def mark(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start, start, length): the longest match is marked, the earliest among equals, and so on; of a match that is
    marked in part, what is left and still long enough takes its place among the others."""
    heap = [(-n, i, j) for i, j, n in matches]
    heapify(heap)
    used_a: set[int] = set()
    used_b: set[int] = set()
    found = []
    while heap:
        n, i, j = heappop(heap)
        n = -n
        free, start = [], 0
        for k in range(n + 1):
            if k == n or i + k in used_a or j + k in used_b:
                if k - start >= least:
                    free.append((start, k))
                start = k + 1
        if free == [(0, n)]:
            used_a.update(range(i, i + n))
            used_b.update(range(j, j + n))
            found.append((i, j, n))
        else:
            for x, y in free:
                heappush(heap, (x - y, i + x, j + x))
    return found


def tiles(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, length) of two word arrays, longest first, earliest first among equals."""
    one = lambda x: T.windows(x, np.array([0, len(x)]), least)
    (ha, ia), (hb, jb) = one(a), one(b)
    order = np.argsort(hb, kind="stable")
    lo, hi = (np.searchsorted(hb[order], ha, side) for side in ("left", "right"))
    i = np.repeat(ia, hi - lo)
    j = jb[order][np.repeat(lo, hi - lo) + np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
    _, i, j, n = runs_of_hits(np.zeros(len(i), np.int64), i, j, least)
    return mark(list(zip(i.tolist(), j.tolist(), n.tolist(), strict=True)), least)


def _coverage(found: list[tuple[int, int, int]], words: int) -> tuple[int, int, float]:
    return max(n for _, _, n in found), len(found), sum(n for _, _, n in found) / words


_LEAK = "doc_id long, item long, longest int, tiles int, coverage double"


def _leak_batch(rows: list[tuple[int, int, tuple[int, int, float]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2][0] for r in rows], pa.int32()), pa.array([r[2][1] for r in rows], pa.int32()), pa.array([r[2][2] for r in rows], pa.float64())],
        ["doc_id", "item", "longest", "tiles", "coverage"],
    )


def _tile_pairs(least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, items, others = (c.to_pylist() for c in batch.columns)
            out = []
            for d, t, i, o in zip(docs, texts, items, others, strict=True):
                b = plain_words([o])[0]
                if (found := tiles(plain_words([t])[0], b, least)) and (covered := _coverage(found, len(b)))[2] >= coverage:
                    out.append((d, i, covered))
            yield _leak_batch(out)

    return run


def _hash_words(least: int, all_words: bool, shared=None):
    """Rows (key, h): of each text the hash of all its words, or of each of its windows that passes the bitmap shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i, j in T.blocks(texts):
                h, bounds = plain_words(texts[i:j])
                if all_words:
                    full = np.flatnonzero(np.diff(bounds) >= least)
                    out, of = T.mix(T.span_hashes(h, bounds[:-1][full], bounds[1:][full], T.WORD_BASE), 5), full
                else:
                    out, at = T.windows(h, bounds, least)
                    of = T.owners(bounds)[at]
                    if shared is not None:
                        maybe = passes(shared.value, out)
                        out, of = out[maybe], of[maybe]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][of]), pa.array(out.view(np.int64))], ["key", "h"])

    return run


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, broadcast_windows: int = BROADCAST_WINDOWS, coverage: float = 0.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id, item_id, longest, tiles, coverage`` for each document (doc_id, text) that holds ``least`` words in a row
    of an item (item_id, text): the longest tile, the number of tiles, and the share of the item's words they cover,
    which is ``coverage`` or more."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    keyed = items.select(F.col("item_id").alias("key"), "text").mapInArrow(_hash_words(least, True), "key long, h long").distinct()
    # items with the same words are one; it goes by its smallest id
    named = materialise(keyed.join(keyed.groupBy("h").agg(F.min("key").alias("item")), "h").select(F.col("key").alias("item_id"), "item"))
    distinct = items.join(named.where("item_id = item"), "item_id").groupBy("item").agg(F.min("text").alias("text"))
    windows = distinct.select(F.col("item").alias("key"), "text").mapInArrow(_hash_words(least, False), "key long, h long")
    if windows.count() <= broadcast_windows:
        few = distinct.orderBy("item").toPandas()
        h, bounds = plain_words(few["text"].tolist())
        shared = spark.sparkContext.broadcast((few["item"].to_numpy(np.int64), h, bounds))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, words, bounds = shared.value
            seeds, at = T.windows(words, bounds, least)
            order = np.argsort(seeds, kind="stable")
            seeds, of = seeds[order], T.owners(bounds)[at][order]
            place, sizes = at[order] - bounds[of], np.diff(bounds)
            known: dict[str, list] = {}  # a text's leaks: copies of a text that has any are tiled once
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = [(k, *x) for k, t in zip(keys, texts, strict=True) if t in known for x in known[t]]
                fresh = list(dict.fromkeys(t for t in texts if t not in known))
                of_text: dict[str, list] = {}
                for i, j in T.blocks(fresh):
                    mine, mb = plain_words(fresh[i:j])
                    wh, wat = T.windows(mine, mb, least)
                    lo, hi = (np.searchsorted(seeds, wh, side) for side in ("left", "right"))
                    many = hi - lo
                    if not many.any():
                        continue
                    e = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                    doc = np.repeat(T.owners(mb)[wat], many)
                    g, x, y, n = runs_of_hits(doc * len(sizes) + of[e], np.repeat(wat, many) - mb[doc], place[e], least)
                    matches: dict[int, list] = {}
                    for pair, *m in zip(g.tolist(), x.tolist(), y.tolist(), n.tolist(), strict=True):
                        matches.setdefault(pair, []).append(tuple(m))
                    for pair, ms in matches.items():
                        d, k = divmod(pair, len(sizes))
                        if (covered := _coverage(mark(ms, least), int(sizes[k])))[2] >= coverage:
                            of_text.setdefault(fresh[i + d], []).append((int(names[k]), covered))
                out += [(k, *x) for k, t in zip(keys, texts, strict=True) for x in of_text.get(t, ())]
                if len(known) > KEPT_TEXTS:
                    known.clear()
                known |= of_text
                yield _leak_batch(out)

        found = docs.mapInArrow(scan, _LEAK)
    else:
        # only windows that some item may have leave their task, and only texts with such windows are read again
        windows = materialise(windows.groupBy("h").agg(F.collect_set("key").alias("items")))
        shared = spark.sparkContext.broadcast(bitmap(windows, "h"))
        seen = docs.select(F.col("doc_id").alias("key"), "text").mapInArrow(_hash_words(least, False, shared), "key long, h long")
        seen = materialise(seen.withColumnRenamed("key", "doc_id").distinct())
        known = materialise(windows.join(seen.groupBy("h").agg(F.count("*").alias("n")), "h"))
        pairs = materialise(lookup(seen, known, "h", hot_rows).select("doc_id", F.explode("items").alias("item")).distinct())
        texts = docs.join(small(materialise(pairs.select("doc_id").distinct())), "doc_id", "left_semi").distinct()
        found = pairs.join(texts, "doc_id").join(distinct.withColumnRenamed("text", "other"), "item")
        found = found.select("doc_id", "text", "item", "other").mapInArrow(_tile_pairs(least, coverage), _LEAK)
    found = found.groupBy("doc_id", "item").agg(F.max("longest").alias("longest"), F.max("tiles").alias("tiles"), F.max("coverage").alias("coverage"))
    return found.join(named, "item").select("doc_id", "item_id", "longest", "tiles", "coverage")
