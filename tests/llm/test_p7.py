import random
import re
import unicodedata

import numpy as np
import pytest

from samewise.llm import p7_leaks as P
from tests.conftest import rows

D, I = "doc_id long, text string, item long, h long", "item_id long, text string, key long"  # noqa: E741


def words(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn" and not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain.lower())


def data():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rng.randint(5, 40)))) for k in range(30)]
    docs = []
    for k in range(80):
        w = [word() for _ in range(30)]
        part = items[rng.randrange(30)][1].split()
        n = rng.randint(8, 16)
        at = rng.randrange(max(1, len(part) - n))
        piece = " ".join(part[at : at + n])
        docs.append((k, " ".join(w[:15]) + "\n" + rng.choice([piece, piece.upper(), unicodedata.normalize("NFD", piece), piece.replace(" ", " - ")]) + " " + " ".join(w[15:])))
    items += [(100, None), (101, ""), (102, "too short"), (103, items[3][1]), (None, items[4][1]), (104, "ﬁ ² ① " * 6)]
    docs += [(100, None), (101, ""), (102, "FI 2 1 " * 5), (None, items[0][1]), (103, "x " * 100_000 + items[3][1])]
    return docs, items


@pytest.mark.parametrize("limit,hot_rows", [(1 << 21, 9), (0, 100_000), (0, 1)])
def test_as_by_brute_force(spark, limit, hot_rows):
    """Whether the items are broadcast or joined, and windows are hot."""
    docs, items = data()
    truth = set()
    seen = {}
    for i, t in items:
        if i is not None and t:
            w = words(t)
            for j in range(len(w) - 11):
                seen.setdefault(tuple(w[j : j + 12]), set()).add(i)
    for d, t in docs:
        if d is not None and t:
            w = words(t)
            for j in range(len(w) - 11):
                truth |= {(d, i) for i in seen.get(tuple(w[j : j + 12]), ())}
    a = spark.createDataFrame([(*x, 1, 2) for x in docs + docs[:5]], D)
    b = spark.createDataFrame([(*x, 3) for x in items + items[:5]], I)
    found = rows(P.leaks(a, b, broadcast_windows=limit, hot_rows=hot_rows), "doc_id", "item_id")
    assert len(found) == len(set(found)) and set(found) == truth and truth


def test_reordered_passage_is_covered(spark):
    item = [f"w{k}" for k in range(60)]
    doc = [*item[40:60], "between", *item[0:20], "also", *item[20:40]]
    a, b = spark.createDataFrame([(1, " ".join(doc), 0, 0)], D), spark.createDataFrame([(2, " ".join(item), 0)], I)
    r = P.leaks(a, b).first()
    assert (r["longest"], r["tiles"], r["coverage"]) == (20, 3, 1.0)


@pytest.mark.parametrize("limit", [1 << 21, 0])
def test_coverage_finds_what_holds_no_long_run(spark, limit):
    """Sentences of eight words in another order cover the item, though no run of twelve words is left; one of them alone doesn't."""
    item = [f"w{k}" for k in range(48)]
    parts = [item[k : k + 8] for k in range(0, 48, 8)]
    docs = [(1, " x ".join(" ".join(p) for p in reversed(parts)), 0, 0), (2, " ".join(parts[2]) + " and nothing else", 0, 0), (3, " ".join(item), 0, 0)]
    a, b = spark.createDataFrame(docs, D), spark.createDataFrame([(7, " ".join(item), 0)], I)
    assert rows(P.leaks(a, b, broadcast_windows=limit), "doc_id") == [(3,)]
    assert rows(P.leaks(a, b, least=5, coverage=0.5, broadcast_windows=limit), "doc_id", "tiles", "coverage") == [(1, 6, 1.0), (3, 1, 1.0)]
    assert len(rows(P.leaks(a, b, least=5, broadcast_windows=limit), "doc_id")) == 3


def test_tiles_don_t_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        used_a, used_b = np.zeros(len(a)), np.zeros(len(b))
        found = P.tiles(a, b, 3)
        for i, j, n in found:
            assert n >= 3 and np.array_equal(a[i : i + n], b[j : j + n])
            used_a[i : i + n] += 1
            used_b[j : j + n] += 1
        assert used_a.max(initial=0) <= 1 and used_b.max(initial=0) <= 1
        shared = {tuple(a[i : i + 3]) for i in range(len(a) - 2)} & {tuple(b[i : i + 3]) for i in range(len(b) - 2)}
        assert bool(found) == bool(shared)


def test_folding_as_by_normalising():
    rng = random.Random(2)
    pool = "aÉéßΣςﬁ²½İ①Ａ한ｶﾞé‑  ́​…™"
    for _ in range(500):
        t = "".join(rng.choice(pool) for _ in range(12))
        a, b = P.plain_words([t])[0], P.plain_words([" ".join(words(t.replace("ς", "σ")))])[0]
        assert np.array_equal(a, b), t


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], D), spark.createDataFrame([], I)
    assert P.leaks(a, b).count() == 0
    assert P.leaks(a, b, broadcast_windows=-1).count() == 0
