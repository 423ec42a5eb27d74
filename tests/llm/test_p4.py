import json
import random

import numpy as np
import pytest

from samewise.llm import p4_format_duplicates as P
from tests.conftest import rows

S = "src string, id string, text string, h1 long, keep_id string, n long"


def found(spark, texts, **options):
    df = spark.createDataFrame([(*t, 1, "k", 2) for t in texts], S)
    return set(rows(P.format_duplicates(df, **options), "src", "keep_id", "id", "copies"))


CASES = [
    ("r", "a1", "Hello, World! 1"), ("r", "a2", "hello\tworld\r\n1"), ("r", "a3", "﻿HELLO world - 1"), ("r", "b1", "hello worl d1"), ("r", "b2", "helloworld 1"),
    ("s", "a1", "hello world 1"), ("r", "n", None), ("r", None, "hello world 1"), ("r", "e", ""), ("r", "p", " ... \n"), ("r", "a2", "hello\tworld\r\n1"),
    ("r", "f1", '{"k": "v w", "x_y": 12.5, "t": true}'), ("r", "f2", "t: True\nk = V, w\nx_y: 12.5"), ("r", "f3", "﻿---\r\nx_y: 12.5\r\n\r\nt: true\r\nk: v w\r\n---"),
    ("r", "f4", "t: v w\nk: true\nx_y: 12.5"), ("r", "f5", "k v w x y 12 5 t true"), ("r", "o1", "k: v"), ("r", "o2", "k v"), ("r", "j", "{broken"), ("r", "j2", "broken"),
    ("r", "u1", "ÉCOLE_Straße ΟΔΟΣ"), ("r", "u2", "école straße οδος"), ("r", "d1", "k: 1\nk: 1\nm: 2"), ("r", "d2", "k: 1\nm: 2"), ("r", "d3", "m: 2\nk: 1\nk: 1"),
]
TRUTH = {
    *{("r", "a1", i, 3) for i in ("a1", "a2", "a3")}, *{("r", "f1", i, 3) for i in ("f1", "f2", "f3")}, ("r", "o1", "o1", 2), ("r", "o1", "o2", 2),
    ("r", "j", "j", 2), ("r", "j", "j2", 2), ("r", "u1", "u1", 2), ("r", "u1", "u2", 2), ("r", "d1", "d1", 2), ("r", "d1", "d3", 2),
}


@pytest.mark.parametrize("options", [{}, {"set_rows": 1}, {"set_rows": 2, "hot_rows": 1}])
def test_cases(spark, options):
    """Also when every set is hot and split over tasks."""
    assert found(spark, CASES, **options) == TRUTH


def test_hot_set(spark):
    rng = random.Random(1)
    fold = lambda: "".join(rng.choice([c.upper(), c]) for c in "one two three four") + rng.choice(["", ".", "\n", " !"])
    texts = [("r", f"h{k:03}", fold()) for k in range(300)] + [("r", f"o{k}", f"own {k}") for k in range(300)]
    assert found(spark, texts, set_rows=50) == {("r", "h000", f"h{k:03}", 300) for k in range(300)}


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    batches = list(P._verify_rows(iter([_batch([("a", "x y"), ("b", "X-Y"), ("c", "x z"), ("d", "x  z!"), ("e", "q")])])))
    assert [tuple(r.values())[4] for b in batches for r in b.to_pylist()] == ["a", "a", "c", "c", "e"]


def _batch(rows_):
    import pyarrow as pa

    n = len(rows_)
    return pa.RecordBatch.from_arrays([pa.array(["r"] * n), pa.array([i for i, _ in rows_]), pa.array([t for _, t in rows_]), *[pa.array([7] * n)] * 3, pa.array([False] * n)], ["src", "id", "text", "h1", "h2", "salt", "split"])


def test_sets_go_on_over_blocks(monkeypatch):
    """A block of one text each: the first text of a set is still what the others are compared with."""
    whole = [r for b in P._verify_rows(iter([_batch([(f"i{k}", t) for k, t in enumerate(["x y", "X-y", "x z", "k: 1\nm: 2", "M: 2\nk = 1", "x_Z"])])])) for r in b.to_pylist()]
    monkeypatch.setattr(P.T, "BLOCK", 1)
    parts = [r for b in P._verify_rows(iter([_batch([(f"i{k}", t) for k, t in enumerate(["x y", "X-y", "x z", "k: 1\nm: 2", "M: 2\nk = 1", "x_Z"])])])) for r in b.to_pylist()]
    assert whole == parts and [r["first"] for r in whole] == ["i0", "i0", "i2", "i3", "i3", "i2"]


def test_the_bitmap_never_loses_a_hash(spark):
    from samewise.llm._bitmap import bitmap, passes

    rng = np.random.default_rng(2)
    hs, others = (rng.integers(-(2**63), 2**63, 3000) for _ in range(2))
    bits = bitmap(spark.createDataFrame([(int(h),) for h in hs], "h1 long"), "h1")
    assert passes(bits, hs.view(np.uint64)).all() and passes(bits, others.view(np.uint64)).mean() < 0.1


def test_two_pointers_as_words():
    import re

    rng = random.Random(4)
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    for _ in range(2000):
        a, b = ("".join(rng.choice("aB1 -_.\n") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert P.same_words(a, b) == (words(a) == words(b))
    long = "Word, " * 5000
    assert P.same_words(long, long.lower().replace(",", "")) and not P.same_words(long, long + "x")


def test_hashes_don_t_depend_on_the_block():
    texts = ["a b", "", "{}", json.dumps({"a": [1, {"b": None}], "c": "d"}), "x" * 9000]
    together = [h.tolist() for h in P.hashes(texts)]
    alone = [[h.tolist()[0] for h in P.hashes([t])] for t in texts]
    assert [list(x) for x in zip(*together, strict=True)] == alone


def test_very_long_and_empty(spark):
    long = "lorem ipsum " * 100_000
    assert found(spark, [("r", "a", long), ("r", "b", long.upper())]) == {("r", "a", "a", 2), ("r", "a", "b", 2)}
    assert found(spark, []) == set()
