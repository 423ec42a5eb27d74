import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from samewise.llm import p1_near_duplicates as P
from tests.conftest import rows

RECORDS = "id string, content string, src string, cid long, key string"
DOCS = "id string, atoms array<string>, text string, h1 long"


def shingles(text):
    import re

    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()


def brute(records, docs, s=0.6):
    out = set()
    sets = {("records", i): shingles(c) for i, c in records if i is not None and c is not None}
    sets |= {("docs", i): {a for a in x if a is not None} for i, x in docs if i is not None and x is not None}
    for (k, x), (m, y) in combinations(sorted(sets.items()), 2):
        if k[0] == m[0] and x and y and len(x & y) >= s * len(x | y) - 1e-9:
            out.add((k[0], *sorted((k[1], m[1]))))
    return out


def frames(spark, records, docs):
    r = spark.createDataFrame([(i, c, "x", 1, "k") for i, c in records], RECORDS)
    return r, spark.createDataFrame([(i, a, "t", 2) for i, a in docs], DOCS)


def texts(seed, families=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out = []
    for f in range(families):
        base = [word() for _ in range(rng.randint(18, 80))]
        for v in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            out.append((f"r{f}-{v}", " ".join(w)))
    return out


EDGE = [(None, "a b"), ("n", None), ("e", ""), ("s", "  \n"), ("t", "one two three"), ("copy1", "Ä " * 1 + "w1 w2 " * 15), ("copy2", "ä, " + "w1-w2\n" * 15)]
DOC_EDGE = [(None, ["a"]), ("n", None), ("e", []), ("z", [None]), ("d1", ["a", "b", "a", None]), ("d2", ["b", "a"]), ("d3", ["a", "b", "c"]), ("d4", ["x"])]


@pytest.mark.parametrize("bucket,hot_rows", [(200, 50_000), (2, 50_000), (200, 1), (1, 1)])
def test_pairs_as_by_brute_force(spark, bucket, hot_rows):
    """Also when buckets overflow or halves are hot, so that the prefix filter finds the pairs."""
    records, docs = texts(1) + EDGE, DOC_EDGE + [(f"x{k}", [f"a{j}" for j in range(k % 3, 8 + k % 3)]) for k in range(9)]
    r, d = frames(spark, records + records[:5], docs + docs[:4])
    found = rows(P.near_pairs(r, d, bucket=bucket, hot_rows=hot_rows), "src", "id_a", "id_b")
    assert len(found) == len(set(found))
    assert set(found) == brute(records, docs)


@pytest.mark.parametrize("members,class_rows", [(256, 100_000), (7, 10)])
def test_a_large_class_gives_all_pairs(spark, members, class_rows):
    """301 copies, and a near class: whether members travel in one part or in many, and the class is hot or not."""
    body = [f"w{j}" for j in range(30)]
    records = [(f"c{k:03}", "same words " + " ".join(body) + "." * (k % 3)) for k in range(301)]
    records += [(f"n{k}", "same words " + " ".join([*body[:-1], "other"])) for k in range(20)]
    r, d = frames(spark, records, [])
    found = rows(P.near_pairs(r, d, members=members, class_rows=class_rows), "src", "id_a", "id_b")
    assert len(found) == len(set(found)) == 321 * 320 // 2
    assert set(found) == brute(records, [])


def test_hot_elements_meet_in_parts(spark):
    records, docs = texts(6), [(f"x{k:02}", [f"a{j}" for j in range(k % 4, 9 + k % 4)] + [f"own{k}"]) for k in range(40)]
    r, d = frames(spark, records, docs)
    classes, links = P.near_classes(r, d, bucket=1, hot_rows=1, part_rows=3)
    reps = {x["cid"]: (x["src"], x["rep"]) for x in classes.collect()}
    found = {(reps[x["a"]][0], *sorted((reps[x["a"]][1], reps[x["b"]][1]))) for x in links.collect()}
    kept = {x[1] for x in reps.values()}
    assert found == {p for p in brute(records, docs) if p[1] in kept and p[2] in kept}


def test_empty_tables(spark):
    r, d = frames(spark, [], [])
    assert P.near_pairs(r, d).count() == 0
    assert P.near_groups(r, d).count() == 0


def test_groups(spark):
    records = texts(3)
    r, d = frames(spark, records, [])
    pairs = brute(records, [])
    found = {x["id"]: x for x in P.near_groups(r, d).collect()}
    for _, a, b in pairs:
        assert found[a]["group_id"] == found[b]["group_id"]
    assert all(x["group_id"] <= x["class_id"] <= i for i, x in found.items())
    assert set(found) == {i for i, c in records if shingles(c)}


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    r, d = frames(spark, [("a", long), ("b", long + " end")], [])
    assert rows(P.near_pairs(r, d), "id_a", "id_b") == [("a", "b")]


def test_bitmap_bound_never_drops_a_pair():
    rng = np.random.default_rng(0)
    for _ in range(50):
        base = rng.integers(0, 1 << 48, 200).astype(np.uint64)
        a, b = np.unique(base[:150]), np.unique(base[50:])
        bits = P.bitmaps(np.concatenate((a, b)), np.array([0, len(a)]))
        differ = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) / 2


def test_recall_of_the_tables(spark):
    """Above the threshold the tables lose next to nothing."""
    records = [(f"{i}-{k}", c) for k in range(4) for i, c in texts(10 + k, 30)]
    r, d = frames(spark, records, [])
    truth = {(a, b) for _, a, b in brute(records, [])}
    found = set(rows(P.near_pairs(r, d), "id_a", "id_b"))
    assert found <= truth and len(found) >= 0.99 * len(truth)
    assert r.where(F.col("id").isNull()).count() == 0


def test_no_pair_at_the_threshold_is_lost(spark):
    """3,000 pairs of docs that have 6 of 10 atoms in common, just enough."""
    docs = [(f"{side}{k}", [f"{k}-{j}" for j in atoms]) for k in range(3000) for side, atoms in (("x", range(8)), ("y", range(2, 10)))]
    r, d = frames(spark, [], docs)
    assert rows(P.near_pairs(r, d), "id_a", "id_b") == sorted((f"x{k}", f"y{k}") for k in range(3000))


def test_classes_in_several_flushes(spark, monkeypatch):
    """Sets are packed anew after each block, and elements of a partition are compared in pieces."""
    monkeypatch.setattr(P.T, "BLOCK", 300)
    records = texts(8)
    r, d = frames(spark, records + [(f"s-{i}", c) for i, c in records], [])
    sets = {"src": "records", "levels": lambda: np.full(P.SKETCH, 8, np.uint8), "parts": 3, "similarity": 0.6, "hot_rows": 1 << 20}
    monkeypatch.setattr(P, "FLUSH_ROWS", 50)
    packed = [b for b in P._prefix_rows(**sets)(iter(_batches(r)))]
    assert len(packed) > 3
    pairs = set()
    for p in range(3):
        for b in P._met(0.6, 1000)(iter([b for b in packed if b.column(0)[0].as_py() == p])):
            pairs |= {x for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x[1] is not None}
    named = {}
    for b in P._named_rows("records")(iter(_batches(r))):
        for i, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            named[c] = min(i, named.get(c, i)) if i else None
    found = {tuple(sorted((named[a], named[b]))) for a, b in pairs}
    first = {}
    for i, c in records:
        first[frozenset(shingles(c))] = min(i, first.get(frozenset(shingles(c)), i))
    kept = set(first.values())
    assert {p[1:] for p in brute(records, []) if p[1] in kept and p[2] in kept} <= found


def _batches(df):
    import pyarrow as pa

    got = df.select("id", "content").collect()
    return [pa.RecordBatch.from_arrays([pa.array([x[k] for x in got]) for k in (0, 1)], ["id", "content"])]
