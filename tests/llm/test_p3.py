import random

from samewise.llm import p3_groups as P
from tests.conftest import rows

S = "subset string, superset string, final_supersets array<string>, v long, n long"


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, f in pairs:
        ids = [x.strip().replace("\\", "/") for x in [a, b, *(f or [])] if x is not None]
        ids = [x[2:] if x.startswith("./") else x for x in ids]
        for x in ids:
            parent.setdefault(x, x)
        for x in ids[1:]:
            p, q = find(ids[0]), find(x)
            parent[max(p, q)] = min(p, q)
    return {(x, find(x)) for x in parent}


def groups(spark, pairs, hot_rows=100_000):
    return set(rows(P.pair_groups(spark.createDataFrame([(*p, 1, 2) for p in pairs], S), hot_rows), "id", "group_id"))


def test_as_by_union_find(spark):
    rng = random.Random(1)
    ids = [f"p{k}/f.md" for k in range(150)]
    spell = lambda x: rng.choice([x, f" {x}", f"./{x}", x.replace("/", "\\"), f"{x} "])
    pairs = [(spell(rng.choice(ids)), spell(rng.choice(ids)), rng.choice([None, [], [rng.choice(ids), None]])) for _ in range(110)]
    pairs += [(None, "alone", None), (None, None, []), (None, None, None), ("self", "self", ["self"]), ("b", "a", None), ("a", "b", None)] + pairs[:10]
    assert groups(spark, pairs) == brute(pairs)


def test_long_chain_and_star(spark):
    """A chain takes several rounds; a star has one vertex that half of all rows hold."""
    pairs = [(f"c{k:03}", f"c{k + 1:03}", None) for k in range(200)] + [("hub", f"s{k:03}", None) for k in range(300)]
    assert groups(spark, pairs) == groups(spark, pairs, 20) == brute(pairs)


def test_empty_table(spark):
    assert groups(spark, []) == set()
