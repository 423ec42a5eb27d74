import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from samewise.llm import p5_distinctive_terms as P
from tests.conftest import rows

S = "id string, content string, term string, m long, p double"


def corpus(seed=1, n=80):
    rng = random.Random(seed)
    common = [f"common{k}" for k in range(20)]
    out = []
    for k in range(n):
        own = [f"own{rng.randrange(60)}" for _ in range(rng.randint(0, 4))]
        out.append((f"r{k}", " ".join(rng.choice(common) for _ in range(30)) + " " + " ".join(w for w in own for _ in range(rng.randint(1, 4)))))
    return out + [(None, "x y"), ("null", None), ("empty", ""), ("one", "a b c"), ("accent", "Größe größe GRÖSSE ñandú ñandú ñandú"), ("tie", "tie1 tie2")]


def frame(spark, records):
    return spark.createDataFrame([(*r, "t", 1, 0.5) for r in records], S)


def counts(records):
    return {i: Counter(re.findall(r"[^\W_]{2,}", c.lower())) for i, c in records if i is not None and c is not None}


@pytest.mark.parametrize("frequent,hot_rows", [(1000, 100_000), (10, 100_000), (0, 100_000), (0, 5)])
def test_outstanding_terms(spark, frequent, hot_rows):
    """Whether all terms are broadcast, some, or none, and hot ones looked up."""
    records = corpus()
    held = Counter(t for c in counts(records).values() for t in c)
    n = len(counts(records))
    truth = {(i, t) for i, c in counts(records).items() for t, k in c.items() if k * math.log(n / held[t]) >= 1.7 * math.log(n)}
    found = P.term_scores(frame(spark, records + records[:7]), frequent, 1.7, hot_rows)
    assert set(rows(found, "id", "term")) == truth and truth


def test_model_as_one_by_one(spark):
    records = corpus(2, 30)
    per = counts(records)
    total, held = Counter(), Counter()
    for c in per.values():
        total.update(c)
        held.update(c.keys())
    size = sum(total.values())
    got = {(r["id"], r["term"]): r for r in P.term_scores(frame(spark, records), 12).collect()}
    assert set(got) == {(i, t) for i, c in per.items() for t in c}
    for i, c in per.items():
        p = {t: n / sum(c.values()) for t, n in c.items()}
        for _ in range(P.ROUNDS):
            e = {t: n * P.WEIGHT * p[t] / ((1 - P.WEIGHT) * total[t] / size + P.WEIGHT * p[t]) for t, n in c.items()}
            p = {t: x / sum(e.values()) for t, x in e.items()}
        order = sorted(c, key=lambda t: (-got[i, t]["p"], t))
        for k, t in enumerate(order, 1):
            r = got[i, t]
            assert abs(r["p"] - p[t]) < 1e-9 and (r["n"], r["m"], r["records"], r["rank"]) == (c[t], held[t], len(per), k)


def test_the_first_ranks_alone(spark):
    df = frame(spark, corpus(3, 20))
    cols = ("id", "term", "rank")
    assert rows(P.term_scores(df, top=3), *cols) == rows(P.term_scores(df).where("rank <= 3"), *cols)


def test_mass_moves_to_what_is_rare():
    p, _, _ = P.maximise(np.array([5, 5]), np.array([0.2, 0.0001]), np.array([0, 2]))
    assert p[1] > 0.95 and abs(p.sum() - 1) < 1e-12


def test_empty_table(spark):
    assert P.term_scores(frame(spark, [])).count() == 0
    assert P.outstanding_terms(frame(spark, [("a", None), ("b", "")])).count() == 0


def test_converged_as_by_a_long_run():
    """Also where few rounds leave p and the order of terms far from their limits."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 40)
    bounds = np.cumsum([0, *sizes])
    n, background = rng.integers(1, 9, bounds[-1]), rng.pareto(1.0, bounds[-1]) / 2000 + 1e-6
    got, _, _ = P.maximise(n, background, bounds)
    rest = (1 - P.WEIGHT) / P.WEIGHT * background
    for a, z in zip(bounds, bounds[1:], strict=False):
        p = n[a:z] / n[a:z].sum()
        for _ in range(50_000):
            e = n[a:z] * p / (rest[a:z] + p)
            p = e / e.sum()
        assert np.abs(got[a:z] - p).max() < 1e-7
        # no probability can be moved with gain
        slope = n[a:z] / (rest[a:z] + got[a:z])
        assert slope[got[a:z] > 0].min() >= slope.max() * (1 - 1e-9)


def test_the_bound_on_p_drops_most_terms_and_no_outstanding_one():
    rng = np.random.default_rng(5)
    dropped = 0
    for _ in range(200):
        k = int(rng.integers(1, 60))
        n, m = rng.integers(1, 30, k), rng.integers(1, 5000, k)
        c = m + rng.integers(0, 4000, k)
        p, x, rest = P.maximise(n, c / 300_000, np.array([0, k]))
        rarity, floor = np.log(5000 / m), 1.7 * math.log(5000)
        kept = P.reachable(p, x, rest, rarity, floor)
        assert not (~kept & (n * rarity >= floor)).any()
        dropped += (~kept).mean() / 200
    assert dropped > 0.5
    one = P.reachable(np.array([1.0]), np.array([2.0]), np.array([0.1]), np.array([0.0]), 0.0)  # a single record
    assert one.all()
