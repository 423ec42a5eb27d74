import random
from itertools import combinations

import numpy as np
import pytest

from samewise.operators import containment as C
from samewise.operators import exact as E
from samewise.operators import similarity as S
from samewise.operators import text_pairs as T
from samewise.operators.components import components
from samewise.plans.files_plan import funnel, pair_verdicts, run_files
from tests.conftest import rows
from tests.test_operators import tfidf


def corpus(seed, n):
    rng = random.Random(seed)
    return [(f"r{k:02}", " ".join(rng.choice([f"w{rng.randrange(6)}", f"own{k // 3}x{rng.randrange(5)}"]) for _ in range(rng.randint(0, 14)))) for k in range(n)]


def cosines(data, threshold):
    vec = tfidf(data)
    norm = {i: sum(w * w for w in v.values()) ** 0.5 for i, v in vec.items()}
    scores = {(a, b): sum(w * vec[b].get(t, 0) for t, w in vec[a].items()) / norm[a] / norm[b] for a, b in combinations(sorted(vec), 2) if norm[a] and norm[b]}
    return {k: s for k, s in scores.items() if s >= threshold}


@pytest.mark.parametrize("threshold", [0.2, 0.65, 0.9])
def test_edges_as_by_brute_force(spark, threshold):
    """Also when terms meet in parts, and when there are too many terms for a broadcast."""
    data = corpus(7, 70) + [("long", "w1 " * 70_000 + "own1x1 own1x2"), ("none", "a the"), ("", "w1 w2 w3")]
    truth = cosines(data, threshold)
    df = spark.createDataFrame(data, "id string, content string").repartition(3)
    for options in ({}, {"part_rows": 3}, {"most_terms": 5}):
        found = {(r["a"], r["b"]): r["score"] for r in T.text_edges(df, threshold, **options).collect()}
        assert set(found) == set(truth) and all(abs(found[k] - truth[k]) < 1e-9 for k in truth)
    with pytest.raises(ValueError):
        T.text_edges(df, 0)


def test_edges_of_nothing(spark):
    assert T.text_edges(spark.createDataFrame([], "id string, content string")).count() == 0
    assert T.text_edges(spark.createDataFrame([("a", "the")], "id string, content string")).count() == 0


def test_texts_are_sent_packed_and_not_as_rows(spark):
    """A row for each text's term was shuffled three times; now there are a few rows for each partition."""
    df = spark.createDataFrame(corpus(3, 60), "id string, content string").repartition(2)
    plan = T.text_edges(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionById" in plan or "RepartitionByExpression" in plan
    assert "explode(" not in plan


def test_scores_with_folded_columns(monkeypatch):
    """Terms beyond the columns are folded into a bound, and scored all the same."""
    monkeypatch.setattr(T, "COLUMNS", 6)
    monkeypatch.setattr(T, "FOLDED", 2)
    rng = np.random.default_rng(0)
    dense = (rng.random((40, 20)) < 0.4) * rng.random((40, 20)) + 1e-9
    dense[7] = dense[3]
    dense /= np.sqrt((dense**2).sum(1, keepdims=True))
    of, places = np.nonzero(dense)
    found = {}
    for x, y, score in T._scores(dense[of, places], places, 20, of, 0.6, np.ones(40, np.float32), np.full(40, 3, np.uint8)):
        found |= {(a, b): s for a, b, s in zip(x.tolist(), y.tolist(), score.tolist(), strict=True)}
    truth = {(a, b): dense[a] @ dense[b] for a, b in combinations(range(40), 2) if dense[a] @ dense[b] >= 0.6}
    assert set(found) == set(truth) and all(abs(found[k] - truth[k]) < 1e-9 for k in truth)


@pytest.mark.parametrize("part_rows", [5000, 2])
def test_contained_as_by_brute_force(spark, part_rows):
    rng = random.Random(2)
    base = [[f"line {k} {j}" if rng.random() < 0.7 else rng.choice(["", "same", "more"]) for j in range(rng.randint(3, 12))] for k in range(8)]
    data = {f"r{k}-{v}": "\n".join(x for x in base[k] if v == 0 or rng.random() < 0.7) for k in range(8) for v in range(5)}
    data = list({c: (i, c) for i, c in data.items()}.values())

    def inside(a, b):
        rest = iter(b)
        return all(x in rest for x in a)

    lines = {i: c.split("\n") for i, c in data}
    solid = {i: sum(x != "" for x in ls) for i, ls in lines.items()}
    truth = sorted((a, b) for a in lines for b in lines if a != b and 2 <= solid[a] <= solid[b] <= 3 * solid[a] and inside(lines[a], lines[b]))
    df = spark.createDataFrame(data, "id string, content string").repartition(3)
    assert rows(C.contained(df, 2, 3.0, part_rows), "subset", "superset") == truth and truth
    pairs = C.containment_pairs(df, 2, 3.0)
    assert rows(pairs, "subset", "superset") == truth
    assert all(len(r["extra"]) == len(lines[r["superset"]]) - len(lines[r["subset"]]) for r in pairs.collect())


def test_unique_records_stay_where_they_are(spark):
    """Texts were shuffled by id; only those of repeated ids are."""
    data = [("a", "x"), ("b", "x"), ("c", "y"), ("c", "y"), ("d", "w"), ("d", "v"), ("e", "v"), (None, "q"), ("f", None)]
    df = spark.createDataFrame(data, "id string, content string").repartition(3)
    found = E.unique_records(df, E.identified(df))
    assert rows(found, "id", "content") == [("a", "x"), ("c", "y"), ("d", "v")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [id") == 1


def test_components_of_few_edges_take_one_task(spark):
    """All rounds of joins were run whatever the number of edges."""
    rng = random.Random(5)
    edges = [(f"v{rng.randrange(60):02}", f"v{rng.randrange(60):02}") for _ in range(45)] + [("same", "same")] + [(f"chain{k:02}", f"chain{k + 1:02}") for k in range(30)]
    df = spark.createDataFrame(edges, "a string, b string").repartition(4)
    label = {v: v for e in edges for v in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = sorted(label.items())
    assert rows(components(df), "id", "component") == rows(components(df, one_task=0), "id", "component") == want
    assert "Join" not in components(df)._jdf.queryExecution().optimizedPlan().toString()
    assert components(df.limit(0)).count() == 0


def test_member_scores_from_packed_texts(spark):
    """The vectors' rows were shuffled, and whole vectors once for each pair."""
    data = corpus(7, 70)
    df = spark.createDataFrame(data, "id string, content string").repartition(3)
    members = spark.createDataFrame([(f"c{k % 4}", f"r{k:02}") for k in range(70) if k % 5], "component string, id string").join(df.where("content <> ''").select("id"), "id").select("component", "id")
    vectors = S.Embedder(df).transform(df)
    want = {(x["component"], x["a"], x["b"]): x["score"] for x in S.member_scores(vectors, members).collect()}
    for options in ({}, {"part_rows": 3}, {"most_terms": 2}):
        found = T.member_scores(df, members, **options).collect()
        assert len(found) == len(want) and all(abs(want[x["component"], x["a"], x["b"]] - x["score"]) < 1e-9 for x in found)
    assert "map_from_entries" not in T.member_scores(df, members)._jdf.queryExecution().optimizedPlan().toString()


def test_funnel_and_verdicts_read_no_text_again(spark):
    """Both counted or joined texts anew, of unique records, survivors and contained pairs."""
    data = [(f"r{k}", "\n".join(f"line {k % 4} {j}" for j in range(5 + k % 3))) for k in range(20)]
    r = run_files(spark.createDataFrame(data, "id string, content string"), normalize=True)
    for made in (funnel(r), pair_verdicts(r)):
        assert "content" not in made._jdf.queryExecution().optimizedPlan().toString()
    out = {x["stage"]: x["records_out"] for x in funnel(r).collect()}
    assert (out["load"], out["exact_hash"], out["containment"]) == (20, r.unique.count(), r.survivors.count()) == (20, 12, 4)
