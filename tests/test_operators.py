import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from samewise.operators import audit as A
from samewise.operators import blocks as B
from samewise.operators import components as K
from samewise.operators import containment as C
from samewise.operators import exact as E
from samewise.operators import follow_up as U
from samewise.operators import merge3 as M
from samewise.operators import similarity as S
from samewise.operators import triage as G
from tests.conftest import rows


def records(spark, data):
    return spark.createDataFrame([(*d, "extra") for d in data], "id string, content string, hash string")


def test_exact(spark):
    df = records(spark, [("a", "same"), ("b", "same"), ("c", "other"), ("c", "other"), (None, "x"), ("n", None)])
    ids = E.identified(df)
    for hot in (1, 100):  # kept apart, or not
        assert rows(E.duplicate_groups(ids, hot), "id", "rep", "n") == [("a", "a", 2), ("b", "a", 2)]
    assert rows(E.unique_records(df, ids), "id", "content") == [("a", "same"), ("c", "other")]


def test_an_id_with_two_texts_has_the_smaller(spark):
    df = records(spark, [("a", "z"), ("a", "b"), ("b", "b"), ("c", "z")])
    ids = E.identified(df)
    assert rows(E.duplicate_groups(ids), "id", "rep") == [("a", "a"), ("b", "a")]
    assert rows(E.unique_records(df, ids), "id", "content") == [("a", "b"), ("c", "z")]


def test_normalised_groups_are_flagged(spark):
    data = [("a", "x\ny"), ("b", "x \r\ny"), ("c", "z"), ("d", "z")]
    assert rows(E.duplicate_groups(E.identified(records(spark, data))), "id") == [("c",), ("d",)]
    assert rows(E.duplicate_groups(E.identified(records(spark, data), True)), "id", "normalized_match") == [("a", True), ("b", True), ("c", False), ("d", False)]


def subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)


def brute_containment(data, floor, ratio):
    out = set()
    for (i, a), (j, b) in combinations(sorted(data), 2):
        x, y = a.split("\n"), b.split("\n")
        n, m = sum(map(bool, x)), sum(map(bool, y))
        if n <= m and n >= floor and m <= n * ratio and subsequence(x, y):
            out.add((i, j))
        elif m <= n and m >= floor and n <= m * ratio and subsequence(y, x):
            out.add((j, i))
    return out


@pytest.mark.parametrize("floor,ratio", [(5, 20.0), (0, float("inf")), (2, 3.0)])
def test_containment_as_by_brute_force(spark, floor, ratio):
    rng = random.Random(floor)
    data = {}
    for k in range(60):
        base = [rng.choice(["", "x", "y", f"l{rng.randrange(12)}"]) for _ in range(rng.randint(1, 14))]
        data["\n".join(base)] = f"r{k:02}"
        if k % 2:
            data["\n".join(base + ["tail"] * rng.randint(1, 3))] = f"s{k:02}"
    data = [(i, c) for c, i in data.items()]
    found = C.containment_pairs(records(spark, data), floor, ratio)
    assert set(rows(found, "subset", "superset")) == brute_containment(data, floor, ratio)
    text = dict(data)
    for r in found.collect():
        drop = {e["line"]: e["text"] for e in r["extra"]}
        full = text[r["superset"]].split("\n")
        assert all(full[k] == v for k, v in drop.items())
        assert [x for k, x in enumerate(full) if k not in drop] == text[r["subset"]].split("\n")


def test_chains_end_at_survivors(spark):
    line = [f"l{k}" for k in range(12)]
    df = records(spark, [("a", "\n".join(line[:5])), ("b", "\n".join(line[:8])), ("c", "\n".join(line))])
    pairs = C.containment_pairs(df)
    assert set(rows(C.final_supersets(pairs), "subset", "superset", "final_superset")) == {("a", "b", "c"), ("a", "c", "c"), ("b", "c", "c")}
    assert rows(C.survivors(df, pairs), "id") == [("c",)]


def test_tiny_files_are_no_subsets(spark):
    df = records(spark, [("t", "}"), ("f", "\n".join([f"l{k}" for k in range(10)] + ["}"]))])
    assert C.containment_pairs(df).count() == 0 and C.containment_pairs(df, 1).count() == 1


def tfidf(data):
    import re

    tok = {i: [w for w in re.findall(r"[a-z0-9]{2,}", c.lower()) if w not in S.X.STOPWORDS] for i, c in data}
    df = {}
    for ts in tok.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    return {i: {t: ts.count(t) / len(ts) * (math.log((len(data) + 1) / (df[t] + 1)) + 1) for t in set(ts)} for i, ts in tok.items()}


@pytest.mark.parametrize("threshold", [0.2, 0.65, 0.9])
def test_cosine_as_by_brute_force(spark, threshold):
    rng = random.Random(7)
    data = [(f"r{k:02}", " ".join(rng.choice([f"w{rng.randrange(6)}", f"own{k // 3}x{rng.randrange(5)}"]) for _ in range(rng.randint(0, 14)))) for k in range(70)]
    vec = tfidf(data)
    norm = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in vec.items()}
    truth = {}
    for a, b in combinations(sorted(vec), 2):
        if norm[a] and norm[b]:
            s = sum(w * vec[b].get(t, 0) for t, w in vec[a].items()) / norm[a] / norm[b]
            if s >= threshold:
                truth[a, b] = s
    df = records(spark, data)
    for parts in (5000, 3):  # terms of very many vectors meet in parts
        found = {(r["a"], r["b"]): r["score"] for r in S.cosine_edges(S.Embedder(df).transform(df), threshold, parts).collect()}
        assert set(found) == set(truth) and all(abs(found[k] - truth[k]) < 1e-9 for k in truth)


def test_embedder_gives_unseen_terms_the_greatest_weight(spark):
    e = S.Embedder(records(spark, [("a", "cats dogs"), ("b", "cats birds")]))
    w = {r["term"]: r["w"] for r in e.transform(records(spark, [("q", "cats unseen")])).collect()}
    assert w["unseen"] == pytest.approx((math.log(3) + 1) / 2) and w["cats"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        S.cosine_edges(e.transform(records(spark, [("q", "x")])), 0)


def test_clusters_and_quality(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.7), ("x", "y", 0.8)], "a string, b string, score double")
    members = S.clusters(edges)
    assert rows(members, "component", "id") == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")]
    assert rows(S.cluster_quality(members, edges), "component", "size", "links", "weakest") == [("a", 3, 2, 0.7), ("x", 2, 1, 0.8)]


def test_components_of_a_chain_and_none(spark):
    chain = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(120)], "a string, b string")
    assert {r["component"] for r in K.components(chain).collect()} == {"000"}
    star = chain.unionByName(spark.createDataFrame([("hub", f"s{k:03}") for k in range(40)], "a string, b string"))
    assert rows(K.components(star), "id", "component") == rows(K.components(star, hot_rows=10), "id", "component")
    assert K.components(chain.limit(0)).count() == 0


MERGES = [
    ("a\nb\nc\n", "x\nb\nc\n", "a\ny\nc\n", False), ("a\nb\nc\n", "x\nb\nc\n", "a\nb\ny\n", True), ("a\nb\n", "a\nx\n", "a\nx\n", True), ("a\nb\n", "a\n", "a\n", True),
    ("a\nb\nc\n", "a\nc\n", "a\nx\nc\n", False), ("a\nb\n", "a\nx\nb\n", "a\ny\nb\n", False), ("", "a\n", "a\n", True), ("", "a\nb\n", "a\nc\n", False),
    ("a\nb\n", "a\nb", "a\nb\nc\n", False), ("a\nb\n", "a\r\nb\r\n", "a\nb\nc\n", False), ("a\n", "a\0\n", "a\n", False), ("a\nb\n", "new\na\nb\n", "a\nb\nend\n", True),
]


@pytest.mark.parametrize("base,a,b,clean", MERGES)
def test_merge_cases(base, a, b, clean):
    assert M.merge(base, a, b)[0] is clean


def test_merge_as_by_version_control(tmp_path):
    """Random texts, merged by the tool whose rules these are: the same answers but for a few where a repeated line can
    be matched in several ways."""
    import shutil
    import subprocess

    if not shutil.which("git"):
        pytest.skip("no git here")
    rng = random.Random(11)
    same = total = 0
    for _ in range(150):
        base = [f"l{rng.randrange(40)}\n" for _ in range(rng.randint(0, 12))]

        def edit(lines):
            lines = list(lines)
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(lines))
                lines[at : at + rng.randint(0, 2)] = [f"n{rng.randrange(6)}\n" for _ in range(rng.randint(0, 2))]
            return lines

        texts = ["".join(x) for x in (edit(base), base, edit(base))]
        for name, t in zip("aob", texts, strict=True):
            (tmp_path / name).write_text(t)
        done = subprocess.run(["git", "merge-file", "-p", "a", "o", "b"], cwd=tmp_path, capture_output=True, text=True)
        clean, merged = M.merge(texts[1], texts[0], texts[2])
        total += 1
        same += clean == (done.returncode == 0) and (not clean or merged == done.stdout)
    assert same >= 0.98 * total


def test_edit_script_is_shortest():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        hunks = M.edit_script(a, b)
        out, at = [], 0
        for i, j, p, q in hunks:
            out += a[at:i] + b[p:q]
            at = j
        assert out + a[at:] == b
        cost = sum(j - i + q - p for i, j, p, q in hunks)
        assert cost == len(a) + len(b) - 2 * A.common_length(a, b)


def test_triage(spark):
    body = "\n".join(f"line {k}" for k in range(8))
    entries = [
        ("same", "m", "modified", "b1", body, 0), ("same", "n", "modified", "b1", None, 1), ("sub", "m", "modified", "b1", body, 0), ("sub", "n", "added", "b2", body + "\nmore", 1),
        ("gone", "m", "deleted", None, None, 0), ("gone", "n", "modified", "b1", body, 1), ("merge", "m", "modified", "c1", "top\n" + body, 0), ("merge", "n", "modified", "c2", body + "\nend", 1),
        ("clash", "m", "modified", "d1", body.replace("line 3", "x"), 0), ("clash", "n", "modified", "d2", body.replace("line 3", "y"), 1), ("lone", "m", "modified", "e", body, 0),
        ("lost", "m", "modified", "f", None, 0), ("lost", "n", "modified", "g", body, 1),
    ]
    df = spark.createDataFrame(entries, "path string, branch string, status string, blob string, content string, seq int")
    bases = spark.createDataFrame([(p, "m", "n", body) for p in ("merge", "clash")], "path string, a string, b string, base_content string")
    pairs = G.pair_verdicts(df, bases)
    assert rows(pairs, "path", "verdict", "via", "fuller", "extra_count") == [
        ("clash", "conflict", None, None, None), ("lost", None, None, None, None), ("merge", "auto_mergeable", None, None, None), ("same", "identical", "blob", None, None), ("sub", "a_subset_of_b", None, "n", 1),
    ]
    files = G.file_verdicts(df, pairs)
    assert rows(files, "path", "verdict", "unread_pairs") == [
        ("clash", "needs_variant", 0), ("gone", "redundant", 0), ("lost", "auto_mergeable", 1), ("merge", "auto_mergeable", 0), ("same", "redundant", 0), ("sub", "redundant", 0),
    ]
    assert tuple(G.summary(files).first()) == (3, 2, 1)


def test_truth_classes(spark):
    atoms = [(f"a{k}", "t", f"a{k}", False) for k in range(12)] + [("e3", "t", "a3", False), ("h", "t", "h", True), ("h", "t", "h", True), ("n", None, None, None)]
    base = [f"a{k}" for k in range(8)]
    docs = {
        "base": base, "copy": base, "sup": [*base, "a9"], "shuffled": base[::-1], "edit": [*base[:3], "e3", *base[4:]], "edit2": [*base[:3], "a10", *base[4:]], "tiny": ["h"], "other": ["h", "a11", "n"], "none": None,
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "id string, atoms array<string>, root long")
    also = spark.createDataFrame([("other", "tiny"), ("base", "copy"), ("base", "other"), ("gone", "tiny")], "a string, b string")
    known = spark.createDataFrame(atoms, "id string, text string, root string, boiler boolean")
    found = {(r["a"], r["b"]): (r["cls"], r["subset"]) for r in B.truth(df, known, also).collect()}
    assert ("other", "tiny") not in {(r["a"], r["b"]) for r in B.truth(df, known).collect()}
    assert found["base", "copy"] == ("identical", None) and found["base", "sup"] == ("subset", "base") and found["base", "shuffled"] == ("reorder", None)
    assert found["base", "edit"] == ("conflict", None) and found["base", "edit2"] == ("additive", None) and found["other", "tiny"] == ("trivial", None)
    assert found["base", "other"] == ("unrelated", None) and ("gone", "tiny") not in found


def test_score_counts_unsafe_merges_first(spark):
    truths = spark.createDataFrame([("a", "b", "identical", None), ("a", "c", "subset", "a"), ("a", "d", "conflict", None), ("b", "c", "unrelated", None), ("b", "d", "additive", None)], "a string, b string, cls string, subset string")
    verdicts = spark.createDataFrame([("a", "b", "collapse", None, None), ("a", "c", "collapse", "c", None), ("a", "d", "collapse", None, None), ("b", "d", "review", None, "additive")], "a string, b string, v string, subset string, type string")
    s = B.score(truths, verdicts).first().asDict()
    assert (s["pairs"], s["unsafe_merges"], s["hidden_by_collapse"], s["collapsed_safely"], s["typed_correct"], s["surfaced"]) == (5, 2, 1, 1, 1, 1)
    assert ("unrelated", 0, 0, 1) in rows(B.score_matrix(truths, verdicts), "cls", "collapse", "review", "separate")


def test_shingle_verdicts(spark):
    text = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([("a", text), ("b", text + " and some more words"), ("c", "q r s"), ("d", None)], "id string, text string")
    pairs = B.shingle_containment(df.where("text is not null"))
    assert rows(B.shingle_verdicts(pairs), "a", "b", "v", "subset") == [("a", "b", "collapse", None)]


def test_multi_segmentation_sees_through_layout(spark):
    units = ["Sentence number %d says a few words of its own here." % k for k in range(12)]
    docs = [("a", "\n\n".join(units)), ("b", "\n".join(units)), ("c", "\n\n".join(units[:10])), ("d", "nothing shared")]
    df = spark.createDataFrame(docs, "id string, text string")
    assert rows(B.multi_verdicts(df), "a", "b", "v", "subset") == [("a", "b", "collapse", None), ("a", "c", "collapse", "c"), ("b", "c", "collapse", "c")]


def test_audit_shares_no_code_with_what_it_checks():
    import ast
    import inspect

    names = [n.module or "" for n in ast.walk(ast.parse(inspect.getsource(A))) if isinstance(n, ast.ImportFrom)]
    assert all(n.split(".")[0] in ("__future__", "collections", "pyspark") for n in names)


def claims(spark):
    base = "\n".join(f"l{k}" for k in range(6))
    contents = spark.createDataFrame([("a", base), ("b", base + "\nmore"), ("c", "x"), ("d", "x")], "id string, content string")
    import hashlib

    h = hashlib.sha256(b"x").hexdigest()
    groups = spark.createDataFrame([(h, "c"), (h, "d")], "hash string, id string")
    pairs = [("a", "b", [(6, "more")], ["b"])]
    return contents, groups, pairs


PAIR = "subset string, superset string, extra array<struct<line:int,text:string>>, final_supersets array<string>"


def test_audit_passes_what_is_true(spark):
    contents, groups, pairs = claims(spark)
    df = spark.createDataFrame(pairs, PAIR)
    assert A.audit(groups, df, contents).count() == 0 and A.claims_checked(groups, df, contents) == 7


@pytest.mark.parametrize("pair,kind", [
    (("b", "a", [], []), "containment_pair"), (("a", "b", [(5, "more")], []), "containment_extra_mismatch"), (("a", "b", None, []), "containment_extra_mismatch"),
    (("a", "b", [(6, "more")], ["c"]), "containment_final_superset"), (("a", "gone", [], []), "missing_record"),
])
def test_audit_finds_false_pairs(spark, pair, kind):
    contents, groups, _ = claims(spark)
    assert kind in {r["type"] for r in A.audit(groups, spark.createDataFrame([pair], PAIR), contents).collect()}


def test_audit_finds_false_and_missed_groups(spark):
    contents, groups, pairs = claims(spark)
    df = spark.createDataFrame(pairs, PAIR)
    wrong = groups.union(spark.createDataFrame([("0" * 64, "a"), ("0" * 64, "b")], groups.schema))
    assert {r["type"] for r in A.audit(wrong, df, contents).collect()} == {"exact_duplicate_group"}
    assert {r["type"] for r in A.audit(groups.limit(0), df, contents).collect()} == {"missed_exact_duplicate"}
    assert A.audit(groups.limit(0), df, contents, complete=False).count() == 0


def test_audit_normalises_alike(spark):
    from samewise.functions.text import normalize

    data = ["﻿a \r\nb\t \rc", "", " ", "x\r\r\ny", "end \t", "a\n\n \n"]
    df = spark.createDataFrame([(d,) for d in data], "x string")
    assert df.where(normalize(F.col("x")) != A.normalized_again(F.col("x"))).count() == 0


def test_deltas_come_back(spark):
    rng = random.Random(9)
    for _ in range(200):
        a, b = ("".join(rng.choice(["a\n", "b\n", "c", "\n", "é\r\n"]) for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert U.undo_delta(a, U.delta(a, b)) == b


def test_actions_and_b_cubed(spark):
    groups = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, rep string")
    pairs = spark.createDataFrame([("a", "x"), ("a", "y")], "subset string, superset string")
    finals = spark.createDataFrame([("a", "x", "y"), ("a", "y", "y")], "subset string, superset string, final_superset string")
    assert rows(U.actions(groups, pairs, finals), "id", "reason", "keep") == [("a", "contained", "y"), ("b", "exact_duplicate", "a")]
    known = spark.createDataFrame([("f", "1"), ("f", "2"), ("g", "3"), ("g", "4")], "family string, id string")
    clusters = spark.createDataFrame([("1", "1"), ("1", "2"), ("1", "3")], "component string, id string")
    r = U.b_cubed(clusters, known).first()
    assert r["items"] == 4 and r["precision"] == pytest.approx((2 / 3 * 2 + 1 / 3 + 1) / 4) and r["recall"] == pytest.approx((1 + 1 + 0.5 + 0.5) / 4)


def test_truth_of_docs_of_boilerplate(spark):
    """Identical, reordered and contained lists count before what is boilerplate."""
    h = [f"h{k}" for k in range(6)]
    docs = {"all": h, "copy": h, "turned": h[::-1], "in": [h[0], "a1", *h[1:]], "five": h[:5], "two": h[:2], "two2": h[:2], "apart": ["a2", "h0"]}
    df = spark.createDataFrame(list(docs.items()), "id string, atoms array<string>")
    known = spark.createDataFrame([(x, x, x.startswith("h")) for x in [*h, "a1", "a2"]], "id string, root string, boiler boolean")
    assert rows(B.truth(df, known), "a", "b", "cls", "subset") == [
        ("all", "copy", "identical", None), ("all", "five", "subset", "five"), ("all", "in", "subset", "all"), ("all", "turned", "reorder", None), ("copy", "five", "subset", "five"),
        ("copy", "in", "subset", "copy"), ("copy", "turned", "reorder", None), ("five", "in", "subset", "five"), ("two", "two2", "identical", None),
    ]
