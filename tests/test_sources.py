import random
import subprocess

import pytest
from pyspark.sql import functions as F

from samewise.operators import blocks as B
from samewise.operators import containment as C
from samewise.operators import exact as E
from samewise.operators import similarity as S
from samewise.plans import files_plan as P
from samewise.sources import corpus as G
from samewise.sources import files as L
from samewise.sources import git as V
from samewise.sources import report as R
from tests.conftest import rows


def test_files_written_and_read_again(spark, tmp_path):
    data = [("a/b.md", "x\r\ny"), ("empty.txt", ""), ("c d%20.md", "é\U0001f600"), (None, "x"), ("null.md", None)]
    df = spark.createDataFrame([(*d, "extra") for d in data], "id string, content string, length string")
    assert L.write_files(df, str(tmp_path / "d")) == 3
    found = L.load_records(spark, str(tmp_path / "d"), ordered=True)
    assert [tuple(r) for r in found.collect()] == sorted(data[:3])
    assert rows(L.count_files(spark, str(tmp_path / "d")), "extension", "files", "bytes") == [(".md", 2, 10), (".txt", 1, 0)]
    assert L.write_files(df.limit(0), str(tmp_path / "e")) == 0
    with pytest.raises(Exception, match="leads out"):
        L.write_files(spark.createDataFrame([("../x", "y")], "id string, content string"), str(tmp_path / "d"))


def test_csv_keeps_quotes_lines_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([('a"b', "x\ny"), ("c,d", None), ("", "é")], "k string, v string")
    R.write_csv(df, str(tmp_path / "t"))
    assert rows(R.read_csv(spark, str(tmp_path / "t"), "k string, v string"), "k", "v") == rows(df, "k", "v")


def test_branches_written_as_a_repository(tmp_path):
    repo = str(tmp_path / "r")
    V.write_branches(repo, {"f.md": "one\ntwo\n", "g h.md": ""}, [("x.md", "f.md", "one\n2\n"), ("gone", "f.md", None), ("same", "f.md", "one\ntwo\n"), ("new", "n.md", "é")])
    assert V.default_base(repo) == "origin/main" and sorted(V.branches_of(repo, "origin/main")) == ["origin/gone", "origin/new", "origin/same", "origin/x.md"]
    found = {b: V.changes(repo, "origin/main", f"origin/{b}")[1] for b in ("x.md", "gone", "same", "new")}
    assert found == {"x.md": [("f.md", "modified", None)], "gone": [("f.md", "deleted", None)], "same": [], "new": [("n.md", "added", None)]}
    assert V.git(repo, "show", "origin/new:n.md") == "é"


def test_wrap():
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(1, 40)))
        lines = G.wrap(text, 20).split("\n")
        assert " ".join(lines) == text and all(len(x) <= 20 for x in lines)
        assert all(len(a) + 1 + len(b.split(" ")[0]) > 20 for a, b in zip(lines, lines[1:], strict=False))
    assert G.wrap("a " + "b" * 30, 20) == "a\n" + "b" * 30


def test_made_corpus(spark):
    docs, atoms = G.make_corpus(spark, [1, 2], 4)
    again, _ = G.make_corpus(spark, [2], 4)
    cols = ("id", "atoms", "text", "render")
    assert rows(docs.where("seed = 2"), *cols) == rows(again, *cols)
    known = {r["id"]: r for r in atoms.collect()}
    assert len(known) == atoms.count()
    for d in docs.collect():
        words = " ".join(known[a]["text"] for a in d["atoms"]).split()
        assert d["text"].split() == words and ("\r" in d["text"]) == (d["render"] == "crlf")
    cls = {r["cls"] for r in B.truth(docs.select("id", "atoms"), atoms).collect()}
    assert {"identical", "subset", "reorder", "conflict", "additive"} & cls >= {"identical", "subset"}
    assert docs.where("id like '%t-%'").count() == 4


def test_classified(spark):
    five = "\n".join("abcde")
    cases = [
        (five, five, "identical"), (five, five + "\nx", "a_subset_of_b"), ("y\n" + five, five, "b_subset_of_a"), (five, "e\nd\nc\nb\na", "neither"),
        ("a\nb", "a\nb\nc", "neither"), (five, five + "\n" + "\n".join("x" * 200), "neither"), (None, five, None), ("", "x", "neither"),
    ]
    df = spark.createDataFrame([(*c, k) for k, c in enumerate(cases)], "a string, b string, want string, k long")
    got = df.select("k", "want", C.classified(F.col("a"), F.col("b"), 5, 20.0).alias("got"), C.classified(F.col("a"), F.col("b")).alias("free"))
    assert all(r["want"] == r["got"] for r in got.collect())
    assert {r["k"]: r["free"] for r in got.collect()}[4] == "a_subset_of_b"


def test_holders_of_a_hot_line_meet_in_parts(spark):
    data = [(f"r{k:02}", "\n".join(f"line {j}" for j in range(3 + k % 9))) for k in range(9)] + [("x", "other\nlines\nhere")]
    split = C.with_lines(spark.createDataFrame(data, "id string, content string"))
    want = rows(C.candidates(split, 1), "subset", "superset")
    assert rows(C.candidates(split, 1, part_rows=2), "subset", "superset") == want and len(want) == 36


def test_pipeline_as_pair_verdicts(spark):
    body = "\n".join(f"line {k} of the text" for k in range(8))
    near = "alpha beta gamma delta epsilon zeta eta theta"
    data = [("a", body), ("b", body), ("c", body + "\nmore"), ("d", near), ("e", near + " iota"), ("f", "something else entirely here")]
    r = P.run_files(spark.createDataFrame(data, "id string, content string"))
    found = {(x["a"], x["b"]): (x["v"], x["subset"]) for x in P.pair_verdicts(r).collect()}
    assert found == {("a", "b"): ("collapse", None), ("a", "c"): ("collapse", "a"), ("b", "c"): ("collapse", "b"), ("d", "e"): ("review", None)}


def test_all_members_have_scores(spark):
    data = [("a", "x y z w"), ("b", "x y z v"), ("c", "x y v u"), ("d", "q")]
    df = spark.createDataFrame(data, "id string, content string")
    vectors = S.Embedder(df, lambda c: F.split(c, " ")).transform(df)
    members = spark.createDataFrame([("a", i) for i in "abcd"], "component string, id string")
    for parts in (100, 1):
        got = {(r["a"], r["b"]): r["score"] for r in S.member_scores(vectors, members, parts).collect()}
        assert len(got) == 6 and got["a", "d"] == 0.0 and got["a", "b"] > got["a", "c"] > 0


def test_merged_scores_are_sums(spark):
    t = spark.createDataFrame([("a", "b", "identical", None), ("a", "c", "conflict", None)], "a string, b string, cls string, subset string")
    v = spark.createDataFrame([("a", "b", "collapse", None, None)], "a string, b string, v string, subset string, type string")
    one = B.score(t, v)
    two = B.merged(one.union(one)).first().asDict()
    assert two == {k: 2 * n for k, n in one.first().asDict().items()} and two["collapsed_safely"] == 2
    assert E.group_stats(E.identified(spark.createDataFrame([], "id string, content string"))).count() == 0


def test_branches_are_read_without_a_process_for_each(spark, tmp_path, monkeypatch):
    """As git tells branch by branch and pair by pair: plain, stacked, merged, empty and unrelated branches, renames, deletions."""

    def git(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=tmp_path, check=True, capture_output=True)

    def commit(name, text):
        (tmp_path / name).write_text(text)
        git("add", "-A")
        git("commit", "-qm", name)

    body = "\n".join(f"line {k}" for k in range(30)) + "\n"
    git("init", "-q", "-b", "main")
    commit("f.md", body)
    commit("g h.md", body * 2)
    for name, start in (("one", "main~1"), ("two", "main"), ("stacked", "two"), ("merged", "two"), ("moved", "main"), ("gone", "main"), ("empty", "main~1")):
        git("checkout", "-q", "-b", name, start)
        if name == "merged":
            git("merge", "-q", "one", "-m", "m", "-X", "ours")
        elif name == "moved":
            git("mv", "f.md", "é.md")
            git("commit", "-qm", "moved")
        elif name == "gone":
            git("rm", "-q", "f.md")
            git("commit", "-qm", "gone")
        elif name != "empty":
            commit("f.md", body + name + "\n")
            commit("new.md", f"\n{name} \n")
    git("checkout", "-q", "--orphan", "apart")
    commit("f.md", "apart")
    git("checkout", "-q", "main")
    commit("later.md", "x")
    for name in ("main", "one", "two", "stacked", "merged", "moved", "gone", "empty", "apart"):
        git("update-ref", f"refs/remotes/origin/{name}", name)
    repo, names, asked = str(tmp_path), [f"origin/{n}" for n in ("one", "two", "stacked", "merged", "moved", "gone", "empty", "apart")], []
    whole = V.git
    want = {(p, b, status, former, fork) for b in names if whole(repo, "merge-base", "origin/main", b) for fork, found in [V.changes(repo, "origin/main", b)] for p, status, former in found}
    monkeypatch.setattr(V, "git", lambda *a: asked.append(a[1]) or whole(*a))
    scan = V.scan_branches(spark, repo, base="origin/main", fetch=False)
    assert asked.count("merge-base") == 1  # of the merged one; before, of each
    entries = scan.entries.collect()
    assert scan.skipped == ["origin/apart"] and {(e["path"], e["branch"], e["status"], e["renamed_from"], e["fork_point"]) for e in entries} == want
    for e in entries:
        ref = f"{e['branch']}:{e['path']}"
        assert (e["blob"], e["content"]) == ((None, None) if e["status"] == "deleted" else (whole(repo, "rev-parse", ref), whole(repo, "show", ref)))
    bases = scan.bases.collect()
    assert len(bases) > 8
    for x in bases:
        assert x["base_content"] == whole(repo, "show", f"{whole(repo, 'merge-base', x['a'], x['b'])}:{x['path']}")
