import json
import os
import subprocess

import pytest

from samewise import cli
from samewise.plans import catalog
from samewise.plans.files_plan import report, run_files, sections
from samewise.sources import files as L
from samewise.sources import git as V
from samewise.sources.report import read_report, write_report, write_sections
from tests.conftest import rows


@pytest.fixture
def corpus(tmp_path):
    base = "\n".join(f"line {k} of the report about wombats" for k in range(8))
    texts = {
        "a.md": base, "copy/b.md": base, "c.md": base + "\nand more", "d e%20+.txt": "alpha beta gamma delta epsilon zeta", "f.txt": "alpha beta gamma delta epsilon eta", "g.json": "unrelated words only",
        "node_modules/x.md": "skip", "deep/.git/y.md": "skip", "out/z.md": "skip", "image.png": "skip", "crlf.md": "one\r\ntwo",
    }
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (tmp_path / "bad.js").write_bytes(b"\xff\xfe ok \0")
    (tmp_path / ".gitignore").write_text("# note\n/out/\n*.log\n!keep\na/b\n")
    return tmp_path


def test_load_records(spark, corpus):
    found = {r["id"]: r["content"] for r in L.load_records(spark, str(corpus)).collect()}
    assert set(found) == {"a.md", "copy/b.md", "c.md", "d e%20+.txt", "f.txt", "g.json", "crlf.md", "bad.js"}
    assert found["crlf.md"] == "one\r\ntwo" and "�" in found["bad.js"]
    assert "bad.js" not in {r["id"] for r in L.load_records(spark, str(corpus), skip_binary=True).collect()}
    assert L.count_binary(spark, str(corpus)) == 1
    assert "out/z.md" in {r["id"] for r in L.load_records(spark, str(corpus), respect_gitignore=False).collect()}
    assert "node_modules/x.md" in {r["id"] for r in L.load_records(spark, str(corpus), ignore={"copy"}).collect()}


def test_cap_is_met_when_reached(spark, corpus):
    with pytest.raises(L.TooManyFiles):
        L.load_records(spark, str(corpus), max_files=8)
    assert L.load_records(spark, str(corpus), max_files=9).count() == 8


def test_count_reads_no_content(spark, corpus):
    df = L.count_files(spark, str(corpus))
    assert ("." + "md", 4) in [(r["extension"], r["files"]) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "content:binary" not in plan


def test_files_pipeline_and_audit_by_command_line(spark, corpus, capsys):
    out = str(corpus / "report.out")
    assert cli.main(["files", "--dir", str(corpus), "--out", out, "--threshold", "0.5"], spark) == 0
    r = json.loads(open(out).read())
    assert [g["ids"] for g in r["exactDuplicateGroups"]] == [["a.md", "copy/b.md"]]
    assert [(p["subset"], p["superset"], p["extra"], p["finalSupersets"]) for p in r["containmentPairs"]] == [("a.md", "c.md", [{"line": 8, "text": "and more"}], ["c.md"])]
    assert [c["ids"] for c in r["similarityClusters"]] == [["d e%20+.txt", "f.txt"]]
    assert [(f["stage"], f["records_in"], f["records_out"]) for f in sorted(r["funnel"], key=lambda f: -f["records_out"])][0] == ("load", None, 8)
    assert cli.main(["audit", "--report", out, "--dir", str(corpus)], spark) == 0
    (corpus / "copy" / "b.md").write_text("changed")
    assert cli.main(["audit", "--report", out, "--dir", str(corpus)], spark) == 1
    assert "exact_duplicate_group" in capsys.readouterr().out


def test_files_report_as_tables(spark, corpus, tmp_path, capsys):
    out = str(tmp_path / "tables")
    assert cli.main(["files", "--dir", str(corpus), "--sections", out], spark) == 0
    assert "load(8)" in capsys.readouterr().out and spark.read.parquet(f"{out}/files.parquet").count() == 8


def test_scan_and_passes(spark, corpus, capsys):
    assert cli.main(["scan", "--dir", str(corpus)], spark) == 0
    assert "8 files" in capsys.readouterr().out
    assert cli.main(["passes"], spark) == 0
    assert "2b" in capsys.readouterr().out


@pytest.mark.parametrize("argv,code", [([], 1), (["nothing"], 1), (["files"], 1), (["git"], 1), (["audit", "--dir", "x"], 1), (["--help"], 0)])
def test_exit_codes(argv, code, capsys):
    assert cli.main(argv) == code


def test_normalised_report_and_sections(spark, tmp_path):
    df = spark.createDataFrame([("a", "x \r\ny"), ("b", "x\ny"), ("c", None)], "id string, content string")
    result = run_files(df, normalize=True)
    path = str(tmp_path / "r.json")
    write_report(report(result), path)
    groups, pairs, normalized, complete = read_report(spark, path)
    assert normalized and complete and rows(groups, "id") == [("a",), ("b",)] and pairs.count() == 0
    write_sections(sections(result), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/exact_duplicate_groups.parquet")).count() == 2


def test_empty_input(spark):
    r = report(run_files(spark.createDataFrame([], "id string, content string")))
    assert r["totalFiles"] == 0 and r["similarityClusters"] == []


def test_parse_changes():
    listing = "\0".join(["M", "a b.md", "A", "n.md", "D", "d.md", "R090", "old.md", "new.md", "C100", "x", "y", ""])
    assert V.parse_changes(listing) == [("a b.md", "modified", None), ("n.md", "added", None), ("d.md", "deleted", None), ("new.md", "renamed", "old.md"), ("y", "copied", "x")]
    assert V.parse_changes("") == []


def test_git_pipeline(spark, tmp_path):
    def git(where, *args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=where, check=True, capture_output=True)

    origin, clone = tmp_path / "origin", tmp_path / "clone"
    origin.mkdir()
    git(origin, "init", "-q", "-b", "trunk")
    body = "\n".join(f"line {k}" for k in range(8)) + "\n"
    (origin / "f.md").write_text(body)
    (origin / "g.md").write_text(body)
    git(origin, "add", ".")
    git(origin, "commit", "-qm", "base")
    edits = {"one": {"f.md": "top\n" + body, "g.md": body.replace("line 3", "x")}, "two": {"f.md": body + "end\n", "g.md": body.replace("line 3", "y")}}
    for branch, changed in edits.items():
        git(origin, "checkout", "-q", "-b", branch, "trunk")
        for name, text in changed.items():
            (origin / name).write_text(text)
        git(origin, "commit", "-qam", branch)
    git(origin, "checkout", "-q", "trunk")
    git(tmp_path, "clone", "-q", str(origin), str(clone))
    assert V.default_base(str(clone)) == "origin/trunk"
    assert V.branches_of(str(clone), "origin/trunk", exclude=("origin/two",)) == ["origin/one"]
    out = str(tmp_path / "git.json")
    assert cli.main(["git", "--repo", str(clone), "--base", "origin/trunk", "--out", out], spark) == 0
    r = json.loads(open(out).read())
    assert {p: f["verdict"] for p, f in r["files"].items()} == {"f.md": "auto_mergeable", "g.md": "needs_variant"}
    assert r["summary"] == {"redundant": 0, "auto_mergeable": 1, "needs_variant": 1} and len(r["branchesScanned"]) == 2


CHEAP = ["exact_groups", "containment_pairs", "containment_extra_lines", "cosine_edges", "similarity_clusters", "pipeline_funnel", "branch_pair_containment", "segments_sentence", "block_verdicts", "multi_segment_verdicts", "truth_classes", "score_summary", "audit_missing", "audit_completeness", "audit_exact", "audit_claims", "pair_classes", "cluster_member_scores", "pipeline_verdicts", "score_merged", "merge3_one_sided", "files_loaded", "files_ignored", "csv_groups", "git_entries", "git_files"]


@pytest.mark.parametrize("name", CHEAP)
def test_queries_as_by_sql(spark, folder, name):
    import duckdb

    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    sql = con.execute(catalog.oracle_sql()[name])
    names = sorted(d[0] for d in sql.description)
    order = [[d[0] for d in sql.description].index(n) for n in names]
    plain = lambda v: round(float(v), 5) if isinstance(v, float) else v
    truth = sorted((tuple(plain(r[k]) for k in order) for r in sql.fetchall()), key=repr)
    found = catalog.queries()[name](spark, folder)
    assert sorted(found.columns) == names
    assert sorted((tuple(map(plain, r)) for r in found.select(*names).collect()), key=repr) == truth


def test_core_stands_alone():
    """Nothing in the core imports the subpackage for training data."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for at, _, names in os.walk(os.path.join(root, "samewise")):
        if os.path.basename(at) not in ("llm", "__pycache__"):
            for n in names:
                if n.endswith(".py"):
                    text = open(os.path.join(at, n), encoding="utf-8").read()
                    assert ".llm" not in text and "import llm" not in text, n


def test_audit_reports_real_claims(spark, tmp_path):
    """A wrong difference and a wrong final superset in the table come out; right ones don't."""
    from samewise.plans import catalog

    at = "timestamp'2024-01-01'"
    spark.sql(f"SELECT id, content, 'main' AS branch, {at} AS modified_at, {at} AS loaded_at FROM VALUES ('s', 'a\\nb'), ('t', 'a\\nx\\nb'), ('u', 'other') AS v(id, content)").write.parquet(f"{tmp_path}/records.parquet")
    claims = " UNION ALL ".join(
        f"SELECT '{a}' AS subset, '{b}' AS superset, array(named_struct('line', {line}, 'text', 'x')) AS extra, array('{f}') AS final_supersets, {at} AS generated_at, {at} AS loaded_at"
        for a, b, line, f in (("s", "t", 1, "t"), ("s", "t", 0, "t"), ("s", "t", 1, "u"))
    )
    spark.sql(claims).write.parquet(f"{tmp_path}/containment_pairs.parquet")
    found = lambda name: [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
    assert found("audit_extra_reported") == [("containment_extra_mismatch", "s", "t")]
    assert found("audit_final_supersets_reported") == [("containment_final_superset", "s", "u")]
