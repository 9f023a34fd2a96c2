from __future__ import annotations

import subprocess

import pytest

from glyphmill.operators import diff as D
from glyphmill.plans import api
from glyphmill.sources import files as S
from glyphmill.sources import git
from glyphmill.sources.files import from_rows

NESTED = "contract A {\n  function f() public {\n    if (a) {\n      if (b) {\n        x = 1;\n      }\n    }\n\n    // note\n    y = 2;\n  }\n}"


@pytest.mark.parametrize(
    "added, removed, status, expected",
    [
        ([2, 10], [], "modified", (2, 0, 2, 0, 0.0)),
        ([5], [], "modified", (1, 0, 1, 2, 0.0)),
        ([], [1, 2, 3], "deleted", (0, 3, 0, 0, 0.0)),
        ([1, 2, 3], [], "added", (3, 0, 3, 1, 0.0)),
        ([9, 10], [], "modified", (2, 0, 1, 0, 100.0)),
        ([8, 10], [4], "modified", (2, 1, 1, 0, 0.0)),
        ([90], [], "modified", (1, 0, 0, 0, 0.0)),
    ],
)
def test_changed_files(spark, added, removed, status, expected):
    files = from_rows(spark, [("a.sol", NESTED)])
    changes = spark.createDataFrame([("a.sol", status, added, removed)], "path string, status string, added array<long>, removed array<long>")
    r = D.diff_metrics(changes, files, api.facts_of(files)).first()
    assert (r.added_lines, r.removed_lines, r.diff_nloc, r.diff_complexity, r.comment_density) == expected
    assert (r.estimated_hours > 0) == (expected[2] > 0)


def test_last_line_is_never_comment_alone(spark):
    files = from_rows(spark, [("a.sol", "contract A {}\n// end")])
    changes = spark.createDataFrame([("a.sol", "modified", [1, 2], [])], "path string, status string, added array<long>, removed array<long>")
    assert D.diff_metrics(changes, files, api.facts_of(files)).first().diff_nloc == 2


def test_changed_line_numbers():
    text = "diff --git a/x.sol b/x.sol\n--- a/x.sol\n+++ b/x.sol\n@@ -1,2 +1,1 @@\n-a\n+b\n c\n@@ -9,1 +8,3 @@ ctx\n same\n+one\n+two\n\\ No newline at end of file\n"
    got = git.parse_file(text)
    assert [[(c["type"], c["line"]) for c in h["changes"]] for h in got["hunks"]] == [[("delete", 1), ("insert", 1), ("normal", 2)], [("normal", 8), ("insert", 9), ("insert", 10)]]
    assert (got["type"], got["old_path"], got["new_path"]) == ("modify", "x.sol", "x.sol")


@pytest.fixture
def repository(tmp_path):
    def run(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=tmp_path, check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (tmp_path / "a.sol").write_text("contract A {\n  function foo() public {\n    x = 1;\n  }\n  function bar() public {\n    y = 1;\n  }\n  function same() public {}\n}\n")
    (tmp_path / "gone.go").write_text("package p\nfunc Old() {}\n")
    (tmp_path / "old name.rs").write_text("fn kept() {\n  let a = 1;\n  let b = 2;\n  let c = 3;\n}\n")
    (tmp_path / "notes.txt").write_text("text\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("branch", "other")
    (tmp_path / "a.sol").write_text("contract A {\n  function foo() public {\n    if (z) {\n      x = 2;\n    }\n  }\n  function baz() public {\n    y = 1;\n  }\n  function same() public {}\n}\n")
    (tmp_path / "gone.go").unlink()
    (tmp_path / "old name.rs").rename(tmp_path / "new name.rs")
    (tmp_path / "notes.txt").write_text("text\nmore\n")
    (tmp_path / "new.rs").write_text("fn fresh() {}\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    (tmp_path / "a.sol").write_text("not what was committed")
    return str(tmp_path)


def test_git(spark, repository):
    got = {r.path: r for r in api.diff(spark, "main~1", "main", output="signatures", cwd=repository).collect()}
    assert {p: (r.status, r.added, r.modified, r.removed) for p, r in got.items()} == {
        "a.sol": ("modified", ["function baz() public"], ["function foo() public"], ["function bar() public"]),
        "gone.go": ("deleted", [], [], ["func Old()"]),
        "new.rs": ("added", ["fn fresh()"], [], []),
    }
    full = {r.path: r for r in api.diff(spark, "main~1", "main", cwd=repository).collect()}
    assert set(full) == {"a.sol", "gone.go", "new name.rs", "new.rs", "notes.txt"}
    assert full["notes.txt"].diff == "--- a/notes.txt\n+++ b/notes.txt\n@@ -1 +1,2 @@\n text\n+more"
    report = api.diff_metrics(spark, "main~1", "main", cwd=repository)
    rows = {r.path: r for r in report.rows.collect()}
    assert {p: (r.status, r.added_lines, r.removed_lines, r.diff_nloc) for p, r in rows.items()} == {
        "a.sol": ("modified", 4, 2, 4), "gone.go": ("deleted", 0, 2, 0), "new.rs": ("added", 1, 0, 1), "new name.rs": ("modified", 0, 0, 0),
    }
    assert rows["a.sol"].diff_complexity == 3
    assert report.summary.first().files_changed == 4
    assert {r.status: r.files for r in report.by_status.collect()} == {"added": 1, "deleted": 1, "modified": 2}
    assert [r.path for r in api.diff(spark, "main~1", "main", ["notes.txt"], cwd=repository).collect()] == ["notes.txt"]
    assert api.diff(spark, "main", "main", cwd=repository).collect() == []
    now = api.diff(spark, "main~1", "main", ["a.sol"], "signatures", repository, working_tree=True).first()
    assert (now.added, now.modified, len(now.removed)) == ([], [], 3)


def test_bad_revisions_are_errors(spark, repository):
    for ref in ("nowhere", "--output=x", "main; ls"):
        with pytest.raises(git.GitError):
            api.diff(spark, ref, "main", cwd=repository)
    with pytest.raises(ValueError):
        api.diff(spark, "main~1", "main", output="other", cwd=repository)


def test_files(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    for name in ("src/a.sol", "src/deep/b c.rs", "src/deep/x.txt", "src/.hidden.sol", "src/d%41.go"):
        (tmp_path / name).write_text("fn f() {}\n")
    root = str(tmp_path)
    assert [p[len(root) + 1 :] for p in S.resolve(["src/**/*.{sol,rs}", "src/a.sol"], root)] == ["src/a.sol", "src/deep/b c.rs"]
    assert S.resolve(["src/**/*", "!src/deep/**"], root) == [f"{root}/src/a.sol", f"{root}/src/d%41.go"]
    got = S.read(spark, "src/**/*", root)
    assert [(r.path, r.language, r.content) for r in got.orderBy("file_ord").collect()] == [
        ("src/a.sol", "solidity", "fn f() {}\n"), ("src/d%41.go", "go", "fn f() {}\n"), ("src/deep/b c.rs", "rust", "fn f() {}\n"),
    ]
    assert S.read(spark, "nothing/*", root).count() == 0
    assert S.read_tree(spark, root).count() >= 3
    assert [r.signatures for r in api.peek(spark, "src/**/*.rs", root).collect()] == [["fn f()"]]
    assert api.metrics(spark, "src/**/*.rs", root).summary.first().total_nloc == 1


def test_streaming(spark, tmp_path):
    from glyphmill.streaming.files import arriving, write_metrics

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sol").write_text(NESTED)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for name in (None, "b.go"):
        if name:
            (tmp_path / "in" / name).write_text("package p\nfunc F() {}\n")
        write_metrics(arriving(spark, str(tmp_path / "in")), out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.path.rpartition("/")[2], r.nloc) for r in rows) == [("a.sol", 10), ("b.go", 2)]
