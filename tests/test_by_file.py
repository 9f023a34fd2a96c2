from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.languages import LANGUAGES
from glyphmill.operators import diff as D
from glyphmill.operators import metrics as M
from glyphmill.plans import api
from glyphmill.sources.files import from_rows
from glyphmill.sources.scanner import scan_files, spread

PIECES = (
    "// note\n", "# note\n", "/* a\n b */", "-- x\n", ";; y\n", "* z\n", "\n", "\x85\n", " \x85\n", "\x85 \n", " \n", "\xa0\n", "\x1c\n", "\r\n", "　// wide\n", "  if (a > 1) {\n", "if a {\n", "}\n", "x = {1,\n 2};\n",
    "g(a,\n b);\n", "function f(uint a,\n uint b) public {\n", "func f(a int) {\n", "fn f() {\n", "contract C {\n", "class C {\n", "export.f\n", "end\n", "for (;;) { h(); }\n", "y ? 1 : 2;\n", "'", '"', "😀\n", "void f(int a)\n{\n",
)


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(5)
    made = [(f"a{k}.{rng.choice(x.extensions)}", "".join(rng.choices(PIECES, k=rng.randrange(30)))) for k, x in enumerate(LANGUAGES * 12)]
    return from_rows(spark, [*made, ("empty.go", ""), ("null.go", None), ("bad.rs", "\x85")]).persist()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tasks_don_t_follow_partitions(spark, files):
    """A table of one row group is one partition; that all of its files were scanned in one task was so before."""
    one = files.coalesce(1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for scanned in (scan_files(one), M.measure_files(one), M.function_texts(one)):
        assert scanned.select(F.spark_partition_id()).distinct().count() == n
    assert _rows(spread(one)) == _rows(one)


def test_only_some_facts(files):
    every = scan_files(files).persist()
    for only in (["function"], ["comment", "branch"], ["norm"], ["container", "call"]):
        assert _rows(scan_files(files, only)) == _rows(every.where(F.col("fact").isin(only)))


def test_metrics_of_files_alone(files):
    assert _rows(M.metrics_of(files)) == _rows(M.file_metrics(files, api.facts_of(files)))


def test_nothing_is_gathered_by_path(spark):
    files = spark.createDataFrame([("a.go", "go", "package p\n")], "path string, language string, content string")
    changes = files.select("path", F.lit("added").alias("status"), F.expr("array(1L)").alias("added"), F.expr("array(1L)").alias("removed"))
    for df in (M.metrics_of(files), M.signatures_of(files), D.metrics_of(changes, files)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and not any(x in plan for x in ("Window", "Aggregate", "InMemory", "Generate"))


def test_measures_equal_operators_on_facts(files):
    facts = scan_files(files).persist()
    got = M.measure_files(files)
    assert _rows(got.where("lines_with_comments > 0").select("path", "lines_with_comments", "comment_only")) == _rows(M.comment_stats(facts.where("fact = 'comment'")))
    assert _rows(got.select("path", "total_lines", "blank_lines")) == _rows(M.line_stats(files.where("content is not null")))
    assert _rows(got.where("adjustment > 0").select("path", "adjustment")) == _rows(M.normalization(facts.where("fact = 'norm'")).where("adjustment > 0"))


def test_signatures_of_files_alone(files):
    assert _rows(M.signatures_of(files)) == _rows(M.signatures_by_file(scan_files(files)))


def test_changes_of_files_alone(files):
    kind = F.element_at(F.array(*map(F.lit, ("added", "modified", "deleted"))), 1 + F.expr("hash(path) & 1") + F.expr("int(length(path) % 2)"))
    changes = files.select("path", kind.alias("status"), F.expr("array(3L, 3L, null, 0L, 99L, 1L, 2L, 4L, 5L, 6L, 7L, 8L, 9L, 12L)").alias("added"), F.expr("array(1L)").alias("removed"))
    got = D.metrics_of(changes, files)
    assert _rows(got) == _rows(D.diff_metrics(changes, files, api.facts_of(files))) and got.where("diff_complexity > 0").count() > 20


def test_the_metrics_tool_reads_all_files(spark, tmp_path):
    """More parts than the 150 that it was cut to."""
    from glyphmill import queries as Q

    spark.range(400).selectExpr("id as p_partkey", "int(id % 50) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert _rows(Q.tool_metrics(spark, str(tmp_path))) == _rows(Q.file_metrics(spark, str(tmp_path)))
    assert "150" not in Q.oracle_sql()["tool_metrics"]


def test_reading_follows_resolve(spark, tmp_path):
    from glyphmill.sources import files as S

    for k, name in enumerate(("src/a.go", "src/b.rs", "src/x/B.RS", "src/x/ü c.sol", "src/.h.go", "src/n.txt", "o/[z].go", "src/x/y/d.ts")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff// x" * k)
    root = str(tmp_path)
    for patterns in ("**/*", ["src/**/*", "!**/*.rs"], ["src/**/*", "!src/x/**", "src/x/*.{sol,ts}"], ["!**/*", "src/*.go"], ["**/*", "!**/*"], f"{root}/src/*", ["src/**/*", "src/**/**/*"], [], "../*/src/*.go"):
        want = [p for p in S.resolve(patterns, root) if S.known(p)]
        got = S.read(spark, patterns, root).collect()
        assert sorted(f"{root}/{r.path}" if not r.path.startswith("/") else r.path for r in got) == want, patterns
        assert all(r.content == open(f"{root}/{r.path}" if not r.path.startswith("/") else r.path, "rb").read().decode("utf-8", "replace") for r in got)
