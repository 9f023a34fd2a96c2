"""The five tools: peek, metrics, execution_paths, diff_metrics and diff, as DataFrames.

Facts that several questions read are kept until ``release()``, or the end of the ``scope()`` in which a tool was called.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..caching import keep, release, scope
from ..languages import route
from ..operators import diff as D
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import paths as P
from ..sources import files as S
from ..sources import git
from ..sources.scanner import scan_files

__all__ = ["Report", "call_graph", "diff", "diff_metrics", "execution_paths", "metrics", "peek", "release", "scope"]


@dataclass
class Report:
    """Rows and what sums them up."""

    rows: DataFrame
    summary: DataFrame
    by_status: DataFrame | None = None


def facts_of(files: DataFrame) -> DataFrame:
    """Facts of the files, kept: all questions about them read the one scan."""
    return keep(scan_files(files))


def peek(spark: SparkSession, patterns: str | Iterable[str], root: str = ".") -> DataFrame:
    """(path, signatures) of the files that have functions."""
    return peek_files(S.read(spark, patterns, root))


def peek_files(*files: DataFrame) -> DataFrame:
    """(path, signatures); of several collections of files with a path in common the last counts."""
    return M.merge_maps(*map(M.signatures_of, files)) if len(files) > 1 else M.signatures_of(*files)


def metrics(spark: SparkSession, patterns: str | Iterable[str], root: str = ".") -> Report:
    return metrics_of_files(S.read(spark, patterns, root))


def metrics_of_files(files: DataFrame) -> Report:
    rows = M.metrics_of(files)
    return Report(rows, M.summary(rows))


def execution_paths(spark: SparkSession, patterns: str | Iterable[str], root: str = ".") -> DataFrame:
    """(root, root_ord, rank, path) of the longest paths from each entry point."""
    return execution_paths_of_files(S.read(spark, patterns, root))


def execution_paths_of_files(files: DataFrame) -> DataFrame:
    nodes, edges = G.combined(facts_of(files), files)
    return P.execution_paths(nodes, edges)


def call_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return G.combined(facts_of(files), files)


def _sides(spark: SparkSession, base: str, head: str, paths: Iterable[str], cwd: str, working_tree: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The diff, and the files of known languages before and after: where the revisions parted, and the head, or what lies in the working tree now."""
    diffs = keep(git.diffs(spark, base, head, paths, cwd))
    # Only paths come to the driver; executors ask git for the contents.
    listed = [(r.path, r.old_path, r.status) for r in D.status(diffs).select("path", "old_path", "status").collect() if S.known(r.path)]
    before = git.snapshots(spark, git.merge_base(base, head, cwd), [o for _, o, s in listed if s != "added" and o], cwd)
    # A renamed file is compared under its new name.
    names = spark.createDataFrame([(o, p) for p, o, s in listed if s != "added" and o], "old string, new string")
    before = before.join(names, F.col("path") == F.col("old")).select(F.col("new").alias("path"), "content")
    kept = [p for p, _, s in listed if s != "deleted"]
    after = git.working_tree(spark, kept, cwd) if working_tree else git.snapshots(spark, head, kept, cwd)
    return diffs, route(before), route(after)


def diff_metrics(
    spark: SparkSession, base: str, head: str = "HEAD", paths: Iterable[str] = (), cwd: str = ".", working_tree: bool = False
) -> Report:
    """Metrics of changed lines by file, with totals."""
    diffs, before, after = _sides(spark, base, head, paths, cwd, working_tree)
    changes = D.changed_lines(diffs)
    gone = before.join(changes.where("status = 'deleted'").select("path"), "path", "left_semi").withColumn("content", F.lit(""))
    files = after.unionByName(gone)
    rows = D.metrics_of(changes, files)
    return Report(rows, D.summary(rows), D.files_by_status(rows))


def diff(
    spark: SparkSession,
    base: str,
    head: str = "HEAD",
    paths: Iterable[str] = (),
    output: str = "full",
    cwd: str = ".",
    working_tree: bool = False,
) -> DataFrame:
    """``full``: (path, status, diff) of all files; ``signatures``: (path, status, added, modified, removed) of those in known languages."""
    if output == "full":
        return D.full_diff(git.diffs(spark, base, head, paths, cwd))
    if output != "signatures":
        raise ValueError(f"output is full or signatures, not {output}")
    diffs, before, after = _sides(spark, base, head, paths, cwd, working_tree)
    old, new = (M.signatures(keep(scan_files(x.where("content <> ''"), ["function"])), 120) for x in (before, after))
    changes = D.changed_lines(diffs)
    # Without both contents there is nothing to compare in a modified file.
    both = before.where("content <> ''").join(after.where("content <> ''").select("path"), "path", "left_semi").select("path")
    comparable = changes.where("status <> 'modified'").unionByName(changes.where("status = 'modified'").join(both, "path", "left_semi"))
    return D.signature_changes_by_file(D.signature_changes(comparable, old, new))
