"""What changed between two revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.scanner import measure_changes, spread
from . import intervals, metrics

CHANGE = "struct<type:string,content:string,line:long>"
HUNK = f"struct<header:string,changes:array<{CHANGE}>>"
#: A row for each file of a diff; insertions have lines of the new side, deletions of the old one, both from 1.
FILE_DIFFS = f"file_ord long, type string, old_path string, new_path string, hunks array<{HUNK}>"


def status(diffs: DataFrame) -> DataFrame:
    """``diffs`` with ``status`` and ``path``, which is the new one unless the file is gone."""
    kind = F.when(F.col("type") == "add", "added").when(F.col("type") == "delete", "deleted").otherwise("modified")
    gone = (F.col("type") == "delete") | F.col("new_path").isNull() | (F.col("new_path") == "/dev/null")
    return diffs.withColumn("status", kind).withColumn("path", F.when(gone, F.col("old_path")).otherwise(F.col("new_path")))


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(path, status, added, removed): lists of line numbers in the order of the diff."""
    every = F.flatten(F.transform("hunks", lambda h: h["changes"]))
    of = lambda kind: F.transform(F.filter(every, lambda c: c["type"] == kind), lambda c: c["line"])
    return status(diffs).select("path", "status", of("insert").alias("added"), of("delete").alias("removed"))


def full_diff(diffs: DataFrame) -> DataFrame:
    """(path, status, diff): the text of each file's diff."""
    sign = lambda c: F.when(c["type"] == "insert", "+").when(c["type"] == "delete", "-").otherwise(" ")
    body = F.flatten(
        F.transform("hunks", lambda h: F.concat(F.array(h["header"]), F.transform(h["changes"], lambda c: F.concat(sign(c), c["content"]))))
    )
    old, new = F.coalesce("old_path", F.lit("/dev/null")), F.coalesce("new_path", F.lit("/dev/null"))
    head = F.array(F.concat(F.lit("--- a/"), old), F.concat(F.lit("+++ b/"), new))
    return status(diffs).select("path", "status", F.array_join(F.concat(head, body), "\n").alias("diff"))


def diff_metrics(changes: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """Metrics of the added lines of each file: (path, language, status, added_lines, removed_lines, diff_nloc, diff_complexity, comment_density, estimated_hours).

    ``changes`` as from ``changed_lines``, ``files`` (path, language, content) with new contents, ``facts`` of these that are at hand. Deleted files cost nothing. A line of
    comment alone is one only if it isn't the last of its file.
    """
    base = changes.join(files.select("path", "language", "content"), "path")
    each = X.lines_of(F.col("content"))
    wanted = F.filter("added", lambda i: (i >= 1) & (i <= F.size(each)))
    # Each added line is looked at beside the text it is in: whether it is blank, and whether it reads as comment alone.
    read = F.transform(
        wanted,
        lambda i: F.struct(
            (i - 1).cast("long").alias("row"),
            X.is_blank(F.element_at(each, i.cast("int"))).alias("blank"),
            ((i < F.size(each)) & X.comment_only_changed(F.element_at(each, i.cast("int")))).alias("bare"),
        ),
    )
    added = base.where("status <> 'deleted' and content is not null").select("path", F.explode(F.filter(read, lambda x: ~x["blank"])).alias("x"))
    points = added.select("path", F.col("x.row").alias("row"), F.col("x.bare").alias("bare"))
    of = lambda fact: facts.where(F.col("fact") == fact).select("path", "start_row", "end_row")
    seen = intervals.depth_at(intervals.depth_at(points, of("comment")).withColumnRenamed("depth", "comments"), of("branch"))
    is_comment = F.col("bare") & (F.col("comments") > 0)
    counted = seen.groupBy("path").agg(
        F.count_if(~is_comment).alias("n"), F.count_if(is_comment).alias("c"), F.sum(F.when(~is_comment, F.col("depth"))).alias("d")
    )
    zero = lambda c: F.when(F.col("status") == "deleted", 0).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("long")
    sizes = changes.select("path", "status", F.size("added").alias("added"), F.size("removed").alias("removed"))
    rows = sizes.join(files.select("path", "language"), "path").join(counted, "path", "left").select(
        "path",
        "language",
        "status",
        F.when(F.col("status") == "deleted", 0).otherwise(F.col("added")).cast("long").alias("added_lines"),
        F.col("removed").cast("long").alias("removed_lines"),
        zero("n").alias("diff_nloc"),
        zero("d").alias("diff_complexity"),
        zero("c").alias("comment_lines"),
    )
    return metrics.effort(rows, "diff_nloc", "comment_lines", "diff_complexity").drop("comment_lines")


def metrics_of(changes: DataFrame, files: DataFrame) -> DataFrame:
    """As ``diff_metrics``, of the files alone: the added lines of each are looked at where it is scanned, so that no row of lines is shuffled or sorted."""
    lines = changes.select("path", "status", "added", F.size("added").cast("long").alias("added_lines"), F.size("removed").cast("long").alias("removed_lines"))
    gone = F.col("status") == "deleted"
    base = spread(files.select("path", "language", "content")).join(lines.hint("merge"), "path")  # lists of lines are larger than Spark takes them for
    rows = measure_changes(base.withColumn("content", F.when(~gone, F.col("content")))).select(
        "path",
        "language",
        "status",
        F.when(gone, 0).otherwise(F.col("added_lines")).cast("long").alias("added_lines"),
        "removed_lines",
        F.col("n").alias("diff_nloc"),
        F.col("d").alias("diff_complexity"),
        F.col("c").alias("comment_lines"),
    )
    return metrics.effort(rows, "diff_nloc", "comment_lines", "diff_complexity").drop("comment_lines")


def summary(rows: DataFrame) -> DataFrame:
    """One row of totals of ``diff_metrics``."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    out = rows.agg(
        *(total(c) for c in ("added_lines", "removed_lines", "diff_nloc", "diff_complexity")),
        X.fixed2(F.coalesce(F.sum("estimated_hours"), F.lit(0.0))).alias("total_hours"),
        F.count("*").alias("files_changed"),
    )
    return out.withColumn("total_days", X.fixed2(F.col("total_hours") / 8))


def files_by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("files"))


def signature_changes(changes: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, status, change, ord, signature): functions added, modified and removed.

    ``base`` and ``head`` are (path, fn_ord, signature, start_line, end_line) of the two revisions. Functions are the same if their
    signatures are; one of both is modified if an added line is in its range in the head. In files that are
    added or deleted all are.
    """
    keys = ["path", "signature"]
    of = lambda *kinds: changes.where(F.col("status").isin(*kinds)).select("path", "status")
    new, old = head.join(of("added", "modified"), "path"), base.join(of("deleted", "modified"), "path")
    was = base.join(of("modified"), "path").select(*keys)
    added = new.join(was, keys, "left_anti").withColumn("change", F.lit("added"))
    removed = old.join(head.join(of("modified"), "path").select(*keys), keys, "left_anti").withColumn("change", F.lit("removed"))
    lines = changes.select("path", F.explode("added").alias("line"))
    both = new.where("status = 'modified'").join(was, keys, "left_semi")
    modified = intervals.touched(both, lines).withColumn("change", F.lit("modified"))
    out = ["path", "status", "change", F.col("fn_ord").alias("ord"), "signature"]
    return added.select(*out).unionByName(modified.select(*out)).unionByName(removed.select(*out))


def signature_changes_by_file(rows: DataFrame) -> DataFrame:
    """(path, status, added, modified, removed): lists in the order of the source; files without changes have no row."""
    each = lambda change: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("change") == change, F.struct("ord", "signature")))), lambda x: x["signature"]
    ).alias(change)
    return rows.groupBy("path", "status").agg(each("added"), each("modified"), each("removed"))
