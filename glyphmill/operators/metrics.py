"""Metrics of files from facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..languages import language_dim
from ..sources.scanner import function_texts, measure_files
from . import intervals


def _line_counts() -> tuple[Column, Column]:
    each = X.lines_of(F.col("content"))
    return (
        F.size(each).cast("long").alias("total_lines"),
        F.size(F.filter(each, X.is_blank)).cast("long").alias("blank_lines"),
    )


def line_stats(files: DataFrame) -> DataFrame:
    """(path, total_lines, blank_lines); no row of lines is shuffled."""
    return files.select("path", *_line_counts())


def comment_stats(comments: DataFrame) -> DataFrame:
    """(path, lines_with_comments, comment_only) of facts of comments, which count the rows they cover; files without comments have no row."""
    return comments.groupBy("path").agg(F.sum("rows").alias("lines_with_comments"), F.sum("bare_rows").alias("comment_only"))


def cognitive_complexity(branches: DataFrame) -> DataFrame:
    """(path, complexity) of spans of branches: each counts one, and one for every branch around it."""
    return intervals.nesting_sweep(branches).groupBy("path").agg(F.sum(F.col("nesting") + 1).alias("complexity"))


def _excess() -> Column:
    """Lines of a construct beyond its first; of a function with a body only those before that."""
    last = F.when(F.col("body_row").isNotNull(), F.col("body_row") - 1).otherwise(F.col("end_row"))
    return F.greatest(last - F.col("start_row"), F.lit(0))


def normalization(spans: DataFrame) -> DataFrame:
    """(path, adjustment) of spans of constructs: the lines by which outermost ones exceed one; of functions with a body only what is before it."""
    return intervals.outermost(spans).groupBy("path").agg(F.sum(_excess()).alias("adjustment"))


def totals(facts: DataFrame) -> DataFrame:
    """(path, lines_with_comments, comment_only, complexity, adjustment, errors): all that metrics need of facts, in one aggregation.

    The scanner says how deep branches are and which constructs are in others, as ``nesting`` and ``outermost`` would.
    """
    of = lambda fact, value: F.coalesce(F.sum(F.when(F.col("fact") == fact, value)), F.lit(0))
    return facts.groupBy("path").agg(
        of("comment", F.col("rows")).alias("lines_with_comments"),
        of("comment", F.col("bare_rows")).alias("comment_only"),
        of("branch", F.col("depth") + 1).alias("complexity"),
        of("norm", F.when(F.col("depth") == 0, _excess())).alias("adjustment"),
        F.count_if(F.col("fact") == "error").alias("errors"),
    )


def metrics_of(files: DataFrame) -> DataFrame:
    """As ``file_metrics``, of the files alone: each is measured where it is scanned, so that no facts are kept or joined by path, and time is in proportion to the files."""
    nloc = F.greatest(F.lit(0), F.expr("total_lines - blank_lines - comment_only - adjustment"))
    return effort(measure_files(files).select("path", "language", nloc.alias("nloc"), "lines_with_comments", "complexity"))


def file_metrics(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, language, nloc, lines_with_comments, comment_density, complexity, estimated_hours) for each file that was scanned, by joins with facts that are at hand."""
    known = files.where("content is not null").select("path", "language", *_line_counts())
    joined = known.join(totals(facts), "path", "left").where("coalesce(errors, 0) = 0")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    nloc = F.greatest(F.lit(0), F.col("total_lines") - F.col("blank_lines") - zero("comment_only") - zero("adjustment"))
    out = joined.select("path", "language", nloc.alias("nloc"), zero("lines_with_comments").alias("lines_with_comments"), zero("complexity").alias("complexity"))
    return effort(out)


def effort(rows: DataFrame, nloc: str = "nloc", comments: str = "lines_with_comments", complexity: str = "complexity") -> DataFrame:
    """``rows``, which have ``language``, with ``comment_density`` and ``estimated_hours``."""
    dim = F.broadcast(language_dim(rows.sparkSession))  # a row for each language
    names = rows.columns
    wide = rows.join(dim, "language").withColumn("comment_density", X.fixed2(X.share(F.col(comments), F.col(nloc))))
    hours = X.review_hours(F.col(nloc), X.share(F.col(complexity), F.col(nloc)), F.col("comment_density"))
    return wide.withColumn("estimated_hours", hours).select(*names, "comment_density", "estimated_hours")


def summary(metrics: DataFrame) -> DataFrame:
    """One row (total_nloc, total_hours, total_days)."""
    total = metrics.agg(
        F.coalesce(F.sum("nloc"), F.lit(0)).alias("total_nloc"), F.coalesce(F.sum("estimated_hours"), F.lit(0.0)).alias("h")
    )
    hours = total.withColumn("total_hours", X.fixed2(F.col("h")))
    return hours.select("total_nloc", "total_hours", X.fixed2(F.col("total_hours") / 8).alias("total_days"))


def signatures(facts: DataFrame, most: int = 80) -> DataFrame:
    """(path, fn_ord, signature, start_line, end_line) of the functions."""
    rows = facts.where("fact = 'function'")
    return rows.select(
        "path",
        F.col("ord").alias("fn_ord"),
        X.truncate(X.clean_signature(F.col("text")), most).alias("signature"),
        (F.col("start_row") + 1).alias("start_line"),
        (F.col("end_row") + 1).alias("end_line"),
    )


def merge_maps(*maps: DataFrame, key: str = "path") -> DataFrame:
    """The rows of all maps, of those with one key that of the last map; within a map keys come once."""
    parts = [m.withColumn("part_", F.lit(k)) for k, m in enumerate(maps)]
    every = parts[0]
    for m in parts[1:]:
        every = every.unionByName(m)
    values = [c for c in maps[0].columns if c != key]
    last = every.groupBy(key).agg(F.max_by(F.struct(*values), "part_").alias("v"))
    return last.select(key, *[F.col(f"v.{c}").alias(c) for c in values])


def signatures_by_file(facts: DataFrame) -> DataFrame:
    """(path, signatures) in the order of the source; files without functions have no row."""
    each = signatures(facts).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("fn_ord", "signature"))).alias("s"))
    return each.select("path", F.col("s.signature").alias("signatures"))


def signatures_of(files: DataFrame, most: int = 80) -> DataFrame:
    """As ``signatures_by_file``, of the files alone, each in the task that scans it."""
    return function_texts(files).select("path", F.transform("texts", lambda t: X.truncate(X.clean_signature(t), most)).alias("signatures"))
