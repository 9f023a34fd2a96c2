"""Execution paths from entry points by bounded recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import caching

MAX_DEPTH, MAX_PATHS = 10, 5


def entrypoints(nodes: DataFrame) -> DataFrame:
    """Nodes that anyone can call."""
    return nodes.where(F.col("visibility").isin("public", "external"))


def ranked_edges(edges: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """(src, dst, n): edges of a node in the order in which they are followed: by target, then as they came."""
    order = W.partitionBy("src").orderBy(F.collate("dst", collation), "edge_ord")
    return edges.select("src", "dst", F.row_number().over(order).alias("n"))


def all_paths(
    nodes: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH, row_limit: int = 50_000_000, of: Callable[[DataFrame], DataFrame] = lambda paths: paths
) -> DataFrame:
    """(root, root_ord, hops, key, path) of every path from an entry point, or what ``of`` makes of them.

    A node that is on the path already ends it as recursive, the node after ``depth`` others ends it as too deep, and so does one
    without edges. ``key`` orders the paths of a root as a depth-first search finds them. If the recursion makes more than
    ``row_limit`` rows it is an error; nothing is cut silently. The result is computed at once, with limits of recursion that are set for that only.
    """
    spark: SparkSession = nodes.sparkSession
    roots = caching.settle(entrypoints(nodes).select(F.col("id").alias("root"), F.col("node_ord").alias("root_ord")))
    steps = caching.settle(ranked_edges(edges))  # every step of the recursion joins them
    with caching.settings(spark, spark__sql__cteRecursionRowLimit=str(row_limit)):
        found = spark.sql(
            """
            WITH RECURSIVE p(root, root_ord, cur, hops, key, done) AS (
              SELECT root, root_ord, root, array(root), cast(array() AS array<int>), false FROM {roots}
              UNION ALL
              SELECT p.root, p.root_ord, e.dst,
                     array_append(p.hops, CASE WHEN array_contains(p.hops, e.dst) THEN concat(e.dst, ' (Recursive)')
                                               WHEN size(p.hops) >= {depth} THEN concat(e.dst, ' (Max Depth)') ELSE e.dst END),
                     array_append(p.key, e.n),
                     array_contains(p.hops, e.dst) OR size(p.hops) >= {depth}
              FROM p JOIN {steps} e ON e.src = p.cur WHERE NOT p.done
            )
            SELECT root, root_ord, size(hops) AS hops, key, array_join(hops, ' -> ') AS path FROM p
            LEFT ANTI JOIN {steps} e ON e.src = p.cur AND NOT p.done
            """,
            roots=roots,
            steps=steps,
            depth=depth,
        )
        return caching.settle(of(found))


def execution_paths(nodes: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH, most: int = MAX_PATHS) -> DataFrame:
    """(root, root_ord, rank, path): the ``most`` longest paths of each entry point, ties in the order of the search."""
    order = W.partitionBy("root", "root_ord").orderBy(F.desc("hops"), "key")

    def longest(paths: DataFrame) -> DataFrame:
        ranked = paths.withColumn("rank", F.row_number().over(order).cast("long"))
        return ranked.where(F.col("rank") <= most).select("root", "root_ord", "rank", "path")

    return all_paths(nodes, edges, depth, of=longest)
