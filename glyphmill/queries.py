"""Queries over the tables of the tests, with SQL that says what each must return."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import expressions as X
from .languages import LANGUAGES, REGISTRY, Language, language_dim, language_of, register, route
from .operators import diff as D
from .operators import graph as G
from .operators import intervals as I
from .operators import metrics as M
from .operators import paths as P
from .plans import api, corpus
from .plans.api import facts_of
from .plans.corpus import TEMPLATES, inheriting_files, mixed_files, source_files, table
from .sources import files as S
from .sources.scanner import measure_files, scan_files

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items()}


# Pieces of SQL.


def _fixed2(x: str) -> str:
    """Exact rounding to two decimals of a double that isn't negative."""
    n, hi = f"floor(({x}) * 100)", f"(({x}) * 134217729.0::DOUBLE - (({x}) * 134217729.0::DOUBLE - ({x})))"
    p = f"(({x}) * 200)"
    return f"(CASE WHEN ({p} - (2 * {n} + 1)) + (({hi} * 200 - {p}) + (({x}) - {hi}) * 200) >= 0 THEN ({n} + 1) / 100 ELSE {n} / 100 END)"


_DIM = "(VALUES " + ", ".join(
    "('" + x.name + "', " + ", ".join(f"{float(v)}::DOUBLE" for v in (x.rate, x.mid, x.steep, x.benefit_cap, x.penalty_cap, x.full_density, x.doc_cap)) + ")" for x in LANGUAGES
) + ") AS dim(language, rate, mid, steep, benefit_cap, penalty_cap, full_density, doc_cap)"


def _hours(nloc: str, complexity: str, density: str) -> str:
    shape = f"tanh(({complexity} - mid) / steep)"
    factor = (
        f"greatest(0.5::DOUBLE, least(1::DOUBLE + penalty_cap, 1::DOUBLE + (CASE WHEN {shape} >= 0 THEN {shape} * penalty_cap ELSE {shape} * benefit_cap END)"
        f" - tanh(greatest(0::DOUBLE, {density}) / greatest(1::DOUBLE, full_density) * 2.646::DOUBLE) * doc_cap))"
    )
    return _fixed2(f"({nloc}::DOUBLE / rate * 8 * {factor})")


def _each(of: Callable[[corpus.Template], str]) -> str:
    """SQL of what the template of part k has."""
    return "[" + ", ".join("'" + of(t).replace("'", "''") + "'" for t in TEMPLATES) + f"][1 + k % {len(TEMPLATES)}]"


#: What is known of the files of ``source_files``: x are the lines that a function counts less, all but one where its body isn't known.
_PART = f"""
    SELECT *, 1 + c + signature_rows + 2 * d + 3 + b AS total, d * (d + 1) // 2 AS complexity, 'src/f' || k || {_each(lambda t: "." + t.extension)} AS path,
           CASE WHEN language IN ('compact', 'masm') THEN signature_rows + 2 * d + 1 ELSE m END AS x
    FROM (SELECT *, CASE WHEN m = 0 THEN 1 ELSE m + 2 END AS signature_rows FROM (
      SELECT p_partkey AS k, {_each(lambda t: t.language).replace("k %", "p_partkey %")} AS language, (p_size % 5)::BIGINT AS d, (p_size % 4)::BIGINT AS c, (p_size % 3)::BIGINT AS b,
             CASE WHEN language = 'masm' THEN 0 ELSE (p_partkey % 4)::BIGINT END AS m FROM part))"""
_METRICS = f"""
    WITH f AS ({_PART}), n AS (SELECT *, total - b - c - x AS nloc FROM f),
    g AS (SELECT *, {_fixed2("(c::DOUBLE / nloc * 100)")} AS comment_density FROM n)
    SELECT path, language, nloc, c AS lines_with_comments, complexity, comment_density, {_hours("nloc", "(complexity::DOUBLE / nloc * 100)", "comment_density")} AS estimated_hours
    FROM g JOIN {_DIM} USING (language)"""
_SPACE = r"[\s\x0B\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# Lines and files.


@_query(f"""SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS total_lines,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_full_match(x, '{_SPACE}*')))::BIGINT AS blank_lines FROM documents""")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return M.line_stats(docs).withColumnRenamed("path", "doc_id")


@_query(f"SELECT doc_id, regexp_replace('  ' || text || chr(13) || chr(10), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS trimmed FROM documents")
def trimmed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.trim(F.concat(F.lit("  "), "text", F.lit("\r\n"))).alias("trimmed"))


@_query("""SELECT path, (CASE s WHEN 0 THEN 'solidity' WHEN 1 THEN 'go' WHEN 2 THEN 'typescript' WHEN 4 THEN 'cpp' END) AS language FROM (
    SELECT s_suppkey % 6 AS s, 'a.rs/f' || s_suppkey || (CASE s_suppkey % 6 WHEN 0 THEN '.sol' WHEN 1 THEN '.GO' WHEN 2 THEN '.tar.Ts' WHEN 3 THEN '' WHEN 4 THEN '.hpp' ELSE '.txt' END) AS path
    FROM supplier) WHERE s IN (0, 1, 2, 4)""")
def language_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, (".sol", ".GO", ".tar.Ts", "", ".hpp", ".txt")))
    path = F.concat(F.lit("a.rs/f"), F.col("s_suppkey"), F.element_at(ends, F.expr("int(s_suppkey % 6)") + 1))
    rows = table(spark, sf_dir, "supplier").select(path.alias("path"))
    return rows.withColumn("language", language_of(F.col("path"))).where("language is not null")


@_query("""SELECT coalesce(a.path, b.path, c.path) AS path, coalesce(c.content, b.content, a.content) AS content FROM (SELECT c_name AS path, 'first' AS content FROM customer WHERE c_custkey % 2 = 0) a
    FULL JOIN (SELECT c_name AS path, c_mktsegment AS content FROM customer WHERE c_custkey % 3 = 0) b USING (path) FULL JOIN (SELECT c_name AS path, 'last ' || c_custkey AS content FROM customer WHERE c_custkey % 5 = 0) c USING (path)""")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three maps with keys in common: the last has its say."""
    rows = table(spark, sf_dir, "customer")
    part = lambda n, e: rows.where(f"c_custkey % {n} = 0").selectExpr("c_name as path", f"{e} as content")
    return M.merge_maps(part(2, "'first'"), part(3, "c_mktsegment"), part(5, "concat('last ', c_custkey)"))


# Comments, branches, constructs.


@_query(f"SELECT path, c AS lines_with_comments, c AS comment_only FROM ({_PART}) WHERE c > 0")
def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_files(source_files(spark, sf_dir)).where("lines_with_comments > 0").select("path", "lines_with_comments", "comment_only")


@_query("""WITH s AS (
      SELECT page_id, i, string_split(html, '<!--') AS p FROM (SELECT page_id, regexp_replace(html, '</p>', chr(10), 'g') AS html FROM pages), range(1, 100000) r(i) WHERE i < len(string_split(html, '<!--'))
    ), r AS (
      SELECT page_id, len(string_split(array_to_string(p[1:i], ''), chr(10))) - 1 AS a, len(string_split(string_split(p[i + 1], '-->')[1], chr(10))) - 1 AS n FROM s
    )
    SELECT page_id, count(DISTINCT t.x)::BIGINT AS comment_rows FROM r, LATERAL (SELECT unnest(range(a, a + n + 1)) AS x) t GROUP BY page_id""")
def html_comment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that HTML comments cover, paragraphs being rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.split(F.regexp_replace("html", "</p>", "\n"), "<!--", -1).alias("p"))
    spans = pages.select("page_id", "p", F.posexplode("p").alias("i", "piece")).where("i > 0")
    rows = lambda text: F.size(F.split(text, "\n", -1)) - 1
    start = rows(F.array_join(F.slice("p", 1, F.col("i")), ""))
    spans = spans.select("page_id", start.alias("start_row"), (start + rows(F.substring_index("piece", "-->", 1))).alias("end_row"))
    return I.rows_covered(spans, "page_id").groupBy("page_id").agg(F.count("*").alias("comment_rows"))


@_query(f"SELECT path, complexity FROM ({_PART}) WHERE d > 0")
def cognitive_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_files(source_files(spark, sf_dir)).where("complexity > 0").select("path", "complexity")


_ITEMS = "(SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) i"
_SPANS = f"SELECT l_orderkey AS path, l_linenumber::BIGINT AS ord, l_quantity::BIGINT AS start_idx, (l_quantity + l_linenumber * 5)::BIGINT AS end_idx FROM {_ITEMS}"
_NESTED = f"SELECT l_orderkey AS path, l_linenumber::BIGINT AS ord, (l_linenumber // 2)::BIGINT AS start_idx, (100 - l_linenumber // 2)::BIGINT AS end_idx FROM {_ITEMS}"


def _theta(spans: str) -> str:
    return f"""WITH s AS ({spans}) SELECT a.path, a.ord, count(o.path)::BIGINT AS nesting FROM s a LEFT JOIN s o ON o.path = a.path AND o.start_idx <= a.start_idx
        AND o.end_idx >= a.end_idx AND (o.start_idx < a.start_idx OR o.end_idx > a.end_idx) GROUP BY a.path, a.ord"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders, each number once; an order is in one task."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return I.dealt(lines, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))


def _spans(spark: SparkSession, sf_dir: str, start: str, end: str) -> DataFrame:
    return _items(spark, sf_dir).selectExpr("l_orderkey as path", "bigint(l_linenumber) as ord", f"bigint({start}) as start_idx", f"bigint({end}) as end_idx")


@_query(_theta(_SPANS))
def interval_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.nesting(_spans(spark, sf_dir, "l_quantity", "l_quantity + l_linenumber * 5")).select("path", "ord", "nesting")


@_query(_theta(_NESTED))
def interval_nesting_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.nesting_sweep(_spans(spark, sf_dir, "l_linenumber div 2", "100 - l_linenumber div 2")).select("path", "ord", "nesting")


@_query(f"""WITH p AS (SELECT l_orderkey AS path, l_linenumber AS ord, l_quantity::BIGINT AS pt FROM {_ITEMS}), s AS (SELECT l_orderkey AS path, l_quantity::BIGINT - l_linenumber AS a, l_quantity::BIGINT + 9 AS b FROM lineitem)
    SELECT p.path, p.ord::BIGINT AS ord, count(s.path)::BIGINT AS depth FROM p LEFT JOIN s ON s.path = p.path AND pt BETWEEN a AND b GROUP BY p.path, p.ord""")
def line_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    points = _items(spark, sf_dir).selectExpr("l_orderkey as path", "bigint(l_linenumber) as ord", "bigint(l_quantity) as row")
    spans = items.selectExpr("l_orderkey as path", "bigint(l_quantity) - l_linenumber as start_row", "bigint(l_quantity) + 9 as end_row")
    return I.depth_at(points, spans).select("path", "ord", "depth")


@_query("""SELECT path, count(DISTINCT x)::BIGINT AS covered FROM (SELECT l_orderkey AS path, unnest(range(l_quantity::BIGINT, l_quantity::BIGINT + l_linenumber + 1)) AS x FROM lineitem) GROUP BY path""")
def rows_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as path", "bigint(l_quantity) as start_row", "bigint(l_quantity) + l_linenumber as end_row")
    return I.rows_covered(spans).groupBy("path").agg(F.count("*").alias("covered"))


@_query(f"""WITH s AS (SELECT l_orderkey AS path, l_linenumber::BIGINT AS ord, l_quantity::BIGINT AS a, (l_quantity + l_linenumber * 5)::BIGINT AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT + 4 END AS body FROM {_ITEMS})
    SELECT x.path, x.ord FROM s x WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.path = x.path AND o.a <= x.a AND o.b >= x.b AND (o.a < x.a OR o.b > x.b) AND (o.body IS NULL OR x.a < o.body))""")
def outermost_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir, "l_quantity", "l_quantity + l_linenumber * 5")
    return I.outermost(spans.withColumn("body_idx", F.expr("case when ord % 2 = 0 then start_idx + 4 end"))).select("path", "ord")


@_query(f"SELECT path, x AS adjustment FROM ({_PART}) WHERE x > 0")
def normalization_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_files(source_files(spark, sf_dir)).where("adjustment > 0").select("path", "adjustment")


# Metrics and effort.


@_query(_METRICS)
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metrics_of(source_files(spark, sf_dir))


@_query(f"""SELECT total_nloc, total_hours, {_fixed2("total_hours / 8")} AS total_days FROM (SELECT sum(nloc)::BIGINT AS total_nloc, {_fixed2("sum(estimated_hours)")} AS total_hours FROM ({_METRICS}))""")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(file_metrics(spark, sf_dir))


@_query(f"""SELECT p_partkey, language, {_hours("n", "c", "p_size::DOUBLE")} AS estimated_hours FROM (SELECT *, (p_partkey % 997) AS n, (p_partkey % 53)::DOUBLE AS c FROM part), {_DIM}""")
def estimate_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").crossJoin(F.broadcast(language_dim(spark)))  # a row for each language
    return rows.select("p_partkey", "language", X.review_hours(F.expr("p_partkey % 997"), F.expr("double(p_partkey % 53)"), F.col("p_size").cast("double")).alias("estimated_hours"))


@_query(f"""SELECT o_orderkey, {_fixed2("o_totalprice / 8")} AS days FROM orders""")
def days_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.fixed2(F.col("o_totalprice") / 8).alias("days"))


# Signatures.


_SIGNATURE = f"""CASE WHEN language = 'masm' THEN 'export.f' || k || repeat(' if.true', d::INT) || ' push.1' || repeat(' end', d::INT + 1)
    ELSE {_each(lambda t: t.f)} || k || '(' || array_to_string(list_transform(range(greatest(m, 1)), lambda i: {_each(lambda t: t.param)}), ', ')
    || (CASE WHEN language = 'go' AND m > 0 THEN ', ' ELSE '' END) || {_each(lambda t: t.tail.removesuffix(" {"))} END"""


@_query(f"SELECT path, 0::BIGINT AS ord, {_SIGNATURE} AS signature FROM ({_PART})")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = M.signatures_of(source_files(spark, sf_dir))
    return lists.select("path", F.posexplode("signatures").alias("ord", "signature")).withColumn("ord", F.col("ord").cast("long"))


@_query(f"SELECT path, 2 + c AS start_line, 2 + c + signature_rows + 2 * d + 1 AS end_line FROM ({_PART})")
def function_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of functions, from 1."""
    return M.signatures(scan_files(source_files(spark, sf_dir), ["function"])).select("path", "start_line", "end_line")


@_query("""SELECT 'z' || p_partkey || '.zig' AS path, 'zig' AS language, 2 * d + 3 AS nloc, d * (d + 1) // 2 AS complexity FROM (SELECT p_partkey, (p_size % 6)::BIGINT AS d FROM part WHERE p_partkey % 10 = 0)""")
def registered_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of files in a language that only the session knows."""
    register(Language("zig", ("zig",), 300, 12, 9, 0.3, 0.6, 18, 0.3, branches=frozenset({"if", "while"}), function=("fn",), block=False))
    try:
        d = F.expr("p_size % 6")
        content = F.concat(F.lit("fn f() void {\n"), F.repeat(F.lit("  if (a) {\n"), d), F.lit("    g();\n"), F.repeat(F.lit("  }\n"), d), F.lit("}"))
        rows = table(spark, sf_dir, "part").where("p_partkey % 10 = 0")
        files = route(rows.select(F.concat(F.lit("z"), "p_partkey", F.lit(".zig")).alias("path"), content.alias("content")))
        return M.metrics_of(files).select("path", "language", "nloc", "complexity")
    finally:
        del REGISTRY["zig"]


@_query("""SELECT p_partkey, CASE WHEN length(s) > 80 THEN left(s, 77) || '...' ELSE s END AS short, CASE WHEN length(s) > 120 THEN left(s, 117) || '...' ELSE s END AS long
    FROM (SELECT p_partkey, repeat(p_name || p_type, (p_partkey % 9)::INT) AS s FROM part)""")
def signature_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("repeat(concat(p_name, p_type), int(p_partkey % 9))")
    return table(spark, sf_dir, "part").select("p_partkey", X.truncate(text, 80).alias("short"), X.truncate(text, 120).alias("long"))


@_query("SELECT p_partkey, 'function ' || p_brand || '(uint a, ' || p_type || ' b) public' AS signature FROM part")
def signature_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("\n function \t"), "p_brand", F.lit("( \n uint a ,\n\n"), "p_type", F.lit("   b\n )  public \n"))
    return table(spark, sf_dir, "part").select("p_partkey", X.clean_signature(raw).alias("signature"))


# Graphs.


@_query("SELECT c_custkey AS node_ord, c_name AS id FROM customer WHERE c_custkey % 4 IN (0, 2)")
def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("public", "private", "external", "internal")))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_ord"), F.col("c_name").alias("id"), F.element_at(kinds, F.expr("int(c_custkey % 4)") + 1).alias("visibility"))
    return P.entrypoints(nodes).select("node_ord", "id")


_EDGES = "SELECT l_orderkey * 10 + l_linenumber AS edge_ord, 's' || lpad((l_suppkey % 50)::VARCHAR, 6, '0') AS src, 's' || lpad((l_partkey % 60)::VARCHAR, 6, '0') AS dst FROM lineitem"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as edge_ord", "concat('s', lpad(string(l_suppkey % 50), 6, '0')) as src", "concat('s', lpad(string(l_partkey % 60), 6, '0')) as dst", "'internal' as kind")


@_query(f"SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst, edge_ord) AS n FROM ({_EDGES})")
def edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ranked_edges(_edges(spark, sf_dir)).withColumn("n", F.col("n").cast("long"))


@_query(f"SELECT src, dst, min(edge_ord) AS edge_ord FROM ({_EDGES}) WHERE src <> dst GROUP BY src, dst")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.distinct_edges(_edges(spark, sf_dir)).select("src", "dst", "edge_ord")


@_query("SELECT 'p' || l_partkey AS id, min(o) AS ord, arg_max(l_quantity, o) AS quantity, arg_max(l_suppkey, o) AS supplier FROM (SELECT *, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey * 100 + l_suppkey % 100 AS o FROM lineitem) GROUP BY l_partkey")
def symbol_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat('p', l_partkey) as id", "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey * 100 + l_suppkey % 100 as ord", "l_quantity as quantity", "l_suppkey as supplier")
    return G.upsert(rows)


@_query("""SELECT o_orderkey AS call, supplier FROM (SELECT o_orderkey, l_suppkey AS supplier, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'O' THEN 1 ELSE 2 END, l_linenumber, l_suppkey) AS n
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE n = 1""")
def first_match_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    prio = F.expr("case when l_returnflag = 'R' then 0 when l_linestatus = 'O' then 1 else 2 end")
    return G.first_match(joined.withColumn("prio", prio), ["o_orderkey"], ["prio", "l_linenumber", "l_suppkey"]).select(F.col("o_orderkey").alias("call"), F.col("l_suppkey").alias("supplier"))


_PARENTS = """SELECT 'n' || n_nationkey AS child, 'n' || (n_nationkey // 2) AS parent, 0 AS ord FROM nation WHERE n_nationkey > 0
    UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey + 7) % 25), 1 FROM nation WHERE n_nationkey % 5 = 0"""


@_query(f"""WITH RECURSIVE i AS ({_PARENTS}), a(child, ancestor, key, trail) AS (
      SELECT child, parent, [ord], [child, parent] FROM i
      UNION ALL SELECT a.child, i.parent, list_append(a.key, i.ord), list_append(a.trail, i.parent) FROM a JOIN i ON i.child = a.ancestor WHERE NOT list_contains(a.trail, i.parent)
    ) SELECT child, ancestor, array_to_string(min(key), ',') AS key FROM a GROUP BY child, ancestor""")
def inherited_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    one = nation.where("n_nationkey > 0").selectExpr("concat('n', n_nationkey) as child", "concat('n', n_nationkey div 2) as parent", "0L as ord")
    two = nation.where("n_nationkey % 5 = 0").selectExpr("concat('n', n_nationkey) as child", "concat('n', (n_nationkey + 7) % 25) as parent", "1L as ord")
    return G.ancestors(one.union(two)).select("child", "ancestor", F.array_join(F.col("key").cast("array<string>"), ",").alias("key"))


_WALK = """WITH RECURSIVE nodes AS (SELECT n_nationkey AS node_ord, 'n' || lpad(n_nationkey::VARCHAR, 3, '0') AS id FROM nation WHERE n_nationkey % 6 = 0),
    edges AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst, o) AS n FROM (
      SELECT n_nationkey AS o, 'n' || lpad(n_nationkey::VARCHAR, 3, '0') AS src, 'n' || lpad(((n_nationkey * 2 + 1) % 25)::VARCHAR, 3, '0') AS dst FROM nation
      UNION ALL SELECT 100 + n_nationkey, 'n' || lpad(n_nationkey::VARCHAR, 3, '0'), 'n' || lpad(((n_nationkey + 3) % 25)::VARCHAR, 3, '0') FROM nation WHERE n_nationkey % 3 <> 1)),
    p(root, root_ord, cur, hops, key, done) AS (
      SELECT id, node_ord, id, [id], []::BIGINT[], false FROM nodes
      UNION ALL SELECT root, root_ord, dst, list_append(hops, CASE WHEN list_contains(hops, dst) THEN dst || ' (Recursive)' WHEN len(hops) >= 10 THEN dst || ' (Max Depth)' ELSE dst END),
        list_append(key, n), list_contains(hops, dst) OR len(hops) >= 10 FROM p JOIN edges ON src = cur WHERE NOT done),
    leaves AS (SELECT * FROM p WHERE done OR NOT EXISTS (SELECT 1 FROM edges WHERE src = cur))"""


def _nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation")
    ident = "concat('n', lpad(string({}), 3, '0'))"
    nodes = nation.selectExpr("bigint(n_nationkey) as node_ord", f"{ident.format('n_nationkey')} as id", "case when n_nationkey % 6 = 0 then 'public' else 'internal' end as visibility")
    a = nation.selectExpr("n_nationkey as edge_ord", f"{ident.format('n_nationkey')} as src", f"{ident.format('(n_nationkey * 2 + 1) % 25')} as dst")
    b = nation.where("n_nationkey % 3 <> 1").selectExpr("100 + n_nationkey as edge_ord", f"{ident.format('n_nationkey')} as src", f"{ident.format('(n_nationkey + 3) % 25')} as dst")
    return nodes, a.union(b)


@_query(f"{_WALK} SELECT root, array_to_string(hops, ' -> ') AS path FROM leaves")
def execution_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.all_paths(*_nation_graph(spark, sf_dir)).select("root", "path")


@_query(f"{_WALK} SELECT root, rank, path FROM (SELECT root, array_to_string(hops, ' -> ') AS path, row_number() OVER (PARTITION BY root ORDER BY len(hops) DESC, key) AS rank FROM leaves) WHERE rank <= 5")
def top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.execution_paths(*_nation_graph(spark, sf_dir)).select("root", "rank", "path")


@_query("""SELECT 'N' || n_nationkey || '.own' || n_nationkey || '()' AS src, 'N' || (n_nationkey // 2) || '.base' || (n_nationkey // 2) || '()' AS dst, 'internal' AS kind FROM nation""")
def call_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inheriting_files(spark, sf_dir)
    return G.call_graph(facts_of(files), files, "solidity")[1].select("src", "dst", "kind")


@_query("""SELECT 'N' || n_nationkey || '.' || f || n_nationkey || '()' AS id, f || n_nationkey AS label, 'N' || n_nationkey AS container, v AS visibility, s AS start_line FROM nation, (VALUES ('own', 'public', 2), ('base', 'internal', 6)) t(f, v, s)""")
def call_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inheriting_files(spark, sf_dir)
    return G.call_graph(facts_of(files), files, "solidity")[0].select("id", "label", "container", "visibility", "start_line")


@_query("""SELECT 'N' || n_nationkey || '.own' || n_nationkey || '() -> N' || (n_nationkey // 2) || '.base' || (n_nationkey // 2) || '()' AS path FROM nation""")
def source_execution_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From source text to paths."""
    files = inheriting_files(spark, sf_dir)
    return P.execution_paths(*G.call_graph(facts_of(files), files, "solidity")).select("path")


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'private' WHEN c_custkey % 3 = 1 THEN 'public' ELSE 'private' END AS visibility FROM customer")
def go_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(F.lower("c_mktsegment"), F.upper("c_mktsegment"), F.concat(F.lit("_"), "c_name")), F.expr("int(c_custkey % 3)") + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", G.go_visibility(name).alias("visibility"))


@_query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'T' || c_custkey WHEN 1 THEN 'T' || c_custkey WHEN 2 THEN right(c_custkey::VARCHAR, 1) END AS receiver FROM customer""")
def go_receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("T"), "c_custkey")
    forms = F.array(F.concat(F.lit("(s *"), t, F.lit(")")), F.concat(F.lit("( s "), t, F.lit(" )")), F.concat(F.lit("("), t, F.lit(")")), F.concat(F.lit("(s *"), t, F.lit("[K])")))
    return table(spark, sf_dir, "customer").select("c_custkey", G.go_receiver(F.element_at(forms, F.expr("int(c_custkey % 4)") + 1)).alias("receiver"))


@_query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'private' ELSE 'public' END AS visibility FROM customer")
def rust_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(F.lit("pub"), F.lit("pub(crate)"), F.lit(None).cast("string"), F.lit("crate"))
    return table(spark, sf_dir, "customer").select("c_custkey", G.rust_visibility(F.element_at(tokens, F.expr("int(c_custkey % 4)") + 1)).alias("visibility"))


@_query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'external' WHEN 2 THEN 'public' WHEN 3 THEN 'external' ELSE 'internal' END AS visibility FROM customer""")
def solidity_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("int(c_custkey % 5)") + 1
    pick = lambda *x: F.element_at(F.array(*(F.lit(v).cast("string") for v in x)), at)
    out = G.solidity_visibility(pick("private", None, None, None, None), pick("f() public", "f(uint x) external", "f(function() internal g) public", "f()", "f()"), pick("contract", "contract", "library", "interface", "contract"))
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("visibility"))


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 'external' WHEN l_linenumber % 4 IN (1, 2) THEN 'internal' WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'O' THEN 'internal' ELSE 'external' END ELSE 'external' END AS kind FROM lineitem""")
def edge_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.element_at(F.array(*map(F.lit, ("this", "super", "simple", "member"))), F.expr("l_linenumber % 4") + 1)
    container, visibility = F.expr("if(l_returnflag = 'R', 'library', 'contract')"), F.expr("if(l_linestatus = 'O', 'internal', 'public')")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.edge_kind(call, container, visibility).alias("kind"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, language FROM (SELECT *, ['len', 'require', 'if', 'append', 'emit', 'run'][1 + l_partkey % 6] AS name, ['simple', 'selector', 'assembly', 'member'][1 + l_suppkey % 4] AS kind FROM lineitem), (VALUES ('go'), ('solidity'), ('rust')) v(language)
    WHERE NOT (language = 'go' AND kind = 'simple' AND name IN ('len', 'append')) AND NOT (language = 'solidity' AND (kind IN ('simple', 'member') AND name IN ('require', 'emit') OR kind = 'assembly' AND name = 'if'))""")
def builtin_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that call graphs are made of: those without builtins of their language."""
    calls = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "element_at(array('len', 'require', 'if', 'append', 'emit', 'run'), int(l_partkey % 6) + 1) as name",
        "element_at(array('simple', 'selector', 'assembly', 'member'), int(l_suppkey % 4) + 1) as kind",
    )
    parts = [G.without_builtins(calls, x).select("l_orderkey", "l_linenumber", "l_partkey", F.lit(x).alias("language")) for x in ("go", "solidity", "rust")]
    return parts[0].union(parts[1]).union(parts[2])


# Graphs of source text in three languages.


def _nations(*rows: str) -> str:
    """SQL of rows for each nation; {n} and {up} stand for its key and half of it."""
    filled = lambda r: re.sub(r"\{(\w+)\}", r"' || \1 || '", r)
    return f"SELECT * FROM (SELECT n_nationkey AS n, n_nationkey // 2 AS up FROM nation), LATERAL (VALUES {', '.join(map(filled, rows))})"


_UP = "up{n}(function(uint) external cb, uint[] memory x)"
_SOLIDITY_EDGES = _nations(
    f"('C{{n}}.{_UP}', 'B{{n}}.{_UP}', 'internal')", "('C{n}.all{n}(uint x)', 'L{n}.lib{n}(uint a, uint b)', 'internal')", "('C{n}.all{n}(uint x)', 'L{n}.ext{n}(uint a)', 'external')",
    f"('C{{n}}.all{{n}}(uint x)', 'C{{n}}.{_UP}', 'external')", "('C{n}.all{n}(uint x)', 'C{n}.yul{n}()', 'internal')", "('C{n}.receive()', 'C{n}.yul{n}()', 'internal')",
) + " t(src, dst, kind)"
_GO_EDGES = _nations(
    "('T{n}.Run{n}', 'helper{n}', 'internal')", "('T{n}.Run{n}', 'T{n}.stop{n}', 'internal')", "('T{n}.stop{n}', 'shared{up}', 'internal')",
    "('helper{n}', 'T{up}.Run{up}', 'internal')", "('shared{n}', 'helper{n}', 'internal')",
) + " t(src, dst, kind)"
_RUST_EDGES = _nations(
    "('m{n}::inner{n}', 'outer{n}', 'internal')", "('S{n}::new{n}', 'S{up}::make{up}', 'internal')", "('S{n}::make{n}', 'S{n}::own{n}', 'internal')",
    "('S{n}::own{n}', 'outer{n}', 'internal')", "('outer{n}', 'S{up}::make{up}', 'internal')",
) + " t(src, dst, kind)"
_SOLIDITY_NODES = _nations(
    "('L{n}.lib{n}(uint a, uint b)', 'L{n}', 'internal', 0)", "('L{n}.ext{n}(uint a)', 'L{n}', 'public', 1)", f"('B{{n}}.{_UP}', 'B{{n}}', 'public', 2)", f"('C{{n}}.{_UP}', 'C{{n}}', 'public', 3)",
    "('C{n}.all{n}(uint x)', 'C{n}', 'external', 4)", "('C{n}.yul{n}()', 'C{n}', 'private', 5)", "('C{n}.receive()', 'C{n}', 'external', 6)",
) + " t(id, container, visibility, o)"
_GO_NODES = _nations("('helper{n}', NULL, 'private', 0)", "('shared{n}', NULL, 'private', 1)", "('T{n}.Run{n}', 'T{n}', 'public', 2)", "('T{n}.stop{n}', 'T{n}', 'private', 3)") + " t(id, container, visibility, o)"
_RUST_NODES = _nations(
    "('S{n}::new{n}', 'S{n}', 'public', 0)", "('S{n}::make{n}', 'S{n}', 'private', 1)", "('S{n}::own{n}', 'S{n}', 'internal', 2)", "('m{n}::inner{n}', 'm{n}', 'public', 3)", "('outer{n}', NULL, 'public', 4)",
) + " t(id, container, visibility, o)"


def _graph_of(language: str, text: str, extension: str) -> Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]:
    def made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        files = corpus.nation_files(spark, sf_dir, extension, text)
        return G.call_graph(facts_of(files), files, language)

    return made


_solidity_graph, _go_graph, _rust_graph = (
    _graph_of(*x) for x in (("solidity", corpus.SOLIDITY, "sol"), ("go", corpus.GO, "go"), ("rust", corpus.RUST, "rs"))
)


@_query(f"SELECT src, dst, kind FROM ({_SOLIDITY_EDGES})")
def solidity_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to a parent, a library, by using-for, through this, in assembly and from receive."""
    return _solidity_graph(spark, sf_dir)[1].select("src", "dst", "kind")


@_query(f"SELECT id, container, visibility FROM ({_SOLIDITY_NODES})")
def solidity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers with the full text of parameters, visibility by token and by container."""
    return _solidity_graph(spark, sf_dir)[0].select("id", "container", "visibility")


@_query(f"SELECT src, dst, kind FROM ({_GO_EDGES})")
def go_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _go_graph(spark, sf_dir)[1].select("src", "dst", "kind")


@_query(f"SELECT id, container, visibility FROM ({_GO_NODES})")
def go_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _go_graph(spark, sf_dir)[0].select("id", "container", "visibility")


@_query(f"SELECT src, dst, kind FROM ({_RUST_EDGES})")
def rust_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rust_graph(spark, sf_dir)[1].select("src", "dst", "kind")


@_query(f"SELECT id, container, visibility FROM ({_RUST_NODES})")
def rust_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rust_graph(spark, sf_dir)[0].select("id", "container", "visibility")


@_query(f"SELECT src, dst, kind FROM ({_SOLIDITY_EDGES}) UNION ALL SELECT src, dst, kind FROM ({_GO_EDGES}) UNION ALL SELECT src, dst, kind FROM ({_RUST_EDGES})")
def combined_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mixed_files(spark, sf_dir)
    return G.combined(facts_of(files), files)[1].select("src", "dst", "kind")


@_query(f"""SELECT id, row_number() OVER (ORDER BY l, n, o) AS place FROM (SELECT 0 AS l, n, o, id FROM ({_RUST_NODES}) UNION ALL SELECT 1, n, o, id FROM ({_GO_NODES}) UNION ALL SELECT 2, n, o, id FROM ({_SOLIDITY_NODES}))""")
def combined_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols, in the order of languages by their first file, then of files and of the search in each."""
    files = mixed_files(spark, sf_dir)
    nodes = G.combined(facts_of(files), files)[0]
    return nodes.select("id", F.row_number().over(W.orderBy("node_ord")).cast("long").alias("place"))


@_query("""SELECT 'p' || (n_nationkey % 5) AS src, 's' || max(n_nationkey) AS dst FROM nation GROUP BY n_nationkey % 5 UNION ALL SELECT 'q' || n_nationkey, 's' || (n_nationkey % 5) FROM nation WHERE n_nationkey >= 5""")
def redefined_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one name in several files of Go: the last definition has the calls, those of earlier ones are lost; each file calls the first of a name."""
    text = F.when(F.col("n_nationkey") < 5, corpus._filled("package p\nfunc p{n}() { s{n}() }\nfunc s{n}() {}\n")).otherwise(
        F.concat(corpus._filled("package p\nfunc q{n}() { s"), F.expr("n_nationkey % 5").cast("string"), F.lit("() }\nfunc p"), F.expr("n_nationkey % 5").cast("string"), corpus._filled("() { s{n}() }\nfunc s{n}() {}\n"))
    )
    files = corpus.nation_files(spark, sf_dir, "go", text)
    return G.call_graph(facts_of(files), files, "go")[1].select("src", "dst")


# Diffs.


def _item_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each order, a hunk for its lines."""
    change = F.struct(F.expr("case l_linenumber % 3 when 0 then 'insert' when 1 then 'delete' else 'normal' end").alias("type"), F.concat(F.lit("q"), F.col("l_partkey")).alias("content"), F.col("l_linenumber").cast("long").alias("line"))
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", change.alias("c")))).alias("s"))
    hunk = F.array(F.struct(F.concat(F.lit("@@ -1,"), F.size("s"), F.lit(" +1,"), F.size("s"), F.lit(" @@")).alias("header"), F.col("s.c").alias("changes")))
    name = F.concat(F.lit("o"), F.col("l_orderkey"))
    kind = F.expr("case l_orderkey % 4 when 0 then 'add' when 1 then 'delete' when 2 then 'rename' else 'modify' end")
    return each.select(F.col("l_orderkey").alias("file_ord"), kind.alias("type"), F.when(kind != "add", F.concat(name, F.when(kind == "rename", ".old").otherwise(""))).alias("old_path"), F.when(kind != "delete", name).alias("new_path"), hunk.alias("hunks"))


_STATUS = "CASE l_orderkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END"


@_query(f"""SELECT 'o' || l_orderkey AS path, {_STATUS} AS status, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_linenumber % 3 = 0), '') AS added,
    coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_linenumber % 3 = 1), '') AS removed FROM lineitem GROUP BY l_orderkey""")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return D.changed_lines(_item_diffs(spark, sf_dir)).select("path", "status", text("added"), text("removed"))


@_query(f"""SELECT 'o' || l_orderkey AS path, {_STATUS} AS status, '--- a/' || (CASE l_orderkey % 4 WHEN 0 THEN '/dev/null' WHEN 2 THEN 'o' || l_orderkey || '.old' ELSE 'o' || l_orderkey END) || chr(10)
    || '+++ b/' || (CASE l_orderkey % 4 WHEN 1 THEN '/dev/null' ELSE 'o' || l_orderkey END) || chr(10) || '@@ -1,' || count(*) || ' +1,' || count(*) || ' @@' || chr(10)
    || string_agg((CASE l_linenumber % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END) || 'q' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey) AS diff FROM lineitem GROUP BY l_orderkey""")
def full_diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.full_diff(_item_diffs(spark, sf_dir))


_CHANGED = f"""WITH f AS ({_PART}), g AS (SELECT *, CASE k % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'added' ELSE 'modified' END AS status FROM f),
    n AS (SELECT path, language, status, CASE WHEN status = 'deleted' THEN 0 ELSE total + 1 END AS added_lines, k % 3 AS removed_lines,
      CASE WHEN status = 'deleted' THEN 0 ELSE total - b - c END AS diff_nloc, CASE WHEN status = 'deleted' THEN 0 ELSE d * d + 2 * d END AS diff_complexity, CASE WHEN status = 'deleted' THEN 0 ELSE c END AS cl FROM g),
    q AS (SELECT *, CASE WHEN diff_nloc > 0 THEN {_fixed2("(cl::DOUBLE / greatest(diff_nloc, 1) * 100)")} ELSE 0::DOUBLE END AS comment_density, CASE WHEN diff_nloc > 0 THEN diff_complexity::DOUBLE / diff_nloc * 100 ELSE 0::DOUBLE END AS cx FROM n),
    r AS (SELECT path, language, status, added_lines, removed_lines, diff_nloc, diff_complexity, comment_density, {_hours("diff_nloc", "cx", "comment_density")} AS estimated_hours FROM q JOIN {_DIM} USING (language))"""


@_query(f"{_CHANGED} SELECT * FROM r")
def diff_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of each file are new, and one that it doesn't have."""
    files = source_files(spark, sf_dir)
    kind = F.expr("case file_ord % 5 when 0 then 'deleted' when 1 then 'added' else 'modified' end")
    changes = files.select(
        "path", kind.alias("status"), F.sequence(F.lit(1).cast("long"), F.size(X.lines_of(F.col("content"))).cast("long") + 1).alias("added"),
        F.expr("slice(array(1L, 2L), 1, int(file_ord % 3))").alias("removed"),
    )
    return D.metrics_of(changes, files)


@_query(f"""{_CHANGED} SELECT *, {_fixed2("total_hours / 8")} AS total_days FROM (SELECT sum(added_lines)::BIGINT AS total_added_lines, sum(removed_lines)::BIGINT AS total_removed_lines, sum(diff_nloc)::BIGINT AS total_diff_nloc,
    sum(diff_complexity)::BIGINT AS total_diff_complexity, {_fixed2("sum(estimated_hours)")} AS total_hours, count(*)::BIGINT AS files_changed FROM r)""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(diff_metrics(spark, sf_dir))


@_query(f"{_CHANGED} SELECT status, count(*)::BIGINT AS files FROM r GROUP BY status")
def files_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.files_by_status(diff_metrics(spark, sf_dir))


_SIDES = """WITH o AS (SELECT 'c' || o_custkey AS path, o_orderkey AS fn_ord, o_orderpriority AS signature, o_orderkey % 100 AS start_line, o_orderkey % 100 + 3 AS end_line, o_orderstatus AS s FROM orders),
    ch AS (SELECT 'c' || c_custkey AS path, CASE c_custkey % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS status, c_custkey % 100 AS line FROM customer),
    head AS (SELECT o.*, ch.status, ch.line FROM o JOIN ch USING (path) WHERE s IN ('O', 'P')), base AS (SELECT o.*, ch.status FROM o JOIN ch USING (path) WHERE s IN ('F', 'P'))"""
_BOTH = "SELECT 1 FROM {0} x WHERE x.path = t.path AND x.signature = t.signature AND x.status = 'modified'"


def _signature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey) as path", "o_orderkey as fn_ord", "o_orderpriority as signature", "o_orderkey % 100 as start_line", "o_orderkey % 100 + 3 as end_line", "o_orderstatus as s")
    changes = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) as path", "case c_custkey % 7 when 0 then 'added' when 1 then 'deleted' else 'modified' end as status", "array(c_custkey % 100) as added")
    return D.signature_changes(changes, orders.where("s in ('F', 'P')").drop("s"), orders.where("s in ('O', 'P')").drop("s"))


def _changes(change: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _signature_rows(spark, sf_dir).where(F.col("change") == change).select("path", "status", "ord", "signature")


@_query(f"{_SIDES} SELECT path, status, fn_ord AS ord, signature FROM head t WHERE status IN ('added', 'modified') AND NOT EXISTS ({_BOTH.format('base')})")
def signature_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes("added")(spark, sf_dir)


@_query(f"{_SIDES} SELECT path, status, fn_ord AS ord, signature FROM base t WHERE status IN ('deleted', 'modified') AND NOT EXISTS ({_BOTH.format('head')})")
def signature_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes("removed")(spark, sf_dir)


@_query(f"{_SIDES} SELECT path, status, fn_ord AS ord, signature FROM head t WHERE status = 'modified' AND line BETWEEN start_line AND end_line AND EXISTS ({_BOTH.format('base')})")
def signature_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes("modified")(spark, sf_dir)


# Order of words, characters of two units.


_CASED = "SELECT l_orderkey * 10 + l_linenumber AS edge_ord, 's' || l_suppkey % 40 AS src, ['n', 'N', 'm', 'Mn', 'mN', 'mn'][1 + l_partkey % 6] || l_partkey % 10 AS dst FROM lineitem"


@_query(f"SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY lower(dst), dst DESC, edge_ord) AS n FROM ({_CASED})")
def edge_order_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in small and capital letters: letters come before case, small before capital."""
    edges = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as edge_ord", "concat('s', l_suppkey % 40) as src", "concat(element_at(array('n', 'N', 'm', 'Mn', 'mN', 'mn'), int(l_partkey % 6) + 1), l_partkey % 10) as dst")
    return P.ranked_edges(edges).withColumn("n", F.col("n").cast("long"))


@_query("""SELECT p_partkey, CASE WHEN e + 2 * m > 80 THEN repeat('x', e) || repeat('😀', (77 - e) // 2) || (CASE WHEN (77 - e) % 2 = 1 THEN chr(65533) ELSE '' END) || '...' ELSE repeat('x', e) || repeat('😀', m) END AS short
    FROM (SELECT p_partkey, (p_size % 2)::INT AS e, (p_partkey % 70)::INT AS m FROM part)""")
def signature_truncate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(repeat('x', p_size % 2), repeat('😀', int(p_partkey % 70)))")
    return table(spark, sf_dir, "part").select("p_partkey", X.truncate(text, 80).alias("short"))


@_query(_theta(_NESTED))
def interval_nesting_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the sweep, by the join that defines nesting."""
    return I.nesting(_spans(spark, sf_dir, "l_linenumber div 2", "100 - l_linenumber div 2")).select("path", "ord", "nesting")


# The tools, over files and repositories.


def _tree(spark: SparkSession, sf_dir: str, *more: tuple[str, str], which: str = "file_ord <= 150") -> str:
    """The files of the first 150 parts, which have all languages, or of others, and files that don't count, in a folder."""
    root = corpus.work_dir(spark)
    corpus.lay_out_rows(root, source_files(spark, sf_dir).where(which))
    corpus.lay_out(root, [("src/notes.txt", "x"), ("src/.hidden.go", "package p\n"), ("other/z.go", "package p\nfunc Z() {}\n"), *more])
    return root


_FIRST = f"SELECT * FROM ({_PART}) WHERE k <= 150"


@_query(f"SELECT path, {_SIGNATURE} AS signature FROM ({_FIRST}) WHERE language <> 'rust'")
def tool_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of files that globs find, one pattern taking matches of another away; a file without functions has no row."""
    return api.peek(spark, ["src/**/*", "!**/*.rs"], _tree(spark, sf_dir, ("src/none.go", "package p\n"))).select("path", F.explode("signatures").alias("signature"))


@_query(_METRICS)
def tool_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the files of all parts, which lie in a folder."""
    return api.metrics(spark, "src/**/*", _tree(spark, sf_dir, which="true")).rows


@_query(f"""SELECT total_nloc, total_hours, {_fixed2("total_hours / 8")} AS total_days FROM (SELECT sum(nloc)::BIGINT AS total_nloc, {_fixed2("sum(estimated_hours)")} AS total_hours FROM ({_METRICS}) WHERE path IN (SELECT path FROM ({_FIRST})))""")
def tool_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.metrics(spark, ["src/*.{sol,go,rs,cpp,java,cairo,compact,move,nr,tolk,masm,js,ts,tsx,flow}"], _tree(spark, sf_dir)).summary


@_query(f"SELECT path, row_number() OVER (ORDER BY first, path) AS place FROM (SELECT path, min(path) OVER (PARTITION BY language) AS first FROM ({_FIRST}))")
def tool_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language after language by their first file."""
    return S.read(spark, "src/**/*", _tree(spark, sf_dir)).select("path", F.row_number().over(W.orderBy("file_ord")).cast("long").alias("place"))


@_query(_METRICS)
def written_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as JSON and read again."""
    path = corpus.out_dir(spark)
    with api.scope():
        rows = file_metrics(spark, sf_dir)
        S.write(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@_query("""SELECT 'N' || n_nationkey || '.own' || n_nationkey || '()' AS root, 'N' || n_nationkey || '.own' || n_nationkey || '() -> N' || (n_nationkey // 2) || '.base' || (n_nationkey // 2) || '()' AS path, 1::BIGINT AS rank FROM nation""")
def tool_execution_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = corpus.work_dir(spark)
    corpus.lay_out(root, [tuple(r) for r in inheriting_files(spark, sf_dir).select("path", "content").collect()])  # 25 files
    return api.execution_paths(spark, "**/*.sol", root).select("root", "path", "rank")


#: Of the files that change, those with n % 8 = 0 get a comment and no function of theirs changes.
_CHANGES = """SELECT n_nationkey AS n, 'n' || lpad(n_nationkey::VARCHAR, 2, '0') || ['.sol', '.sol', '.go', '.rs'][1 + n_nationkey % 4] AS path, ['modified', 'modified', 'deleted', 'added'][1 + n_nationkey % 4] AS status, n_nationkey % 8 = 0 AS noted FROM nation WHERE n_nationkey % 4 > 0 OR n_nationkey % 8 = 0"""


@_query(f"""SELECT path, status, CASE CASE WHEN noted THEN 'noted' ELSE status END WHEN 'noted' THEN '--- a/' || path || '|+++ b/' || path || '|@@ -4,3 +4,4 @@ contract N' || n || ' {{|   }}|   function old' || n || '() public {{}}| }}|+// end' WHEN 'modified' THEN '--- a/' || path || '|+++ b/' || path || '|@@ -1,6 +1,8 @@| contract N' || n || ' {{|   function a' || n || '() public {{|-    x = 1;|+    if (y) {{|+      x = 2;|+    }}|   }}|-  function old' || n || '() public {{}}|+  function new' || n || '() public {{}}| }}'
    WHEN 'deleted' THEN '--- a/' || path || '|+++ b//dev/null|@@ -1,5 +0,0 @@|-package p|-|-func Gone' || n || '(a int) {{|-' || chr(9) || 'println(a)|-}}'
    ELSE '--- a//dev/null|+++ b/' || path || '|@@ -0,0 +1,4 @@|+pub fn fresh' || n || '(b: u8) -> u8 {{|+    // note|+    b + 1|+}}' END AS diff FROM ({_CHANGES})""")
def tool_diff_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.diff(spark, "main~1", "main", cwd=corpus.repository(spark, sf_dir))
    return found.select("path", "status", F.translate("diff", "\n", "|").alias("diff"))


@_query(f"""SELECT path, status, CASE status WHEN 'modified' THEN 'function new' || n || '() public' WHEN 'added' THEN 'pub fn fresh' || n || '(b: u8) -> u8' ELSE '' END AS added,
    CASE status WHEN 'modified' THEN 'function a' || n || '() public' ELSE '' END AS modified, CASE status WHEN 'modified' THEN 'function old' || n || '() public' WHEN 'deleted' THEN 'func Gone' || n || '(a int)' ELSE '' END AS removed FROM ({_CHANGES}) WHERE NOT noted""")
def tool_diff_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.diff(spark, "main~1", "main", output="signatures", cwd=corpus.repository(spark, sf_dir))
    return found.select("path", "status", *(F.array_join(c, "|").alias(c) for c in ("added", "modified", "removed")))


@_query(f"""SELECT path, language, status, added_lines, removed_lines, diff_nloc, diff_complexity, density AS comment_density, {_hours("diff_nloc", "cx", "density")} AS estimated_hours FROM (
    SELECT *, CASE status WHEN 'modified' THEN 'solidity' WHEN 'deleted' THEN 'go' ELSE 'rust' END AS language, CASE WHEN noted THEN 1 WHEN status = 'deleted' THEN 0 ELSE 4 END::BIGINT AS added_lines, CASE WHEN noted THEN 0 WHEN status = 'modified' THEN 2 WHEN status = 'deleted' THEN 5 ELSE 0 END::BIGINT AS removed_lines,
      CASE WHEN noted OR status = 'deleted' THEN 0 WHEN status = 'modified' THEN 4 ELSE 3 END::BIGINT AS diff_nloc, CASE WHEN status = 'modified' AND NOT noted THEN 3 ELSE 0 END::BIGINT AS diff_complexity, CASE status WHEN 'added' THEN 33.33 ELSE 0 END::DOUBLE AS density, CASE WHEN status = 'modified' AND NOT noted THEN 75 ELSE 0 END::DOUBLE AS cx
    FROM ({_CHANGES})) JOIN {_DIM} USING (language)""")
def tool_diff_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.diff_metrics(spark, "main~1", "main", cwd=corpus.repository(spark, sf_dir)).rows


@_query(f"SELECT status, count(*)::BIGINT AS files FROM ({_CHANGES}) GROUP BY status")
def tool_diff_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.diff_metrics(spark, "main~1", "main", cwd=corpus.repository(spark, sf_dir)).by_status
