"""Call graphs: symbols from functions, call sites resolved to symbols by prioritised joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import caching
from ..functions import expressions as X

#: Names of calls that are no calls of functions: (kinds, names) by language.
BUILTINS = {
    "solidity": (
        (("super", "member", "this", "simple"), ("require", "assert", "revert", "emit")),
        (("assembly",), ("if", "for", "switch", "case", "default", "let", "function", "leave", "break", "continue")),
    ),
    "go": (
        (("simple",), tuple("append cap clear close complex copy delete imag len make max min new panic print println real recover".split())),
    ),
    "rust": (),
}
NODES = "node_ord long, id string, label string, file string, container string, container_kind string, visibility string, start_line long, start_col long, end_line long"
EDGES = "edge_ord long, src string, dst string, kind string"


def go_visibility(name: Column) -> Column:
    first = F.substring(name, 1, 1)
    return F.when((first == F.upper(first)) & (first != F.lower(first)), "public").otherwise("private")


def go_receiver(text: Column) -> Column:
    """The type in the text of a receiver, by the pattern that is to be kept: of a receiver that is a type alone, the last letter."""
    found = F.regexp_extract(text, r"[(]\s*\w*\s*[*]?\s*(\w+)\s*[)]", 1)
    return F.when(found != "", found)


def rust_visibility(token: Column) -> Column:
    inner = token.rlike(r"^pub\s*\(\s*(crate|super|in)\b")
    return F.when(token.isNull(), "private").when(inner, "internal").otherwise("public")


def solidity_visibility(token: Column, signature: Column, container_kind: Column) -> Column:
    """The token, else the first of the words that the signature has, else what the container implies."""
    out = F.when(token.isin("external", "public", "internal", "private"), token)
    for word in ("external", "public", "internal", "private"):
        out = out.when(signature.rlike(rf"\b{word}\b"), word)
    return out.when(container_kind == "interface", "external").otherwise("internal")


def edge_kind(call: Column, container_kind: Column, visibility: Column) -> Column:
    library = F.when(visibility == "internal", "internal").otherwise("external")
    return (
        F.when(call == "this", "external")
        .when(call.isin("super", "simple", "assembly"), "internal")
        .when(container_kind == "library", library)
        .otherwise("external")
    )


def without_builtins(calls: DataFrame, language: str) -> DataFrame:
    """``calls`` (kind, name) without those of the language's ``BUILTINS``."""
    for kinds, names in BUILTINS[language]:
        calls = calls.where(~(F.col("kind").isin(*kinds) & F.col("name").isin(*names)))
    return calls


def upsert(symbols: DataFrame) -> DataFrame:
    """One row for each id: the values of the last, at the place of the first. ``ord`` orders the rows and is the place."""
    others = [c for c in symbols.columns if c not in ("id", "ord")]
    last = symbols.groupBy("id").agg(F.min("ord").alias("first"), F.max_by(F.struct(*others), "ord").alias("v"))
    return last.select("id", F.col("first").alias("ord"), *[F.col(f"v.{c}").alias(c) for c in others])


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(edge_ord, src, dst, kind) without edges to oneself, each pair at the place of its first edge."""
    first = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("edge_ord").alias("edge_ord"), F.min_by("kind", "edge_ord").alias("kind"))
    return first.select("edge_ord", "src", "dst", "kind")


def first_match(candidates: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of the candidates of each key that which comes first."""
    return candidates.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def ancestors(inheritance: DataFrame, depth: int = 64) -> DataFrame:
    """(child, ancestor, key): all that a container inherits from, ``key`` in the order of a depth-first search through parents in declared order.

    A container that is an ancestor of itself isn't followed again. Longer chains than ``depth`` are an error of the recursion limit. The
    result is computed at once, with limits of recursion that are set for that only.
    """
    spark = inheritance.sparkSession
    inheritance = caching.settle(inheritance)  # every step of the recursion joins it
    with caching.settings(spark, spark__sql__cteRecursionLevelLimit=str(max(100, depth + 2))):
        found = spark.sql(
            """
            WITH RECURSIVE a(child, ancestor, key, trail) AS (
              SELECT child, parent, array(ord), array(child, parent) FROM {i}
              UNION ALL
              SELECT a.child, i.parent, array_append(a.key, i.ord), array_append(a.trail, i.parent)
              FROM a JOIN {i} i ON i.child = a.ancestor WHERE NOT array_contains(a.trail, i.parent)
            )
            SELECT child, ancestor, min(key) AS key FROM a GROUP BY child, ancestor
            """,
            i=inheritance,
        )
        return caching.settle(found)


def _symbols(facts: DataFrame, files: DataFrame, language: str) -> DataFrame:
    """Functions as symbols, in the order in which they are found; ``raw`` is not yet unique by id."""
    f = facts.where((F.col("fact") == "function") & (F.col("language") == language)).join(files.select("path", "file_ord"), "path")
    name, raw = F.col("name"), F.col("text")
    token, receiver = F.col("libs")[0], F.col("libs")[1]
    clean = X.clean_signature(raw)
    if language == "solidity":
        params = F.transform("names", X.clean_signature)
        special = F.col("kind").isin("fallback", "receive")
        own = F.concat(name, F.lit("("), F.when(special, "").otherwise(F.array_join(params, ", ")), F.lit(")"))
        container, kind = F.col("owner"), F.col("owner_kind")
        visibility = F.when(special, "external").otherwise(solidity_visibility(token, F.substring_index(clean, "{", 1), kind))
        ident, phase = F.concat(F.coalesce(F.concat(container, F.lit(".")), F.lit("")), own), F.when(container.isNull(), 1).otherwise(0)
    elif language == "rust":
        # A function of an implementation in a module of the file is a symbol of both.
        free, inner, module = F.col("libs")[2], F.col("libs")[3], F.col("libs")[4]
        place = lambda name, phase: F.struct(name.alias("container"), F.lit(phase).alias("phase"))
        places = F.array_compact(F.array(F.when(inner.isNotNull(), place(inner, 0)), F.when(module.isNotNull(), place(module, 1)), F.when(free.isNotNull() & inner.isNull(), place(F.lit(None).cast("string"), 1))))
        f = f.withColumn("at", F.explode(places))
        container, kind = F.col("at.container"), F.lit(None).cast("string")
        visibility = rust_visibility(token)
        ident, phase = F.concat(F.coalesce(F.concat(container, F.lit("::")), F.lit("")), name), F.col("at.phase")
    else:
        container, kind = go_receiver(receiver), F.lit(None).cast("string")
        visibility = go_visibility(name)
        ident, phase = F.concat(F.coalesce(F.concat(container, F.lit(".")), F.lit("")), name), F.when(receiver.isNull(), 0).otherwise(1)
    rows = f.select(
        ident.alias("id"), name.alias("label"), F.col("path").alias("file"), container.alias("container"), kind.alias("container_kind"),
        visibility.alias("visibility"), (F.col("start_row") + 1).alias("start_line"), "start_col", (F.col("end_row") + 1).alias("end_line"),
        "file_ord", phase.cast("long").alias("phase"), F.col("ord").alias("fn_ord"),
    )
    return rows.withColumn("ord", F.struct("file_ord", "phase", "fn_ord")).drop("phase")


def _resolve(language: str, calls: DataFrame, symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates (call key, dst, priorities) of all rules."""
    none = F.array().cast("array<long>")
    keep = [*calls.columns, "prio", "key", "dst", "s_ord", "s_kind", "s_visibility"]
    # Of the symbols that a rule may find for a name, only the first counts, so a call meets one row for each container that it looks in, however many functions share the name.
    entry = F.struct(F.col("ord").alias("s_ord"), F.col("id").alias("dst"), F.col("container_kind").alias("s_kind"), F.col("visibility").alias("s_visibility"))
    held = symbols.where("container is not null").groupBy(F.col("label").alias("s_label"), F.col("container").alias("s_container")).agg(F.min(entry).alias("s"))
    loose = symbols.where("container is null").groupBy(F.col("label").alias("s_label")).agg(F.min(entry).alias("s"))
    every_one = symbols.groupBy(F.col("label").alias("s_label")).agg(F.min(entry).alias("s"))

    def rule(on: Column | DataFrame, prio: int, rows: DataFrame = calls, key: Column = none) -> DataFrame:
        """Candidates of symbols in the container that ``on`` demands, or of ``on``, symbols by name alone."""
        found = rows.join(on, F.col("name") == F.col("s_label")) if isinstance(on, DataFrame) else rows.join(held, (F.col("name") == F.col("s_label")) & on)
        return found.select("*", "s.*").withColumn("prio", F.lit(prio)).withColumn("key", key).select(*keep)

    local = F.col("s_container") == F.col("container")
    kind = F.col("kind")
    if language == "go":
        rules = [rule(loose, 0, calls.where(kind != "selector")), rule(local, 0, calls.where(kind == "selector")), rule(every_one, 1)]
    elif language == "rust":
        scoped = kind.isin("scoped", "generic_scoped")
        simple = kind.isin("simple", "generic_simple")
        rules = [
            rule(F.col("s_container") == F.col("receiver"), 0, calls.where(scoped)),
            rule(local, 0, calls.where(~scoped)),
            rule(loose, 1, calls.where(simple)),
            rule(every_one, 2),
        ]
    else:
        c = facts.where("fact = 'container' and language = 'solidity'")
        # Containers of one name are one: of those that have parents, or libraries, the last counts.
        last = W.partitionBy("name").orderBy(F.desc("path"), F.desc("ord"))

        def lists(column: str) -> DataFrame:
            some = c.where(F.size(column) > 0).withColumn("n_", F.row_number().over(last)).where("n_ = 1")
            return some.select(F.col("name").alias("child"), F.posexplode(column).alias("ord", "parent"))

        parents = lists("names").select("child", "parent", F.col("ord").cast("long").alias("ord"))
        libraries = lists("libs").select(F.col("child").alias("l_child"), F.col("parent").alias("l_name"), F.array(F.col("ord").cast("long")).alias("l_key"))
        direct = parents.select(F.col("child").alias("p_child"), F.col("parent").alias("p_name"), F.array("ord").alias("p_key"))
        every = ancestors(parents).select(F.col("child").alias("a_child"), F.col("ancestor").alias("a_name"), F.col("key").alias("a_key"))
        supers = calls.where(kind == "super").join(direct, F.col("container") == F.col("p_child"))
        members = calls.where(kind == "member")
        using = members.join(libraries, F.col("container") == F.col("l_child"))
        simple = calls.where(kind.isin("this", "simple", "assembly"))
        inherited = simple.join(every, F.col("container") == F.col("a_child"))
        rules = [
            rule(F.col("s_container") == F.col("p_name"), 0, supers, F.col("p_key")),
            rule(F.col("s_container") == F.col("receiver"), 0, members),
            rule(F.col("s_container") == F.col("l_name"), 1, using, F.col("l_key")),
            rule(local, 0, simple),
            rule(F.col("s_container") == F.col("a_name"), 1, inherited, F.col("a_key")),
            rule(loose, 2, simple),
            rule(every_one, 3, simple),
        ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def call_graph(facts: DataFrame, files: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one language. ``files`` has (path, file_ord), the order in which they are read.

    A symbol that is defined again keeps its place, takes the new values and loses the calls of the old body. A call goes to
    the first symbol of the first rule that finds one: in its own container, what it inherits or uses, free functions, any of the name.
    """
    raw = caching.settle(_symbols(facts, files, language))
    table = upsert(raw)
    calls = facts.where((F.col("fact") == "call") & (F.col("language") == language)).select(
        F.col("path").alias("file"), "fn_ord", F.col("ord").alias("call_ord"), "kind", "name", F.col("owner").alias("receiver")
    )
    callers = first_match(table, ["file", "fn_ord"], ["ord"]).select("file", "fn_ord", F.col("id").alias("src"), "container", "file_ord")
    sites = caching.settle(without_builtins(calls, language).join(callers, ["file", "fn_ord"]))  # every rule joins them
    found = first_match(_resolve(language, sites, raw, facts), ["file", "fn_ord", "call_ord"], ["prio", "key", "s_ord"])
    kind = edge_kind(F.col("kind"), F.col("s_kind"), F.col("s_visibility")) if language == "solidity" else F.lit("internal")
    place = F.struct("file_ord", "fn_ord", "call_ord")
    edges = found.select(place.alias("edge_ord"), "src", "dst", kind.alias("kind"))
    edges = edges if language == "solidity" else distinct_edges(edges)
    nodes = table.select(F.col("ord").alias("node_ord"), "id", "label", "file", "container", "container_kind", "visibility", "start_line", "start_col", "end_line")
    return nodes, edges


def combined(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all languages that have graphs; those of the language that comes first in ``files`` come first."""
    files = caching.settle(files.select("path", "language", "file_ord"))
    first = files.groupBy("language").agg(F.min("file_ord").alias("lang_ord"))
    present = {r.language for r in first.collect()}  # a row for each language
    nodes = edges = None
    for language in [x for x in ("solidity", "rust", "go") if x in present] or ["go"]:
        n, e = call_graph(facts, files, language)
        at = first.where(F.col("language") == language).select("lang_ord")
        n = n.crossJoin(F.broadcast(at)).withColumn("node_ord", F.struct("lang_ord", "node_ord")).drop("lang_ord")
        e = e.crossJoin(F.broadcast(at)).withColumn("edge_ord", F.struct("lang_ord", "edge_ord")).drop("lang_ord")
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return nodes, edges
