from __future__ import annotations

import random

import pytest

from glyphmill.operators import graph as G
from glyphmill.operators import paths as P
from glyphmill.plans import api
from glyphmill.sources.files import from_rows


def graph(spark, *rows):
    nodes, edges = api.call_graph(from_rows(spark, rows))
    return [r.id for r in nodes.orderBy("node_ord").collect()], [(r.src, r.dst, r.kind) for r in edges.orderBy("edge_ord").collect()], {r.id: r.visibility for r in nodes.collect()}


def test_solidity(spark):
    text = """
interface IExt { function ext() external; }
library Math { function add(uint left, uint right) internal pure returns (uint) { return left + right; } function sub(uint a) public {} }
contract Base { function foo() public virtual {} function deep() internal {} }
contract Mid is Base { function mid() public { deep(); } }
contract Top is Mid, Other {
  using Math for uint;
  IExt IExt;
  constructor() { foo(); }
  modifier only() { mid(); _; }
  function foo() public override { super.mid(); super.foo(); }
  function all(uint x, function(uint) external cb) external only {
    foo(); foo(); deep(); Math.add(1, 2); x.sub(); IExt.ext(); this.foo(); require(x > 0); loose(); nobody(); a[0].foo(); all(x, cb);
    assembly { let y := helper(1) }
  }
  function helper() private {}
  receive() external payable { helper(); }
}
function loose() {}
"""
    nodes, edges, seen = graph(spark, ("t.sol", text))
    call = "Top.all(uint x, function(uint) external cb)"
    assert nodes == ["IExt.ext()", "Math.add(uint left, uint right)", "Math.sub(uint a)", "Base.foo()", "Base.deep()", "Mid.mid()", "Top.foo()", call, "Top.helper()", "Top.receive()", "loose()"]
    assert seen["IExt.ext()"] == "external" and seen["Top.receive()"] == "external" and seen["loose()"] == "internal" and seen[call] == "external" and seen["Top.helper()"] == "private"
    assert edges == [
        ("Mid.mid()", "Base.deep()", "internal"),
        ("Top.foo()", "Mid.mid()", "internal"),
        (call, "Math.add(uint left, uint right)", "internal"),
        (call, "Math.sub(uint a)", "external"),
        (call, "IExt.ext()", "external"),
        (call, "Top.foo()", "external"),
        (call, "Top.foo()", "internal"),
        (call, "Top.foo()", "internal"),
        (call, "Base.deep()", "internal"),
        (call, "loose()", "internal"),
        (call, call, "internal"),
        (call, "Top.helper()", "internal"),
        ("Top.receive()", "Top.helper()", "internal"),
    ]


def test_redefinition_loses_calls_and_overloads_go_to_the_first(spark):
    a = "contract A { function f() public { g(); } function g() internal {} function h(uint a) public {} function h() public {} }"
    b = "contract A { function f() public { h(); } }"
    _, edges, _ = graph(spark, ("a.sol", a), ("b.sol", b))
    assert edges == [("A.f()", "A.h(uint a)", "internal")]


def test_rust(spark):
    text = """
mod inner { pub fn in_mod() { helper(); } }
trait Show { fn show(&self); fn defaulted(&self) { helper(); } }
struct P;
impl Show for P { fn show(&self) { self.detail(); println!("{}", helper()); } }
impl<T> Q<T> { pub fn new() -> Self { Q::make::<T>() } fn make() -> Self { P::detail(); helper::<u8>(); let c = |x| helper(); Q } pub(crate) fn own(&self) {} }
impl P { fn detail(&self) { self.detail(); } pub async fn go(&self) { helper().await; } }
fn helper() {}
fn main() { helper(); helper(); let q = Q::new(); q.own(); std::mem::swap(a, b); }
"""
    nodes, edges, seen = graph(spark, ("t.rs", text))
    assert nodes == ["P::show", "Q::new", "Q::make", "Q::own", "P::detail", "P::go", "inner::in_mod", "helper", "main"]
    assert (seen["Q::new"], seen["Q::own"], seen["helper"], seen["P::go"]) == ("public", "internal", "private", "public")
    assert {e[:2] for e in edges} == {("inner::in_mod", "helper"), ("P::show", "P::detail"), ("Q::new", "Q::make"), ("Q::make", "P::detail"), ("Q::make", "helper"), ("P::go", "helper"), ("main", "helper"), ("main", "Q::new"), ("main", "Q::own")}
    assert len(edges) == 9 and {e[2] for e in edges} == {"internal"}


def test_rust_implementations_in_modules_are_symbols_of_both(spark):
    text = "mod m { impl T { fn a(&self) { b(); } } fn b() { fn nested() {} } mod deep { fn c() { b(); } } }"
    nodes, edges, _ = graph(spark, ("t.rs", text))
    assert nodes == ["T::a", "m::a", "m::b", "m::nested", "m::c"]
    assert {e[:2] for e in edges} == {("T::a", "m::b"), ("m::c", "m::b")}


def test_go(spark):
    a = "package p\nfunc main() { Run(1); fmt.Println(len(x)); defer clean(); go func() { work() }() }\nfunc Run[T any](a T) { s.Start(); Run(a) }\nfunc clean() {}\nfunc work() {}\n"
    b = "package p\ntype S struct{}\nfunc (s *S) Start() { s.stop(); clean() }\nfunc (s S) stop() {}\nfunc (S) bare() {}\n"
    nodes, edges, seen = graph(spark, ("a.go", a), ("b.go", b))
    assert nodes == ["main", "Run", "clean", "work", "S.Start", "S.stop", "S.bare"]
    assert [e[:2] for e in edges] == [("main", "Run"), ("main", "clean"), ("main", "work"), ("Run", "S.Start"), ("S.Start", "clean"), ("S.Start", "S.stop")]
    assert seen["Run"] == "public" and seen["main"] == "private" and seen["S.Start"] == "public"


def nodes_edges(spark, nodes, edges):
    n = spark.createDataFrame([(k, i, v) for k, (i, v) in enumerate(nodes)], "node_ord long, id string, visibility string")
    e = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(edges)], "edge_ord long, src string, dst string")
    return n, e


def walk(roots, edges):
    """The definition, depth first."""
    out = []

    def step(node, stack, key):
        if node in stack:
            return found.append((stack + [f"{node} (Recursive)"], key))
        if len(stack) >= 10:
            return found.append((stack + [f"{node} (Max Depth)"], key))
        following = sorted((b, k) for k, (a, b) in enumerate(edges) if a == node)
        if not following:
            found.append((stack + [node], key))
        for n, (b, _) in enumerate(following):
            step(b, stack + [node], key + [n])

    for root in roots:
        found = []
        step(root, [], [])
        best = sorted(found, key=lambda x: (-len(x[0]), x[1]))[:5]
        out += [(root, k + 1, " -> ".join(p)) for k, (p, _) in enumerate(best)]
    return out


def test_paths(spark):
    for nodes, edges in (
        ([("A", "public"), ("B", "internal"), ("C", "internal"), ("D", "internal")], [("A", "B"), ("B", "C")]),
        ([("A", "external"), ("B", "internal")], [("A", "B"), ("B", "A")]),
        ([("A", "public")], [("A", "B"), ("A", "C"), ("A", "B")]),
        ([("N0", "public"), ("alone", "public")], [(f"N{i}", f"N{i + 1}") for i in range(15)]),
    ):
        got = sorted((r.root, r.rank, r.path) for r in P.execution_paths(*nodes_edges(spark, nodes, edges)).collect())
        assert got == sorted(walk([i for i, v in nodes if v != "internal"], edges))


def test_random_paths(spark):
    rng = random.Random(8)
    names = [f"n{i:02d}" for i in range(12)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(18)]
    nodes = [(n, "public" if i % 3 == 0 else "private") for i, n in enumerate(names)]
    got = sorted((r.root, r.rank, r.path) for r in P.execution_paths(*nodes_edges(spark, nodes, edges)).collect())
    assert got == sorted(walk([i for i, v in nodes if v == "public"], edges))


def test_too_many_paths_are_an_error(spark):
    n, e = nodes_edges(spark, [("a0", "public")], [(f"a{i}", f"a{i + 1}") for i in range(9) for _ in range(4)])
    with pytest.raises(Exception, match="(?i)row"):
        P.all_paths(n, e, row_limit=1000).collect()


def test_order_of_edges_is_that_of_words(spark):
    n, e = nodes_edges(spark, [("r", "public")], [("r", "Zeta"), ("r", "alpha"), ("r", "Beta")])
    assert [r.path for r in P.execution_paths(n, e).orderBy("rank").collect()] == ["r -> alpha", "r -> Beta", "r -> Zeta"]


def test_inheritance_with_cycles(spark):
    i = spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("b", "c", 1)], "child string, parent string, ord long")
    assert sorted((r.child, r.ancestor) for r in G.ancestors(i).collect()) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c")]


def test_twenty_thousand_functions_of_one_name(spark):
    """A call meets one row for each rule, however many functions share its name."""
    from pyspark.sql import functions as F

    hot = spark.range(20_000).select(F.format_string("h%05d.go", "id").alias("path"), F.concat(F.lit("package p\nfunc (t *T"), "id", F.lit(") get() { t.get(); x.get(); get() }\n")).alias("content"), F.lit("go").alias("language"), F.col("id").alias("file_ord"))
    with api.scope():
        nodes, edges = G.call_graph(api.facts_of(hot), hot, "go")
        assert nodes.count() == 20_000
        # Each calls itself, which is no edge, and by simple calls the first of all.
        assert edges.count() == 19_999 and edges.select("dst").distinct().first().dst == "T0.get"


def test_nothing_stays_behind(spark):
    """Limits of recursion and caches are as before, once the scope of a tool ends."""
    kept = lambda: len(spark.sparkContext._jsc.getPersistentRDDs())
    names = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")
    before, limits = kept(), [spark.conf.get(n) for n in names]
    with api.scope():
        files = from_rows(spark, [("a.sol", "contract A { function f() public { g(); } }\ncontract B is A { function g() public { super.f(); } }")])
        assert [r.path for r in api.execution_paths_of_files(files).orderBy("root").collect()] == ["A.f() -> B.g() -> A.f() (Recursive)", "B.g() -> A.f() -> B.g() (Recursive)"]
        assert kept() > before
    assert kept() == before and [spark.conf.get(n) for n in names] == limits


def test_trees_of_files_have_an_order(spark, tmp_path):
    from glyphmill.sources.files import read_tree, write

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sol").write_text("contract A { function f() public { g(); } function g() internal {} }")
    (tmp_path / "in" / "b.go").write_text("package p\nfunc F() { g() }\nfunc g() {}\n")
    found = api.execution_paths_of_files(read_tree(spark, str(tmp_path / "in")))
    write(found.select("root", "path"), str(tmp_path / "out"), "json")
    assert sorted(r.path for r in spark.read.json(str(tmp_path / "out")).collect()) == ["A.f() -> A.g()", "F -> g"]
    with pytest.raises(ValueError):
        write(found, str(tmp_path / "other"), "text")
    assert api.execution_paths_of_files(from_rows(spark, [("x.js", "function f() { f() }")])).collect() == []
