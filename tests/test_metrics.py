from __future__ import annotations

import random

import pytest

from glyphmill.operators import intervals as I
from glyphmill.plans import api
from glyphmill.sources.files import from_rows
from glyphmill.sources.scanner import scan

SIMPLE = "contract S {\n    function t() public {\n        uint x = 1;\n    }\n}"
NESTED = "contract C {\n  function t(uint n) public {\n    if (n > 0) {\n      for (uint k = 0; k < n; k += 1) {\n        // here\n      }\n    }\n  }\n}"
SPLIT = "contract M {\n  function long(\n    uint256 one,\n    address two\n  ) public returns (uint256) {\n    return one;\n  }\n}"
NOTES = "// licence\npragma solidity ^0.8.0;\n\n/// about\ncontract D {\n  // state\n  uint256 v;\n\n  /// sets\n  /// @param n new\n  function set(uint256 n) public {\n    v = n;\n  }\n}"
DEEP = "contract D {\n  function f(uint a, uint b, uint c) public {\n    if (a > 0) {\n      if (b > 0) {\n        if (c > 0) {\n          return;\n        }\n      }\n    }\n  }\n}"
HOURS = "contract E {\n  /// documented\n  function s() public {\n    uint x = 1;\n  }\n}"
GO = "package main\n\nfunc f(n int) {\n\tif n > 0 {\n\t\tfor i := 0; i < n; i++ {\n\t\t\t// here\n\t\t}\n\t}\n}"
RUST = "fn f(n: i32) {\n  if n > 0 {\n    for i in 0..n {\n      // here\n    }\n  }\n}"
#: nloc, complexity, lines with comments, density, hours
CASES = [
    ("a.sol", SIMPLE, 5, 0, 0, 0.0, None),
    ("b.sol", NESTED, 8, 3, 1, 12.5, None),
    ("c.sol", SPLIT, 6, 0, 0, 0.0, None),
    ("d.sol", NOTES, 7, 0, 5, 71.43, None),
    ("e.sol", DEEP, 11, 6, 0, 0.0, None),
    ("f.sol", HOURS, 5, 0, 1, 20.0, 0.08),
    ("g.go", GO, 7, 3, 1, None, None),
    ("h.rs", RUST, 6, 3, 1, None, None),
    ("empty.rs", "", 0, 0, 0, 0.0, 0.0),
]


@pytest.fixture(scope="module")
def rows(spark):
    files = from_rows(spark, [(p, c) for p, c, *_ in CASES] + [("no.txt", "x"), ("null.go", None)])
    report = api.metrics_of_files(files)
    return {r.path: r for r in report.rows.collect()}, report.summary.first()


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_exact(rows, case):
    path, _, nloc, complexity, comments, density, hours = case
    r = rows[0][path]
    assert (r.nloc, r.complexity, r.lines_with_comments) == (nloc, complexity, comments)
    assert density is None or r.comment_density == density
    assert hours is None or r.estimated_hours == hours


def test_summary(rows):
    found, total = rows
    assert len(found) == len(CASES) and total.total_nloc == sum(r.nloc for r in found.values())
    assert total.total_hours == pytest.approx(sum(r.estimated_hours for r in found.values()))


def test_sweep_equals_join(spark):
    rng = random.Random(3)
    spans = []

    def grow(path, a, b, depth):
        if b - a < 2 or depth > 6:
            return
        for _ in range(rng.choice([1, 1, 2])):
            spans.append((path, len(spans), a, b))
        cut = rng.randrange(a, b)
        for x, y in ((a, cut), (cut, b)):
            if rng.random() < 0.8:
                grow(path, x, y, depth + 1)

    for p in range(30):
        grow(f"p{p}", 0, 200, 0)
    df = spark.createDataFrame(spans, "path string, ord long, start_idx long, end_idx long")
    key = lambda d: sorted((r.path, r.ord, r.nesting) for r in d.collect())
    assert key(I.nesting(df)) == key(I.nesting_sweep(df))


def branches(language, text):
    return [(r["kind"], text[r["start_idx"] : r["end_idx"]]) for r in scan("f", language, text) if r["fact"] == "branch"]


def functions(language, text):
    return [r["name"] for r in scan("f", language, text) if r["fact"] == "function"]


@pytest.mark.parametrize(
    "language, text, kinds, names",
    [
        ("solidity", "contract C { using L for uint; function f() public { try x.f() { } catch { } do { g(); } while (a); if (a) b(); else if (c) d(); } }", ["catch", "do", "if", "if"], ["f"]),
        ("cpp", '#if X\n#endif\nnamespace n { class A { public: A(int a) : x{a} {} int g() const { switch (x) { case 1: break; } for (int i = 0; i < 2; ++i) if (i) h(i); return "}"[0]; } }; }\nstatic int h(int a) { try { } catch (...) { } while (a) a--; }', ["switch", "for", "if", "catch", "while"], ["A", "g", "h"]),
        ("java", "class A { @Override public int f(int x) throws E { return x > 0 ? 1 : 2; } A() { for (int i : xs) { } } abstract void g(); void h() { switch (a) { } try { } catch (E e) { } do { } while (x); } }", ["conditional", "for", "switch", "catch", "do"], ["f", "A", "g", "h"]),
        ("go", "package p\ntype T struct { f func(int) int }\nfunc (t *T) M(a int) (b int) { switch x := v.(type) { case 1: } ; select { } ; for _, x := range []int{1, 2} { if x == 1 { } else if y { } } ; g := func() { } }\nfunc Top[K any](a K) {}", ["switch", "select", "for", "if", "if"], ["M", "Top"]),
        ("rust", "impl<T> Foo for Bar<T> { pub(crate) fn a(&self) -> Vec<T> where T: X { match x { 1 => loop { }, _ => {} } } }\ntrait Q { fn sig(&self); }\nfn b<'a>(s: &'a str) { while let Some(x) = it { if x == '{' { } } let r = r#\"}\"#; }", ["match", "loop", "while", "if"], ["a", "b"]),
        ("javascript", "export async function f(a) { if (a) return /}/.test(a); for (const x of y) z() }\nconst g = (a) => a ? 1 : 2\nclass A { static async m(x) { try { } catch (e) { } finally { } } get v() { while (1) { } } }\nconst h = async x => { do { } while (x) }", ["if", "for", "conditional", "try", "while", "do"], ["f", None, "m", "v", None]),
        ("typescript", "class A { constructor(private a?: string) {} m<T>(x: T): T | null { switch (x) { } return x ?? null; } }\nconst f = (a: number): number => { return a; };", ["switch"], ["constructor", "m", None]),
        ("javascript", "class A { constructor(x) { super(x); } #p(a) { foo(a)\n{ } } static async *gen() {} [Symbol.iterator]() { } 'q r'() {} get v() { return 1 } }\nconst o = { m() { }, [k](x) { }, n: function () { } }\nfoo(a)\n{ }", [], ["constructor", "#p", "gen", "[Symbol.iterator]", "'q r'", "v", "m", "[k]", None]),
        ("tsx", "class A extends B<{ x: number }> { private constructor(private a: string) { super(a); } #x<T>(y: T): void {} abstract z(): void; }", [], ["constructor", "#x"]),
        ("cpp", "struct A { A() = default; A& operator=(const A& o) { return *this; } bool operator==(const A& o) const { return true; } int operator()(int x) { return x; } int& operator[](int i) { return d[i]; } operator bool() const { return true; } void* operator new(size_t n) { return 0; } };\nstd::ostream& operator<<(std::ostream& o, const A& a) { return o; }\nint main() { struct L { int m() { return 1; } }; auto z = a.operator()(3); if (a == b) { } }", ["if"], ["A", "operator=", "operator==", "operator()", "operator[]", "operator bool", "operator new", "operator<<", "main", "m"]),
        ("java", "class A { void f() { Runnable r = new Runnable() { public void run() { g(); } }; foo(new X<Y>(1, 2) { int z(int q) { return q; } }); synchronized (this) { h(); } run(() -> { int k = m(1); }); } record R(int x) { int y() { return x; } } @Test(expected = Foo.class) public void t() { u(); for (A a : b) { } } }\nenum E { P(1) { int v() { return 1; } }, Q(2); E(int x) { } abstract int v(); }", ["for"], ["f", "run", "z", "y", "t", "v", "E", "v"]),
        ("cairo", "#[external]\nfn f(x: u8) -> u8 { if x == 1 { loop { break; } } match x { _ => 0 } }", ["if", "loop", "match"], ["f"]),
        ("noir", "pub fn f(x: Field) { for i in 0..3 { if i == 1 { } } comptime { } }", ["for", "if", "comptime"], ["f"]),
        ("move", "module a::b { public entry fun f(x: u64) { if (x > 1) { abort 1 }; while (true) { break }; loop { } } }", ["if", "abort", "while", "loop"], ["f"]),
        ("tolk", 'fun f(a: int): int { repeat (3) { } try { } catch { } match (a) { 1 => 2 } do { } while (a); if (a) { } }', ["repeat", "try", "match", "do", "if"], ["f"]),
        ("compact", "export circuit f(a: Field): Field { for (const i of 0..3) { if (a) { } } return a == 1 ? 2 : 3; }", ["for", "if", "conditional"], ["f"]),
        ("masm", "# note\nproc.foo\n  if.true\n    while.true\n      push.1\n    end\n  else\n    repeat.3\n      add\n    end\n  end\nend\nbegin\n  exec.foo\nend", ["if", "while", "repeat"], ["foo", "begin"]),
    ],
    ids=lambda x: x if isinstance(x, str) and len(x) < 12 else "",
)
def test_languages(language, text, kinds, names):
    assert [k for k, _ in branches(language, text)] == kinds
    assert functions(language, text) == names


def test_extent_of_else_chain():
    text = "contract C { function f() public { if (a) { b(); } else if (c) d(); else { e(); } g(); } }"
    assert [t for _, t in branches("solidity", text)] == ["if (a) { b(); } else if (c) d(); else { e(); }", "if (c) d(); else { e(); }"]


def test_definitions_collapse_where_bodies_have_no_name(spark):
    text = "export circuit f(\n  a: Field\n): Field {\n  const b = g(\n    a\n  );\n  return b;\n}\n"
    report = api.metrics_of_files(from_rows(spark, [("a.compact", text)]))
    assert report.rows.first().nloc == 1


def test_structure_of_facts_is_that_of_intervals(spark):
    """Depths that the scanner gives are those of the joins on spans, and rows of comments are those that they cover."""
    from glyphmill.sources.scanner import scan_files

    files = from_rows(spark, [(p, c) for p, c, *_ in CASES] + [("x.ts", "const f = (a) => g(h([1, 2], { x: () => 1 })) ? 1 : k(2)\n/* a */ /* b\n c */ foo(); // d\n  * e"), ("y.java", "class A { int a() { return b(c(1), new D() { int e() { return f(2); } }); } }")])
    facts = scan_files(files).persist()
    of = lambda fact: facts.where(facts.fact == fact)
    want = {(r.path, r.ord): r.nesting for r in I.nesting(of("branch").select("path", "ord", "start_idx", "end_idx")).collect()}
    assert want == {(r.path, r.ord): r.depth for r in of("branch").collect()}
    top = {(r.path, r.ord) for r in I.outermost(of("norm").select("path", "ord", "start_idx", "end_idx", "body_idx")).collect()}
    assert top == {(r.path, r.ord) for r in of("norm").where("depth = 0").collect()} and top
    covered = {(r.path, r.row) for r in I.rows_covered(of("comment")).collect()}
    assert len(covered) == of("comment").agg({"rows": "sum"}).first()[0]
    text = {r.path: r.content for r in files.collect()}
    bare = sum(text[p].split("\n")[r].strip().startswith(("//", "/*", "*", "#")) for p, r in covered)
    assert bare == of("comment").agg({"bare_rows": "sum"}).first()[0]
    facts.unpersist()


def test_registered_languages_reach_the_workers(spark):
    from glyphmill import languages as L

    zig = L.Language("zig", ("zig",), 300, 12, 9, 0.3, 0.6, 18, 0.3, branches=frozenset({"if", "while"}), function=("fn",), block=False)
    L.register(zig)
    try:
        r = api.metrics_of_files(from_rows(spark, [("a.zig", "fn f(a: u8) void {\n  // note\n  if (a > 1) {\n    g();\n  }\n}"), ("b.go", GO)])).rows.where("language = 'zig'").first()
        assert (r.nloc, r.complexity, r.lines_with_comments) == (5, 1, 1)
    finally:
        del L.REGISTRY["zig"]


def test_unfinished_sources_do_not_break():
    for language in ("solidity", "go", "rust", "javascript", "cpp", "java", "masm", "move"):
        for text in ("{{{", "if (", "function f(", "fn f(", "func (", "/* open", '"open', "a ? b", "do", "else", "=>", "impl", "contract A is", "case x:", ")", "try {"):
            list(scan("f", language, text))


def test_peek(spark):
    files = from_rows(spark, [("a.sol", SPLIT), ("b.go", "package p\nfunc (s *Srv) Go(x int) int { return x }\n"), ("c.rs", "struct A;")])
    got = {r.path: r.signatures for r in api.peek_files(files).collect()}
    assert got == {"a.sol": ["function long(uint256 one, address two) public returns (uint256)"], "b.go": ["func (s *Srv) Go(x int) int"]}


def test_later_collections_have_their_say(spark):
    a, b = (from_rows(spark, [(p, f"package p\nfunc {n}() {{}}\n") for p in paths]) for n, paths in (("A", ("x.go", "y.go")), ("B", ("y.go", "z.go"))))
    assert {r.path: r.signatures for r in api.peek_files(a, b).collect()} == {"x.go": ["func A()"], "y.go": ["func B()"], "z.go": ["func B()"]}


def test_depth_at_equals_counting(spark):
    rng = random.Random(5)
    points = [(f"p{rng.randrange(5)}", k, rng.randrange(40)) for k in range(300)] + [("p9", 1, 3), ("p1", 7, 5), ("p1", 7, 5)]
    spans = [(f"p{rng.randrange(5)}", a, a + rng.randrange(-1, 15)) for a in (rng.randrange(40) for _ in range(120))]
    got = I.depth_at(spark.createDataFrame(points, "path string, ord long, row long"), spark.createDataFrame(spans, "path string, start_row long, end_row long"))
    want = sorted((p, k, r, sum(q == p and a <= r <= b for q, a, b in spans)) for p, k, r in points)
    assert sorted(map(tuple, got.collect())) == want


def test_touched_equals_looking_at_each_point(spark):
    rng = random.Random(6)
    ranges = [(f"p{rng.randrange(4)}", k, a, a + rng.randrange(-1, 6)) for k, a in enumerate(rng.randrange(60) for _ in range(200))]
    points = [(f"p{rng.randrange(5)}", rng.randrange(60)) for _ in range(40)]
    got = I.touched(spark.createDataFrame(ranges, "path string, ord long, start_line long, end_line long"), spark.createDataFrame(points, "path string, line long"))
    assert sorted(map(tuple, got.collect())) == sorted(r for r in ranges if any(p == r[0] and r[2] <= x <= r[3] for p, x in points))


def test_depths_equal_counting():
    from glyphmill.sources.scanner import _depths, _inner

    rng = random.Random(12)
    for k in range(300):
        spans = []
        for _ in range(rng.randrange(1, 25)):
            a = rng.randrange(30)
            spans.append((a, a + rng.randrange(1, 12)))
        spans = sorted(spans, key=lambda x: (x[0], -x[1]))
        if k % 2:  # nested or apart
            kept = []
            for x in spans:
                if all(y[1] <= x[0] or y[1] >= x[1] for y in kept):
                    kept.append(x)
            spans = kept
        around = lambda x: [y for y in spans if y[0] <= x[0] and y[1] >= x[1] and y != x]
        assert _depths(spans) == [len(around(x)) for x in spans]
        bodies = {x: rng.choice([None, rng.randrange(x[0], x[1])]) for x in spans}
        assert _inner([(*x, bodies[x]) for x in spans]) == [any(bodies[y] is None or x[0] < bodies[y] for y in around(x)) for x in spans]


def test_long_chains_take_linear_time():
    """Else chains of 5,000 branches and 20,000 calls in one expression, which are all nested in each other."""
    import time

    began = time.time()
    facts = list(scan("f", "go", "package p\nfunc f() {\n" + " else ".join(f"if a == {k} {{ g() }}" for k in range(5000)) + "\n}\n"))
    assert max(r["depth"] for r in facts if r["fact"] == "branch") == 4999
    facts = list(scan("f", "javascript", "x" + ".y(1)" * 20_000))
    assert sum(r["fact"] == "norm" and not r["depth"] for r in facts) == 1
    assert time.time() - began < 30
