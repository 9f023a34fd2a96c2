"""Source text made from the columns of tables, so that what a scan must find is known from the same columns."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import subprocess
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..caching import on_one_machine, shared_dir
from ..languages import route
from ..sources.scanner import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Template:
    """Lines of a file in one language; ``f`` stands for the function's beginning, which the key follows."""

    language: str
    extension: str
    head: str
    f: str
    param: str
    tail: str
    branch: str = "if (a > 1) {"
    foot: str = "}"
    comment: str = "// note"
    call: str = "g(a);"
    end: str = "}"
    comma: str = ""


TEMPLATES = (
    Template("solidity", "sol", "contract C {", "function f", "uint p", ") public {"),
    Template("go", "go", "package p", "func f", "p int", ") {", "if a > 1 {", "var z = 1", comma=","),
    Template("rust", "rs", "mod c {", "pub fn f", "p: u32", ") {", "if a > 1 {"),
    Template("cpp", "cpp", "namespace c {", "int f", "int p", ") {"),
    Template("java", "java", "class C {", "public int f", "int p", ") {"),
    Template("cairo", "cairo", "mod c {", "fn f", "p: u8", ") {", "if a > 1 {"),
    Template("compact", "compact", "module c {", "export circuit f", "p: Field", "): [] {"),
    Template("move", "move", "module a::c {", "public fun f", "p: u64", ") {"),
    Template("noir", "nr", "mod c {", "pub fn f", "p: Field", ") {", "if a > 1 {"),
    Template("tolk", "tolk", 'import "x"', "fun f", "p: int", ") {", foot="const z = 1"),
    Template("masm", "masm", "use.std::x", "export.f", "", "", "if.true", "const.Z=1", "# note", "push.1", "end"),
    Template("javascript", "js", "class C {", "f", "p", ") {"),
    Template("typescript", "ts", "class C {", "f", "p: number", "): void {"),
    Template("tsx", "tsx", "class C {", "private f", "p: number", ") {"),
    Template("flow", "flow", "class C {", "static f", "p", ") {"),
)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, language, file_ord): a file for each part, in turn in all languages.

    With d = p_size % 5, c = p_size % 4, b = p_size % 3 and m = p_partkey % 4 it has c comments, a signature of m parameters on
    lines of their own (none: one line), d nested branches around a call, and b blank lines at its end. Procedures of masm have no
    parameters.
    """
    part = table(spark, sf_dir, "part")
    d, c, b = F.expr("p_size % 5"), F.expr("p_size % 4"), F.expr("p_size % 3")
    which = F.expr(f"int(p_partkey % {len(TEMPLATES)})")

    def choose(of: Callable[[Template], str]) -> Column:
        return F.element_at(F.array(*(F.lit(of(t)) for t in TEMPLATES)), which + 1)

    bare = choose(lambda t: "" if t.param else "x") == "x"
    m = F.when(bare, 0).otherwise(F.expr("int(p_partkey % 4)"))
    key = F.col("p_partkey").cast("string")
    param = choose(lambda t: t.param)
    listed = F.concat(F.lit("\n"), F.array_join(F.array_repeat(F.concat(F.lit("        "), param), m), ",\n"), choose(lambda t: t.comma + "\n    "))
    signature = F.concat(
        choose(lambda t: "    " + t.f), key, choose(lambda t: "(" if t.param else ""),
        F.when(bare, "").when(m == 0, param).otherwise(listed), choose(lambda t: t.tail + "\n"),
    )
    content = F.concat(
        choose(lambda t: t.head + "\n"),
        F.repeat(choose(lambda t: f"    {t.comment}\n"), c),
        signature,
        F.repeat(choose(lambda t: f"        {t.branch}\n"), d),
        choose(lambda t: f"        {t.call}\n"),
        F.repeat(choose(lambda t: f"        {t.end}\n"), d),
        choose(lambda t: f"    {t.end}\n"),
        choose(lambda t: t.foot),
        F.repeat(F.lit("\n"), b),
    )
    path = F.concat(F.lit("src/f"), key, choose(lambda t: "." + t.extension))
    return route(part.select(path.alias("path"), content.alias("content"), F.col("p_partkey").alias("file_ord")))


def _filled(text: str) -> Column:
    """``text`` with {n} and {up} filled with a nation's key and half of it."""
    parts = re.split(r"(\{n\}|\{up\})", text)
    keys = {"{n}": F.col("n_nationkey").cast("string"), "{up}": F.expr("cast(n_nationkey div 2 as string)")}
    return F.concat(*[keys[p] if p in keys else F.lit(p) for p in parts if p])


def nation_files(spark: SparkSession, sf_dir: str, extension: str, text: str | Column, offset: int = 0) -> DataFrame:
    """A file for each nation; ``file_ord`` is three times its key, plus an offset."""
    path = F.concat(F.lit("src/n"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.lit("." + extension))
    content = _filled(text) if isinstance(text, str) else text
    rows = table(spark, sf_dir, "nation").select(path.alias("path"), content.alias("content"), (F.col("n_nationkey").cast("long") * 3 + offset).alias("file_ord"))
    return route(rows)


def inheriting_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract for each nation n, which inherits from that of n div 2 and calls its function."""
    head = F.when(F.col("n_nationkey") > 0, _filled("contract N{n} is N{up} {\n")).otherwise(F.lit("contract N0 {\n"))
    rest = _filled("  function own{n}() public {\n    base{up}();\n    require(true);\n  }\n  function base{n}() internal {}\n}\n")
    return nation_files(spark, sf_dir, "sol", F.concat(head, rest))


SOLIDITY = """library L{n} { function lib{n}(uint a, uint b) internal pure returns (uint) { return a; } function ext{n}(uint a) public {} }
contract B{n} { function up{n}(function(uint) external cb, uint[] memory x) public virtual {} }
contract C{n} is B{n} {
  using L{n} for uint;
  function up{n}(function(uint) external cb, uint[] memory x) public override { super.up{n}(cb, x); }
  function all{n}(uint x) external {
    L{n}.lib{n}(x, 1); x.ext{n}(); this.up{n}(cb, y); require(x > 0);
    assembly { let y := yul{n}(1) }
  }
  function yul{n}() private {}
  receive() external payable { yul{n}(); }
}
"""
GO = """package p
type T{n} struct{}
func (t *T{n}) Run{n}(a int) { helper{n}(a); t.stop{n}(); fmt.Println(len(x)) }
func (t T{n}) stop{n}() { go func() { shared{up}() }() }
func helper{n}(a int) { defer x.Run{up}() }
func shared{n}() { helper{n}(append(a, b)); shared{n}() }
"""
RUST = """mod m{n} { pub fn inner{n}() { outer{n}(); } }
struct S{n};
impl S{n} {
  pub fn new{n}() -> Self { S{up}::make{up}() }
  fn make{n}(&self) { self.own{n}(); println!("{}", new{n}()); }
  pub(crate) fn own{n}(&self) { outer{n}::<u8>(); }
}
pub async fn outer{n}() { let c = |x| make{up}(x); }
"""


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three languages for each nation, Rust first."""
    parts = [nation_files(spark, sf_dir, e, t, k) for k, (e, t) in enumerate((("rs", RUST), ("go", GO), ("sol", SOLIDITY)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def work_dir(spark: SparkSession) -> str:
    """A new folder for files that tools read by path, where globs, git and executors find them: on this machine if the session is local, else in the folder of spark.checkpoint.dir, which must then be mounted on all machines."""
    parent = None
    if not on_one_machine(spark):
        at = urlsplit(shared_dir(spark) or "none:")
        if at.scheme not in ("", "file"):
            raise ValueError(f"spark.checkpoint.dir is no folder of the file system, and {spark.sparkContext.master} needs one that all executors share")
        parent = unquote(at.path)
        os.makedirs(parent, exist_ok=True)
    folder = tempfile.mkdtemp(prefix="glyphmill-tree-", dir=parent)
    os.chmod(folder, 0o755)  # executors may have another user
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def out_dir(spark: SparkSession) -> str:
    """A path that nothing else uses, on whatever file system executors share, for results that are written."""
    found = None if on_one_machine(spark) else shared_dir(spark)
    return f"{found.rstrip('/')}/out-{uuid.uuid4().hex}" if found else f"{work_dir(spark)}/out"


def lay_out(root: str, files: Iterable[tuple[str, str | None]]) -> None:
    """Writes files under a folder; those without content are deleted."""
    made: set[str] = set()
    for path, content in files:
        at = os.path.join(root, path)
        if content is None:
            os.unlink(at)
            continue
        if (folder := os.path.dirname(at)) not in made:
            os.makedirs(folder, exist_ok=True)
            made.add(folder)
        with open(at, "w", encoding="utf-8", newline="") as out:
            out.write(content)


def lay_out_rows(root: str, files: DataFrame) -> int:
    """Writes ``files`` (path, content) under a folder that executors see, and counts them; tasks write, so there may be many."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            lay_out(root, ((p.as_py(), c.as_py()) for p, c in zip(*given.columns)))
            yield pa.RecordBatch.from_pydict({"n": [given.num_rows]})

    return spread(files.select("path", "content")).mapInArrow(written, "n long").agg(F.sum("n")).first()[0] or 0


def repository(spark: SparkSession, sf_dir: str) -> str:
    """A git repository of files of nations n, with revisions main~1 and main between which those with n % 4 = 1 are modified, 2 deleted and 3 added; those with n % 8 = 0 get a comment, others stay."""
    root = work_dir(spark)

    def git(*args: str) -> None:
        subprocess.run(["git", "-c", "user.name=none", "-c", "user.email=none@localhost", *args], cwd=root, check=True, capture_output=True)

    kept = "contract N{n} {{\n  function a{n}() public {{\n    x = 1;\n  }}\n  function old{n}() public {{}}\n}}\n"
    after = "contract N{n} {{\n  function a{n}() public {{\n    if (y) {{\n      x = 2;\n    }}\n  }}\n  function new{n}() public {{}}\n}}\n"
    gone, fresh = "package p\n\nfunc Gone{n}(a int) {{\n\tprintln(a)\n}}\n", "pub fn fresh{n}(b: u8) -> u8 {{\n    // note\n    b + 1\n}}\n"
    keys = sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())  # 25 nations
    git("init", "-q", "-b", "main")
    lay_out(root, [(f"n{n:02d}.sol", kept.format(n=n)) for n in keys if n % 4 < 2] + [(f"n{n:02d}.go", gone.format(n=n)) for n in keys if n % 4 == 2])
    git("add", "-A")
    git("commit", "-qm", "before")
    lay_out(root, [(f"n{n:02d}.sol", after.format(n=n)) for n in keys if n % 4 == 1] + [(f"n{n:02d}.go", None) for n in keys if n % 4 == 2])
    lay_out(root, [(f"n{n:02d}.sol", kept.format(n=n) + "// end\n") for n in keys if n % 8 == 0])
    lay_out(root, [(f"n{n:02d}.rs", fresh.format(n=n)) for n in keys if n % 4 == 3])
    git("add", "-A")
    git("commit", "-qm", "after")
    return root
