"""The languages that are understood: extensions, constants of the effort model, and what the scanner must know of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    rate: float
    mid: float
    steep: float
    benefit_cap: float
    penalty_cap: float
    full_density: float
    doc_cap: float
    #: Beginnings of line comments, and whether there are block comments and whether these nest.
    line: tuple[str, ...] = ("//",)
    block: bool = True
    nested: bool = False
    #: Words that begin a branch; conditions stand in parentheses or go up to the block.
    branches: frozenset[str] = frozenset()
    paren: bool = True
    ternary: bool = False
    #: The word before the name of a function, if the language has one, and constructs that count as one line.
    function: tuple[str, ...] = ()
    literals: str = ""
    functionlike: bool = True


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_JS = {
    "rate": 450, "mid": 12, "steep": 9, "benefit_cap": 0.25, "penalty_cap": 0.55, "full_density": 15, "doc_cap": 0.25,
    "branches": _words("if for while do switch try"), "ternary": True, "function": ("function",), "literals": "[{",
}

LANGUAGES = (
    Language("solidity", ("sol",), 250, 11, 8, 0.25, 0.75, 20, 0.35, branches=_words("if for while do catch"), function=("function", "fallback", "receive")),
    Language("cpp", ("cpp", "hpp", "cc", "cxx", "c", "h"), 400, 15, 9, 0.30, 0.60, 18, 0.30, branches=_words("if for while do switch catch"), literals="{"),
    Language("java", ("java",), 400, 13, 9, 0.25, 0.55, 25, 0.25, branches=_words("if for while do switch catch"), ternary=True, literals="{"),
    Language("go", ("go",), 400, 12, 9, 0.25, 0.50, 15, 0.25, branches=_words("if for switch select"), paren=False, function=("func",), literals="{"),
    Language("rust", ("rs",), 400, 16, 10, 0.30, 0.70, 18, 0.35, nested=True, branches=_words("if for while loop match"), paren=False, function=("fn",), literals="["),
    Language("cairo", ("cairo",), 350, 12, 8, 0.30, 0.60, 20, 0.30, block=False, branches=_words("if loop while for match"), paren=False, function=("fn",)),
    Language("compact", ("compact",), 300, 10, 7, 0.30, 0.60, 20, 0.30, branches=_words("if for"), ternary=True, function=("circuit",), functionlike=False),
    Language("move", ("move",), 350, 12, 8, 0.30, 0.60, 20, 0.30, nested=True, branches=_words("if while loop for match abort"), function=("fun",)),
    Language("noir", ("nr",), 300, 10, 7, 0.30, 0.60, 20, 0.30, nested=True, branches=_words("if for comptime"), paren=False, function=("fn",)),
    Language("tolk", ("tolk",), 300, 15, 9, 0.30, 0.60, 18, 0.30, branches=_words("if while do repeat match try"), function=("fun", "get")),
    Language("masm", ("masm",), 350, 10, 7, 0.30, 0.60, 20, 0.30, line=("#",), block=False, branches=_words("if while repeat"), functionlike=False),
    Language("javascript", ("js", "jsx", "mjs", "cjs"), **_JS),
    Language("typescript", ("ts",), **_JS),
    Language("tsx", ("tsx",), **_JS),
    Language("flow", ("flow",), **_JS),
)
#: By name; a language that is registered under a known name takes its place.
REGISTRY: dict[str, Language] = {x.name: x for x in LANGUAGES}


def register(language: Language) -> None:
    REGISTRY[language.name] = language


DIMENSION = "language string, rate double, mid double, steep double, benefit_cap double, penalty_cap double, full_density double, doc_cap double"


def language_dim(spark: SparkSession) -> DataFrame:
    """A row of constants for each language; its size is that of the registry."""
    rows = [
        (x.name, *map(float, (x.rate, x.mid, x.steep, x.benefit_cap, x.penalty_cap, x.full_density, x.doc_cap)))
        for x in REGISTRY.values()
    ]
    return spark.createDataFrame(rows, DIMENSION)


def language_of(path: Column) -> Column:
    """The language of a path by its last extension in lower case, or null."""
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    pairs = [(e, x.name) for x in REGISTRY.values() for e in x.extensions]
    return F.create_map(*[F.lit(v) for p in pairs for v in p])[extension]


def route(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``language``; those of unknown languages are left out."""
    return files.withColumn("language", language_of(F.col(path))).where("language is not null")
