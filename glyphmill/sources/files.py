"""Source files as rows (path, content, language, file_ord)."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..caching import keep
from ..languages import REGISTRY, route

#: Files of a task at least; files of a batch, and characters of their texts, at which it is sent on.
_TASK_FILES, _BATCH_FILES, _BATCH_TEXT = 64, 2_000, 4 << 20


def resolve(patterns: str | Iterable[str], root: str = ".") -> list[str]:
    """Paths of the files that match, absolute and sorted, each once; files and folders with a leading dot only where the pattern has it. ``!`` before a pattern takes its matches away."""
    found: set[str] = set()
    for pattern in [patterns] if isinstance(patterns, str) else patterns:
        away = pattern.startswith("!")
        at = os.path.join(os.path.abspath(root), pattern.lstrip("!"))
        names: set[str] = set()
        for one in _braces(at):
            names |= {os.path.normpath(p) for p in glob.glob(one, recursive=True) if os.path.isfile(p)}
        found = found - names if away else found | names
    return sorted(found)


def _braces(pattern: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [x for part in m[1].split(",") for x in _braces(pattern[: m.start()] + part + pattern[m.end() :])]


def known(path: str) -> bool:
    return os.path.splitext(path)[1].lower().lstrip(".") in {e for x in REGISTRY.values() for e in x.extensions}


def ordered(files: DataFrame) -> DataFrame:
    """``files``, which have (path, language), with ``file_ord``: language after language by their first path, then by path.

    It is a key to sort by, not a rank, so nothing is brought into one partition; what is broadcast has a row for each language.
    """
    first = files.groupBy("language").agg(F.min("path").alias("first"))
    placed = files.join(F.broadcast(first), "language").withColumn("file_ord", F.struct("first", "path"))
    return placed.select(*files.columns, "file_ord")


def read(spark: SparkSession, patterns: str | Iterable[str], root: str = ".") -> DataFrame:
    """The files of known languages that match, as ``resolve`` says; others aren't read. Files that vanish or can't be read are skipped, bytes that aren't UTF-8 replaced.

    Tasks list the matches and read them, so executors must see ``root``; the driver gets neither names nor contents.
    """
    at = os.path.abspath(root)
    found = keep(route(_matches(spark, [patterns] if isinstance(patterns, str) else list(patterns), at)))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(spark.sparkContext.defaultParallelism, min(most, found.count() // _TASK_FILES))
    columns = "path string, language string, file_ord struct<first:string,path:string>"
    fields = T.StructType.fromDDL(columns).names

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            places, texts, size = [], [], 0
            for k, name in enumerate(given.column(0)):
                try:
                    with open(os.path.join(at, name.as_py()), "rb") as source:
                        texts.append(source.read().decode("utf-8", "replace"))
                except OSError:
                    continue
                places.append(k)
                size += len(texts[-1])
                if size >= _BATCH_TEXT or len(places) >= _BATCH_FILES:
                    yield with_texts(given, places, texts)
                    places, texts, size = [], [], 0
            if places:
                yield with_texts(given, places, texts)

    def with_texts(given: pa.RecordBatch, places: list[int], texts: list[str]) -> pa.RecordBatch:
        kept = given.take(pa.array(places, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], [*fields, "content"])

    named = ordered(found).select(*fields).repartition(tasks, "path")
    return named.mapInArrow(contents, f"{columns}, content string").select("path", "content", "language", "file_ord")


def _matches(spark: SparkSession, patterns: list[str], at: str) -> DataFrame:
    """(path) of the files under known extensions that match, relative to the folder ``at`` if they are in it. The last pattern that a file matches decides whether it counts."""
    ends = tuple({"." + e for x in REGISTRY.values() for e in x.extensions})
    base = at.rstrip("/") + "/"
    asked = [(k, p.startswith("!"), os.path.join(at, p.lstrip("!"))) for k, p in enumerate(patterns)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for k, away, pattern in zip(*(c.to_pylist() for c in given.columns)):
                names = (os.path.normpath(p) for one in _braces(pattern) for p in glob.iglob(one, recursive=True) if p.lower().endswith(ends) and os.path.isfile(p))
                while some := list(islice(names, _BATCH_FILES)):
                    paths = [os.fsencode(p.removeprefix(base)).decode("utf-8", "replace") for p in some]
                    yield pa.RecordBatch.from_pydict({"path": paths, "k": pa.array([k] * len(some), pa.int32()), "away": [away] * len(some)})

    found = spark.createDataFrame(asked, "k int, away boolean, pattern string").mapInArrow(listed, "path string, k int, away boolean")
    return found.groupBy("path").agg(F.max_by("away", "k").alias("away")).where("not away").select("path")


def read_tree(spark: SparkSession, folder: str, name: str = "*") -> DataFrame:
    """All files under a folder of any file system whose names match, listed by Spark in parallel; for corpora that are too many to list on the driver."""
    suffixes = sorted({e for x in REGISTRY.values() for e in x.extensions})
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{name}.{{{','.join(suffixes)}}}")
    return ordered(route(reader.load(folder).select("path", F.col("content").cast("string").alias("content"))))


def from_rows(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    """Files from (path, content) in the order given, language after language as each first comes up."""
    data = [(p, c, k) for k, (p, c) in enumerate(rows)]
    files = route(spark.createDataFrame(data, "path string, content string, given long"))
    first = files.groupBy("language").agg(F.min("given").alias("first"))
    placed = files.join(F.broadcast(first), "language").withColumn("file_ord", F.struct("first", "given"))
    return placed.select("path", "content", "language", "file_ord")


def write(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """The result of a tool under ``path``: one file for each partition, as parquet or json; ``mode`` as of Spark's writers."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"kind is parquet or json, not {kind}")
    rows.write.mode(mode).format(kind).save(path)
