"""What the operators of this subpackage have in common."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session.

    Only a local session that has none (tests, a single machine) gets one; on a cluster a folder of the driver's machine is
    no help, so that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir isn't set, and {sc.master} needs a folder that all executors share")
        found = tempfile.mkdtemp(prefix="glyphmill-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by their exact names under others; columns that differ in case only, or come twice, don't clash."""
    names = df.columns
    packed = df.toDF(*[f"c{i}" for i in range(len(names))])
    return packed.select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in wanted.items()])


def id_and_text(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text); bytes that aren't UTF-8 are replaced."""
    rows = pick(df, doc_id=doc_id, text=text)
    return rows.select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def byte_size(df: DataFrame) -> int:
    """Bytes of the values of ``df``, with 8 for whatever has a fixed width, and for each element of a list."""

    def width(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(name) + 8
        elif isinstance(kind, T.ArrayType):
            size = F.size(name) * 8 + 8
        else:
            size = F.lit(8)
        return F.coalesce(size, F.lit(8))

    total = sum((width(f.name, f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")
    return df.agg(F.sum(total)).first()[0] or 0


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df``, which is checkpointed, marked for broadcast if its values have no more than ``most`` bytes; else the join shuffles."""
    return F.broadcast(df) if byte_size(df) <= most else df


def slices(batches: Iterator[pa.RecordBatch], column: int, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text in each is about ``budget`` bytes; a longer text gets a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.nbytes <= budget:
            yield batch
            continue
        start = size = 0
        for i, one in enumerate(batch.column(column)):
            length = len(one.as_buffer()) if one.is_valid else 0
            if size and size + length > budget:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += length
        yield batch.slice(start)
    # Workers live on after their task; what Arrow keeps for reuse would add to what the next one needs.
    pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> list[str | None]:
    """Strings of a column; bytes that aren't UTF-8 are replaced."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [v.as_buffer().to_pybytes().decode("utf-8", "replace") if v.is_valid else None for v in column]
