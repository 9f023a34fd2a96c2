"""What tools keep while their results are used, and how it is let go."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_KEPT: ContextVar[list[DataFrame]] = ContextVar("kept", default=[])  # noqa: B039


def keep(df: DataFrame) -> DataFrame:
    """``df`` persisted, until ``release`` or the end of the ``scope`` that it was kept in."""
    _KEPT.get().append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release() -> None:
    """Lets go of all that was kept in this scope; results that are still used are computed anew."""
    kept = _KEPT.get()
    while kept:
        kept.pop().unpersist()


@contextmanager
def scope() -> Iterator[None]:
    """What is kept within is released at its end: results are written or collected inside."""
    token = _KEPT.set([])
    try:
        yield
    finally:
        release()
        _KEPT.reset(token)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (dots as ``__``) for what runs within; then they are as before."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def on_one_machine(spark: SparkSession) -> bool:
    """Whether the session is local, its executors being the driver; those of a local-cluster count as a cluster's."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str | None:
    """The folder that all executors see: spark.checkpoint.dir, or where checkpoints go; None if there is neither."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed now and cut off from its plan, which what builds on it need not analyse again: a checkpoint in the folder of spark.checkpoint.dir, which outlasts executors.

    A local session without that setting gets a folder of its own, deleted at the end; a cluster without it has ``df`` persisted.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and on_one_machine(spark):
            folder = tempfile.mkdtemp(prefix="glyphmill-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        if not folder:
            keep(df).count()
            return df
        sc.setCheckpointDir(folder)
    return df.checkpoint()
