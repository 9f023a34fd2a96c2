"""Metrics of files as they arrive. The plan per file has no state, so each batch is a query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..caching import scope
from ..languages import route
from ..plans.api import metrics_of_files


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, language) of files that come into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return route(raw.select("path", F.col("content").cast("string").alias("content")))


def write_metrics(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes metrics of each batch as Parquet; a batch that is repeated after a failure replaces its own rows."""

    def one(batch: DataFrame, number: int) -> None:
        with scope():  # what the batch keeps doesn't outlast it
            metrics_of_files(batch).rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
