"""Labelling a stream of records into a cache, so that a run that was stopped goes on where it was.

Each batch leaves out what the cache holds of earlier batches, labels the rest and writes it to the folder of its number,
overwriting what an attempt that died may have left there. So every record is labelled once, and any number of stops and
reruns gives the cache of a run without any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import first_existing


def known(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Identifiers in the cache, of batches before a number if one is given."""
    if first_existing(spark, [path]) is None:
        return spark.createDataFrame([], "id string")
    rows = spark.read.schema("id string, batch long").parquet(path)
    return (rows if before is None else rows.where(F.col("batch") < before)).select("id")


def resumed(stream: DataFrame, path: str, checkpoint: str, label: Callable[[DataFrame], DataFrame], done: Callable[[int], None] = lambda number: None) -> StreamingQuery:
    """Starts labelling what there is of a stream with identifiers (id). label: from the records that are new, the rows to
    keep, id among them. done is told each batch's number once its rows are written."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = rows.dropDuplicates(["id"]).join(known(spark, path, number), "id", "left_anti")
        label(new).write.mode("overwrite").parquet(f"{path}/batch={number}")
        done(number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def labelled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache's rows with the number of their batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)
