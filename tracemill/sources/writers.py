"""Writers of submissions, caches and settings."""

from __future__ import annotations

import io
import json
import time
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def submission(df: DataFrame, path: str, detailed: bool = False) -> None:
    """CSV with ID, label and, if wanted, detailed_label."""
    df.select(F.col("id").alias("ID"), "label", *(["detailed_label"] if detailed else [])).write.mode("overwrite").option("header", True).csv(path)


def zipped(spark: SparkSession, folder: str, target: str, name: str = "submission.csv") -> None:
    """One archive of a submission's parts, which are streamed one after the other on the driver (an archive is one file)."""
    parts = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("f")).orderBy("f")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z, z.open(name, "w") as raw, io.TextIOWrapper(raw, "utf-8", newline="") as out:
        for i, row in enumerate(parts.toLocalIterator()):
            out.write(row["value"] if i == 0 else row["value"].partition("\n")[2])


def append_cache(df: DataFrame, path: str) -> None:
    """Adds lines to a cache. All of one append carry its time by the driver's clock, which orders them behind those of earlier
    appends; drivers whose clocks differ use caches.append(), which numbers appends."""
    df.withColumn("batch", F.lit(time.time_ns())).write.mode("append").json(path)


def by_group(df: DataFrame, path: str, *by: str) -> None:
    """Records of each group (such as a generator) in a folder of its own; no group is held in one place."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def cached_features(build: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """A feature table, computed if the path does not hold it yet."""
    from .readers import first_existing

    if first_existing(spark, [f"{path.rstrip('/')}/_SUCCESS"]) is None:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def settings(spark: SparkSession, path: str, **values) -> None:
    """A JSON object of a few settings."""
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def ranked_summary(df: DataFrame, path: str, by: str = "f1_macro") -> None:
    df.orderBy(F.desc(by)).coalesce(1).write.mode("overwrite").json(path)
