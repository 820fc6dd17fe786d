"""A cache of votes as a table in hash buckets: appends, reading, and compaction.

An append adds a file to the buckets that it touches, under the number that follows the last append's. Reading folds a
record's lines into one: for each model the label of the last append that has one. Compaction folds the buckets in which a
record has several lines and overwrites those partitions alone; a line keeps the number of its last append, so what is appended later
still stands. A record's lines are always in one bucket, so folding never moves more than a bucket's rows to a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import first_existing
from .shared import remove

SCHEMA = "id string, model_labels map<string,string>, batch long, bucket int"


def exists(spark: SparkSession, path: str) -> bool:
    return first_existing(spark, [f"{path.rstrip('/')}/_SUCCESS"]) is not None


def lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the cache; none before the first append."""
    return spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def last_batch(spark: SparkSession, path: str) -> int:
    return lines(spark, path).agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def append(df: DataFrame, path: str, buckets: int = 64, batch: int | None = None) -> int:
    """Adds lines (id, model_labels) and gives their append's number. A record that df holds twice is for the caller to fold."""
    number = last_batch(df.sparkSession, path) + 1 if batch is None else batch
    rows = bucketed(df.select("id", "model_labels").withColumn("batch", F.lit(number).cast("long")), buckets)
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return number


def folded(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each record: of every model the last label. Labels are folded as (model, batch), never a record's whole history at once."""
    each = rows.select(*keys, "id", "batch", F.explode_outer("model_labels").alias("model", "label"))
    last = each.groupBy(*keys, "id", "model").agg(F.max_by("label", F.struct("batch", "label")).alias("label"), F.max("batch").alias("batch"))
    entries = F.filter(F.collect_list(F.struct("model", "label")), lambda e: e["model"].isNotNull())  # an entry a model
    return last.groupBy(*keys, "id").agg(F.map_from_entries(F.array_sort(entries)).alias("model_labels"), F.max("batch").alias("batch"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """id and votes of each record."""
    return folded(lines(spark, path)).select("id", F.col("model_labels").alias("votes"))


def compact(spark: SparkSession, path: str) -> list[int]:
    """Folds the buckets in which a record has several lines, and gives their numbers.

    The folded rows are written beside the cache, then those partitions are overwritten, then the rows beside it removed. If
    a run dies on the way, the next one first appends what it finds beside the cache: those rows carry the numbers of their
    appends, so they fill what was lost and change nothing else.
    """
    beside = f"{path.rstrip('/')}.compacting"
    kept = "bucket int, id string, model_labels map<string,string>, batch long"
    if exists(spark, beside):
        spark.read.schema(kept).parquet(beside).select("id", "model_labels", "batch", "bucket").write.mode("append").partitionBy("bucket").parquet(path)
        remove(spark, beside)
    rows = lines(spark, path)
    repeated = rows.groupBy("bucket", "id").agg(F.count("*").alias("n")).where("n > 1").select("bucket").distinct()
    due = sorted(r["bucket"] for r in repeated.collect())  # a row a bucket
    if due:
        folded(rows.where(F.col("bucket").isin(due)), "bucket").write.mode("overwrite").parquet(beside)
        fresh = spark.read.schema(kept).parquet(beside)
        fresh.select("id", "model_labels", "batch", "bucket").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        remove(spark, beside)
    return due
