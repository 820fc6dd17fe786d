"""Readers of records, traces, labels and caches with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACES, strip
from ..operators.cascade import three_way, two_way
from ..operators.running import running
from ..operators.votes import latest, legacy_label
from .shared import new_folder


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


S = T.StringType()
SOLUTIONS = _schema(id=S, problem_id=S, solution_id=S, problem=S, solution=S, generator=S, detailed_generator=S)
TRACES = _schema(id=S, query=S, generator=S, reasoning_trace=S, label=S, detailed_label=T.ArrayType(T.IntegerType()))
#: Time of the append that wrote a line, in caches that writers.append_cache() writes.
BATCH = "batch"
VOTES = _schema(id=S, model_labels=T.MapType(S, S), batch=T.LongType())
LABELS = _schema(id=S, label=S, model_labels=T.MapType(S, S), batch=T.LongType())
REPLIES = _schema(idx=T.IntegerType(), trace_pred=T.IntegerType(), trace_label_str=S, response=S, step_labels=T.ArrayType(T.IntegerType()), batch=T.LongType())


#: The column of a line that is no JSON object, and what to do about such lines.
BROKEN = "broken_line"
FAIL, APART, SKIP = "fail", "apart", "skip"


def jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType, broken: str = FAIL) -> DataFrame:
    """JSON lines; blank ones are no records. Adds where a record stands: its file, and seq, the order in which lines were
    appended: by batch, or for files without any by the time of the file; then by file and place in it. The order in which
    Spark happens to read files (by their size) has no part in it.

    A line that is no JSON object of the schema stops the reading (fail), however few columns are read; apart keeps it as a
    row whose only field is broken_line, before any label is derived; skip leaves it out.
    """
    parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField(BROKEN, S)]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    lines = spark.read.text(paths).where(F.btrim("value", F.lit(SPACES)) != "")
    # a generator stands between, so that each line is parsed once and whatever is read of it
    rows = lines.select(F.col("_metadata").alias("at_"), F.inline(F.array(parsed)))
    batch = F.col(BATCH) if BATCH in schema.names else F.lit(None).cast("long")
    written = F.when(batch.isNull(), F.col("at_.file_modification_time"))
    order = F.struct(batch.alias("batch"), written.alias("written"), F.col("at_.file_name").alias("file"), F.col("at_.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    bad = F.col(BROKEN).isNotNull()
    if broken == FAIL:
        told = F.concat(F.lit("no JSON record in "), F.col("at_.file_path"), F.lit(": "), F.substring(BROKEN, 1, 200))
        rows = rows.where(F.when(bad, F.raise_error(told).cast("boolean")).otherwise(True))
    elif broken == SKIP:
        rows = rows.where(~bad)
    # a broken line may have left the fields before its break
    fields = [F.when(~bad, F.col(c)).alias(c) for c in schema.names if c != BATCH] if broken == APART else [F.col(c) for c in schema.names if c != BATCH]
    return rows.select(*fields, *([BROKEN] if broken == APART else []), F.col("at_.file_path").alias("file"), order.alias("seq"))


def quarantined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows that were read with broken lines apart: the records, and the broken lines with file and seq."""
    return rows.where(F.col(BROKEN).isNull()).drop(BROKEN), rows.where(F.col(BROKEN).isNotNull()).select(BROKEN, "file", "seq")


def positioned(rows: DataFrame, name: str = "position") -> DataFrame:
    """Records of jsonl() with their place from 0 in all files, which follow each other in the order of their names.

    Records are counted by block of a file; sums over the blocks before give each block its first place, and a record's
    place in its block the rest. The records are written once, so that both readings see the same blocks.
    """
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "positions")
    rows.withColumn("block_", F.col("seq.block")).withColumn("line_", F.col("seq.line")).write.parquet(path)
    kept = spark.read.parquet(path)
    blocks = kept.groupBy("file", "block_").agg(F.count("*").alias("records_"), F.min("line_").alias("first_"))
    before = running(blocks, ["file", "block_"], {"records_": "before_"})
    placed = kept.join(before.select(F.col("file").alias("file_"), F.col("block_").alias("start_"), "first_", "before_"), (F.col("file") == F.col("file_")) & (F.col("block_") == F.col("start_")))
    return placed.withColumn(name, F.col("before_") + F.col("line_") - F.col("first_")).drop("block_", "line_", "file_", "start_", "first_", "before_")


def solution_files(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Records of a split's files, train_*, valid_* or (for test) all, in the order of their names, with their position."""
    names = {"train": "train_*.jsonl", "validation": "valid_*.jsonl"}.get(split, "*.jsonl")
    return positioned(jsonl(spark, f"{folder}/{names}", SOLUTIONS))


def labelled_solutions(rows: DataFrame) -> DataFrame:
    """Solutions with id (or solution_id, or empty) and label 0 for people, 1 for models; broken lines get neither."""
    broken = F.col(BROKEN).isNotNull() if BROKEN in rows.columns else F.lit(False)
    named = rows.withColumn("id", F.when(~broken, F.coalesce("id", "solution_id", F.lit(""))))
    return named.withColumn("label", F.when(broken, F.lit(None).cast("int")).when(F.col("generator") == "human", 0).otherwise(1))


def solutions(spark: SparkSession, paths: str | list[str], labelled: bool = True) -> DataFrame:
    """Solutions with id (or solution_id, or empty) and label 0 for people, 1 for models."""
    rows = labelled_solutions(jsonl(spark, paths, SOLUTIONS))
    return rows if labelled else rows.drop("label")


def traces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Traces with label_int 0, 1 or 2; labels that are not known are 1."""
    return jsonl(spark, paths, TRACES).withColumn("label_int", three_way(F.coalesce("label", F.lit(""))))


def binary_traces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Traces with label safe or unsafe; labels that are not known are unsafe."""
    return jsonl(spark, paths, TRACES).withColumn("label", two_way(F.coalesce("label", F.lit(""))))


def traces_by_file(spark: SparkSession, folder: str, names: tuple[str, ...] = ("safe", "potentially", "unsafe")) -> DataFrame:
    """Traces whose label is the first of the names that their file's name holds as a word, or else its folder's (as Spark
    writes files into folders); only safe is safe."""
    rows = jsonl(spark, folder, TRACES)
    held = lambda place: F.regexp_extract(F.lower(F.regexp_extract("file", place, 1)), rf"(?:^|[_.\-])({'|'.join(names)})(?:[_.\-]|$)", 1)
    own, above = held("([^/]*)$"), held("([^/]*)/[^/]*$")
    return rows.withColumn("label", F.when(F.when(own != "", own).otherwise(above) == "safe", "safe").otherwise("unsafe"))


def vote_cache(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id and votes of a cache to which lines are appended; a record's last line stands."""
    rows = jsonl(spark, paths, VOTES).select("id", F.col("model_labels").alias("votes"), "seq")
    return latest(rows).select("id", "votes")


def legacy_cache(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id and label of caches that hold a label or several models' votes; records without a known label are left out."""
    rows = latest(jsonl(spark, paths, LABELS).select("id", "label", "model_labels", "seq"))
    return rows.select("id", legacy_label(F.col("label"), F.col("model_labels")).alias("label")).where("label is not null")


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    return rows.select(F.col("ID").alias("id"), strip(F.col("label")).alias("label"))


def api_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of model calls that were kept as a table."""
    return spark.read.parquet(path)


def replies(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return latest(jsonl(spark, paths, REPLIES).drop("file"), "idx")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, in any store that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None
