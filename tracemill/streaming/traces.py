"""The same rules over streams: columns are stateless, caches are appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cascade import classify
from ..sources.readers import TRACES


def read(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(TRACES).option("maxFilesPerTrigger", files_per_batch).json(folder)


def classified(stream: DataFrame, query: str = "query", trace: str = "reasoning_trace") -> DataFrame:
    return classify(stream, query, trace).select("id", "label", "detailed_label")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends results as JSON lines, each batch once, and stops when all that is there is read."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
