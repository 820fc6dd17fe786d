"""Running sums over an order of all rows, without a task that sees all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder


def running(df: DataFrame, by: Sequence[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """df with, for each column of `sums`, the sum of all rows before a row in the order of `by`, under its new name.

    Rows are sorted into ranges and written with their range's number; a range's rows add up on their own, and the ranges'
    totals, a row each, are added up before. Rows that are equal in `by` share a range and have no order among them: group
    them first.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, "running")
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in by]
    df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    own = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("range_").agg(*[F.sum(c).alias(f"{c}_all") for c in sums])
    ranges = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range_", *[F.coalesce(F.sum(f"{c}_all").over(ranges), F.lit(0)).alias(f"{c}_off") for c in sums])
    out = rows.join(F.broadcast(offsets), "range_")  # a row for each range of the sort
    for c, name in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"{c}_off"))
    return out.drop("range_", *[f"{c}_off" for c in sums])
