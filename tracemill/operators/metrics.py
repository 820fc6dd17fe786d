"""Metrics of predictions as grouped aggregates: no table of predictions leaves the executors, only sums do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    return df.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def by_class(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """tp, fp, fn, support, precision, recall and f1 of each label that occurs on either side."""
    cells = confusion(df, truth, predicted)
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(True).alias("of_y")), F.struct(F.col("p").alias("label"), F.lit(False).alias("of_y")))).alias("s"), "y", "p", "n")
    hit, of_y = F.col("y") == F.col("p"), F.col("s.of_y")
    sums = sides.groupBy("s.label").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("tp", hit & of_y), ("fp", ~hit & ~of_y), ("fn", ~hit & of_y), ("support", of_y))])
    return with_scores(sums)


def with_scores(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """precision, recall and f1 from counts, 0 where a denominator is 0."""
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return df.withColumn("precision", safe(t, t + p)).withColumn("recall", safe(t, t + n)).withColumn("f1", safe(2 * t, 2 * t + p + n))


def summary(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """One row: n, accuracy, f1_macro, f1_weighted, kappa. Of one row per label, whatever the input."""
    labels = by_class(df, truth, predicted).withColumn("marked", F.col("tp") + F.col("fp"))
    sums = labels.agg(F.sum("support").alias("n"), F.sum("tp").alias("hits"), F.avg("f1").alias("f1_macro"), F.sum(F.col("support") * F.col("f1")).alias("weighted"), F.sum(F.col("support").cast("double") * F.col("marked")).alias("chance"))
    n, pe = F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return sums.select("n", (F.col("hits") / n).alias("accuracy"), "f1_macro", (F.col("weighted") / n).alias("f1_weighted"), F.when(pe < 1, (F.col("hits") / n - pe) / (1 - pe)).otherwise(F.lit(float("nan"))).alias("kappa"))


def safety_report(traces: DataFrame, steps: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """Both levels of safety in one table (level, label, tp, fp, fn, support, precision, recall, f1): traces with three
    classes and steps with two (0 safe, 1 unsafe), and a row `all` with the mean F1 of each level's classes."""
    levels = [by_class(df.select(F.col(truth).cast("string").alias("y"), F.col(predicted).cast("string").alias("p"))).select(F.lit(name).alias("level"), "label", "tp", "fp", "fn", "support", "precision", "recall", "f1") for name, df in (("trace", traces), ("step", steps))]
    rows = levels[0].union(levels[1])
    sums = rows.groupBy("level").agg(F.lit("all").alias("label"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")], *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return rows.union(sums)


def binary_f1(df: DataFrame, y: Column, p: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per group): counts and F1 of both classes, their mean, accuracy. y and p are booleans."""
    of = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = (df.groupBy(*by) if by else df.groupBy()).agg(of(y & p).alias("tp"), of(~y & p).alias("fp"), of(y & ~p).alias("fn"), of(~y & ~p).alias("tn"))
    f1 = lambda a, b, c: F.when(2 * a + b + c > 0, 2 * a / (2 * a + b + c)).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sums = sums.withColumn("f1_true", f1(tp, fp, fn)).withColumn("f1_false", f1(tn, fn, fp))
    total = tp + fp + fn + tn
    return sums.withColumn("f1_macro", (F.col("f1_true") + F.col("f1_false")) / 2).withColumn("accuracy", F.when(total > 0, (tp + tn) / total).otherwise(0.0))


def histogram(df: DataFrame, *by: str) -> DataFrame:
    """Counts by group and their share in percent."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over one row per group
    return counts.select(*by, "n", (100.0 * F.col("n") / total).alias("percent"))


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    """Smallest, median (cut to a whole number) and largest."""
    return df.agg(F.min(length).alias("least"), F.median(length).cast("int").alias("middle"), F.max(length).alias("most"))


def step_label_counts(df: DataFrame, labels: str) -> DataFrame:
    one = df.select(F.explode(labels).alias("l"))
    return one.agg(F.coalesce(F.sum((F.col("l") == 0).cast("long")), F.lit(0)).alias("safe"), F.coalesce(F.sum((F.col("l") == 1).cast("long")), F.lit(0)).alias("unsafe"))


def buckets(df: DataFrame, length: Column, edges: tuple[int, ...], *by: str) -> DataFrame:
    """Counts by bucket of length (its lower edge) and other columns."""
    low = F.lit(0)
    for e in sorted(edges):
        low = F.when(length >= e, e).otherwise(low)
    return df.select(low.alias("bucket"), *by).groupBy("bucket", *by).agg(F.count("*").alias("n"))
