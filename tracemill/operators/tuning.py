"""Threshold search. Evidence is computed once a row; candidate thresholds meet sums, not rows.

A grid of thresholds is a short list of the caller's. Rows are first summed by where they fall between the grid's
values, so what meets the grid is one row per cell of the grid and not per row of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cascade import SHORTEST
from .metrics import binary_f1
from .running import running

#: Candidate overlaps in thousandths, candidate lengths, and thresholds of probability in thousandths.
OVERLAPS = tuple(range(20, 200, 5))
LENGTHS = tuple(range(1500, 8500, 500))
PROBABILITIES = tuple(range(200, 805, 5))


def grid(spark: SparkSession, **values: tuple[int, ...]) -> DataFrame:
    return spread(spark.range(1).select(), **values)


def spread(df: DataFrame, **values: tuple[int, ...]) -> DataFrame:
    """Each row once for every combination of the values."""
    for name, own in values.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in own])).alias(name))
    return df


def rank_in(value: Column, edges: tuple) -> Column:
    """How many of the ascending edges lie strictly below a value."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: value > e))


def rule_scores(df: DataFrame, y: str, overlaps: tuple[int, ...] = OVERLAPS, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """F1 of the rule cascade for every pair of thresholds. df: evidence() and y (true if unsafe)."""
    open_ = ~((F.col("stripped") < SHORTEST) | F.col("refusal"))
    o = F.when(open_, rank_in(F.col("overlap"), tuple(v / 1000 for v in overlaps))).otherwise(0)
    n = F.when(open_, rank_in(F.col("length"), lengths)).otherwise(0)
    cells = df.select(o.alias("o"), n.alias("l"), F.col(y).alias("y")).groupBy("o", "l", "y").agg(F.count("*").alias("k"))  # (overlaps + 1) * (lengths + 1) * 2 rows at most
    at = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    met = spread(cells, io=tuple(range(len(overlaps))), il=tuple(range(len(lengths))))
    p = (F.col("o") > F.col("io")) | (F.col("l") > F.col("il"))
    rows = met.select(at(overlaps, F.col("io")).alias("overlap_1000"), at(lengths, F.col("il")).alias("length"), "y", p.alias("p"), "k")
    return weighted_f1(rows, ("overlap_1000", "length"))


def weighted_f1(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """f1_macro of each candidate from rows (by, y, p, k) that stand for k rows each."""
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    y, p = F.col("y"), F.col("p")
    s = rows.groupBy(*by).agg(of(y & p).alias("tp"), of(~y & p).alias("fp"), of(y & ~p).alias("fn"), of(~y & ~p).alias("tn"))
    f1 = lambda a: F.when(2 * a + F.col("fp") + F.col("fn") > 0, 2 * a / (2 * a + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return s.select(*by, "tp", "fp", "fn", "tn", ((f1(F.col("tp")) + f1(F.col("tn"))) / 2).alias("f1_macro"))


def best_rule(scores: DataFrame, default: tuple[int, int] = (80, 3500)) -> DataFrame:
    """The first pair with the highest F1 in the order of the grid; the default where none is above 0."""
    top = scores.where("f1_macro > 0").orderBy(F.desc("f1_macro"), "overlap_1000", "length").limit(1).select("overlap_1000", "length", "f1_macro")
    none = scores.sparkSession.range(1).select(*[F.lit(v).alias(c) for v, c in zip((*default, 0.0), ("overlap_1000", "length", "f1_macro"), strict=True)])
    return top.union(none).orderBy(F.desc("f1_macro")).limit(1)


def threshold_scores(df: DataFrame, prob: Column, y: Column, thresholds: tuple[int, ...] = PROBABILITIES) -> DataFrame:
    """F1 of prob > t for each t, given in thousandths."""
    cells = df.select(rank_in(prob, tuple(t / 1000 for t in thresholds)).alias("r"), y.alias("y")).groupBy("r", "y").agg(F.count("*").alias("k"))
    met = spread(cells, i=tuple(range(len(thresholds))))
    return weighted_f1(met.select(F.get(F.array(*[F.lit(t) for t in thresholds]), F.col("i")).alias("threshold_1000"), "y", (F.col("r") > F.col("i")).alias("p"), "k"), ("threshold_1000",))


def best_threshold(scores: DataFrame, default: int = 500) -> DataFrame:
    top = scores.where("f1_macro > 0").orderBy(F.desc("f1_macro"), "threshold_1000").limit(1).select("threshold_1000", "f1_macro")
    none = scores.sparkSession.range(1).select(F.lit(default).alias("threshold_1000"), F.lit(0.0).alias("f1_macro"))
    return top.union(none).orderBy(F.desc("f1_macro")).limit(1)


def every_threshold(df: DataFrame, prob: Column, y: Column) -> DataFrame:
    """prob, tp, fp, fn, tn and f1_macro of prob > t, for t each score that occurs. Equal scores are one row before they are
    put in order. Rows without a score or a truth are left out."""
    rows = df.select(prob.cast("double").alias("prob"), y.alias("y")).where("prob is not null and y is not null")
    grouped = rows.groupBy("prob").agg(F.sum(F.col("y").cast("long")).alias("ones"), F.sum((~F.col("y")).cast("long")).alias("zeros"))
    above = running(grouped, ["prob"], {"ones": "tp", "zeros": "fp"}, descending=True)
    total = grouped.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("zeros"), F.lit(0))).first()
    out = above.withColumn("fn", F.lit(total[0]) - F.col("tp")).withColumn("tn", F.lit(total[1]) - F.col("fp"))
    f1 = lambda a: F.when(2 * a + F.col("fp") + F.col("fn") > 0, 2 * a / (2 * a + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return out.withColumn("f1_macro", (f1(F.col("tp")) + f1(F.col("tn"))) / 2)


def best_of_all(scores: DataFrame, default: float = 0.5) -> DataFrame:
    """threshold and f1_macro: the smallest of the best thresholds of every_threshold(); the default where none is above 0."""
    top = scores.where("f1_macro > 0").orderBy(F.desc("f1_macro"), "prob").limit(1).select(F.col("prob").alias("threshold"), "f1_macro")
    none = scores.sparkSession.range(1).select(F.lit(default).alias("threshold"), F.lit(0.0).alias("f1_macro"))
    return top.union(none).orderBy(F.desc("f1_macro")).limit(1)


def area(scores: DataFrame) -> DataFrame:
    """auc: the chance that a true row scores above a false one, ties half; null where one class is empty. From
    every_threshold(), whose counts lie above each score."""
    pairs = F.sum(F.col("ones") * F.col("tn") - F.col("ones") * F.col("zeros") / 2)  # tn: false rows at the score or below
    return scores.agg((pairs / F.nullif(F.sum("ones") * F.sum("zeros"), F.lit(0))).alias("auc"))


def evaluate_rule(df: DataFrame, y: Column, overlap: float, length: int) -> DataFrame:
    from .cascade import rule

    return binary_f1(df, y, rule(overlap, length) == "unsafe")
