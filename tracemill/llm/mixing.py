"""Mixing sources to target weights, with DataFrame functions alone.

Tokens are summed by source (combined before the shuffle), a source's target divided by its size is its repetition
rate, and a document is taken floor(rate) times plus once more with the rate's fraction as probability. That coin is
seeded by a hash of the document's identifier, so reruns and retried tasks agree. Excess over `most` times a source's
size goes to the others by weight, round by round, until no source is above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, quoted, stage_table

#: Sources beyond this many are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds each source's place (from 0) by code point, null last. Sources may be many: ranges of them are sorted side by
    side, and only the ranges' sizes, a row each, meet in one task."""
    dealt = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    numbered = stage_table(dealt.select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "sources")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = numbered.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    return numbered.join(parts, "part").select("source", "source_size", (F.col("before") + F.col("at")).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds weight and target.

    Sources by code point, null last, weigh `weights`, repeating. The loop's state is two numbers; each round is one
    aggregate over the table of sources, and caps at least one more source or ends.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    held = stage_table(ranked(sizes).select("source", "source_size", weight.alias("weight")), "weights")
    sums = lambda rows: tuple(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first())
    total, weights_sum = sums(held)
    rest, free = total, weights_sum
    while True:
        # at this level a source is above if weight * rest / free > most * source_size
        above = (F.col("weight").cast("decimal(38,0)") * F.lit(rest).cast("decimal(19,0)")) > (F.col("source_size").cast("decimal(38,0)") * F.lit(most * free).cast("decimal(19,0)"))
        size, weight_sum = sums(held.where(above))
        left, leftw = total - most * size, weights_sum - weight_sum
        if (left, leftw) == (rest, free) or leftw == 0:
            break
        rest, free = left, leftw
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(max(free, 1)))
    return held.withColumn("target", F.least(share, (F.col("source_size") * most).cast("double")))


def coin(id_col):
    """Uniform in [0, 1) from the first 52 bits of the identifier's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rated(rows: DataFrame, sizes: DataFrame, id_col: str, source_col: str, weights: tuple[int, ...], most: int, names: list[str]) -> DataFrame:
    """rows with source_size, target and copies under the given names, which no column of rows has."""
    source = fresh([*rows.columns, *names], "source_of_mix")[0]
    table = targets(sizes, weights, most).select(F.col("source").alias(source), F.col("source_size").alias(names[0]), F.col("target").alias(names[1]))
    small = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(table) if small else table, quoted(source_col).eqNullSafe(quoted(source))).drop(source)
    rate = F.when(quoted(names[0]) > 0, quoted(names[1]) / quoted(names[0])).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    return joined.withColumn(names[2], (whole + (coin(quoted(id_col)) < rate - whole).cast("long")).cast("long"))


def source_sizes(docs: DataFrame, text_col: str, source_col: str) -> DataFrame:
    return docs.select(quoted(source_col).alias("source"), n_words(quoted(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))


def mix_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies, taken (= size * copies).

    Null texts have size 0; null sources are one source of their own. Repeated rows and rows that share an identifier toss
    the same coin. A source without words has target 0 and takes each document once (its documents have no words to
    take). No document is taken more than `most` times. An empty table gives no rows. Other columns are not read.
    """
    sized = docs.select(quoted(id_col).alias("id"), quoted(source_col).alias("source"), n_words(quoted(text_col)).alias("size"))
    out = rated(sized, source_sizes(docs, text_col, source_col), "id", "source", weights, most, ["source_size", "target", "copies"])
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of docs, whatever their names."""
    size, target, copies, copy = fresh(docs.columns, "source_size", "target", "copies", "copy")
    out = rated(docs, source_sizes(docs, text_col, source_col), id_col, source_col, weights, most, [size, target, copies])
    return out.where(quoted(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), quoted(copies)))).drop(size, target, copies, copy)
