"""Exact top-k search by inner product in a vector-approximation file.

Vectors are integers, floor(scale * component). The file has a row for each block of vectors: per dimension the least
value and the width of CELLS equal cells, a byte a component that names the cell, and, in columns that the scan does not
read, the exact vectors. Cells bound a score from below and above. A scan keeps for each query the candidates whose
upper bound reaches the kth largest lower bound so far; over all tasks, those that reach the kth largest of all. Exact
vectors are then read in the order of the upper bounds: a first read of a few candidates a query gives a kth score, a
second reads those alone whose upper bound still reaches it, after which the result is certain.

Queries are searched in parts of QUERY_BYTES at most, which are broadcast one after the other; as many parts are dealt as
their bytes ask for, however many partitions the rows come in. Blocks are never shuffled. Of equal vectors the k + 1 smallest identifiers are candidates, as no more can be in a result that leaves out the
query's own, so a vector in a third of all rows is a few candidates.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, quoted, stage_table
from .rows import batch

#: Cells a dimension, components of a block, bytes of a part of the queries, candidates of a query read first (times k), bounds a step of the scan.
CELLS, BLOCK, QUERY_BYTES, FIRST, STEP = 256, 1 << 17, 8 << 20, 2, 1 << 20
EXACT = float(1 << 52)  # up to here sums of integers in double precision are exact
LEAST, MOST = -(1 << 63), (1 << 63) - 1

VECTORS = "id long, v binary"
BLOCKS = "block long, dims int, ids array<long>, lows binary, widths binary, cells binary, exact array<binary>"
PARTS = "part long, ids array<long>, v array<binary>"
FOUND = "query int, block long, row int, low double, high double"
SCORED = "query int, id long, score long"


def encoded(values: np.ndarray) -> bytes:
    """Integers in the least of 2, 4 or 8 bytes that holds all of them, so equal vectors are equal bytes."""
    most = int(np.abs(values.astype(np.float64)).max(initial=0))
    return values.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes() + (b"\2" if most < 1 << 15 else b"\4" if most < 1 << 31 else b"\10")


def decoded(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[-1]}", count=len(data) // data[-1]).astype(np.int64)


def integers(scale: float):
    """(id, v) of the vectors that take part: whole ones with finite components alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column("v")
            ids, out = [], []
            for k, own in enumerate(lists):
                if not own.is_valid or own.values.null_count:
                    continue
                x = np.asarray(own.values, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(x * scale)
                # beyond 64 bits components stand at the ends, as long integers do
                v = np.where(x >= 2.0**63, MOST, np.where(x < -(2.0**63), LEAST, np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))
                ids.append(rows.column("id")[k].as_py())
                out.append(encoded(v))
            yield batch([ids, out], VECTORS)

    return run


def matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        x = decoded(v)
        out[i, : len(x)] = x
    return out


def width_of(vectors: list[bytes]) -> int:
    return max((len(v) // v[-1] for v in vectors), default=0)


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the file from rows (id, v)."""
    ids, held, size, block = [], [], 0, TaskContext.get().partitionId() << 32

    def flushed() -> pa.RecordBatch:
        dims = width_of(held)
        x = matrix(held, dims).astype(np.float64)
        lows = x.min(axis=0)
        widths = np.maximum(1.0, np.ceil((x.max(axis=0) - lows + 1) / CELLS))
        cells = np.clip((x - lows) // widths, 0, CELLS - 1).astype(np.uint8)
        return batch([[block], [dims], [ids], [lows.tobytes()], [widths.tobytes()], [cells.tobytes()], [held]], BLOCKS)

    for rows in batches:
        for i, v in zip(rows.column("id").to_pylist(), rows.column("v").to_pylist(), strict=True):
            ids.append(i)
            held.append(v)
            size += len(v) // v[-1] + 1
            if size >= BLOCK:
                yield flushed()
                ids, held, size, block = [], [], 0, block + 1
    if held:
        yield flushed()


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the queries: in double precision each part takes QUERY_BYTES, or is one vector."""
    ids, held, dims, part = [], [], 0, TaskContext.get().partitionId() << 32
    for rows in batches:
        for i, v in zip(rows.column("id").to_pylist(), rows.column("v").to_pylist(), strict=True):
            wide = max(dims, len(v) // v[-1], 1)
            if held and 8 * wide * (len(held) + 1) > QUERY_BYTES:
                yield batch([[part], [ids], [held]], PARTS)
                ids, held, wide, part = [], [], max(len(v) // v[-1], 1), part + 1
            ids.append(i)
            held.append(v)
            dims = wide
    if held:
        yield batch([[part], [ids], [held]], PARTS)


def scan(queries, k: int):
    """Candidates of each query in the blocks of a task that may be among its k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, vectors = queries.value
        q_dims = width_of(vectors)
        q = matrix(vectors, q_dims).astype(np.float64)
        ids_q = np.array(own_ids, dtype=np.int64)
        best = np.full((len(q), k), -np.inf)
        for rows in batches:
            for r in rows.to_pylist():
                dims = r["dims"]
                lows, widths = np.frombuffer(r["lows"]), np.frombuffer(r["widths"])
                n = len(r["ids"])
                shared = min(dims, q_dims)  # components that one side lacks are zero
                low = (lows + np.frombuffer(r["cells"], dtype=np.uint8).reshape(n, dims) * widths)[:, :shared]
                spread = widths[:shared] - 1
                ids = np.array([LEAST if i is None else i for i in r["ids"]], dtype=np.int64)
                null = np.array([i is None for i in r["ids"]])
                step = max(1, STEP // n)
                for s in range(0, len(q), step):
                    part = q[s : s + step, :shared]
                    least = part @ low.T
                    up, down = np.maximum(part, 0) @ spread, np.minimum(part, 0) @ spread
                    size = np.abs(part) @ (np.abs(low).max(axis=0, initial=0) + spread)
                    slack = np.where(size >= EXACT, size * (shared + 2) * 2.0**-50, 0.0)  # rounding of sums beyond 52 bits
                    up, down = up + slack, down - slack
                    least[(ids_q[s : s + step, None] == ids[None, :]) & ~null] = -np.inf
                    top = least if n <= k else np.partition(least, n - k, axis=1)[:, n - k :]
                    both = np.concatenate([best[s : s + step], top + down[:, None]], axis=1)
                    best[s : s + step] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
                    high = least + up[:, None]
                    at, row = np.nonzero((high >= best[s : s + step].min(axis=1)[:, None]) & (least > -np.inf))
                    if len(at):
                        yield batch([(at + s).astype(np.int32), np.full(len(at), r["block"]), row.astype(np.int32), least[at, row] + down[at], high[at, row]], FOUND)

    return run


def exactly(queries):
    """Inner products of the read vectors (query, id, v) with their queries; sums beyond 64 bits stand at the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = [decoded(v) for v in queries.value[1]]
        for rows in batches:
            scores = []
            for at, v in zip(rows.column("query").to_pylist(), rows.column("v").to_pylist(), strict=True):
                a, b = vectors[at], decoded(v)
                n = min(len(a), len(b))
                a, b = a[:n], b[:n]
                if float(np.abs(a.astype(np.float64)) @ np.abs(b.astype(np.float64))) < EXACT:
                    scores.append(int(a @ b))
                else:
                    scores.append(min(max(sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True)), LEAST), MOST))
            yield batch([rows.column("query"), rows.column("id"), scores], SCORED)

    return run


def best_of(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(spark: SparkSession, blocks: DataFrame, ids: list, vectors: list, k: int) -> DataFrame:
    """(query_id, rank, id, score) of one part of the queries."""
    queries = spark.sparkContext.broadcast((ids, vectors))
    found = stage_table(blocks.select("block", "dims", "ids", "lows", "widths", "cells").mapInArrow(scan(queries, k), FOUND), "found")
    kth = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("low").desc()))).where(F.col("n") <= k)
    bound = kth.groupBy("query").agg(F.min("low").alias("bound"), F.count("*").alias("n"))
    alive = found.join(bound, "query").where((F.col("n") < k) | (F.col("high") >= F.col("bound"))).select("query", "block", "row", "high")
    order = Window.partitionBy("query").orderBy(F.col("high").desc(), "block", "row")
    alive = stage_table(alive.withColumn("turn", F.row_number().over(order)), "alive")
    vectors_of = blocks.select("block", F.posexplode(F.arrays_zip("ids", "exact")).alias("row", "c")).select("block", "row", F.col("c.ids").alias("id"), F.col("c.exact").alias("v"))
    read = lambda rows: rows.select("query", "block", "row").join(vectors_of, ["block", "row"]).select("query", "id", "v").mapInArrow(exactly(queries), SCORED)
    first = stage_table(read(alive.where(F.col("turn") <= FIRST * k)), "first")
    sure = best_of(first, k).groupBy("query").agg(F.min("score").alias("sure"), F.count("*").alias("n"))
    rest = alive.where(F.col("turn") > FIRST * k).join(sure, "query").where((F.col("n") < k) | (F.col("high") >= F.col("sure")))
    names = spark.createDataFrame(pa.table({"query": pa.array(range(len(ids)), pa.int32()), "query_id": pa.array(ids, pa.int64())}))
    out = best_of(first.union(read(rest)), k).join(F.broadcast(names), "query")  # a part's identifiers
    out = stage_table(out.select("query_id", "rank", "id", "score"), "best")
    queries.unpersist()
    return out


def top_k(rows: DataFrame, k: int, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k largest inner products of each query's integer vector with all others: query_id, rank (from 1), id_col, score.

    Queries are the rows whose identifier (as column id) meets the SQL condition is_query; candidates are all rows with another
    identifier; ties go to the smaller one, null last. Null vectors and those with null or non-finite components take no part.
    Components that the shorter of two vectors lacks count as zero, so an empty vector scores 0. Rows that repeat with
    identifier and vector count once; vectors that share an identifier are searched and found each. Components and scores
    beyond 64 bits stand at the ends of their range. Fewer than k candidates give fewer rows; no queries give none. Other
    columns are not read.
    """
    spark = rows.sparkSession
    own = rows.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("v"))
    vectors = lambda df: df.mapInArrow(integers(scale), VECTORS).distinct()
    order = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    candidates = vectors(own).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("id", "v")
    blocks = stage_table(candidates.mapInArrow(packs, BLOCKS), "blocks")
    asked = stage_table(vectors(own.where(is_query)), "asked")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("v") * 4), F.lit(0))).first()[0]  # as doubles, of the least integers' two bytes
    parts = stage_table(asked.repartition(max(1, -(-size // QUERY_BYTES))).mapInArrow(parted, PARTS), "queries")
    path = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    schema = "query_id long, rank int, id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for number in [r["part"] for r in parts.select("part").orderBy("part").collect()]:  # numbers alone; a part is read when it is searched
        part = parts.where(F.col("part") == number).first()
        searched(spark, blocks, list(part["ids"]), [bytes(v) for v in part["v"]], k).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).withColumnRenamed("id", id_col)
