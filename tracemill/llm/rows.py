"""Small helpers of the operators on vectors, conversations and phrases: Arrow rows, ranks, digests of ordered lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
#: Identifiers in one piece of a joined list, at most.
PIECE = 1 << 16


def batch(columns: list, ddl: str) -> pa.RecordBatch:
    """A batch of the columns (lists, numpy or Arrow arrays), typed by a Spark schema in DDL."""
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def ranked(df: DataFrame, order: list[Column], name: str, staged: str) -> tuple[DataFrame, int]:
    """The rows with their place (from 0) in the given order, written to the shared folder, and how many they are.

    Rows are sorted range by range; places are those within a range plus the sizes of the ranges before it. No task holds
    more than a range; the sizes of the ranges are a row each.
    """
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    at = stage_table(at, staged)
    part = F.shiftright("at_", 33)
    sizes = at.groupBy(part.alias("part_")).agg(F.count("*").alias("size_"))
    before = F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part_", before.alias("before_"))
    placed = at.withColumn("part_", part).join(F.broadcast(offsets), "part_")  # a row for each range of the sort
    return placed.withColumn(name, F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))).drop("part_", "at_", "before_"), at.count()


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (node, id) in order: runs of one node's identifiers as decimal text, PIECE at most in each."""
    for rows in batches:
        nodes, ids = rows.column("node").to_pylist(), rows.column("id").to_pylist()
        out, begin = [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or nodes[i] != nodes[begin] or i - begin >= PIECE:
                out.append((nodes[begin], ids[begin], ",".join(map(str, ids[begin:i])).encode()))
                begin = i
        yield batch([list(c) for c in zip(*out, strict=True)] or [[]] * 3, "node binary, first long, piece binary")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces in order of node and first identifier: each node's digest, one piece at a time."""
    node, state = None, None
    for rows in batches:
        out = []
        for key, piece in zip(rows.column("node").to_pylist(), rows.column("piece").to_pylist(), strict=True):
            if key != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
        yield batch([list(c) for c in zip(*out, strict=True)] or [[]] * 2, "node binary, sha256 string")
    if state is not None:
        yield batch([[node], [state.hexdigest()]], "node binary, sha256 string")


def list_digests(members: DataFrame) -> DataFrame:
    """(node, sha256): of each node's distinct identifiers (node binary, id long), ascending and joined by commas.

    Identifiers are sorted over ranges of (node, id), so a node with most of them is dealt to many tasks, which join up to
    PIECE of them to one piece; a node's digest then reads its pieces as a stream, and no list is held whole.
    """
    each = members.repartitionByRange("node", "id").sortWithinPartitions("node", "id").mapInArrow(pieces, "node binary, first long, piece binary")
    return each.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, sha256 string")
