"""Harmonic packing of tokenized documents into sequences.

A piece of length L belongs to class floor(capacity / L), and a bin of class k takes exactly k pieces, whatever their
lengths, so a task needs one open bin per class and no other task's state: packing is one pass without a shuffle.
Documents may be cut freely, so a document yields whole sequences first; what is left is cut at powers of two down to
`smallest`, whose classes fill their bins to the last token, and a short tail, whose class wastes under a
1/(k + 1)-th. At the end of a task its open bins, at most one a class, are packed first-fit by falling length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices
from .tokens import encoder

PIECES = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Bytes of text that are encoded at a time.
ENCODED_BYTES = 2 << 20
DDL = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int, smallest: int) -> list[int]:
    """Lengths of a document's pieces."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= smallest:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Packer:
    """Bins of one task. A piece is a tuple (id, start, length, ids, doc_tokens)."""

    def __init__(self, capacity: int, smallest: int, base: int):
        self.capacity, self.smallest, self.next = capacity, smallest, base
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.rows.append((*p, self.next, at))
            at += p[2]
        self.next += 1

    def add(self, key: int | None, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        data = ids.astype("<u4").tobytes()
        for size in cuts(n, self.capacity, self.smallest):
            k = self.capacity // size
            piece = (key, start, size, data[4 * start : 4 * (start + size)], n)
            if k == 1:
                self.close([piece])
            else:
                held = self.open.setdefault(k, [])
                held.append(piece)
                if len(held) == k:
                    self.close(self.open.pop(k))
            start += size

    def finish(self) -> None:
        bins: list[list] = []
        for piece in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2]):
            found = next((b for b in bins if b[0] + piece[2] <= self.capacity), None)
            if found is None:
                bins.append(found := [0, []])
            found[0] += piece[2]
            found[1].append(piece)
        for _, pieces in bins:
            self.close(pieces)
        self.open = {}

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)


def packed(path: str, capacity: int, end_id: int, smallest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, smallest, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                flat, starts = encoder(path, True).encode(part["text"])
                for i, key in enumerate(part["id"].to_pylist()):
                    packer.add(key, np.append(flat[starts[i] : starts[i + 1]], np.uint32(end_id)))
                if packer.rows:
                    yield packer.batch()
        packer.finish()
        if packer.rows:
            yield packer.batch()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, smallest: int = 64) -> DataFrame:
    """One row per piece: id_col, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    tokenizer: path of a byte-level tokenizers file, the same on every executor. A null text is empty and has the end
    id alone. Repeated rows are packed as often as they occur; null identifiers pass through. A sequence holds pieces
    of rows that one task has read; sequence_id is the task's partition and a counter, so a retried task gives the
    same numbers. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    return rows.mapInArrow(packed(tokenizer, capacity, end_id, smallest), DDL).withColumnRenamed("id", id_col)
