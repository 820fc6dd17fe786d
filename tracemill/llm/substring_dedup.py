"""Substring dedup with a count-min prefilter.

A window is `width` consecutive words of one document. A word is removed if it lies in a window whose word sequence
also starts in a document with a smaller identifier. Windows are judged on the input.

First pass: each task counts its windows in a partial sketch, shipped by range of cells as the cells that it fills. A
range adds the parts of all tasks into a count-min sketch: ROWS arrays, each of a fixed number of cells that follows from
the windows counted in the range, each with a hash of its own. The smallest of a window's counts is never below its
true count, so a window that occurs twice is always estimated repeated. Each block of documents gets back which of its
windows are. Second pass: those windows alone are grouped exactly, by 96-bit fingerprints, which gives the smallest
document of each, and every block gets back the windows that start in a smaller document elsewhere.

Blocks hold a few MB of text each, so their number grows with the input; a task's partial sketch holds a window of its
share twice at most, so a passage in a third of all documents adds two entries a task to its range. Rows that repeat with
identifier and text until they would fill a block alone are worked on once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIG, mix, packed, quoted, rolled, slices, spans, stage_table, unpacked, word_hashes

#: Bytes of text in a block, on average, and windows that a task counts before it hands its sketch on.
BLOCK_BYTES, FLUSH = 6 << 20, 1_500_000
#: Arrays of a range's sketch, cells of each for a window, bits that tell windows of a range apart, bits of a block's number.
ROWS, CELLS, FINGER_BITS, BLOCK_BITS = 3, 4, 32, 32
NONE = np.uint32((1 << BLOCK_BITS) - 1)
BASE2 = 0xC2B2AE3D27D4EB4F

SKETCH = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("cells", pa.binary()), ("blocks", pa.binary())])
FLAGS = pa.schema([("block", pa.int64()), ("cells", pa.binary())])
OWNERS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("h1", pa.binary()), ("h2", pa.binary()), ("owner", pa.binary())])
OUT = pa.schema([("id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("copies", pa.int64())])


def windows(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all windows in two parts (64 and 32 bits), the text of each, and its first word's index in all words."""
    a, b, starts = word_hashes(texts)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    n = max(0, len(a) - width + 1)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :]) if n else np.zeros(0, dtype=np.int64)
    return rolled(a, width)[at], rolled(b, width, BASE2)[at] >> np.uint64(32), doc[at], at


def record(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema.names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([record(schema, rows)], schema=schema)


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)


def fingers(h: np.ndarray, shard_bits: int) -> np.ndarray:
    """What the sketch knows of a window: its range and FINGER_BITS more bits."""
    return h >> np.uint64(64 - FINGER_BITS - shard_bits)


def by_block(block: np.ndarray, finger: np.ndarray, rows: list[tuple], of) -> None:
    """Adds a row for each block with its distinct fingers."""
    order = np.lexsort((finger, block))
    block, finger = block[order], finger[order]
    new = np.concatenate([[True], (block[1:] != block[:-1]) | (finger[1:] != finger[:-1])]) if len(block) else np.zeros(0, dtype=bool)
    block, finger = block[new], finger[new]
    for s, e in spans(runs(block), len(block)):
        rows.append(of(int(block[s]), packed(np.diff(finger[s:e], prepend=np.uint64(0)), 8)))


def sketch(width: int, shard_bits: int):
    def flushed(finger: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(finger, kind="stable")
        finger, block = finger[order], block[order]
        first = runs(finger)
        count = np.diff(np.append(first, len(finger)))
        rows: list[tuple] = []
        # a window that this share alone holds twice is known to be repeated: its blocks are told at once
        known = np.repeat(count > 1, count)
        by_block(block[known], finger[known], rows, lambda b, f: (b % (1 << shard_bits), b, f, b""))
        # the partial sketch: a count of one with its block, or of two without
        keep = ~known
        keep[first[count > 1]] = keep[first[count > 1] + 1] = True
        block = np.where(known, NONE, block)[keep]
        finger = finger[keep]
        shard, own = (finger >> np.uint64(FINGER_BITS)).astype(np.int64), finger & np.uint64((1 << FINGER_BITS) - 1)
        for s, e in spans(runs(shard), len(shard)):
            rows.append((int(shard[s]), -1, packed(np.diff(own[s:e], prepend=np.uint64(0)), 4), packed(block[s:e].astype(np.uint64), 4)))
        return record(SKETCH, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks, size = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                h1, _, doc, _ = windows(part["text"], width)
                held.append(fingers(h1, shard_bits))
                blocks.append(np.asarray(part["block"]).astype(np.uint32)[doc])
                size += len(h1)
                if size >= FLUSH:
                    yield flushed(np.concatenate(held), np.concatenate(blocks))
                    held, blocks, size = [], [], 0
        if size:
            yield flushed(np.concatenate(held), np.concatenate(blocks))

    return run


def repeated(finger: np.ndarray) -> np.ndarray:
    """Which entries a count-min sketch of all of them estimates to occur twice or more: the smallest count of ROWS arrays."""
    cells = 1 << max(10, (CELLS * len(finger) - 1).bit_length())
    least = np.ones(len(finger), dtype=bool)
    for row in range(ROWS):
        at = (mix(finger + np.uint64((row + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(cells - 1)).astype(np.int64)
        counts = np.bincount(at, minlength=cells)
        least &= counts[at] >= 2
    return least


def merged(part: pa.Table) -> pa.Table:
    """Of one range of cells: the repeated windows of each block."""
    rows, keys, blocks = [], [], []
    shard = np.uint64(part["shard"][0].as_py())
    for block, finger, own in zip(part["block"].to_pylist(), part["cells"].to_pylist(), part["blocks"].to_pylist(), strict=True):
        if block >= 0:
            rows.append((block, finger))
        else:
            keys.append(np.cumsum(unpacked(finger, 4), dtype=np.uint64))
            blocks.append(unpacked(own, 4).astype(np.uint32))
    if keys:
        finger, block = np.concatenate(keys), np.concatenate(blocks)
        pick = repeated(finger) & (block != NONE)
        by_block(block[pick], finger[pick] | shard << np.uint64(FINGER_BITS), rows, lambda b, f: (b, f))
    return table_of(FLAGS, rows)


def ids_of(docs: pa.Table) -> np.ndarray:
    return np.array([BIG if i is None else i for i in docs["id"].to_pylist()], dtype=np.int64)


def candidates(width: int, shard_bits: int):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not docs.num_rows or not flags.num_rows:
            return table_of(OWNERS, [])
        block = docs["block"][0].as_py()
        h1, h2, doc, _ = windows(docs["text"].combine_chunks(), width)
        cells = np.unique(np.concatenate([np.cumsum(unpacked(c, 8), dtype=np.uint64) for c in flags["cells"].to_pylist()]))
        cell = fingers(h1, shard_bits)
        at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        hit = cells[at] == cell
        h1, h2, owner = h1[hit], h2[hit], ids_of(docs)[doc[hit]]
        order = np.lexsort((owner, h2, h1))
        h1, h2, owner = h1[order], h2[order], owner[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, dtype=bool)
        h1, h2, owner = h1[new], h2[new], owner[new]
        shard = (h1 >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(h1), dtype=np.int64)
        start = runs(shard)
        return table_of(OWNERS, [(int(shard[s]), block, packed(np.diff(h1[s:e], prepend=np.uint64(0)), 8), packed(h2[s:e], 4), packed(owner[s:e].astype(np.uint64), 8)) for s, e in spans(start, len(shard))])

    return run


def read_owners(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h1 = [np.cumsum(unpacked(x, 8), dtype=np.uint64) for x in part["h1"].to_pylist()]
    n = [len(x) for x in h1]
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, dtype=np.uint64)
    return np.repeat(np.array(part["block"].to_pylist(), dtype=np.int64), n), join(h1), join([unpacked(x, 4) for x in part["h2"].to_pylist()]), join([unpacked(x, 8) for x in part["owner"].to_pylist()]).astype(np.int64)


def grouped(part: pa.Table) -> pa.Table:
    """Of one range of fingerprints: for each block, its windows that start in a smaller document of another block."""
    block, h1, h2, owner = read_owners(part)
    order = np.lexsort((owner, h2, h1))
    block, h1, h2, owner = block[order], h1[order], h2[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else np.zeros(0, dtype=np.int64)
    least = np.repeat(owner[start], np.diff(np.append(start, len(h1))))
    told = least < owner
    order = np.lexsort((h1[told], block[told]))
    block, h1, h2, least = block[told][order], h1[told][order], h2[told][order], least[told][order]
    start = runs(block)
    return table_of(OWNERS, [(0, int(block[s]), packed(np.diff(h1[s:e], prepend=np.uint64(0)), 8), packed(h2[s:e], 4), packed(least[s:e].astype(np.uint64), 8)) for s, e in spans(start, len(block))])


def removed(width: int):
    def run(docs: pa.Table, owners: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return table_of(OUT, [])
        texts, own = docs["text"].combine_chunks(), ids_of(docs)
        h1, h2, doc, at = windows(texts, width)
        _, o1, o2, owner = read_owners(owners)
        a, b, who = np.concatenate([h1, o1]), np.concatenate([h2, o2]), np.concatenate([own[doc], owner])
        order = np.lexsort((who, b, a))
        a, b, who = a[order], b[order], who[order]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
        least = np.repeat(who[start], np.diff(np.append(start, len(a))))
        later = order[(least < who) & (order < len(h1))]
        flat = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts.to_pylist()]
        sizes = np.array([len(w) for w in flat], dtype=np.int64)
        cover = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
        np.add.at(cover, at[later], 1)
        np.add.at(cover, at[later] + width, -1)
        gone = np.cumsum(cover)[:-1] > 0
        rows, begin = [], 0
        for key, w, n, copies in zip(docs["id"].to_pylist(), flat, sizes.tolist(), docs["copies"].to_pylist(), strict=True):
            mask = gone[begin : begin + n]
            k = int(mask.sum())
            rows.append((key, b" ".join(w if not k else [x for x, m in zip(w, mask.tolist(), strict=True) if not m]).decode("utf-8", "surrogatepass"), n, k, copies))
            begin += n
        return table_of(OUT, rows)

    return run


def collapsed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, text, copies) and the bytes of all texts. Rows that repeat with both, by more bytes than a block, are one row."""
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("id", "text"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    heavy = (F.col("n") > 1) & (F.col("size") > BLOCK_BYTES)
    size, some = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max(heavy), F.lit(False))).first()
    if not some:
        return rows.withColumn("copies", F.lit(1).cast("long")), size
    hot = stage_table(sizes.where(heavy).select("key"), "hot")
    once = keyed.join(hot, "key", "left_semi").groupBy("id", "text").agg(F.count("*").alias("copies"))
    rest = keyed.join(hot, "key", "left_anti").select("id", "text", F.lit(1).cast("long").alias("copies"))
    return rest.union(stage_table(once, "once")), size


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """One row per row of docs: id_col, kept (the words that stay, joined by one space), n_words, n_removed.

    Null texts have no words; texts under `width` words have no windows and keep all. Rows with one identifier never
    remove each other's words; null identifiers count as larger than all others. An empty table gives no rows. Other
    columns are not read.
    """
    rows, size = collapsed(docs, id_col, text_col)
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    if n_blocks >= NONE:
        raise ValueError(f"{n_blocks} blocks: their numbers have {BLOCK_BITS} bits")
    shard_bits = max(0, (n_blocks - 1).bit_length())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
    flags = rows.select("text", "block").mapInArrow(sketch(width, shard_bits), "shard int, block long, cells binary, blocks binary").groupBy("shard").applyInArrow(merged, "block long, cells binary")
    # both passes over the blocks read one exchange of the texts
    owner_ddl = "shard int, block long, h1 binary, h2 binary, owner binary"
    told = rows.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(candidates(width, shard_bits), owner_ddl).groupBy("shard").applyInArrow(grouped, owner_ddl)
    done = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(removed(width), "id long, kept string, n_words long, n_removed long, copies long")
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return done.withColumn("copy", each).select(F.col("id").alias(id_col), "kept", "n_words", "n_removed")
