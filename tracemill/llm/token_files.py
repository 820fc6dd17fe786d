"""Token-id files with a minimal perfect hash index.

A file is a folder of shards in Parquet, a row a shard: the raw payload (unsigned 16- or 32-bit little-endian ids of
its documents, end to end), the index, and the shard's place in the whole. The index is a minimal perfect hash from
document keys to slots: displacements for each bucket, then per slot a fingerprint, the offset in the payload and the
length. A lookup hashes the key twice, reads one displacement and one slot, and compares the fingerprint. Documents
lie in ascending key order over all shards; keys are stored too, so that a reader can list them. A shard closes when it
is full, wherever it is in a key's documents: a key with very many of them (or none, the null key) runs on over several
shards, each with its own part in its index, and a lookup reads every shard whose range of keys holds the key.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, mix, quoted, slices
from .tokens import encoder

#: Ids of a shard, bytes of text that are encoded at a time.
SHARD_IDS, ENCODED_BYTES = 4 << 20, 6 << 20
SHARD = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("width", pa.int32()), ("payload", pa.binary()), ("keys", pa.binary()), ("nulls", pa.int64()), ("displacements", pa.binary()), ("slots", pa.binary())])
SHARD_DDL = "part int, piece int, n_ids long, low long, high long, width int, payload binary, keys binary, nulls long, displacements binary, slots binary"
#: A slot: fingerprint, first document's ordinal among equal keys' run, offset in ids, length in ids of the run's documents.
SLOT = np.dtype([("print", "<u4"), ("run", "<u4"), ("first", "<u8")])


def hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket hash, slot hash and fingerprint of int64 keys."""
    k = keys.astype(np.int64).view(np.uint64)
    return mix(k + np.uint64(0x9E3779B97F4A7C15)), mix(k ^ np.uint64(0xD1B54A32D192ED03)), (mix(k + np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(32)).astype(np.uint32)


def slot_of(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + d.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement per bucket, and the slot of each key: a bijection onto 0..n-1. Keys are distinct.

    Hash and displace: buckets of about 4 keys, largest first, each tries displacements until its keys fall on free
    slots.
    """
    n = len(keys)
    if n == 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    m = max(1, (n + 3) // 4)
    b, h, _ = hashes(keys)
    bucket = (b % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=m))
    displacement, slot, taken = np.zeros(m, dtype=np.uint32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    sizes = np.bincount(bucket, minlength=m)
    for k in np.argsort(-sizes, kind="stable").tolist():
        if not sizes[k]:
            break
        own = order[ends[k] - sizes[k] : ends[k]]
        d, step = 0, 64
        while True:
            tries = np.arange(d, d + step, dtype=np.uint64)
            at = slot_of(h[own][None, :], tries[:, None], n)
            free = ~taken[at].any(axis=1)
            if len(own) > 1 and free.any():
                s = np.sort(at, axis=1)
                free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if free.any():
                i = int(np.argmax(free))
                displacement[k], slot[own] = d + i, at[i]
                taken[at[i]] = True
                break
            d, step = d + step, min(step * 2, 8192)
    return displacement, slot


def shard(part: int, piece: int, ids: list[np.ndarray], keys: list[int | None]) -> tuple:
    """ids: of each document, in key order; null keys come first and are listed by `nulls` alone."""
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], dtype=np.int64)
    own, start, run = np.unique(known, return_index=True, return_counts=True)
    displacement, slot = build_index(own)
    slots = np.zeros(len(own), dtype=SLOT)
    slots["print"][slot], slots["run"][slot], slots["first"][slot] = hashes(own)[2], run, start + nulls
    bounds = np.append(first, len(flat)).astype("<u8")
    low, high = (int(known[0]), int(known[-1])) if len(known) else (None, None)
    return part, piece, len(flat), low, high, width, flat.astype(f"<u{width}").tobytes(), known.astype("<i8").tobytes(), nulls, displacement.astype("<u4").tobytes(), slots.tobytes() + bounds.tobytes()


class Reader:
    """Keyed access to a shard."""

    def __init__(self, row: dict):
        self.width, self.nulls, payload = row["width"], row["nulls"], row["payload"]
        self.ids = np.frombuffer(payload, dtype=f"<u{self.width}")
        self.keys = np.frombuffer(row["keys"], dtype="<i8")
        self.displacements = np.frombuffer(row["displacements"], dtype="<u4")
        n = len(np.unique(self.keys))
        self.slots = np.frombuffer(row["slots"], dtype=SLOT, count=n)
        self.bounds = np.frombuffer(row["slots"], dtype="<u8", offset=n * SLOT.itemsize)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents where the fingerprint differs."""
        if not len(self.slots):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        b, h, prints = hashes(keys)
        slot = slot_of(h, self.displacements[(b % np.uint64(len(self.displacements))).astype(np.int64)], len(self.slots))
        found = self.slots[slot]
        return found["first"].astype(np.int64), np.where(found["print"] == prints, found["run"], 0).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        return self.ids[int(self.bounds[i]) : int(self.bounds[i + 1])]


def shards(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, held, ids, keys = TaskContext.get().partitionId(), 0, 0, [], []
        batch_of = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, SHARD.types, strict=True)], schema=SHARD)
        for batch in batches:
            for rows in slices(batch, "text", ENCODED_BYTES):
                flat, starts = encoder(path, False).encode(rows["text"])
                for i, key in enumerate(rows["id"].to_pylist()):
                    if held >= most:
                        yield batch_of(shard(part, piece, ids, keys))
                        piece, held, ids, keys = piece + 1, 0, [], []
                    ids.append(np.append(flat[starts[i] : starts[i + 1]], np.uint32(end_id)))
                    keys.append(key)
                    held += len(ids[-1])
        if keys:
            yield batch_of(shard(part, piece, ids, keys))

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, most: int = SHARD_IDS) -> None:
    """Encodes every whole text, appends end_id, and writes the file in ascending id order (nulls first).

    tokenizer: path of a word-level tokenizers file. Null texts are empty. Repeated identifiers are kept, side by side.
    An empty table writes a file without shards.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    # a hot key's texts are dealt over several ranges
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id")
    ordered.mapInArrow(shards(tokenizer, end_id, most), SHARD_DDL).write.parquet(path)


LISTED = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Looks every stored key up in its shard's index and reads the documents it leads to."""
    for batch in batches:
        for row in batch.to_pylist():
            reader = Reader(row)
            own = np.unique(reader.keys)
            first, run = reader.find(own)
            if not (run > 0).all():
                raise ValueError("the index does not hold all of its keys")
            out = [(None, i) for i in range(reader.nulls)] + [(k, f + j) for k, f, r in zip(own.tolist(), first.tolist(), run.tolist(), strict=True) for j in range(r)]
            ids = [reader.document(i) for _, i in out]
            cols = [[row["part"]] * len(out), [row["piece"]] * len(out), [k for k, _ in out], [int(reader.bounds[i]) for _, i in out], [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, LISTED.types, strict=True)], schema=LISTED)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of a file: id_col, start (ids of all documents before it), n_tokens, ids_crc32."""
    stored = spark.read.schema(SHARD_DDL).parquet(path)
    # one row a shard, of some million ids each
    places = stored.select("part", "piece", "n_ids").withColumn("before", F.sum("n_ids").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))).select("part", "piece", F.coalesce("before", F.lit(0)).cast("long").alias("before"))
    rows = stored.mapInArrow(listed, "part int, piece int, id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(places, ["part", "piece"]).select(F.col("id").alias(id_col), (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def documents_of(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """key and ids (unsigned 32-bit little-endian) of each document of a few keys, from the shards that may hold them."""
    wanted = sorted(set(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row)
                own = np.array([k for k in wanted if row["low"] <= k <= row["high"]], dtype=np.int64)
                found = [(k, reader.document(f + j).astype("<u4").tobytes()) for k, f, r in zip(own.tolist(), *(x.tolist() for x in reader.find(own)), strict=True) for j in range(r)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["key", "ids"])

    near = F.exists(F.array(*[F.lit(k).cast("long") for k in wanted]), lambda k: (F.col("low") <= k) & (F.col("high") >= k))
    inside = (F.col("high") >= wanted[0]) & (F.col("low") <= wanted[-1]) & near if wanted else F.lit(False)
    return spark.read.schema(SHARD_DDL).parquet(path).where(inside).mapInArrow(run, "key long, ids binary")


def token_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Writes docs to a new file in the shared folder and lists what it reads from there."""
    path = f"{checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path, id_col, text_col, end_id)
    return read_tokens(docs.sparkSession, path, id_col)
