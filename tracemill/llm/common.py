"""Helpers shared by the operators: words as hashes, shared-folder tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters (Java, RE2 and Python agree on it).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 4 << 20
BIG = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session of one machine (as in tests) may name none and gets one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tracemill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: computed once, safe from lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (in any case, as Spark compares them)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its whole name, which may hold dots."""
    return F.col(f"`{name.replace('`', '``')}`")


def cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each (at least one row)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    part = np.cumsum(size) // most
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    start = 0
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and the first word's index of each text (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat, starts = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    starts = starts - starts[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():  # pieces before the first and after the last word
        flat = flat.filter(pa.array(full))
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
    return flat, starts


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word, computed once for each different word, and the starts as in words().

    lower: of words with A-Z lower-cased (as bytes).
    """
    flat, starts = words(texts)
    coded = flat.dictionary_encode()
    both = np.empty((len(coded.dictionary), 2), dtype=np.uint64)
    for i, w in enumerate(coded.dictionary.cast(pa.large_binary()).to_pylist()):
        h = xxhash.xxh3_128_intdigest(w.lower() if lower else w)
        both[i, 0], both[i, 1] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
    at = np.asarray(coded.indices)
    return both[at, 0], both[at, 1], starts


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of the `width` values that start at each index, as a polynomial in an odd base."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n].copy()
    for i in range(1, width):
        out *= np.uint64(base)
        out += h[i : n + i]
    return mix(out)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned integers, byte by byte, which shuffles compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    got = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((got.shape[1], 8), dtype=np.uint8)
    out[:, :width] = got.T
    return out.view("<u8").ravel()


def packed(values: np.ndarray, width: int) -> bytes:
    """Planes, compressed as counts and ranks need it (by the entropy of their bytes), after their length."""
    data = planes(values, width)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, width: int) -> np.ndarray:
    return unplanes(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data[:8].strip(b"\0") else b"", width)


def spans(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Start and end of each run, given the starts and the number of all values."""
    return zip(starts.tolist(), [*starts[1:].tolist(), n] if len(starts) else [], strict=True)


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from which operators choose how many blocks they deal work into."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of (a long, b long): (node, component), the smallest reachable id.

    Alternates large-star and small-star steps. Each is a grouped minimum, which Spark combines before it shuffles,
    and an equi-join that adaptive execution can split at a hot node; no step collects a component anywhere. Lineage
    is cut with checkpoint() after each round. Edges with nulls and loops are ignored; no edges give no rows. Rounds grow
    with the logarithm of a component's diameter; components that are not whole after `most_rounds` raise an error.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not whole after {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select("v", "v").distinct())
