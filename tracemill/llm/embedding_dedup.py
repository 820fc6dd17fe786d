"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector x is turned by random rotations, stacked as M with K rows, and stored as the signs s of M x (its code) and
one correction factor, <s, M x>. For another vector q, <s, M q> / <s, M x> is an unbiased estimate of their inner product.
In place of q itself, its rotated coordinates are stored with four bits each, rounded at random so that the estimate
stays unbiased. Its error is under BOUND standard deviations with overwhelming probability; pairs whose estimate and
bound reach the threshold are computed again in double precision, and only those at or above it become links.

Pairs to estimate come from the codes themselves: a table reads a few bits of the code, and two vectors meet in a table
where those agree. Bits grow with the logarithm of the number of vectors and tables with the chance that a pair at the
threshold never meets, kept under MISS. First, codes alone are shipped to the buckets, which tell the vectors that have
a partner within its bound; second, only those vectors are fetched in full, and each bucket gives the number of links of
every vector and a spanning forest of them, never the pairs. A pair counts in the first table where it meets. Large
buckets are dealt out as pairs of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, quoted, stage_table

MISS, BOUND, CHUNK, SEED = 0.002, 4.0, 1024, 7
#: Buckets of this size or smaller are estimated many at a time; rows of such a block of pairs.
SMALL, BLOCK = 16, 20_000
KEYS = ("d", "t", "bucket", "i", "j")
CODES = pa.schema([("node", pa.int64()), ("d", pa.int32()), ("copies", pa.int64()), ("code", pa.binary()), ("factor", pa.float64()), ("coarse", pa.binary()), ("scale", pa.float64())])
CODES_DDL = "node long, d int, copies long, code binary, factor double, coarse binary, scale double"
MET_DDL = "d int, t int, bucket long, i int, j int, side int, node long, copies long, code binary"
MET = pa.schema([("d", pa.int32()), ("t", pa.int32()), ("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("code", pa.binary())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


class Rotations:
    """Random orthogonal matrices and the bits that each table reads; the same on every executor for the same sizes."""

    def __init__(self, d: int, bits: int, tables: int):
        rng = np.random.default_rng(SEED)
        k = max(1, math.ceil(4 * bits / d), math.ceil(256 / d))
        self.d, self.k, self.matrix = d, k, np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0].T for _ in range(k)])
        self.bits = np.stack([rng.choice(k * d, size=bits, replace=False) for _ in range(tables)])
        self.again = self.matrix @ self.matrix[:d].T  # from the first rotation's coordinates to those of all
        self.size = k * d

    def encoded(self, unit: np.ndarray) -> list[list]:
        """Code, factor, four-bit coordinates of the first rotation, and their scale."""
        rotated = unit @ self.matrix.T
        first = rotated[:, : self.d]
        scale = np.abs(first).max(axis=1)
        step = 2 * scale / 15
        coarse = np.floor((first + scale[:, None]) / step[:, None] + np.random.default_rng(SEED).random(first.shape))
        coarse = np.clip(coarse, 0, 15).astype(np.uint8)
        coarse = np.concatenate([coarse, np.zeros((len(coarse), self.d % 2), dtype=np.uint8)], axis=1)
        both = coarse[:, 0::2] << 4 | coarse[:, 1::2]
        return [[x.tobytes() for x in np.packbits(rotated > 0, axis=1)], np.abs(rotated).sum(axis=1).tolist(), [x.tobytes() for x in both], scale.tolist()]

    def signs(self, codes: list[bytes]) -> np.ndarray:
        packed = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)
        return np.unpackbits(packed, axis=1, count=self.size)

    def coordinates(self, coarse: list[bytes], scale: np.ndarray) -> np.ndarray:
        """Of all rotations, from the stored ones."""
        both = np.frombuffer(b"".join(coarse), dtype=np.uint8).reshape(len(coarse), -1)
        four = np.stack([both >> 4, both & 15], axis=2).reshape(len(coarse), -1)[:, : self.d]
        return ((four * (2 * scale / 15)[:, None] - scale[:, None]) @ self.again.T).astype(np.float32)

    def errors(self, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Standard deviations of an estimate: by the code, and by a query's rounding for each unit of its step."""
        f2 = np.minimum((factor / math.sqrt(self.size * self.k)) ** 2, 1.0)
        return np.sqrt((1 - f2) / (f2 * max(1, self.size - 1))), np.sqrt(1 + (1 - f2) * self.d / (f2 * self.size)) / 2

    def buckets(self, signs: np.ndarray) -> np.ndarray:
        """(vectors, tables)"""
        weight = np.uint64(1) << np.arange(self.bits.shape[1], dtype=np.uint64)
        return np.stack([signs[:, own].astype(np.uint64) @ weight for own in self.bits], axis=1)


@lru_cache(maxsize=8)
def rotations(d: int, bits: int, tables: int) -> Rotations:
    return Rotations(d, bits, tables)


def sizes(n: int, similarity: float) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = min(60, max(8, math.ceil(math.log2(max(n, 2))) + 1))
    meet = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - meet)))


def unit_rows(vectors: list[bytes], d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype="<f8").reshape(-1, d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps vectors that can link: of finite components, not all zero; as doubles scaled by their largest."""
    for batch in batches:
        rows = []
        for v in batch["v"].to_pylist():
            x = np.array([np.nan if c is None else c for c in v] if v is not None else [], dtype=np.float64)
            rows.append((x / np.abs(x).max()).astype("<f8").tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(rows, pa.binary())], names=["id", "v"])


def encoded(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) // 8 for v in batch["v"].to_pylist()])
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                code, factor, coarse, scale = rotations(d, bits, tables).encoded(unit_rows(part["v"].to_pylist(), d))
                yield pa.RecordBatch.from_arrays([part["node"], pa.array([d] * len(code), pa.int32()), part["copies"], pa.array(code, pa.binary()), pa.array(factor), pa.array(coarse, pa.binary()), pa.array(scale)], schema=CODES)

    return run


def bucket_rows(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch["d"])
            for d in np.unique(lengths).tolist():
                part, r = batch.filter(pa.array(lengths == d)), rotations(d, bits, tables)
                own = r.buckets(r.signs(part["code"].to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.size, d, dtype=np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(own.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part["node"]), tables))], names=["d", "t", "bucket", "node"])

    return run


def whole_buckets(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by KEYS as tables of whole buckets of one vector length, and the buckets' starts (and the end)."""
    held: list[pa.RecordBatch] = []

    def parts(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held
        rows = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([np.asarray(rows[c]).astype(np.int64) for c in KEYS], axis=1)
        start = np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])), len(key))
        end = len(key) if last else int(start[-2])  # the last bucket may go on
        for d in np.unique(key[:end, 0]).tolist():
            low, high = np.searchsorted(key[:end, 0], [d, d + 1]).tolist()
            yield rows.slice(low, high - low), start[(start >= low) & (start <= high)] - low
        held = [b for b in rows.slice(end).combine_chunks().to_batches() if b.num_rows]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield from parts(False)
    if held:
        yield from parts(True)


def sides(rows: pa.Table, s: int, e: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a bucket to compare with each other: all with all, or those of two chunks."""
    if rows["i"][s].as_py() == rows["j"][s].as_py():
        return np.arange(s, e), np.arange(s, e), True
    side = np.asarray(rows["side"][s:e])
    return s + np.flatnonzero(side == 0), s + np.flatnonzero(side == 1), False


def candidate_rows(bits: int, tables: int, similarity: float):
    """The rows of vectors that have a partner, first met in this bucket, whose estimate reaches the threshold with its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in whole_buckets(batches):
            r = rotations(rows["d"][0].as_py(), bits, tables)
            codes, scale, factor = rows["code"].to_pylist(), np.asarray(rows["scale"]), np.asarray(rows["factor"])
            bit = r.signs(codes)
            sign, query = bit.astype(np.float32) * 2 - 1, r.coordinates(rows["coarse"].to_pylist(), scale)
            own, rounding = r.errors(factor)
            step, t, keys = 2 * scale / 15, np.asarray(rows["t"]), None
            marked = np.zeros(len(rows), dtype=bool)

            def reach(dot: np.ndarray, x, y) -> np.ndarray:
                return dot / factor[y] + BOUND * np.sqrt(own[y] ** 2 + (rounding[y] * step[x]) ** 2) >= similarity  # noqa: B023

            def mark(x: np.ndarray, y: np.ndarray) -> None:
                nonlocal keys
                if len(x):
                    keys = r.buckets(bit) if keys is None else keys  # noqa: B023
                    before = (keys[x] == keys[y]) & (np.arange(tables)[None, :] < t[x][:, None])  # noqa: B023
                    new = ~before.any(axis=1)
                    marked[x[new]] = marked[y[new]] = True  # noqa: B023

            size = np.diff(start)
            one = np.asarray(rows["i"])[start[:-1]] == np.asarray(rows["j"])[start[:-1]]
            for k in np.unique(size[one & (size <= SMALL)]).tolist():
                at = start[:-1][one & (size == k)]
                pairs = np.array(list(combinations(range(k), 2)), dtype=np.int64).reshape(-1, 2)
                x, y = ((at[:, None] + pairs[None, :, c]).ravel() for c in (0, 1))
                for b in range(0, len(x), BLOCK):
                    p, q = x[b : b + BLOCK], y[b : b + BLOCK]
                    near = reach(np.einsum("ij,ij->i", query[p], sign[q]), p, q)
                    mark(p[near], q[near])
            for s, e in zip(start[:-1][~one | (size > SMALL)].tolist(), start[1:][~one | (size > SMALL)].tolist(), strict=True):
                left, right, same = sides(rows, s, e)
                for b in range(0, len(left), 256):
                    x = left[b : b + 256]
                    near = reach(query[x] @ sign[right].T, x[:, None], right[None, :])
                    if same:
                        near &= x[:, None] < right[None, :]
                    p, q = np.nonzero(near)
                    mark(x[p], right[q])
            yield from rows.select(MET.names).filter(pa.array(marked)).combine_chunks().cast(MET).to_batches()

    return run


def linked_rows(bits: int, tables: int, similarity: float):
    """Rows (a, null, n): vectors that a is linked with here, copies counted; and (a, b, null): a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in whole_buckets(batches, 20_000):
            d = rows["d"][0].as_py()
            r, unit, node, copies, t = rotations(d, bits, tables), unit_rows(rows["v"].to_pylist(), d), np.asarray(rows["node"]), np.asarray(rows["copies"]), np.asarray(rows["t"])
            keys, total = r.buckets(r.signs(rows["code"].to_pylist())), np.zeros(len(rows), dtype=np.int64)
            edges: list[tuple[int, int]] = []
            for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                left, right, same = sides(rows, s, e)
                part = np.arange(s, e)
                for b in range(0, len(left), 256):
                    x = left[b : b + 256]
                    link = unit[x] @ unit[right].T >= similarity
                    if same:
                        link &= x[:, None] < right[None, :]
                    p, q = np.nonzero(link)
                    if t[s] and len(p):
                        link[p, q] = ~(keys[x[p], : t[s]] == keys[right[q], : t[s]]).any(axis=1)
                    total[x] += link @ copies[right]
                    total[right] += copies[x] @ link
                    for i in np.flatnonzero(link.any(axis=1)).tolist():
                        mates = right[link[i]] - s
                        _, new = np.unique(part[mates], return_index=True)
                        mine = part[x[i] - s]
                        for m in mates[new].tolist():
                            if part[m] != mine:
                                edges.append((int(node[x[i]]), int(node[s + m])))
                                part[part == part[m]] = mine
            some = np.flatnonzero(total)
            a = np.concatenate([node[some], np.array([x for x, _ in edges], dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array([None] * len(some) + [y for _, y in edges], pa.int64()), pa.array([*total[some].tolist(), *[None] * len(edges)], pa.int64())], schema=FOUND)

    return run


def similar(classes: DataFrame, n: int, similarity: float) -> DataFrame:
    """classes: (node, v as doubles, copies), a row per different vector. Numbers of links and a spanning forest of them."""
    bits, tables = sizes(n, similarity)
    codes = stage_table(classes.select("node", "v", "copies").mapInArrow(encoded(bits, tables), CODES_DDL), "codes")
    rows = codes.select("d", "code", "node").mapInArrow(bucket_rows(bits, tables), "d int, t int, bucket long, node long")
    counted = rows.groupBy("d", "t", "bucket").agg(F.count("*").alias("k")).where("k > 1")
    # a bucket of k vectors is dealt into c chunks and the pairs of chunks are compared; a pair of unequal chunks has two sides
    multi = rows.join(counted, ["d", "t", "bucket"]).withColumn("c", F.ceil(F.col("k") / CHUNK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", "t"), F.col("c")).cast("int"))
    dealt = multi.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select("d", "t", "bucket", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    met = lambda df: df.repartition(*KEYS).sortWithinPartitions(*KEYS)
    coded = met(dealt.join(codes.drop("d"), "node").select(*KEYS, "side", "node", "copies", "code", "factor", "coarse", "scale"))
    near = stage_table(coded.mapInArrow(candidate_rows(bits, tables, similarity), MET_DDL), "near")
    full = met(near.join(classes.select("node", "v"), "node").select(*KEYS, "side", "node", "copies", "code", "v"))
    return stage_table(full.mapInArrow(linked_rows(bits, tables, similarity), "a long, b long, n long"), "links")


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = 0.95) -> DataFrame:
    """One row per row of embeddings: id_col, n_links (others linked directly), component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths never link. Vectors with equal bytes, once scaled by their largest component, are one class and linked with
    each other. A null identifier is ignored where a component's smallest is chosen; kept is null-safe equality with
    that. Repeated rows count as other vectors, and each keeps if its identifier is the smallest. An empty table gives
    no rows. Other columns are not read.
    """
    rows = embeddings.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("v"))
    named = stage_table(rows.mapInArrow(as_bytes, "id long, v binary"), "vectors")
    grouped = named.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stage_table(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = similar(classes, classes.count(), similarity)
    others = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    placed = components(found.where("b is not null").select("a", "b"))
    each = classes.join(others, "node", "left").join(placed, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = each.groupBy("part").agg(F.min("rep").alias("component_id"))
    labels = each.join(least, "part").select("v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    some = named.where("v is not null").join(labels, "v").select("id", "n_links", "component_id")  # by bytes; a row per class
    none = named.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return some.union(none).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
