"""N-gram Jaccard join on count vectors.

A document's set holds its distinct shingles. Shingles are hashed into groups, and a set is the point of its group
counts. The overlap of two sets is at most the sum of the smaller of each pair of coordinates; pairs whose bound falls
short are dropped, the others are verified on the sets.

One R-tree over all coordinates does not prune: the box around a leaf of unrelated points has large maxima in every
coordinate, and its bound reaches every size (README gives figures). So the index is a forest. Sets are cut into bands by size, so that a link
joins neighbouring bands at most. The sets of a link differ in D shingles at most; the groups of a band are dealt into
D + 1 blocks, one tree each over its own coordinates, and at least one block of a link's two points agrees in all its
coordinates. So a leaf is the points with equal coordinates in a block, and a probe reads one leaf a tree. Blocks with
under three shingles say little and are not indexed; where the agreeing blocks of a link could all be such (short
texts), more forests with other hashes are kept, until the chance of that is under MISS for each link. Beyond 300 blocks
a third of them, 100 and more, agree at a link's worst, so one forest is enough.

A leaf's points are compared with its smallest alone (all pairs in a leaf of four or fewer). Leaves whose points are not
all in one component of the links so found are opened. Leaves that share most of their points are gathered into one group,
so that a point comes in few groups however many leaves it lies in. A group is cut into pages, the points of its largest
component first, and pairs of pages that can hold a link between components are compared in one task each, which emits
a spanning forest of such links and never a pair that is no link. So no link between components is lost, no group emits
all of its pairs, and the pages of a large component meet those of points outside it alone. Points are distinct sets:
copies collapse before anything is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, mix, planes, slices, spans, stage_table, text_bytes, unplanes, word_hashes

GROUPS = 64
#: Shingles that a block needs to be indexed, chance of missing a link just at the threshold, points of a leaf that are
#: compared all with all, points of a leaf that a task ships before it keeps its smallest alone, entries held by a task.
LEAST, MISS, SMALL_LEAF, LOCAL_LEAF, FLUSH = 3, 1e-6, 4, 64, 1_500_000
SHARD_BYTES = 6 << 20
#: Shingles and points of a page at most, on average, and points of a box.
PAGE_SHINGLES, PAGE, BOX = 1 << 19, 2048, 32
ENTRY, PAIR, MEMBER, HOT = 0, 1, 2, 3

SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("counts", pa.binary())])
SHIPPED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
LEAVES = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
SETS = pa.schema([("sid", pa.int64()), ("shingles", pa.binary())])


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, in one array, and the starts (one more at the end)."""
    h, _, starts = word_hashes(texts, lower=True)
    n = np.diff(starts)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - starts[of]
    # a text with fewer words has one shingle, its whole sequence
    length = np.minimum(width, n)[of]
    ok = place + length <= n[of]
    value = mix(h + length.astype(np.uint64))
    for i in range(1, width):
        more = np.zeros(len(h), dtype=np.uint64)
        more[: len(h) - i] = h[i:] if i < len(h) else 0
        value = np.where(length > i, mix(value * np.uint64(0x9E3779B97F4A7C15) + more), value)
    of, value = of[ok], value[ok]
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])]) if len(of) else np.zeros(0, dtype=bool)
    of, value = of[new], value[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))]).astype(np.int64)


def set_ids(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, the same for equal sets."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values), dtype=np.uint64)])
    odd = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    x, y = total[starts[1:]] - total[starts[:-1]], odd[starts[1:]] - odd[starts[:-1]]
    return mix(x ^ mix(y + np.diff(starts).astype(np.uint64))).view(np.int64)


def signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, starts = shingle_sets(part["text"], width)
                n, sid = np.diff(starts), set_ids(values, starts)
                of = np.repeat(np.arange(len(n)), n)
                counts = np.bincount(of * GROUPS + (values >> np.uint64(58)).astype(np.int64), minlength=GROUPS * len(n)).astype("<u4").reshape(-1, GROUPS)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(n), pa.array(sid), pa.array([c.tobytes() for c in counts], pa.binary())], schema=SIGNED)

    return run


def share_of(similarity: float) -> tuple[int, int]:
    """The threshold as a fraction of whole numbers, so that sizes are compared exactly."""
    num, den = round(similarity * 1000), 1000
    g = math.gcd(num, den)
    return num // g, den // g


@cache
def bands(num: int, den: int, most: int) -> tuple[int, ...]:
    """Largest size of each band: sizes of a link lie in one band or in two neighbours."""
    out, low = [], 1
    while not out or out[-1] < most:
        out.append(low * den // num)
        low = out[-1] + 1
    return tuple(out)


@cache
def layout(num: int, den: int, high: int) -> tuple[int, int]:
    """Blocks and forests for pairs whose larger set has `high` shingles at most."""
    d = 2 * high * (den - num) // (den + num)
    m = d + 1
    if m == 1 or m > 300:
        return m, 1
    # chance for each number of blocks without a difference, after d differences fall anywhere
    free = [0.0] * (m + 1)
    free[m] = 1.0
    for _ in range(d):
        free = [free[a] * (m - a) / m + (free[a + 1] * (a + 1) / m if a < m else 0.0) for a in range(m + 1)]
    common = max(1, high * num // (den + num) * 2 * num // den)
    p, light = 1 / m, 0.0
    for k in range(min(LEAST, common + 1)):
        light += math.comb(common, k) * p**k * (1 - p) ** (common - k)
    lost = sum(f * light**a for a, f in enumerate(free))
    return m, max(1, math.ceil(math.log(MISS) / math.log(max(lost, 1e-300)))) if lost < 1 else 24


def least_for(high: int, m: int) -> int:
    """Tiny sets have few shingles in any block, so there a block with one is indexed."""
    return LEAST if m > 1 and high > 24 else 1


def entries(values: np.ndarray, starts: np.ndarray, sid: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf keys of each set and the set's name."""
    n = np.diff(starts)
    if not n.any():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    edges = np.array(bands(num, den, int(n.max()) * 2 + 2))
    band = np.searchsorted(edges, n)
    keys, names = [], []
    for k in np.unique(band[n > 0]).tolist():
        for high_band in (k, k + 1):
            high = int(edges[high_band])
            m, forests = layout(num, den, high)
            own = np.flatnonzero((band == k) & (n > 0))
            size = n[own]
            at = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            row = np.repeat(np.arange(len(own)), size)
            v = values[at]
            for f in range(forests):
                u = mix(v ^ np.uint64((high_band * 64 + f + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                block = ((u >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                weight = mix(u & np.uint64(0xFFFFFFFF))  # of the shingle's group within its block
                cell = row * m + block
                cells = len(own) * m
                count = np.bincount(cell, minlength=cells)
                # the point's coordinates in a block, folded into one number: a sum over groups of count times weight
                x = np.bincount(cell, weights=(weight & np.uint64((1 << 30) - 1)).astype(np.float64), minlength=cells).astype(np.uint64)
                y = np.bincount(cell, weights=(weight >> np.uint64(34)).astype(np.float64), minlength=cells).astype(np.uint64)
                full = np.flatnonzero(count >= least_for(high, m))
                place = np.uint64(((high_band * 64 + f) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF) + (full % m).astype(np.uint64)
                keys.append(mix(mix(x[full] ^ mix(place)) + y[full]))
                names.append(sid[own][full // m])
    return np.concatenate(keys), np.concatenate(names)


def leaf_runs(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct entries, and start and size of each leaf."""
    order = np.lexsort((names, keys))
    keys, names = keys[order], names[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])]) if len(keys) else np.zeros(0, dtype=bool)
    keys, names = keys[new], names[new]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys, names, start, np.diff(np.append(start, len(keys)))


def stars(names: np.ndarray, start: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest) of the chosen leaves."""
    keep = np.repeat(chosen, size)
    first = np.repeat(names[start], size)
    pick = keep & (names != first)
    return names[pick], first[pick]


def ship(num: int, den: int, width: int, shard_bits: int):
    def pack(kind: int, shard: np.ndarray, a: np.ndarray, b: np.ndarray, rows: list[tuple]) -> None:
        order = np.lexsort((a, shard))
        shard, a, b = shard[order], a[order].view(np.uint64), b[order].view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, dtype=np.int64)
        for s, e in spans(start, len(shard)):
            rows.append((int(shard[s]), kind, planes(np.diff(a[s:e], prepend=np.uint64(0)), 8), planes(b[s:e], 8)))

    def flushed(keys: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        """An entry ships its key and a place in its row's list of names."""
        rows: list[tuple] = []
        place = lambda k: (k >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(k), dtype=np.int64)
        keys, names, start, size = leaf_runs(keys, names)
        hot = size > LOCAL_LEAF
        if hot.any():
            m, first = stars(names, start, size, hot)
            both = np.unique(np.stack([m, first], axis=1), axis=0)
            spread = (mix(both[:, 0].astype(np.int64).view(np.uint64)) % np.uint64(1 << shard_bits)).astype(np.int64)
            pack(PAIR, spread, both[:, 0], both[:, 1], rows)
            own = np.repeat(hot, size)
            spread = (mix(names[own].view(np.uint64)) % np.uint64(1 << shard_bits)).astype(np.int64)
            pack(MEMBER, spread, keys[own].view(np.int64), names[own], rows)
            marked = keys[start[hot]].view(np.int64)
            pack(HOT, place(keys[start[hot]]), marked, np.zeros_like(marked), rows)
        keep = ~np.repeat(hot, size)
        keep[start] = True
        keys, names = keys[keep], names[keep]
        shard = place(keys)
        start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, dtype=np.int64)
        for s, e in spans(start, len(shard)):
            own, at = np.unique(names[s:e], return_inverse=True)
            rows.append((int(shard[s]), ENTRY, planes(np.diff(keys[s:e], prepend=np.uint64(0)), 8), np.array([len(own)], dtype="<u8").tobytes() + own.astype("<i8").tobytes() + planes(at.astype(np.uint64), 3)))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SHIPPED.types, strict=True)], schema=SHIPPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, held, seen = [], [], 0, set()
        for batch in batches:
            for part in slices(batch, "text"):
                values, starts = shingle_sets(part["text"], width)
                sid = set_ids(values, starts)
                new = []
                for i, s in enumerate(sid.tolist()):
                    if s not in seen:
                        seen.add(s)
                        new.append(i)
                new = np.array(new, dtype=np.int64)
                size = np.diff(starts)[new]
                at = np.repeat(starts[new] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                k, s = entries(values[at], np.concatenate([[0], np.cumsum(size)]), sid[new], num, den)
                keys.append(k)
                names.append(s)
                held += len(k)
                if held >= FLUSH:
                    yield flushed(np.concatenate(keys), np.concatenate(names))
                    keys, names, held = [], [], 0
        if held:
            yield flushed(np.concatenate(keys), np.concatenate(names))

    return run


def leaves(part: pa.Table) -> pa.Table:
    """Of one range of leaf keys: pairs to compare, and the members of leaves whose pairs are not all compared."""
    out, keys, names, hot = [], [], [], [np.zeros(0, dtype=np.uint64)]
    for kind, a, b in zip(part["kind"].to_pylist(), part["a"].to_pylist(), part["b"].to_pylist(), strict=True):
        first = np.cumsum(unplanes(a, 8), dtype=np.uint64)
        if kind == ENTRY:
            n = int(np.frombuffer(b, dtype="<u8", count=1)[0])
            own = np.frombuffer(b, dtype="<i8", count=n, offset=8)
            keys.append(first)
            names.append(own[unplanes(b[8 + 8 * n :], 3).astype(np.int64)])
        elif kind == HOT:
            hot.append(first)
        else:
            out.append((kind, first.view(np.int64), unplanes(b, 8).view(np.int64)))
    if keys:
        keys, names, start, size = leaf_runs(np.concatenate(keys), np.concatenate(names))
        pairs = [np.stack(stars(names, start, size, size > 1), axis=1)]
        for k in range(3, SMALL_LEAF + 1):
            at = start[size == k]
            pairs += [np.stack([names[at + j], names[at + i]], axis=1) for i, j in combinations(range(1, k), 2)]
        both = np.unique(np.concatenate(pairs), axis=0)
        out.append((PAIR, both[:, 0], both[:, 1]))
        # points beside those that a task kept to itself are few here, but their leaf is not
        big = np.repeat((size > SMALL_LEAF) | ((size > 1) & np.isin(keys[start], np.concatenate(hot))), size)
        out.append((MEMBER, keys[big].view(np.int64), names[big]))
    kinds = np.concatenate([np.full(len(a), k, dtype=np.int32) for k, a, _ in out]) if out else np.zeros(0, dtype=np.int32)
    join = lambda i: np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64)
    return pa.table([pa.array(kinds), pa.array(join(1)), pa.array(join(2))], schema=LEAVES)


def within_bound(num: int, den: int):
    """Pairs whose sizes and summed coordinate minima allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = np.asarray(batch["na"]), np.asarray(batch["nb"])
            of = lambda c: np.frombuffer(b"".join(batch[c].to_pylist()), dtype="<u4").reshape(-1, GROUPS)
            bound = np.minimum(of("ca"), of("cb")).sum(axis=1) if batch.num_rows else np.zeros(0)
            ok = bound.astype(np.int64) * den >= num * (na + nb - bound.astype(np.int64))
            keep = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([keep["a"], keep["b"]], names=["a", "b"])

    return run


def named_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, starts = shingle_sets(part["text"], width)
                low = values >> np.uint64(16)
                rows = [planes(np.diff(low[s:e], prepend=np.uint64(0)), 6) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(values, starts)), pa.array(rows, pa.binary())], schema=SETS)

    return run


def verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True):
                x, y = np.cumsum(unplanes(x, 6)), np.cumsum(unplanes(y, 6))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(common * den >= num * (len(x) + len(y) - common))
            keep = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep["a"], keep["b"]], names=["a", "b"])

    return run


def links(pairs: DataFrame, points: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different sets that reach the threshold, of those given."""
    side = lambda s: points.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("counts").alias(f"c{s}"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(within_bound(num, den), "a long, b long")
    of = lambda s: sets.select(F.col("sid").alias(s), F.col("shingles").alias(f"s{s}"))
    return near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(verified(num, den), "a long, b long")


def set_table(need: DataFrame, points: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The shingles of the points named."""
    rows = points.join(need, "sid").select(F.col("rep").alias("id_")).distinct()
    texts = docs.join(rows, F.col("id").eqNullSafe(F.col("id_")), "left_semi").select("text")
    return stage_table(texts.mapInArrow(named_sets(width), "sid long, shingles binary").dropDuplicates(["sid"]), "sets")


def boxes(counts: np.ndarray, n: np.ndarray, points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Leaves of an R-tree over some points, in the order of their counts, with each leaf's largest counts and smallest size."""
    points = points[np.lexsort((n[points], *counts[points, :8].T))]
    leaves = [points[k : k + BOX] for k in range(0, len(points), BOX)]
    return leaves, np.stack([counts[own].max(axis=0) for own in leaves]), np.array([n[own].min() for own in leaves])


def summed_minima(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bound of every pair of rows."""
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for g in range(x.shape[1]):
        out += np.minimum(x[:, g][:, None], y[:, g][None, :])
    return out


def compared(num: int, den: int):
    """Of one pair of pages: a spanning forest of the links between points of different components, as pairs of those."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key[1:])
        component, page = np.asarray(rows["component"]), np.asarray(rows["page"])
        sets = [np.cumsum(unplanes(x, 6), dtype=np.uint64) for x in rows["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets], dtype=np.int64)
        counts = np.stack([np.bincount((x >> np.uint64(42)).astype(np.int64), minlength=GROUPS) for x in sets]).astype(np.int32)
        part = np.unique(component, return_inverse=True)[1]
        left, right = np.flatnonzero(page == i), np.flatnonzero(page == j)
        edges: list[tuple[int, int]] = []
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        (xs, x_box, x_least), (ys, y_box, y_least) = boxes(counts, n, left), boxes(counts, n, right)
        near = summed_minima(x_box, y_box) * (den + num) >= num * (x_least[:, None] + y_least[None, :])
        for k, x in enumerate(xs):
            mates = [ys[m] for m in np.flatnonzero(near[k]).tolist()]
            if not mates:
                continue
            y = np.concatenate(mates)
            both = n[x][:, None] + n[y][None, :]
            ok = part[x][:, None] != part[y][None, :]
            if i == j:
                ok &= x[:, None] < y[None, :]
            ok &= np.minimum(n[x][:, None], n[y][None, :]) * den >= np.maximum(n[x][:, None], n[y][None, :]) * num
            if not ok.any():
                continue
            ok &= summed_minima(counts[x], counts[y]) * (den + num) >= num * both
            rows_, cols = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            if not len(rows_):
                continue
            common = overlaps([sets[r] for r in x[rows_]], [sets[c] for c in y[cols]])
            linked = ok[np.ix_(rows_, cols)] & (common * (den + num) >= num * both[np.ix_(rows_, cols)])
            for r, c in zip(*np.nonzero(linked), strict=True):
                u, v = x[rows_[r]], y[cols[c]]
                if part[u] != part[v]:
                    edges.append((int(component[u]), int(component[v])))
                    part[part == part[v]] = part[u]
        return pa.table([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Sizes of all intersections of two lists of ascending arrays, by products of their incidence matrices."""
    shared = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    out = np.zeros((len(xs), len(ys)), dtype=np.float64)
    where = lambda sets: (np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets))
    (rx, vx), (ry, vy) = where(xs), where(ys)
    for at in range(0, len(shared), step):
        part = shared[at : at + step]
        a, b = np.zeros((len(xs), len(part)), dtype=np.float32), np.zeros((len(ys), len(part)), dtype=np.float32)
        for m, r, v in ((a, rx, vx), (b, ry, vy)):
            own = (v >= part[0]) & (v <= part[-1])
            k = np.searchsorted(part, v[own])
            hit = part[k] == v[own]
            m[r[own][hit], k[hit]] = 1
        out += a @ b.T
    return out.astype(np.int64)


def gathered(members: DataFrame) -> DataFrame:
    """(first, sid): groups of points, so that each leaf lies whole in one of them.

    At first a group is all leaves with one smallest point. Groups of near copies overlap, so a leaf then goes to the
    largest group that holds any of its points, if the points which that group lacks bring fewer rows than are saved.
    """
    first = members.groupBy("leaf").agg(F.min("sid").alias("first"))
    placed = stage_table(members.join(first, "leaf").select("leaf", "sid", "first"), "members")
    own = stage_table(placed.select("first", "sid").distinct(), "groups")
    largest = own.join(own.groupBy("first").agg(F.count("*").alias("size")), "first").groupBy("sid").agg(F.max(F.struct("size", "first")).alias("hub"))
    asked = placed.join(largest, "sid").groupBy("leaf", "first").agg(F.max("hub").alias("hub"), F.count("*").alias("points")).where("hub.first <> first")
    asked = placed.join(asked.select("leaf", F.col("hub.first").alias("to"), "hub.size", "points"), "leaf").select("leaf", "sid", "to", "size", "points")
    held = own.select(F.col("first").alias("to"), "sid", F.lit(1).alias("held"))
    lacks = asked.join(held, ["to", "sid"], "left").groupBy("leaf", "to", "size", "points").agg(F.count("*").alias("all"), F.count("held").alias("held"))
    moved = lacks.where((F.col("all") - F.col("held")) * F.greatest(F.lit(1.0), F.col("size") / PAGE) * 2 <= F.col("points")).select("leaf", "to")
    return placed.join(moved, "leaf", "left").select(F.coalesce("to", "first").alias("first"), "sid").distinct()


def dealt(group: DataFrame, num: int, den: int) -> DataFrame:
    """Points of (first, sid, n, component) by pairs of pages (first, i, j), without pairs that can hold no link between components.

    A group that fits one page is that page. Points of others lie in their pages in the order of size, those of the
    group's largest component first, so that its pages meet the pages of other points alone, and only of sizes that link.
    """
    load = F.greatest(F.count("*") / PAGE, F.sum("n") / PAGE_SHINGLES)
    open_ = group.groupBy("first").agg(F.min("component").alias("low"), F.max("component").alias("high"), load.alias("load")).where("low <> high").select("first", "load")
    rows = group.join(open_, "first")
    single = rows.where("load <= 1").select("first", F.lit(0).alias("page"), F.lit(0).alias("i"), F.lit(0).alias("j"), "sid", "component")
    rows = rows.where("load > 1").drop("load")
    main = rows.groupBy("first", "component").agg(F.count("*").alias("size")).groupBy("first").agg(F.max(F.struct("size", "component")).alias("main"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)) if den > num else F.col("n")
    rows = rows.join(main, "first").select("first", "sid", "n", "component", (F.col("component") != F.col("main.component")).alias("other"), band.cast("int").alias("band"))
    # strata are few; a point's place in its own is its hash
    before = Window.partitionBy("first").orderBy("other", "band").rowsBetween(Window.unboundedPreceding, -1)
    strata = rows.groupBy("first", "other", "band").agg(load.alias("load")).withColumn("before", F.coalesce(F.sum("load").over(before), F.lit(0.0)))
    place = F.pmod(F.xxhash64("sid"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    paged = rows.join(strata, ["first", "other", "band"]).select("first", F.floor(F.col("before") + F.col("load") * place).cast("int").alias("page"), "sid", "n", "component")
    paged = stage_table(paged, "pages")
    page = paged.groupBy("first", "page").agg(*(f(c).alias(f"{k}_{c}") for c in ("n", "component") for k, f in (("low", F.min), ("high", F.max))))
    x, y = page.alias("x"), page.alias("y")
    sizes = (F.col("x.high_n") * den >= F.col("y.low_n") * num) & (F.col("y.high_n") * den >= F.col("x.low_n") * num)
    apart = F.least("x.low_component", "y.low_component") != F.greatest("x.high_component", "y.high_component")
    pairs = x.join(y, (F.col("x.first") == F.col("y.first")) & (F.col("x.page") <= F.col("y.page")) & sizes & apart).select("x.first", F.col("x.page").alias("i"), F.col("y.page").alias("j"))
    sides = pairs.select("first", F.col("i").alias("page"), "i", "j").union(pairs.where("i < j").select("first", F.col("j").alias("page"), "i", "j"))
    return single.union(paged.join(sides, ["first", "page"]).select("first", "page", "i", "j", "sid", "component"))


def opened(members: DataFrame, known: DataFrame, points: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the known components (node, component) of points that lie in one leaf, as pairs of components."""
    own = known.select(F.col("node").alias("sid"), "component")
    group = gathered(members).join(points.select("sid", "n"), "sid").join(own, "sid", "left").select("first", "sid", "n", F.coalesce("component", "sid").alias("component"))
    rows = dealt(stage_table(group, "opened"), num, den).join(sets, "sid")
    return rows.groupBy("first", "i", "j").applyInArrow(compared(num, den), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable by links, itself included).

    Words are split at ASCII white space after lower-casing A-Z; a text with fewer than `width` words has its whole
    sequence as one shingle, and null or empty texts have none and link with nothing. Two texts link when their sets'
    Jaccard similarity is at least `similarity` (to a thousandth). Repeated rows are in one component. A null
    identifier is ignored where a component's smallest is chosen; a component with none has null. An empty table gives
    no rows. Other columns are not read.
    """
    num, den = share_of(similarity)
    shard_bits = max(0, (max(1, text_bytes(docs, text_col) // SHARD_BYTES) - 1).bit_length())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stage_table(rows.mapInArrow(signatures(width), "id long, n long, sid long, counts binary"), "points")
    points = signed.where("n > 0").groupBy("sid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("counts").alias("counts"))
    found = stage_table(rows.mapInArrow(ship(num, den, width, shard_bits), "shard int, kind int, a binary, b binary").groupBy("shard").applyInArrow(leaves, "kind int, a long, b long"), "leaves")
    pairs = found.where(f"kind = {PAIR}").select("a", "b").distinct()
    members = found.where(f"kind = {MEMBER}").select(F.col("a").alias("leaf"), F.col("b").alias("sid")).distinct()
    sets = set_table(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(members.select("sid")).distinct(), points, rows, width)
    sure = stage_table(links(pairs, points, sets, num, den), "links")
    known = stage_table(components(sure), "known")
    joined = stage_table(components(opened(members, known, points, sets, num, den)), "components")
    # components that opened leaves join, and the points in them
    whole = known.join(joined.select(F.col("node").alias("component"), F.col("component").alias("all")), "component", "left")
    joined = whole.select("node", F.coalesce("all", "component").alias("component")).union(joined).distinct()
    placed = signed.select("id", "n", "sid").join(joined, F.col("sid") == F.col("node"), "left").select("id", "n", F.coalesce("component", "sid").alias("component"))
    least = placed.where("n > 0").groupBy("component").agg(F.min("id").alias("least"))
    some = placed.where("n > 0").join(least, "component").select("id", "n", "least")
    none = placed.where("n = 0").select("id", "n", F.col("id").alias("least"))
    return some.union(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
