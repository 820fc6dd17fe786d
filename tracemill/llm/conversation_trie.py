"""Prefix trie of conversations by truncation peeling.

A node of depth d is a distinct sequence of d turns that some conversation starts with. From the longest conversations
down, each level is made of the conversations that end there and of the surviving nodes of the level below with their last
turn stripped, regrouped. Regrouping adds up what a node knows of its subtree (members, children, leaves, tokens), so nodes
are discovered and aggregated in one pass.

A conversation's path is its turns' hashes in a row (16 bytes of the SHA-256 of role and text), and equal paths are one row
before anything else. Paths are sorted over ranges, so a node's members lie side by side, and each chunk of CHUNK turns is
peeled on its own. Only nodes on the paths of a chunk's first and last rows can have members elsewhere: what the chunk knows
of those goes on as two rows a chunk, partial sums along a path, which are sorted and peeled in the same way until one chunk
holds all. So a first turn in a third of all conversations is two rows a chunk, and the number of jobs depends on the number
of chunks alone, not on the longest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, quoted, stage_table
from .rows import batch

#: Turns of a chunk, bytes of a turn's hash, numbers that a node adds up: members, smallest member, children, leaves, saved tokens.
CHUNK, HASH, SUMS = 1 << 16, 16, 5
NONE = np.iinfo(np.int64).max  # no member
RECORDS = "path binary, words binary, sums binary"
PEELED = "path binary, words binary, sums binary, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, pos from 1, role, text): turns in order, null turns first, ties by role and text; null role and text are empty.

    Rows without an identifier belong to no conversation.
    """
    each = rows.where("conv is not null").select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return each.select("conv", F.row_number().over(order).alias("pos"), "role", "text")


def renamed(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    return rows.select(quoted(id_col).cast("long").alias("conv"), quoted(turn_col).alias("turn"), quoted(role_col).alias("role"), quoted(text_col).alias("text"))


def with_heads(turns: DataFrame, head_of: Column, size: Column) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that start with another's head, and all conversations (some may have no turns left).

    Of numbered turns: conversation c gets the first `size` turns of conversation `head_of` (both of column conv), then its
    own after its first `size`. A head is at most as long as `size` says, and is joined once to each conversation that
    starts with it.
    """
    convs = turns.where("pos = 1").select("conv", head_of.alias("base"), size.alias("h"))
    own = turns.withColumn("h", size).where("pos > h").select("conv", F.lit(1).alias("part"), "pos", "role", "text")
    heads = turns.select(F.col("conv").alias("base"), "pos", "role", "text")
    most = convs.agg(F.coalesce(F.max("h"), F.lit(0))).first()[0]
    lent = convs.join(heads.where(F.col("pos") <= most), "base").where("pos <= h").select("conv", F.lit(0).alias("part"), "pos", "role", "text")
    return lent.union(own), convs.select("conv")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, path, words): each conversation's turns in order as hashes in a row, and their numbers of words."""
    size = F.octet_length("role").cast("string")  # where the role ends
    h = F.substring(F.sha2(F.concat(size, F.lit(":"), "role", "text").cast("binary"), 256), 1, 2 * HASH)
    w = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    each = turns.select("conv", F.struct("part", "pos", h.alias("h"), w.alias("w")).alias("t"))
    grouped = each.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    out = convs.join(grouped, "conv", "left").select("conv", F.coalesce("t", F.array().cast(grouped.schema["t"].dataType)).alias("t"))
    return out.select("conv", F.unhex(F.array_join(F.transform("t", lambda t: t.h), "")).alias("path"), F.transform("t", lambda t: t.w).alias("words"))


def recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of (path, words, conv_id, n): members at a path's end."""
    for rows in batches:
        out = []
        for words, conv, n in zip(*(rows.column(c).to_pylist() for c in ("words", "conv_id", "n")), strict=True):
            sums = np.zeros((SUMS, len(words) + 1), dtype=np.int64)
            sums[1] = NONE
            sums[:2, -1] = n, conv
            out.append((np.array(words, dtype="<i8").tobytes(), sums.tobytes()))
        yield batch([rows.column("path"), *([list(c) for c in zip(*out, strict=True)] or [[], []])], RECORDS)


class Record:
    """A path with what is known of its nodes, from the root: sums without those of children that have a record elsewhere."""

    def __init__(self, path: bytes, words: bytes, sums: bytes):
        self.path, self.words = path, np.frombuffer(words, dtype="<i8")
        self.sums = np.frombuffer(sums, dtype=np.int64).reshape(SUMS, -1)
        self.depth, digest = len(self.words), hashlib.sha256()
        self.names = [digest.digest()]
        for d in range(self.depth):
            digest.update(path[d * HASH : (d + 1) * HASH])
            self.names.append(digest.digest())


def peeled(records: list[Record], whole: bool) -> tuple[list[tuple], list[tuple]]:
    """Nodes that lie in the records alone, and records of what is known of the others. whole: there are no other records."""
    ends: dict[int, list[Record]] = {}
    for r in records:
        for d in np.flatnonzero(r.sums[1] < NONE).tolist():
            ends.setdefault(d, []).append(r)
    first, last = records[0], records[-1]
    open_ = {} if whole else {name: (r, d) for r in (last, first) for d, name in enumerate(r.names)}
    parts = {id(r): np.zeros((SUMS, r.depth + 1), dtype=np.int64) for r in (first, last)}
    for sums in parts.values():
        sums[1] = NONE
    nodes: list[list] = []
    below: dict[bytes, list] = {}
    for depth in range(max(r.depth for r in records), -1, -1):
        level, below = below, {}
        for r in ends.get(depth, ()):  # newly ended ones join the survivors
            n, conv, children, leaves, saved = r.sums[:, depth].tolist()
            own = level.get(r.names[depth])
            if own is None:
                level[r.names[depth]] = [n, conv, children, leaves, saved, r, []]
            else:
                own[0] += n
                own[1] = min(own[1], conv)
                own[2] += children
                own[3] += leaves
                own[4] += saved
        for name, (n, conv, children, leaves, saved, r, kids) in level.items():
            if name in open_:
                at, d = open_[name]
                parts[id(at)][:, d] = n, conv, children, leaves, saved
                continue
            leaves = leaves if children else 1
            saved += (n - 1) * int(r.words[depth - 1]) if depth else 0
            for k in kids:
                nodes[k][4] = conv
            nodes.append([name, r.names[depth - 1] if depth else None, depth, conv, None, n, children, leaves, saved])
            if depth:  # strip the last turn
                up = below.get(r.names[depth - 1])
                if up is None:
                    below[r.names[depth - 1]] = [n, conv, 1, leaves, saved, r, [len(nodes) - 1]]
                else:
                    up[0] += n
                    up[1] = min(up[1], conv)
                    up[2] += 1
                    up[3] += leaves
                    up[4] += saved
                    up[6].append(len(nodes) - 1)
    rest = [] if whole else [(r.path, r.words.tobytes(), parts[id(r)].tobytes()) for r in dict.fromkeys((first, last))]
    return [tuple(n) for n in nodes], rest


def chunks(whole: bool, most: int):
    """Peels sorted records, `most` turns at a time unless they are the whole."""

    def out(records: list[Record]) -> Iterator[pa.RecordBatch]:
        nodes, rest = peeled(records, whole)
        for s in range(0, len(nodes), 1 << 14):
            part = [list(c) for c in zip(*nodes[s : s + (1 << 14)], strict=True)]
            yield batch([[None] * len(part[0])] * 3 + part, PEELED)
        for row in rest:
            yield batch([[x] for x in row] + [[None]] * 9, PEELED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in batches:
            for path, words, sums in zip(*(rows.column(c).to_pylist() for c in ("path", "words", "sums")), strict=True):
                held.append(Record(path, words, sums))
                size += held[-1].depth + 1
                if size >= most and not whole:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    return run


def prefix_trie(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of turns (conv, part, pos, role, text), ordered by part and pos, and all conversations (conv).

    nodes: node and parent (names), conv_id (the smallest member), depth, parent_conv_id, n_convs (members), n_children,
    n_leaves (childless nodes in the subtree, itself among them), saved_tokens (over the subtree: members but one, times
    words of the last turn). ends: (node, id), the conversations that end at a node. The root has depth 0 and no turns;
    conversations without turns end there. No conversations give no rows. A conversation's hashes are one row.
    """
    every = stage_table(paths(turns, convs), "paths")
    same = every.groupBy("path", "words").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n"))
    records = stage_table(same.mapInArrow(recorded, RECORDS), "records")
    columns = [c.split()[0] for c in PEELED.split(", ")]
    levels = []
    while True:
        turns_left, longest = records.agg(F.coalesce(F.sum(F.octet_length("words") / 8 + 1), F.lit(0)).cast("long"), F.coalesce(F.max(F.octet_length("words") / 8 + 1), F.lit(0)).cast("long")).first()
        size = max(chunk, 16 * longest)  # a chunk's two rows are a part of it
        whole = turns_left <= size
        dealt = records.repartition(1) if whole else records.repartitionByRange(-(-turns_left // size), "path")
        levels.append(stage_table(dealt.sortWithinPartitions("path").mapInArrow(chunks(whole, size), PEELED), "peeled"))
        if whole:
            break
        records = levels[-1].where("path is not null").select(*[c.split()[0] for c in RECORDS.split(", ")])
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    nodes = out.where("node is not null").select(*columns[3:])
    # where a node's parent lies in more than one chunk, its member is known from a later level
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("found"))
    later = nodes.where("parent_conv_id is null and depth > 0").join(above, "parent")
    done = nodes.where("parent_conv_id is not null or depth = 0")
    joined = later.withColumn("parent_conv_id", F.col("found")).select(*columns[3:]).union(done.select(*columns[3:]))
    return joined, every.select(F.unhex(F.sha2("path", 256)).alias("node"), F.col("conv").alias("id"))
