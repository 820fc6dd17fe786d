"""Exact dedup by Patricia-trie owners.

Texts count as equal when identical after lower-casing A-Z; null counts as empty. Texts are dealt by length and a few
bits of a content hash, and whole byte strings of one such part are inserted into a compressed radix trie, so equality
is of bytes, never of hashes. A terminal node stores the owner's identifier and row and the count.

First, each task collapses its own copies in tries, one for each part, and gives every row the number of its terminal;
a group of copies that holds a third of all rows thus goes on as one string a task. Tries over their budget are spilled
by subtree, those of the largest trie first; a spilled string that comes again opens another terminal. Second, the strings of all tasks meet by
part in the order of their bytes, a sort that Spark spills to disk. A trie that is filled in this order is complete to
the left of its last path, so those subtrees are settled and dropped at once, and a task holds one path. Each terminal
of the first step learns its owner from the terminal it ended in, and rows are labelled through their terminals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, quoted, slices, stage_table

#: Distinct bytes that a task keeps in its tries, what a terminal takes beside its string, bits of the content hash that
#: deal strings of one length.
TRIE_BYTES, NODE_BYTES, BITS = 48 << 20, 500, 12

LOCAL = pa.schema([("terminal", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("length", pa.int64()), ("bits", pa.int32()), ("body", pa.binary())])
LOCAL_DDL = "terminal long, row long, id long, n long, length long, bits int, body binary"
SETTLED = pa.schema([("terminal", pa.int64()), ("keep_row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("sha", pa.binary())])
SETTLED_DDL = "terminal long, keep_row long, keep_id long, group_size long, sha binary"


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class PatriciaTrie:
    """A compressed radix trie over byte strings. A node is [run of bytes, children by first byte, terminal]; a terminal
    is [owner, owner's row, count, names of first-step terminals]."""

    def __init__(self, keep: str = "largest"):
        self.better = max if keep == "largest" else min
        self.size = 0
        self.root: list = [b"", {}, None]

    def insert(self, key: bytes, owner: int | None, row: int, n: int = 1, name: int | None = None) -> list:
        """The string's terminal. `name` is the terminal's first name if it is new, one more if it is given again."""
        node, at = self.root, 0
        while True:
            run = node[0]
            if not key.startswith(run, at):
                same = common_prefix(run, key[at : at + len(run)])
                node[:] = [run[:same], {run[same]: [run[same:], node[1], node[2]]}, None]  # split the edge
                run = node[0]
            at += len(run)
            if at == len(key):
                if node[2] is None:
                    node[2] = self.opened(key, owner, row, n, name)
                else:
                    self.merged(node[2], owner, row, n, name)
                return node[2]
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = child = [key[at:], {}, self.opened(key, owner, row, n, name)]
                return child[2]
            node = child

    def opened(self, key: bytes, owner: int | None, row: int, n: int, name: int | None) -> list:
        self.size += len(key) + NODE_BYTES
        return [owner, row, n, [row if name is None else name]]

    def merged(self, held: list, owner: int | None, row: int, n: int, name: int | None) -> None:
        if owner is not None and (held[0] is None or (owner != held[0] and self.better(owner, held[0]) == owner)):
            held[0], held[1] = owner, row
        elif owner == held[0]:
            held[1] = min(held[1], row)
        held[2] += n
        if name is not None:
            held[3].append(name)

    def items(self, node: list | None = None, before: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(node or self.root, before)]
        while stack:
            node, before = stack.pop()
            whole = before + node[0] if before else node[0]
            if node[2] is not None:
                yield whole, node[2]
            stack += [(child, whole) for child in node[1].values()]

    def shed(self, goal: int) -> Iterator[tuple[bytes, list]]:
        """Takes out subtree after subtree, the terminals below a node before its own, until `goal` bytes are gone."""
        least, path = self.size - goal, [(self.root, self.root[0], None, 0)]
        while path and self.size > least:
            node, whole, parent, first = path[-1]
            if node[1]:
                below, child = next(iter(node[1].items()))
                path.append((child, whole + child[0], node, below))
                continue
            path.pop()
            if node[2] is not None:
                self.size -= len(whole) + NODE_BYTES
                yield whole, node[2]
            if parent is None:
                self.root = [b"", {}, None]
            else:
                del parent[1][first]

    def settled(self, key: bytes) -> Iterator[tuple[bytes, list]]:
        """Takes out the subtrees that lie before a string: no string that follows it in order can reach them."""
        node, at = self.root, 0
        while True:
            run = node[0]
            if not key.startswith(run, at):
                if node is self.root:  # its whole tree lies before
                    yield from self.items()
                    self.root = [b"", {}, None]
                return
            at += len(run)
            if at == len(key):
                return
            for first in [b for b in node[1] if b < key[at] or not key.startswith(node[1][b][0], at) and node[1][b][0] < key[at:]]:
                yield from self.items(node[1].pop(first), key[:at])
            child = node[1].get(key[at])
            if child is None:
                return
            node = child


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(schema.types), schema.types, strict=True)], schema=schema)


def local_tries(keep: str, budget: int):
    """A row (terminal, row, id) for each row of docs, and one with the string for each terminal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple[int, int], PatriciaTrie] = {}
        held, row = 0, TaskContext.get().partitionId() << 40

        def spilled(most: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            out, size = [], 0
            for part in sorted(tries, key=lambda p: tries[p].size, reverse=True):
                if held <= most:
                    break
                trie, before = tries[part], tries[part].size
                for body, (owner, at, n, names) in trie.shed(held - most):
                    out.append((names[0], at, owner, n, *part, body))
                    size += len(body)
                    if size > 4 << 20:
                        yield rows_of(out, LOCAL)
                        out, size = [], 0
                held -= before - trie.size
                if not trie.size:
                    del tries[part]
            if out:
                yield rows_of(out, LOCAL)

        for batch in batches:
            for rows in slices(batch, "text"):
                terminals, first = [], row
                for owner, text in zip(rows["id"].to_pylist(), rows["text"].cast(pa.large_binary()).to_pylist(), strict=True):
                    body = (text or b"").lower()  # of bytes, this lower-cases A-Z alone
                    part = len(body), xxhash.xxh3_64_intdigest(body) >> (64 - BITS)
                    trie = tries.get(part)
                    if trie is None:
                        trie = tries[part] = PatriciaTrie(keep)
                    before = trie.size
                    terminals.append(trie.insert(body, owner, row)[3][0])
                    held += trie.size - before
                    row += 1
                none = lambda kind: pa.nulls(len(terminals), kind)
                yield pa.RecordBatch.from_arrays([pa.array(terminals, pa.int64()), pa.array(range(first, row), pa.int64()), rows["id"], none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.binary())], schema=LOCAL)
                if held > budget:
                    yield from spilled(budget // 2)
        yield from spilled(-1)

    return run


def settled_tries(keep: str):
    """Of strings in the order of (length, bits, body): the owner of each first-step terminal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, PatriciaTrie(keep)
        out: list[tuple] = []

        def put(found: Iterator[tuple[bytes, list]]) -> None:
            for body, (owner, row, n, names) in found:
                sha = hashlib.sha256(body).digest()
                out.extend((name, row, owner, n, sha) for name in names)

        for batch in batches:
            cols = [batch[c].to_pylist() for c in LOCAL.names]
            for terminal, row, owner, n, length, bits, body in zip(*cols, strict=True):
                if (length, bits) != now:
                    put(trie.items())
                    now, trie = (length, bits), PatriciaTrie(keep)
                else:
                    put(trie.settled(body))
                trie.insert(body, owner, row, n, terminal)
                if len(out) > 5000:
                    yield rows_of(out, SETTLED)
                    out.clear()
        put(trie.items())
        yield rows_of(out, SETTLED)

    return run


def labelled(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """id, keep_id, group_size, kept, sha of every row of docs, through the terminals of the tries."""
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    local = stage_table(rows.mapInArrow(local_tries(keep, TRIE_BYTES), LOCAL_DDL), "tries")
    strings = local.where("body is not null").repartition("length", "bits").sortWithinPartitions("length", "bits", "body")
    owners = strings.mapInArrow(settled_tries(keep), SETTLED_DDL)
    placed = local.where("body is null").select("terminal", "row", "id").join(owners, "terminal")
    return placed.select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per row of docs, dropped ones too: (id_col, keep_id, group_size, kept, text_sha256).

    keep: which identifier of a group stays, "largest" or "smallest". Null identifiers stay only in a group without
    others (keep_id null). Repeated rows with the identifier that stays: one is kept, the others are dropped. Null
    texts are empty, and empty texts are copies of each other. An empty table gives no rows. Other columns of docs
    are not read, so their names cannot clash.
    """
    return labelled(docs, id_col, text_col, keep).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; of repeated rows with one identifier and
    text, one. Nulls and empty tables as in exact_dedup()."""
    own, nil, own_sha, n, key, null, sha = fresh(docs.columns, "own", "nil", "own_sha", "n", "key", "null", "sha")
    stay = labelled(docs, id_col, text_col, keep).where("kept").select(F.coalesce("id", F.lit(0)).alias(own), F.col("id").isNull().alias(nil), F.col("sha").alias(own_sha))
    id_ = quoted(id_col).cast("long")
    marked = docs.select("*", F.coalesce(id_, F.lit(0)).alias(key), id_.isNull().alias(null), F.unhex(F.sha2(ascii_lower(F.coalesce(quoted(text_col), F.lit(""))), 256)).alias(sha))
    # the join and the window deal rows by the same columns, so that texts are shuffled once
    kept = marked.join(stay, (F.col(key) == F.col(own)) & (F.col(null) == F.col(nil)) & (F.col(sha) == F.col(own_sha)), "left_semi")
    others = [quoted(c) for c, t in docs.dtypes if t in ("string", "bigint", "int", "double") and c not in (id_col, text_col)][:8]
    first = F.row_number().over(Window.partitionBy(key, null, sha).orderBy(*others or [F.lit(1)]))
    return kept.withColumn(n, first).where(F.col(n) == 1).drop(n, key, null, sha)
