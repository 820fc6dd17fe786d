"""LM scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background, share one vocabulary: every word of either. Both are counted
over all of their documents and matched: background counts are scaled to the target's number of tokens, and both
interpolate with their own unigrams. A document's score is its mean loss per token under the target minus that under the
background; the lower, the more it is like the target. A document is scored by models that were counted without it, so
that documents of the target are not near to it for having been counted.

The models are never held in one place. Texts are cut into chunks, each staged as its distinct words' hashes and one
index a token. A chunk ships its distinct words and pairs once, with their counts in both corpora, by ranges of their
hashes; each range adds up the counts of all chunks and answers every chunk that has documents to score with the totals
of what it asked for, and the chunk scores its documents. So a hot n-gram is one entry a chunk, what is counted grows
with the corpus, and no task holds more than a chunk or a range. Within its range, a hash is told by KEY_BITS bits
(a range holds up to a million distinct pairs, of which two share theirs with a chance of at most one in a hundred).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, packed, quoted, slices, spans, stage_table, text_bytes, unpacked, words

#: Tokens and documents of a chunk, bytes of text for each range of hashes, bits of a hash within its range, weight of unigrams.
CHUNK_TOKENS, CHUNK_DOCS, SHARD_BYTES, KEY_BITS, PRIOR = 1_000_000, 100_000, 8 << 20, 46, 4.0
FIRST = np.uint64(0x243F6A8885A308D3)  # stands for the start of a document where pairs are hashed
BACKGROUND, TARGET = 1, 2  # flags of a document

CHUNKS = "chunk long, ids array<long>, flags binary, lengths array<long>, words binary, tokens binary"
COUNTS = ("n", "ends", "m")  # of words, of words that end a document, of pairs; each in the background, then in the target
ASKED = "shard int, chunk long, words binary, n binary, ends binary, pairs binary, m binary"
TOTALS = "shard int, chunk long, n binary, ends binary, m binary, vocabulary long, tokens long, wanted_tokens long, texts long, wanted_texts long"
SCORED = "id long, n_tokens long, ce_target double, ce_background double, score double"


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents (id, flag, text): hashes of the distinct words (A-Z lower-cased, as bytes), frequent ones first, and an index a token."""
    names, at, ids, flags, lengths, held, docs, chunk = [], [], [], [], [], 0, 0, TaskContext.get().partitionId() << 32

    def flushed() -> pa.RecordBatch:
        every, own = np.unique(np.concatenate(names), return_inverse=True)
        first = np.cumsum([0, *map(len, names)])
        tokens = np.concatenate([own[k + i] for k, i in zip(first, at, strict=False)])
        order = np.argsort(-np.bincount(tokens, minlength=len(every)), kind="stable")
        rank = np.empty(len(every), dtype=np.int64)
        rank[order] = np.arange(len(every))
        lists = [pa.LargeListArray.from_arrays([0, len(x)], pa.array(x, pa.int64())).cast(pa.list_(pa.int64())) for x in (pa.concat_arrays(ids), np.concatenate(lengths))]
        row = [np.concatenate(flags).astype(np.uint8).tobytes(), packed(every[order], 8), packed(rank[tokens].astype(np.uint64), 4)]
        cols = [pa.array([x], pa.binary()) for x in row]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), lists[0], cols[0], lists[1], *cols[1:]], names=[x.split()[0] for x in CHUNKS.split(", ")])

    for batch in batches:
        for part in slices(batch, "text"):
            flat, starts = words(part["text"])
            coded = flat.dictionary_encode()
            names.append(np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64))
            at.append(np.asarray(coded.indices).astype(np.int64))
            ids.append(part["id"])
            flags.append(np.asarray(part["flag"]))
            lengths.append(np.diff(starts))
            held, docs = held + len(flat), docs + part.num_rows
            if held >= CHUNK_TOKENS or docs >= CHUNK_DOCS:
                yield flushed()
                names, at, ids, flags, lengths, held, docs, chunk = [], [], [], [], [], 0, 0, chunk + 1
    if docs:
        yield flushed()


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def record(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [x.split() for x in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(cols, fields, strict=True)], names=[name for name, _ in fields])


class Chunk:
    """A staged chunk: its documents' flags and lengths, its words and tokens, and its distinct pairs. Documents at the
    wanted places are the target's."""

    def __init__(self, chunk: pa.Table, wanted: list):
        row = chunk.drop_columns(["ids"]).to_pylist()[0]
        self.number, self.lengths = row["chunk"], np.array(row["lengths"], dtype=np.int64)
        self.flags = np.frombuffer(row["flags"], dtype=np.uint8).copy()
        for places in wanted:
            self.flags[np.array(places or [], dtype=np.int64)] |= TARGET
        self.names, self.tokens = unpacked(row["words"], 8), unpacked(row["tokens"], 4).astype(np.int64)
        self.of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        full = self.lengths > 0
        self.first, self.last = (np.cumsum(self.lengths) - self.lengths)[full], (np.cumsum(self.lengths) - 1)[full]
        size = len(self.names) + 1  # the last history is a document's start
        self.history = np.concatenate([[0], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        self.history[self.first] = size - 1
        pairs, self.pair = np.unique(self.history * size + self.tokens, return_inverse=True)
        self.key = mix(mix(np.append(self.names, FIRST)[pairs // size]) * np.uint64(0x9E3779B97F4A7C15) + self.names[pairs % size])

    def counted(self, at: np.ndarray, docs: np.ndarray, n: int) -> list[np.ndarray]:
        """How often each of n entries occurs in the background's documents and in the target's."""
        return [np.bincount(at[(self.flags[docs] & f) > 0], minlength=n) for f in (BACKGROUND, TARGET)]

    def counts(self) -> dict[str, list[np.ndarray]]:
        n = len(self.names)
        return {"n": self.counted(self.tokens, self.of, n), "ends": self.counted(self.tokens[self.last], self.of[self.last], n), "m": self.counted(self.pair, self.of, len(self.key))}


def asked(shard_bits: int):
    """A chunk's distinct words (counts, and how often last in a document) and pairs, by range of their hashes."""
    shift, rest = np.uint64(shard_bits), np.uint64(64 - KEY_BITS)

    def by_shard(keys: np.ndarray, counts: list[list[np.ndarray]]) -> dict[int, list[bytes]]:
        order = np.argsort(keys)
        keys = keys[order]
        shard = (keys >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(keys), dtype=np.int64)
        short = (keys << shift) >> rest
        start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else shard
        own = [[x[order].astype(np.uint64) for x in c] for c in counts]
        return {int(shard[s]): [packed(np.diff(short[s:e], prepend=np.uint64(0)), 6), *(packed(np.concatenate([x[s:e] for x in c]), 5) for c in own)] for s, e in spans(start, len(shard))}

    def run(chunk: pa.Table, wanted: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return record([], ASKED)
        own = Chunk(chunk, wanted["places"].to_pylist())
        c = own.counts()
        one, two = by_shard(own.names, [c["n"], c["ends"]]), by_shard(own.key, [c["m"]])
        return record([(s, own.number, *one.get(s, [b""] * 3), *two.get(s, [b""] * 2)) for s in sorted(one.keys() | two.keys())], ASKED)

    return run


def totals(part: pa.Table) -> pa.Table:
    """Of one range of hashes: the totals of what each chunk asked for, and a row of sums."""
    chunks, shard = part["chunk"].to_pylist(), part["shard"][0].as_py()
    answers, sums = {}, {}
    for key, names in (("words", ("n", "ends")), ("pairs", ("m",))):
        own = [np.cumsum(unpacked(x, 6), dtype=np.uint64) for x in part[key].to_pylist()]
        size = [len(x) for x in own]
        every, at = np.unique(np.concatenate(own), return_inverse=True)
        sums[key], first = len(every), np.cumsum([0, *size])
        for c in names:
            both = [unpacked(x, 5).reshape(2, -1) for x in part[c].to_pylist()]
            added = [np.bincount(at, weights=np.concatenate([x[i] for x in both]).astype(np.float64), minlength=len(every)).astype(np.uint64) for i in (0, 1)]
            sums[c] = [int(x.sum()) for x in added]
            answers[c] = [packed(np.concatenate([x[at[s:e]] for x in added]), 5) for s, e in zip(first[:-1], first[1:], strict=True)]
    rows = [(shard, c, *own, *[None] * 5) for c, *own in zip(chunks, *(answers[c] for c in COUNTS), strict=True)]
    return record([*rows, (shard, None, None, None, None, sums["words"], *sums["n"], *sums["ends"])], TOTALS)


def halves(values: list[bytes]) -> list[np.ndarray]:
    """The background's totals of all answers, and the target's."""
    got = [np.zeros((2, 0)), *(unpacked(x, 5).astype(np.float64).reshape(2, -1) for x in values)]
    return [np.concatenate([x[i] for x in got]) for i in (0, 1)]


def scored(sums: dict, prior: float):
    tokens, texts = (sums["tokens"], sums["wanted_tokens"]), (sums["texts"], sums["wanted_texts"])

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return record([], SCORED)
        answers = answers.sort_by("shard")
        n, ends, m = (halves([x for x in answers[c].to_pylist() if x is not None]) for c in COUNTS)
        c = Chunk(chunk, answers["places"].to_pylist())
        size, lengths, of = len(c.names) + 1, c.lengths, c.of
        places = lambda keys: np.argsort(np.argsort(keys))
        word_at, pair_at = places(c.names), places(c.key)[c.pair]
        # what a token's own document has of its pair, word and history
        same = lambda x, k: np.take(*np.unique(of * k + x, return_inverse=True, return_counts=True)[:0:-1])
        own_pair, own_word = same(c.pair, len(c.key) + 1), same(c.tokens, size)
        ending = np.zeros(len(lengths), dtype=np.int64) - 1
        ending[lengths > 0] = c.tokens[c.last]
        own_after = np.concatenate([[0], own_word[:-1]]) - (c.history == ending[of]) if len(of) else own_word
        own_after[c.first] = 1
        took = [np.where((c.flags & f) > 0, 1, 0) for f in (BACKGROUND, TARGET)]
        left = [tokens[i] - took[i] * lengths for i in (0, 1)]
        scale = np.where((left[0] > 0) & (left[1] > 0), left[1] / np.maximum(left[0], 1), 1.0)
        means, safe = [], np.maximum(lengths, 1)
        for i, s in ((0, scale[of]), (1, np.ones(len(of)))):
            t = took[i][of]
            after = np.append((n[i] - ends[i])[word_at], texts[i])[c.history] - t * own_after
            one = ((n[i][word_at][c.tokens] - t * own_word) * s + 1.0) / (left[i][of] * s + sums["vocabulary"])
            loss = -np.log(((m[i][pair_at] - t * own_pair) * s + prior * one) / (after * s + prior))
            means.append(np.bincount(of, weights=loss, minlength=len(lengths)) / safe)
        ids, kept = chunk["ids"].combine_chunks().flatten(), pa.array((c.flags & BACKGROUND) > 0)
        out = pa.table([ids, pa.array(lengths), pa.array(means[1]), pa.array(means[0]), pa.array(means[1] - means[0])], names=["id", "n_tokens", "ce_target", "ce_background", "score"])
        return out.filter(kept)

    return run


def score_by_difference(docs: DataFrame, target: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, wanted: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ce_target, ce_background, score (their difference, in nats a token).

    docs are the background. The texts to be like are rows of docs whose identifiers `wanted` (id_col) lists, or those of
    another table, target (text_col), or both. A document's own counts are taken out of every model that holds them, so
    a copy of it still counts. Words are split at ASCII white space and lower-cased (A-Z). Null and empty texts have 0
    tokens, losses and score. Repeated rows are counted and scored as often as they occur; null identifiers are scored and
    never wanted. Without a target all of its losses are uniform; an empty docs gives no rows. Other columns are not read.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.lit(BACKGROUND).alias("flag"), quoted(text_col).alias("text"))
    if target is not None:
        rows = rows.union(target.select(F.lit(None).cast("long"), F.lit(TARGET), quoted(text_col)))
    shard_bits = max(0, (max(1, text_bytes(docs, text_col) // SHARD_BYTES) - 1).bit_length())
    chunks = stage_table(rows.mapInArrow(chunked, CHUNKS), "chunks")
    none = docs.sparkSession.range(0).select(F.col("id").alias("wanted"))
    ids = none if wanted is None else wanted.select(quoted(id_col).cast("long").alias("wanted")).where("wanted is not null").distinct()
    # places of a chunk: CHUNK_DOCS and one batch at most; joined in the same way at every size
    each = chunks.select("chunk", F.posexplode("ids").alias("place", "id")).join(ids.hint("merge"), F.col("id") == F.col("wanted"))
    places = stage_table(each.groupBy("chunk").agg(F.collect_list("place").alias("places")), "places")
    every = chunks.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(asked(shard_bits), ASKED)
    found = stage_table(every.groupBy("shard").applyInArrow(totals, TOTALS), "totals")
    sums = found.where("chunk is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("vocabulary", "tokens", "wanted_tokens", "texts", "wanted_texts")]).first().asDict()
    answers = found.where("chunk is not null").select("shard", "chunk", *COUNTS, F.lit(None).cast("array<int>").alias("places"))
    known = places.select(F.lit(-1).alias("shard"), "chunk", *[F.lit(None).cast("binary").alias(c) for c in COUNTS], "places")
    return chunks.groupBy("chunk").cogroup(answers.union(known).groupBy("chunk")).applyInArrow(scored(sums, prior), SCORED).withColumnRenamed("id", id_col)
