"""Phrase collocations by direct-address tiles.

Texts are staged once as codes: a chunk holds its distinct words, a code a word, and breaks where a piece of text ends.
Words that occur often enough get their rank by frequency as identifier, and pairs of neighbours become cells of a grid
of identifiers. The grid is cut into tiles of SIDE x SIDE cells. Tiles of the frequent ranks are counted by address with
numpy's bincount; all others, sparse ones, as sorted coordinates with counts, many tiles to a bucket. Pairs that occur
often enough are ranked again and take the place of their words, so phrases of three words are pairs of a pair and a word,
counted in the same way, and so on.

A chunk ships each distinct cell once with its count. A tile's cells come in as a stream that is added up piece by piece,
so a task holds one tile, or one bucket's distinct cells; frequent tiles are salted by chunk and added up in a second
step. The number of buckets grows with the input. What a chunk needs to know of the frequent pairs comes back to it by
the same keys. Nothing but numbers of ranges, chunks and languages is counted on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, quoted, slices, stage_table, unpacked
from .rows import batch, ranked, run_starts

#: Words of a chunk, cells of a tile's side, tiles a side that are counted by address, words for each bucket of sparse tiles, chunks for each salt.
CHUNK, SIDE, DENSE, BUCKET, SALT = 2_000_000, 1024, 4, 4_000_000, 16
#: Entries that a task holds before it adds them up, and parts of a language whose best phrases are found on their own first.
HELD, PARTS = 4_000_000, 64

CHUNKS = "chunk long, langs array<string>, words array<binary>, lang array<long>, n array<long>, codes binary"
CELLS = "tile long, salt long, chunk long, cells binary, counts binary"
FOUND = "tile long, whole boolean, one long, two long, n long"
ANSWERS = "chunk long, cells binary, ids binary"


def classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: 0 in words, 1 between words, 2 between pieces; and the byte with A-Z lower-cased."""
    kind, lower = np.zeros(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    kind[[0x20, 0x09]] = 1
    kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    lower[ord("A") : ord("Z") + 1] += 32
    return kind, lower


KIND, LOWER_BYTE = classes()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (binary), and for each whether it starts a piece."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    if begin == end:
        return pa.array([], pa.large_binary()), np.zeros(0, dtype=bool)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[begin:end]
    kind = KIND[data]
    # a document's first byte begins a word of its own
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1] - begin] = True
    first = first[:-1]
    word = kind == 0
    start = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | first))
    sizes = np.add.reduceat(word.astype(np.int64), start) if len(start) else start
    ends = np.cumsum(sizes)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(LOWER_BYTE[data[word]])])
    cuts = np.cumsum((kind == 2) | first)
    at = cuts[start]
    return flat, np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=bool)


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of (lang, text): the distinct words of each language with their counts, and the codes of all words in order, 0 at a break."""
    held, size, chunk = [], 0, TaskContext.get().partitionId() << 32

    def flushed() -> pa.RecordBatch:
        langs, words, lang_of, counts, codes, first = [], [], [], [], [], 1
        for lang in dict.fromkeys(x[0] for x in held):
            own = [x for x in held if x[0] == lang]
            coded = pa.chunked_array([x[1] for x in own]).combine_chunks().dictionary_encode()
            if not len(coded):
                continue
            at, news = np.asarray(coded.indices).astype(np.int64), np.concatenate([x[2] for x in own])
            line = np.zeros(len(at) + int(news.sum()), dtype=np.int64)
            line[np.arange(len(at)) + np.cumsum(news)] = at + first
            codes.append(line)
            words.append(coded.dictionary.cast(pa.binary()))
            lang_of.append(np.full(len(words[-1]), len(langs)))
            counts.append(np.bincount(at, minlength=len(words[-1])))
            langs.append(lang)
            first += len(words[-1])
        none = np.zeros(0, dtype=np.int64)
        flat = np.concatenate(codes) if codes else none
        lists = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
        row = [lists(pa.concat_arrays(words) if words else pa.array([], pa.binary())), lists(pa.array(np.concatenate(lang_of) if lang_of else none, pa.int64())), lists(pa.array(np.concatenate(counts) if counts else none, pa.int64()))]
        return batch([[chunk], [langs], *row, [packed(flat.astype(np.uint64), 4)]], CHUNKS)

    for rows in batches:
        for part in slices(rows, "text"):
            lang = part.column("lang").dictionary_encode()
            at = np.asarray(lang.indices)
            for i, name in enumerate(lang.dictionary.to_pylist()):
                flat, news = split(part.column("text").filter(pa.array(at == i)) if len(lang.dictionary) > 1 else part.column("text"))
                held.append((name, flat, news))
                size += len(flat)
            if size >= CHUNK:
                yield flushed()
                held, size, chunk = [], 0, chunk + 1
    if held:
        yield flushed()


def spread(cell: np.ndarray) -> np.ndarray:
    """Bits that deal sparse tiles into buckets."""
    h = cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)


def addressed(one: np.ndarray, two: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Tile and cell of pairs of identifiers: by address in frequent tiles, else a bucket (negative) and the pair's number."""
    i, j = one // SIDE, two // SIDE
    dense = (i < DENSE) & (j < DENSE)
    bucket = -1 - (spread(i * (width // SIDE + 1) + j) % np.uint64(buckets)).astype(np.int64)
    return np.where(dense, i * DENSE + j, bucket), np.where(dense, (one % SIDE) * SIDE + two % SIDE, one * width + two)


def shipped(chunk: int, one: np.ndarray, two: np.ndarray, width: int, buckets: int, salts: int) -> Iterator[tuple]:
    """Rows of CELLS: each distinct cell of a chunk with its count, in order, tile by tile."""
    number, n = np.unique(one * width + two, return_counts=True)
    tile, cell = addressed(number // width, number % width, width, buckets)
    order = np.lexsort((cell, tile))
    tile, cell, n = tile[order], cell[order], n[order]
    starts = run_starts(tile)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)], strict=False):
        t = int(tile[s])
        yield t, chunk % salts if t >= 0 else 0, chunk, packed(np.diff(cell[s:e], prepend=0).astype(np.uint64), 8), packed(n[s:e].astype(np.uint64), 4)


def cells_of(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, 8).astype(np.int64))


class Tile:
    """The counts of one tile (or bucket) as they come in."""

    def __init__(self, tile: int):
        self.tile, self.cells, self.counts, self.held, self.table = tile, [], [], 0, None

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.cells.append(cells)
        self.counts.append(counts)
        self.held += len(cells)
        if self.held >= (HELD if self.table is None else SIDE * SIDE):
            self.settle()

    def settle(self) -> None:
        if not self.cells:
            return
        cells, counts = np.concatenate(self.cells), np.concatenate(self.counts)
        if self.tile >= 0 and (self.table is not None or len(cells) * 8 >= SIDE * SIDE):  # by address
            added = np.bincount(cells, weights=counts, minlength=SIDE * SIDE).astype(np.int64)
            self.table = added if self.table is None else self.table + added
            self.cells, self.counts, self.held = [], [], 0
            return
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        starts = run_starts(cells)
        self.cells, self.counts = [cells[starts]], [np.add.reduceat(counts, starts) if len(starts) else counts]
        self.held = max(0, len(starts) - HELD // 2)  # distinct cells do not call for settling again

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        if self.table is None:
            return (self.cells[0], self.counts[0]) if self.cells else (np.zeros(0, dtype=np.int64),) * 2
        at = np.flatnonzero(self.table)
        return at, self.table[at]


def added(width: int, least: int):
    """From rows of CELLS in order of tile and salt: counts of whole tiles that reach `least`, and all counts of salted ones."""

    def done(tile: Tile) -> Iterator[pa.RecordBatch]:
        cells, counts = tile.total()
        if tile.tile < 0:
            often = counts >= least
            cells, counts = cells[often], counts[often]
            one, two = cells // width, cells % width
        else:
            one, two = tile.tile // DENSE * SIDE + cells // SIDE, tile.tile % DENSE * SIDE + cells % SIDE
        for s in range(0, len(one), 1 << 16):
            e = min(s + (1 << 16), len(one))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(e - s, tile.tile)), pa.array(np.full(e - s, tile.tile < 0)), pa.array(one[s:e]), pa.array(two[s:e]), pa.array(counts[s:e])], names=["tile", "whole", "one", "two", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of = None, None
        for rows in batches:
            for tile, salt, cells, counts in zip(*(rows.column(c).to_pylist() for c in ("tile", "salt", "cells", "counts")), strict=True):
                if (tile, salt) != of:
                    if now is not None:
                        yield from done(now)
                    now, of = Tile(tile), (tile, salt)
                now.add(cells_of(cells), unpacked(counts, 4).astype(np.int64))
        if now is not None:
            yield from done(now)

    return run


def counted(cells: DataFrame, width: int, least: int) -> DataFrame:
    """(one, two, n): pairs that occur `least` times or more, of staged rows of CELLS."""
    parts = cells.select("tile", "salt", "cells", "counts").repartition("tile", "salt").sortWithinPartitions("tile", "salt").mapInArrow(added(width, least), FOUND)
    parts = stage_table(parts, "parts")
    salted = parts.where("not whole").groupBy("one", "two").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return parts.where("whole").select("one", "two", "n").union(salted)


class Chunk:
    """A chunk's line of identifiers: -1 at breaks and rare words."""

    def __init__(self, chunk: pa.Table, ranks: pa.Table):
        row = chunk.select(["chunk", "codes"]).to_pylist()[0]
        codes = unpacked(row["codes"], 4).astype(np.int64)
        place, rank = (np.asarray(ranks[c].combine_chunks(), dtype=np.int64) for c in ("place", "rank"))
        of = np.full(int(codes.max(initial=0)) + 1, -1, dtype=np.int64)
        of[place + 1] = rank
        self.number, self.line = row["chunk"], of[codes]

    def pairs(self) -> np.ndarray:
        """Where two frequent words are neighbours."""
        return np.flatnonzero((self.line[:-1] >= 0) & (self.line[1:] >= 0)) if len(self.line) else np.zeros(0, dtype=np.int64)


def table(rows: list[tuple], ddl: str) -> pa.Table:
    return pa.Table.from_batches([batch([list(c) for c in zip(*rows, strict=True)] or [[] for _ in ddl.split(", ")], ddl)])


def first_pairs(width: int, buckets: int, salts: int):
    def run(chunk: pa.Table, ranks: pa.Table) -> pa.Table:
        if not chunk.num_rows or not ranks.num_rows:
            return table([], CELLS)
        c = Chunk(chunk, ranks)
        at = c.pairs()
        return table(list(shipped(c.number, c.line[at], c.line[at + 1], width, buckets, salts)) if len(at) else [], CELLS)

    return run


def told(known: pa.Table, asked: pa.Table) -> pa.Table:
    """Of one tile and salt: for each chunk that shipped cells, those that are frequent pairs, and their identifiers."""
    if not known.num_rows or not asked.num_rows:
        return table([], ANSWERS)
    cell, ids = (np.asarray(known[c].combine_chunks(), dtype=np.int64) for c in ("number", "pair"))
    key = np.asarray(known["cell"].combine_chunks(), dtype=np.int64)
    order = np.argsort(key)
    cell, ids, key = cell[order], ids[order], key[order]
    rows = []
    for chunk, data in zip(asked["chunk"].to_pylist(), asked["cells"].to_pylist(), strict=True):
        own = cells_of(data)
        at = np.minimum(np.searchsorted(key, own), len(key) - 1)
        at = at[key[at] == own]
        rows.append((chunk, packed(cell[at].astype(np.uint64), 8), packed(ids[at].astype(np.uint64), 5)))
    return table(rows, ANSWERS)


def next_pairs(width: int, wide: int, buckets: int, salts: int):
    """Pairs of a frequent pair and the word after it, where that word's pair is frequent as well. Pairs are told as numbers of a grid `width` wide."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return table([], CELLS)
        c = Chunk(rows.filter(pc.is_valid(rows["codes"])), rows.filter(pc.is_null(rows["codes"])))
        number = np.concatenate([unpacked(x, 8).astype(np.int64) for x in answers["cells"].to_pylist()])
        ids = np.concatenate([unpacked(x, 5).astype(np.int64) for x in answers["ids"].to_pylist()])
        if not len(number):
            return table([], CELLS)
        order = np.argsort(number)
        number, ids = number[order], ids[order]
        at = c.pairs()
        own = c.line[at] * width + c.line[at + 1]
        found = np.minimum(np.searchsorted(number, own), len(number) - 1)
        pair = np.full(len(c.line), -1, dtype=np.int64)
        pair[at] = np.where(number[found] == own, ids[found], -1)
        at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        return table(list(shipped(c.number, pair[at], c.line[at + 2], wide, buckets, salts)) if len(at) else [], CELLS)

    return run


def ratio(a: str, l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)), exact: products have up to 38 digits, the quotient at most 7 as a is in both l and r."""
    wide = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({wide(a)} * {wide(a)} * 1000000) div ({wide(l)} * {wide(r)})")


def keyed(pairs: DataFrame, width: int, buckets: int, salts: int) -> DataFrame:
    """Frequent pairs (one, two, pair) with the tile, salt and cell by which chunks ask for them, once for each salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            one, two = (np.asarray(rows.column(c), dtype=np.int64) for c in ("one", "two"))
            tile, cell = addressed(one, two, width, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(cell), pa.array(one * width + two), rows.column("pair")], names=["tile", "cell", "number", "pair"])

    each = pairs.select("one", "two", "pair").mapInArrow(run, "tile long, cell long, number long, pair long")
    return each.withColumn("salt", F.explode(F.when(F.col("tile") >= 0, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).withColumn("salt", F.col("salt").cast("long"))


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, within: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The `most` best phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at `.,;:!?` and line ends into pieces, those at spaces and tabs into words. n: all
    words of the language; a: how often the phrase occurs within pieces, overlaps included, at least `least` times; l and r:
    of its two parts at the cut with the lowest floor(10^6 a a / (l r)), the score. A phrase of two words within one of three
    that occurs at `within` percent of its count or more is left out. Ties go by a, then by the bytes of the phrase.

    Null languages are `und`, null and empty texts have no words, repeated rows count as often as they occur; a language
    without phrases, and an empty table, give no rows. Other columns are not read.
    """
    rows = docs.select(F.coalesce(quoted(lang_col), F.lit("und")).alias("lang"), quoted(text_col).alias("text"))
    chunks = stage_table(rows.mapInArrow(chunked, CHUNKS), "chunks")
    words = chunks.select("chunk", "langs", F.posexplode(F.arrays_zip("words", "lang", "n")).alias("place", "w")).select("chunk", "place", F.element_at("langs", (F.col("w.lang") + 1).cast("int")).alias("lang"), F.col("w.words").alias("word"), F.col("w.n").alias("n"))
    every = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    every = stage_table(every, "words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    vocabulary, size = ranked(every.where(F.col("n") >= least), [F.col("n").desc(), F.col("lang"), F.col("word")], "rank", "vocabulary")
    all_words, n_chunks = chunks.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.count("*")).first()
    width, buckets, salts = max(size, 1), max(1, -(-all_words // BUCKET)), max(1, -(-n_chunks // SALT))
    if width >= 1 << 31:
        raise ValueError(f"{width} frequent words: their pairs have 62 bits")
    ranks = stage_table(words.select("chunk", "place", "lang", "word").join(vocabulary.select("lang", "word", "rank"), ["lang", "word"]).select("chunk", F.lit(None).cast("binary").alias("codes"), "place", "rank"), "ranks")
    cells = stage_table(chunks.select("chunk", "codes").groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(first_pairs(width, buckets, salts), CELLS), "pairs")
    pairs, n_pairs = ranked(counted(cells, width, least), [F.col("n").desc(), F.col("one"), F.col("two")], "pair", "ranked")
    wide = max(width, n_pairs)
    if wide >= 1 << 31:
        raise ValueError(f"{wide} frequent pairs: their pairs have 62 bits")
    answers = keyed(pairs, width, buckets, salts).groupBy("tile", "salt").cogroup(cells.select("tile", "salt", "chunk", "cells").groupBy("tile", "salt")).applyInArrow(told, ANSWERS)
    lines = chunks.select("chunk", "codes", F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("rank")).union(ranks.select("chunk", "codes", "place", "rank"))
    cells3 = stage_table(lines.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(next_pairs(width, wide, buckets, salts), CELLS), "triples")
    triples = counted(cells3, wide, least)

    v = vocabulary.select("rank", "lang", F.col("n").alias("f"))
    named = lambda at: v.select(F.col("rank").alias(at), F.col("f").alias(f"f_{at}"))
    two = stage_table(pairs.select("pair", "one", "two", F.col("n").alias("a")).join(v.withColumnRenamed("rank", "one").withColumnRenamed("f", "f_one"), "one").join(named("two"), "two"), "two")
    three = triples.select(F.col("one").alias("pair"), F.col("two").alias("three"), F.col("n").alias("a3"))
    three = three.join(two.withColumnRenamed("a", "a12"), "pair").join(two.select(F.col("one").alias("two"), F.col("two").alias("three"), F.col("a").alias("a23"), F.col("f_two").alias("f_three")), ["two", "three"])
    three = stage_table(three, "three")
    inside = three.select("one", "two", "a3").union(three.select("two", "three", "a3")).groupBy("one", "two").agg(F.max("a3").alias("longer"))
    kept = two.join(inside, ["one", "two"], "left").where((100 * F.coalesce("longer", F.lit(0))) < within * F.col("a"))
    bigrams = kept.select("lang", "one", "two", F.lit(None).cast("long").alias("three"), "a", F.col("f_one").alias("l"), F.col("f_two").alias("r"), ratio("a", "f_one", "f_two").alias("score"))
    cuts = three.withColumn("s1", ratio("a3", "f_one", "a23")).withColumn("s2", ratio("a3", "a12", "f_three"))
    late = F.col("s2") < F.col("s1")
    trigrams = cuts.select("lang", "one", "two", "three", F.col("a3").alias("a"), F.when(late, F.col("a12")).otherwise(F.col("f_one")).alias("l"), F.when(late, F.col("f_three")).otherwise(F.col("a23")).alias("r"), F.least("s1", "s2").alias("score"))
    # first of parts of a language, then of it; those that tie with the last one stay until their words are known
    best = bigrams.union(trigrams).withColumn("part", F.pmod(F.xxhash64("one", "two", "three"), F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("a").desc())
        best = best.withColumn("place", F.rank().over(by)).where(F.col("place") <= most).drop("place")
    best = stage_table(best.drop("part"), "best")
    for at in ("one", "two", "three"):
        best = best.join(vocabulary.select(F.col("rank").alias(at), F.col("word").alias(f"w_{at}")), at, "left")
    phrase = F.concat("w_one", F.lit(b" "), "w_two", F.coalesce(F.concat(F.lit(b" "), "w_three"), F.lit(b"")))
    last = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = best.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= most)
    return out.join(totals, "lang").select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score")
