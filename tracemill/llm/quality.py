"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Document statistics (of characters, words and lines; never labels, language, source or identifier) are standardised
and mapped to cosines of random projections, whose inner products approximate a Gaussian kernel. Tasks sum the normal
equations of their rows; the driver adds a fixed number of such sums and solves a system of `features` unknowns. Scores
are calibrated by isotonic regression on rows that the ridge did not see.

A fit reads labelled rows alone: the labels, FIT_ROWS at most, are joined to the documents before any statistics are
taken, and the statistics of those rows are a staged table from there on. Scoring is one pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices, stage_table, words

#: Labelled rows that a model is fitted on at most (a sample by hash beyond), tasks that sum equations, cosines, ridge.
FIT_ROWS, FIT_TASKS, FEATURES, RIDGE, SEED = 200_000, 16, 384, 1.0, 11

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".?", "bang": b"!", "comma": b",;:", "bar": b"|/\\", "mark": b"#$%&*@^~_=+<>", "other": b"\"'`()[]{}-"}
CLASS_OF = np.zeros(256, dtype=np.int64)  # 0: bytes of characters beyond ASCII, and control characters
for _i, _bytes in enumerate(CLASSES.values(), 1):
    CLASS_OF[list(_bytes)] = _i
N_CLASSES = len(CLASSES) + 1
NAMES = ["words_log", "bytes_log", "word_length", "word_length_sd", "distinct_words", "top_word", "distinct_pairs", "repeats_next", "distinct_lines", "line_length_log", "capital_words", *[f"share_{k}" for k in ("wide", *CLASSES)]]


def distinct_in(doc: np.ndarray, code: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Different codes of each document, and its most frequent code's count."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | code.astype(np.uint64))
    if not len(key):
        return np.zeros(n_docs), np.zeros(n_docs)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    of = (key[start] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n_docs)
    np.maximum.at(top, of, np.diff(np.append(start, len(key))))
    return np.bincount(of, minlength=n_docs), top


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, len(NAMES)); all of an empty text are 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    flat, starts = words(texts)
    n_words = np.diff(starts)
    doc = np.repeat(np.arange(n), n_words)
    coded = flat.dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    length = np.asarray(pc.binary_length(coded.dictionary)).astype(np.float64)[code] if len(code) else np.zeros(0)
    capital = np.asarray(pc.match_substring_regex(coded.dictionary, r"^\p{Lu}"))[code] if len(code) else np.zeros(0, dtype=bool)
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    safe = np.maximum(n_words, 1)
    mean = np.bincount(doc, weights=length, minlength=n) / safe
    var = np.bincount(doc, weights=length**2, minlength=n) / safe - mean**2
    distinct, top = distinct_in(doc, code, n)
    pair = (code[:-1] * np.int64(1_000_003) + code[1:]) & np.int64((1 << 40) - 1) if len(code) > 1 else np.zeros(0, dtype=np.int64)
    same_doc = doc[:-1] == doc[1:]
    pairs, _ = distinct_in(doc[:-1][same_doc], pair[same_doc], n)
    again = np.bincount(doc[:-1][same_doc & (code[:-1] == code[1:])], minlength=n) if len(code) > 1 else np.zeros(n)
    lists = pc.split_pattern(texts, "\n")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    n_lines = np.diff(offsets)
    line = np.asarray(lists.flatten().dictionary_encode().indices).astype(np.int64)
    lines, _ = distinct_in(np.repeat(np.arange(n), n_lines), line, n)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = data[bounds[0] : bounds[-1]]
    share = np.bincount(np.repeat(np.arange(n) * N_CLASSES, size) + CLASS_OF[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(size, 1)[:, None]
    own = [np.log1p(n_words), np.log1p(size), mean, np.sqrt(np.maximum(var, 0)), distinct / safe, top / safe, pairs / np.maximum(n_words - 1, 1), again / np.maximum(n_words - 1, 1), np.where(size > 0, lines / np.maximum(n_lines, 1), 0), np.log1p(size / np.maximum(n_lines, 1)), np.bincount(doc, weights=capital.astype(float), minlength=n) / safe]
    return np.concatenate([np.stack(own, axis=1), share], axis=1)


def statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = statistics(part["text"])
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), part["y"], part["fold"]], names=["x", "y", "fold"])


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


class Model:
    """Standardisation, cosines, ridge weights and calibration; a few hundred KB."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.sd = mean, sd
        self.w, self.b = rng.normal(size=(len(mean), features)) / np.sqrt(len(mean)), rng.uniform(0, 2 * np.pi, size=features)
        self.weights = np.zeros(features + 1)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit of y (means) on ascending x, with weights n: the pooled steps' ends."""
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for a, b, w in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
        blocks.append([b, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, k, _, last = blocks.pop()
            prev = blocks[-1]
            prev[0], prev[1], prev[3] = (prev[0] * prev[1] + m * k) / (prev[1] + k), prev[1] + k, last
    return np.array([v for b in blocks for v in (b[2], b[3] + 1e-12)]), np.array([v for b in blocks for v in (b[0], b[0])])


def summed(make, n: int):
    """Adds up make(x, y), a flat array of n numbers, over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                total += make(matrix(batch["x"]), np.asarray(batch["y"]).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["s"])

    return run


def total(rows: DataFrame, make, n: int) -> np.ndarray:
    """Of FIT_TASKS sums at most, whatever the input."""
    return np.sum([np.frombuffer(r[0], dtype="<f8") for r in rows.mapInArrow(summed(make, n), "s binary").collect()], axis=0)


def fold(id_col):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label: str, held_out: int, most: int) -> DataFrame:
    """x, y and fold of the documents with a label outside fold `held_out`; beyond `most` labels, of a sample by hash."""
    y = labels.select(quoted(label_id).cast("long").alias("own"), quoted(label).cast("double").alias("y")).where("own is not null and y is not null")
    y = y.groupBy("own").agg(F.max("y").alias("y")).withColumn("fold", fold(F.col("own"))).where(F.col("fold") != held_out)
    n = y.count()
    if n > most:
        y = y.where(F.pmod(F.xxhash64("own"), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    own = rows.join(F.broadcast(y), F.col("id") == F.col("own"))  # about `most` rows of three numbers, whatever the input
    return stage_table(own.select("text", "y", "fold").mapInArrow(statistics_rows, "x binary, y double, fold long"), "labelled")


def fit(rows: DataFrame, calibrate: int = 3, features: int = FEATURES) -> Model:
    """Learns from labelled() rows; fold `calibrate` fits the calibration alone. The table is of a bounded size, so that
    FIT_TASKS tasks read it, whose sums are added up here."""
    learn = rows.where(F.col("fold") != calibrate)
    k = len(NAMES)
    sums = total(learn.coalesce(FIT_TASKS), lambda x, y: np.concatenate([x.sum(axis=0), (x**2).sum(axis=0), [len(x)]]), 2 * k + 1)
    count = max(sums[-1], 1)
    mean = sums[:k] / count
    model = Model(mean, np.sqrt(np.maximum(sums[k : 2 * k] / count - mean**2, 0)) + 1e-6, features)
    if not sums[-1]:
        model.steps = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))  # nothing to learn from: every text may be good or bad
        return model
    m = features + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.cosines(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = total(learn.coalesce(FIT_TASKS), equations, m * m + m)
    model.weights = np.linalg.solve(sums[: m * m].reshape(m, m) + RIDGE * np.diag([1.0] * features + [1e-6]), sums[m * m :])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(model.raw(matrix(batch["x"])), -1, 2), 3)), pa.array(np.asarray(batch["y"]).astype(np.float64))], names=["r", "y"])

    bins = rows.where(F.col("fold") == calibrate).mapInArrow(binned, "r double, y double").groupBy("r").agg(F.avg("y"), F.count("*")).orderBy("r").collect()  # 3001 at most
    if bins:
        model.steps = isotonic(*[np.array([b[i] for b in bins], dtype=np.float64) for i in range(3)])
    return model


def model_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str = "doc_id", label: str = "quality", held_out: int = 2, most: int = FIT_ROWS) -> Model:
    return fit(labelled(docs, labels, id_col, text_col, label_id, label, held_out, most))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: float = 0.7) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted.

    Null texts are empty; empty texts are scored by their statistics, all 0. Rows with a null identifier are never
    labelled and not held out. Labels that occur twice count once, with the larger; null ones not at all. Without any
    labels every score is 0.5. Repeated rows get one score each; an empty table gives no rows. Other columns are not
    read.
    """
    model = model_of(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(model.score(statistics(part["text"])))], names=["id", "score"])

    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    scored = rows.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= good).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: float = 0.7) -> DataFrame:
    """The rows of docs that are not rejected, with their columns, whatever their names. Nothing is shuffled but labels.

    Odd rows and labels as in classify(); without any labels every row is rejected.
    """
    model = model_of(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # Spark takes no names with dots here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                yield part.filter(pa.array(model.score(statistics(part[at])) >= good))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
