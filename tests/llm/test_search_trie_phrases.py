"""Exact top-k search, the conversation trie and collocations: odd rows, and brute force on small and skewed inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import collocations as C
from tracemill.llm import vector_search as S
from tracemill.llm.collocations import collocations
from tracemill.llm.conversation_trie import numbered, prefix_trie, renamed, with_heads
from tracemill.llm.rows import list_digests
from tracemill.llm.vector_search import decoded, encoded, top_k

VECTORS = "vec_id long, embedding array<double>, label int, query string, row int, v binary"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "clash", 1, b"") for i, e in rows], VECTORS)


def nearest(rows, k, every=50):
    """Brute force over distinct rows; null identifiers last."""
    ints = list(dict.fromkeys((i, tuple(int(np.floor(256 * x)) for x in e)) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)))
    out = []
    for q, a in ints:
        if q is None or q % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c is None, c or 0, c) for c, b in ints if c != q)
        out += [(q, r, c, -s) for r, (s, _, _, c) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def test_search_on_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0, 0.5]), (1, [0.9, 0.1, 0.5]), (2, None), (3, [1.0, None, 0.0]), (4, [float("nan"), 0.0, 1.0]), (5, [float("inf"), 0.0, 1.0]), (6, [0.0, 0.0, 0.0]),
        (7, []), (8, [2.0]), (9, [1.0, 0.0, 0.5]), (10, [1.0, 0.0, 0.5]), (10, [1.0, 0.0, 0.5]), (None, [3.0, 3.0, 3.0]), (50, [-1.0, -0.001, 0.3]), (50, [0.2, 0.2, 0.2]), (100, []), (150, None),
    ]
    got = top_k(vectors(spark, rows), 3, "id % 50 = 0")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == nearest(rows, 3)
    assert top_k(vectors(spark, []), 3, "id % 50 = 0").count() == 0
    assert top_k(vectors(spark, [(0, [1.0])]), 3, "id % 50 = 0").count() == 0  # no other row


def test_search_against_brute_force(spark):
    """A third of the rows are one vector, many more lie near it, ties abound; several blocks, parts of unlike ranges."""
    r = np.random.default_rng(3)
    hot, rows = r.normal(size=12) / 4, []
    for i in range(900):
        v = hot if i % 3 == 0 else hot + r.normal(size=12) / 500 if i % 3 == 1 else r.normal(size=12) * (10.0 if i % 7 == 0 else 0.3)
        rows.append((i, [float(x) for x in v]))
    got = top_k(vectors(spark, rows).repartition(5), 5, "id % 50 = 0")
    assert sorted(map(tuple, got.collect()), key=str) == nearest(rows, 5)


@pytest.mark.parametrize(("limit", "parts"), [(8 << 20, {1}), (8 * 8 * 3, set(range(4, 12)))])
def test_queries_are_searched_in_parts_by_their_bytes(spark, monkeypatch, limit, parts):
    """However many partitions they come in: 10 queries of 8 components, then at most three a part."""
    calls, own = [], S.searched
    monkeypatch.setattr(S, "QUERY_BYTES", limit)
    monkeypatch.setattr(S, "searched", lambda spark, blocks, ids, v, k: calls.append(len(ids)) or own(spark, blocks, ids, v, k))
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(500)]
    got = top_k(vectors(spark, rows).repartition(23), 5, "id % 50 = 0")
    assert sorted(map(tuple, got.collect()), key=str) == nearest(rows, 5)
    assert len(calls) in parts and sum(calls) == 10 and max(calls) <= limit // 64


def test_search_with_huge_components(spark):
    """Scores beyond what sums in double precision hold are exact; those beyond 64 bits stand at the end."""
    rows = [(0, [2.0**22 + 0.25, 3.0]), (1, [2.0**22, 1.0]), (2, [2.0**22, 1.25]), (3, [1e300, 1.0]), (4, [2.0**21, 5.5])]
    got = {(r["rank"], r["vec_id"]): r["score"] for r in top_k(vectors(spark, rows), 4, "id = 0").collect()}
    ints = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if i != 3}
    assert got[(1, 3)] == 2**63 - 1
    for rank, i in ((2, 2), (3, 1), (4, 4)):
        assert got[(rank, i)] == sum(a * b for a, b in zip(ints[0], ints[i], strict=True))
    for x in ([], [1, -1], [2**15], [-(2**31), 5], [2**62]):
        assert decoded(encoded(np.array(x, dtype=np.int64))).tolist() == x


# ---- conversations


def trie(rows, step=20):
    """The digest query's rows by brute force."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(c - c % step, [])[:h] + x[h:])
    nodes = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            nodes[x[:d]].append(c)
    words = lambda t: len([w for w in t.translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ") if w])
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = sum(1 for q in under if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in nodes))
        saved = sum((len(nodes[q]) - 1) * words(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def query(spark, rows, chunk):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, node int, path string")
    turns = numbered(renamed(df))
    nodes, ends = prefix_trie(*with_heads(turns, F.col("conv") - F.col("conv") % 20, F.crc32(F.col("conv").cast("string").cast("binary")) % 4), chunk=chunk)
    out = nodes.join(list_digests(ends), "node", "left").withColumn("e", F.coalesce("sha256", F.sha2(F.lit(b""), 256)))
    return sorted(map(tuple, out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "e").collect()), key=str)


@pytest.mark.parametrize("chunk", [8, 1 << 16])
def test_trie_against_brute_force(spark, chunk):
    """Copies, shared starts, long and turnless conversations, nulls and ties; chunks of a few turns and of all."""
    r = random.Random(1)
    rows = []
    for c in range(70):
        n = 40 if c == 33 else r.randrange(1, 7)
        for t in range(n):
            same = c % 3 == 0
            rows.append((c, t, "user" if t % 2 == 0 else None, f"hello {t}" if same else r.choice(["a b c", "", None, "x\ty", "same", "é " * 50])))
    rows += [(200, None, "user", "first"), (200, 0, "user", "second"), (200, 0, "assistant", "tie"), (200, 0, "assistant", "tie"), (None, 0, "user", "nobody's"), (7, 0, "user", "one more"), (401, 0, "user", "only one")]
    assert query(spark, rows, chunk) == trie(rows)


def test_trie_of_one_hot_conversation(spark):
    """Most conversations are copies that end at one node, and most others share its start."""
    rows = [(c, t, "user", f"turn {t}") for c in range(120) for t in range(4)] + [(c, 4, "user", f"own {c}") for c in range(0, 120, 3)]
    assert query(spark, rows, 16) == trie(rows)


def test_trie_without_rows(spark):
    assert query(spark, [], 8) == []
    assert query(spark, [(None, 0, "user", "x")], 8) == []


# ---- phrases


def phrases(rows, least=10, most=2000, within=50):
    """Brute force with Python's whole numbers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for cut in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(cut, "\0")
        for piece in low.split("\0"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= within * a for q, b in cands.items()):
                continue
            score, k, l, r = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(l, t, 1, "x") for l, t in rows], "lang string, text string, n int, rank string")
    out = collocations(df.repartition(3), **more)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


def texts(seed, docs):
    r = random.Random(seed)
    names = ["the", "The", "of", "New", "york", "city", "São", "Paulo", "x", "y", "z", "日本", "a.b", "c d", "don't"]
    return [(r.choice(["en", "en", "de", None, "und"]), " ".join(r.choice(names) + r.choice(["", "", "", ",", ".", "\n", "\t", "!"]) for _ in range(r.randrange(0, 60)))) for _ in range(docs)]


def test_phrases_against_brute_force(spark):
    rows = texts(5, 220) + [("en", None), ("en", ""), (None, None), ("fr", "?!"), ("fr", "one two"), ("en", "tick " * 5000)] + [("en", "new york city hall")] * 40
    want = phrases(rows)
    assert mined(spark, rows) == want and any(r[2].count(" ") == 2 for r in want)
    assert mined(spark, rows, most=3) == phrases(rows, most=3)
    assert mined(spark, rows, least=3, within=90) == phrases(rows, least=3, within=90)


def test_phrases_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", "a b c"), (None, None)]) == []


def test_words_and_pieces():
    import pyarrow as pa

    flat, news = C.split(pa.array(["A b,c", "", None, "  ..  ", "d\te", "F"], pa.string()))
    assert flat.to_pylist() == [b"a", b"b", b"c", b"d", b"e", b"f"] and news.tolist() == [True, False, True, True, False, True]


def test_tiles_add_up_by_address_and_by_coordinates():
    """Cells of frequent and of sparse tiles, added in many pieces, in three ways."""
    r = np.random.default_rng(2)
    for tile, top in ((3, C.SIDE * C.SIDE), (-1, 1 << 40)):
        cells, counts = r.integers(0, 5000, 40000) % top, r.integers(1, 9, 40000)
        want = Counter()
        for c, k in zip(cells.tolist(), counts.tolist(), strict=True):
            want[c] += k
        for pieces in (1, 7):
            own = C.Tile(tile)
            for part in np.array_split(np.arange(len(cells)), pieces):
                own.add(cells[part], counts[part])
            got = own.total()
            assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == dict(want)
    dense = C.Tile(0)
    for _ in range(3):
        dense.add(np.arange(C.SIDE * C.SIDE), np.full(C.SIDE * C.SIDE, 2))
    assert set(dense.total()[1].tolist()) == {6} and dense.table is not None


def test_addresses_tell_pairs_apart():
    one, two = np.meshgrid(np.arange(0, 6000, 37), np.arange(0, 6000, 41))
    tile, cell = C.addressed(one.ravel(), two.ravel(), 6000, 5)
    assert len(set(zip(tile.tolist(), cell.tolist(), strict=True))) == one.size and tile.min() >= -5 and tile.max() < C.DENSE**2
