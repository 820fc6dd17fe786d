"""Each operator on odd rows (nulls, empty and long texts, ties, repeats, clashing columns, empty tables) and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm import common
from tracemill.llm.embedding_dedup import Rotations, near_vectors
from tracemill.llm.exact_dedup import NODE_BYTES, PatriciaTrie, exact_dedup, keep_one, local_tries
from tracemill.llm.lm_scoring import score_by_difference
from tracemill.llm.mixing import mix, mix_rates
from tracemill.llm.packing import cuts, pack
from tracemill.llm.quality import FEATURES, Model, classify, isotonic, keep_good, statistics
from tracemill.llm.substring_dedup import remove_repeats, repeated
from tracemill.llm.token_files import Reader, build_index, documents_of, read_tokens, shard, token_round_trip, write_tokens
from tracemill.llm.tokens import Encoder
from tracemill.llm.url_filter import judge, templates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, length int, block int"
LONG = "lorem ipsum dolor, " * 30_000
ROWS = [(4, "One two  three."), (2, "one TWO  three."), (9, None), (8, ""), (None, "alone"), (3, LONG), (3, LONG), (5, "É une Dé"), (6, "é une dé"), (7, " \t\n"), (1, "<|endoftext|> it's 12 日本  x"), (7, "one two  three.")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 4}", 1, 7, 8, 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# ---- helpers


def test_words_are_split_at_ascii_white_space_alone():
    texts = ["", None, " a\tb\x0bc\x0c d\r\n", "x\x1cy z", "A É"]
    flat, starts = common.words(pa.array(texts))
    assert flat.to_pylist() == [w.decode() for t in texts for w in (t or "").encode().split()]
    assert starts.tolist() == [0, 0, 0, 4, 6, 8]
    same = common.word_hashes(pa.array(["ÉA b"]), lower=True)[0].tolist()
    assert same == common.word_hashes(pa.array(["Éa B"]), lower=True)[0].tolist() != common.word_hashes(pa.array(["éa b"]), lower=True)[0].tolist()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            part[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in part}


# ---- 1


def test_url_rules_and_templates(spark, empty):
    urls = ["http://A.Example.org/es/1", "https://x.example.org/en/12?q", "https://x.example.org/en/2#f", "ftp://com/de/3", "http://acom/de/3", "http://b.com", "no scheme", None, "://h/p", "http://b.com/fr/é", "http://h.net/es/9", "http://h.net/it/9"]
    many = [f"http://h{k % 9}.example.org/es/{k}" for k in range(40)] + [f"http://h{k % 9}.example.org/it/{k}" for k in range(40)]
    deep = "http://d.net/" + "/".join(f"s{k}" for k in range(3000))
    rows = [(k, u, "x", "clash") for k, u in enumerate(urls + many + [deep, deep])] + [(None, urls[0], "x", "clash")]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: tuple(r[:5]) for r in got}
    assert by[0][1:] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[1][1:] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert by[2][1:] == ("x.example.org", "/en/2", "org/", "allow")
    assert by[3][1:] == ("com", "/de/3", "com/de/", "block")
    assert by[4][3] is None and by[5][1:4] == ("b.com", "", None) and by[6][1:4] == ("", "", None) == by[7][1:4]
    assert by[8][1:4] == ("h", "/p", None) and by[9][3] == "com/fr/"
    assert by[10][4] == "block" and by[11][4] == "allow"  # by their templates on other hosts
    assert by[None][4] == "block" and by[len(urls + many)][1] == "d.net"
    assert judge(empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))).count() == 0


def alike(b1, g1, b2, g2):
    p = (b1 + b2) / (b1 + b2 + g1 + g2)
    return (b1 / (b1 + g1) - b2 / (b2 + g2)) ** 2 <= 3.8416 * p * (1 - p) * (1 / (b1 + g1) + 1 / (b2 + g2))


def tree_by_hand(urls):
    """Templates of {(host, path): (n, bad, good)}, one node at a time."""
    shapes = {u: [re.sub("[0-9]+", "#", s) for s in u[1].split("/") if s] for u in urls}
    shapes = {u: s[:12] + ["**"] * (len(s) > 12) for u, s in shapes.items()}
    node = dict.fromkeys(urls, "")
    for level in range(max(map(len, shapes.values()), default=0)):
        kids, pooled = defaultdict(list), defaultdict(lambda: [0, 0])
        for u, s in shapes.items():
            if len(s) > level:
                kids[u[0], node[u], s[level]].append(u)
                pooled[node[u], s[level]][0] += urls[u][1]
                pooled[node[u], s[level]][1] += urls[u][2]
        parents, names = defaultdict(list), {}
        for (host, at, seg), own in kids.items():
            parents[host, at].append((seg, own))
        for (host, at), children in parents.items():
            sure, rest = [], defaultdict(list)
            for seg, own in children:
                counts = [sum(urls[u][i] for u in own) for i in (1, 2)]
                counts = counts if sum(counts) >= 5 else pooled[at, seg] if sum(pooled[at, seg]) >= 5 else None
                if counts:
                    sure.append((counts[0] / sum(counts), seg, *counts))
                else:
                    below = [len(shapes[u]) - level - 1 for u in own]
                    rest[min(below), max(below)].append((seg, sum(urls[u][0] for u in own)))
            cells, branches = defaultdict(list), []
            for share, seg, b, g in sorted(sure):
                cells[int(share * 64)].append((seg, b, g))
            for _, own in sorted(cells.items()):
                b, g = sum(x[1] for x in own), sum(x[2] for x in own)
                if branches and all(alike(*x, b, g) for x in branches[-1][:2]):
                    (b0, g0), low, held = branches[-1]
                    branches[-1] = ((b0 + b, g0 + g), low, held + own)
                else:
                    branches.append(((b, g), (b, g), own))
            branches = [held for _, _, held in branches]
            for own in branches:
                for seg, *_ in own:
                    names[host, at, seg] = seg if len(own) == 1 else min(x[0] for x in own) + "+"
            k, pages = sum(map(len, rest.values())), sum(n for own in rest.values() for _, n in own)
            for own in rest.values():
                for seg, _ in own:
                    names[host, at, seg] = "*" if len(own) > 1 or (k >= 8 and k * k >= pages) else seg
        node = {u: f"{node[u]}/{names[u[0], node[u], s[level]]}" if len(s) > level else node[u] for u, s in shapes.items()}
    return {u: t + ("" if t and not u[1].endswith("/") else "/") for u, t in node.items()}


def test_url_tree_as_by_hand(spark):
    rng = random.Random(10)
    urls = {}
    for _ in range(700):
        host = rng.choice(["a.com", "b.com", "c.net", ""])
        parts = [rng.choice(["user", "shop", "es", "fr", "about"]), rng.choice([f"n{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}", "item", "list"]), rng.choice(["a", "b", "7", "12"])]
        path = "/" + "/".join(parts[: rng.randrange(4)]) + rng.choice(["", "/"])
        n = rng.randrange(1, 4)
        bad = rng.randrange(n + 1) if rng.random() < {"es": 0.9, "shop": 0.4}.get(parts[0], 0.1) else 0
        urls[host, path] = (n, bad, rng.randrange(n - bad + 1) if rng.random() < 0.5 else 0)
    rows = spark.createDataFrame([(*u, *v) for u, v in urls.items()], "host string, path string, n long, bad long, good long")
    got = {(r["host"], r["path"]): r["template"] for r in templates(rows).collect()}
    assert got == tree_by_hand(urls) and len(set(got.values())) < len(got) / 3


def test_similarity_is_not_handed_on(spark):
    """Siblings with 0, 1, ... 20 bad pages of 20: no branch holds two that differ, so clean and bad ones stay apart."""
    names = [f"s{chr(97 + k)}" for k in range(21)]
    rows = spark.createDataFrame([("h.net", f"/{s}/x", 20, k, 20 - k) for k, s in enumerate(names)], "host string, path string, n long, bad long, good long")
    branch = defaultdict(list)
    for r in templates(rows).collect():
        branch[r["template"]].append(r["bad"])
    assert sorted(x for own in branch.values() for x in own) == list(range(21)) and 3 <= len(branch) < 12
    assert all(alike(a, 20 - a, b, 20 - b) for own in branch.values() for a in own for b in own)


def test_depth_is_a_parameter(spark):
    path = "/" + "/".join(f"s{chr(97 + k)}" for k in range(15))
    rows = spark.createDataFrame([("h.net", path, 9, 9, 0), ("h.net", path + "x", 9, 0, 9)], "host string, path string, n long, bad long, good long")
    assert [r["template"].count("/") for r in templates(rows).collect()] == [13, 13] and templates(rows).select("template").distinct().count() == 1
    assert sorted(r["template"] for r in templates(rows, depth=None).collect()) == [path, path + "x"]


def test_variable_segments_below_variable_segments(spark):
    letters = "abcdefghijklmnopqrst"
    urls = [(f"http://h.net/user/{x * 3}/item/{y}",) for x in letters for y in ("red", "blue", "tall", "wide")] + [("http://h.net/about",), ("http://h.net/help/",)]
    got = judge(spark.createDataFrame([(k, *u) for k, u in enumerate(urls)], "page_id long, url string")).collect()
    assert {r["template"] for r in got} == {"/user/*/item/*", "/*", "/*/"}


# ---- 3


def test_mixing(spark, docs, empty):
    got = mix_rates(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode().split()) for _, t in ROWS)
    assert all(r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3 for r in got)
    sizes = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in sizes.values()) == pytest.approx(sum(s for s, _ in sizes.values()))
    assert all(t <= 3 * s + 1e-9 for s, t in sizes.values()) and None in sizes
    assert Counter(r["doc_id"] for r in mix(docs).collect()) == Counter({k: v for k, v in Counter(k for r in got for k in [r["id"]] * r["copies"]).items()})
    assert mix(docs).columns == docs.columns and mix_rates(empty).count() == 0 == mix(empty).count()


# ---- 4, 6


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_tokenizers(name, byte_level):
    e, rng = Encoder(path(name), byte_level), random.Random(2)
    alphabet = ["a", "B", "é", "É", "ß", "Σ", " ", " ", "\n", "\t", "'s", "'", "1", ".", ",", "!", "́", "<|endoftext|>", "\x1f", "\x85", " ", "　", "😀", "日", "한", "İ"]
    texts = [t for _, t in ROWS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(3000)]
    ids, starts = e.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_packing(spark, docs, empty):
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = pack(docs, path("byte_bpe_50k.json")).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] * 4 == len(r["ids"])
            at += r["length"]
        assert at <= 1024
    for (key, n), own in pieces.items():
        texts = [t for k, t in ROWS if k == key and len(tok.encode(t or "", add_special_tokens=False).ids) + 1 == n]
        want = sorted(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes() for t in texts)
        joined = [b"".join(r["ids"] for r in sorted(own, key=lambda r: r["start"]))] if len(texts) == 1 else None
        assert joined in (None, want) and sum(r["length"] for r in own) == n * len(texts)
    assert sum(r["length"] for r in rows) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert cuts(2000, 1024, 64) == [1024, 512, 256, 128, 64, 16] and pack(empty, path("byte_bpe_50k.json")).count() == 0


def test_token_files(spark, docs, empty):
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_round_trip(docs, path("word_bpe_49k.json")).collect())
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
    assert sorted((g[1] is not None, g[1] or 0, *g[2:]) for g in got) == sorted((k is not None, k or 0, len(ids(t)), zlib.crc32(ids(t).tobytes())) for k, t in ROWS)
    at, last = 0, -1
    for start, key, n, _ in got:
        assert start == at and (key if key is not None else -1) >= last
        at, last = at + n, key if key is not None else -1
    assert token_round_trip(empty, path("word_bpe_49k.json")).count() == 0


def test_a_hot_key_runs_over_shards(spark, tmp_path):
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = [(5 if k % 3 else k, f"word{k} " * (k % 9)) for k in range(300)] + [(None, "x y")] * 40
    write_tokens(frame(spark, rows), path("word_bpe_49k.json"), str(tmp_path / "f"), most=50)
    stored = spark.read.parquet(str(tmp_path / "f"))
    assert stored.agg(F.max("n_ids")).first()[0] < 100 and stored.where("low = 5 and high = 5").count() > 3
    ids = lambda t: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
    got = Counter((r["key"], bytes(r["ids"])) for r in documents_of(spark, str(tmp_path / "f"), [5, 30, 7, 10**9]).collect())
    assert got == Counter((k, ids(t)) for k, t in rows if k in (5, 30))
    whole = sorted((r["start"], r["n_tokens"]) for r in read_tokens(spark, str(tmp_path / "f")).collect())
    assert len(whole) == len(rows) and all(a + n == b for (a, n), (b, _) in zip(whole, whole[1:], strict=False))


def test_minimal_perfect_hash():
    for n in (1, 2, 5, 1000, 5000):
        keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, size=n))
        assert sorted(build_index(keys)[1].tolist()) == list(range(len(keys)))
    names = ("part", "piece", "n_ids", "low", "high", "width", "payload", "keys", "nulls", "displacements", "slots")
    row = dict(zip(names, shard(0, 0, [np.arange(k, dtype=np.uint32) + 60_000 for k in range(1, 6)], [None, 3, 3, 8, 10]), strict=True))
    r = Reader(row)
    first, run = r.find(np.array([3, 8, 10, 99]))
    assert (first[:3].tolist(), run[:3].tolist()) == ([1, 3, 4], [2, 1, 1]) and r.document(3).tolist() == [60_000, 60_001, 60_002, 60_003]


# ---- 5


def test_exact_dedup(spark, docs, empty):
    norm = lambda t: (t or "").encode().lower()
    groups = defaultdict(list)
    for k, t in ROWS:
        groups[norm(t)].append(k)
    top = {t: max([k for k in ks if k is not None], default=None) for t, ks in groups.items()}
    got = exact_dedup(docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["keep_id"] or -1, r["group_size"], r["text_sha256"]) for r in got) == sorted((k is not None, k or 0, top[norm(t)] or -1, len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()) for k, t in ROWS)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(t).hexdigest(): 1 for t in groups})
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup(empty).count() == 0 == keep_one(empty).count()
    assert {r["keep_id"] for r in exact_dedup(docs, keep="smallest").where("group_size = 3").collect()} == {2}


def test_trie():
    rng, held = random.Random(4), Counter()
    trie, top = PatriciaTrie(), {}
    for i in range(3000):
        k = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))
        before = trie.size
        owner = rng.randrange(50) if rng.random() < 0.9 else None
        trie.insert(k, owner, i)
        assert (trie.size > before) == (k not in held)
        held[k] += 1
        top[k] = max([x for x in (top.get(k), owner) if x is not None], default=None)
    assert {k: (v[0], v[2]) for k, v in trie.items()} == {k: (top[k], n) for k, n in held.items()}


def test_a_trie_filled_in_order_holds_one_path():
    for seed in range(40):
        rng = random.Random(seed)
        keys = sorted(bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randrange(1, 60)))
        trie, got = PatriciaTrie(), []
        for i, k in enumerate(keys):
            got += trie.settled(k)
            trie.insert(k, i, i, 1, i)
            assert len(list(trie.items())) == 1
        got += trie.items()
        assert [b for b, _ in got] == sorted(set(keys)) and sorted(x for _, v in got for x in v[3]) == list(range(len(keys)))


def test_a_trie_sheds_whole_subtrees():
    for seed in range(40):
        rng = random.Random(seed)
        keys = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(60)}
        trie = PatriciaTrie()
        for i, k in enumerate(sorted(keys)):
            trie.insert(k, i, i)
        goal = rng.randrange(trie.size)
        before, out = trie.size, [k for k, _ in trie.shed(goal)]
        left = [k for k, _ in trie.items()]
        assert sorted(out + left) == sorted(keys) and goal <= before - trie.size <= goal + 12 + NODE_BYTES
        assert trie.size == sum(len(k) + NODE_BYTES for k in left)
        gone = set(out)
        for i, k in enumerate(out):  # what went lies below a common node, but for the ways to it
            assert not any(k.startswith(x) and k != x for x in out[:i])
        for k in keys:  # a trie that has shed takes strings again
            trie.insert(k, 1, 1)
        assert sorted(k for k, _ in trie.items()) == sorted(keys) and gone <= keys


def test_the_largest_trie_is_spilled_first(monkeypatch):
    monkeypatch.setattr("tracemill.llm.exact_dedup.TaskContext", type("Here", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())}))
    texts = ["a" * 5, "b" * 30, "c" * 20000, "d" * 9000]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], names=["id", "text"])
    told = [b for out in local_tries("largest", 25000)(iter([batch])) for b in out["body"].to_pylist() if b is not None]
    assert [len(b) for b in told] == [20000, 9000, 30, 5]


def test_of_rows_that_repeat_one_stays(spark):
    """The first by the other columns, with a map beside it."""
    rows = [(7, "Same Text", f"s{i % 3}", {"k": i % 3}) for i in range(300)] + [(8, "other", None, None), (None, "x", "b", {}), (None, "X", "a", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `so.urce` string, m map<string,int>").repartition(6)
    for d, m in ((docs, {"k": 0}), (docs.drop("m"), None)):
        got = keep_one(d)
        assert got.columns == d.columns
        assert sorted(((r[0] or 0), r[1], r[2] or "") for r in got.collect()) == [(0, "X", "a"), (7, "Same Text", "s0"), (8, "other", "")]
        if m:
            assert got.where("doc_id = 7").first()["m"] == m


def test_tries_that_are_spilled_lose_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr("tracemill.llm.exact_dedup.TRIE_BYTES", 2000)
    monkeypatch.setattr("tracemill.llm.exact_dedup.BITS", 1)
    rng = random.Random(9)
    rows = [(k, f"{rng.choice('abc')}{rng.randrange(40):03}" * 20) for k in range(600)] + ROWS
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    got = exact_dedup(frame(spark, rows)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(list)
    for k, t in rows:
        groups[hashlib.sha256((t or "").encode().lower()).hexdigest()].append(k)
    assert len(got) == len(rows) and all(r["group_size"] == len(groups[r["text_sha256"]]) for r in got)
    assert all(r["keep_id"] == max((k for k in groups[r["text_sha256"]] if k is not None), default=None) for r in got)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(dict.fromkeys(groups, 1))


# ---- 7


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr("tracemill.llm.embedding_dedup.CHUNK", 20)  # so that buckets are dealt out as pairs of chunks
    rng = np.random.default_rng(5)
    base, short = rng.normal(size=(12, 24)), rng.normal(size=(3, 7))
    rows = [(base[k % 12] + rng.normal(size=24) * 0.02).tolist() for k in range(300)] + rng.normal(size=(600, 24)).tolist() + [base[0].tolist()] * 4
    fewer = [(short[k % 3] + rng.normal(size=7) * 0.01).tolist() for k in range(30)] + [[1.0], [2.5], [-1.0]]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, None] + [0.0] * 22, [1.0] * 3]
    every = [*rows, *fewer, *odd]
    table = [(k, v, k, "x") for k, v in enumerate(every)] + [(None, rows[0], 0, "x")]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, node string")).collect()}
    assert len(got) == len(table)
    have, want = 0, 0
    for keys in ([*range(len(rows)), None], range(len(rows), len(rows) + 30), range(len(rows) + 30, len(rows) + 33)):
        x = np.array([every[k] if k is not None else rows[0] for k in keys], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link = x @ x.T >= 0.95
        np.fill_diagonal(link, False)
        found = np.array([got[k]["n_links"] for k in keys])
        have, want = have + found.sum(), want + link.sum()
        assert (found <= link.sum(axis=1)).all()
    assert have >= 0.99 * want
    lone = range(len(rows) + len(fewer), len(every))
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in lone)
    assert len({got[k]["component_id"] for k in range(300)}) == 12 and not got[None]["kept"]
    assert len({got[k]["component_id"] for k in range(len(rows), len(rows) + 30)}) == 3
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(8)
    for d in (5, 64, 300):
        r = Rotations(d, 16, 4)
        x = rng.normal(size=(400, d))
        y = x + rng.normal(size=(400, d)) * rng.uniform(0.05, 1.5, size=(400, 1))
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
        code, factor, _, _ = r.encoded(x)
        _, _, coarse, scale = r.encoded(y)
        factor, scale = np.array(factor), np.array(scale)
        estimate = (r.coordinates(coarse, scale) * (r.signs(code).astype(float) * 2 - 1)).sum(axis=1) / factor
        own, rounding = r.errors(factor)
        z = (estimate - (x * y).sum(axis=1)) / np.sqrt(own**2 + (rounding * 2 * scale / 15) ** 2)
        assert abs(z.mean()) < 0.25 and (np.abs(z) < 4).mean() > 0.995


# ---- 8


def quality_rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for k in range(600):
        good = k % 4 > 0
        w = [word() for _ in range(rng.randrange(40, 160))]
        text = ". ".join(" ".join(w[i : i + 9]).capitalize() for i in range(0, len(w), 9)) if good else " ".join(w[:2] * 60) if k % 8 else "!! ".join(x.upper() for x in w)
        rows.append((k, text))
        labels.append((k, int(good)))
    return rows, labels


def test_quality(spark, empty):
    rows, labels = quality_rows()
    truth = dict(labels)
    docs = frame(spark, [*rows, (None, rows[1][1]), (700, None), (701, ""), (702, LONG), (3, rows[3][1])])
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (8, truth[8])], "doc_id long, quality int")
    got = classify(docs, lab).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    kept = keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert {r["score"] for r in classify(docs, lab.limit(0)).collect()} == {0.5} and classify(empty, lab).count() == 0


def test_quality_as_brute_force(spark):
    """The same model in one piece of numpy, from all labelled rows at once."""
    rows, labels = quality_rows()
    x = statistics(pa.array([t for _, t in rows]))
    y, part = np.array([q for _, q in labels], dtype=float), np.array([zlib.crc32(str(k).encode()) % 4 for k, _ in rows])
    learn = (part != 2) & (part != 3)
    model = Model(x[learn].mean(axis=0), np.sqrt((x[learn] ** 2).mean(axis=0) - x[learn].mean(axis=0) ** 2) + 1e-6, FEATURES)
    z = model.cosines(x[learn])
    model.weights = np.linalg.solve(z.T @ z + np.diag([1.0] * FEATURES + [1e-6]), z.T @ y[learn])
    raw = np.round(np.clip(model.raw(x), -1, 2), 3)
    bins = np.unique(raw[part == 3])
    model.steps = isotonic(bins, np.array([y[(part == 3) & (raw == b)].mean() for b in bins]), np.array([((part == 3) & (raw == b)).sum() for b in bins], dtype=float))
    got = {r["doc_id"]: r["score"] for r in classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert np.allclose([got[k] for k, _ in rows], model.score(x), atol=1e-5)


def test_no_task_but_those_of_the_labels_is_narrowed(spark):
    rows, labels = quality_rows()
    plan = classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Exchange" not in plan


def test_isotonic():
    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 0.8, 0.2, 1.0]), np.array([1.0, 1, 1, 2]))
    assert y.tolist() == [0, 0, 0.5, 0.5, 1, 1] and (np.diff(x) >= 0).all()


# ---- 9


def test_lm_scores_as_brute_force(spark, empty, monkeypatch):
    """Every word and pair counts, rare ones too, and a document is scored by models that do not hold it."""
    monkeypatch.setattr("tracemill.llm.lm_scoring.CHUNK_TOKENS", 400)
    monkeypatch.setattr("tracemill.llm.lm_scoring.SHARD_BYTES", 4000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    rng = random.Random(7)
    rows = [(k, " ".join(f"Word{'abcdefghij'[rng.randrange(10)] * 3}{rng.choice('klmnopqrst')}{rng.choice('uvwxyz')}{rng.choice('abcdefgh')}" for _ in range(60))) for k in range(120)]
    rows += [(90, None), (91, " "), (None, "aa bb"), (3, "zz"), (3, "zz"), (200, "common goodword"), (201, "common badword"), (1, "common goodword"), (202, "a a b a a"), (203, "only Only here")]
    other = [(1, "aa bb common"), (2, None)]
    docs, ids = frame(spark, rows), [*range(40), 203]
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    extra = [(t or "").encode().lower().split() for _, t in other]

    def counts(texts):
        pairs = Counter(x for w in texts for x in zip([None, *w], w, strict=False))
        after, one = Counter(), Counter()
        for (h, w), n in pairs.items():
            after[h] += n
            one[w] += n
        return pairs, after, one, sum(one.values())

    vocabulary = len({w for t in [*tokens, *extra] for w in t})
    assert vocabulary > 2048
    models = counts([*[w for w, (k, _) in zip(tokens, rows, strict=True) if k in ids], *extra]), counts(tokens)

    def loss(w, own, total):
        (p, a, u, n), (q, b, v, m) = own, total
        scale = 1.0
        if total is models[1]:
            left = models[0][3] - (n if taken else 0)
            scale = left / (m - n) if left > 0 and m > n else 1.0
        minus = 1 if total is models[1] or taken else 0
        out = [-np.log(((q[h, x] - minus * p[h, x]) * scale + 4 * ((v[x] - minus * u[x]) * scale + 1) / ((m - minus * n) * scale + vocabulary)) / ((b[h] - minus * a[h]) * scale + 4)) for h, x in zip([None, *w], w, strict=False)]
        return np.mean(out) if out else 0.0

    want = []
    for (k, _), w in zip(rows, tokens, strict=True):
        taken = k in ids
        t, b = (loss(w, counts([w]), m) for m in models)
        want.append((str(k), len(w), t, b, t - b))
    wanted = spark.createDataFrame([(k,) for k in [*ids, *ids, 999, None]], "doc_id long")
    got = score_by_difference(docs, frame(spark, other), wanted=wanted).collect()
    have = sorted((str(r["doc_id"]), r["n_tokens"], r["ce_target"], r["ce_background"], r["score"]) for r in got)
    assert len(have) == len(want)
    for x, y in zip(have, sorted(want), strict=True):
        assert x[:2] == y[:2] and np.allclose(x[2:], y[2:], atol=1e-9)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[200] < by_id[201]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    uniform = score_by_difference(docs).where("n_tokens > 0").collect()
    assert np.allclose([r["ce_target"] for r in uniform], np.log(vocabulary)) or np.allclose([r["ce_target"] for r in uniform], np.log(len({w for t in tokens for w in t})))
    assert score_by_difference(empty, empty).count() == 0


# ---- 10


def test_substring_dedup_as_brute_force(spark, docs, empty, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(3))
    passages = [" ".join(word() for _ in range(n)) for n in (12, 13, 14, 40)]
    rows = []
    for k in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(30))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(5))]
        rows.append((k if k % 17 else None, " \n".join(parts)))
    rows += [(5, rows[6][1]), (5, rows[6][1]), (200, None), (201, rows[9][1]), *ROWS, *[(300, LONG)] * 3, *[(None, LONG)] * 2]
    monkeypatch.setattr("tracemill.llm.substring_dedup.BLOCK_BYTES", 200_000)
    monkeypatch.setattr("tracemill.llm.substring_dedup.FLUSH", 400)
    got = remove_repeats(frame(spark, rows)).collect()
    least: dict = {}
    words = [(t or "").encode().split() for _, t in rows]
    rank = [float("inf") if k is None else k for k, _ in rows]
    for r, w in zip(rank, words, strict=True):
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            least[key] = min(least.get(key, r), r)
    want = []
    for (k, _), r, w in zip(rows, rank, words, strict=True):
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < r for j in range(i, i + 13)}
        want.append((str(k), b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(w), len(gone)))
    assert sorted((str(r["doc_id"]), r["kept"], r["n_words"], r["n_removed"]) for r in got) == sorted(want)
    assert sum(x[3] for x in want) > 0 and remove_repeats(empty).count() == 0


def test_the_sketch_never_estimates_too_little():
    rng = np.random.default_rng(3)
    once, twice = rng.integers(0, 1 << 32, 40_000, dtype=np.uint64), rng.integers(0, 1 << 32, 500, dtype=np.uint64)
    found = repeated(np.concatenate([once, twice, twice]))
    assert found[len(once) :].all() and found[: len(once)].mean() < 0.05
    assert repeated(np.zeros(0, dtype=np.uint64)).tolist() == [] and repeated(np.array([7, 7, 9], dtype=np.uint64)).tolist()[:2] == [True, True]


def test_block_numbers_do_not_overflow(spark, monkeypatch):
    monkeypatch.setattr("tracemill.llm.substring_dedup.BLOCK_BYTES", 1)
    monkeypatch.setattr("tracemill.llm.substring_dedup.NONE", np.uint32(50))
    with pytest.raises(ValueError, match="blocks"):
        remove_repeats(frame(spark, [(1, "a" * 60)]))
