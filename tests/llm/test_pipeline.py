"""The pipeline's stages against brute force, each on its own input."""

from collections import defaultdict

import pyarrow as pa
import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

import corpus_pipeline as P
from tracemill.llm.common import table
from tracemill.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5 and P.ORACLE_SQL is None
    label = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    good = P.quality(spark, docs, SF).persist()
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    clean = [k for k, q in label.items() if q == 1]
    assert sum(k in kept for k in clean) >= 0.97 * len(clean) and sum(k in kept for k, q in label.items() if q == 0) <= 0.2 * max(1, len(label) - len(clean))

    one = P.exact(spark, good, SF).persist()
    groups = defaultdict(list)
    for r in good.collect():
        groups[r["text"].encode().lower()].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(max(v) for v in groups.values())

    near = P.near(spark, one, SF).persist()
    sets = {}
    for r in one.collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    part = {k: k for k in sets}

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({root(k) for k in ids})

    mixed = P.mixing(spark, near, SF).persist()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}
    pieces = P.packing(spark, mixed, SF).collect()
    assert sum(p["start"] == 0 for p in pieces) == mixed.count() and all(p["offset"] + p["length"] <= 1024 for p in pieces)


def test_run_and_registration(spark):
    assert P.run(spark, SF).count() > 0
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and set(SQL) <= set(QUERIES)


#: Rows with nulls in every column, empty, repeated and very long texts, ties, and columns named as inner ones might be.
CLASHES = "doc_id long, text string, lang string, source string, n_chars long, stay_id long, source_size long, target double, copies long, copy long, id long, sha string, n long, key long, own long, x string, y double, fold long, block long, `a.b` string, Doc string"
LONG = " ".join(f"w{i}" for i in range(40_000))
ODD = [(1, "one two three four five six", "s1"), (2, "ONE two three four five six", "s1"), (2, "ONE two three four five six", "s1"), (3, None, None), (None, "alone here", None), (None, None, None), (4, "", "s2"), (5, LONG, "s2"), (6, LONG + " more", "s3"), (7, " \n\t", "s3"), (8, "one two three four five six seven", "s3"), (2, "another text under one identifier", "s1")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, s, None, *[7] * 2, 0.5, *[7] * 3, "sha", *[7] * 3, "x", 1.0, 5, 6, "ab", "Doc") for i, t, s in ODD], CLASHES)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_quality_on_odd_rows(spark, odd):
    got = P.quality(spark, odd, SF)
    assert got.columns == odd.columns and set(rows_of(got)) <= set(rows_of(odd))
    assert P.quality(spark, odd.limit(0), SF).count() == 0


def test_exact_on_odd_rows(spark, odd):
    got = P.exact(spark, odd, SF)
    best: dict = {}
    for i, t, _ in ODD:
        key = (t or "").encode().lower()
        best[key] = max([x for x in (best.get(key), i) if x is not None], default=None)
    assert got.columns == odd.columns
    assert sorted(((t or "").encode().lower(), str(i)) for i, t in got.select("doc_id", "text").collect()) == sorted((k, str(i)) for k, i in best.items())
    assert P.exact(spark, odd.limit(0), SF).count() == 0


def test_near_on_odd_rows(spark, odd):
    got = P.near(spark, odd, SF)
    assert got.columns == odd.columns
    # 1 and 2 have one set, but identifier 2 has a text of its own too; 8 shares two of its three shingles; the long texts link
    assert sorted(str(r["doc_id"]) for r in got.select("doc_id").collect()) == ["1", "2", "2", "2", "3", "4", "5", "7", "8", "None", "None"]
    assert P.near(spark, odd.limit(0), SF).count() == 0


def test_mixing_as_brute_force(spark, odd):
    from collections import Counter
    from hashlib import md5

    got = P.mixing(spark, odd, SF)
    assert got.columns == odd.columns
    sizes: dict = defaultdict(int)
    for _, t, s in ODD:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    above: set = set()
    while True:
        rest, free = sum(sizes.values()) - 3 * sum(sizes[s] for s in above), sum(weight[s] for s in order if s not in above)
        more = {s for s in order if s not in above and weight[s] * rest > 3 * sizes[s] * free}
        if not more or more | above == set(order):
            break
        above |= more
    target = {s: 3.0 * sizes[s] if s in above else min(weight[s] * rest / free, 3.0 * sizes[s]) for s in order}
    want: Counter = Counter()
    for i, t, s in ODD:
        rate = target[s] / sizes[s] if sizes[s] else 1.0
        coin = int(md5(("null" if i is None else str(i)).encode()).hexdigest()[:13], 16) / 2**52
        want[str(i), t, s] += int(rate) + (coin < rate - int(rate))
    assert Counter((str(r[0]), r[1], r[2]) for r in got.select("doc_id", "text", "source").collect()) == +want
    assert P.mixing(spark, odd.limit(0), SF).count() == 0


def test_packing_as_brute_force(spark, odd):
    rows = P.packing(spark, odd, SF).collect()
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = sorted((str(i), bytes(pa.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], pa.uint32()).buffers()[1])[: 4 * (len(tok.encode(t or "", add_special_tokens=False).ids) + 1)]) for i, t, _ in ODD)
    at: dict = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append(r)
    for own in at.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 1024
    left = [r.asDict() for r in rows]
    for key, ids in want:
        start = 0
        while start < len(ids) // 4:
            piece = next(r for r in left if (str(r["doc_id"]), r["start"], r["doc_tokens"]) == (key, start, len(ids) // 4) and bytes(r["ids"]) == ids[4 * start : 4 * (start + r["length"])])
            left.remove(piece)
            start += piece["length"]
    assert not left and P.packing(spark, odd.limit(0), SF).count() == 0
