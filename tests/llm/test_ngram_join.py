import random
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tracemill.llm import ngram_join
from tracemill.llm.ngram_join import LOCAL_LEAF, MEMBER, SMALL_LEAF, bands, boxes, entries, jaccard_components, layout, leaves, set_ids, shingle_sets, ship, summed_minima

SCHEMA = "doc_id long, text string, lang string, id long, n int"


def brute(rows, width, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(r[1]) for r in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and k * den >= num * (len(sets[i]) + len(sets[j]) - k):
                part[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows, width, similarity):
    docs = spark.createDataFrame([(i, t, None, 5, 1) for i, t in rows], SCHEMA)
    return sorted([tuple(r) for r in jaccard_components(docs, width=width, similarity=similarity).collect()], key=str)


@pytest.mark.parametrize(("width", "similarity", "num", "den", "page"), [(3, 0.9, 9, 10, 4096), (5, 0.8, 4, 5, 4096), (5, 0.8, 4, 5, 40)])
def test_as_brute_force_on_many_near_copies(spark, monkeypatch, width, similarity, num, den, page):
    """A group of near copies at all distances, so that leaves hold several components and are opened, in one page and in many."""
    monkeypatch.setattr("tracemill.llm.ngram_join.PAGE", page)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for _ in range(220):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = word()
        rows.append((len(rows), " ".join(w)))
    for n in (1, 2, 4, 6, 9, 14, 30):
        short = [word() for _ in range(n)]
        for k in range(6):
            w = list(short)
            if k > 2 and n > 4:
                w[k % n] = word()
            rows.append((len(rows), ("\t" if k % 2 else " ").join(w).upper() if k == 1 else " ".join(w)))
    assert run(spark, rows, width, similarity) == brute(rows, width, num, den)


@pytest.mark.parametrize(("width", "similarity", "swaps"), [(3, 0.9, 70), (5, 0.8, 88)])
def test_long_texts_at_the_threshold(spark, width, similarity, swaps):
    """Texts with one forest of over 300 blocks: every pair just at the threshold is found, and none just below it."""
    rng = random.Random(11)
    n = 3990 if width == 3 else 3960
    assert layout(9 if width == 3 else 4, 10 if width == 3 else 5, n) [1] == 1 < 300 < layout(9 if width == 3 else 4, 10 if width == 3 else 5, n)[0]
    rows = []
    for k in range(30):
        base = [f"{k}w{i}" for i in range(n + width - 1)]
        for extra in (0, 1):
            w = list(base)
            for i in rng.sample(range(1, (n - width) // 8), swaps + extra):
                w[i * 8] = f"{k}x{i}"
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(w))] if not extra else [(len(rows), " ".join(f"{k}y{x}" for x in base)), (len(rows) + 1, " ".join(f"{k}y{x}" for x in w))]
    got = run(spark, rows, width, similarity)
    assert [c for _, _, c in sorted(got)] == [i // 2 * 2 if i % 4 < 2 else i for i in range(120)]


def test_boxes_never_skip_a_pair_within_the_bound():
    rng = np.random.default_rng(12)
    counts = rng.poisson(3, size=(300, 64)).astype(np.int32)
    n = counts.sum(axis=1)
    leaves_, largest, least = boxes(counts, n, np.arange(300))
    assert sorted(np.concatenate(leaves_).tolist()) == list(range(300))
    bound, upper = summed_minima(counts, counts), summed_minima(largest, largest)
    for a, x in enumerate(leaves_):
        for b, y in enumerate(leaves_):
            assert (bound[np.ix_(x, y)] <= upper[a, b]).all() and least[a] == n[x].min()


@pytest.mark.parametrize("page", [2048, 60])
def test_points_are_shipped_few_times(spark, monkeypatch, tmp_path, page):
    """A point lies in leaves of many smallest points, but is not compared below each of them again, nor with its own component.

    Before leaves were gathered, the 300 points made 4720 rows with pages of 2048 points, and 12376 with pages of 60.
    """
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = []
    for k in range(300):
        w = list(base)
        for i in rng.sample(range(len(w)), 1 if k % 6 else 6):
            w[i] = word()
        rows.append((k, " ".join(w)))

    def counted(num, den, real=ngram_join.compared):
        def run(key, part):
            (tmp_path / uuid.uuid4().hex).write_text(str(part.num_rows))
            return real(num, den)(key, part)

        return run

    monkeypatch.setattr(ngram_join, "compared", counted)
    monkeypatch.setattr(ngram_join, "PAGE", page)
    assert run(spark, rows, 5, 0.8) == brute(rows, 5, 4, 5)
    shipped = sum(int(f.read_text()) for f in tmp_path.iterdir())
    assert 300 <= shipped <= (900 if page == 2048 else 1500)


@pytest.mark.parametrize("elsewhere", [1, 3])
def test_leaf_hot_in_one_task_with_few_points_elsewhere(elsewhere):
    """All points of a leaf with more than SMALL_LEAF are its members, whichever task ships them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    near = lambda: " ".join(w if rng.random() > 1 / 120 else word() for w in base)
    texts = [pa.array([near() for _ in range(n)]) for n in (300, elsewhere)]
    rows = pa.Table.from_batches([r for t in texts for r in ship(9, 10, 3, 2)(iter([pa.record_batch([t], names=["text"])]))])
    found = [leaves(rows.filter(pc.equal(rows["shard"], s))) for s in range(4)]
    members = {(a, b) for f in found for k, a, b in zip(*(f[c].to_pylist() for c in ("kind", "a", "b")), strict=True) if k == MEMBER}
    points: dict = {}
    for t in texts:
        values, starts = shingle_sets(t, 3)
        for key, name in zip(*entries(values, starts, set_ids(values, starts), 9, 10), strict=True):
            points.setdefault(int(np.uint64(key).view(np.int64)), set()).add(int(name))
    want = {(k, n) for k, own in points.items() if len(own) > SMALL_LEAF for n in own}
    assert want <= members and max(map(len, points.values())) > LOCAL_LEAF


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \n"), (None, "a b c"), (7, "A b  c"), (7, "A b  c"), (9, long), (8, long), (None, "only null"), (2, "x"), (1, "x"), (6, "x y")]
    got = run(spark, rows, 3, 0.9)
    assert got == brute(rows, 3, 9, 10)


def test_empty_table(spark):
    assert run(spark, [], 5, 0.8) == []


def test_links_lie_in_neighbouring_bands():
    edges = bands(4, 5, 3000)
    band = lambda n: next(i for i, e in enumerate(edges) if n <= e)
    for n in range(1, 2400):
        assert band(n * 5 // 4) - band(n) <= 1
    assert layout(4, 5, 8)[1] > layout(4, 5, 400)[1] == 1
