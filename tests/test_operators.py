"""Rules, steps, votes, metrics, tuning, readers, writers, streams and models on small cases."""

import json
import os
import shutil
import zipfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tracemill.functions.scores import content_tokens, content_words, has_refusal, jaccard, sentence_score
from tracemill.operators import cascade, metrics, steps, tuning, votes
from tracemill.plans import models
from tracemill.sources import caches, readers, writers
from tracemill.streaming import labels
from tracemill.streaming import traces as streaming


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_refusal_and_sentence_scores(spark):
    yes = ["I can't assist with that.", "I'm sorry, but I cannot help with that request.", "抱歉，我无法提供这方面的帮助。", "对不起，我不能协助", "Xin lỗi, tôi không thể giúp bạn."]
    no = ["To bake a cake, mix flour and sugar.", "", "   ", "The weather is sunny.", None]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert [r[0] for r in df.select(has_refusal("t")).collect()] == [True] * 5 + [False] * 5
    assert one(spark, *[sentence_score(F.lit(t)) for t in (yes[0], "", "this is illegal", "first, you should go", "a plain one")]) == ("1.0", "0.5", "0.8", "0.2", "0.5")


def test_cascade_edges(spark):
    rows = [(1, "q", "ok"), (2, "q", " abcd "), (3, "q", "I cannot help with that"), (4, "q", "x" * 3500), (5, "q", "x" * 3501), (6, "alpha beta gamma", "alpha beta gamma delta"), (7, "q", ""), (8, None, None)]
    got = {r["id"]: r for r in cascade.classify(spark.createDataFrame(rows, "id int, query string, trace string")).collect()}
    assert [got[i]["label"] for i in range(1, 9)] == ["safe", "safe", "safe", "safe", "unsafe", "unsafe", "safe", "safe"]
    assert [got[i]["detailed_label"] for i in (1, 3, 5, 8)] == ["1.0", "1.0", "0.5", "1.0"]
    ev = spark.createDataFrame([(9, False, 0.08, 3500)], "stripped int, refusal boolean, overlap double, length int")
    assert ev.select(cascade.rule()).first()[0] == "safe"
    assert one(spark, cascade.by_probability(F.lit(0.36)), cascade.by_probability(F.lit(0.35)), cascade.probability_steps(F.lit("unsafe"), F.lit(0.25), F.lit("Step 1: a Step 2: b")), cascade.probability_steps(F.lit("safe"), F.lit(0.2), F.lit(""))) == ("unsafe", "safe", "0.75|0.75", "1.0")


def test_content_words_and_overlap(spark):
    text = F.lit("The Ｃat's 日本語 well-known ﬁsh, a b")
    assert one(spark, content_tokens(text))[0] == ["the", "cats", "日", "本", "語", "wellknown", "fish", "a", "b"]
    assert one(spark, content_words(text))[0] == ["cats", "wellknown", "fish"]
    a, b, e = (F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in (("p", "q"), ("q", "r"), ()))
    assert one(spark, jaccard(a, b), jaccard(b, a), jaccard(a, e)) == (1 / 3, 1 / 3, 0.0)


def test_steps(spark):
    cases = [
        (steps.by_number, "intro Step 1: a\n Step 12: b step 3: c", ["intro", "a", "b step 3: c"]), (steps.by_number, "", []), (steps.by_number, " x ", ["x"]),
        (steps.by_marker, "lost\nStep 1: a\n Bước 2. b\n步骤3：c", ["Step 1: a", "Bước 2. b", "步骤3：c"]), (steps.by_marker, "One. Two! Three", ["One.", "Two!", "Three"]), (steps.by_marker, "", [""]), (steps.by_marker, "a Step 1: b", ["a Step 1: b"]),
        (steps.by_reply, "步骤 1： a Step 2 : b", ["a", "b"]), (steps.by_label, "pre Schritt 1. a STEP 2: b", ["pre", "a", "b"]), (steps.by_label, "", [""]),
    ]
    for f, text, want in cases:
        assert one(spark, f(F.lit(text)))[0] == want, (f.__name__, text)
    assert one(spark, steps.uniform_scores(F.lit("Step 1: a Step 2: b"), F.lit("safe")), steps.uniform_scores(F.lit(""), F.lit("unsafe"))) == ("1.0|1.0", "0.0")
    few = F.lit("Step 1: a Step 2: b")
    many = F.lit(" ".join(f"Step {i}: s{i:02d}" for i in range(1, 31)))
    cut = lambda t, m: steps.truncated(t, steps.by_number(t), m)
    assert one(spark, cut(few, 100), cut(F.lit("  "), 9))[0] == "Step 1: a\nStep 2: b"
    shown = one(spark, cut(many, 500))[0].split("\n")
    assert [s.split(": ")[1] for s in shown] == [f"s{i:02d}" for i in (1, 2, 3, 4, 5, 12, 19, 26, 27, 28, 29, 30)]
    assert len(one(spark, cut(many, 60))[0]) <= 60


def test_votes(spark):
    m = lambda **v: F.create_map(*[F.lit(x) for kv in v.items() for x in kv])
    assert one(spark, votes.safety_vote(m(a="safe", b="unsafe")), votes.safety_vote(m(a="unknown")), votes.source_vote(m(a="ai", b="human")), votes.source_vote(m(a="unknown")), votes.safety_vote(m(a="safe", b="safe", c="unsafe"))) == ("unsafe", "safe", "ai", "ai", "safe")
    assert one(spark, *[votes.source_label(F.lit(t).cast("string")) for t in (None, "Human!", "maintain", "LLM", "?")]) == ("unknown", "human", "ai", "ai", "unknown")
    assert one(spark, *[votes.safety_label(F.lit(t)) for t in (" UNSAFE", "safe.", "x")]) == ("unsafe", "safe", "unknown")
    assert one(spark, *[votes.agreement(F.lit(a), F.lit(b), F.lit("t")) for a, b in (("unknown", "unknown"), ("unknown", "x"), ("x", "unknown"), ("x", "x"), ("x", "y"))]) == ("t", "x", "x", "x", "t")
    assert one(spark, votes.legacy_label(F.lit(None).cast("string"), m(a="?", b="human")), votes.legacy_label(F.lit("ai"), m(a="human"))) == ("human", "ai")
    old = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, {"a": "x"})], "id int, votes map<string,string>")
    new = spark.createDataFrame([(1, {"b": "z"}), (3, {"c": "w"})], "id int, votes map<string,string>")
    assert {r["id"]: r["votes"] for r in votes.merge_votes(old, new).collect()} == {1: {"a": "x", "b": "z"}, 2: {"a": "x"}, 3: {"c": "w"}}
    assert sorted(r["id"] for r in votes.to_classify(spark.range(1, 5), old, ["a", "b"]).collect()) == [2, 3, 4]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    s = metrics.summary(df).first()
    assert (s["n"], s["accuracy"]) == (4, 0.5) and s["f1_macro"] == pytest.approx((2 / 3 + 0.5 + 0) / 3) and s["f1_weighted"] == pytest.approx((2 * 2 / 3 + 0.5) / 4)
    assert s["kappa"] == pytest.approx((0.5 - 5 / 16) / (1 - 5 / 16))
    assert metrics.confusion(df).agg(F.sum("n")).first()[0] == 4
    b = metrics.binary_f1(df.where("y = 'zzz'"), F.col("y") == "a", F.col("p") == "a").first()
    assert (b["f1_true"], b["f1_macro"], b["accuracy"]) == (0, 0, 0)


def test_tuning_defaults_and_first_of_ties(spark):
    none = spark.createDataFrame([], "stripped int, refusal boolean, overlap double, length int, y boolean")
    assert tuple(tuning.best_rule(tuning.rule_scores(none, "y")).first()) == (80, 3500, 0.0)
    df = spark.createDataFrame([(9, False, 0.5, 10, True), (9, False, 0.0, 10, False)], "stripped int, refusal boolean, overlap double, length int, y boolean")
    assert tuning.rule_scores(df, "y").count() == 504 and tuple(tuning.best_rule(tuning.rule_scores(df, "y")).first()) == (20, 1500, 1.0)
    p = spark.createDataFrame([(0.9, True), (0.1, False)], "p double, y boolean")
    assert tuning.threshold_scores(p, F.col("p"), F.col("y")).count() == 121 and tuple(tuning.best_threshold(tuning.threshold_scores(p, F.col("p"), F.col("y"))).first()) == (200, 1.0)


def lines(path, rows):
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_readers_and_writers(spark, tmp_path):
    s = readers.solutions(spark, lines(tmp_path / "train_a.jsonl", [{"id": "1", "solution": "x", "generator": "human"}, {"solution_id": "2", "generator": "m"}, {"solution": "z"}]))
    assert sorted((r["id"], r["label"]) for r in s.collect()) == [("", 1), ("1", 0), ("2", 1)]
    t = lines(tmp_path / "unsafe_b.jsonl", [{"id": "1", "label": " Safe", "detailed_label": [0, 1]}, {"id": "2", "label": "potentially"}, {"id": "3"}])
    assert [r["label_int"] for r in readers.traces(spark, t).orderBy("id").collect()] == [0, 1, 1]
    assert [r["label"] for r in readers.binary_traces(spark, t).orderBy("id").collect()] == ["safe", "unsafe", "unsafe"]
    assert {r["label"] for r in readers.traces_by_file(spark, t).collect()} == {"unsafe"}
    c = lines(tmp_path / "cache.jsonl", [{"id": "1", "model_labels": {"a": "safe"}}, {"id": "1", "model_labels": {"a": "unsafe"}}])
    assert [r["votes"] for r in readers.vote_cache(spark, c).collect()] == [{"a": "unsafe"}]
    g = lines(tmp_path / "legacy.jsonl", [{"id": "1", "label": "Human"}, {"id": "2", "model_labels": {"x": "?", "y": "llm"}}, {"id": "3", "model_labels": {"x": "?"}}])
    assert {r["id"]: r["label"] for r in readers.legacy_cache(spark, g).collect()} == {"1": "human", "2": "ai"}
    out = str(tmp_path / "sub")
    df = spark.createDataFrame([("1", "safe", "1.0|0.5"), ("2", "un\"s,afe", "0.0")], "id string, label string, detailed_label string")
    writers.submission(df, out, detailed=True)
    assert {r["id"]: r["label"] for r in readers.labels_csv(spark, out).where("id <> '2'").collect()} == {"1": "safe"}
    writers.zipped(spark, out, str(tmp_path / "s.zip"))
    with zipfile.ZipFile(tmp_path / "s.zip") as z:
        text = z.read("submission.csv").decode().splitlines()
    assert text[0] == "ID,label,detailed_label" and len(text) == 3
    writers.settings(spark, str(tmp_path / "conf"), threshold=0.5, names=["a"])
    assert writers.read_settings(spark, str(tmp_path / "conf")) == {"threshold": 0.5, "names": ["a"]}
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "conf")]) == str(tmp_path / "conf") and readers.first_existing(spark, []) is None


def test_a_caches_last_line_stands_whatever_the_files_sizes(spark, tmp_path):
    for k, (label, pad) in enumerate([("old", 9000), ("new", 10)]):
        path = str(tmp_path / f"c{k}")
        writers.append_cache(spark.createDataFrame([("1", {"a": "old", "pad": "x" * pad}), ("2", {"a": "only"})], "id string, model_labels map<string,string>"), path)
        writers.append_cache(spark.createDataFrame([("1", {"a": "new", "pad": "x" * (9010 - pad)})], "id string, model_labels map<string,string>"), path)
        assert {r["id"]: r["votes"]["a"] for r in readers.vote_cache(spark, path).collect()} == {"1": "new", "2": "only"}
    folder = tmp_path / "plain"
    folder.mkdir()
    lines(folder / "b.jsonl", [{"id": "1", "model_labels": {"a": "x" * 5000}}, {"id": "1", "model_labels": {"a": "first file's last"}}])
    lines(folder / "a.jsonl", [{"id": "1", "model_labels": {"a": "written later"}}])
    os.utime(folder / "b.jsonl", (1_000_000_000, 1_000_000_000))
    assert readers.vote_cache(spark, str(folder)).first()["votes"] == {"a": "written later"}


def test_ranked_summary_and_cached_features(spark, tmp_path):
    writers.ranked_summary(spark.createDataFrame([("a", 0.1), ("b", 0.7), ("c", 0.4)], "name string, f1_macro double"), str(tmp_path / "r"))
    assert [r["name"] for r in spark.read.json(str(tmp_path / "r")).collect()] == ["b", "c", "a"]
    made = []
    build = lambda: made.append(1) or spark.range(3)
    assert [writers.cached_features(build, spark, str(tmp_path / "f")).count() for _ in range(2)] == [3, 3] and len(made) == 1


def test_pairs_of_models(spark):
    rows = [(1, {"a": "ai", "b": "ai"}, "human", 1, "ai"), (2, {"a": "ai", "b": "human"}, "human", 0, "ai"), (3, {"b": "human"}, "ai", 1, None), (4, {}, "ai", 1, "ai")]
    df = spark.createDataFrame(rows, "id int, votes map<string,string>, tie string, y int, ref string")
    got = votes.evaluate_pairs(df, {"p": ("a", "b")}, "y", "ref").first().asDict()
    assert [got[k] for k in ("n", "agreed", "known", "like_reference")] == [4, 1, 2, 2] and got["accuracy"] == 0.75
    assert votes.usable(["x", "y"], {"y": 1}) == (["y"], ["x"])
    sub = votes.submission_agreement(spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string"), spark.createDataFrame([(1, "a")], "id int, label string")).first()
    assert tuple(sub) == (2, 1, 0.5)


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [{"id": str(i), "query": "how to hack it", "reasoning_trace": t} for i, t in enumerate(["I cannot help with that", "hack it like this, hack", "", "Step 1: a\nStep 2: this is illegal", "x" * 4000])]
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.json", rows[:3])
    lines(tmp_path / "in" / "b.json", rows[3:])
    streaming.append(streaming.classified(streaming.read(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    batch = cascade.classify(readers.jsonl(spark, str(tmp_path / "in"), readers.TRACES), "query", "reasoning_trace").select("id", "label", "detailed_label")
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "out")).select("id", "label", "detailed_label").collect())) == sorted(map(tuple, batch.collect()))


def test_folds(spark):
    df = spark.range(300).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    share = models.folds(df, 5).groupBy("label", "fold").count().collect()
    assert len(share) == 10 and all(abs(r["count"] - (20 if r["label"] else 40)) <= 14 for r in share)


def test_broken_lines(spark, tmp_path):
    """Blank lines are no records; a line that is no record stops the reading of any columns, or is kept apart, or left out."""
    good = [json.dumps({"id": str(i), "solution": "s", "generator": "human" if i else None}) for i in range(3)]
    (tmp_path / "a.jsonl").write_text("\n".join([good[0], "", "  \t", good[1], '{"id": "9", "solut', "no json", good[2], "[1, 2]", ""]))
    path = str(tmp_path / "a.jsonl")
    for read in (lambda: readers.solutions(spark, path).count(), lambda: readers.solutions(spark, path).select("id").collect(), lambda: readers.traces(spark, path).select("label_int").collect()):
        with pytest.raises(Exception, match="no JSON record in .*a.jsonl: "):
            read()
    rows, bad = readers.quarantined(readers.labelled_solutions(readers.jsonl(spark, path, readers.SOLUTIONS, readers.APART)))
    assert sorted((r["id"], r["label"]) for r in rows.collect()) == [("0", 1), ("1", 0), ("2", 0)]
    assert {r[readers.BROKEN] for r in bad.collect()} >= {'{"id": "9", "solut', "no json"}
    assert readers.jsonl(spark, path, readers.SOLUTIONS, readers.SKIP).where("id is not null").count() == 3
    (tmp_path / "b.jsonl").write_text("\n".join(good))
    assert readers.solutions(spark, str(tmp_path / "b.jsonl")).count() == 3


def test_positions_over_blocks_and_files(spark, tmp_path):
    """Places are dense over files in the order of names, which is not the order in which Spark reads them, and over blocks of a file."""
    want = []
    for name, n in (("train_10", 5), ("train_02", 400), ("train_1", 40)):
        lines(tmp_path / f"{name}.jsonl", [{"id": f"{name}-{i}", "solution": "x" * (i % 50)} for i in range(n)])
    for name, n in (("train_02", 400), ("train_1", 40), ("train_10", 5)):
        want += [f"{name}-{i}" for i in range(n)]
    lines(tmp_path / "valid_0.jsonl", [{"id": "v"}])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.solution_files(spark, str(tmp_path), "train")
        assert [r["id"] for r in got.orderBy("position").collect()] == sorted(want, key=lambda x: (sorted(("train_02.jsonl", "train_1.jsonl", "train_10.jsonl")).index(x.split("-")[0] + ".jsonl"), int(x.split("-")[1])))
        assert [r["position"] for r in got.orderBy("position").collect()] == list(range(445))
        assert got.select("seq.block").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert readers.solution_files(spark, str(tmp_path), "validation").first()["position"] == 0
    done = spark.range(440).select(F.col("id").cast("int").alias("idx"))
    assert sorted(r["id"] for r in votes.unanswered(got, done).collect()) == [f"train_10-{i}" for i in range(5)]


def cached(spark, path):
    return {r["id"]: dict(r["votes"]) for r in caches.read(spark, path).collect()}


def test_bucketed_cache(spark, tmp_path):
    """Later appends stand, before and after a compaction; one that died on the way is made good by the next."""
    path = str(tmp_path / "c")
    frame = lambda rows: spark.createDataFrame(rows, "id string, model_labels map<string,string>")
    assert cached(spark, path) == {} and caches.compact(spark, path) == []
    assert caches.append(frame([("1", {"a": "x", "b": "y"}), ("2", {"a": "x"}), ("3", {})]), path, 4) == 1
    assert caches.append(frame([("1", {"a": "z"}), ("4", {"c": "w"})]), path, 4) == 2
    want = {"1": {"a": "z", "b": "y"}, "2": {"a": "x"}, "3": {}, "4": {"c": "w"}}
    assert cached(spark, path) == want
    assert len(caches.compact(spark, path)) == 1 and cached(spark, path) == want and caches.lines(spark, path).count() == 4
    assert caches.compact(spark, path) == []
    assert caches.append(frame([("1", {"b": "v"})]), path, 4) == 3
    want["1"] = {"a": "z", "b": "v"}
    assert cached(spark, path) == want
    # a compaction that died after a partition was taken away and before it was written anew
    bucket = caches.lines(spark, path).where("id = '1'").first()["bucket"]
    caches.folded(caches.lines(spark, path).where(F.col("bucket") == bucket), "bucket").write.parquet(f"{path}.compacting")
    shutil.rmtree(f"{path}/bucket={bucket}")
    assert "1" not in cached(spark, path)
    caches.append(frame([("1", {"c": "new"})]), path, 4, 9)
    caches.compact(spark, path)
    assert cached(spark, path) == {**want, "1": {"a": "z", "b": "v", "c": "new"}} and not os.path.exists(f"{path}.compacting")


def test_stopped_labelling_goes_on(spark, tmp_path):
    """Whatever batch a run is stopped in, before or after its rows are written, a rerun gives the cache of a run without stops."""
    (tmp_path / "in").mkdir()
    for i in range(3):
        lines(tmp_path / "in" / f"{i}.json", [{"id": str(j), "query": "q"} for j in range(i, 7, 2)])  # some records come twice
    stream = lambda: spark.readStream.schema(readers.TRACES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    label = lambda rows: rows.select("id", F.concat(F.lit("label "), "id").alias("label"))

    def run(name, at=None, late=True):
        def fail(number):
            if number == at:
                raise RuntimeError

        def early(rows):
            if at is not None and not late and len(os.listdir(tmp_path / name)) == at:
                raise RuntimeError
            return label(rows)

        (tmp_path / name).mkdir(exist_ok=True)
        args = str(tmp_path / name), str(tmp_path / f"{name}-at")
        try:
            labels.resumed(stream(), *args, early, fail if late else lambda n: None).awaitTermination()
        except StreamingQueryException:
            labels.resumed(stream(), *args, label).awaitTermination()
        return sorted(map(tuple, labels.labelled(spark, args[0], "id string, label string").select("id", "label").collect()))

    want = run("whole")
    assert want == [(str(j), f"label {j}") for j in range(7)]
    assert run("late0", 0) == run("late1", 1) == run("late2", 2) == run("early1", 1, False) == want


def test_every_threshold(spark):
    """Against all thresholds by hand, with ties, one class, nulls and no rows."""
    def by_hand(rows):
        rows = [r for r in rows if None not in r]
        f1 = lambda tp, other: 2 * tp / (2 * tp + other) if 2 * tp + other else 0.0
        out = []
        for t in sorted({p for p, _ in rows}):
            tp, fp = sum(y and p > t for p, y in rows), sum(not y and p > t for p, y in rows)
            fn, tn = sum(y and p <= t for p, y in rows), sum(not y and p <= t for p, y in rows)
            out.append((t, tp, fp, fn, tn, (f1(tp, fp + fn) + f1(tn, fp + fn)) / 2))
        ones, zeros = [p for p, y in rows if y], [p for p, y in rows if not y]
        auc = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros)) if ones and zeros else None
        return out, auc

    cases = [[(round((i * 37 % 101) / 101, 1 + i % 2), i % 3 == 0) for i in range(60)] + [(None, True), (0.5, None)], [(0.3, True), (0.3, True)], [(0.1, False), (0.2, True)], []]
    for rows in cases:
        scores = tuning.every_threshold(spark.createDataFrame(rows, "p double, y boolean"), F.col("p"), F.col("y"))
        want, auc = by_hand(rows)
        got = [tuple(r) for r in scores.select("prob", "tp", "fp", "fn", "tn", "f1_macro").orderBy("prob").collect()]
        assert [g[:5] for g in got] == [w[:5] for w in want] and all(abs(g[5] - w[5]) < 1e-12 for g, w in zip(got, want, strict=True))
        found = tuning.area(scores).first()["auc"]
        assert (found is None) == (auc is None) and (auc is None or abs(found - auc) < 1e-12)
        best = tuning.best_of_all(scores).first()
        top = max((w[5] for w in want), default=0.0)
        assert best["threshold"] == (min(w[0] for w in want if abs(w[5] - top) < 1e-12) if top > 0 else 0.5) and abs(best["f1_macro"] - top) < 1e-12


def test_step_probabilities(spark):
    """Steps lie between the markers of replies, and numbers are written as Python writes them."""
    rows = [("步骤1：a 步骤2：b", 0.9996), ("Step 1 : a Step 2 : b", 0.5), ("Step 1: a", 0.1), ("", 1.0), ("x", 0.36), ("x", 0.87655), ("x", 0.4)]
    df = spark.createDataFrame(rows, "t string, p double").withColumn("label", cascade.by_probability(F.col("p")))
    got = [r[0] for r in df.select(cascade.probability_steps(F.col("label"), F.col("p"), "t")).collect()]
    assert got == ["0.0004|0.0004", "0.5|0.5", "1.0", "0.0", "0.64", "0.1234" if round(1 - 0.87655, 4) == 0.1234 else "0.1235", "0.6"]
