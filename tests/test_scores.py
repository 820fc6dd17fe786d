"""Scores of literal texts with values by hand, and Python's own functions on random texts."""

import math
import random
import re
import string
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.functions import fixed
from tracemill.functions import scores as S
from tracemill.functions.text import PUNCTUATION, WS, WS_IN, clean, count_of, java_pattern, sentences, strip, tokens
from tracemill.operators.features import SOLUTION_FEATURES, cohens_d, fire_rates, fitted, solution_features, step_features, step_rows, trace_features

LITERALS = {
    "vocab_richness": {"": 0, "the quick brown fox": 1, "the the the cat": 0.5},
    "avg_word_length": {"": 0, "hi there": 3.5},
    "digit_ratio": {"": 0, "hello world": 0, "12345": 1, "abc123": 0.5, "²": 1},
    "punct_ratio": {"": 0, "hello": 0, "a!": 0.5},
    "compression_ratio": {"": 1},
    "entropy": {"": 0, "aaaa": 0, "ab": 1},
    "hapax_ratio": {"a": 0, "the quick brown fox jumps over the lazy dog": 7 / 8},
    "yules_k": {"a": 0, "the the the cat cat dog bird fish fish fish": 1400},
    "heaps_exponent": {"too short": 0, " ".join(f"w{i}" for i in range(50)): 1},
    "sentence_length_cv": {"One sentence only.": 0, "One two three. One.": 0.5},
    "sentence_compression_cv": {"Only one.": 0},
    "function_word_ratio": {"": 0, "the a an is are": 1, "the cat sat on the mat": 0.5},
    "thus_therefore_ratio": {"none": 0.5, "Thus and therefore": 0.5, "thus": 1, "thusly": 0.5},
    "we_pronoun_freq": {"we We WE swe éwe": 2 / 5},
    "whitespace_pattern": {"a\n\nb\nc": 1 / 3, "a": 0},
    "numbered_step_count": {"1. a\n 2. b\nx 3. c": 2},
    "bold_section_count": {"**a** b **c**": 2},
    "solution_is_empty": {" short ": 1, "long enough!": 0},
    "paragraph_count": {"a\n\nb": 2, "": 1},
    "repetition_ratio": {"a b c": 0, "a b c d a b c d": 0.2},
    "sentence_count_log": {"": math.log1p(1), "A. B!": math.log1p(3)},
    "has_boxed_answer": {"\\boxed{1}": 1, "boxed": 0},
}


def test_literals(spark):
    rows = [(k, t, float(v)) for k, own in LITERALS.items() for t, v in own.items()]
    df = spark.createDataFrame(rows, "name string, solution string, want double")
    for r in solution_features(df, keys=("name", "want", "solution")).collect():
        assert r[r["name"]] == pytest.approx(r["want"], abs=1e-9), (r["name"], r["solution"])


def test_null_is_empty_and_all_columns_are_there(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, solution string")
    a, b = (r.asDict() for r in solution_features(df, keys=("id",)).orderBy("id").collect())
    assert {k: v for k, v in a.items() if k != "id"} == {k: v for k, v in b.items() if k != "id"} and tuple(a)[1:] == SOLUTION_FEATURES
    assert len(SOLUTION_FEATURES) == 30


def test_as_python_on_random_texts(spark):
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", " ", "\t", "\x1c", "\xa0", " ", "\n", ".", "!", "1", "😀", "日", "we", "thus"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, solution string")
    for r in solution_features(df, keys=("id",)).collect():
        t = texts[r["id"]]
        low = t.lower().split()
        c = Counter(low)
        assert r["word_count_log"] == pytest.approx(math.log1p(len(t.split()))) and r["char_count_log"] == pytest.approx(math.log1p(len(t)))
        assert r["sentence_count_log"] == pytest.approx(math.log1p(len(re.split(r"[.!?]+", t.strip()))))
        assert r["entropy"] == pytest.approx(-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0, abs=1e-9)
        assert r["hapax_ratio"] == pytest.approx(sum(n == 1 for n in c.values()) / len(c) if len(low) > 1 else 0)
        assert r["we_pronoun_freq"] == pytest.approx(len(re.findall(r"\b[Ww]e\b", t)) / len(t.split()) if t.split() else 0)
        assert r["compression_ratio"] == pytest.approx(len(zlib.compress(t.encode(), 9)) / len(t.encode()) if t else 1)
        assert 0 <= r["vocab_richness"] <= 1 and 0 <= r["punct_ratio"] <= 1


def test_text_primitives(spark):
    t = "\x1f　 a\xa0b \n"
    r = spark.range(1).select(strip(F.lit(t)).alias("s"), tokens(F.lit(t)).alias("k"), count_of(F.lit("aaaa"), "aa").alias("n"), sentences(F.lit("")).alias("p"), clean(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(r) == (t.strip(), t.split(), 2, [""], "")


def test_trace_features_with_no_one_and_two_steps(spark):
    rows = [(0, "", ""), (1, "hack it", "one two"), (2, "q", "Step 1: i cannot help. Step 2: hack the weapon now"), (3, None, None)]
    got = {r["id"]: r for r in trace_features(spark.createDataFrame(rows, "id int, query string, trace string"), keys=("id",)).collect()}
    assert [got[i]["step_count"] for i in range(4)] == [0, 1, 2, 0] and got[0]["compression_ratio"] == 1
    assert got[1]["query_unsafe_kw_density"] == 0.5 and got[1]["step_length_std"] == 0
    assert got[2]["max_step_length"] == 4 and got[2]["min_step_length"] == 3 and got[2]["step_length_std"] == 0.5
    assert got[2]["late_refusal_ratio"] == 0 and got[2]["refusal_indicator"] == pytest.approx(1 / 11 + 1 / 11 if "cannot help" in fixed.REFUSAL_PHRASES else 0)
    assert len(got[0]) == 29


def test_steps_align_with_labels(spark):
    df = spark.createDataFrame([(1, "q", "Step 1: a Step 2: b Step 3: c", [0, 1]), (2, "q", "x", [1, 0, 1]), (3, "q", "", [1])], "id int, query string, trace string, labels array<int>")
    rows = step_rows(df, labels="labels", keys=("id",))
    assert sorted(tuple(r) for r in rows.select("id", "step", "step_idx", "total_steps", "label").collect()) == [(1, "a", 0, 3, 0), (1, "b", 1, 3, 1), (2, "x", 0, 1, 1)]
    own = {(r["id"], r["step_idx"]): r for r in step_features(rows, keys=("id", "step_idx")).collect()}
    assert own[1, 1]["step_position"] == 0.5 and own[2, 0]["is_last_step"] == 1 and own[2, 0]["is_first_step"] == 1 and len(own[2, 0]) == 24


def test_signals(spark):
    cases = [
        (S.has_disclaimer, "Note: x", 0), (S.has_disclaimer, "note:x", 1), (S.has_disclaimer, "a CAVEAT.", 1), (S.has_code, "function f", 1), (S.has_code, "Def x", 0),
        (S.warning_words, "Warning, toxic detoxic", 2), (S.safety_words, "safe unsafe SAFETY", 2), (S.danger_words, "bomb bombs", 1), (S.authority_appeals, "who said NIST, according to a journal", 4),
        (S.query_danger, "how to HACK", 2), (S.step_marker_count, "Step 1: Step 22: step 3:", 2),
    ]
    for f, text, want in cases:
        assert spark.range(1).select(f(F.lit(text))).first()[0] == want, (f.__name__, text)
    assert spark.range(1).select(S.dialect_score(F.lit("y'all gonna talk about 'bout x'bout"), F.lit(1))).first()[0] == 3


def test_patterns_compile_and_agree_with_python(spark):
    texts = ["I can't help with that", "Ich kann Ihnen leider nicht helfen", "抱歉，我无法协助", "xin lỗi, tôi không thể giúp", "Как ИИ я", "ÜZGÜNÜM, yapamam", "⚠", "Here is a cake recipe.", "", "Step 2: we refuse it", "죄송합니다 도움", "instead, I suggest", "désolé, je ne peux pas vous aider"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("REFUSAL_PATTERNS", "SAFETY_PATTERNS", "INSTRUCTION_PATTERNS"):
        own = [re.compile(p, re.IGNORECASE) for p in getattr(fixed, name)]
        got = {r["t"]: r["m"] for r in df.select("t", F.rlike("t", F.lit(java_pattern(getattr(fixed, name)))).alias("m")).collect()}
        assert got == {t: any(p.search(t) for p in own) for t in texts}


def test_tables_of_features(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 3.0, 0.0), ("b", 5.0, 1.0), ("b", 7.0, 0.0)], "g string, x double, y double")
    assert {(r["g"], r["feature"]): r["fire_rate"] for r in fire_rates(df, ["x", "y"], ("g",)).collect()} == {("a", "x"): 1, ("a", "y"): 0, ("b", "x"): 1, ("b", "y"): 0.5}
    assert {r["feature"]: round(r["cohens_d"], 6) for r in cohens_d(df, ["x"], "g", "a", "b").collect()} == {"x": round(-4 / math.sqrt(2), 6)}
    assert fitted(df, ["x", "y"], 3).columns == ["g", "x", "y", "pad_2"] and fitted(df, ["x", "y"], 1).columns == ["g", "x"]


def test_stop_words_of_all_languages(spark):
    rows = spark.createDataFrame([("der Hund und le chat que la casa de",)], "t string")
    assert sorted(rows.select(S.content_words("t").alias("w")).first()["w"]) == ["casa", "chat", "hund"]
    assert len(set(fixed.STOP_WORDS)) == 707


def test_classes_are_those_of_python(spark):
    """White space, digits and punctuation, each character of the first plane by itself."""
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string").select("c", *[F.rlike("c", F.lit(f"^{p}\\z")).alias(n) for n, p in (("w", WS), ("p", PUNCTUATION), ("old", f"[{WS_IN}]"))])
    found = {r["c"]: r for r in df.collect()}
    assert {c for c in chars if found[c]["w"]} == {c for c in chars if found[c]["old"]} == {c for c in chars if c.isspace()}
    assert {c for c in chars if found[c]["p"]} == set(string.punctuation)


def test_words_of_sentences(spark):
    texts = ["", " . ", "A b. C\n\nd  e!? F", "one two", "...x y... z　u.\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(S.sentence_lengths(tokens(F.lower("t"))).alias("n"))
    assert [r["n"] for r in df.collect()] == [[n for p in re.split("[.!?]+", t) if (n := len(p.split()))] for t in texts]
