"""The rules as SQL functions, against the Columns."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import scores as S
from tracemill.functions import sql
from tracemill.functions.text import clean
from tracemill.operators import cascade, steps
from tracemill.plans.queries import SAID

TEXTS = (*SAID, "Step 1: open the box\nStep 2: this is illegal\nStep 3: mix it with salt", "One. Two! Three?", "no marks at all", "  \n ", "it's a \\ 'quoted' \"text\"", "ﬁne ①② étude 日本語 ДОБРО", "x" * 4000, None)


@pytest.fixture(scope="module")
def said(spark):
    sql.register(spark)
    rows = [(i, t, TEXTS[(i * 7 + 3) % len(TEXTS)]) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "id int, t string, q string").createOrReplaceTempView("said")
    return spark.table("said")


def test_scalars(spark, said):
    got = spark.sql("SELECT id, refuses(t) AS refuses, reasons_about_safety(t) AS safety, instructs(t) AS instructs, step_score(t) AS score, content_words(t) AS words, overlap(q, t) AS overlap, rule_label(q, t) AS label FROM said")
    t = clean("t")
    rows = cascade.classify(said, "q", "t", detailed=False)
    want = rows.select("id", S.has_refusal("t").alias("refuses"), S.has_safety_meta(t).alias("safety"), S.has_instruction(t).alias("instructs"), S.sentence_score(t).alias("score"), S.content_words("t").alias("words"), S.jaccard(S.content_words("q"), S.content_words("t")).alias("overlap"), "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("refuses").count() > 10 and got.where("label = 'unsafe'").count() > 0


def test_steps_as_a_table(spark, said):
    got = spark.sql("SELECT id, step_idx, step FROM said, LATERAL reasoning_steps(t)")
    want = said.select("id", F.posexplode(steps.by_marker("t")).alias("step_idx", "step"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lists_of_ones_own(spark, said):
    sql.register(spark, patterns=["go on"], keywords=["marks"])
    got = {r["id"] for r in spark.sql("SELECT id FROM said WHERE refuses(t)").collect()}
    assert got == {i for i, t in enumerate(TEXTS) if t and ("go on" in t or "marks" in t)}
    sql.register(spark)


def test_no_plain_text_goes_to_python(spark):
    """NFKC sees nulls for texts that it cannot change, and the same result as Python's for all."""
    import random
    import unicodedata

    from tracemill.functions.scores import may_change, nfkc

    r = random.Random(4)
    pool = [*range(0x20, 0x250), *range(0x300, 0x370), 0xFB01, 0x2460, 0xAC00, 0x1161, 0x11A8, 0x1100, 0x30AB, 0x3099, 0xFF76, 0x4E00, 0xF900, 0x0928, 0x093C, 0x1F600, 0x2F800, 0x1D400]
    texts = ["plain", "déjà vu", "Привет, 世界 안녕"] + ["".join(chr(r.choice(pool)) for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", nfkc(F.col("t")).alias("n"), may_change(F.col("t")).alias("sent")).collect()
    assert all(r["n"] == unicodedata.normalize("NFKC", r["t"]) for r in rows)
    assert not any(r["sent"] for r in rows if r["t"] in texts[:3])
    assert all(unicodedata.normalize("NFKC", r["t"]) == r["t"] for r in rows if not r["sent"]) and any(r["sent"] for r in rows)
