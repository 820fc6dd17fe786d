"""The prefilter of patterns: it never rules out what a pattern matches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill.functions import fixed
from tracemill.functions.patterns import any_pattern, fold, parsed, pieces
from tracemill.functions.text import java_pattern

LISTS = {n: getattr(fixed, n) for n in ("REFUSAL_PATTERNS", "SAFETY_PATTERNS", "INSTRUCTION_PATTERNS")}


def sample(alternatives, rng):
    """A text of the pattern's shape."""
    out = ""
    for kind, value, least in rng.choice(alternatives):
        for _ in range(least if least else rng.randrange(2)):
            if kind == "group":
                out += sample(value, rng)
            elif kind == "literal":
                out += value
            else:
                out += {"\\s": " ", "\\d": "7", "\\w": "x", ".": "-"}.get(value) or value[1]
    return out


@pytest.mark.parametrize("name", LISTS)
def test_samples_of_every_pattern_hold_its_pieces(name):
    rng = random.Random(1)
    for p in LISTS[name]:
        sets = pieces(parsed(p))
        assert sets, p
        for _ in range(20):
            text = sample(parsed(p), rng)
            for text in (text, text.upper(), text.title()):
                if re.search(p, text, re.IGNORECASE):
                    assert all(any(x in fold(text) for x in own) for own in sets), (p, text)


def test_as_the_patterns_themselves(spark):
    rng = random.Random(2)
    texts = [sample(parsed(p), rng) for own in LISTS.values() for p in own for _ in range(3)]
    texts += [t.upper() for t in texts] + [t[1:] for t in texts] + ["", "CANNOT HELP", "ſorry, i can't help", "ΛΥΠΆΜΑΙ ΔΕΝ ΜΠΟΡΏ ΝΑ ΒΟΗΘΉΣΩ", "İ cannot help"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    for own in LISTS.values():
        plain = F.rlike("t", F.lit(java_pattern(own)))
        got = rows.select(plain.alias("a"), any_pattern(F.col("t"), own).alias("b")).groupBy("a", "b").count().collect()
        assert all(r["a"] == r["b"] for r in got) and len(got) == 2


def test_own_lists(spark):
    got = spark.range(1).select(any_pattern(F.lit("Nope, never"), (r"nope,?\s+(?:never|not)",)), any_pattern(F.lit("some text"), (), ["me t"]), any_pattern(F.lit("x"), (), ())).first()
    assert tuple(got) == (True, True, False)
    with pytest.raises(ValueError, match="group"):
        parsed("(?:a")
