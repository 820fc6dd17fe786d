"""Splitting a trace into steps, in four ways, and labels of steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scores import sentence_score
from ..functions.text import WS, clean, strip

MARKER = rf"(?:^|\n){WS}*(?:{'|'.join(fixed.STEP_WORDS)}){WS}*\d+{WS}*[:：.]"
#: Words before a step's number in model replies.
REPLY_WORDS = ("Step", "Bước", "Schritt", "Étape", "Paso", "步骤", "步驟")


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def _sentences(t: Column) -> Column:
    return _pieces(F.split(t, f"(?<=[.!?。！？\n]){WS}+", -1))


def _or(steps: Column, other: Column) -> Column:
    return F.when(F.size(steps) > 0, steps).otherwise(other)


def by_number(trace: Column | str) -> Column:
    """Between "Step N:" markers, what stands before the first included; blank pieces go."""
    return _pieces(F.split(clean(trace), rf"(?U)Step \d+:{WS}*", -1))


def by_marker(trace: Column | str) -> Column:
    """From one line's marker (of many languages) to the next, marker included and what stands before the first lost;
    without markers sentences, and without those the trace."""
    t = strip(clean(trace))
    marked = F.filter(F.split(t, f"(?iud)(?={MARKER})", -1), lambda s: F.rlike(s, F.lit(f"(?iud)^{MARKER}")))
    steps = _or(_pieces(marked), _or(_sentences(t), F.array(t)))
    return F.when(t == "", F.array(t)).otherwise(steps)


def by_reply(trace: Column | str) -> Column:
    """Between markers of replies in two languages."""
    return _pieces(F.split(clean(trace), rf"(?U)(?:步骤|Step){WS}*\d+{WS}*[：:]", -1))


def by_label(trace: Column | str) -> Column:
    """Between markers of seven kinds, anywhere and in any case; else sentences; else the trace."""
    t = clean(trace)
    steps = _pieces(F.split(t, rf"(?iuU)(?:{'|'.join(REPLY_WORDS)}){WS}*\d+{WS}*[:：.]", -1))
    return _or(steps, _or(_sentences(strip(t)), F.array(t)))


def joined_scores(trace: Column | str) -> Column:
    """Scores of the steps, joined by "|"."""
    return F.array_join(F.transform(by_marker(trace), lambda s: sentence_score(s)), "|")


def uniform_scores(trace: Column | str, label: Column) -> Column:
    """1.0 for each step of a safe trace, else 0.0."""
    return F.array_join(F.array_repeat(F.when(label == "safe", "1.0").otherwise("0.0"), F.size(by_label(trace))), "|")


def truncated(trace: Column | str, steps: Column, most: int = 6000, first: int = 4, middle: int = 4, last: int = 4, few: int = 10) -> Column:
    """A trace as numbered steps for a model of limited input: all of them if they are few and fit, else the first, evenly
    spaced middle and last ones; if those do not fit, each is cut to its share. Without steps, the trace's start.
    steps: a column of by_number(trace), computed before."""
    t = clean(trace)
    n = F.size(steps)
    inner = F.greatest(n - first - last, F.lit(0))
    k = F.least(inner, F.lit(middle))
    spaced = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.get(steps, (F.lit(first) + F.floor(F.when(k > 1, i * (inner - 1) / (k - 1)).otherwise(0.0))).cast("int")))
    between = F.when(inner > 0, spaced).otherwise(F.array().cast("array<string>"))
    tail = F.when(n > first, F.slice(steps, F.greatest(n - last + 1, F.lit(1)), F.lit(last))).otherwise(F.array().cast("array<string>"))
    shown = F.concat(F.slice(steps, 1, first), between, tail)
    numbered = lambda xs: F.array_join(F.transform(xs, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s)), "\n")
    share = F.floor(F.lit(most) / F.greatest(F.size(shown), F.lit(1))).cast("int")
    fitted = F.when(F.length(numbered(shown)) <= most, numbered(shown)).otherwise(F.substring(numbered(F.transform(shown, lambda s: F.substring(s, F.lit(1), share))), 1, most))
    return F.when(n == 0, F.substring(t, 1, most)).when((n <= few) & (F.length(numbered(steps)) <= most), numbered(steps)).otherwise(fitted)
