"""Scores of a text's words, steps and labels as Columns."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .patterns import any_pattern
from .text import AFTER, BEFORE, DIGIT, PUNCTUATION, TALLY, WS, WS_IN, clean, count_of, deviation, matches, mean, number_of, ratio, sentences, strip, tally, tokens, whole_words

# ---- of all texts


def type_token_ratio(ltoks: Column) -> Column:
    return ratio(F.size(F.array_distinct(ltoks)), F.size(ltoks))


def digit_ratio(t: Column) -> Column:
    return ratio(matches(t, DIGIT), F.length(t))


def punct_ratio(t: Column) -> Column:
    return ratio(matches(t, PUNCTUATION), F.length(t))


def latex_density(t: Column) -> Column:
    return ratio(matches(t, r"[\\${}^_]"), F.length(t))


@F.pandas_udf(T.DoubleType())
def entropy(t: pd.Series) -> pd.Series:
    """Bits a character. All texts of a batch are counted at once; a fold over an array of characters in Spark is many times
    slower."""
    out = np.zeros(len(t))
    for start in range(0, len(t), 256):
        own = t.iloc[start : start + 256].to_numpy()
        size = np.array([len(x) for x in own], dtype=np.int64)
        code = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        _, counts = np.unique(np.repeat(np.arange(len(own)), size) << 21 | code, return_counts=True)
        of = np.repeat(np.arange(len(own)), [len(set(x)) for x in own])
        out[start : start + 256] = np.where(size > 0, np.log2(np.maximum(size, 1)) - np.bincount(of, weights=counts * np.log2(counts), minlength=len(own)) / np.maximum(size, 1), 0.0)
    return pd.Series(np.maximum(out, 0.0))


def repetition_ratio(ltoks: Column, width: int = 4) -> Column:
    """Share of word n-grams that occurred before. They are counted from the words, so that they are made once."""
    n = F.size(ltoks) - (width - 1)
    grams = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", *[F.get(ltoks, i + k) for k in range(width)]))
    return F.when(n > 0, (n - F.size(F.array_distinct(grams))) / n).otherwise(F.lit(0.0))


def zlib_ratio(raw: bytes) -> float:
    return len(zlib.compress(raw, 9)) / len(raw) if raw else 1.0


@F.pandas_udf(T.DoubleType())
def compression_ratio(t: pd.Series) -> pd.Series:
    """Bytes after zlib at level 9 to bytes before; 1 if empty. Spark has no such function."""
    return t.map(lambda x: zlib_ratio(x.encode("utf-8", "surrogatepass")))


@F.pandas_udf(T.DoubleType())
def _spread(parts: pd.Series) -> pd.Series:
    def one(texts) -> float:
        if len(texts) < 3:
            return 0.0
        r = [zlib_ratio(s.encode("utf-8", "surrogatepass")) for s in texts]
        mean = sum(r) / len(r)
        return (max(sum(x * x for x in r) / len(r) - mean * mean, 0.0)) ** 0.5 / mean if mean >= 0.01 else 0.0

    return parts.map(one)


def sentence_compression_cv(parts: Column) -> Column:
    """Spread of the compression ratios of sentences longer than 20 characters; 0 with under three."""
    return _spread(F.filter(F.transform(parts, strip), lambda s: F.length(s) > 20))


def hapax_ratio(tallied: Column) -> Column:
    return F.when(F.get(tallied, TALLY["n"]) < 2, 0.0).otherwise(ratio(F.get(tallied, TALLY["once"]), F.get(tallied, TALLY["types"])))


def yules_k(tallied: Column) -> Column:
    n = F.get(tallied, TALLY["n"])
    return F.when(n < 2, 0.0).otherwise(10000.0 * (F.get(tallied, TALLY["squares"]) - n) / (n * n))


def heaps_exponent(tallied: Column) -> Column:
    n = F.get(tallied, TALLY["n"])
    return F.when(n < 10, 0.0).otherwise(F.log(F.get(tallied, TALLY["types"])) / F.log(n))


def sentence_lengths(toks: Column) -> Column:
    """Words of each sentence that is not blank, from the text's tokens: put together with one space between them, they are
    cut at the ends of sentences, and their spaces tell the words. No pattern is compiled for each sentence."""
    parts = F.transform(sentences(F.array_join(toks, " ")), lambda s: F.trim(s))
    return F.transform(F.filter(parts, lambda s: s != ""), lambda s: count_of(s, " ") + 1)


def sentence_length_cv(lengths: Column) -> Column:
    return F.when((F.size(lengths) >= 2) & (mean(lengths) >= 1), deviation(lengths) / mean(lengths)).otherwise(0.0)


def function_word_ratio(ltoks: Column, words: Iterable[str] = tuple(fixed.FUNCTION_WORDS)) -> Column:
    return ratio(F.size(F.filter(ltoks, lambda t: t.isin(list(words)))), F.size(ltoks))


def whitespace_pattern(t: Column) -> Column:
    return ratio(count_of(t, "\n\n"), count_of(t, "\n"))


def we_frequency(t: Column, n: Column) -> Column:
    return ratio(matches(t, whole_words(["[Ww]e"], False, "[Ww]")), n)


def numbered_steps(t: Column) -> Column:
    return matches(t, rf"(?mUd)^{WS}*\d+\.")


def thus_ratio(t: Column) -> Column:
    thus, therefore = matches(t, whole_words(["[Tt]hus"], False, "[Tt]")), matches(t, whole_words(["[Tt]herefore"], False, "[Tt]"))
    return ratio(thus, thus + therefore, 0.5)


def step_marker_count(t: Column) -> Column:
    return matches(t, r"(?U)Step \d+:")


# ---- of safety


def unsafe_density(ltoks: Column) -> Column:
    kinds = F.array_distinct(ltoks)
    return ratio(F.size(F.array_intersect(kinds, F.array(*[F.lit(w) for w in fixed.UNSAFE_KEYWORDS]))), F.size(kinds))


def per_word(count: Column, n: Column) -> Column:
    return count / F.greatest(n, F.lit(1))


def refusal_indicator(t: Column, n: Column) -> Column:
    return per_word(number_of(F.lower(t), fixed.REFUSAL_PHRASES), n)


def warning_words(t: Column) -> Column:
    return matches(t, whole_words(fixed.WARNING_WORDS))


def safety_words(t: Column) -> Column:
    return matches(t, whole_words(fixed.SAFETY_WORDS))


def danger_words(t: Column) -> Column:
    return matches(t, whole_words(fixed.DANGER_WORDS))


def has_disclaimer(t: Column) -> Column:
    """A phrase that ends in a colon needs a word's character after it, which is where its boundary is."""
    ends = [d + (r"(?=[\p{L}\p{N}_])" if d.endswith(":") else AFTER) for d in fixed.DISCLAIMERS]
    return F.rlike(t, F.lit(f"(?iu){BEFORE}(?:{'|'.join(ends)})")).cast("int")


def has_code(t: Column) -> Column:
    return F.rlike(t, F.lit(f"```|def |import |class |function{WS}")).cast("int")


def authority_appeals(t: Column) -> Column:
    low = F.lower(t)
    return sum((matches(low, whole_words(group)) for group in fixed.AUTHORITY[1:]), matches(low, whole_words(fixed.AUTHORITY[0])))


def educational_framing(t: Column, n: Column) -> Column:
    return per_word(number_of(F.lower(t), fixed.EDUCATIONAL), n)


def query_complexity(t: Column, n: Column) -> Column:
    return per_word(matches(t, whole_words(fixed.CLAUSE_WORDS)), n)


def dialect_score(t: Column, n: Column) -> Column:
    """Before a leading or after a trailing apostrophe, the boundary wants a word's character on the other side."""
    edge = lambda w: f"(?iu){r'(?<=[\p{L}\p{N}_])' if w[0] == chr(39) else BEFORE}{w}{r'(?=[\p{L}\p{N}_])' if w[-1] == chr(39) else AFTER}"
    return per_word(sum((matches(t, edge(w)) for w in fixed.DIALECT[1:]), matches(t, edge(fixed.DIALECT[0]))), n)


def query_danger(q: Column) -> Column:
    return number_of(F.lower(q), [k.lower() for k in fixed.QUERY_DANGER])


def has_refusal(trace: Column | str, patterns: Iterable[str] = fixed.REFUSAL_PATTERNS, keywords: Iterable[str] = fixed.REFUSAL_KEYWORDS) -> Column:
    """Whether a text refuses: one of the plain keywords, or one of the patterns. Lists of one's own may be given."""
    return any_pattern(strip(clean(trace)), patterns, [k.lower() for k in keywords])


def has_safety_meta(t: Column, patterns: Iterable[str] = fixed.SAFETY_PATTERNS) -> Column:
    return any_pattern(t, patterns)


def has_instruction(t: Column, patterns: Iterable[str] = fixed.INSTRUCTION_PATTERNS) -> Column:
    return any_pattern(t, patterns)


def sentence_score(sentence: Column, refusal=has_refusal) -> Column:
    """The step's score as text: 1.0 for a refusal, 0.8 for reasoning about safety, 0.2 for instructions, else 0.5."""
    s = strip(sentence)
    return F.when(s == "", "0.5").when(refusal(s), "1.0").when(has_safety_meta(s), "0.8").when(has_instruction(s), "0.2").otherwise("0.5")


# ---- content words


@lru_cache(maxsize=1)
def plain_class() -> tuple[str, str]:
    """Patterns of a character that NFKC may change or join with others: all but the long runs of those that it surely leaves as
    they are, wherever they stand. The first pattern has Latin runs alone, and finds all others too; the second has all, a
    dozen to a class, as a class looks at all its runs. Read off the Unicode tables of Python, whose NFKC is applied."""
    joining = set()
    for i in range(0x110000):
        own = unicodedata.decomposition(chr(i))
        if own and not own.startswith("<"):
            joining.update(int(x, 16) for x in own.split()[1:])  # may join the character before it
    joining.update(range(0x1161, 0x1176), range(0x11A8, 0x11C3))  # parts of syllables

    def kept(i: int) -> bool:
        return not 0xD800 <= i < 0xE000 and unicodedata.combining(chr(i)) == 0 and i not in joining and unicodedata.is_normalized("NFKC", chr(i))

    runs, start = [], None
    for i in range(0x30000):
        if kept(i):
            start = i if start is None else start
        elif start is not None:
            if i - start >= 6:
                runs.append((start, i - 1))
            start = None
    listed = lambda own: "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in own)
    parts = [runs[k : k + 12] for k in range(0, len(runs), 12)]
    ends = [own[0][0] - 1 for own in parts[1:]] + [0x10FFFF]
    blocks = [rf"[\x{{{start:x}}}-\x{{{end:x}}}&&[^{listed(own)}]]" for own, start, end in zip(parts, [0] + [e + 1 for e in ends[:-1]], ends, strict=True)]
    # what is not ASCII is looked for first, as most characters are
    return rf"[\x{{80}}-\x{{10ffff}}&&[^{listed([r for r in runs if r[1] < 0x250])}]]", "|".join(blocks)


def may_change(t: Column) -> Column:
    """Whether a text holds a character that NFKC may change or join."""
    latin, full = plain_class()
    return (F.octet_length(t) > F.length(t)) & F.rlike(t, F.lit(latin)) & F.rlike(t, F.lit(full))


@F.pandas_udf(T.StringType())
def _nfkc(t: pd.Series) -> pd.Series:
    return t.str.normalize("NFKC")


def nfkc(t: Column) -> Column:
    """Spark has no Unicode normalisation. Texts without a character that it may change never go to Python; nulls stand for them there."""
    return F.coalesce(_nfkc(F.when(may_change(t), t)), t)


def content_tokens(text: Column | str, normalise: bool = True) -> Column:
    """Lower-case words without marks; every CJK character is a word of its own."""
    t = clean(text)
    low = F.lower(nfkc(t) if normalise else t)
    spread = F.regexp_replace(low, f"([{fixed.CJK}])", " $1 ")
    return tokens(F.regexp_replace(spread, rf"[^\p{{L}}\p{{N}}_{fixed.CJK}{WS_IN}]+", ""))


def content_words(text: Column | str, stop_words: Iterable[str] = tuple(fixed.STOP_WORDS), normalise: bool = True) -> Column:
    """Distinct words of two characters or more that are no stop words."""
    stops = list(stop_words)
    return F.array_distinct(F.filter(content_tokens(text, normalise), lambda w: (F.length(w) > 1) & ~w.isin(stops)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
