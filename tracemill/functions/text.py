"""Text primitives as Columns, with Python's ideas of white space, words and digits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's 29 white-space characters, inside and as a class.
WS_IN = r"\t-\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same class with its Latin characters one by one, which Java looks up in a table, and the others behind their range: few characters of a text are tried against each of them.
WS = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A word's character, and the two sides of a boundary (only where a pattern's edge is a word's character).
WORD = r"[\p{L}\p{N}_]"
BEFORE, AFTER = f"(?<!{WORD})", f"(?!{WORD})"
#: Digits as Python's isdigit() has them: decimal ones, and those in circles, brackets and indices.
DIGIT = r"[0123456789[\x{80}-\x{10ffff}&&[\p{Nd}\xb2\xb3\xb9፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]]]"
PUNCTUATION = "[" + "".join(rf"\x{i:x}" for i in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F))) + "]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def tokens(c: Column) -> Column:
    """Pieces between runs of white space."""
    return F.filter(F.split(c, f"{WS}+", -1), lambda t: t != "")


def count_of(c: Column, piece: str) -> Column:
    """Occurrences that do not overlap, as str.count()."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def sentences(c: Column) -> Column:
    """Pieces between runs of . ! ?, empty ones included (one for an empty text)."""
    return F.split(strip(c), "[.!?]+", -1)


def ratio(x: Column, y: Column, default: float = 0.0) -> Column:
    return F.when(y > 0, x / y).otherwise(F.lit(default))


def whole_words(words: Iterable[str], ignore_case: bool = True, starts: str = "") -> str:
    """starts: a class of the characters that words start with, which is cheaper to try first than the boundary."""
    return f"{'(?iu)' if ignore_case else ''}{f'(?={starts})' if starts else ''}{BEFORE}(?:{'|'.join(words)}){AFTER}"


def java_pattern(patterns: Iterable[str]) -> str:
    """One alternation of Python patterns that ignore case, with its classes and line ends."""
    return "(?iuUd)(?:" + "|".join(patterns) + ")"


def number_of(c: Column, pieces: Iterable[str]) -> Column:
    """How many of the plain substrings the text holds; one that is listed twice counts twice."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in pieces]), lambda p: F.contains(c, p)))


#: Places of a tally's numbers.
TALLY = {"n": 0, "types": 1, "once": 2, "squares": 3}


def tally(items: Column) -> Column:
    """Of an array, as an array of numbers: its TALLY, that is n, types (different items), once (items that occur once) and
    squares (of counts). Runs of the sorted array are cut where an item differs from the one before it: no shuffle, no
    search within, and stateless, so it runs on streams."""

    def of(own: Column) -> Column:
        n = F.size(own)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))
        return F.transform(F.array(F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))), lambda s: F.struct(n.alias("n"), s.alias("starts")))

    def numbers(x: Column) -> Column:
        starts, n, k = x["starts"], x["n"], F.size(x["starts"])
        counts = F.transform(starts, lambda s, i: F.coalesce(F.get(starts, i + 1), n) - s)
        return F.transform(F.array(counts), lambda c: F.array(*[v.cast("double") for v in (n, k, F.size(F.filter(c, lambda v: v == 1)), total(F.transform(c, lambda v: v.cast("long") * v), "long"))]))

    # arrays of one entry bind what their lambdas share
    return F.flatten(F.flatten(F.flatten(F.transform(F.array(F.sort_array(items)), lambda own: F.transform(of(own), numbers)))))


def total(values: Column, kind: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))


def mean(values: Column) -> Column:
    return ratio(total(values), F.size(values))


def deviation(values: Column) -> Column:
    """Population standard deviation, from the sums of values and of squares."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.sqrt(F.greatest(ratio(squares, F.size(values)) - mean(values) * mean(values), F.lit(0.0)))


def stage(df, **named: Column):
    """Adds columns that later columns share. A generator of one row stands between, so that Spark computes each once
    instead of copying its expression into every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in named.items()]))))
