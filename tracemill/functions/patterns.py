"""Long lists of patterns as Columns: plain substrings that a match must hold are looked for before a pattern is tried.

A pattern's pieces are read off its text: every literal run that it cannot do without, and of every group that it cannot do
without one piece of each alternative. A text that lacks all pieces of one of these sets cannot match the pattern. Case is
folded on both sides first.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import java_pattern

#: An item of a parsed pattern: its kind (literal, class or group), its value, the fewest times that it occurs.
Item = tuple[str, object, int]


def parsed(pattern: str) -> list[list[Item]]:
    """The alternatives of a pattern in the plain syntax that the lists use: literals, classes, escapes, groups that capture
    nothing, quantifiers and anchors."""
    alternatives, rest = _alternatives(pattern)
    if rest:
        raise ValueError(f"{pattern!r} has one ) too many")
    return alternatives


def _alternatives(p: str) -> tuple[list[list[Item]], str]:
    out: list[list[Item]] = [[]]
    while p and p[0] != ")":
        if p[0] == "|":
            out.append([])
            p = p[1:]
        elif p[0] in "^$":
            p = p[1:]
        else:
            kind, value, p = _atom(p)
            least, p = _quantifier(p)
            out[-1].append((kind, value, least))
    return out, p


def _atom(p: str) -> tuple[str, object, str]:
    if p.startswith("(?:"):
        inner, rest = _alternatives(p[3:])
        if not rest:
            raise ValueError("a group is not closed")
        return "group", inner, rest[1:]
    if p[0] == "(":
        raise ValueError(f"only groups that capture nothing: {p!r}")
    if p[0] == "[":
        end = p.index("]", 2)
        return "class", p[: end + 1], p[end + 1 :]
    if p[0] == "\\":
        return ("class" if p[1] in "sSdDwWbB" else "literal"), (p[:2] if p[1] in "sSdDwWbB" else p[1]), p[2:]
    return ("class" if p[0] == "." else "literal"), p[0], p[1:]


def _quantifier(p: str) -> tuple[int, str]:
    if p[:1] in ("?", "*", "+"):
        return (1 if p[0] == "+" else 0), p[1:]
    if p[:1] == "{":
        least, _, rest = p[1:].partition("}")
        return int(least.split(",")[0] or 0), rest
    return 1, p


def sets_of(items: list[Item]) -> list[frozenset[str]]:
    """Sets of plain strings of each of which every match of one alternative holds one, telling ones first."""
    out, run = [], ""
    for kind, value, least in [*items, ("class", "", 1)]:
        if kind == "literal" and least:
            run += str(value)
            continue
        if run:
            out.append(frozenset([fold(run)]))
        run = ""
        if kind == "group" and least and (inner := pieces(value)):
            out.append(inner[0])
    return sorted(dict.fromkeys(out), key=lambda own: (-min(map(len, own)), len(own), sorted(own)))


def pieces(alternatives: list[list[Item]]) -> list[frozenset[str]]:
    """The same for several alternatives: the sets of a single one, else one set, with the most telling of each."""
    own = [sets_of(items) for items in alternatives]
    if len(own) == 1:
        return own[0]
    return [frozenset().union(*(sets[0] for sets in own))] if all(own) else []


def folded(c: Column) -> Column:
    """The same for texts that differ in case alone, as patterns that ignore case take it. Sigma is lowered apart, as its
    form depends on its place (and Spark would drop an upper() that stands in a lower())."""
    return F.lower(F.translate(F.upper(F.translate(c, "İ", "i")), "Σ", "σ"))


def fold(s: str) -> str:
    return s.replace("İ", "i").upper().replace("Σ", "σ").lower()


#: Characters beyond the Latin letters of Western languages.
WIDE = r"[^\x00-\x{24f}]"


#: Patterns of one alternation, at most.
GROUP = 4


@lru_cache(maxsize=None)
def prepared(patterns: tuple[str, ...]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """The patterns for Spark in groups, each as one alternation and, as JSON, the sets of pieces of its patterns: groups that
    any text may match, and those of which every match holds a wide character. Patterns with the same telling pieces stand
    together, so that a text that holds some of them meets few alternations."""
    sets = [pieces(parsed(p)) for p in patterns]
    wide = [any(all(max(piece) > "\u024f" for piece in own) for own in each) for each in sets]
    out: tuple[list[tuple[str, str]], list[tuple[str, str]]] = ([], [])
    for kind in (False, True):
        own = sorted((i for i, w in enumerate(wide) if w is kind), key=lambda i: (sorted(sets[i][0]) if sets[i] else [], i))
        for start in range(0, len(own), GROUP):
            part = own[start : start + GROUP]
            out[kind].append((java_pattern([patterns[i] for i in part]), json.dumps([[sorted(x) for x in sets[i]] for i in part])))
    return out


def any_pattern(c: Column, patterns: Iterable[str], words: Iterable[str] = ()) -> Column:
    """Whether a text matches one of the patterns (Python's syntax, case ignored) or holds one of the plain words (in lower
    case). A group's alternation is a constant, which Spark compiles once, and is tried on texts that hold the pieces of one
    of its patterns."""
    narrow, wide = prepared(tuple(patterns))
    plain = F.from_json(F.lit(json.dumps(list(dict.fromkeys(words)))), "array<string>")

    def found(x: Column) -> Column:
        held = lambda own: F.exists(own, lambda piece: F.contains(x["low"], piece))

        def tried(group: tuple[str, str]) -> Column:
            listed = F.from_json(F.lit(group[1]), "array<array<array<string>>>")
            return F.exists(listed, lambda sets: F.forall(sets, held)) & F.rlike(x["text"], F.lit(group[0]))

        any_of = lambda groups: reduce(lambda a, b: a | b, map(tried, groups), F.lit(False))
        return F.exists(plain, lambda w: F.contains(x["lower"], w)) | any_of(narrow) | (F.rlike(x["low"], F.lit(WIDE)) & any_of(wide))

    # a lambda's variable, so that the folded text is computed once
    return F.exists(F.array(F.struct(c.alias("text"), F.lower(c).alias("lower"), folded(c).alias("low"))), found)
