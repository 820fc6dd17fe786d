"""Feature projections: 30 of a solution, 28 of a trace, 22 of a step. Column order is the matrix's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import clean, count_of, deviation, mean, ratio, sentences, stage, strip, tally, tokens
from .steps import by_number

#: Features of tokens as they are written.
CASED = ("word_count_log", "avg_word_length", "avg_sentence_length", "unique_word_count_log", "max_word_length", "we_pronoun_freq")
COMPRESSED = ("compression_ratio", "sentence_compression_cv")


def with_words(df: DataFrame, text: str, prefix: str = "", cased: bool = True) -> DataFrame:
    """Shared columns of a text: itself without nulls, its tokens (if the case of letters is needed), and its lower-case tokens."""
    df = stage(df, **{f"{prefix}t": clean(text)})
    t = F.col(f"{prefix}t")
    return stage(df, **({f"{prefix}toks": tokens(t)} if cased else {}), **{f"{prefix}ltoks": tokens(F.lower(t))})


def solution_columns(compressed: bool = True) -> dict[str, Column]:
    """Over the columns of with_words(), and `counts` (a tally of tokens), `parts` and `lengths` (of sentences)."""
    t, toks, ltoks, counts, parts = (F.col(c) for c in ("t", "toks", "ltoks", "counts", "parts"))
    n, chars = F.size(toks), F.length(t)
    out = {
        "word_count_log": F.log1p(n.cast("double")),
        "char_count_log": F.log1p(chars.cast("double")),
        "sentence_count_log": F.log1p(F.size(parts).cast("double")),
        "vocab_richness": S.type_token_ratio(ltoks),
        "avg_word_length": ratio(F.length(F.array_join(toks, "")), F.size(toks)),
        "digit_ratio": S.digit_ratio(t),
        "punct_ratio": S.punct_ratio(t),
        "latex_density": S.latex_density(t),
        "compression_ratio": S.compression_ratio(t) if compressed else None,
        "entropy": S.entropy(t),
        "repetition_ratio": S.repetition_ratio(ltoks),
        "has_boxed_answer": F.contains(t, F.lit("\\boxed")).cast("double"),
        "avg_sentence_length": n / F.greatest(F.size(parts), F.lit(1)),
        "unique_word_count_log": F.log1p(F.size(F.array_distinct(toks)).cast("double")),
        "paragraph_count": (count_of(t, "\n\n") + 1).cast("double"),
        "max_word_length": F.coalesce(F.array_max(F.transform(toks, F.length)), F.lit(0)).cast("double"),
        "parenthesis_density": count_of(t, "(") / F.greatest(chars, F.lit(1)),
        "newline_ratio": count_of(t, "\n") / F.greatest(chars, F.lit(1)),
        "we_pronoun_freq": S.we_frequency(t, n),
        "numbered_step_count": S.numbered_steps(t).cast("double"),
        "thus_therefore_ratio": S.thus_ratio(t),
        "bold_section_count": F.regexp_count(t, F.lit(r"\*\*[^*]+\*\*")).cast("double"),
        "solution_is_empty": (F.length(strip(t)) < 10).cast("double"),
        "hapax_ratio": S.hapax_ratio(counts),
        "yules_k": S.yules_k(counts),
        "heaps_exponent": S.heaps_exponent(counts),
        "sentence_length_cv": S.sentence_length_cv(F.col("lengths")),
        "function_word_ratio": S.function_word_ratio(ltoks),
        "whitespace_pattern": S.whitespace_pattern(t),
        "sentence_compression_cv": S.sentence_compression_cv(parts) if compressed else None,
    }
    return {k: c for k, c in out.items() if c is not None}


SOLUTION_FEATURES = ("word_count_log", "char_count_log", "sentence_count_log", "vocab_richness", "avg_word_length", "digit_ratio", "punct_ratio", "latex_density", "compression_ratio", "entropy", "repetition_ratio", "has_boxed_answer", "avg_sentence_length", "unique_word_count_log", "paragraph_count", "max_word_length", "parenthesis_density", "newline_ratio", "we_pronoun_freq", "numbered_step_count", "thus_therefore_ratio", "bold_section_count", "solution_is_empty", "hapax_ratio", "yules_k", "heaps_exponent", "sentence_length_cv", "function_word_ratio", "whitespace_pattern", "sentence_compression_cv")


def solution_features(df: DataFrame, text: str = "solution", keys: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """keys and the chosen features (all 30 by default) of each row, without a shuffle."""
    chosen = only or SOLUTION_FEATURES
    staged = with_words(df.select(*keys, F.col(text).alias("__text")), "__text", cased=bool(set(CASED) & set(chosen)))
    shared = {"counts": (tally(F.col("ltoks")), ("hapax_ratio", "yules_k", "heaps_exponent")), "parts": (sentences(F.col("t")), ("sentence_count_log", "avg_sentence_length", "sentence_length_cv", "sentence_compression_cv")), "lengths": (S.sentence_lengths(F.col("ltoks")), ("sentence_length_cv",))}
    for name, (column, users) in shared.items():
        if set(users) & set(chosen):
            staged = stage(staged, **{name: column})
    own = solution_columns(any(c in COMPRESSED for c in chosen))  # columns that are not chosen are never resolved
    return staged.select(*keys, *[own[c].alias(c) for c in chosen])


def trace_features(df: DataFrame, query: str = "query", trace: str = "trace", keys: tuple[str, ...] = (), compressed: bool = True) -> DataFrame:
    """keys and the 28 features of a query and its trace (27 without the compressed one)."""
    staged = with_words(df.select(*keys, F.col(query).alias("__q"), F.col(trace).alias("__t")), "__t")
    staged = with_words(staged, "__q", "q")
    staged = stage(staged, steps=by_number(F.col("t")))
    staged = stage(staged, lengths=F.transform("steps", lambda s: F.size(tokens(s))), unsafe=F.transform("steps", lambda s: S.unsafe_density(tokens(F.lower(s)))))
    t, ltoks, steps, lengths, unsafe = (F.col(c) for c in ("t", "ltoks", "steps", "lengths", "unsafe"))
    n, qn, k = F.size("toks"), F.size("qtoks"), F.size(steps)
    half = F.floor(k / 2).cast("int")
    late = F.slice(steps, half + 1, F.greatest(k - half, F.lit(0)))
    early = F.slice(unsafe, F.lit(1), F.greatest(half, F.lit(1)))
    own = {
        "trace_word_count_log": F.log1p(n.cast("double")),
        "trace_char_count_log": F.log1p(F.length(t).cast("double")),
        "query_word_count_log": F.log1p(qn.cast("double")),
        "vocab_richness": S.type_token_ratio(ltoks),
        "compression_ratio": S.compression_ratio(t) if compressed else None,
        "entropy": S.entropy(t),
        "repetition_ratio": S.repetition_ratio(ltoks),
        "query_unsafe_kw_density": S.unsafe_density(F.col("qltoks")),
        "trace_unsafe_kw_density": S.unsafe_density(ltoks),
        "refusal_indicator": S.refusal_indicator(t, n),
        "step_count": k.cast("double"),
        "avg_step_length": mean(lengths),
        "step_length_std": deviation(lengths),
        "max_step_length": F.coalesce(F.array_max(lengths), F.lit(0)).cast("double"),
        "min_step_length": F.coalesce(F.array_min(lengths), F.lit(0)).cast("double"),
        "avg_step_unsafe_score": mean(unsafe),
        "query_trace_length_ratio": qn / F.greatest(n, F.lit(1)),
        "digit_ratio": S.digit_ratio(t),
        "punct_ratio": S.punct_ratio(t),
        "late_refusal_ratio": mean(F.transform(late, lambda s: S.refusal_indicator(s, F.size(tokens(s))))),
        "early_engagement_ratio": mean(early),
        "warning_word_count": S.warning_words(t).cast("double"),
        "safety_language_count": S.safety_words(t).cast("double"),
        "has_disclaimer": S.has_disclaimer(t).cast("double"),
        "dangerous_term_count": S.danger_words(t).cast("double"),
        "query_dangerous_term_count": S.danger_words(F.col("qt")).cast("double"),
        "has_code_blocks": S.has_code(t).cast("double"),
        "chars_per_step": F.length(t) / F.greatest(k, F.lit(1)),
    }
    return staged.select(*keys, *[c.alias(name) for name, c in own.items() if c is not None])


def step_rows(df: DataFrame, trace: str = "trace", labels: str | None = None, keys: tuple[str, ...] = (), query: str = "query") -> DataFrame:
    """A row per step: keys, query, step, step_idx, total_steps and, if labels (an array) are given, label.

    Steps and labels are aligned by position; what either has more is left out, but total_steps counts all.
    """
    steps = by_number(F.col(trace))
    base = stage(df.select(*keys, clean(query).alias("query"), F.col(trace), *([F.col(labels).alias("__labels")] if labels else [])), steps=steps)
    kept = F.slice(F.arrays_zip(F.col("steps"), F.col("__labels").alias("labels")), F.lit(1), F.least(F.size("steps"), F.size("__labels"))) if labels else F.transform("steps", lambda s: F.struct(s.alias("steps")))
    rows = base.select(*keys, "query", F.size("steps").alias("total_steps"), F.posexplode(kept).alias("step_idx", "one"))
    return rows.select(*keys, "query", F.col("one.steps").alias("step"), "step_idx", "total_steps", *([F.col("one").getField("labels").alias("label")] if labels else []))


def step_features(rows: DataFrame, keys: tuple[str, ...] = (), compressed: bool = True) -> DataFrame:
    """keys and the 22 features of rows as step_rows() gives them (21 without the compressed one)."""
    staged = with_words(rows.select(*dict.fromkeys([*keys, "step_idx", "total_steps"]), F.col("step").alias("__s"), F.col("query").alias("__q")), "__s")
    staged = with_words(staged, "__q", "q")
    t, n, idx, total = F.col("t"), F.size("toks"), F.col("step_idx"), F.col("total_steps")
    own = {
        "step_word_count_log": F.log1p(n.cast("double")),
        "step_vocab_richness": S.type_token_ratio(F.col("ltoks")),
        "step_unsafe_kw_density": S.unsafe_density(F.col("ltoks")),
        "step_refusal_indicator": S.refusal_indicator(t, n),
        "step_digit_ratio": S.digit_ratio(t),
        "step_punct_ratio": S.punct_ratio(t),
        "step_position": idx / F.greatest(total - 1, F.lit(1)),
        "is_first_step": (idx == 0).cast("double"),
        "is_last_step": (idx == total - 1).cast("double"),
        "query_unsafe_kw_density": S.unsafe_density(F.col("qltoks")),
        "step_compression_ratio": S.compression_ratio(t) if compressed else None,
        "step_warning_words": S.warning_words(t).cast("double"),
        "step_dangerous_terms": S.danger_words(t).cast("double"),
        "step_safety_language": S.safety_words(t).cast("double"),
        "step_has_code": S.has_code(t).cast("double"),
        "step_has_disclaimer": S.has_disclaimer(t).cast("double"),
        "query_word_count_log": F.log1p(F.size("qtoks").cast("double")),
        "query_dangerous_terms": S.danger_words(F.col("qt")).cast("double"),
        "query_warning_words": S.warning_words(F.col("qt")).cast("double"),
        "query_has_code": S.has_code(F.col("qt")).cast("double"),
        "total_steps": total.cast("double"),
        "step_entropy": F.when(n > 5, S.entropy(t)).otherwise(0.0),
    }
    return staged.select(*keys, *[c.alias(k) for k, c in own.items() if c is not None])


def fitted(df: DataFrame, names: list[str], width: int) -> DataFrame:
    """The first `width` feature columns; missing ones are 0 (older models know fewer features, newer ones more)."""
    return df.select(*[c for c in df.columns if c not in names], *names[:width], *[F.lit(0.0).alias(f"pad_{i}") for i in range(len(names), width)])


def fire_rates(df: DataFrame, names: list[str], by: tuple[str, ...] = (), default: float = 0.0) -> DataFrame:
    """Share of rows in which a feature has not its default, by feature (and groups)."""
    long = df.unpivot([*by], names, "feature", "value")
    return long.groupBy(*by, "feature").agg(F.avg((F.col("value") != default).cast("double")).alias("fire_rate"), F.count("*").alias("rows"))


def cohens_d(df: DataFrame, names: list[str], group: str, first: str, second: str) -> DataFrame:
    """Difference of two groups' means over their pooled deviation, by feature."""
    long = df.where(F.col(group).isin(first, second)).unpivot([group], names, "feature", "value")
    of = lambda f, g: f(F.when(F.col(group) == g, F.col("value")))
    stats = long.groupBy("feature").agg(*[of(f, g).alias(f"{n}{i}") for i, g in enumerate((first, second)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    return stats.select("feature", F.when(pooled > 0, (F.col("m0") - F.col("m1")) / pooled).otherwise(0.0).alias("cohens_d"))

