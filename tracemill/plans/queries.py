"""Registered queries over the tables and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, sql
from ..functions import scores as S
from ..functions.text import TALLY, stage, tally, tokens
from ..operators import cascade, features, metrics, steps, tuning, votes
from ..sources.shared import new_folder
from ..sources.writers import cached_features
from . import inputs
from .inputs import SQL as CTE
from .inputs import quoted, strip_sql, tokens_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
W = r"[\p{L}\p{N}_]"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def of_solutions(*names: str):
    """The chosen solution features, rounded, by doc_id."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(features.solution_features(inputs.solutions(spark, sf_dir), keys=("doc_id",), only=names), *names)

    return run


def of_traces(*names: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = features.trace_features(inputs.traces(spark, sf_dir), keys=("id",), compressed="compression_ratio" in names)
        return rounded(own.select("id", *names), *names)

    return run


def register(name: str, run, sql: str | None = None) -> None:
    run.__name__ = name
    query(sql)(run)


def select_sql(source: str, key: str, **columns: str) -> str:
    return f"WITH {CTE[source]} SELECT {key}, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in columns.items()) + f" FROM {source}"


def matched_sql(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def words_sql(t: str, words) -> str:
    """Whole words of a list, by cutting the text at all other characters."""
    return f"len(list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: list_contains([{', '.join(quoted(w.lower()) for w in words)}], x)))"


def contained_sql(t: str, pieces) -> str:
    return "(" + " + ".join(f"CAST(contains({t}, {quoted(p)}) AS INTEGER)" for p in pieces) + ")"


def density_sql(lw: str) -> str:
    return f"coalesce(len(list_intersect(list_distinct({lw}), [{', '.join(quoted(w) for w in fixed.UNSAFE_KEYWORDS)}]))::DOUBLE / nullif(len(list_distinct({lw})), 0), 0)"


def over(x: str, y: str, default: str = "0") -> str:
    return f"coalesce(({x})::DOUBLE / nullif({y}, 0), {default})"


# ---- features of solutions

register(
    "s1_sizes",
    of_solutions("word_count_log", "char_count_log", "sentence_count_log", "avg_sentence_length", "unique_word_count_log", "max_word_length", "avg_word_length"),
    select_sql("words", "doc_id", word_count_log="ln(1 + len(w))", char_count_log="ln(1 + length(t))", sentence_count_log="ln(1 + len(parts))", avg_sentence_length="len(w)::DOUBLE / greatest(len(parts), 1)", unique_word_count_log="ln(1 + len(list_distinct(w)))", max_word_length="coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::DOUBLE", avg_word_length="coalesce(list_avg(list_transform(w, lambda x: length(x))), 0)"),
)
register(
    "s1_character_ratios",
    of_solutions("digit_ratio", "punct_ratio", "latex_density", "parenthesis_density", "newline_ratio", "whitespace_pattern"),
    select_sql(
        "words",
        "doc_id",
        digit_ratio=over(matched_sql("t", r"\p{Nd}"), "length(t)"),
        punct_ratio=over(matched_sql("t", r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]"), "length(t)"),
        latex_density=over(matched_sql("t", r"[\\${}^_]"), "length(t)"),
        parenthesis_density=over("length(t) - length(replace(t, '(', ''))", "length(t)"),
        newline_ratio=over("length(t) - length(replace(t, chr(10), ''))", "length(t)"),
        whitespace_pattern=over("(length(t) - length(replace(t, chr(10) || chr(10), ''))) / 2", "length(t) - length(replace(t, chr(10), ''))"),
    ),
)
register(
    "s1_marks",
    of_solutions("has_boxed_answer", "paragraph_count", "numbered_step_count", "bold_section_count", "solution_is_empty"),
    select_sql("words", "doc_id", has_boxed_answer=r"contains(t, '\boxed')::DOUBLE", paragraph_count="((length(t) - length(replace(t, chr(10) || chr(10), ''))) / 2 + 1)::DOUBLE", numbered_step_count=matched_sql("t", r"(?m)^[ \t\n\x0B\f\r]*[0-9]+\.") + "::DOUBLE", bold_section_count=matched_sql("t", r"\*\*[^*]+\*\*") + "::DOUBLE", solution_is_empty=f"(length({strip_sql('t')}) < 10)::DOUBLE"),
)
register(
    "s1_words",
    of_solutions("vocab_richness", "repetition_ratio", "we_pronoun_freq", "thus_therefore_ratio", "function_word_ratio"),
    select_sql(
        "words",
        "doc_id",
        vocab_richness=over("len(list_distinct(lw))", "len(lw)"),
        repetition_ratio="CASE WHEN len(lw) < 4 THEN 0 ELSE (len(lw) - 3 - len(list_distinct(list_transform(range(1, len(lw) - 2), lambda i: array_to_string(lw[i:i+3], ' ')))))::DOUBLE / (len(lw) - 3) END",
        we_pronoun_freq=over(r"len(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}_]+'), lambda x: x = 'we' OR x = 'We'))", "len(w)"),
        thus_therefore_ratio=over(r"len(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}_]+'), lambda x: x = 'thus' OR x = 'Thus'))", r"len(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}_]+'), lambda x: list_contains(['thus', 'Thus', 'therefore', 'Therefore'], x)))", "0.5"),
        function_word_ratio=over(f"len(list_filter(lw, lambda x: list_contains([{', '.join(quoted(w) for w in fixed.FUNCTION_WORDS)}], x)))", "len(lw)"),
    ),
)
TF = "tf AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(lw) AS x FROM words) GROUP BY ALL), sums AS (SELECT doc_id, count(*) AS v, sum(c) AS n, sum(c * c) AS sq, count(*) FILTER (c = 1) AS h FROM tf GROUP BY doc_id)"
register(
    "s1_vocabulary",
    of_solutions("hapax_ratio", "yules_k", "heaps_exponent"),
    f"WITH {CTE['words']}, {TF} SELECT doc_id, round(CASE WHEN n < 2 OR n IS NULL THEN 0 ELSE h / v END, 6) AS hapax_ratio, round(CASE WHEN n < 2 OR n IS NULL THEN 0 ELSE 10000.0 * (sq - n)::DOUBLE / (n * n)::DOUBLE END, 6) AS yules_k, round(CASE WHEN n < 10 OR n IS NULL THEN 0 ELSE ln(v) / ln(n) END, 6) AS heaps_exponent FROM words LEFT JOIN sums USING (doc_id)",
)
register(
    "s1_entropy",
    of_solutions("entropy"),
    f"WITH {CTE['words']}, chars AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, '')) AS x FROM words WHERE t <> '') GROUP BY ALL), h AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM chars GROUP BY doc_id) SELECT doc_id, round(coalesce(e, 0), 6) AS entropy FROM words LEFT JOIN h USING (doc_id)",
)
register(
    "s1_sentence_spread",
    of_solutions("sentence_length_cv"),
    f"WITH {CTE['words']}, one AS (SELECT doc_id, len({tokens_sql('s')}) AS k FROM (SELECT doc_id, unnest(parts) AS s FROM words) WHERE {strip_sql('s')} <> ''), cv AS (SELECT doc_id, CASE WHEN count(*) >= 2 AND avg(k) >= 1 THEN stddev_pop(k) / avg(k) ELSE 0 END AS c FROM one GROUP BY doc_id) SELECT doc_id, round(coalesce(c, 0), 6) AS sentence_length_cv FROM words LEFT JOIN cv USING (doc_id)",
)
register("s1_compression", of_solutions("compression_ratio", "sentence_compression_cv"))
register("s1_matrix", of_solutions(*features.SOLUTION_FEATURES))


@query(select_sql("words", "doc_id", word_count_log="ln(1 + len(w))", vocab_richness=over("len(list_distinct(lw))", "len(lw)"), pad_2="0::DOUBLE", pad_3="0::DOUBLE"))
def padded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features for a model that knows four: zeros stand for those that are lacking."""
    names = ["word_count_log", "vocab_richness"]
    f = features.solution_features(inputs.solutions(spark, sf_dir), keys=("doc_id",), only=tuple(names))
    return rounded(features.fitted(f, names, 4), *names)


FINGERPRINT = f"WITH {CTE['words']}, {TF} SELECT doc_id, n::BIGINT AS n, round(v::DOUBLE / n, 6) AS ttr, round(CASE WHEN n < 2 THEN 0 ELSE h / v END, 6) AS hapax_ratio, round(10000.0 * (sq - n)::DOUBLE / (n * n)::DOUBLE, 6) AS yules_k FROM sums WHERE n >= 2"


def fingerprint(counts: DataFrame) -> DataFrame:
    n = F.col("n")
    out = counts.where("n >= 2").select("doc_id", "n", (F.col("types") / n).alias("ttr"), (F.col("once") / F.col("types")).alias("hapax_ratio"), (10000.0 * (F.col("squares") - n) / (n * n)).alias("yules_k"))
    return rounded(out, "ttr", "hapax_ratio", "yules_k")


@query(FINGERPRINT)
def vocabulary_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each solution's tokens, row by row, without a shuffle."""
    words = features.with_words(inputs.solutions(spark, sf_dir).select("doc_id", "solution"), "solution", cased=False)
    counts = stage(words, counts=tally(F.col("ltoks")))
    return fingerprint(counts.select("doc_id", *[F.get("counts", i).cast("long").alias(k) for k, i in TALLY.items()]))


@query(FINGERPRINT)
def vocabulary_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by grouping (document, token) pairs, the form in which the counts themselves are a table."""
    s = inputs.solutions(spark, sf_dir).select("doc_id", F.explode(tokens(F.lower("solution"))).alias("w"))
    c = F.col("c")
    return fingerprint(s.groupBy("doc_id", "w").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.sum(c).alias("n"), F.count("*").alias("types"), F.sum((c == 1).cast("long")).alias("once"), F.sum(c * c).alias("squares")))


# ---- features of traces and steps

TRACE = f"t2 AS (SELECT *, {tokens_sql('trace')} AS w, {tokens_sql('lower(trace)')} AS lw, {tokens_sql('query')} AS qw, {tokens_sql('lower(query)')} AS qlw FROM steps)"
STEP_SQL = f"each AS (SELECT id, query, len(steps) AS k, generate_subscripts(steps, 1) - 1 AS i, unnest(steps) AS s FROM steps), e2 AS (SELECT *, {tokens_sql('s')} AS sw, {tokens_sql('lower(s)')} AS slw, {tokens_sql('query')} AS qw, {tokens_sql('lower(query)')} AS qlw FROM each)"


def refusal_sql(t: str, w: str) -> str:
    return f"({contained_sql(f'lower({t})', fixed.REFUSAL_PHRASES)})::DOUBLE / greatest(len({w}), 1)"


def trace_sql(**columns: str) -> str:
    return f"WITH {CTE['steps']}, {TRACE} SELECT id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in columns.items()) + " FROM t2"


register(
    "s2_sizes",
    of_traces("trace_word_count_log", "trace_char_count_log", "query_word_count_log", "vocab_richness", "query_trace_length_ratio", "digit_ratio", "punct_ratio", "chars_per_step"),
    trace_sql(trace_word_count_log="ln(1 + len(w))", trace_char_count_log="ln(1 + length(trace))", query_word_count_log="ln(1 + len(qw))", vocab_richness=over("len(list_distinct(lw))", "len(lw)"), query_trace_length_ratio="len(qw)::DOUBLE / greatest(len(w), 1)", digit_ratio=over(matched_sql("trace", r"\p{Nd}"), "length(trace)"), punct_ratio=over(matched_sql("trace", r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]"), "length(trace)"), chars_per_step="length(trace)::DOUBLE / greatest(len(steps), 1)"),
)
register(
    "s2_safety",
    of_traces("query_unsafe_kw_density", "trace_unsafe_kw_density", "refusal_indicator", "warning_word_count", "safety_language_count", "dangerous_term_count", "query_dangerous_term_count", "has_code_blocks"),
    trace_sql(query_unsafe_kw_density=density_sql("qlw"), trace_unsafe_kw_density=density_sql("lw"), refusal_indicator=refusal_sql("trace", "w"), warning_word_count=words_sql("trace", fixed.WARNING_WORDS) + "::DOUBLE", safety_language_count=words_sql("trace", fixed.SAFETY_WORDS) + "::DOUBLE", dangerous_term_count=words_sql("trace", fixed.DANGER_WORDS) + "::DOUBLE", query_dangerous_term_count=words_sql("query", fixed.DANGER_WORDS) + "::DOUBLE", has_code_blocks="regexp_matches(trace, '```|def |import |class |function[ \\t\\n\\x0B\\f\\r]')::INTEGER::DOUBLE"),
)
register(
    "s2_step_stats",
    of_traces("step_count", "avg_step_length", "step_length_std", "max_step_length", "min_step_length", "avg_step_unsafe_score"),
    f"WITH {CTE['steps']}, {STEP_SQL}, a AS (SELECT id, count(*) AS n, avg(len(sw)) AS m, stddev_pop(len(sw)) AS d, max(len(sw)) AS hi, min(len(sw)) AS lo, avg({density_sql('slw')}) AS u FROM e2 GROUP BY id) SELECT id, coalesce(n, 0)::DOUBLE AS step_count, round(coalesce(m, 0), 6) AS avg_step_length, round(coalesce(d, 0), 6) AS step_length_std, coalesce(hi, 0)::DOUBLE AS max_step_length, coalesce(lo, 0)::DOUBLE AS min_step_length, round(coalesce(u, 0), 6) AS avg_step_unsafe_score FROM steps LEFT JOIN a USING (id)",
)
register(
    "s2_halves",
    of_traces("late_refusal_ratio", "early_engagement_ratio"),
    f"WITH {CTE['steps']}, {STEP_SQL}, a AS (SELECT id, avg({refusal_sql('s', 'sw')}) FILTER (i >= k // 2) AS late, avg({density_sql('slw')}) FILTER (i < greatest(k // 2, 1)) AS early FROM e2 GROUP BY id) SELECT id, round(coalesce(late, 0), 6) AS late_refusal_ratio, round(coalesce(early, 0), 6) AS early_engagement_ratio FROM steps LEFT JOIN a USING (id)",
)
CHARS_SQL = "(SELECT coalesce(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split({t}, '')) AS x) WHERE x <> '' GROUP BY x))"
DISCLAIMER_SQL = r"regexp_matches(lower({t}), '(^|[^\p{{L}}\p{{N}}_])((disclaimer|caveat|please note)([^\p{{L}}\p{{N}}_]|$)|(note|important):[\p{{L}}\p{{N}}_])')::INTEGER::DOUBLE"
CODE_SQL = r"regexp_matches({t}, '```|def |import |class |function[ \t\n\x0B\f\r]')::INTEGER::DOUBLE"
register(
    "s2_words",
    of_traces("entropy", "repetition_ratio", "has_disclaimer"),
    trace_sql(entropy=CHARS_SQL.format(t="trace"), repetition_ratio="CASE WHEN len(lw) < 4 THEN 0 ELSE (len(lw) - 3 - len(list_distinct(list_transform(range(1, len(lw) - 2), lambda i: array_to_string(lw[i:i+3], ' ')))))::DOUBLE / (len(lw) - 3) END", has_disclaimer=DISCLAIMER_SQL.format(t="trace")),
)
register("s2_matrix", lambda spark, d: rounded(f := features.trace_features(inputs.traces(spark, d), keys=("id",)), *f.columns[1:]))


STEP_COLUMNS = {
    "step_word_count_log": "ln(1 + len(sw))",
    "step_vocab_richness": over("len(list_distinct(slw))", "len(slw)"),
    "step_unsafe_kw_density": density_sql("slw"),
    "step_refusal_indicator": refusal_sql("s", "sw"),
    "step_digit_ratio": over(matched_sql("s", r"\p{Nd}"), "length(s)"),
    "step_punct_ratio": over(matched_sql("s", r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]"), "length(s)"),
    "step_position": "i::DOUBLE / greatest(k - 1, 1)",
    "is_first_step": "(i = 0)::INTEGER::DOUBLE",
    "is_last_step": "(i = k - 1)::INTEGER::DOUBLE",
    "query_unsafe_kw_density": density_sql("qlw"),
    "step_warning_words": words_sql("s", fixed.WARNING_WORDS) + "::DOUBLE",
    "step_dangerous_terms": words_sql("s", fixed.DANGER_WORDS) + "::DOUBLE",
    "step_safety_language": words_sql("s", fixed.SAFETY_WORDS) + "::DOUBLE",
    "step_has_code": CODE_SQL.format(t="s"),
    "step_has_disclaimer": DISCLAIMER_SQL.format(t="s"),
    "query_word_count_log": "ln(1 + len(qw))",
    "query_dangerous_terms": words_sql("query", fixed.DANGER_WORDS) + "::DOUBLE",
    "query_warning_words": words_sql("query", fixed.WARNING_WORDS) + "::DOUBLE",
    "query_has_code": CODE_SQL.format(t="query"),
    "total_steps": "k::DOUBLE",
    "step_entropy": f"CASE WHEN len(sw) > 5 THEN {CHARS_SQL.format(t='s')} ELSE 0 END",
}


@query(f"WITH {CTE['steps']}, {STEP_SQL} SELECT id, i::INTEGER AS step_idx, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in STEP_COLUMNS.items()) + " FROM e2")
def step_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a step's matrix but the compressed one, which SQL lacks."""
    rows = features.step_rows(inputs.traces(spark, sf_dir), keys=("id",))
    own = features.step_features(rows, keys=("id", "step_idx"), compressed=False)
    return rounded(own.select("id", "step_idx", *STEP_COLUMNS), *STEP_COLUMNS)


@query()
def step_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features.step_features(features.step_rows(inputs.traces(spark, sf_dir), keys=("id",)), keys=("id", "step_idx"))
    return rounded(own, *own.columns[2:])


@query(f"WITH {CTE['steps']}, l AS (SELECT *, [id % 2, 1, 0] AS labels FROM steps), e AS (SELECT id, len(steps) AS total_steps, unnest(range(0, least(len(steps), len(labels)))) AS i, steps, labels FROM l) SELECT id, i::INTEGER AS step_idx, steps[i + 1] AS step, total_steps::INTEGER AS total_steps, labels[i + 1]::INTEGER AS label FROM e")
def step_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inputs.traces(spark, sf_dir).withColumn("labels", F.array((F.col("id") % 2).cast("int"), F.lit(1), F.lit(0)))
    return features.step_rows(t, labels="labels", keys=("id",)).select("id", "step_idx", "step", "total_steps", "label")


@query(f"WITH {CTE['traces']} SELECT id, {words_sql('trace', fixed.CLAUSE_WORDS)}::INTEGER AS clauses, {contained_sql('lower(trace)', fixed.EDUCATIONAL)} AS framings, {words_sql('trace', ('gonna', 'wanna', 'gotta', 'mate', 'bloke', 'folks', 'reckon', 'dunno', 'kinda', 'sorta'))}::INTEGER AS slang, {contained_sql('lower(query)', [k.lower() for k in fixed.QUERY_DANGER])} AS danger FROM traces")
def query_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts behind the scores of complexity, framing, dialect and danger."""
    t, one = F.col("trace"), F.lit(1)
    return inputs.traces(spark, sf_dir).select("id", S.query_complexity(t, one).cast("int").alias("clauses"), S.educational_framing(t, one).cast("int").alias("framings"), S.dialect_score(t, one).cast("int").alias("slang"), S.query_danger(F.col("query")).alias("danger"))


@query(f"WITH {CTE['traces']} SELECT id, {matched_sql('trace', 'Step [0-9]+:')}::INTEGER AS markers, {words_sql('trace', ('nist', 'sans', 'cisa', 'nih', 'who', 'cdc', 'aacap', 'institute', 'academy', 'association', 'foundation', 'university', 'journal'))}::INTEGER + len(regexp_extract_all(lower(trace), 'according to |researchers at '))::INTEGER AS appeals, regexp_matches(lower(trace), '(^|[^\\p{{L}}\\p{{N}}_])(disclaimer|caveat|please note)([^\\p{{L}}\\p{{N}}_]|$)')::INTEGER AS disclaimer FROM traces")
def trace_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("trace")
    return inputs.traces(spark, sf_dir).select("id", S.step_marker_count(t).alias("markers"), S.authority_appeals(t).alias("appeals"), S.has_disclaimer(t).alias("disclaimer"))


# ---- refusal, overlap, cascade

#: Patterns in plain letters.
PLAIN = tuple(p for p in fixed.REFUSAL_PATTERNS if p.isascii())
#: Sentences that refuse, one in each of many languages, and some that do not.
SAID = ("I won't be able to do this.", "Ich kann Ihnen dabei nicht helfen.", "Je ne peux pas vous aider.", "Lo siento, hoy no puedo.", "抱歉，今天我没办法。", "К сожалению, это невозможно.", "Tôi không thể giúp bạn.", "죄송합니다 지금은 불가능", "申し訳ないが、できません", "Non posso aiutarti.", "Nie mogę pomóc.", "Não posso ajudar.", "آسف، لا أستطيع", "ฉันไม่สามารถช่วย", "Saya tidak bisa membantu.", "Jag kan inte hjälpa dig.", "Ik kan niet helpen.", "Λυπάμαι, δεν μπορώ", "We can go on now.", "Das geht gut.", "C'est possible.", "好的，我们开始", "Да, конечно", "")


def patterns_sql(t: str, patterns) -> str:
    return f"regexp_matches({t}, {quoted('(?i)(?:' + '|'.join(patterns) + ')')})"


def refused_sql(t: str, patterns=fixed.REFUSAL_PATTERNS) -> str:
    """All patterns and keywords; of white space, SQL knows the ASCII kinds, which are those in the tables."""
    return f"({patterns_sql(strip_sql(t), patterns)} OR {contained_sql(f'lower({t})', [k.lower() for k in fixed.REFUSAL_KEYWORDS])} > 0)"


@query(f"WITH {CTE['traces']} SELECT id, {refused_sql('trace', PLAIN)} AS refusal FROM traces")
def refusal_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a list of patterns of one's own: those in plain letters."""
    return inputs.traces(spark, sf_dir).select("id", S.has_refusal("trace", patterns=PLAIN).alias("refusal"))


@query(f"WITH {CTE['traces']} SELECT id, {refused_sql('trace')} AS refusal, {patterns_sql('trace', fixed.SAFETY_PATTERNS)} AS safety_meta, {patterns_sql('trace', fixed.INSTRUCTION_PATTERNS)} AS instruction FROM traces")
def refusal_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("trace")
    return inputs.traces(spark, sf_dir).select("id", S.has_refusal(t).alias("refusal"), S.has_safety_meta(t).alias("safety_meta"), S.has_instruction(t).alias("instruction"))


@query(f"WITH said AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || chr(10) ELSE '' END || [{', '.join(map(quoted, SAID))}][1 + doc_id % {len(SAID)}] AS t FROM documents) SELECT doc_id, {refused_sql('t')} AS refusal FROM said")
def refusal_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of many languages, alone and at the end of whole documents."""
    k = F.col("doc_id")
    before = F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))).otherwise("")
    said = F.element_at(F.array(*[F.lit(t) for t in SAID]), (F.pmod(k, F.lit(len(SAID))) + 1).cast("int"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", S.has_refusal(F.concat(before, said)).alias("refusal"))


CONTENT = lambda t: f"list_distinct(list_filter(list_transform({tokens_sql(f'lower({t})')}, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda x: length(x) > 1 AND NOT list_contains([{', '.join(quoted(w) for w in fixed.STOP_WORDS)}], x)))"
OVERLAP = f"sets AS (SELECT *, {CONTENT('query')} AS a, {CONTENT('trace')} AS b FROM gold), overlap AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0 END AS o FROM sets)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.evidence(inputs.gold(spark, sf_dir))


#: The tables hold no character that NFKC changes, which SQL lacks; a test on other characters covers it.
EVIDENCE = f"WITH {CTE['gold']}, {OVERLAP}, ev AS (SELECT *, length({strip_sql('trace')}) AS stripped, {refused_sql('trace')} AS refusal, length(trace) AS n FROM overlap)"
RULE = "CASE WHEN stripped < 5 OR refusal THEN 'safe' WHEN o > {o} OR n > {n} THEN 'unsafe' ELSE 'safe' END"


@query(f"WITH {CTE['gold']}, {OVERLAP} SELECT doc_id, len(a)::INTEGER AS query_words, len(b)::INTEGER AS trace_words, round(o, 6) AS overlap FROM overlap")
def content_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stage(inputs.gold(spark, sf_dir), a=S.content_words("query"), b=S.content_words("trace"))
    return d.select("doc_id", F.size("a").alias("query_words"), F.size("b").alias("trace_words"), F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(f"{EVIDENCE} SELECT doc_id, refusal, round(o, 6) AS overlap, {RULE.format(o=0.08, n=3500)} AS label FROM ev")
def sql_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade through the functions that a session's SQL gets."""
    sql.register(spark)
    return spark.sql("SELECT doc_id, refuses(trace) AS refusal, round(overlap(query, trace), 6) AS overlap, rule_label(query, trace) AS label FROM {gold}", gold=inputs.gold(spark, sf_dir))


@query(f"{EVIDENCE} SELECT doc_id, {RULE.format(o=0.08, n=3500)} AS label FROM ev")
def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("doc_id", cascade.rule().alias("label"))


MARKER_SQL = f"{inputs.WS}*(?:{'|'.join(fixed.STEP_WORDS)}){inputs.WS}*[0-9]+{inputs.WS}*[:：.]"
CUT = "chr(1)"
AT_MARKERS = rf"string_split(regexp_replace(st, '(?i)(^|\n)({MARKER_SQL})', {CUT} || '\1\2', 'g'), {CUT})"
AT_SENTENCES = rf"string_split(regexp_replace(st, '([.!?。！？\n]){inputs.WS}+', '\1' || {CUT}, 'g'), {CUT})"
PIECES = lambda e: f"list_filter(list_transform({e}, lambda s: {strip_sql('s')}), lambda s: s <> '')"
OF_MARKERS = PIECES(rf"list_filter({AT_MARKERS}, lambda s: regexp_matches(s, '(?i)^\n?{MARKER_SQL}'))")
MARKED = (
    f"stripped AS (SELECT *, {strip_sql('trace')} AS st FROM traces), marked AS (SELECT *, {OF_MARKERS} AS by_marker, {PIECES(AT_SENTENCES)} AS by_sentence FROM stripped), "
    "split AS (SELECT *, CASE WHEN st = '' OR len(by_marker) + len(by_sentence) = 0 THEN [st] WHEN len(by_marker) > 0 THEN by_marker ELSE by_sentence END AS steps FROM marked)"
)
SCORE_SQL = f"CASE WHEN {strip_sql('s')} = '' THEN '0.5' WHEN {refused_sql('s')} THEN '1.0' WHEN {patterns_sql(strip_sql('s'), fixed.SAFETY_PATTERNS)} THEN '0.8' WHEN {patterns_sql(strip_sql('s'), fixed.INSTRUCTION_PATTERNS)} THEN '0.2' ELSE '0.5' END"


@query(
    f"WITH {CTE['traces']}, {MARKED}, each AS (SELECT id, generate_subscripts(steps, 1) AS i, unnest(steps) AS s FROM split), scored AS (SELECT id, string_agg({SCORE_SQL}, '|' ORDER BY i) AS scores FROM each GROUP BY id), sets AS (SELECT *, {CONTENT('query')} AS a, {CONTENT('trace')} AS b FROM split), "
    f"ev AS (SELECT id, length(st) AS stripped, {refused_sql('trace')} AS refusal, length(trace) AS n, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0 END AS o FROM sets) SELECT id, {RULE.format(o=0.08, n=3500)} AS label, CASE WHEN stripped < 5 THEN '1.0' ELSE scores END AS detailed_label FROM ev JOIN scored USING (id)"
)
def safety_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade: all patterns, normalised words, scores of the steps."""
    return cascade.classify(inputs.traces(spark, sf_dir)).select("id", "label", "detailed_label")


@query(f"{EVIDENCE}, p AS (SELECT y, {RULE.format(o=0.08, n=3500)} = 'unsafe' AS p FROM ev), c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM p) SELECT tp, fp, fn, tn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_true, round(coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1_false, round((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS f1_macro, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy FROM c")
def rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tuning.evaluate_rule(evidence(spark, sf_dir), F.col("y"), 0.08, 3500), "f1_true", "f1_false", "f1_macro", "accuracy")


GRID = f"{EVIDENCE}, grid AS (SELECT a.v::INTEGER AS overlap_1000, b.v::INTEGER AS length FROM (SELECT unnest(range(20, 200, 5)) AS v) a, (SELECT unnest(range(1500, 8500, 500)) AS v) b), p AS (SELECT overlap_1000, length, y, NOT (stripped < 5 OR refusal) AND (o > overlap_1000 / 1000.0::DOUBLE OR n > length) AS p FROM ev, grid), c AS (SELECT overlap_1000, length, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM p GROUP BY ALL), s AS (SELECT *, (coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1_macro FROM c)"


@query(f"{GRID} SELECT overlap_1000, length, tp, fp, fn, tn, round(f1_macro, 6) AS f1_macro FROM s")
def rule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tuning.rule_scores(evidence(spark, sf_dir), "y"), "f1_macro")


@query(f"{GRID} SELECT overlap_1000, length, round(f1_macro, 6) AS f1_macro FROM s ORDER BY s.f1_macro DESC, overlap_1000, length LIMIT 1")
def rule_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tuning.best_rule(tuning.rule_scores(evidence(spark, sf_dir), "y")), "f1_macro")


PROB = "((doc_id * 37 + 11) % 1000) / 1000.0"
SWEEP = f"WITH p0 AS (SELECT ({PROB})::DOUBLE AS prob, toxic = 1 AS y FROM labels), t AS (SELECT unnest(range(200, 805, 5))::INTEGER AS threshold_1000), c AS (SELECT threshold_1000, count(*) FILTER (y AND prob > threshold_1000 / 1000.0::DOUBLE) AS tp, count(*) FILTER (NOT y AND prob > threshold_1000 / 1000.0::DOUBLE) AS fp, count(*) FILTER (y AND prob <= threshold_1000 / 1000.0::DOUBLE) AS fn, count(*) FILTER (NOT y AND prob <= threshold_1000 / 1000.0::DOUBLE) AS tn FROM p0, t GROUP BY 1), s AS (SELECT *, (coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1_macro FROM c)"


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "labels")
    return tuning.threshold_scores(rows, F.pmod(F.col("doc_id") * 37 + 11, F.lit(1000)) / 1000.0, F.col("toxic") == 1)


@query(f"{SWEEP} SELECT threshold_1000, tp, fp, fn, tn, round(f1_macro, 6) AS f1_macro FROM s")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sweep(spark, sf_dir), "f1_macro")


@query(f"{SWEEP} SELECT threshold_1000, round(f1_macro, 6) AS f1_macro FROM s ORDER BY s.f1_macro DESC, threshold_1000 LIMIT 1")
def threshold_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tuning.best_threshold(sweep(spark, sf_dir)), "f1_macro")


FINE = "((doc_id * 7919 + 13) % 100003)::DOUBLE / 100003"
EVERY = f"WITH p0 AS (SELECT {FINE} AS prob, toxic = 1 AS y FROM labels), g AS (SELECT prob, count(*) FILTER (y) AS ones, count(*) FILTER (NOT y) AS zeros FROM p0 GROUP BY prob), c AS (SELECT *, (sum(ones) OVER w - ones)::BIGINT AS tp, (sum(zeros) OVER w - zeros)::BIGINT AS fp, sum(ones) OVER () AS t, sum(zeros) OVER () AS f FROM g WINDOW w AS (ORDER BY prob DESC)), d AS (SELECT *, (t - tp)::BIGINT AS fn, (f - fp)::BIGINT AS tn FROM c), s AS (SELECT *, (coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1_macro FROM d)"


def exact_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.every_threshold(inputs.table(spark, sf_dir, "labels"), F.pmod(F.col("doc_id") * 7919 + 13, F.lit(100003)) / 100003.0, F.col("toxic") == 1)


@query(f"{EVERY} SELECT round(prob, 9) AS threshold, tp, fp, fn, tn, round(f1_macro, 6) AS f1_macro FROM s")
def threshold_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 at every score that occurs."""
    return rounded(exact_sweep(spark, sf_dir).select(F.round("prob", 9).alias("threshold"), "tp", "fp", "fn", "tn", "f1_macro"), "f1_macro")


@query(f"{EVERY}, best AS (SELECT prob, f1_macro FROM s ORDER BY f1_macro DESC, prob LIMIT 1), area AS (SELECT sum(ones * tn - ones * zeros / 2.0) / (sum(ones) * sum(zeros)) AS auc FROM s) SELECT round(prob, 9) AS threshold, round(f1_macro, 6) AS f1_macro, round(auc, 6) AS auc FROM best, area")
def threshold_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all thresholds, and the area under the curve."""
    scores = exact_sweep(spark, sf_dir)
    both = tuning.best_of_all(scores).join(F.broadcast(tuning.area(scores)))  # a row each
    return rounded(both.withColumn("threshold", F.round("threshold", 9)), "f1_macro", "auc")


@query(f"WITH p AS (SELECT doc_id, {PROB} AS prob, coalesce(text, '') AS t FROM documents) SELECT doc_id, CASE WHEN prob < 0.36 THEN 'safe' ELSE 'unsafe' END AS label FROM p")
def probability_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.pmod(F.col("doc_id") * 37 + 11, F.lit(1000)) / 1000.0
    return inputs.table(spark, sf_dir, "documents").select("doc_id", cascade.by_probability(p).alias("label"))


#: Ends with markers of both kinds of replies, which a trace gets by its key.
REPLIED = (" 步骤1：a 步骤2：b", " Step 1 : a Step 2 : b", "", " Step 3:c")
PROB_STEPS = "CASE WHEN id % 5 = 0 THEN 0.9996 WHEN id % 7 = 0 THEN 0.5 ELSE ((id * 37 + 11) % 10000) / 10000.0 END"


@query(
    f"WITH {CTE['traces']}, p AS (SELECT id, ({PROB_STEPS})::DOUBLE AS prob, len(list_filter(list_transform(regexp_split_to_array(trace || [{', '.join(map(quoted, REPLIED))}][1 + id % 4], '(?:步骤|Step){inputs.WS}*[0-9]+{inputs.WS}*[：:]'), lambda s: {strip_sql('s')}), lambda s: s <> '')) AS n FROM traces) "
    r"SELECT id, CASE WHEN prob < 0.36::DOUBLE THEN 'safe' ELSE 'unsafe' END AS label, rtrim(repeat(CASE WHEN prob < 0.36::DOUBLE THEN '1.0' ELSE regexp_replace(CAST(round(1 - prob, 4) AS DECIMAL(6, 4))::VARCHAR, '(\.[0-9]+?)0+$', '\1') END || '|', greatest(n, 1)), '|') AS scores FROM p"
)
def probability_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    p = F.when(k % 5 == 0, 0.9996).when(k % 7 == 0, 0.5).otherwise(F.pmod(k * 37 + 11, F.lit(10000)) / 10000.0)
    end = F.element_at(F.array(*[F.lit(x) for x in REPLIED]), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    t = inputs.traces(spark, sf_dir).select("id", F.concat("trace", end).alias("trace"), p.alias("prob")).withColumn("label", cascade.by_probability(F.col("prob")))
    return t.select("id", "label", cascade.probability_steps(F.col("label"), F.col("prob"), "trace").alias("scores"))


@query(f"{EVIDENCE}, p AS (SELECT doc_id, trace, y, {RULE.format(o=0.08, n=3500)} = 'unsafe' AS p FROM ev), f AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY doc_id) AS r FROM p WHERE y <> p) SELECT doc_id, y, replace(substring(trace, 1, 100), chr(10), ' ') AS preview FROM f WHERE r <= 5")
def error_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five errors of each kind (the samples are the feature), each a top-k of its own."""
    wrong = evidence(spark, sf_dir).withColumn("p", cascade.rule() == "unsafe").where("y <> p")
    shown = lambda y: wrong.where(F.col("y") == y).orderBy("doc_id").limit(5)
    return shown(True).union(shown(False)).select("doc_id", "y", F.replace(F.substring("trace", 1, 100), F.lit("\n"), F.lit(" ")).alias("preview"))


# ---- steps

LISTED = lambda e: f"WITH {CTE['traces']}, s AS (SELECT id, list_filter(list_transform({e}, lambda s: {strip_sql('s')}), lambda s: s <> '') AS steps FROM traces) SELECT id, len(steps)::INTEGER AS n, array_to_string(steps, '|') AS joined FROM s"


def listed(spark: SparkSession, sf_dir: str, split) -> DataFrame:
    t = stage(inputs.traces(spark, sf_dir), steps=split("trace"))
    return t.select("id", F.size("steps").alias("n"), F.array_join("steps", "|").alias("joined"))


@query(LISTED(r"regexp_split_to_array(trace, 'Step [0-9]+:[ \t\n\x0B\f\r]*')"))
def steps_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir, steps.by_number)


@query(LISTED(r"regexp_split_to_array(trace, '(?:步骤|Step)[ \t\n\x0B\f\r]*[0-9]+[ \t\n\x0B\f\r]*[：:]')"))
def steps_by_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir, steps.by_reply)


@query(f"WITH {CTE['traces']}, {MARKED} SELECT id, len(steps)::INTEGER AS n, array_to_string(steps, '|') AS joined FROM split")
def steps_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir, steps.by_marker)


@query(f"WITH {CTE['traces']}, {MARKED} SELECT id, (generate_subscripts(steps, 1) - 1)::INTEGER AS step_idx, unnest(steps) AS step FROM split")
def sql_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps through the table function that a session's SQL gets."""
    sql.register(spark)
    return spark.sql("SELECT id, step_idx, step FROM {traces}, LATERAL reasoning_steps(trace)", traces=inputs.traces(spark, sf_dir))


@query(f"WITH {CTE['traces']}, s AS (SELECT id, list_filter(list_transform(regexp_split_to_array(trace, '(?i)(?:Step|Bước|Schritt|Étape|Paso|步骤|步驟)[ \\t\\n\\x0B\\f\\r]*[0-9]+[ \\t\\n\\x0B\\f\\r]*[:：.]'), lambda s: {strip_sql('s')}), lambda s: s <> '') AS steps FROM traces WHERE trace <> '') SELECT id, array_to_string(list_transform(steps, lambda s: CASE WHEN id % 2 = 0 THEN '1.0' ELSE '0.0' END), '|') AS scores FROM s WHERE len(steps) > 0")
def steps_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inputs.traces(spark, sf_dir).where("trace <> ''")
    return t.select("id", steps.uniform_scores("trace", F.when(F.col("id") % 2 == 0, "safe").otherwise("unsafe")).alias("scores"))


NUMBERED = lambda xs: f"array_to_string(list_transform(range(1, len({xs}) + 1), lambda i: 'Step ' || i || ': ' || {xs}[i]), chr(10))"
TRUNCATED = (
    f"WITH {CTE['steps']}, n AS (SELECT id, trace, steps, len(steps) AS n, greatest(len(steps) - 8, 0) AS inner_, least(greatest(len(steps) - 8, 0), 4) AS k, {NUMBERED('steps')} AS every FROM steps), "
    "s AS (SELECT *, list_concat(steps[1:4], list_concat(list_transform(range(0, k), lambda i: steps[5 + CASE WHEN k > 1 THEN i * (inner_ - 1) // (k - 1) ELSE 0 END]), CASE WHEN n > 4 THEN steps[greatest(n - 3, 1):n] ELSE [] END)) AS shown FROM n), "
    f"f AS (SELECT *, {NUMBERED('shown')} AS whole, list_transform(shown, lambda s: substring(s, 1, 600 // greatest(len(shown), 1))) AS short FROM s) "
    f"SELECT id, CASE WHEN n = 0 THEN substring(trace, 1, 600) WHEN n <= 10 AND length(every) <= 600 THEN every WHEN length(whole) <= 600 THEN whole ELSE substring({NUMBERED('short')}, 1, 600) END AS shown FROM f"
)


@query(TRUNCATED)
def truncated_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stage(inputs.traces(spark, sf_dir), steps=steps.by_number("trace"))
    return t.select("id", steps.truncated("trace", F.col("steps"), 600).alias("shown"))


@query(f"WITH {CTE['traces']} SELECT id, 'QUERY: ' || substring(query, 1, 500) || chr(10) || chr(10) || 'REASONING TRACE:' || chr(10) || substring(trace, 1, 2000) AS prompt FROM traces")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.traces(spark, sf_dir).select("id", votes.prompt(F.col("query"), F.col("trace")).alias("prompt"))


# ---- votes

V = f"WITH {CTE['votes']}"
COUNTS = "(coalesce((alpha = '{0}')::INTEGER, 0) + coalesce((beta = '{0}')::INTEGER, 0) + coalesce((gamma = '{0}')::INTEGER, 0))"


@query(f"{V} SELECT doc_id, CASE WHEN {COUNTS.format('safe')} + {COUNTS.format('unsafe')} = 0 THEN 'safe' WHEN {COUNTS.format('unsafe')} >= {COUNTS.format('safe')} THEN 'unsafe' ELSE 'safe' END AS label FROM votes")
def vote_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.votes(spark, sf_dir).select("doc_id", votes.safety_vote(F.col("votes")).alias("label"))


SOURCE = {"alpha": ("human", "AI", "hm", None), "beta": ("maintain", "Human.", "", "llm"), "gamma": ("human", "machine", "?", "artificial")}
SOURCE_SQL = "WITH r AS (SELECT doc_id, " + ", ".join(f"[{', '.join('NULL' if v is None else quoted(v) for v in names)}][1 + (doc_id // {i + 1}) % 4] AS {m}" for i, (m, names) in enumerate(SOURCE.items())) + " FROM documents), l AS (SELECT doc_id, " + ", ".join(f"CASE WHEN contains(lower(coalesce({m}, '')), 'human') THEN 'human' WHEN regexp_matches(lower(coalesce({m}, '')), 'ai|llm|machine|artificial') THEN 'ai' ELSE 'unknown' END AS {m}" for m in SOURCE) + " FROM r)"


def source_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents")
    own = [votes.source_label(F.element_at(F.array(*[F.lit(v) for v in names]), (F.pmod(F.floor(F.col("doc_id") / (i + 1)), F.lit(4)) + 1).cast("int"))).alias(m) for i, (m, names) in enumerate(SOURCE.items())]
    return d.select("doc_id", *own)


@query(f"{SOURCE_SQL}, c AS (SELECT doc_id, (alpha = 'ai')::INTEGER + (beta = 'ai')::INTEGER + (gamma = 'ai')::INTEGER AS a, (alpha = 'human')::INTEGER + (beta = 'human')::INTEGER + (gamma = 'human')::INTEGER AS h FROM l) SELECT doc_id, CASE WHEN a >= h THEN 'ai' ELSE 'human' END AS label FROM c")
def vote_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = source_votes(spark, sf_dir)
    return v.select("doc_id", votes.source_vote(F.map_from_arrays(F.array(*[F.lit(m) for m in SOURCE]), F.array(*SOURCE))).alias("label"))


@query(f"{SOURCE_SQL} SELECT d.doc_id, CASE WHEN a = 'unknown' AND b = 'unknown' THEN t WHEN a = 'unknown' THEN b WHEN b = 'unknown' THEN a WHEN a = b THEN a ELSE t END AS label FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 'unknown' ELSE alpha END AS a, CASE WHEN d.doc_id % 7 = 0 THEN 'unknown' ELSE beta END AS b, CASE WHEN d.doc_id % 11 = 0 THEN 'ai' ELSE gamma END AS t FROM documents d JOIN l USING (doc_id)) d")
def agreement_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' tables lack some records, the tie-break's lacks others."""
    v = source_votes(spark, sf_dir)
    side = lambda m, k: v.where(F.col("doc_id") % k != 0).select("doc_id", F.col(m).alias("label"))
    return votes.agree_else_tiebreak(v.select("doc_id"), side("alpha", 5), side("beta", 7), side("gamma", 11), "doc_id").select("doc_id", "label")


@query(f"{V}, u AS (SELECT unnest([{{'m': 'alpha', 'l': alpha}}, {{'m': 'beta', 'l': beta}}, {{'m': 'gamma', 'l': gamma}}]) AS r FROM votes) SELECT r.m AS model, coalesce(r.l, 'unknown') AS label, count(*) AS n FROM u GROUP BY 1, 2")
def vote_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.model_histogram(inputs.votes(spark, sf_dir), list(inputs.MODELS))


@query(f"{V}, a AS (SELECT len(list_distinct(list_filter([alpha, beta, gamma], lambda x: x IN ('safe', 'unsafe')))) <= 1 AS same FROM votes) SELECT count(*) FILTER (same) AS agreed, count(*) AS n, round(count(*) FILTER (same)::DOUBLE / count(*), 6) AS rate FROM a")
def vote_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(votes.agreement_rate(inputs.votes(spark, sf_dir)), "rate")


@query(f"{V} SELECT doc_id FROM votes WHERE doc_id % 3 <> 0 OR alpha IS NULL OR beta IS NULL")
def unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a cached label of both models; two thirds have no line in the cache."""
    v = inputs.votes(spark, sf_dir)
    return votes.to_classify(v.select("doc_id"), v.where("doc_id % 3 = 0").select("doc_id", "votes"), ["alpha", "beta"], "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.uncached(inputs.table(spark, sf_dir, "documents").select("doc_id"), inputs.table(spark, sf_dir, "labels"), "doc_id")


@query(f"{V} SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'unsafe' END, CASE WHEN doc_id % 3 = 0 THEN alpha END, '-') AS alpha, coalesce(CASE WHEN doc_id % 3 = 0 THEN beta END, '-') AS beta, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'new' END, '-') AS delta FROM votes WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def vote_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old votes of every third record, new ones of every second; a new label stands."""
    v = inputs.votes(spark, sf_dir)
    new = v.where("doc_id % 2 = 0").select("doc_id", F.create_map(F.lit("alpha"), F.lit("unsafe"), F.lit("delta"), F.lit("new")).alias("votes"))
    m = votes.merge_votes(v.where("doc_id % 3 = 0").select("doc_id", "votes"), new, "doc_id")
    return m.select("doc_id", *[F.coalesce(F.col("votes")[k], F.lit("-")).alias(k) for k in ("alpha", "beta", "delta")])


@query("SELECT user_id, max_by(event_type, (event_id)) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache's last line of each key."""
    e = inputs.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return votes.latest(e, "user_id", "event_id").select("user_id", "event_type", "event_id")


TERNARY = ("safe", "UNSAFE!", "potentially_unsafe", "It is potentially unsafe.", "unsafe, potentially", "", None, "maybe")


@query(f"WITH r AS (SELECT doc_id, lower([{', '.join('NULL' if v is None else quoted(v) for v in TERNARY)}][1 + doc_id % 8]) AS t FROM documents) SELECT doc_id, CASE WHEN t IS NULL THEN 0 WHEN regexp_matches(t, 'potentially[_ ]unsafe') THEN 1 WHEN contains(t, 'unsafe') AND NOT contains(t, 'potentially') THEN 2 WHEN contains(t, 'safe') AND NOT contains(t, 'unsafe') THEN 0 WHEN starts_with(t, 'unsafe') THEN 2 ELSE 0 END::INTEGER AS code, CASE WHEN t IS NULL THEN 'error' WHEN regexp_matches(t, 'potentially[_ ]unsafe') THEN 'potentially_unsafe' WHEN contains(t, 'unsafe') THEN 'unsafe' WHEN contains(t, 'safe') THEN 'safe' ELSE 'unknown' END AS name FROM r")
def ternary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.element_at(F.array(*[F.lit(v) for v in TERNARY]), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", votes.ternary_label(r).alias("r")).select("doc_id", "r.code", "r.name")


@query("SELECT doc_id, ((doc_id % 4) = 1)::INTEGER AS label, CASE WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0.05 END::DOUBLE AS p0, CASE WHEN doc_id % 3 = 1 THEN 0.9 ELSE 0.05 END::DOUBLE AS p1, CASE WHEN doc_id % 3 = 2 THEN 0.9 ELSE 0.05 END::DOUBLE AS p2 FROM documents")
def step_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*[F.lit(v) for v in ("0", " 1 ", "hello 1", None)]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("r"), votes.one_hot(F.pmod("doc_id", F.lit(3))).alias("p"))
    return d.select("doc_id", votes.step_reply(F.col("r")).alias("label"), *[F.get("p", i).alias(f"p{i}") for i in range(3)])


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'safe' WHEN 1 THEN 'is unsafe' WHEN 2 THEN 'unsafe' ELSE '-' END AS reply FROM documents")
def response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = ('{"choices":[{"message":{"content":" Safe\\n"}}]}', '{"candidates":[{"content":{"parts":[{"text":"IS unsafe"}]}}]}', '{"candidates":[{"finishReason":"SAFETY"}]}', '{"candidates":[{"finishReason":"OTHER"}]}')
    body = F.element_at(F.array(*[F.lit(b) for b in bodies]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(votes.reply_text(body), F.lit("-")).alias("reply"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END::INTEGER AS three, CASE doc_id % 5 WHEN 0 THEN 'safe' ELSE 'unsafe' END AS two FROM documents")
def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(v) for v in (" Safe", "potentially", "Potentially Unsafe", "unsafe ", "other")]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", cascade.three_way(raw).alias("three"), cascade.two_way(raw).alias("two"))


@query(f"WITH {CTE['traces']} SELECT round(sum(length(trace)) * 4 * 0.003 / 1000 + count(*) * 50 * 0.015 / 1000, 6) AS cost FROM traces")
def call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(votes.cost(inputs.traces(spark, sf_dir), "trace", 0.003, 0.015), "cost")


@query(f"{V}, pairs AS (SELECT unnest([{{'a': 'alpha', 'b': 'beta'}}, {{'a': 'alpha', 'b': 'gamma'}}, {{'a': 'beta', 'b': 'gamma'}}]) AS p), r AS (SELECT p.a AS a, p.b AS b, CASE p.a WHEN 'alpha' THEN alpha ELSE beta END AS x, CASE p.b WHEN 'beta' THEN beta ELSE gamma END AS y FROM votes, pairs) SELECT a, b, count(*) FILTER (x = y AND x <> 'unknown') AS agreed, count(*) FILTER (x <> 'unknown' AND y <> 'unknown') AS n FROM r GROUP BY a, b")
def pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = inputs.votes(spark, sf_dir)
    pairs = [("alpha", "beta"), ("alpha", "gamma"), ("beta", "gamma")]
    rows = v.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col("votes")[a], F.lit("unknown")).alias("x"), F.coalesce(F.col("votes")[b], F.lit("unknown")).alias("y")) for a, b in pairs])).alias("r")).select("r.*")
    both = (F.col("x") != "unknown") & (F.col("y") != "unknown")
    return rows.groupBy("a", "b").agg(F.sum((both & (F.col("x") == F.col("y"))).cast("long")).alias("agreed"), F.sum(both.cast("long")).alias("n"))


# ---- metrics and statistics

THREE = "WITH r AS (SELECT quality + 1 - toxic AS y, (doc_id % 7 > 3)::INTEGER + (doc_id % 11 > 4)::INTEGER AS p FROM labels)"


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return inputs.table(spark, sf_dir, "labels").select((F.col("quality") + 1 - F.col("toxic")).alias("y"), ((k % 7 > 3).cast("int") + (k % 11 > 4).cast("int")).alias("p"))


CLASSES = f"{THREE}, l AS (SELECT DISTINCT unnest([y, p]) AS label FROM r), c AS (SELECT label, count(*) FILTER (y = label AND p = label) AS tp, count(*) FILTER (y <> label AND p = label) AS fp, count(*) FILTER (y = label AND p <> label) AS fn, count(*) FILTER (y = label) AS support FROM r, l GROUP BY label), m AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"


@query(f"{THREE} SELECT y, p, count(*) AS n FROM r GROUP BY y, p")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(three(spark, sf_dir))


@query(f"{CLASSES} SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.by_class(three(spark, sf_dir)), "precision", "recall", "f1")


@query(f"{CLASSES}, s AS (SELECT sum(support) AS n, sum(tp) AS h, avg(f1) AS macro, sum(support * f1) / sum(support) AS weighted, sum(support::DOUBLE * (tp + fp)) / sum(support)::DOUBLE / sum(support) AS pe FROM m) SELECT n::BIGINT AS n, round(h::DOUBLE / n, 6) AS accuracy, round(macro, 6) AS f1_macro, round(weighted, 6) AS f1_weighted, round((h::DOUBLE / n - pe) / (1 - pe), 6) AS kappa FROM s")
def multiclass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.summary(three(spark, sf_dir)), "accuracy", "f1_macro", "f1_weighted", "kappa")


@query("SELECT source AS generator, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY source")
def generator_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents").select(F.col("source").alias("generator"))
    return rounded(metrics.histogram(d, "generator"), "percent")


@query(f"WITH {CTE['words']} SELECT min(len(w))::INTEGER AS least, floor(median(len(w)))::INTEGER AS middle, max(len(w))::INTEGER AS most FROM words")
def word_count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.length_stats(inputs.solutions(spark, sf_dir), F.size(tokens(F.col("solution"))))


@query(f"WITH {CTE['steps']}, u AS (SELECT unnest([id % 2, 1, 0][1:len(steps)]) AS l FROM steps) SELECT count(*) FILTER (l = 0) AS safe, count(*) FILTER (l = 1) AS unsafe FROM u")
def step_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inputs.traces(spark, sf_dir).withColumn("labels", F.slice(F.array((F.col("id") % 2).cast("int"), F.lit(1), F.lit(0)), F.lit(1), F.least(F.size(steps.by_number("trace")), F.lit(3))))
    return metrics.step_label_counts(t, "labels")


@query("SELECT doc_id % 10 AS id, round(avg(((doc_id * 37 + 11) % 1000) / 1000.0), 6) AS prob FROM documents GROUP BY 1")
def mean_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .models import mean_probability as mean

    d = inputs.table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("id"), (F.pmod(F.col("doc_id") * 37 + 11, F.lit(1000)) / 1000.0).alias("prob"))
    return rounded(mean(d, "id"), "prob")


@query(f"WITH {CTE['words']}, f AS (SELECT label, unnest([{{'f': 'has_boxed_answer', 'v': contains(t, '\\boxed')::DOUBLE}}, {{'f': 'paragraph_count', 'v': ((length(t) - length(replace(t, chr(10) || chr(10), ''))) / 2 + 1)::DOUBLE}}, {{'f': 'parenthesis_density', 'v': {over('length(t) - length(replace(t, ' + quoted('(') + ', ' + quoted('') + '))', 'length(t)')}}}]) AS r FROM words) SELECT label, r.f AS feature, round(avg((r.v <> 0)::INTEGER), 6) AS fire_rate, count(*) AS rows FROM f GROUP BY 1, 2")
def feature_fire_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["has_boxed_answer", "paragraph_count", "parenthesis_density"]
    f = features.solution_features(inputs.solutions(spark, sf_dir), keys=("label",), only=tuple(names))
    return rounded(features.fire_rates(f, names, ("label",)), "fire_rate")


@query(f"WITH {CTE['words']}, f AS (SELECT label, unnest([{{'f': 'avg_word_length', 'v': coalesce(list_avg(list_transform(w, lambda x: length(x))), 0)}}, {{'f': 'word_count_log', 'v': ln(1 + len(w))}}]) AS r FROM words), s AS (SELECT r.f AS feature, avg(r.v) FILTER (label = 0) AS m0, avg(r.v) FILTER (label = 1) AS m1, var_samp(r.v) FILTER (label = 0) AS v0, var_samp(r.v) FILTER (label = 1) AS v1, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM f GROUP BY 1) SELECT feature, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) AS cohens_d FROM s")
def feature_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["avg_word_length", "word_count_log"]
    f = features.solution_features(inputs.solutions(spark, sf_dir), keys=("label",), only=tuple(names)).withColumn("label", F.col("label").cast("string"))
    return rounded(features.cohens_d(f, names, "label", "0", "1"), "cohens_d")


@query(f"{EVIDENCE} SELECT (CASE WHEN n >= 8000 THEN 8000 WHEN n >= 3500 THEN 3500 WHEN n >= 1500 THEN 1500 ELSE 0 END)::INTEGER AS bucket, {RULE.format(o=0.08, n=3500)} AS label, count(*) AS n FROM ev GROUP BY 1, 2")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir).withColumn("label", cascade.rule())
    return metrics.buckets(e, F.col("length"), (1500, 3500, 8000), "label")


# ---- models

#: Rounds of boosting of the registered query; see README for figures on more.
ROUNDS = 10


@query()
def source_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on all solution features, five folds by label and five seeds: out-of-fold probabilities of every row."""
    from .models import Settings, out_of_fold

    path = new_folder(spark, "features")
    build = lambda: features.solution_features(inputs.solutions(spark, sf_dir), keys=("doc_id", "label")).withColumnRenamed("doc_id", "id")
    f = cached_features(build, spark, path)
    return out_of_fold(f, features.SOLUTION_FEATURES, settings=Settings(rounds=ROUNDS)).select(F.col("id").alias("doc_id"), "label", F.round("prob", 6).alias("prob"))


#: Two models of two trees as rows of a table of nodes: model, tree, node, feature, threshold, under, over, value, gain.
TREES = (
    (0, 0, 0, -1, None, -1, -1, -0.25, 0.0),
    (0, 1, 0, 0, 5.5, 1, 2, 0.0, 9.0), (0, 1, 1, -1, None, -1, -1, 0.5, 0.0), (0, 1, 2, 1, 0.55, 3, 4, 0.0, 4.0), (0, 1, 3, -1, None, -1, -1, -0.75, 0.0), (0, 1, 4, 2, 0.02, 5, 6, 0.0, 1.0), (0, 1, 5, -1, None, -1, -1, 0.125, 0.0), (0, 1, 6, -1, None, -1, -1, 1.5, 0.0),
    (1, 0, 0, -1, None, -1, -1, 0.5, 0.0),
    (1, 1, 0, 2, 0.04, 1, 2, 0.0, 2.0), (1, 1, 1, 1, 0.8, 3, 4, 0.0, 1.0), (1, 1, 2, -1, None, -1, -1, -1.0, 0.0), (1, 1, 3, -1, None, -1, -1, 0.25, 0.0), (1, 1, 4, -1, None, -1, -1, -2.0, 0.0),
)
TREE_FEATURES = ("word_count_log", "vocab_richness", "punct_ratio")


@query(
    f"WITH RECURSIVE {CTE['words']}, x AS (SELECT doc_id, [ln(1 + len(w)), {over('len(list_distinct(lw))', 'len(lw)')}, {over(matched_sql('t', '[!-/:-@[-`{-~]'), 'length(t)')}] AS x FROM words), "
    f"nodes(model, tree, node, feature, threshold, under, over_, value, gain) AS (VALUES {', '.join('(' + ', '.join('NULL::DOUBLE' if v is None else f'{v}::DOUBLE' if isinstance(v, float) else str(v) for v in row) + ')' for row in TREES)}), "
    "walk(doc_id, x, model, tree, node) AS (SELECT doc_id, x, model, tree, 0 FROM x, nodes WHERE node = 0 UNION ALL SELECT doc_id, x, w.model, w.tree, CASE WHEN x[feature + 1] <= threshold THEN under ELSE over_ END FROM walk w JOIN nodes n ON n.model = w.model AND n.tree = w.tree AND n.node = w.node WHERE feature >= 0), "
    "sums AS (SELECT doc_id, w.model, sum(value) AS s FROM walk w JOIN nodes n ON n.model = w.model AND n.tree = w.tree AND n.node = w.node WHERE feature < 0 GROUP BY ALL) "
    "SELECT doc_id, round(avg(1 / (1 + exp(-s))), 6) AS prob, CASE WHEN avg(1 / (1 + exp(-s))) > 0.45::DOUBLE THEN 'ai' ELSE 'human' END AS label FROM sums GROUP BY doc_id"
)
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of trees saved with its settings, read back, and walked by a Column for every document."""
    from .boosting import NODES
    from .models import predict, save

    path = new_folder(spark, "model")
    save(spark.createDataFrame(list(TREES), NODES), path, TREE_FEATURES, 0.45)
    f = features.solution_features(inputs.solutions(spark, sf_dir), keys=("doc_id",), only=TREE_FEATURES)
    return rounded(predict(path, f, "doc_id"), "prob")


@query(
    "WITH d AS (SELECT doc_id, (source <> 'src0')::INTEGER AS label FROM documents), p AS (SELECT *, CAST('0x' || substr(md5('1:' || doc_id), 1, 2) AS INTEGER) % 64 AS part, md5('0:' || doc_id) AS h FROM d) "
    "SELECT doc_id, label, ((row_number() OVER (PARTITION BY label, part ORDER BY h, doc_id) + part) % 5)::INTEGER AS fold FROM p"
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's fold, dealt so that every fold has its share of each label."""
    from .models import folds

    return folds(inputs.solutions(spark, sf_dir).select("doc_id", "label"), 5, "doc_id").select("doc_id", "label", "fold")


from . import round_trips  # noqa: E402, F401  registers its own
