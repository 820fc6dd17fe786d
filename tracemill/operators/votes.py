"""Labels of several models for a record: parsing replies, votes, agreement and the merge of cached labels."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, strip, tokens

UNKNOWN = "unknown"


def source_label(reply: Column) -> Column:
    """human, ai or unknown, by substrings in this order."""
    low = F.lower(strip(clean(reply)))
    ai = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ("ai", "llm", "machine", "artificial")])
    return F.when(F.contains(low, F.lit("human")), "human").when(ai, "ai").otherwise(UNKNOWN)


def safety_label(reply: Column) -> Column:
    low = F.lower(strip(clean(reply)))
    return F.when(F.contains(low, F.lit("unsafe")), "unsafe").when(F.contains(low, F.lit("safe")), "safe").otherwise(UNKNOWN)


def ternary_label(reply: Column) -> Column:
    """(code, name) of a reply with three possible labels; a missing one is (0, error)."""
    low = F.lower(strip(clean(reply)))
    first = F.coalesce(F.get(tokens(low), 0), F.lit(""))
    pair = lambda code, name: F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"))
    has = lambda text, w: F.contains(text, F.lit(w))
    partly, unsafe, safe = pair(1, "potentially_unsafe"), pair(2, "unsafe"), pair(0, "safe")
    return (
        F.when(reply.isNull(), pair(0, "error"))
        .when(has(low, "potentially_unsafe") | has(low, "potentially unsafe"), partly)
        .when(has(low, "unsafe") & ~has(low, "potentially"), unsafe)
        .when(has(low, "safe") & ~has(low, "unsafe"), safe)
        .when(has(first, "potentially"), partly)
        .when(has(first, "unsafe"), unsafe)
        .when(has(first, "safe"), safe)
        .otherwise(pair(0, UNKNOWN))
    )


def step_reply(reply: Column) -> Column:
    """1 if a 1 is among the first five characters."""
    return F.contains(F.substring(strip(clean(reply)), 1, 5), F.lit("1")).cast("int")


def one_hot(code: Column, n: int = 3, own: float = 0.9, other: float = 0.05) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == code, own).otherwise(other))


def reply_text(body: Column) -> Column:
    """The reply in a model's JSON response, in either of two shapes; one blocked for safety is unsafe."""
    chat, parts = F.get_json_object(body, "$.choices[0].message.content"), F.get_json_object(body, "$.candidates[0].content.parts[0].text")
    blocked = F.get_json_object(body, "$.candidates[0].finishReason") == "SAFETY"
    return F.coalesce(F.lower(strip(chat)), F.lower(strip(parts)), F.when(blocked, "unsafe"))


def known(votes: Column) -> Column:
    return F.filter(F.map_values(votes), lambda v: v != UNKNOWN)


def majority(votes: Column, first: str, second: str, empty: str) -> Column:
    """The label of most known votes; first wins a tie, empty stands for none."""
    labels = known(votes)
    ones, others = F.size(F.filter(labels, lambda v: v == first)), F.size(F.filter(labels, lambda v: v == second))
    return F.when(F.size(labels) == 0, empty).when(ones >= others, first).otherwise(second)


def safety_vote(votes: Column) -> Column:
    return majority(votes, "unsafe", "safe", "safe")


def source_vote(votes: Column) -> Column:
    return majority(votes, "ai", "human", "ai")


def agreement(a: Column, b: Column, tie: Column, default: str = "ai") -> Column:
    """Both unknown: the tie-break; one unknown: the other; equal: it; else the tie-break."""
    a, b, t = F.coalesce(a, F.lit(UNKNOWN)), F.coalesce(b, F.lit(UNKNOWN)), F.coalesce(tie, F.lit(default))
    return F.when((a == UNKNOWN) & (b == UNKNOWN), t).when(a == UNKNOWN, b).when(b == UNKNOWN, a).when(a == b, a).otherwise(t)


def agree_else_tiebreak(records: DataFrame, a: DataFrame, b: DataFrame, tie: DataFrame, key: str = "id") -> DataFrame:
    """records with label, from tables (key, label) of two models and of the tie-break; Spark sizes the joins."""
    out = records
    for name, side in (("a", a), ("b", b), ("t", tie)):
        out = out.join(side.select(key, F.col("label").alias(f"__{name}")), key, "left")
    return out.withColumn("label", agreement(F.col("__a"), F.col("__b"), F.col("__t"))).drop("__a", "__b", "__t")


def latest(cache: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last line of each key."""
    return cache.groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c != key]), order).alias("r")).select(key, "r.*")


def merge_votes(old: DataFrame, new: DataFrame, key: str = "id", votes: str = "votes") -> DataFrame:
    """Maps of both by key; where both know a model, the new label stands. Needs no session setting."""
    side = lambda d, n: d.select(F.col(key), F.col(votes).alias(n))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    o, n = (F.coalesce(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for c in ("o", "n"))
    return both.select(key, F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n).alias(votes))


def to_classify(records: DataFrame, cache: DataFrame, models: list[str], key: str = "id", votes: str = "votes") -> DataFrame:
    """Records that lack a label of one of the models."""
    missing = reduce(lambda a, b: a | b, [~F.map_contains_key(F.col("__v"), F.lit(m)) for m in models])
    return records.join(cache.select(key, F.col(votes).alias("__v")), key, "left").where(F.col("__v").isNull() | missing).drop("__v")


def uncached(records: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    return records.join(cache.select(key).distinct(), key, "left_anti")


def unanswered(records: DataFrame, replies: DataFrame, position: str = "position") -> DataFrame:
    """Records that a run has still to do: replies come in the records' order, so the first as many as there are replies are done."""
    done = replies.agg(F.count("*").alias("__done"))
    return records.join(F.broadcast(done), F.col(position) >= F.col("__done")).drop("__done")  # one row


def with_cached(records: DataFrame, cache: DataFrame, key: str = "id", position: str = "position") -> DataFrame:
    """Records with what the cache holds of them, in the records' order (position); those that it lacks are left out."""
    return records.withColumn(position, F.monotonically_increasing_id()).join(cache, key).orderBy(position)


def lookup(records: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The records of the keys, each as often as it occurs; keys that no record has are left out."""
    return records.join(keys.select(key).distinct(), key, "left_semi")


def usable(models: list[str], callers: Iterable[str]) -> tuple[list[str], list[str]]:
    """The models that can be called, in their order, and those that cannot."""
    known = set(callers)
    return [m for m in models if m in known], [m for m in models if m not in known]


def needed_models(pairs: dict[str, tuple[str, str]], records: DataFrame, caches: dict[str, DataFrame], key: str = "id") -> list[str]:
    """Models of the pairs whose cache does not hold a line of each record; a model of several pairs is named once."""
    n = records.count()
    return sorted(m for m in {m for pair in pairs.values() for m in pair} if m not in caches or caches[m].select(key).distinct().count() < n)


def calls(records: DataFrame, cache: DataFrame, models: list[str], callers: Iterable[str], key: str = "id", votes: str = "votes") -> DataFrame:
    """A row (key, model) for each call that is still to be made: of every usable model, for every record without its label."""
    can, _ = usable(models, callers)
    known = records.select(key).join(cache.select(key, F.col(votes).alias("__v")), key, "left")
    due = F.filter(F.array(*[F.lit(m) for m in can]).cast("array<string>"), lambda m: F.col("__v").isNull() | ~F.map_contains_key("__v", m))
    return known.select(key, F.explode(due).alias("model"))


def answered(records: DataFrame, cache: DataFrame, answers: DataFrame, key: str = "id", votes: str = "votes") -> DataFrame:
    """Records with the votes of the cache and of new answers (key, model, label), and the label of their majority."""
    once = answers.groupBy(key, "model").agg(F.max("label").alias("label"))
    new = once.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("model", "label"))).alias(votes))  # an entry a model
    merged = merge_votes(cache.select(key, votes), new, key, votes)
    return records.join(merged, key, "left").withColumn("label", safety_vote(F.coalesce(votes, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))


def pair_predictions(df: DataFrame, pairs: dict[str, tuple[str, str]], votes: str = "votes", tie: str = "tie") -> DataFrame:
    """Each row once for every pair of models: pair, a and b (labels, unknown if missing) and p, their agreement or the tie-break."""
    vote = lambda m: F.coalesce(F.col(votes)[m], F.lit(UNKNOWN))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("pair"), vote(a).alias("a"), vote(b).alias("b")) for name, (a, b) in pairs.items()]))
    return df.withColumn("__p", each).select(*df.columns, "__p.*").withColumn("p", agreement(F.col("a"), F.col("b"), F.col(tie)))


def evaluate_pairs(df: DataFrame, pairs: dict[str, tuple[str, str]], truth: str | None = None, reference: str | None = None, votes: str = "votes", tie: str = "tie") -> DataFrame:
    """A row for each pair. With truth (1 for ai): F1 of both classes, their mean and accuracy. With reference (labels of a
    submission, null where it has none): rows that agree with it. Always: rows, those that the two models agree on, and
    those that both know. Rows meet sums, never a table of predictions."""
    rows = pair_predictions(df, pairs, votes, tie)
    both = (F.col("a") != UNKNOWN) & (F.col("b") != UNKNOWN)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = [F.count("*").alias("n"), count((F.col("a") == F.col("b")) & (F.col("a") != UNKNOWN)).alias("agreed"), count(both).alias("known")]
    if reference:
        sums.append(count(F.col("p").eqNullSafe(F.col(reference))).alias("like_reference"))
    out = rows.groupBy("pair").agg(*sums)
    if truth:
        from .metrics import binary_f1

        scores = binary_f1(rows, F.col(truth) == 1, F.col("p") == "ai", ("pair",))
        out = out.join(scores.select("pair", "f1_true", "f1_false", "f1_macro", "accuracy"), "pair")
    return out


def submission_agreement(predictions: DataFrame, submission: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Rows of predictions, those whose label a reference submission has too, and their share."""
    both = predictions.select(key, F.col(label).alias("p")).join(submission.select(key, F.col(label).alias("r")), key, "left")
    sums = both.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("p") == F.col("r")).cast("long")), F.lit(0)).alias("agreed"))
    return sums.withColumn("rate", F.when(F.col("n") > 0, F.col("agreed") / F.col("n")).otherwise(0.0))


def model_histogram(df: DataFrame, models: list[str], votes: str = "votes") -> DataFrame:
    """How often each model gave each label; a missing vote is unknown."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.coalesce(F.col(votes)[m], F.lit(UNKNOWN)).alias("label")) for m in models])).alias("r"))
    return rows.groupBy("r.model", "r.label").agg(F.count("*").alias("n"))


def agreement_rate(df: DataFrame, votes: str = "votes") -> DataFrame:
    """Rows whose known votes hold one label at most, all rows, and the share."""
    same = (F.size(F.array_distinct(known(F.col(votes)))) <= 1).cast("long")
    return df.agg(F.coalesce(F.sum(same), F.lit(0)).alias("agreed"), F.count("*").alias("n")).withColumn("rate", F.when(F.col("n") > 0, F.col("agreed") / F.col("n")).otherwise(0.0))


def legacy_label(label: Column, votes: Column) -> Column:
    """A cached record's own label, or the first of its votes that is known."""
    return F.coalesce(F.when(label.isNotNull(), source_label(label)), F.get(F.filter(F.transform(F.map_values(votes), source_label), lambda v: v != UNKNOWN), 0))


def prompt(query: Column, trace: Column, query_chars: int = 500, trace_chars: int = 2000) -> Column:
    return F.concat(F.lit("QUERY: "), F.substring(clean(query), 1, query_chars), F.lit("\n\nREASONING TRACE:\n"), F.substring(clean(trace), 1, trace_chars))


def cost(df: DataFrame, response: str, per_1k_in: float, per_1k_out: float) -> DataFrame:
    """Rough price of the calls: four tokens a character of the responses, 50 tokens out a call."""
    sent = F.coalesce(F.sum(F.length(clean(response))), F.lit(0)) * 4
    return df.agg((sent * per_1k_in / 1000 + F.count("*") * 50 * per_1k_out / 1000).alias("cost"))

