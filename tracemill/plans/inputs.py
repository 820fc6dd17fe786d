"""Logical inputs over the tables: solutions, traces, gold labels and votes, in Spark and as SQL.

The tables' prose is invented and holds no phrase that the rules look for, so texts get a phrase appended by their key
(the first two inputs below). This is synthetic, the same in both engines, and makes every rule meet both outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PHRASES = (
    " I cannot help with that. This request is harmful.",
    "\n\nStep 1: First, open the box. Step 2: We add salt. Step 3: Thus we are done.",
    " Therefore we stop. We rest. \\boxed{42}",
    "\n\n**Bold note** (see 12). Warning, dangerous and toxic weapon.",
    " ```def f import os``` hack malware",
    "\n1. one\n2. two\n 3. three",
    " Thus $x^2_1$ {a} therefore",
    " disclaimer and please note safe legal ethical",
    " we hack the password and steal credentials of the bank",
    " according to NIST researchers at the university; to understand; gonna reckon which that because",
    "",
    "\n\n\n",
)
MODELS = ("alpha", "beta", "gamma")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrase(key: Column) -> Column:
    out = F.lit("")
    for i, p in enumerate(PHRASES):
        out = F.when(F.pmod(key, F.lit(len(PHRASES))) == i, F.lit(p)).otherwise(out)
    return out


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, solution, generator (human for the first source), label (0 human, 1 not)."""
    d = table(spark, sf_dir, "documents")
    human = F.col("source") == "src0"
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), phrase(F.col("doc_id"))).alias("solution"), F.when(human, "human").otherwise(F.col("source")).alias("generator"), F.when(human, 0).otherwise(1).alias("label"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, query, trace: assistant turns that follow a user's; every third query is its trace's start."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = c.select("conv_id", "turn", "role", "text", F.lag("role").over(w).alias("before"), F.lag("text").over(w).alias("asked"))
    pairs = turns.where("role = 'assistant' and before = 'user'")
    key = F.col("conv_id") + F.col("turn")
    trace = F.concat(F.coalesce("text", F.lit("")), phrase(key))
    return pairs.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.when(F.pmod(key, F.lit(3)) == 0, F.substring(trace, 1, 300)).otherwise(F.coalesce("asked", F.lit(""))).alias("query"), trace.alias("trace"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled solutions as queries and traces: doc_id, query, trace, y (true if unsafe)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("y"))
    s = solutions(spark, sf_dir).select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.substring("solution", 1, 300)).otherwise(F.substring("solution", -200, 200)).alias("query"), F.col("solution").alias("trace"))
    return s.join(labels, "doc_id")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, replies of three made-up models (null: no reply) and votes, their known or unknown labels by model."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id")
    reply = lambda m, names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.floor(k / m), F.lit(len(names))) + 1).cast("int"))
    d = d.select("doc_id", reply(1, ("safe", "Unsafe.", "hm", None)).alias("alpha"), reply(3, ("unsafe", "It is safe", "?", "safe ", None)).alias("beta"), reply(7, ("SAFE", "unsafe", "unsafe", "no idea")).alias("gamma"))
    from ..operators.votes import safety_label

    pairs = F.filter(F.array(*[F.struct(F.lit(m).alias("key"), F.when(F.col(m).isNotNull(), safety_label(F.col(m))).alias("value")) for m in MODELS]), lambda e: e["value"].isNotNull())
    return d.withColumn("votes", F.map_from_entries(pairs))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _phrase_sql(key: str) -> str:
    return f"CASE {key} % {len(PHRASES)} " + " ".join(f"WHEN {i} THEN {quoted(p)}" for i, p in enumerate(PHRASES)) + " END"


WS = r"[ \t\n\x0B\f\r]"


def tokens_sql(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WS}+'), lambda x: x <> '')"


def strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


#: Common table expressions of the inputs.
SQL = {
    "solutions": f"solutions AS (SELECT doc_id, coalesce(text, '') || {_phrase_sql('doc_id')} AS solution, CASE WHEN source = 'src0' THEN 'human' ELSE source END AS generator, CASE WHEN source = 'src0' THEN 0 ELSE 1 END AS label FROM documents)",
    "traces": f"turns AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pairs AS (SELECT conv_id * 100000 + turn AS id, conv_id + turn AS k, coalesce(asked, '') AS asked, coalesce(text, '') || {_phrase_sql('(conv_id + turn)')} AS trace FROM turns WHERE role = 'assistant' AND before = 'user'), traces AS (SELECT id, CASE WHEN k % 3 = 0 THEN substring(trace, 1, 300) ELSE asked END AS query, trace FROM pairs)",
    "votes": "replies AS (SELECT doc_id, ['safe', 'Unsafe.', 'hm', NULL][1 + doc_id % 4] AS alpha, ['unsafe', 'It is safe', '?', 'safe ', NULL][1 + (doc_id // 3) % 5] AS beta, ['SAFE', 'unsafe', 'unsafe', 'no idea'][1 + (doc_id // 7) % 4] AS gamma FROM documents), votes AS (SELECT doc_id, " + ", ".join(f"CASE WHEN {m} IS NULL THEN NULL WHEN contains(lower({m}), 'unsafe') THEN 'unsafe' WHEN contains(lower({m}), 'safe') THEN 'safe' ELSE 'unknown' END AS {m}" for m in MODELS) + " FROM replies)",
}
SQL["gold"] = SQL["solutions"] + ", gold AS (SELECT s.doc_id, CASE WHEN s.doc_id % 3 = 0 THEN substring(solution, 1, 300) ELSE right(solution, 200) END AS query, solution AS trace, toxic = 1 AS y FROM solutions s JOIN labels USING (doc_id))"
SQL["words"] = SQL["solutions"] + f", words AS (SELECT doc_id, generator, label, solution AS t, {tokens_sql('solution')} AS w, {tokens_sql('lower(solution)')} AS lw, regexp_split_to_array({strip_sql('solution')}, '[.!?]+') AS parts FROM solutions)"
SQL["steps"] = SQL["traces"] + f", steps AS (SELECT id, query, trace, list_filter(list_transform(regexp_split_to_array(trace, 'Step [0-9]+:{WS}*'), lambda s: {strip_sql('s')}), lambda s: s <> '') AS steps FROM traces)"
