"""Registered queries that write records derived from the tables in the formats of the readers and read them back, and
queries of what works on such caches: which calls are due, how answers are merged, how pairs of models compare."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade, features, metrics, tuning, votes
from ..sources import caches, readers, writers
from ..sources.shared import new_folder
from ..streaming import labels as streams
from . import inputs
from .inputs import SQL as CTE
from .inputs import quoted
from .queries import SWEEP, V, over, query, rounded, source_votes, sweep, three

NAMES = (" Safe", "potentially", "unsafe ", "other")
PAIRS = {"first": ("alpha", "beta"), "second": ("alpha", "gamma"), "third": ("beta", "gamma")}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents")


def pick(names, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(k, F.lit(len(names))) + 1).cast("int"))


def pick_sql(names, k: str) -> str:
    return f"[{', '.join('NULL' if n is None else quoted(n) for n in names)}][1 + ({k}) % {len(names)}]"


# ---- records


@query(f"SELECT CASE WHEN doc_id % 3 = 0 THEN '' ELSE doc_id::VARCHAR END AS id, md5(coalesce(text, '')) AS solution, CASE WHEN source = 'src0' THEN 0 ELSE 1 END::INTEGER AS label FROM documents")
def read_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of solutions; some know their identifier by one name, some by another, some by none."""
    k, path = F.col("doc_id").cast("string"), new_folder(spark, "solutions")
    d = documents(spark, sf_dir).select(F.when(F.pmod("doc_id", F.lit(3)) == 1, k).alias("id"), F.when(F.pmod("doc_id", F.lit(3)) == 2, k).alias("solution_id"), F.coalesce("text", F.lit("")).alias("solution"), F.when(F.col("source") == "src0", "human").otherwise(F.col("source")).alias("generator"))
    d.write.json(path)
    return readers.solutions(spark, path).select("id", F.md5(F.col("solution").cast("binary")).alias("solution"), "label")


@query(f"WITH t AS (SELECT doc_id, {pick_sql(NAMES, 'doc_id')} AS label FROM documents) SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 2 THEN 2 ELSE 1 END::INTEGER AS three, CASE WHEN doc_id % 4 = 0 THEN 'safe' ELSE 'unsafe' END AS two, 2::INTEGER AS steps FROM t")
def read_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of traces, with labels in all spellings, by both readers."""
    path = new_folder(spark, "traces")
    k = F.col("doc_id")
    documents(spark, sf_dir).select(k.cast("string").alias("id"), F.lit("q").alias("query"), F.col("text").alias("reasoning_trace"), pick(NAMES, k).alias("label"), F.array(F.pmod(k, F.lit(2)).cast("int"), F.lit(1)).alias("detailed_label")).write.json(path)
    two = readers.binary_traces(spark, path).select("id", F.col("label").alias("two"))
    return readers.traces(spark, path).select("id", F.col("label_int").alias("three"), F.size("detailed_label").alias("steps")).join(two, "id")


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 'safe' ELSE 'unsafe' END AS label FROM documents")
def read_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in files whose names tell the label."""
    path, k = new_folder(spark, "files"), F.col("doc_id")
    kinds = ("train_safe", "train_potentially", "unsafe_part")
    for i, name in enumerate(kinds):
        documents(spark, sf_dir).where(F.pmod(k, F.lit(3)) == i).select(k.cast("string").alias("id"), F.col("text").alias("reasoning_trace")).write.json(f"{path}/{name}.jsonl")
    return readers.traces_by_file(spark, [f"{path}/{name}.jsonl" for name in kinds]).select("id", "label")


@query("SELECT source AS generator, count(*) AS n, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY 1")
def records_by_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each generator's records in a folder of its own, read back as one table."""
    path = new_folder(spark, "generators")
    writers.by_group(documents(spark, sf_dir).select(F.col("source").alias("generator"), "text"), path, "generator")
    rows = spark.read.schema("text string, generator string").json(path)
    return rows.groupBy("generator").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"))


@query(
    "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'half' WHEN 2 THEN 'broken' ELSE 'record' END AS kind, CASE WHEN doc_id % 5 IN (1, 2) THEN NULL WHEN source = 'src0' THEN 0 ELSE 1 END::INTEGER AS label FROM documents"
)
def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of solutions of which some are no JSON, some end in the middle and some are followed by a blank line: broken ones
    are kept apart before labels are derived."""
    path, k = new_folder(spark, "broken"), F.col("doc_id")
    line = F.to_json(F.struct(k.cast("string").alias("id"), F.lit("a solution").alias("solution"), F.when(F.col("source") == "src0", "human").otherwise(F.col("source")).alias("generator")))
    half, other = F.substring(line, 1, 30), F.concat(F.lit('no object "id":"'), k.cast("string"), F.lit('"'))
    kind = F.pmod(k, F.lit(5))
    documents(spark, sf_dir).select(F.when(kind == 1, half).when(kind == 2, other).when(kind == 3, F.concat(line, F.lit("\n  \n"))).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.quarantined(readers.labelled_solutions(readers.jsonl(spark, path, readers.SOLUTIONS, readers.APART)))
    known = good.select(F.col("id").cast("long").alias("doc_id"), F.lit("record").alias("kind"), "label")
    number = F.regexp_extract(readers.BROKEN, '"id":"([0-9]+)', 1).cast("long")
    return known.union(bad.select(number, F.when(F.startswith(readers.BROKEN, F.lit("{")), "half").otherwise("broken"), F.lit(None).cast("int")))


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents) SELECT doc_id, position FROM p WHERE position >= 2 * n // 5")
def resume_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several files, of which the first two fifths have their replies in a positional cache: what a rerun has to do."""
    path, done = new_folder(spark, "records"), new_folder(spark, "replies")
    documents(spark, sf_dir).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("solution")).write.json(path)
    records = readers.positioned(readers.jsonl(spark, path, readers.SOLUTIONS))
    n = records.count()
    writers.append_cache(records.where(F.col("position") < 2 * n // 5).select(F.col("position").cast("int").alias("idx"), F.lit(1).alias("trace_pred")), done)
    return votes.unanswered(records, readers.replies(spark, done)).select(F.col("id").cast("long").alias("doc_id"), "position")


# ---- caches


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 'third' WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END AS label FROM documents")
def cache_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache after three appends of which the first has the largest files and the second the smallest: last lines stand."""
    path, k = new_folder(spark, "cache"), F.col("doc_id")
    d = documents(spark, sf_dir)
    for label, rows, pad in (("first", d, 300), ("second", d.where(F.pmod(k, F.lit(2)) == 0), 0), ("third", d.where(F.pmod(k, F.lit(3)) == 0), 100)):
        votes_ = F.map_from_arrays(F.array(F.lit("a"), F.lit("pad")), F.array(F.lit(label), F.lit("x" * pad)))
        writers.append_cache(rows.select(k.cast("string").alias("id"), votes_.alias("model_labels")), path)
    return readers.vote_cache(spark, path).select("id", F.col("votes")["a"].alias("label"))


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 = 0 THEN 'fourth' WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'third' ELSE '-' END AS b, CASE WHEN doc_id % 5 = 0 THEN 'fourth' WHEN doc_id % 3 = 0 THEN 'third' ELSE '-' END AS c FROM documents")
def cache_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed cache after three appends, its compaction, and an append after that: each model's last label stands."""
    path, k = new_folder(spark, "buckets"), F.col("doc_id")
    d = documents(spark, sf_dir)

    def add(label: str, every: int, *models: str) -> None:
        own = F.map_from_arrays(F.array(*[F.lit(m) for m in models]), F.array(*[F.lit(label) for _ in models]))
        caches.append(d.where(F.pmod(k, F.lit(every)) == 0).select(k.cast("string").alias("id"), own.alias("model_labels")), path, 16)

    add("first", 1, "a")
    add("second", 2, "a")
    add("third", 3, "b", "c")
    caches.compact(spark, path)
    add("fourth", 5, "a", "c")
    return caches.read(spark, path).select("id", *[F.coalesce(F.col("votes")[m], F.lit("-")).alias(m) for m in ("a", "b", "c")])


class Stopped(Exception):
    """Raised in the middle of a run, as a cluster would end it."""


@query(f"WITH {CTE['traces']}, p AS (SELECT id, ((id * 37 + 11) % 1000)::DOUBLE / 1000 AS prob FROM traces) SELECT id::VARCHAR AS id, CASE WHEN prob < 0.36::DOUBLE THEN 'safe' ELSE 'unsafe' END AS label FROM p")
def resumed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces as a stream of files, labelled batch by batch into a cache; the run is stopped after its second batch is written
    and before it is committed, and started again."""
    source, cache, checkpoint = (new_folder(spark, name) for name in ("stream", "labels", "progress"))
    inputs.traces(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "query", F.col("trace").alias("reasoning_trace")).repartition(4, "id").write.json(source)
    label = lambda rows: rows.select("id", cascade.by_probability(F.pmod(F.col("id").cast("long") * 37 + 11, F.lit(1000)) / 1000.0).alias("label"))
    stream = lambda: spark.readStream.schema(readers.TRACES).option("maxFilesPerTrigger", 1).json(source)

    def stop(number: int) -> None:
        if number == 1:
            raise Stopped

    first = streams.resumed(stream(), cache, checkpoint, label, stop)
    try:
        first.awaitTermination()
    except StreamingQueryException:
        pass
    streams.resumed(stream(), cache, checkpoint, label).awaitTermination()
    return streams.labelled(spark, cache, "id string, label string").select("id", "label")


@query(f"WITH r AS (SELECT doc_id, {pick_sql(('Human', None, None, '?'), 'doc_id')} AS label, {pick_sql(('x', 'llm', '?', 'human'), 'doc_id')} AS vote FROM documents) SELECT doc_id::VARCHAR AS id, CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'ai' ELSE 'unknown' END AS label FROM r WHERE doc_id % 4 <> 2")
def legacy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, k = new_folder(spark, "legacy"), F.col("doc_id")
    lines = documents(spark, sf_dir).select(k.cast("string").alias("id"), pick(("Human", None, None, "?"), k).alias("label"), F.create_map(F.lit("m"), pick(("x", "llm", "?", "human"), k)).alias("model_labels"))
    writers.append_cache(lines, path)
    return readers.legacy_cache(spark, path)


@query("SELECT doc_id FROM documents WHERE doc_id % 5 > 1")
def resume_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions without a reply in the positional cache are what a rerun has still to do."""
    path, d = new_folder(spark, "replies"), documents(spark, sf_dir).select("doc_id")
    done = d.where(F.pmod("doc_id", F.lit(5)) <= 1).select(F.col("doc_id").cast("int").alias("idx"), F.lit(1).alias("trace_pred"), F.array(F.lit(0), F.lit(1)).alias("step_labels"))
    writers.append_cache(done, path)
    return votes.uncached(d, readers.replies(spark, path).select(F.col("idx").cast("long").alias("doc_id")), "doc_id")


@query(f"{V} SELECT doc_id, coalesce(alpha, '-') AS alpha, coalesce(beta, '-') AS beta FROM votes WHERE alpha IS NOT NULL OR beta IS NOT NULL")
def result_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of model calls kept as a table and read back."""
    path = new_folder(spark, "results")
    v = inputs.votes(spark, sf_dir).select("doc_id", *[F.col("votes")[m].alias(m) for m in ("alpha", "beta")])
    v.where("alpha is not null or beta is not null").write.parquet(path)
    return readers.api_results(spark, path).select("doc_id", *[F.coalesce(m, F.lit("-")).alias(m) for m in ("alpha", "beta")])


@query(f"WITH {CTE['words']} SELECT doc_id, round(ln(1 + len(w)), 6) AS word_count_log, round({over('len(list_distinct(lw))', 'len(lw)')}, 6) AS vocab_richness FROM words")
def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features computed once: the second reading finds the table and computes nothing."""
    path, names = new_folder(spark, "features"), ("word_count_log", "vocab_richness")
    build = lambda: features.solution_features(inputs.solutions(spark, sf_dir), keys=("doc_id",), only=names)
    writers.cached_features(build, spark, path)
    return rounded(writers.cached_features(lambda: build().limit(0), spark, path), *names)


# ---- outputs


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'a, \"quoted\" label' ELSE 'plain' END AS label FROM documents")
def submission_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission with labels that need quotes, written and read back."""
    path, k = new_folder(spark, "submission"), F.col("doc_id")
    rows = documents(spark, sf_dir).select(k.cast("string").alias("id"), F.when(F.pmod(k, F.lit(2)) == 0, 'a, "quoted" label').otherwise("plain").alias("label"), F.lit("1.0|0.5").alias("detailed_label"))
    writers.submission(rows, path, detailed=True)
    return readers.labels_csv(spark, path)


@query(f"{SWEEP} SELECT threshold_1000, round(f1_macro, 6) AS f1_macro FROM s")
def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "ranked")
    writers.ranked_summary(rounded(sweep(spark, sf_dir).select("threshold_1000", "f1_macro"), "f1_macro"), path)
    return spark.read.schema("threshold_1000 int, f1_macro double").json(path)


@query(f"{SWEEP}, best AS (SELECT threshold_1000 FROM s ORDER BY s.f1_macro DESC, threshold_1000 LIMIT 1) SELECT threshold_1000 AS threshold, count(*) FILTER (prob > threshold_1000 / 1000.0::DOUBLE) AS above FROM p0, best GROUP BY 1")
def saved_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold kept as settings, and the rows above it once it is read back."""
    path = new_folder(spark, "settings")
    writers.settings(spark, path, threshold=tuning.best_threshold(sweep(spark, sf_dir)).first()["threshold_1000"])
    own = readers.first_existing(spark, [f"{path}-none", path])
    t = writers.read_settings(spark, own)["threshold"]
    prob = F.pmod(F.col("doc_id") * 37 + 11, F.lit(1000)) / 1000.0
    return inputs.table(spark, sf_dir, "labels").agg(F.lit(t).alias("threshold"), F.sum((prob > t / 1000).cast("long")).alias("above"))


# ---- calls, answers, pairs of models


@query(f"{V} SELECT doc_id, alpha AS label FROM votes WHERE doc_id % 3 = 0 AND alpha IS NOT NULL")
def cached_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = inputs.votes(spark, sf_dir)
    cache = v.where(F.pmod("doc_id", F.lit(3)) == 0).select("doc_id", F.col("votes")["alpha"].alias("label")).where("label is not null")
    return votes.with_cached(v.select("doc_id"), cache, "doc_id").select("doc_id", "label")


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def record_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = inputs.table(spark, sf_dir, "labels").where("toxic = 1")
    return votes.lookup(documents(spark, sf_dir), toxic, "doc_id").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text"))


@query(f"{V} SELECT doc_id, unnest(list_filter(['alpha', 'beta'], lambda m: doc_id % 3 <> 0 OR CASE m WHEN 'alpha' THEN alpha ELSE beta END IS NULL)) AS model FROM votes")
def calls_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that a run has still to make; one of its models has no caller."""
    v = inputs.votes(spark, sf_dir)
    return votes.calls(v.select("doc_id"), v.where(F.pmod("doc_id", F.lit(3)) == 0).select("doc_id", "votes"), ["alpha", "beta", "gamma"], {"alpha": None, "beta": None}, "doc_id")


@query(f"{V}, n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN alpha END AS alpha, CASE WHEN doc_id % 2 = 0 THEN 'unsafe' WHEN doc_id % 3 = 0 THEN beta END AS beta, CASE WHEN doc_id % 3 = 0 THEN gamma END AS gamma FROM votes), c AS (SELECT doc_id, len(list_filter([alpha, beta, gamma], lambda x: x = 'unsafe')) AS u, len(list_filter([alpha, beta, gamma], lambda x: x = 'safe')) AS s FROM n) SELECT doc_id, CASE WHEN u + s = 0 THEN 'safe' WHEN u >= s THEN 'unsafe' ELSE 'safe' END AS label FROM c")
def answered_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached votes of every third record, answers of one model for every second, and the majority of both."""
    v = inputs.votes(spark, sf_dir)
    new = v.where(F.pmod("doc_id", F.lit(2)) == 0).select("doc_id", F.lit("beta").alias("model"), F.lit("unsafe").alias("label"))
    return votes.answered(v.select("doc_id"), v.where(F.pmod("doc_id", F.lit(3)) == 0).select("doc_id", "votes"), new, "doc_id").select("doc_id", "label")


@query(f"{V}, a AS (SELECT count(alpha) AS alpha, count(beta) AS beta, count(gamma) AS gamma, count(*) AS n FROM votes) SELECT unnest(list_filter(['alpha', 'beta', 'delta', 'gamma'], lambda m: CASE m WHEN 'alpha' THEN alpha WHEN 'beta' THEN beta WHEN 'gamma' THEN gamma ELSE 0 END < n)) AS model FROM a")
def models_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = inputs.votes(spark, sf_dir)
    caches = {m: v.where(F.col("votes")[m].isNotNull()).select("doc_id") for m in inputs.MODELS}
    names = votes.needed_models({**PAIRS, "fourth": ("alpha", "delta")}, v.select("doc_id"), caches, "doc_id")
    return spark.createDataFrame([(m,) for m in names], "model string")


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = source_votes(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    k = F.col("doc_id")
    return v.select("doc_id", F.map_from_arrays(F.array(*[F.lit(m) for m in inputs.MODELS]), F.array(*inputs.MODELS)).alias("votes"), F.when(F.pmod(k, F.lit(11)) == 0, "ai").otherwise("human").alias("tie"), (F.col("source") != "src0").cast("int").alias("y"), F.when(F.pmod(k, F.lit(3)) == 0, "human").when(F.pmod(k, F.lit(3)) == 1, "ai").alias("ref"))


def pair_sql() -> str:
    from .queries import SOURCE_SQL

    pairs = ", ".join(f"{{'pair': '{n}', 'a': {a}, 'b': {b}}}" for n, (a, b) in PAIRS.items())
    p = "CASE WHEN a = 'unknown' AND b = 'unknown' THEN tie WHEN a = 'unknown' THEN b WHEN b = 'unknown' THEN a WHEN a = b THEN a ELSE tie END"
    return (
        f"{SOURCE_SQL}, v AS (SELECT doc_id, unnest([{pairs}]) AS x, CASE WHEN doc_id % 11 = 0 THEN 'ai' ELSE 'human' END AS tie, (source <> 'src0')::INTEGER AS y, CASE doc_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'ai' END AS ref FROM l JOIN documents USING (doc_id)), "
        f"q AS (SELECT x.pair AS pair, x.a AS a, x.b AS b, tie, y, ref FROM v), s AS (SELECT *, {p} AS p FROM q), "
        "c AS (SELECT pair, count(*) AS n, count(*) FILTER (a = b AND a <> 'unknown') AS agreed, count(*) FILTER (a <> 'unknown' AND b <> 'unknown') AS known, count(*) FILTER (p = ref) AS like_reference, count(*) FILTER (y = 1 AND p = 'ai') AS tp, count(*) FILTER (y = 0 AND p = 'ai') AS fp, count(*) FILTER (y = 1 AND p <> 'ai') AS fn, count(*) FILTER (y = 0 AND p <> 'ai') AS tn FROM s GROUP BY pair), "
        "f AS (SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0 FROM c) "
        "SELECT pair, n, agreed, known, like_reference, round(f1, 6) AS f1_true, round(f0, 6) AS f1_false, round((f1 + f0) / 2, 6) AS f1_macro, round((tp + tn)::DOUBLE / n, 6) AS accuracy FROM f"
    )


@query(pair_sql())
def pair_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(votes.evaluate_pairs(pair_rows(spark, sf_dir), PAIRS, truth="y", reference="ref"), "f1_true", "f1_false", "f1_macro", "accuracy")


@query("SELECT count(*) AS n, count(*) FILTER (doc_id % 4 <> 3 AND doc_id % 2 = (doc_id // 2) % 2) AS agreed, round(count(*) FILTER (doc_id % 4 <> 3 AND doc_id % 2 = (doc_id // 2) % 2)::DOUBLE / count(*), 6) AS rate FROM documents")
def reference_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against a submission that lacks a quarter of the rows."""
    d, k = documents(spark, sf_dir), F.col("doc_id")
    own = d.select(k.alias("id"), F.pmod(k, F.lit(2)).alias("label"))
    other = d.where(F.pmod(k, F.lit(4)) != 3).select(k.alias("id"), F.pmod(F.floor(k / 2), F.lit(2)).alias("label"))
    return rounded(votes.submission_agreement(own, other), "rate")


REPORT = "coalesce({0}::DOUBLE / nullif({1}, 0), 0)"


@query(
    "WITH r AS (SELECT 'trace' AS level, (quality + 1 - toxic)::VARCHAR AS y, ((doc_id % 7 > 3)::INTEGER + (doc_id % 11 > 4)::INTEGER)::VARCHAR AS p FROM labels UNION ALL SELECT 'step', toxic::VARCHAR, ((doc_id % 3) = 0)::INTEGER::VARCHAR FROM labels), l AS (SELECT DISTINCT level, unnest([y, p]) AS label FROM r), "
    "c AS (SELECT level, label, count(*) FILTER (y = label AND p = label) AS tp, count(*) FILTER (y <> label AND p = label) AS fp, count(*) FILTER (y = label AND p <> label) AS fn, count(*) FILTER (y = label) AS support FROM r JOIN l USING (level) GROUP BY ALL), "
    f"m AS (SELECT *, {REPORT.format('tp', 'tp + fp')} AS precision, {REPORT.format('tp', 'tp + fn')} AS recall, {REPORT.format('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c), "
    "a AS (SELECT * FROM m UNION ALL SELECT level, 'all', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(support)::BIGINT, avg(precision), avg(recall), avg(f1) FROM m GROUP BY level) "
    "SELECT level, label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM a"
)
def safety_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with three classes and steps with two, in one table."""
    steps = inputs.table(spark, sf_dir, "labels").select(F.col("toxic").alias("y"), (F.pmod("doc_id", F.lit(3)) == 0).cast("int").alias("p"))
    return rounded(metrics.safety_report(three(spark, sf_dir), steps), "precision", "recall", "f1")
