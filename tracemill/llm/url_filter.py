"""URL filters: rules first, then a path-template tree, with DataFrame functions alone.

The tree: a path is split at "/"; digits in a segment become "#". From the root down, level by level, the children of a
host's generalised prefix are named. A child has evidence if enough labelled pages lie below it, on its host or, under the
same generalised prefix, on all hosts together. Children with evidence are summed by their share of bad pages in CELLS
cells, and the cells, from the lowest share on, join the running branch while their share differs by a two-proportion test
neither from that of all that the branch has pooled nor from that of its lowest cell; so similarity is not handed on along
a chain of neighbours, and the least and the most of a branch are alike. Among children without evidence, a
position is variable, and a wildcard "*", if its segments are many and hardly repeat; else those of one structure (the
same least and largest depth below) are one branch "*". A template is the path of branches, so its counts are those of
all that was merged into it, and it is rejected by its smoothed labelled purity: (bad + m * prior) / (n + m), where the
prior is the same template's share over all hosts, itself smoothed by the overall share. Labels are the rules' own
verdicts and any labels given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, quoted, stage_table

#: Fixed rules of the digest query, as (verdict, host/path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Segments beyond this depth are one wildcard "**", unless another depth, or none, is asked for.
DEPTH = 12
#: Square of the test's critical value (5 % of branches that do not differ stay apart), the fewest kinds of a variable position, cells of the share.
CRITICAL, LEAST, CELLS = 3.8416, 8, 64


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (nulls without one). Rules are a short list, given by the caller."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def similar(b1: Column, g1: Column, b2: Column, g2: Column) -> Column:
    """Whether two shares of bad pages do not differ."""
    n1, n2 = b1 + g1, b2 + g2
    p, d = (b1 + b2) / (n1 + n2), b1 / n1 - b2 / n2
    return d * d <= CRITICAL * p * (1 - p) * (1 / n1 + 1 / n2)


def branches(cells: Column) -> Column:
    """The number of the branch of each cell, from cells (cell, b, g) of one parent in order; CELLS + 1 at most."""
    kind = "array<struct<cell:int,branch:int>>"
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("b", "g", "b1", "g1")], F.lit(0).alias("branch"), F.array().cast(kind).alias("out"))

    def joined(now: Column, x: Column) -> Column:
        same = (now.branch > 0) & similar(now.b, now.g, x.b, x.g) & similar(now.b1, now.g1, x.b, x.g)
        branch = F.when(same, now.branch).otherwise(now.branch + 1)
        out = F.concat(now.out, F.array(F.struct(x.cell.alias("cell"), branch.alias("branch"))))
        pick = lambda old, new: F.when(same, old).otherwise(new)
        return F.struct(pick(now.b + x.b, x.b).alias("b"), pick(now.g + x.g, x.g).alias("g"), pick(now.b1, x.b).alias("b1"), pick(now.g1, x.g).alias("g1"), branch.alias("branch"), out.alias("out"))

    return F.aggregate(cells, start, joined)["out"]


def named_children(kids: DataFrame, fewest: int, least: int) -> DataFrame:
    """kids: (host, node, seg, n, bad, good, low, high). Adds the name of each child's branch.

    Children with evidence, each with `fewest` labelled pages at least, meet in sums by parent and cell of their share, and
    a parent's cells in one row; the others meet in sums by parent and structure.
    """
    pooled = kids.groupBy("node", "seg").agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
    own, some = F.col("bad") + F.col("good") >= fewest, F.col("all_bad") + F.col("all_good") >= fewest
    pick = lambda x, y: F.when(own, F.col(x)).when(some, F.col(y)).cast("double")
    known = kids.join(pooled, ["node", "seg"]).select("host", "node", "seg", "n", "low", "high", pick("bad", "all_bad").alias("b"), pick("good", "all_good").alias("g"))
    known = known.withColumn("share", F.col("b") / (F.col("b") + F.col("g")))

    sure = known.where("share is not null").withColumn("cell", F.floor(F.col("share") * CELLS).cast("int"))
    cells = sure.groupBy("host", "node", "cell").agg(F.sum("b").alias("b"), F.sum("g").alias("g"), F.count("*").alias("members"), F.min("seg").alias("first"))
    parents = cells.groupBy("host", "node").agg(branches(F.array_sort(F.collect_list(F.struct("cell", "b", "g")))).alias("out"))
    of = parents.select("host", "node", F.inline("out"))
    named = cells.join(of, ["host", "node", "cell"]).groupBy("host", "node", "branch").agg(F.sum("members").alias("members"), F.min("first").alias("first"), F.collect_list("cell").alias("cell"))
    named = named.select("host", "node", "members", "first", F.explode("cell").alias("cell"))
    labelled = sure.join(named, ["host", "node", "cell"]).select("host", "node", "seg", F.when(F.col("members") > 1, F.concat("first", F.lit("+"))).otherwise(F.col("seg")).alias("name"))

    rest = known.where("share is null")
    kinds = rest.groupBy("host", "node", "low", "high").agg(F.count("*").alias("members"), F.sum("n").alias("pages"))
    parent = Window.partitionBy("host", "node")  # a row per structure
    k, pages = F.sum("members").over(parent), F.sum("pages").over(parent)
    kinds = kinds.withColumn("merged", (F.col("members") > 1) | ((k >= least) & (k.cast("double") * k >= pages))).select("host", "node", "low", "high", "merged")
    other = rest.join(kinds, ["host", "node", "low", "high"]).select("host", "node", "seg", F.when(F.col("merged"), F.lit("*")).otherwise(F.col("seg")).alias("name"))
    return labelled.union(other)


def templates(urls: DataFrame, fewest: int = 5, least: int = LEAST, depth: int | None = DEPTH) -> DataFrame:
    """urls: distinct (host, path) with n pages, bad and good ones. Adds template.

    least: a position is variable if at least so many different segments without evidence stand there, and the square of
    their number is at least their pages. depth: deeper segments are one wildcard; None keeps all (a level is a job).
    """
    raw = F.filter(F.split("path", "/"), lambda s: s != "")
    shapes = F.transform(raw, lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    if depth is not None:
        shapes = F.when(F.size(shapes) > depth, F.concat(F.slice(shapes, 1, depth), F.array(F.lit("**")))).otherwise(shapes)
    now = stage_table(urls.withColumn("shapes", shapes).withColumn("node", F.lit("")), "urls")
    deepest = now.agg(F.coalesce(F.max(F.size("shapes")), F.lit(0))).first()[0]
    for level in range(deepest):
        each = now.withColumn("seg", F.get("shapes", F.lit(level)))
        below = F.size("shapes") - (level + 1)
        kids = each.where("seg is not null").groupBy("host", "node", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")], F.min(below).alias("low"), F.max(below).alias("high"))
        named = named_children(kids, fewest, least)
        node = F.when(F.col("name").isNotNull(), F.concat("node", F.lit("/"), "name")).otherwise(F.col("node"))
        now = stage_table(each.join(named, ["host", "node", "seg"], "left").select(*urls.columns, "shapes", node.alias("node")), f"level{level}")
    tail = F.when((F.col("node") != "") & ~F.col("path").endswith("/"), F.lit("")).otherwise(F.lit("/"))
    return now.select(*urls.columns, F.concat("node", tail).alias("template"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, smooth: float = 4.0, reject: float = 0.6, fewest: int = 5, depth: int | None = DEPTH) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, template, purity (share of bad, smoothed).

    labels: optional (host, path, bad boolean), added to the rules' verdicts as evidence. A template is blocked if at
    least `fewest` labelled pages speak about it (on its host or on others) and its purity reaches `reject`.
    Null urls and urls without "://" have an empty host and path and are judged like any other. Repeated rows and
    identifiers get the same verdict each; an empty table gives no rows. Other columns are not read.
    """
    parts = pages.select(quoted(id_col).alias("id"), host_of(quoted(url_col)).alias("host"), path_of(quoted(url_col)).alias("path"))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    urls = parts.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("rule", rule).withColumn("by_rule", verdict)
    bad, good = (F.when(F.col("by_rule") == v, F.col("n")).otherwise(0) for v in ("block", "allow"))
    if labels is not None:
        given = labels.groupBy("host", "path").agg(F.sum(F.col("bad").cast("int")).alias("lb"), F.sum((~F.col("bad")).cast("int")).alias("lg"))
        urls = urls.join(given, ["host", "path"], "left")
        bad, good = bad + F.coalesce("lb", F.lit(0)), good + F.coalesce("lg", F.lit(0))
    known = templates(urls.withColumn("bad", bad).withColumn("good", good).drop("lb", "lg"), fewest, depth=depth)
    counted = known.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    pooled = counted.groupBy("template").agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
    all_bad, seen = pooled.agg(F.coalesce(F.sum("all_bad"), F.lit(0)), F.coalesce(F.sum(F.col("all_bad") + F.col("all_good")), F.lit(0))).first()
    overall = all_bad / seen if seen else 0.5
    prior = (F.col("all_bad") + smooth * overall) / (F.col("all_bad") + F.col("all_good") + smooth)
    purity = (F.col("bad") + smooth * prior) / (F.col("bad") + F.col("good") + smooth)
    enough = F.greatest(F.col("bad") + F.col("good"), F.col("all_bad") + F.col("all_good")) >= fewest
    scored = counted.join(pooled, "template").select("host", "template", purity.alias("purity"), enough.alias("enough"))
    verdicts = known.select("host", "path", "template", "rule", "by_rule").join(scored, ["host", "template"])
    verdicts = verdicts.select("host", "path", "template", "rule", "purity", F.coalesce("by_rule", F.when(F.col("enough") & (F.col("purity") >= reject), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
    return parts.join(verdicts, ["host", "path"]).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "template", "purity")
