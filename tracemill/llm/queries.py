"""The operators applied to the synthetic tables, with production parameters, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import table
from .conversation_trie import numbered, prefix_trie, renamed, with_heads
from .embedding_dedup import near_vectors
from .exact_dedup import exact_dedup
from .lm_scoring import score_by_difference
from .mixing import mix_rates
from .ngram_join import jaccard_components
from .packing import pack
from .quality import classify
from .rows import list_digests
from .substring_dedup import remove_repeats
from .token_files import token_round_trip
from .url_filter import judge
from .vector_search import top_k


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, similarity=0.9)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_rates(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents labelled good."""
    return score_by_difference(table(spark, sf_dir, "documents"), wanted=table(spark, sf_dir, "labels").where("quality = 1"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: identifiers divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), k=5, is_query="id % 50 = 0")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c starts with up to three turns of conversation c - c % 20."""
    turns = numbered(renamed(table(spark, sf_dir, "conversations")))
    length = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    nodes, ends = prefix_trie(*with_heads(turns, F.col("conv") - F.col("conv") % 20, length))
    digests = list_digests(ends)
    out = nodes.join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("sha256", F.sha2(F.lit(b""), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_ngram_join, op3_mixing, op4_packing, op5_exact_dedup, op6_token_files, op7_embedding_dedup, op8_quality, op9_lm_scoring,
        op10_substring_dedup, op11_vector_search, op12_conversation_trie, op13_collocations,
    )
}




def _same(b: str, g: str) -> str:
    """Whether the shares of (b, g) and (x.b, x.g) do not differ."""
    p = f"(({b} + x.b) / ({b} + {g} + x.b + x.g))"
    d = f"({b} / ({b} + {g}) - x.b / (x.b + x.g))"
    return f"{d} * {d} <= 3.8416::DOUBLE * {p} * (1 - {p}) * (1 / ({b} + {g}) + 1 / (x.b + x.g))"


#: One level of op1's tree.
_LEVEL = r""",
each{k} AS MATERIALIZED (SELECT *, shapes[{k}] AS seg, len(shapes) - {k} AS below FROM level{before}),
kids{k} AS (SELECT host, node, seg, sum(n) AS n, sum(bad) AS bad, sum(good) AS good, min(below) AS low, max(below) AS high FROM each{k} WHERE seg IS NOT NULL GROUP BY ALL),
all{k} AS (SELECT node, seg, sum(bad) AS ab, sum(good) AS ag FROM kids{k} GROUP BY ALL),
ev{k} AS (
  SELECT host, node, seg, n, low, high, CASE WHEN bad + good >= 5 THEN bad WHEN ab + ag >= 5 THEN ab END::DOUBLE AS b, CASE WHEN bad + good >= 5 THEN good WHEN ab + ag >= 5 THEN ag END::DOUBLE AS g
  FROM kids{k} JOIN all{k} USING (node, seg)
), cells{k} AS (
  SELECT host, node, CAST(floor(b / (b + g) * 64) AS INTEGER) AS cell, sum(b) AS b, sum(g) AS g, count(*) AS members, min(seg) AS first FROM ev{k} WHERE b IS NOT NULL GROUP BY ALL
), fold{k} AS (
  SELECT host, node, unnest(list_reduce(list({{'cell': cell, 'b': b, 'g': g}} ORDER BY cell), lambda a, x:
    CASE WHEN a.k > 0 AND {same_all} AND {same_first}
    THEN {{'b': a.b + x.b, 'g': a.g + x.g, 'b1': a.b1, 'g1': a.g1, 'k': a.k, 'o': list_append(a.o, {{'cell': x.cell, 'k': a.k}})}}
    ELSE {{'b': x.b, 'g': x.g, 'b1': x.b, 'g1': x.g, 'k': a.k + 1, 'o': list_append(a.o, {{'cell': x.cell, 'k': a.k + 1}})}} END,
    {{'b': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'b1': 0.0::DOUBLE, 'g1': 0.0::DOUBLE, 'k': 0, 'o': [{{'cell': 0, 'k': 0}}][2:]}}).o) AS u FROM cells{k} GROUP BY host, node
), branch{k} AS (
  SELECT c.host, c.node, c.cell, CASE WHEN sum(members) OVER q > 1 THEN min(first) OVER q || '+' END AS name FROM cells{k} c JOIN fold{k} f ON f.host = c.host AND f.node = c.node AND f.u.cell = c.cell
  WINDOW q AS (PARTITION BY c.host, c.node, f.u.k)
),
rest{k} AS (SELECT host, node, low, high, count(*) AS members, sum(n) AS pages FROM ev{k} WHERE b IS NULL GROUP BY ALL),
kinds{k} AS (SELECT host, node, low, high, members > 1 OR (sum(members) OVER p >= 8 AND sum(members) OVER p * sum(members) OVER p >= sum(pages) OVER p) AS merged FROM rest{k} WINDOW p AS (PARTITION BY host, node)),
names{k} AS (
  SELECT e.host, e.node, e.seg, coalesce(name, e.seg) AS name FROM ev{k} e JOIN branch{k} b ON b.host = e.host AND b.node = e.node AND b.cell = CAST(floor(e.b / (e.b + e.g) * 64) AS INTEGER)
  UNION ALL SELECT e.host, e.node, e.seg, CASE WHEN merged THEN '*' ELSE e.seg END FROM ev{k} e JOIN kinds{k} USING (host, node, low, high) WHERE e.b IS NULL
), level{k} AS MATERIALIZED (
  SELECT e.host, e.path, e.n, e.rule, e.kind, e.bad, e.good, e.shapes, CASE WHEN name IS NULL THEN e.node ELSE e.node || '/' || name END AS node FROM each{k} e LEFT JOIN names{k} m ON m.host = e.host AND m.node = e.node AND m.seg = e.seg
)"""

SQL: dict[str, str] = {
    "op3_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS BIGINT) AS w
  FROM sized GROUP BY source
), ordered AS (  -- capped sources are those with the least size for their weight
  SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS weights,
         coalesce(sum(3 * s) OVER (ORDER BY s::DOUBLE / w, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         coalesce(sum(w) OVER (ORDER BY s::DOUBLE / w, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM sources
), level AS (
  SELECT CAST(total - capped AS BIGINT) AS rest, CAST(weights - gone AS BIGINT) AS free FROM ordered
  WHERE w * (total - capped) <= 3 * s * (weights - gone) ORDER BY gone LIMIT 1
), target AS (
  SELECT source, s, least(CAST(w AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(free AS DOUBLE), CAST(3 * s AS DOUBLE)) AS target FROM sources, level
), rated AS (
  SELECT doc_id, size, s AS source_size, target, CASE WHEN s > 0 THEN target / s ELSE 1.0::DOUBLE END AS rate,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
""",
    "op5_exact_dedup": r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
    "op2_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s FROM places),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op7_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(k.k, 0) AS BIGINT) AS n_links, m AS component_id, vec_id = m AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM places),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN least USING (s) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op1_url_filters": r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), urls AS (SELECT host, path, count(*) AS n FROM parts GROUP BY ALL),
rules AS (SELECT * FROM (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')) r(kind, rule)),
hits AS (
  SELECT host, path, kind, rule, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule DESC) AS r FROM urls JOIN rules
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substring(rule, instr(rule, '/')))
), raw AS (SELECT host, path, n, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) AS all_shapes FROM urls),
level0 AS MATERIALIZED (
  SELECT u.host, u.path, u.n, h.rule, h.kind, CASE WHEN kind = 'block' THEN u.n ELSE 0 END AS bad, CASE WHEN kind = 'allow' THEN u.n ELSE 0 END AS good,
         CASE WHEN len(all_shapes) > 12 THEN list_append(all_shapes[1:12], '**') ELSE all_shapes END AS shapes, '' AS node
  FROM raw u LEFT JOIN hits h ON h.host = u.host AND h.path = u.path AND h.r = 1
)""" + "".join(_LEVEL.format(k=k, before=k - 1, same_all=_same("a.b", "a.g"), same_first=_same("a.b1", "a.g1")) for k in range(1, 14)) + r""",
known AS (SELECT *, node || CASE WHEN node <> '' AND NOT ends_with(path, '/') THEN '' ELSE '/' END AS template FROM level13),
counted AS (SELECT host, template, sum(bad) AS bad, sum(good) AS good FROM known GROUP BY ALL),
pooled AS (SELECT template, sum(bad) AS ab, sum(good) AS ag FROM counted GROUP BY ALL),
overall AS (SELECT coalesce(sum(ab)::DOUBLE / nullif(sum(ab + ag), 0), 0.5) AS o FROM pooled),
scored AS (
  SELECT host, template, (bad + 4.0::DOUBLE * ((ab + 4.0::DOUBLE * o) / (ab + ag + 4.0::DOUBLE))) / (bad + good + 4.0::DOUBLE) AS purity, greatest(bad + good, ab + ag) >= 5 AS enough
  FROM counted JOIN pooled USING (template), overall
)
SELECT page_id, parts.host, parts.path, rule, coalesce(kind, CASE WHEN enough AND purity >= 0.6 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts JOIN known k ON k.host = parts.host AND k.path = parts.path JOIN scored s ON s.host = k.host AND s.template = k.template
""",
    "op11_vector_search": r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(256::DOUBLE * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
""",
    "op12_conversation_trie": r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (  -- the remainders of all bytes, of the reflected polynomial
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS k
), convs AS (
  SELECT c, c - c % 20 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda x, b: xor(x >> 8, k[(xor(x, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t), crc
), turns AS (
  SELECT convs.c, 0 AS part, pos, role, text FROM convs JOIN t ON t.c = base WHERE pos <= h UNION ALL SELECT t.c, 1, pos, role, text FROM t JOIN convs USING (c) WHERE pos > h
), paths AS (SELECT c, list(struct_pack(role, text) ORDER BY part, pos) AS path FROM turns GROUP BY c),
whole AS (SELECT convs.c, coalesce(path, []) AS path FROM convs LEFT JOIN paths USING (c)),
prefixes AS (SELECT c, len(path) AS l, unnest(range(0, len(path) + 1)) AS depth, path FROM whole),
nodes AS (
  SELECT path[:depth] AS p, depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN l = depth THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM prefixes GROUP BY ALL
), kids AS (SELECT p[:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
each AS (SELECT nodes.*, coalesce(n, 0) AS n_children, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(nodes.p[depth].text, '[^\x20\x09-\x0D]+')) END AS spared FROM nodes LEFT JOIN kids USING (p)),
up AS (SELECT p, unnest(range(0, depth + 1)) AS d, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, spared FROM each),
sums AS (SELECT p[:d] AS p, sum(leaf) AS leaves, sum(spared) AS saved FROM up GROUP BY ALL)
SELECT each.conv_id, CAST(each.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, CAST(each.n_convs AS BIGINT) AS n_convs, CAST(each.n_children AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(each.ends) AS ends_sha256
FROM each JOIN sums USING (p) LEFT JOIN nodes above ON each.depth > 0 AND above.p = each.p[:each.depth - 1]
""",
    "op13_collocations": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
one AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM lists) GROUP BY ALL),
two AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS p FROM lists) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS p FROM lists) GROUP BY ALL HAVING count(*) >= 10),
inner_ AS (SELECT lang, p, max(f) AS longer FROM (SELECT lang, p[1:2] AS p, f FROM three UNION ALL SELECT lang, p[2:3], f FROM three) GROUP BY ALL),
cuts AS (
  SELECT two.lang, two.p, two.f AS a, 1 AS k, x.f AS l, y.f AS r FROM two JOIN one x ON x.lang = two.lang AND x.p = two.p[1] JOIN one y ON y.lang = two.lang AND y.p = two.p[2] LEFT JOIN inner_ i ON i.lang = two.lang AND i.p = two.p WHERE 100 * coalesce(longer, 0) < 50 * two.f
  UNION ALL SELECT t.lang, t.p, t.f, 1, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.p = t.p[1] JOIN two y ON y.lang = t.lang AND y.p = t.p[2:3]
  UNION ALL SELECT t.lang, t.p, t.f, 2, x.f, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.p = t.p[1:2] JOIN one y ON y.lang = t.lang AND y.p = t.p[3]
), scored AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, k, l, r, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest QUALIFY rank <= 2000),
n AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM best JOIN n USING (lang)
""",
}
