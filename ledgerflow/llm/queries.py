"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm import (chat, exact_dedup, hard_negatives, language_id, mixing, near_dedup, packing, pii,
                            prefix_trie, quality, token_store, toxicity, url_filter)
from ledgerflow.llm.common import shared_path, table

REPETITION = 4.0        # passes over the most repeated source of the mixing query


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, repetition=REPETITION, order=True)
    return out.select("doc_id", "source", "mix_epoch", "mix_block", "mix_position", "mix_weight", "mix_order")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages")).drop("pattern")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path)
    return token_store.read(spark, path).drop("ids")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_hash")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.examples(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0).drop("positive_rank")


LEAD = 6                # a rebuilt conversation begins with fewer turns of another than this
LEAD_STEP = 100


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie query's input: conversations that share beginnings, as rows
    (conv_id, turn, role, text), and all their ids."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"),
                                                              text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = rows.withColumn("turn", F.row_number().over(order))
    lead = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEAD
    ids = rows.select("conv_id").distinct()
    first = (turns.filter(F.col("conv_id") % LEAD_STEP == 0).filter(F.col("turn") < LEAD)
             .withColumnRenamed("conv_id", "base"))
    begun = (ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % LEAD_STEP).join(first, "base")
             .filter(F.col("turn") <= lead))
    own = turns.filter(F.col("turn") > lead)
    return begun.select("conv_id", "turn", "role", "text").unionByName(own), ids


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ids = rebuilt_conversations(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(rows, ids)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_near_dedup, op3_pii, op4_toxicity, op5_url_filter, op6_packing, op7_token_store,
    op8_quality, op9_exact_dedup, op10_chat, op11_hard_negatives,
    op12_prefix_trie, op13_language_id, pipeline)}


def _url_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT '{r.verdict}' AS verdict, '{r.host}' AS host, '{r.path}' AS path"
                               for r in url_filter.RULES)
    blocks = " OR ".join(
        "regexp_matches(low, '" + p.pattern.replace("^", "(^|$|[^a-z0-9])").replace("*", ".*") + "', 's')"
        for p in url_filter.PATTERNS)
    return f"""
WITH rules AS ({rules}),
urls AS (SELECT row_number() OVER () AS rn, page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
best AS (SELECT u.rn, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict),
                             length(r.host || r.path)) AS b
    FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host))
        AND starts_with(u.path, r.path) GROUP BY u.rn),
flat AS (SELECT *, lower(host || '/' || path) AS low FROM urls)
SELECT f.page_id, f.host, f.path, b.b.rule AS rule,
    CASE WHEN b.rn IS NOT NULL THEN b.b.verdict WHEN {blocks} THEN 'block' ELSE 'allow' END AS verdict
FROM flat f LEFT JOIN best b USING (rn)"""


_EXACT_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS text,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT doc_id, text_sha256, count(*) OVER g AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) = 1 AS kept
    FROM n WINDOW g AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r"""

_CHAT_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role,
    coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS rn FROM t),
r AS (SELECT *, rn // 256 AS part FROM n),
c AS (SELECT conv_id, part, TRUE AS own, rn, role, text FROM r
    UNION ALL SELECT conv_id, part + 1, FALSE, rn, role, text FROM r
        WHERE rn % 256 >= 240 AND NOT (role = 'system' AND part = 0)
    UNION ALL SELECT r.conv_id, l.part, FALSE, r.rn, r.role, r.text
        FROM (SELECT DISTINCT conv_id, part FROM r WHERE part > 0) l
        JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.part = 0 AND r.role = 'system'),
s AS (SELECT DISTINCT conv_id, part, role AS perspective FROM c WHERE own AND role <> 'system'),
p AS (SELECT s.conv_id, s.part, s.perspective, c.rn, c.own, c.role = s.perspective AND c.own AS mine,
    CASE WHEN c.role = s.perspective THEN '<|im_start|>assistant' || chr(10)
         WHEN c.role = 'system' THEN '<|im_start|>system' || chr(10)
         ELSE '<|im_start|>user name=' || regexp_replace(replace(c.role, '<|', '< |'), '\s+', '_', 'g')
              || chr(10) END AS head,
    replace(c.text, '<|', '< |') || '<|im_end|>' AS body
    FROM s JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.part = c.part),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, part, perspective ORDER BY rn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM p)
SELECT conv_id, part, perspective, count(*) FILTER (WHERE own) AS n_turns,
    count(*) FILTER (WHERE NOT own) AS n_context, string_agg(head || body || chr(10), '' ORDER BY rn) AS text,
    string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ','
               ORDER BY rn) FILTER (WHERE mine) AS mask,
    CAST(sum(length(body)) FILTER (WHERE mine) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, part, perspective"""

_NEGATIVES_SQL = """
WITH e AS (SELECT row_number() OVER () AS rn, vec_id,
    CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.rn, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM e a JOIN e b ON a.rn <> b.rn WHERE a.vec_id % 100 = 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, id NULLS LAST) AS k
    FROM p WHERE same QUALIFY k <= 5),
neg AS (SELECT pos.anchor_id, pos.id AS positive_id,
    CAST(row_number() OVER (PARTITION BY pos.rn, pos.k ORDER BY p.score DESC, p.id NULLS LAST) AS INTEGER) AS rank,
    p.id AS negative_id, pos.score AS positive_score, p.score AS negative_score
    FROM pos JOIN p ON p.rn = pos.rn AND NOT p.same
        AND 80 * pos.score <= 100 * p.score AND p.score <= pos.score)
SELECT * FROM neg WHERE rank <= 5"""

# DuckDB has no crc32: one step for each byte, then eight shifts
_TRIE_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
        FOR c IN string_split(CAST(conv_id AS VARCHAR), '')])),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT i.conv_id, t.n, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.base AND t.n <= i.h
    UNION ALL SELECT i.conv_id, t.n, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.n > i.h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS depth, length(text) AS size,
    md5(length(role) || ':' || role || text) AS k FROM r),
p AS (SELECT conv_id, depth, size, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM d
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
f AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
nodes AS (SELECT p.path, p.depth, max(p.size) AS size, min(p.conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)
                    FILTER (f.depth = p.depth), '')) AS ends_sha256
    FROM p JOIN f ON f.conv_id = p.conv_id GROUP BY p.path, p.depth),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS c FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.c, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path)
SELECT a.conv_id, a.depth, any_value(u.conv_id) AS parent_conv_id, a.n_convs, a.n_children,
    count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.size) AS BIGINT) AS saved_tokens,
    a.ends_sha256
FROM full_nodes a JOIN full_nodes b ON starts_with(b.path, a.path)
    LEFT JOIN nodes u ON a.depth > 0 AND u.path = left(a.path, length(a.path) - 32)
GROUP BY a.path, a.conv_id, a.depth, a.n_convs, a.n_children, a.ends_sha256"""

SQL = {"op11_hard_negatives": _NEGATIVES_SQL, "op12_prefix_trie": _TRIE_SQL, "op5_url_filter": _url_sql(), "op9_exact_dedup": _EXACT_SQL, "op10_chat": _CHAT_SQL}
