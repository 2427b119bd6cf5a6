"""Queries of this subpackage, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import (attribution, bpe, dialogue, exact_dedup, jaccard, mixing, neighbours, pseudonyms, substrings, topk, toxicity,
                         trie, warc)
from marquee.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, sum(source_size) OVER () AS whole, sum(weight) OVER () AS all_weights,
         coalesce(sum(3 * source_size) OVER o, 0) AS size_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM s WINDOW o AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, 3 * source_size * (all_weights - weight_before) <= (whole - size_before) * weight AS capped FROM c),
r AS (SELECT max(whole) - coalesce(sum(3 * source_size) FILTER (capped), 0) AS rest,
             max(all_weights) - coalesce(sum(weight) FILTER (capped), 0) AS free_weight FROM k),
t AS (SELECT source, source_size, CASE WHEN capped THEN 3.0::DOUBLE * source_size
             ELSE rest::DOUBLE * weight / free_weight::DOUBLE END AS target FROM k, r),
f AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size::BIGINT AS size, f.source_size, f.target,
       ((floor(f.rate) + CASE WHEN d.draw < f.rate - floor(f.rate) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), rule="first")


@query("op2_exact_dedup", OP2_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op3_neighbours")
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op6_pseudonyms")
def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key="op6")
    return made.withColumn("n_values", F.coalesce(F.size("values"), F.lit(0)))


@query("op7_substrings")
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""


@query("op9_warc", OP9_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op10_mixing", OP10_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The cheapest way to each last role after each row, kept with its audit and its messages.
OP11_SQL = r"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(str_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))),
             4294967295::BIGINT), 4294967295) % 20 AS fate
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) WHERE fate <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM d),
r AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM r GROUP BY conv_id),
made(last, letters, now, said, cost) AS (VALUES
  ('', '', '', '', 0), ('s', '', 's', '', 0), ('u', '', 'u', '', 0), ('a', '', 'a', '', 0),
  ('', 'I', 'u', chr(10) || 'user:', 2), ('s', 'I', 'u', chr(10) || 'user:', 2), ('u', 'I', 'a', chr(10) || 'assistant:', 2), ('a', 'I', 'u', chr(10) || 'user:', 2),
  ('', 'II', 'a', chr(10) || 'user:' || chr(10) || 'assistant:', 4), ('s', 'II', 'a', chr(10) || 'user:' || chr(10) || 'assistant:', 4)),
edit(now, kind, letter, last, role) AS (
  SELECT now, kind, 'D', now, NULL FROM (VALUES (''), ('s'), ('u'), ('a')) a(now), (VALUES ('s'), ('u'), ('a'), ('x')) b(kind)
  UNION ALL SELECT * FROM (VALUES ('', 's', 'K', 's', ''), ('', 'u', 'K', 'u', ''), ('s', 'u', 'K', 'u', ''), ('a', 'u', 'K', 'u', ''), ('u', 'a', 'K', 'a', ''))
  UNION ALL SELECT now, kind, 'R', last, role
  FROM (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')) a(now, last, role), (VALUES ('s'), ('u'), ('a'), ('x')) b(kind)),
p(conv_id, i, last, cost, audit, fixed) AS (
  SELECT conv_id, 0::BIGINT, '', 0, '', '' FROM c
  UNION ALL
  SELECT conv_id, i, last, cost, audit, fixed FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, last ORDER BY cost, audit) AS place FROM (
      SELECT p.conv_id, r.i, edit.last,
             p.cost + made.cost + CASE edit.letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
               + CASE WHEN edit.letter <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
             p.audit || made.letters || edit.letter AS audit,
             p.fixed || made.said || CASE edit.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text
               ELSE chr(10) || edit.role || ':' || r.text END AS fixed
      FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
      JOIN made ON made.last = p.last
      JOIN edit ON edit.now = made.now AND edit.kind = CASE WHEN left(r.role, 1) IN ('s', 'u', 'a') THEN left(r.role, 1) ELSE 'x' END
      WHERE edit.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate'))) WHERE place = 1),
e AS (
  SELECT p.conv_id, p.cost + made.cost AS cost, p.audit || made.letters AS audit, p.fixed || made.said AS fixed,
         row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + made.cost, p.audit || made.letters) AS place
  FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN made ON made.last = p.last
  WHERE made.now IN ('', 'a'))
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(substr(fixed, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id AND e.place = 1
"""


@query("op11_dialogue", OP11_SQL)
def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.damaged_and_repaired(table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


@query("op12_topk", OP12_SQL)
def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, sha256(coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS at
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_transform(str_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))),
             4294967295::BIGINT), 4294967295) % 4 AS h
  FROM t),
b AS (
  SELECT c.conv_id, t.at AS place, 0 AS own, role, digest, words FROM c JOIN t ON t.conv_id = c.base AND t.at <= c.h
  UNION ALL SELECT c.conv_id, t.at, 1, role, digest, words FROM c JOIN t USING (conv_id) WHERE t.at > c.h),
p AS (
  SELECT conv_id, words, row_number() OVER w AS depth, string_agg(sha256(role || ':' || digest), '' ) OVER w AS prefix
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (
  SELECT conv_id, depth, prefix, words FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM m),
n AS (
  SELECT prefix, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
         left(prefix, len(prefix) - 64) AS above, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM e GROUP BY prefix),
k AS (SELECT above AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
s AS (
  SELECT a.prefix, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM n JOIN m a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN k ON k.prefix = n.prefix GROUP BY a.prefix)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (prefix) LEFT JOIN k USING (prefix) LEFT JOIN n u ON n.depth > 0 AND u.prefix = n.above
"""


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.branched_trie(table(spark, sf_dir, "conversations"))
