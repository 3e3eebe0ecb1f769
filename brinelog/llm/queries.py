"""Registered queries of the subpackage, with production parameters, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, hard_negatives, language_id, packing, piece_bpe, prefix_trie, quality, secrets, simhash, substring_dedup, topk, url_filter
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.spliced(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(table(spark, sf_dir, "documents"), piece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_byte_bpe, op3_exact_topk, op4_packing, op5_url_filter, op6_language_id, op7_simhash, op8_exact_dedup, op9_quality, op10_secret_scan, op11_hard_negatives, op12_prefix_trie, op13_sentencepiece)}

SPACE_CLASS = r"[\x20\x09-\x0D]"

ORACLE_SQL = {
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op5_url_filter": r"""
        WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM p),
        u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
        r AS (SELECT *, CASE
                WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM u)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op8_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{SPACE_CLASS}', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op12_prefix_trie": r"""
        WITH t(x) AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
        r AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS o FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT c, n, c - ((c % 5) + 5) % 5 AS base,
                     xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda v, b: xor(v >> 8, x[(xor(v, b) & 255) + 1])), 4294967295) % 9 AS h
              FROM (SELECT c, count(*) AS n FROM r GROUP BY c), t),
        k AS (SELECT h.c, h.h, least(h.h, coalesce(b.n, 0)) AS given, least(h.h, coalesce(b.n, 0)) + greatest(h.n - h.h, 0) AS length, h.base FROM h LEFT JOIN h b ON b.c = h.base),
        s AS (SELECT k.c, r.o AS p, r.role, r.text FROM k JOIN r ON r.c = k.base AND r.o < k.h
              UNION ALL SELECT k.c, k.given + r.o - k.h, r.role, r.text FROM k JOIN r ON r.c = k.c AND r.o >= k.h),
        w AS (SELECT c, list(sha256(length(role) || ':' || role || text) ORDER BY p) AS path, list(strlen(text) ORDER BY p) AS bytes FROM s GROUP BY c),
        m AS (SELECT k.c, k.length, coalesce(path, []) AS path, coalesce(bytes, []) AS bytes FROM k LEFT JOIN w USING (c)),
        e AS (SELECT c, length, d AS depth, path[1:d] AS id, CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS bytes FROM (SELECT *, unnest(range(length + 1)) AS d FROM m)),
        n AS (SELECT id, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saves,
                     sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE length = depth), '')) AS ends_sha256 FROM e GROUP BY id, depth),
        f AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.id = n.id[1:n.depth - 1]),
        g AS (SELECT id[1:depth - 1] AS id, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        u AS (SELECT id[1:d] AS id, count(*) FILTER (WHERE leaf)::BIGINT AS n_leaves, sum(saves)::BIGINT AS saved_tokens
              FROM (SELECT n.*, g.n_children IS NULL AS leaf, unnest(range(n.depth + 1)) AS d FROM n LEFT JOIN g USING (id)) GROUP BY 1)
        SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256 FROM f LEFT JOIN g USING (id) JOIN u USING (id)""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS a, v.vec_id AS b, a.label = v.label AS same, list_dot_product(a.x, v.x)::BIGINT AS score
              FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.x) = len(v.x)),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INT AS rank,
               n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        QUALIFY rank <= 5""",
}
