"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliomill.llm import (
    bit_planes,
    bpe,
    brown_lm,
    exact_dedup,
    license_diagonals,
    pattern_packing,
    piece_chunks,
    prefix_trie,
    quality_cnn,
    simhash_bk,
    token_attribution,
    vector_graph,
    warc_chain,
)

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chain.archive_round_trip(_table(spark, sf_dir, "pages"))


def op4_brown_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_diagonals.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("n_copies")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.section_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_chunks.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(_table(spark, sf_dir, "conversations"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.cluster_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_embedding_near_dedup,
        op3_warc_round_trip,
        op4_brown_lm_scores,
        op5_simhash_near_dedup,
        op6_license_scans,
        op7_exact_dedup,
        op8_bpe_round_trip,
        op9_token_counts,
        op10_best_fit_packing,
        op11_sentencepiece_round_trip,
        op12_conversation_trie,
        op13_centroid_clusters,
    )
}

def _clusters_sql(rounds: int) -> str:
    """Clustering in SQL: each round's assignment a and centroids d."""
    nearest = "(SELECT r, min_by(c, (s, c)) AS c, min(s) AS s FROM (SELECT r, c, sum((p.x - d.x) * (p.x - d.x)) AS s FROM p JOIN d{n} d USING (i) GROUP BY r, c) GROUP BY r)"
    mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    moved = f"(SELECT d.c, d.i, coalesce(m.x, d.x) AS x FROM d{{n}} d LEFT JOIN (SELECT c, i, {mean} AS x FROM p JOIN a{{n}} USING (r) GROUP BY c, i) m USING (c, i))"
    steps = "".join(f"a{n} AS MATERIALIZED {nearest.format(n=n)},\n" + (f"d{n + 1} AS MATERIALIZED {moved.format(n=n)},\n" if n < rounds else "") for n in range(rounds + 1))
    return f"""
        WITH k AS MATERIALIZED (
          SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS v
          FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM k),
        c0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM k ORDER BY sha256('1:' || vec_id) LIMIT 16),
        d0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(v) AS x FROM c0),
        {steps}
        h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM d{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(s) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN k USING (r) JOIN h USING (c)"""


ORACLES = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
        c AS (SELECT n AS vec_id, min(m) AS component_id FROM r GROUP BY n),
        d AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept, CAST(1 AS DOUBLE) AS recall FROM c LEFT JOIN d USING (vec_id)""",
    "op3_warc_round_trip": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
               CASE WHEN NOT (payload_bytes >= 100 AND page_id <> first_id) THEN true END AS verified
        FROM q""",
    "op7_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS points,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        r AS (
          SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, nth = 1 AS kept, text_sha256 FROM r""",
    "op12_conversation_trie": r"""
        WITH RECURSIVE t AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) AS i
          FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (
          SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM t),
        h AS (
          SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda x: CAST(ord(x) AS BIGINT))),
            lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 AS h FROM ids),
        r AS (
          SELECT c, i, role, text FROM h JOIN t ON t.conv_id = c - c % 20 AND i <= h
          UNION ALL SELECT c, i, role, text FROM h JOIN t ON t.conv_id = c AND i > h),
        n AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY i) AS d FROM r),
        e AS (
          SELECT c, 0 AS depth, '' AS k, 0 AS words FROM ids
          UNION ALL
          SELECT n.c, e.depth + 1, sha256(e.k || length(n.role) || ':' || n.role || n.text), len(regexp_extract_all(n.text, '[^\x20\x09-\x0D]+'))
          FROM e JOIN n ON n.c = e.c AND n.d = e.depth + 1),
        m AS (SELECT *, lag(k) OVER w AS up, lead(k) OVER w IS NULL AS ended FROM e WINDOW w AS (PARTITION BY c ORDER BY depth)),
        x AS (
          SELECT k, any_value(depth) AS depth, any_value(up) AS up, any_value(words) AS words, min(c) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends_sha256
          FROM m GROUP BY k),
        kids AS (SELECT up AS k, count(*) AS n_children FROM x WHERE up IS NOT NULL GROUP BY up),
        s AS (SELECT DISTINCT b.k AS top, a.k AS k FROM m a JOIN m b ON a.c = b.c AND b.depth <= a.depth),
        g AS (
          SELECT s.top AS k, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
          FROM s JOIN x ON x.k = s.k LEFT JOIN kids ON kids.k = s.k GROUP BY s.top)
        SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
        FROM x JOIN g ON g.k = x.k LEFT JOIN kids ON kids.k = x.k LEFT JOIN x p ON p.k = x.up""",
    "op13_centroid_clusters": _clusters_sql(3),
}
