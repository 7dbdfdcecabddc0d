"""The thin queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chimerant.llm import bpe, clusters, decontam, html, linededup, lm, ngram_join, pii, quality, spelling, substrings, tokencount, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that SQL has too; archive_and_index() also gives URL key, archive and offset of each record."""
    return warc.archive_and_index(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents")).drop("spans")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf_dir, "embeddings")).drop("cluster_size")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_lm, op3_html, op4_line_dedup, op5_decontamination, op6_pii, op7_ngram_join, op8_quality, op9_token_counts, op10_warc, op11_substrings, op12_clusters, op13_spelling)}



def _clusters_sql(k: int = clusters.K, rounds: int = clusters.ROUNDS) -> str:
    """Chained steps: components as rows, distances of all vectors to all centroids, means as floors of quotients."""
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {clusters.DIM} AND list_count(embedding) = {clusters.DIM} AND len(list_filter(embedding, lambda x: isfinite(x))) = {clusters.DIM})",
        "e AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS pos FROM v)",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM v QUALIFY c < {k})",
        "c0 AS (SELECT c, pos, x FROM first JOIN e USING (vec_id))",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT vec_id, c, CAST(sum((e.x - c{i}.x) * (e.x - c{i}.x)) AS BIGINT) AS d FROM e JOIN c{i} USING (pos) GROUP BY vec_id, c)")
        steps.append(f"a{i} AS (SELECT vec_id, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT c, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN e USING (vec_id) GROUP BY c, pos)")
            steps.append(f"c{i + 1} AS (SELECT c, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} LEFT JOIN m{i} USING (c, pos))")
    last = f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS h FROM c{rounds} GROUP BY c)"
    return f"WITH {', '.join([*steps, last])} SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN h USING (c)"


#: Models, tokenizers, parsers and closures stand in the others; tests/llm compares those with brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f""",
    "op11_substrings": r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM t WHERE len(ws) >= 50)),
early AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN early USING (h) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM t),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS s, count(*) AS k FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)""",
    "op12_clusters": _clusters_sql(),
}
