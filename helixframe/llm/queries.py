"""The queries of the text operators, and their SQL for DuckDB where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, jaccard, language_id, licenses, merkle, mixing, secrets, tokens, toxicity, url_filter, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_sentences", "sentence_ids", "licenses", "spans")


#: Shares of the mixed tokens by language and quality.
MIX_TARGETS = {
    "en:good": 0.40, "de:good": 0.20, "fr:good": 0.20, "es:good": 0.15,
    "en:poor": 0.02, "de:poor": 0.01, "fr:poor": 0.01, "es:poor": 0.01,
}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = mixing.language_quality(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, MIX_TARGETS)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.judge(docs, labels)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lex")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return scanned.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.documents_manifest(docs).rows()


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_warc, op3_license_scans, op4_mixing, op5_nearest, op6_toxicity, op7_url_filters,
        op8_secret_scans, op9_jaccard_join, op10_decontamination, op11_merkle_manifest, op12_token_counts,
    )
}

SQL: dict[str, str] = {
    "op2_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p
""",
    "op5_nearest": """
WITH v AS (
  SELECT vec_id, max(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: NOT coalesce(isfinite(x), false))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op7_url_filters": url_filter.sql(),
    "op10_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
        FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), m AS (
  SELECT r, p, iw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g
), h AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r
), s AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE b AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS k, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT),
      lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) AS crc
  FROM documents
), d AS (
  SELECT r, doc_id, k, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS claimed
  FROM b
), o AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), up(k, lv, l) AS (
  SELECT k, 0, list(leaf ORDER BY pos) FROM o GROUP BY k
  UNION ALL SELECT k, lv + 1, list_transform(range(1, len(l) + 1, 2), lambda i: sha256(l[i] || coalesce(l[i + 1], ''))) FROM up WHERE len(l) > 1
), s AS (
  SELECT k, l[1] AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos FROM up WHERE len(l) = 1
), tree(lv, l) AS (
  SELECT 0, list(subroot ORDER BY k) FROM s
  UNION ALL SELECT lv + 1, list_transform(range(1, len(l) + 1, 2), lambda i: sha256(l[i] || coalesce(l[i + 1], ''))) FROM tree WHERE len(l) > 1
), steps AS (
  SELECT r, 0 AS part, lv, (pos >> lv) & 1 AS side, coalesce(l[xor(pos >> lv, 1) + 1], '') AS sib FROM o JOIN up USING (k) WHERE len(l) > 1
  UNION ALL SELECT r, 1, lv, (s.pos >> lv) & 1, coalesce(l[xor(s.pos >> lv, 1) + 1], '') FROM o JOIN s USING (k) JOIN tree ON len(l) > 1
), p AS (
  SELECT r, list(side || sib ORDER BY part, lv) AS path FROM steps GROUP BY r
), f AS (
  SELECT o.*, s.subroot, (SELECT l[1] FROM tree WHERE len(l) = 1) AS root, coalesce(path, []) AS path FROM o JOIN s USING (k) LEFT JOIN p USING (r)
), g AS (
  SELECT *, list_reduce([coalesce(claimed, leaf)] || path, lambda a, x: sha256(CASE WHEN x[1] = '1' THEN substr(x, 2) || a ELSE a || substr(x, 2) END)) AS folded_root FROM f
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: substr(x, 2)), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM g
""",
}
