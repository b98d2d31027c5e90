"""Queries of this package on the test tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import exact_dedup, language_id, lexical_search, license_scan, packing, quality_cnn, secret_scan, source_mixing, token_alignment, token_counts, vector_neardup, warc_zip, weighted_minhash
from tideline.llm.columns import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@_query("op8_exact_dedup", r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
  FROM documents
), k AS (
  SELECT doc_id, digest, first_value(doc_id) OVER (PARTITION BY digest ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY digest) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, digest AS text_sha256 FROM k""")
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.classes(table(spark, folder, "documents"))


@_query("op6_warc_zip", """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""")
def op6_warc_zip(spark: SparkSession, folder: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, crc_mod("doc_id", 3) != 1)
    found = language_id.with_language(docs.withColumn("held_out", crc_mod("doc_id", 3) == 1), model, passing=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "lang_accepted")


@_query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_cnn.train(docs, table(spark, folder, "labels").select("doc_id", "quality"), crc_mod("doc_id", 4) != 2)
    found = quality_cnn.with_quality(docs.withColumn("held_out", crc_mod("doc_id", 4) == 2), model, passing=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@_query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs), passing=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


@_query("op10_token_counts")
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096, passing=["doc_id"])


@_query("op5_embedding_neardup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a
), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.id""")
def op5_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_neardup.components(table(spark, folder, "embeddings"))


@_query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


@_query("op9_minhash_neardup")
def op9_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return weighted_minhash.classes(table(spark, folder, "documents").select("doc_id", "text"))


@_query("op1_source_mixing", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')) AS BIGINT) AS tokens FROM documents
), t AS (
  SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) / CAST((SELECT sum(tokens) FROM d) AS DOUBLE) AS share FROM d GROUP BY source
), n AS (
  SELECT -sum(share * ln(share)) AS own, ln(count(*)) AS alike, max(tokens) AS top, min(tokens) AS low FROM t WHERE tokens > 0
), b(i, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN low ELSE mid END, CASE WHEN good THEN mid ELSE high END FROM (
    SELECT b.i, b.low, b.high, m.mid,
      (SELECT ln(sum(share ** m.mid)) - sum(share ** m.mid * m.mid * ln(share)) / sum(share ** m.mid) FROM t WHERE tokens > 0)
        <= (SELECT own + 0.98 * (alike - own) + 1e-12 FROM n)
      AND (SELECT (CAST(low AS DOUBLE) / top) ** (m.mid - 1) FROM n) <= 2 + 1e-12 AS good
    FROM b, (SELECT CASE WHEN i = 0 THEN 0.0 ELSE (low + high) / 2 END AS mid, i AS j FROM b) m WHERE m.j = b.i AND b.i < 41
  )
), a AS (SELECT CASE WHEN high = 0 THEN 0 ELSE ceil(high * 1e6) / 1e6 END AS a FROM b ORDER BY i DESC LIMIT 1),
w AS (
  SELECT t.*, CASE WHEN tokens > 0 THEN share ** a ELSE 0 END AS power FROM t, a
), s AS (
  SELECT source, tokens, CAST(round(power / z * (top * z / p)) AS BIGINT) AS wanted, greatest(1, CAST(ceil(tokens / 262144.0) AS BIGINT)) AS n_blocks
  FROM w, (SELECT sum(power) AS z, arg_max(power, tokens) AS p, max(tokens) AS top FROM w)
), q AS (
  SELECT source, n_blocks, CASE WHEN tokens > 0 THEN wanted // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN wanted % tokens ELSE 0 END AS rest FROM s
), e AS (
  SELECT d.doc_id, d.source, d.tokens, q.passes, q.rest, unnest(range(q.passes + 1)) AS epoch,
    CAST('0x' || substr(md5('1|' || d.doc_id), 1, 15) AS BIGINT) % q.n_blocks AS block
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), o AS (
  SELECT *, CAST('0x' || substr(md5('1|' || coalesce(source, 'null') || '|' || epoch || '|' || block), 1, 15) AS BIGINT) AS block_order,
    CAST('0x' || substr(md5('1|' || doc_id || '|' || epoch), 1, 15) AS BIGINT) AS doc_order
  FROM e
), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY block_order, doc_order) AS upto FROM o)
SELECT doc_id, source, tokens, CAST(epoch AS INTEGER) AS epoch, block, block_order, doc_order FROM r WHERE epoch < passes OR upto <= rest""")
def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return source_mixing.placed(docs).select("doc_id", "source", "tokens", "epoch", "block", "block_order", "doc_order")


@_query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = token_alignment.aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


@_query("op12_license_scan")
def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(table(spark, folder, "documents").select("doc_id", "text"), passing=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@_query("op13_lexical_search", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), f AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
l AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY r),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM l),
g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark
), h AS (
  SELECT q.item_id, f.r, f.doc_id,
    CAST(sum(CAST(floor(1000 * ln((2 * s.docs + 2) / (2 * g.df + 1))) AS BIGINT) * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * l.n * s.docs) // s.total)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN g USING (term) JOIN l USING (r) CROSS JOIN s GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM h WHERE score > 0
) WHERE rank <= 10""")
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(lexical_search.build(table(spark, folder, "documents").select("doc_id", "text")), table(spark, folder, "benchmark"))
