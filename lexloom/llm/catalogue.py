"""The registered queries of the training-data operators: thin projections of each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, licenses, mixing, ngram_join, quality_model, quality_rules, repeats, token_shards, toxicity, url_filter, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shard_index(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similarity_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "copies")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, mixing.source_rates(docs)).select("doc_id", "text", "lang", "source", "n_chars", "copy", "mix_key")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.encode(_table(spark, sf_dir, "embeddings"))
    return vector_codes.with_totals(found, books).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centers = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(found, centers).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(_table(spark, sf_dir, "documents")))


_ALL = (
    op1_license_scan, op2_token_shards, op3_decontamination, op4_ngram_join, op5_quality_rules, op6_quality_classifier, op7_source_mixing, op8_url_filter, op9_warc_revisits, op10_toxicity,
    op11_vector_codes, op12_centroid_clusters, op13_suffix_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}


def _url_sql() -> str:
    def hits(terms: tuple[str, ...]) -> str:
        return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INTEGER" for t in terms)

    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    return f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {rules}),
u AS (SELECT page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS low, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
p AS (SELECT page_id, low, translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.path AS path FROM u),
t AS (SELECT *, {hits(url_filter.STRICT)} AS strict_terms, {hits(url_filter.SOFT)} AS soft_terms FROM p),
r AS (SELECT t.*, (SELECT max_by({{'rule': rule_host || rule_path, 'verdict': verdict}}, length(rule_host || rule_path)) FROM rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best FROM t)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN strict_terms > 0 OR soft_terms >= 2 THEN 'block' ELSE 'allow' END) AS verdict, strict_terms, soft_terms FROM r"""


ORACLE_SQL = {
    "op7_source_mixing": """
WITH rates AS (
  SELECT coalesce(source, chr(0) || 'null') AS k, coalesce(sum(length(text)), 0) AS chars FROM documents GROUP BY 1
), rated AS (
  SELECT k, (CASE WHEN chars > 0 THEN 1.0 / (SELECT count(*)::DOUBLE FROM rates) * (SELECT sum(chars)::DOUBLE FROM rates) / chars ELSE 0 END)::DOUBLE AS rate FROM rates
), terms AS (
  SELECT k, rate, i.i, CASE WHEN rate = 0 THEN CASE WHEN i.i = 0 THEN 1.0 ELSE 0.0 END ELSE exp(-rate + i.i * ln(rate) - lgamma(i.i + 1)) END AS term
  FROM rated, range(0, CAST(ceil(rate + 12 * sqrt(rate) + 21) AS BIGINT)) AS i(i)
), cdf AS (
  SELECT k, i, sum(term) OVER (PARTITION BY k ORDER BY i) AS upto FROM terms
), lists AS (
  SELECT k, list(upto ORDER BY i) AS upto FROM cdf GROUP BY k
), counted AS (
  SELECT d.*, len(list_filter(l.upto, lambda c: c <= ('0x' || substr(md5('7|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0)) AS n
  FROM documents d JOIN lists l ON coalesce(d.source, chr(0) || 'null') = l.k
)
SELECT doc_id, text, lang, source, n_chars, c.c::INTEGER AS copy, md5('order7|' || coalesce(doc_id::VARCHAR, '') || '|' || c.c::VARCHAR) AS mix_key
FROM counted, range(0, n) AS c(c)""",
    "op1_license_scan": licenses.oracle_sql(),
    "op8_url_filter": _url_sql(),
    "op11_vector_codes": vector_codes.oracle_sql(),
    "op12_centroid_clusters": centroids.oracle_sql(),
    "op13_suffix_dedup": repeats.oracle_sql(),
    # every pair of texts that share a shingle, and every pair within a class: for small tables
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
k AS (SELECT doc_id, len(words) AS n, array_to_string(words, ' ') AS seq, words FROM w),
nodes AS (SELECT seq, min(doc_id) AS rep, count(*) AS copies, any_value(words) AS words FROM k WHERE n > 0 GROUP BY 1),
sh AS (SELECT DISTINCT rep, CASE WHEN len(words) >= 5 THEN array_to_string(list_slice(words, x.i, x.i + 4), ' ') ELSE seq || ' .' END AS s FROM nodes, range(1, greatest(len(words) - 4, 1) + 1) x(i)),
size AS (SELECT rep, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2),
half AS (SELECT a, b FROM common JOIN size x ON x.rep = a JOIN size y ON y.rep = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT rep AS a, rep AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY 1),
linked AS (SELECT l.a, sum(n.copies) AS n FROM links l JOIN nodes n ON n.rep = l.b GROUP BY 1)
SELECT doc_id, CASE WHEN k.n > 0 THEN class_id ELSE doc_id END AS class_id, CASE WHEN k.n > 0 THEN coalesce(l.n, 0)::BIGINT + copies - 1 ELSE 0 END AS n_links, coalesce(copies, 1) AS copies
FROM k LEFT JOIN nodes USING (seq) LEFT JOIN class ON class.a = rep LEFT JOIN linked l ON l.a = rep""",
    "op9_warc_revisits": """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, url, octet_length(encode(html)) AS n, sha1(html) AS hexed FROM p
), d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hexed, 1 + 10 * (k // 8), 10))::BIGINT >> (5 * (7 - k % 8))) & 31)::INTEGER, 1)), '') AS digest FROM h
), f AS (
  SELECT digest, min(page_id) AS first FROM d GROUP BY 1
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, url FROM d JOIN f USING (digest)""",
}
