"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm import audit, decontamination, extraction, languages, mixing, negatives, passages, quality, resampling, setsketch, simhash, suffixes, urls
from panelscope.llm.common import table


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of the pages whose article, numbered in the URL's path, is labelled toxic."""
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return table(spark, sf_dir, "pages").select("url", number.alias("doc_id")).join(toxic, "doc_id", "left_semi").select("url")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), listed_urls(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.without_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judged(docs).drop("text", "lang")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_simhash": op2_simhash,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_minhash": op12_minhash,
    "op13_hard_negatives": op13_hard_negatives,
}

HOST = "coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
PATH = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"

SQL: dict[str, str] = {
    "op1_url_filters": rf"""
WITH parts AS (
  SELECT page_id, url, {HOST} AS host, {PATH} AS path,
         regexp_replace(regexp_replace(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^=&]*|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&+', '') AS query
  FROM pages),
named AS (
  SELECT page_id, url, host, path,
         coalesce(concat(regexp_replace(host, '^www\.', ''), regexp_replace(path, '/+$', ''), CASE WHEN query <> '' THEN '?' || query ELSE '' END), '') AS canon
  FROM parts),
listed AS (
  SELECT DISTINCT canon FROM named
  WHERE canon <> '' AND try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
distinct_pages AS (SELECT DISTINCT host, path FROM named),
best AS (
  SELECT p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM distinct_pages p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.host, p.path)
SELECT n.page_id, n.host, n.path, b.rule,
       coalesce(b.verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canon IS NOT NULL AS listed
FROM named n LEFT JOIN best b ON n.host = b.host AND n.path = b.path LEFT JOIN listed l ON n.canon = l.canon
""",
    "op4_suffix_dedup": """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, i, array_slice(b, i, i + 199) AS s FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM docs WHERE octet_length(b) >= 200)),
twice AS (SELECT s FROM starts GROUP BY s HAVING count(*) > 1),
hits AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS begins FROM starts SEMI JOIN twice USING (s)),
runs AS (SELECT r, i, sum(begins::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM hits),
spans AS (SELECT r, k, min(i) AS a, max(i) + 199 AS z FROM runs GROUP BY r, k),
pieces AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY k), 0) + 1 AS a, a - 1 AS z FROM spans
  UNION ALL SELECT r, coalesce(max(s.z), 0) + 1, any_value(octet_length(b)) FROM docs LEFT JOIN spans s USING (r) GROUP BY r),
kept AS (SELECT r, unhex(string_agg(hex(array_slice(b, a, z)), '' ORDER BY a)) AS left_over FROM pieces JOIN docs USING (r) WHERE a <= z GROUP BY r),
counts AS (SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(left_over, ''::BLOB)) AS kept_sha256
FROM docs LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
""",
    "op7_substring_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(words[i : i + 49], ' ') AS w
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE doc_id IS NOT NULL AND len(words) >= 50)),
firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM windows JOIN firsts USING (w) WHERE least < doc_id),
each AS (SELECT r, unnest(range(1, len(words) + 1)) AS k, unnest(words) AS word FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM each ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
""",
    "op11_filter_audit": r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN least < d.doc_id THEN 'E' ELSE '' END) AS failed
  FROM docs d JOIN firsts USING (text) LEFT JOIN said s ON d.doc_id = s.doc_id),
masks AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, failed),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
each AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, n, good, toxic, failed, contains(failed, substr(filter_order, step, 1)) AS fails,
         translate(failed, substr(filter_order, 1, step - 1), '') <> failed AS gone_before, translate(failed, substr(filter_order, 1, step), '') <> failed AS gone_after
  FROM masks, steps),
told AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, x, coalesce(sum(n) FILTER (NOT gone_after), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone_before), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND gone_before), 0) AS redundant, coalesce(sum(n) FILTER (failed = x), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone_before), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone_before), 0) AS toxic_lost
  FROM each GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM told
""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_dot_product(a.x, v.x) AS BIGINT) AS score
  FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
""",
}
