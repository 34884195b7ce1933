"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, license_scan, line_dedup, ordinal, quality_rules, simhash, token_codec, url_rules, warc

#: Fixed rules of the URL query.
URL_RULES = [
    url_rules.UrlRule("allow", "com", "/"),
    url_rules.UrlRule("block", "example.com", "/en/"),
    url_rules.UrlRule("allow", "www.example.com", "/en/"),
    url_rules.UrlRule("block", "net", "/es/"),
    url_rules.UrlRule("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_codec.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return files.digests().select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.contamination(docs, items, width=10).drop("d", "th")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM bl)),
dg AS (SELECT r, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g
       FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d JOIN (SELECT DISTINCT k FROM bg) ON len(w) >= k)),
m AS (SELECT r, i, dg.k, item_id FROM dg JOIN bg ON dg.k = bg.k AND dg.g = bg.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT page_id, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS rn
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.rn = 1
"""



def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.select("record_id", "canonical_url", "ts", "kind", "base_id", "outcome", headers.alias("headers"))


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, url, html, substr(md5(coalesce(url, '')), 1, 1) AS digit, '"' || md5(coalesce(html, '')) || '"' AS tag,
         regexp_replace(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '(?s)#.*$', '') AS rest
  FROM pages),
c AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', '') AS host,
         coalesce(nullif(rtrim(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/{2,}', '/', 'g'), '/'), ''), '/') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_full_match(lower(split_part(x, '=', 1)), 'utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid'))) AS q
  FROM u),
k AS (SELECT *, CASE WHEN url IS NULL THEN NULL ELSE host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS cu FROM c),
r AS (
  SELECT page_id * 2 AS record_id, cu, page_id AS ts, CASE WHEN digit = '5' THEN 'other' ELSE 'response' END AS kind,
         MAP {'etag': tag, 'last-modified': 'monday', 'content-length': CAST(length(coalesce(html, '')) AS VARCHAR)} AS h
  FROM k
  UNION ALL
  SELECT page_id * 2 + 1, cu, page_id + 1000, 'revisit',
         CASE WHEN digit IN ('0', '1') THEN MAP {'etag': 'W/' || tag, 'date': 'later'}
              WHEN digit = '2' THEN MAP {'last-modified': 'monday', 'expires': 'soon'}
              WHEN digit = '3' THEN MAP {'etag': '"changed"'}
              WHEN digit = '4' THEN MAP {'server': 'cache'}
              ELSE MAP {'etag': tag, 'cache-control': 'max-age=60', 'content-length': '0'} END
  FROM k),
b AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER w AS bid,
            last_value(CASE WHEN kind = 'response' THEN h END IGNORE NULLS) OVER w AS bh
  FROM r WINDOW w AS (PARTITION BY cu ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (
  SELECT *, CASE WHEN kind <> 'revisit' THEN 'full' WHEN bid IS NULL OR cu IS NULL THEN 'missing'
                 WHEN h['etag'] IS NOT NULL AND bh['etag'] IS NOT NULL THEN CASE WHEN regexp_replace(h['etag'], '^W/', '') = regexp_replace(bh['etag'], '^W/', '') THEN 'resolved' ELSE 'mismatch' END
                 WHEN h['last-modified'] IS NOT NULL AND bh['last-modified'] IS NOT NULL THEN CASE WHEN h['last-modified'] = bh['last-modified'] THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unvalidated' END AS outcome
  FROM b)
SELECT record_id, cu AS canonical_url, ts, kind, CASE WHEN outcome IN ('resolved', 'unvalidated') THEN bid END AS base_id, outcome,
       array_to_string(list_sort(list_transform(map_entries(CASE WHEN outcome = 'resolved' THEN map_concat(bh, map_from_entries(list_filter(map_entries(h), lambda e: e.key <> 'content-length'))) ELSE h END),
                       lambda e: e.key || ': ' || e.value)), chr(10)) AS headers
FROM o
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).drop("spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), wide=True, short=True)
    return slim.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return quality_rules.judge(docs, good, base=base).select("doc_id", *quality_rules.STATS, "base_failed", "kept")


#: A document stays if its chance of the highest grade reaches this.
KEEP_TAIL = 0.6


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit_grades(docs, ordinal.quality_grades(table(spark, sf_dir, "labels")), n_grades=3)
    scored = ordinal.score_grades(docs, model, tail=2)
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP_TAIL).alias("kept"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_texts_column(docs, ranks, public_tokenizers.PATTERN, ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_simhash": op9_simhash,
    "op10_byte_bpe": op10_byte_bpe,
}

SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op4_warc_revisits": OP4_SQL,
}
