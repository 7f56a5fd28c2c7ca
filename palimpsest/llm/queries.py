"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, fim, html_main, importance, langid, mixing, neardup, secrets, sharding, spelling, tiff, tokens, url_rules
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text_report(table(spark, sf_dir, "pages"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_report(table(spark, sf_dir, "documents"))


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_report(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(table(spark, sf_dir, "documents"))


#: Sites (host, path, verdict) and patterns (pattern, verdict) of the URL filter.
SITES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PATTERNS = [
    ("||ads.", "block"), ("/adserver/", "block"), ("-pills.", "block"), ("casino", "block"), ("/login^", "block"), ("/cart^", "block"), ("/print/", "block"),
    ("^sessionid=", "block"), ("^replytocom=", "block"), (".exe|", "block"), (".zip|", "block"), ("||blog.*^page=", "block"), ("||docs.", "allow"), ("^utm_source=feed|", "allow"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judged(pages, url_rules.rule_table(spark, SITES, url_rules.SITE_COLUMNS), url_rules.rule_table(spark, PATTERNS, url_rules.PATTERN_COLUMNS)).select("page_id", "host", "path", "rule", "pattern", "verdict")


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_language": op2_language,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_main_text": op5_main_text,
    "op6_media": op6_media,
    "op7_importance": op7_importance,
    "op8_sharding": op8_sharding,
    "op9_secrets": op9_secrets,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling": op12_spelling,
    "op13_url_filter": op13_url_filter,
}

ORACLES: dict[str, str] = {
    # The documents of a source in hash order, up to the budget; the one across it if that brings the sum nearer.
    "op3_mixing": r"""
WITH base AS (
  SELECT doc_id, source AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS words, CASE (row_number() OVER (ORDER BY s NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM base GROUP BY s),
filling AS (
  SELECT *, row_number() OVER w AS place,
         (CAST(sum(words) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) - CAST(coalesce(sum(words) OVER (ORDER BY words / weight, s NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * CAST(2 AS DOUBLE))
         / CAST(sum(weight) OVER (ORDER BY words / weight, s NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS lvl
  FROM src WINDOW w AS (ORDER BY words / weight, s NULLS LAST)),
targets AS (
  SELECT s, words, coalesce(least(words * CAST(2 AS DOUBLE), weight * (SELECT arg_min(lvl, place) FROM filling WHERE words * CAST(2 AS DOUBLE) > lvl * weight)), words * CAST(2 AS DOUBLE)) AS target
  FROM filling),
parts AS (
  SELECT *, CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END AS passes FROM targets),
sums AS (
  SELECT b.doc_id, b.size, p.words AS source_size, p.target, p.passes, p.target - p.passes * p.words AS rest,
         CAST(sum(b.size) OVER (PARTITION BY b.s ORDER BY b.h) AS BIGINT) AS upto,
         CAST(sum(b.size) OVER (PARTITION BY b.s, b.h) AS BIGINT) AS own
  FROM base b JOIN parts p ON b.s IS NOT DISTINCT FROM p.s)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sums
""",
    # Equal words, anywhere: words by position, windows by their first word, and hits as the positions they cover.
    "op4_decontamination": r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
  FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM doc_words, lengths, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)),
found AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x USING (n, phrase)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found), unnest(range(0, n)) AS u(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
""",
    # All pairs by their common shingles, and the closure of the links.
    "op10_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS g
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b),
least_one AS (SELECT a AS doc_id, min(b) AS b FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_one l USING (doc_id)
""",
    # Units as a list, cut by rank; the rebuilt text of a sound output is the text.
    "op11_fill_in_middle": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
cuts AS (
  SELECT *, array_to_string(w[1 : least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(w[greatest(a, b) + 1 : n], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM cuts
""",
    # Every rule on every URL.
    "op13_url_filter": r"""
WITH places AS (
  SELECT row_number() OVER () AS k, page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
sites(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
patterns(pattern, v, re) AS (VALUES
  ('||ads.', 'block', '^[a-z0-9+.-]*://([^/?#]*[.])?ads[.]'), ('/adserver/', 'block', '/adserver/'), ('-pills.', 'block', '-pills[.]'), ('casino', 'block', 'casino'),
  ('/login^', 'block', '/login([^a-z0-9_.%-]|\z)'), ('/cart^', 'block', '/cart([^a-z0-9_.%-]|\z)'), ('/print/', 'block', '/print/'), ('^sessionid=', 'block', '[^a-z0-9_.%-]sessionid='),
  ('^replytocom=', 'block', '[^a-z0-9_.%-]replytocom='), ('.exe|', 'block', '[.]exe\z'), ('.zip|', 'block', '[.]zip\z'), ('||blog.*^page=', 'block', '(?s)^[a-z0-9+.-]*://([^/?#]*[.])?blog[.].*[^a-z0-9_.%-]page='),
  ('||docs.', 'allow', '^[a-z0-9+.-]*://([^/?#]*[.])?docs[.]'), ('^utm_source=feed|', 'allow', '[^a-z0-9_.%-]utm_source=feed\z')),
by_site AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM places, sites WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY k),
by_pattern AS (
  SELECT k, min(CASE WHEN v = 'allow' THEN pattern END) AS yes, min(CASE WHEN v = 'block' THEN pattern END) AS no FROM places, patterns WHERE regexp_matches(u, re) GROUP BY k)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN coalesce(yes, no) END AS pattern, coalesce(s.v, CASE WHEN yes IS NULL AND no IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM places LEFT JOIN by_site s USING (k) LEFT JOIN by_pattern USING (k)
""",
}
