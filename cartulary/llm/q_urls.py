"""The URL query: five rules, and a list that names the pages of known spam hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.llm.registry import query, table
from cartulary.llm.urls import Rule, canonical, host_of, judge_urls, path_of

RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
# Names in the first labels of hosts whose pages go on the list.
SPAM_NAMES = "adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm"

OP9_SQL = rf"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
rules(name, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
ruled AS (
  SELECT p.*, regexp_replace(p.host, '^(?:www|m)\.', '') || regexp_replace(p.path, '(?:/|\.html)$', '') AS canonical,
    (SELECT max_by(r.name, length(r.name)) FROM rules r
      WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule
  FROM parts p
),
listed AS (
  SELECT DISTINCT canonical FROM ruled WHERE regexp_matches(host, '^(?:[a-z]+\.)?(?:{SPAM_NAMES})\.')
)
SELECT u.page_id, u.host, u.path, u.rule,
  CASE WHEN u.rule IS NOT NULL THEN (SELECT verdict FROM rules r WHERE r.name = u.rule)
       WHEN u.host <> '' AND u.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled u
"""


def spam_list(pages):
    """The list of the query: canonical URLs of all pages on spam hosts."""
    parts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    spam = parts.where(F.col("host").rlike(rf"^(?:[a-z]+\.)?(?:{SPAM_NAMES})\."))
    return spam.select(canonical(F.col("host"), F.col("path")).alias("canonical"))


@query("op9_url_filter", OP9_SQL)
def op9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES, spam_list(pages))
