"""Item, notice, crawl and log views over the plain tables, each one SQL text that any engine reads the same way.

The tables hold invented words, so phrases are added by arithmetic on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from market_signals.session import bounded, spread

#: The time of every query.
AS_OF = "2024-01-31 00:00:00"
AS_OF_TEXT = "2024-01-31T00:00:00+00:00"

TITLES = [
    "Norway opens offshore wind seabed auction", "UK offshore wind CfD auction results announced", "New oil and gas drilling campaign planned",
    "Germany approves grid and transmission funding", "RWE and Orsted sign turbine contract notice", "Floating wind pilot in Scotland gets consultation",
    "Hydrogen electrolyser factory financing closes", "LNG refinery upstream update", "Equinor awards subsea cable tender",
    "Port supply chain investment in Denmark", "Battery storage market note", "Membership news", "Quiet day",
]
ENDINGS = ["", " in the North Sea", " says ministry", " with Vattenfall and Statkraft", " before 2026"]
NOTICES = [
    "Open tender: inspection of inter-array cables at an offshore wind site", "Marine survey framework agreement", "Strategy advisory for port development",
    "School building construction with offshore cable", "Funding call for floating wind pilot",
    "CfD auction prequalification round, offshore market analysis", "Road maintenance", "Geotechnical site investigation, marine",
]
DUE = ["Submission deadline 2024-02-10.", "Deadline 15.02.2024 at noon.", "Offers due 20 March 2024.", "Due 31.02.2024.", "Due 2024-13-45.", "", "Due 2024-01-31 sharp."]
COUNTRIES = ["NOR", "DNK", "GBR", "DEU", "NLD", "USA", "IRL", ""]
CATEGORIES = ["71354500", "79411100", "45000000", "00000000"]


def choose(number: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST(({number}) AS BIGINT) % {len(values)} {whens} END"


def over(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


def two(number: str) -> str:
    return f"lpad(CAST({number} AS STRING), 2, '0')"


_TITLE = f"{choose('doc_id', TITLES)} || {choose(over('doc_id', 13), ENDINGS)}"
NEWS_RAW = f"""
SELECT doc_id + 1 AS id, source AS source_name,
  'https://www.example.com/2024/story-about-' || CAST(CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS STRING) AS article_url,
  {_TITLE} AS title_raw,
  CASE WHEN doc_id % 17 = 0 THEN 'Paywalled content; no full access available.' WHEN doc_id % 11 = 0 THEN '' ELSE substring(text, 1, 500) END AS summary_raw,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE {_TITLE} || '. ' || text END AS content_raw,
  CASE WHEN doc_id % 19 = 0 THEN NULL ELSE '2024-01-' || {two('1 + doc_id % 30')} || 'T' || {two('doc_id % 24')} || ':' || {two('doc_id % 60')} || ':00+00:00' END AS published_at,
  '2024-01-31T00:' || {two('doc_id % 60')} || ':00+00:00' AS fetched_at
FROM documents
"""
_K = "CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey - 1 ELSE o_orderkey END"
NOTICE_RAW = f"""
SELECT o_orderkey + 1 AS id,
  {choose(_K, ['TED', 'DOFFIN', 'WORLDBANK'])} || '-' || CAST({_K} AS STRING) AS notice_id,
  {choose('o_orderkey', ['TED', 'DOFFIN', 'WORLDBANK'])} AS source_name,
  'https://notices.example.com/' || CAST(o_orderkey AS STRING) AS notice_url,
  {choose('o_orderkey', NOTICES)} AS title_raw, c_name AS buyer_raw, {choose('c_nationkey', COUNTRIES)} AS country_raw,
  CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE '2024-01-' || {two('1 + o_orderkey % 30')} END AS publication_date,
  {choose(over('o_orderkey', 8), DUE)} AS description_raw, {choose('o_orderkey', CATEGORIES)} AS cpv
FROM orders JOIN customer ON o_custkey = c_custkey
"""
_N = f"({NOTICE_RAW}) n"
NOTICE_JSON = f"""
SELECT id, source_name, CASE source_name
  WHEN 'TED' THEN '{{"publication-number":"' || CAST(id AS STRING) || '","notice-title":' ||
    CASE id % 3 WHEN 0 THEN '{{"eng":["' || title_raw || '"]}}' WHEN 1 THEN '{{"fra":["Avis"],"en":"' || title_raw || '"}}' ELSE '"' || title_raw || '"' END ||
    ',"buyer-name":{{"nor":["' || buyer_raw || '"]}},"buyer-country":' || CASE WHEN id % 2 = 0 THEN '["' || country_raw || '"]' ELSE '"' || country_raw || '"' END ||
    ',"publication-date":"' || publication_date || CASE WHEN publication_date <> '' THEN '+01:00' ELSE '' END || '","classification-cpv":' ||
    CASE WHEN id % 5 = 0 THEN '"' || cpv || '"' ELSE '["' || cpv || '"]' END || ',"notice-type":"' || CASE WHEN id % 7 = 0 THEN 'CAN-standard' ELSE 'CN-standard' END || '"' ||
    CASE WHEN id % 4 = 0 THEN ',"links":{{"html":{{"ENG":"' || notice_url || '"}}}}' ELSE '' END || '}}'
  WHEN 'DOFFIN' THEN '{{"id":"' || CAST(id AS STRING) || '","heading":"' || title_raw || '","buyer":[{{"name":"' || buyer_raw || '"}}],"publicationDate":"' || publication_date ||
    CASE WHEN publication_date <> '' THEN 'T08:00:00Z' ELSE '' END || '","cpvCodes":["' || cpv || '"],"description":"' || description_raw || '","status":"' ||
    CASE WHEN id % 5 = 0 THEN 'EXPIRED' ELSE 'ACTIVE' END || '","type":"' || CASE WHEN id % 3 = 0 THEN 'AWARD' ELSE 'COMPETITION' END || '"}}'
  ELSE '{{' || CASE WHEN id % 2 = 0 THEN '"id":"' ELSE '"procno":"' END || CAST(id AS STRING) || '",' || CASE WHEN id % 3 = 0 THEN '"project_name":"' ELSE '"title":"' END || title_raw ||
    '","borrower":"' || buyer_raw || '","countrycode":"' || CASE country_raw WHEN 'NOR' THEN 'NO' WHEN 'DNK' THEN 'dk' ELSE country_raw END || '","notice_date":"' || publication_date ||
    '","description":"' || description_raw || '"}}' END AS body
FROM {_N}
"""
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
CRAWL_PAGES = f"""
SELECT page_id, url, {_HOST} AS source,
  CASE WHEN page_id % 29 = 0 THEN 401 WHEN page_id % 31 = 0 THEN 403 WHEN page_id % 37 = 0 THEN 500 ELSE 200 END AS status_code,
  CASE WHEN page_id % 3 = 0 THEN 'application/rss+xml' ELSE 'text/html' END AS content_type,
  CASE WHEN page_id % 7 = 0 THEN replace(html, '<head>', '<head><link rel="alternate" type="application/rss+xml" href="/feed">') ELSE html END || CASE WHEN page_id % 13 = 0 THEN ' subscribe ' ELSE '' END AS html
FROM pages
"""
REGISTRY = f"""
SELECT h.position * 3 + k.k AS position, 'Source ' || h.host AS name,
  CASE WHEN h.position % 11 = 0 AND k.k = 0 THEN '' WHEN k.k = 1 THEN 'https://www.' || h.host || '/' ELSE h.host END AS homepage,
  CASE WHEN (h.position + k.k) % 3 = 0 THEN 'rss' ELSE 'scrape' END AS type,
  CASE WHEN (h.position + k.k) % 3 = 0 THEN 'https://' || h.host || '/rss' WHEN h.position % 11 = 0 AND k.k = 0 THEN '' ELSE 'https://' || h.host END AS url,
  (h.position + k.k) % 4 <> 0 AS enabled, (h.position + k.k) % 10 = 0 AS manual_override
FROM (SELECT host, row_number() OVER (ORDER BY host) AS position FROM (SELECT DISTINCT {_HOST} AS host FROM pages) x) h
JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) k ON k.k <= h.position % 3
"""
FETCH_LOG = """
SELECT CAST(CAST(ts AS DATE) AS STRING) AS run, 'src' || CAST(user_id % 20 AS STRING) AS source,
  sum(CASE WHEN event_type IN ('click', 'view', 'purchase', 'signup') THEN 1 ELSE 0 END) AS kept,
  CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 AND count(*) % 5 = 0 THEN 'timeout' END AS error
FROM events GROUP BY CAST(ts AS DATE), user_id % 20
"""
RELEVANCE_LOG = """
SELECT event_id, ts, user_id AS processed_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS relevance
FROM events WHERE event_type IN ('purchase', 'signup', 'error', 'view')
"""
OVERRIDE_LOG = """
SELECT event_id, ts, user_id AS processed_id, 'manual:' || CAST(event_id % 40 AS STRING) AS collection_key FROM events WHERE event_type = 'click'
"""
ENRICHMENT = f"""
SELECT id AS raw_item_id, CASE id % 12
  WHEN 0 THEN '{{"summary":"Model summary","theme_tags":["policy"," "],"geography_tags":[],"actors":["Equinor"],"confidence":0.9}}'
  WHEN 4 THEN 'Here it is: {{"summary":"","theme_tags":["finance","policy"],"geography_tags":["Norway"],"confidence":"84%"}}'
  ELSE 'no json here' END AS response,
  CASE (CAST(floor(id / 12) AS BIGINT)) % 5 WHEN 0 THEN '0.9' WHEN 1 THEN '84' WHEN 2 THEN '84%' WHEN 3 THEN 'high' ELSE 'unsure' END AS said
FROM ({NEWS_RAW}) n
"""
VIEWS = {
    "news_raw": NEWS_RAW, "notice_raw": NOTICE_RAW, "notice_json": NOTICE_JSON, "crawl_pages": CRAWL_PAGES, "registry": REGISTRY,
    "fetch_log": FETCH_LOG, "relevance_log": RELEVANCE_LOG, "override_log": OVERRIDE_LOG, "enrichment": ENRICHMENT,
}
TABLES = ("documents", "orders", "customer", "pages", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables at `sf_dir`. Pages, which go to Python, go in batches of bounded size."""
    if name == "crawl_pages":
        bounded(spark)
    sql = VIEWS[name]
    used = [t for t in TABLES if f" {t}" in sql.replace("\n", " ")]
    for t in used:
        sql = sql.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    literal = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in used if f"{{{t}}}" in sql}
    for i, (t, df) in enumerate(literal.items()):
        df.createOrReplaceTempView(f"ms_{t}")
        sql = sql.replace(f"{{{t}}}", f"ms_{t}")
    return spark.sql(sql)
