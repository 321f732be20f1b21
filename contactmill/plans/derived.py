"""Input tables of the registered queries, derived from the parquet tables with portable SQL.

The same text runs in Spark and in the SQL twin (as a common table expression), so both sides start from
identical rows.  Every derived table scales with the parquet tables it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")

URLS = """
SELECT c_custkey AS id,
 CASE c_custkey % 10
  WHEN 0 THEN concat('https://www.instagram.com/user', c_custkey, '/')
  WHEN 1 THEN concat('https://in.linkedin.com/in/user-', c_custkey)
  WHEN 2 THEN concat('https://www.linkedin.com/company/acme-', c_custkey % 50, '/')
  WHEN 3 THEN concat('https://www.youtube.com/@chan', c_custkey)
  WHEN 4 THEN concat('https://www.facebook.com/groups/g', c_custkey % 30)
  WHEN 5 THEN concat('https://www.yelp.com/biz/shop-', c_custkey)
  WHEN 6 THEN concat('https://x.com/u', c_custkey)
  WHEN 7 THEN concat('ftp://bad.example.com/', c_custkey)
  WHEN 8 THEN concat('https://help.linkedin.com/x/', c_custkey)
  ELSE concat('https://www.site', c_custkey % 25, '.example.com/contact') END AS url,
 lower(concat('Group travel ', n_name)) AS search_query,
 concat('icp_', n_regionkey) AS icp_identifier,
 CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS processed,
 CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * CAST(c_custkey % 720 AS INT) AS created_at
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

AS_OF_SQL = "TIMESTAMP '2024-02-15 12:00:00'"


def as_of() -> Column:
    """The fixed clock of the registered queries."""
    return F.lit("2024-02-15 12:00:00").cast("timestamp")


# Paths of many sites, for the rules that look at the path rather than the host.
SITE_URLS = """
SELECT o_orderkey AS id,
 CASE o_orderkey % 24
  WHEN 0 THEN concat('https://www.instagram.com/reel/R', o_orderkey, '/')
  WHEN 1 THEN concat('https://www.instagram.com/p/P', o_orderkey, '/')
  WHEN 2 THEN concat('https://www.instagram.com/explore/tags/t', o_orderkey)
  WHEN 3 THEN concat('https://www.youtube.com/watch?v=v', o_orderkey)
  WHEN 4 THEN concat('https://www.youtube.com/shorts/s', o_orderkey)
  WHEN 5 THEN concat('https://youtu.be/y', o_orderkey)
  WHEN 6 THEN concat('https://www.facebook.com/profile.php?id=', o_orderkey)
  WHEN 7 THEN concat('https://www.facebook.com/events/', o_orderkey)
  WHEN 8 THEN concat('https://www.facebook.com/page', o_orderkey, '/posts/', o_orderkey)
  WHEN 9 THEN concat('https://www.facebook.com/pages/shop', o_orderkey)
  WHEN 10 THEN concat('https://www.facebook.com/user.', o_orderkey)
  WHEN 11 THEN 'https://www.facebook.com/marketplace'
  WHEN 12 THEN concat('https://www.linkedin.com/posts/user_topic-activity-', o_orderkey, '-aBc')
  WHEN 13 THEN concat('https://www.linkedin.com/newsletters/weekly-', o_orderkey, '/')
  WHEN 14 THEN concat('https://www.linkedin.com/jobs/view/', o_orderkey)
  WHEN 15 THEN concat('https://www.thomasnet.com/suppliers/s', o_orderkey)
  WHEN 16 THEN concat('https://www.indiamart.com/proddetail/p', o_orderkey, '.html')
  WHEN 17 THEN concat('https://www.crunchbase.com/organization/o', o_orderkey)
  WHEN 18 THEN concat('https://opencorporates.com/companies/gb/', o_orderkey)
  WHEN 19 THEN concat('https://shop', o_orderkey % 90, '.example.com/company/', o_orderkey)
  WHEN 20 THEN concat('https://news', o_orderkey % 90, '.example.com/search?q=', o_orderkey)
  WHEN 21 THEN concat('https://en.wikipedia.org/wiki/', o_orderkey)
  WHEN 22 THEN concat('www.bare', o_orderkey % 40, '.example.com/a')
  ELSE concat('https://blog', o_orderkey % 40, '.example.com/story/', o_orderkey) END AS url,
 CASE o_orderkey % 7 WHEN 0 THEN 'profile' WHEN 1 THEN 'website' WHEN 2 THEN 'community' WHEN 3 THEN 'event'
  WHEN 4 THEN 'video.other' WHEN 5 THEN 'business.business' ELSE NULL END AS og_type,
 o_orderkey % 5 = 0 AS is_video
FROM orders
"""

CONTACTS = """
SELECT c_custkey AS id,
 CASE c_custkey % 5 WHEN 0 THEN 'instagram' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'youtube' WHEN 3 THEN 'facebook' ELSE 'web' END AS platform,
 concat('https://', CASE c_custkey % 5 WHEN 0 THEN 'www.instagram.com/u' WHEN 1 THEN 'www.linkedin.com/in/u' WHEN 2 THEN 'www.youtube.com/@u' WHEN 3 THEN 'www.facebook.com/u' ELSE 'www.example.com/u' END, c_custkey) AS url,
 CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'Sign Up' ELSE c_name END AS full_name,
 CASE WHEN c_custkey % 4 = 0 THEN concat('Info', c_custkey % 60, '@mail.example.com') WHEN c_custkey % 17 = 0 THEN 'broken@' ELSE NULL END AS email,
 CASE WHEN c_custkey % 3 = 0 THEN concat('+1 (555) 01', CAST(c_custkey % 9 AS VARCHAR(1)), '-', lpad(CAST(c_custkey % 900 AS VARCHAR(4)), 4, '0')) ELSE NULL END AS phone,
 lower(c_mktsegment) AS industry, n_name AS location, concat('icp_', n_regionkey) AS icp_identifier,
 c_acctbal AS score,
 CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * CAST(c_custkey % 720 AS INT) AS scraped_at
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

PAGES_JSONLD = """
SELECT page_id, url, concat(html, '<a href="mailto:sales', page_id, '@shop.example.com?subject=x">Mail</a><a href="tel:+1-555-010-', lpad(CAST(page_id % 900 AS VARCHAR(4)),4,'0'), '">Call</a><script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","name":"', s_name, '","telephone":"+1 555 010 ', lpad(CAST(page_id % 900 AS VARCHAR(4)),4,'0'), '","email":"office', s_suppkey, '@org.example.com","address":{"streetAddress":"', page_id, ' Main Street","addressCountry":"', n_name, '"}}</script>') AS html
FROM pages JOIN supplier ON s_suppkey = page_id % 10 JOIN nation ON s_nationkey = n_nationkey
"""

# Saved pages with social meta tags, company links, team sections and embedded script fields.
PAGES_RICH = """
SELECT page_id, url, concat('<head><meta property="og:title" content="Shop ', page_id, ' (@shop.', page_id, ') • Instagram photos"><meta property="og:type" content="', CASE page_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'video.other' ELSE 'business.shop' END, '"><meta property="og:url" content="https://www.instagram.com/p/C', page_id, '/"><meta property="og:description" content="', page_id % 90, 'K likes: &quot;trip ', page_id, '&quot;"><meta name="description" content="', page_id % 90, '.5K likes, ', page_id % 9 + 1, ',', lpad(CAST(page_id % 900 AS VARCHAR(4)), 3, '0'), ' comments - shop.', page_id, ' on July ', page_id % 28 + 1, ', 2025"><meta name="twitter:title" content="Shop (@tw', page_id, ') • Instagram"></head>', html, '<div class="team">', CASE page_id % 4 WHEN 0 THEN 'Anna Berg, Managing Director. Omar Diaz - Analyst.' WHEN 1 THEN 'CEO: Maria Rossi' WHEN 2 THEN 'Group travel and charter bus booking for 250 employees' ELSE 'Get a quote for your team outing' END, '</div><a href="/company/c', page_id % 40, '">Acme company</a><a href="https://www.linkedin.com/company/c', page_id, '">Group ltd</a><a href="/contact">Contact</a><script>{"username":"shop.', page_id, '","is_verified":', CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"edge_followed_by":{"count":', page_id * 37, '},"viewCount":"', page_id * 11, '"}</script><footer>Call 415-555-', lpad(CAST(page_id % 9000 AS VARCHAR(5)), 4, '0'), ' or write to team', page_id % 70, '@firm.example.org</footer>') AS html
FROM pages
"""

RUN_LOG = """
SELECT event_id, ts, CASE user_id % 5 WHEN 0 THEN 'instagram' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'youtube' WHEN 3 THEN 'facebook' ELSE 'web_scraper' END AS scraper,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'signup_page' ELSE 'success' END AS status,
 CASE WHEN event_type='error' THEN CASE event_id % 6 WHEN 0 THEN 'HTTP 429 Too Many Requests' WHEN 1 THEN 'HTTP 401 Unauthorized' WHEN 2 THEN 'HTTP 403 Forbidden' WHEN 3 THEN 'Connection timeout' WHEN 4 THEN 'Network error' ELSE 'Profile is private' END END AS message,
 CASE WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS http_status, value AS seconds FROM events
"""

DERIVED = {"fx_urls": URLS, "fx_site_urls": SITE_URLS, "fx_contacts": CONTACTS, "fx_pages": PAGES_JSONLD,
           "fx_rich": PAGES_RICH, "fx_run_log": RUN_LOG}


#: Rows of a narrow table that one task derives from. They are few bytes in the files, but each gives texts to work on.
ROWS_A_TASK = 50_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Give a scan that is too small to fill the cores (one file, one row group) as many partitions as there are cores.
    A scan of texts with enough splits, which is every large table, is returned as it is and never shuffled.

    With ``rows``, for tables whose rows are narrow, the partitions hold about that many rows each, however large the table
    is and however its files are cut: splits by bytes would grow to millions of such rows a task. Runs a count, which reads
    the footers only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        n = max(cores, -(-df.count() // rows))
    else:
        n = cores if df.rdd.getNumPartitions() < cores else None
    return df if n is None else df.repartition(n, F.rand(7))


# Tables whose rows cost much work each: texts and pages, and narrow ones that texts are derived from.
HEAVY = ("documents", "pages", "conversations")
NARROW = ("orders", "customer", "part")


class Tables:
    """Loads one directory of parquet tables; ``t.customer`` or ``t.fx_urls`` gives a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            return spread(df) if name in HEAVY else spread(df, ROWS_A_TASK) if name in NARROW else df
        if name in DERIVED:
            return self.sql(DERIVED[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        for name in BASE:
            if name in text:
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)


def twin(body: str, *names: str, **ctes: str) -> str:
    """SQL twin: the derived tables it reads as common table expressions, then ``body``."""
    parts = [f"{n} AS ({DERIVED[n]})" for n in names] + [f"{n} AS ({s})" for n, s in ctes.items()]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def sql_hits(expr: str, words) -> str:
    """Number of different words contained."""
    return "(" + " + ".join(f"CASE WHEN contains({expr}, {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def sql_rules(expr: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN {sql_any(expr, ws)} THEN {label if isinstance(label, (int, float)) else q(label)}"
                     for label, ws in rules)
    return f"CASE {whens} ELSE {default} END"


def sql_re(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


NETLOC = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"


def sql_netloc(expr: str) -> str:
    return NETLOC.format(expr)
