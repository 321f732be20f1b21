"""URL queries and their SQL twins."""

from pyspark.sql import functions as F

from contactmill.functions import text as X
from contactmill.functions import url_rules as R
from contactmill.operators import pages as P
from contactmill.operators import urls as U
from contactmill.plans.catalog import query
from contactmill.plans.derived import AS_OF_SQL, as_of, q, sql_any, sql_netloc, sql_re, sql_rules, twin

EPOCH = "CAST(floor(epoch({0})) AS BIGINT)"

HOST = f"regexp_replace(lower({sql_netloc('url')}), '^www\\.', '')"
VALID = (f"(regexp_matches(url, '^https?://') AND length(url) <= 2000 AND {sql_re('url', R.URL_SHAPE)})")


def _type_sql(host=HOST):
    whens = " ".join(
        f"WHEN {' OR '.join(f'{host} = {q(h)} OR ends_with({host}, {q(chr(46) + h)})' for h in hosts)} THEN {q(n)}"
        for n, hosts in R.PLATFORM_HOSTS)
    return f"CASE {whens} WHEN {sql_any(host, R.DIRECTORY_HOSTS)} THEN 'company_directory' ELSE 'general' END"


TYPE = _type_sql()
ALL_URLS = "SELECT id, url FROM fx_urls UNION ALL SELECT id + 1000000000, url FROM fx_site_urls"
QUEUE = f"SELECT *, {TYPE} AS url_type FROM fx_urls WHERE {VALID}"


def all_urls(t):
    return t.fx_urls.select("id", "url").unionAll(t.fx_site_urls.select(F.col("id") + 1000000000, "url"))


def queue(t):
    return U.filter_valid_urls(t.fx_urls)


def column_query(name, column, sql, source="all_urls"):
    """One column rule over every URL."""
    with_all = dict(all_urls=ALL_URLS)

    @query(name, twin(f"SELECT id, {sql} AS result FROM all_urls", "fx_urls", "fx_site_urls", **with_all))
    def run(t):
        return all_urls(t).select("id", column().alias("result"))


column_query("url_valid", lambda: U.url_valid("url"), VALID)
column_query("url_type", lambda: U.url_type("url"), TYPE)
column_query("url_bucket", lambda: U.url_bucket("url"), sql_rules(f"lower({sql_netloc('url')})", R.BUCKETS, "'general'"))
column_query("url_platform", lambda: U.url_platform("url"),
             sql_rules(f"lower({sql_netloc('url')})", R.CONTACT_PLATFORMS, "'unknown'"))
FULL = "CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END"
column_query("url_domain", lambda: U.url_domain("url"), f"nullif(regexp_replace({sql_netloc(FULL)}, '^www\\.', ''), '')")
LI_HOST = f"lower({sql_netloc('url')})"
column_query("linkedin_url_filter", lambda: U.linkedin_url_keep("url"),
             f"(NOT {sql_re('url', R.LINKEDIN_REJECT)} AND {sql_re('url', R.LINKEDIN_ACCEPT)} AND "
             f"({LI_HOST} = 'www.linkedin.com' OR regexp_matches({LI_HOST}, '^[^.][^.]\\..*linkedin\\.com$')))")
LI_TYPE = ("CASE WHEN contains(lower(url), '/company/') THEN 'company' WHEN contains(lower(url), '/newsletters/') THEN "
           "'newsletter' WHEN contains(lower(url), '/in/') THEN 'profile' WHEN contains(lower(url), '/posts/') THEN "
           "'post' ELSE 'unknown' END")
column_query("linkedin_url_type", lambda: U.linkedin_url_type("url"), LI_TYPE)
column_query("linkedin_username", lambda: U.linkedin_username("url"),
             f"CASE {LI_TYPE} WHEN 'profile' THEN regexp_extract(url, 'linkedin\\.com/in/([^/?]+)', 1) "
             "WHEN 'company' THEN regexp_extract(url, 'linkedin\\.com/company/([^/?]+)', 1) "
             "WHEN 'newsletter' THEN regexp_extract(url, 'linkedin\\.com/newsletters/([^/?]+)', 1) ELSE '' END")
column_query("youtube_page_type", lambda: U.youtube_page_type("url"),
             f"CASE WHEN NOT (regexp_matches(lower(url), '^https?://') AND {sql_any('lower(url)', ['youtube.com', 'youtu.be'])}) "
             "THEN 'invalid' WHEN contains(lower(url), '/shorts/') THEN 'shorts' WHEN contains(lower(url), '/watch?v=') "
             f"THEN 'video' WHEN {sql_any('lower(url)', ['/@', '/channel/', '/c/'])} THEN 'channel' ELSE 'unknown' END")
column_query("skip_url", lambda: U.skip_url("url"),
             f"(NOT regexp_matches(url, '^https?://') OR {sql_any('lower(url)', R.SKIPPED_URL_PARTS)})")


def _company_sql(u="lower(url)"):
    avoid, li, whens = sql_any(u, R.COMPANY_URL_AVOID), f"contains({u}, 'linkedin.com/company/')", []
    for site, paths in R.COMPANY_URL_SITES:
        on = f"contains({u}, {q(site)})"
        whens.append(f"WHEN {on} AND {sql_any(u, paths)} AND NOT {avoid} THEN true")
        if site == "thomasnet.com":
            whens.append(f"WHEN {on} AND {sql_any(u, R.THOMASNET_OWN)} THEN false")
        if site in ("thomasnet.com", "indiamart.com"):
            whens.append(f"WHEN {on} AND {li} THEN true")
    return f"CASE {' '.join(whens)} ELSE {sql_any(u, R.COMPANY_URL_WORDS)} AND NOT {avoid} END"


column_query("company_url", lambda: U.company_url("url"), _company_sql())
column_query("directory_search_url", lambda: U.directory_search_url("url", F.lit("steel pipe")),
             "CASE " + " ".join(f"WHEN contains(regexp_replace(url, '/+$', ''), {q(h)}) THEN concat(regexp_replace(url, '/+$', ''), "
                                f"{q(p)}, 'steel+pipe')" for h, p in R.DIRECTORY_SEARCH_PATHS) + " ELSE NULL END")


@query("instagram_content_type", twin(f"""
SELECT id, CASE WHEN NOT contains({sql_netloc('url')}, 'instagram.com') THEN 'unknown'
 WHEN contains(url, '/reel/') OR (contains(url, '/p/') AND is_video) THEN 'video'
 WHEN contains(url, '/p/') THEN 'article'
 WHEN regexp_matches(url, '^[a-z]+://[^/?#]*/+[A-Za-z0-9._]+/*([?#].*)?$') THEN 'profile' ELSE 'unknown' END AS result
FROM (SELECT id, url, is_video FROM fx_site_urls UNION ALL SELECT id + 1000000000, url, false FROM fx_urls)""",
                                      "fx_urls", "fx_site_urls"))
def instagram_content_type(t):
    rows = t.fx_site_urls.select("id", "url", "is_video").unionAll(
        t.fx_urls.select(F.col("id") + 1000000000, "url", F.lit(False)))
    return rows.select("id", U.instagram_content_type("url", "is_video").alias("result"))


@query("facebook_url_type", twin(r"""
SELECT id, CASE WHEN regexp_matches(url, 'facebook\.com/profile\.php\?id=\d+') THEN 'profile'
 WHEN regexp_matches(url, 'facebook\.com/groups/[^/]+') THEN 'group'
 WHEN regexp_matches(url, 'facebook\.com/events/[^/]+') THEN 'event'
 WHEN regexp_matches(url, 'facebook\.com/[^/]+/posts/\d+') OR regexp_matches(url, 'facebook\.com/story\.php\?story_fbid=\d+&id=\d+') THEN 'post'
 WHEN regexp_matches(url, 'facebook\.com/(pages|pg)/[^/]+') OR regexp_matches(url, 'facebook\.com/[^/]+/about/?') THEN 'page'
 WHEN og_type = 'profile' THEN 'profile' WHEN og_type IN (""" + ", ".join(q(v) for v in R.FACEBOOK_PAGE_OG) + r""") THEN 'page'
 WHEN og_type = 'community' THEN 'group' WHEN og_type = 'event' THEN 'event' WHEN og_type = 'video.other' THEN 'post'
 WHEN regexp_matches(url, 'facebook\.com/[a-zA-Z0-9_.]+$') AND NOT """ + sql_re("url", R.FACEBOOK_SYSTEM) + """ THEN 'page'
 ELSE 'unknown' END AS result FROM fx_site_urls""", "fx_site_urls"))
def facebook_url_type(t):
    return t.fx_site_urls.select("id", U.facebook_url_type("url", "og_type").alias("result"))


@query("page_type", f"""
SELECT page_id, CASE WHEN {sql_any('lower(url)', R.SEARCH_URL_MARKS)} AND {sql_any('lower(html)', R.SEARCH_PAGE_WORDS)} THEN 'search_results'
 WHEN {sql_any('lower(url)', R.DIRECTORY_URL_WORDS)} AND {sql_any('lower(html)', R.DIRECTORY_PAGE_WORDS)} THEN 'company_directory'
 WHEN {sql_any('lower(url)', R.PROFILE_URL_WORDS)} AND {sql_any('lower(html)', R.PROFILE_PAGE_WORDS)} THEN 'company_profile'
 WHEN {sql_any('lower(html)', R.LISTING_PAGE_WORDS)} THEN 'company_directory' ELSE 'unknown' END AS page_type,
 CASE WHEN {sql_any('lower(html)', R.SITE_KIND_DIRECTORY_WORDS)} OR {sql_any('lower(url)', R.SITE_KIND_DIRECTORY_URLS)} THEN 'company_directory'
 WHEN {sql_any('lower(url)', R.SITE_KIND_SOCIAL)} THEN 'social_media' WHEN {sql_any('lower(html)', R.SITE_KIND_NEWS)} THEN 'news_article'
 WHEN {sql_any('lower(html)', R.SITE_KIND_LISTING)} THEN 'business_listing' ELSE 'generic' END AS site_kind
FROM pages""")
def page_type(t):
    return t.pages.select("page_id", U.page_type("url", "html").alias("page_type"),
                          U.site_kind("url", "html").alias("site_kind"))


@query("filter_valid_urls", twin("SELECT id, url, url_type FROM queue", "fx_urls", queue=QUEUE))
def filter_valid_urls(t):
    return queue(t).select("id", "url", "url_type")


@query("url_valid_counts", twin(f"SELECT count(*) FILTER ({VALID}) AS valid, count(*) FILTER (NOT {VALID}) AS invalid FROM fx_urls", "fx_urls"))
def url_valid_counts(t):
    return U.valid_counts(t.fx_urls)


# Stored table for the ingest: the URLs of every seventh customer; arrivals are all of them.
STORED = "SELECT * FROM fx_urls WHERE id % 7 = 0"


@query("url_ingest", twin(f"""
SELECT id, url, lower(search_query) AS search_query, {TYPE} AS url_type FROM
 (SELECT *, row_number() OVER (PARTITION BY url ORDER BY created_at, id) AS rn FROM fx_urls
  WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.url = fx_urls.url)) WHERE rn = 1""", "fx_urls", stored=STORED))
def url_ingest(t):
    u = t.fx_urls
    return U.url_ingest(u, u.filter("id % 7 = 0"), as_of()).select("id", "url", "search_query", "url_type")


@query("url_ingest_counts", twin("""
SELECT count(*) AS total, count(DISTINCT url) FILTER (url NOT IN (SELECT url FROM stored)) AS new_urls,
 count(*) - count(DISTINCT url) FILTER (url NOT IN (SELECT url FROM stored)) AS duplicates FROM fx_urls""", "fx_urls", stored=STORED))
def url_ingest_counts(t):
    u = t.fx_urls
    return U.ingest_counts(u, u.filter("id % 7 = 0"))


@query("insert_if_absent", twin("SELECT id, url FROM fx_urls WHERE url NOT IN (SELECT url FROM stored)", "fx_urls", stored=STORED))
def insert_if_absent(t):
    u = t.fx_urls
    return u.join(u.filter("id % 7 = 0").select("url"), "url", "left_anti").select("id", "url")


@query("urls_by_query", twin("SELECT id, url FROM queue WHERE search_query = lower('Group Travel NATION_3')", "fx_urls", queue=QUEUE))
def urls_by_query(t):
    return U.urls_by(queue(t), search_query="Group Travel NATION_3").select("id", "url")


@query("urls_by_type", twin("SELECT id, url FROM queue WHERE url_type = 'linkedin'", "fx_urls", queue=QUEUE))
def urls_by_type(t):
    return U.urls_by(queue(t), url_type="linkedin").select("id", "url")


@query("urls_by_query_and_type", twin("SELECT count(*) AS n FROM queue WHERE search_query = 'group travel nation_3' AND url_type = 'instagram'", "fx_urls", queue=QUEUE))
def urls_by_query_and_type(t):
    return U.urls_by(queue(t), "group travel nation_3", "instagram").agg(F.count("*").alias("n"))


@query("urls_by_type_and_icp", twin("SELECT id, url FROM queue WHERE url_type = 'youtube' AND icp_identifier = 'icp_2'", "fx_urls", queue=QUEUE))
def urls_by_type_and_icp(t):
    return U.urls_by(queue(t), url_type="youtube", icp_identifier="icp_2").select("id", "url")


@query("urls_unprocessed", twin("SELECT id, url FROM queue WHERE NOT coalesce(processed, false)", "fx_urls", queue=QUEUE))
def urls_unprocessed(t):
    return U.urls_unprocessed(queue(t)).select("id", "url")


@query("urls_unprocessed_page", twin("SELECT id, url FROM queue WHERE NOT coalesce(processed, false) ORDER BY created_at, id LIMIT 50", "fx_urls", queue=QUEUE))
def urls_unprocessed_page(t):
    return U.urls_unprocessed(queue(t), limit=50).select("id", "url")


LISTED = "SELECT url FROM fx_urls WHERE id % 4 = 1"


@query("urls_mark_processed", twin(f"""
SELECT id, url IN (SELECT url FROM listed) AS modified,
 CASE WHEN url IN (SELECT url FROM listed) THEN true ELSE processed END AS processed,
 CASE WHEN url IN (SELECT url FROM listed) THEN {AS_OF_SQL} END AS processed_at FROM queue""", "fx_urls", queue=QUEUE, listed=LISTED))
def urls_mark_processed(t):
    listed = t.fx_urls.filter("id % 4 = 1").select("url")
    return (U.urls_mark_processed(queue(t), listed, as_of()).select("id", "modified", "processed", "processed_at"))


@query("mark_by_list", twin("SELECT count(*) AS modified FROM queue WHERE url IN (SELECT url FROM listed)", "fx_urls", queue=QUEUE, listed=LISTED))
def mark_by_list(t):
    listed = t.fx_urls.filter("id % 4 = 1").select("url")
    return U.urls_mark_processed(queue(t), listed, as_of()).agg(F.count_if("modified").alias("modified"))


@query("url_type_stats", twin("SELECT url_type, count(*) AS n FROM queue GROUP BY url_type", "fx_urls", queue=QUEUE))
def url_type_stats(t):
    return U.url_type_stats(queue(t))


@query("url_available_counts", twin("SELECT url_type, count(*) FILTER (NOT coalesce(processed, false)) AS available FROM queue GROUP BY url_type", "fx_urls", queue=QUEUE))
def url_available_counts(t):
    return U.url_available_counts(queue(t))


@query("url_db_stats", twin("SELECT count(*) AS total, count(DISTINCT search_query) AS queries, count(DISTINCT url_type) AS types FROM queue", "fx_urls", queue=QUEUE))
def url_db_stats(t):
    return U.url_db_stats(queue(t))


@query("url_type_share", twin("SELECT url_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM queue), 4)::DOUBLE AS pct FROM queue GROUP BY url_type", "fx_urls", queue=QUEUE))
def url_type_share(t):
    return U.url_type_share(queue(t))


PICKED = ["instagram", "linkedin", "web_scraper", "reddit"]
FILTERS = [(n, f) for n, _, f, _ in R.SOURCES if n in PICKED and f]
BASE_QUERIES = "SELECT c_custkey AS id, concat(lower(c_mktsegment), CASE WHEN c_custkey % 2 = 0 THEN ' sales Director ' ELSE ' club ' END, c_nationkey) AS query FROM customer"


@query("query_expand", twin("SELECT id, 'base' AS source, query AS expanded FROM base UNION ALL " + " UNION ALL ".join(
    f"SELECT id, {q(n)}, trim(concat(CASE WHEN {sql_any('lower(query)', ['director', 'manager', 'head'])} THEN "
    f"'intitle:(\"director\" OR \"manager\" OR \"head\") ' || query ELSE query END, ' ', {q(f)})) FROM base" for n, f in FILTERS),
                            base=BASE_QUERIES))
def query_expand(t):
    return U.query_expand(t.sql(BASE_QUERIES), PICKED).select("id", "source", "expanded")


LINES = ("list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(regexp_replace("
         "regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '^[0-9.\\-• \"'']+', ''), '[\"'']+$', '')), lambda s: length(s) > {0})")


@query("query_clean", f"""
WITH l AS (SELECT conv_id, turn, {LINES.format(15)} AS lines FROM conversations)
SELECT conv_id, turn, CAST(i - 1 AS INT) AS pos, lines[i] AS query FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)""")
def query_clean(t):
    return U.query_clean(t.conversations.select("conv_id", "turn", "text"), "text")


@query("query_clean_top", f"""
WITH l AS (SELECT doc_id, {LINES.format(10)} AS lines FROM documents),
 d AS (SELECT doc_id, list_filter(lines, lambda s, i: list_position(lines, s) = i)[1:8] AS lines FROM l)
SELECT doc_id, CAST(i - 1 AS INT) AS pos, lines[i] AS query FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)""")
def query_clean_top(t):
    return U.query_clean(t.documents.select("doc_id", "text"), "text", min_length=10, top=8)


SOURCE_OF = "CASE url_type " + " ".join(f"WHEN {q(t)} THEN {q(n)}" for n, t, _, _ in R.SOURCES) + " END"


@query("route_urls", twin(f"SELECT id, url, {SOURCE_OF} AS source FROM queue WHERE {SOURCE_OF} IS NOT NULL", "fx_urls", queue=QUEUE))
def route_urls(t):
    return U.route_urls(queue(t)).select("id", "url", "source")


QUOTA = "CASE url_type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in R.QUOTAS.items()) + " ELSE 0 END"


@query("url_quota", twin(f"""
SELECT id, url_type, CAST(pick AS INT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY url_type ORDER BY md5(url), url, id) AS pick FROM queue)
WHERE pick <= {QUOTA}""", "fx_urls", queue=QUEUE))
def url_quota(t):
    return U.url_quota(queue(t)).select("id", "url_type", "pick")


ICP = "SELECT c_custkey AS id, concat(c_name, ' Tours & Co') AS product, concat('{\"product\": \"', c_name, '\"}') AS icp_json FROM customer"


@query("icp_identifier", twin(f"""
SELECT id, concat_ws('_', left(replace(lower(regexp_replace(product, '[^A-Za-z0-9\\s]', '', 'g')), ' ', '-'), 20),
 strftime({AS_OF_SQL}, '%Y%m%d_%H%M'), left(md5(icp_json), 8)) AS icp_identifier FROM icp""", icp=ICP))
def icp_identifier(t):
    return t.sql(ICP).select("id", U.icp_identifier("product", "icp_json", as_of()).alias("icp_identifier"))


CACHE = """SELECT url, CASE WHEN id % 2 = 0 THEN 'static' ELSE 'dynamic' END AS classification, 0.5 + (id % 50) / 100.0E0 AS confidence,
 id % 11 = 0 AS is_override, CAST('2024-02-15 12:00:00' AS TIMESTAMP) - INTERVAL '1' HOUR * CAST(id % 300 AS INT) AS ts FROM fx_urls WHERE id % 2 = 0 OR id % 3 = 0"""


@query("classification_lookup", twin(f"""
SELECT id, classification, CASE WHEN age >= 86400 THEN round(greatest(0, confidence * pow(0.98, floor(age / 86400.0))), 6) ELSE confidence END AS confidence
FROM (SELECT *, epoch({AS_OF_SQL}) - epoch(ts) AS age FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, is_override DESC, classification) AS rn FROM cache) WHERE rn = 1) c
JOIN (SELECT id, url FROM fx_urls) u USING (url) WHERE age <= 7 * 86400""", "fx_urls", cache=CACHE))
def classification_lookup(t):
    u = t.fx_urls
    u.createOrReplaceTempView("fx_urls")
    cache = t.spark.sql(CACHE)
    return U.classification_lookup(u.select("id", "url"), cache, as_of()).select("id", "classification", "confidence")


ANCHORS = """SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS tag FROM fx_rich"""


@query("company_links", twin(f"""
SELECT page_id, link, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY link) AS rank FROM
 (SELECT DISTINCT page_id, link FROM (
  SELECT page_id, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN concat(regexp_replace(url, '/+$', ''), href) ELSE concat(regexp_replace(url, '/+$', ''), '/', href) END AS link
  FROM (SELECT page_id, url, regexp_extract(tag, '"([^"]*)"', 1) AS href, lower(trim(regexp_extract(tag, '>([^<]*)<', 1))) AS label FROM anchors)
  WHERE {_company_sql('lower(href)')} AND {sql_any('label', R.COMPANY_LINK_WORDS)})
  WHERE length(link) > 10 AND NOT regexp_matches(link, '\\.(pdf|jpg|png)$') AND NOT {sql_any('lower(link)', R.COMPANY_LINK_INTERNAL)}))
WHERE rank <= 15""", "fx_rich", anchors=ANCHORS))
def company_links(t):
    return U.company_links(P.page_links(t.fx_rich), 15)


@query("same_host_links", twin("""
SELECT page_id, link, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY link) AS rank FROM
 (SELECT DISTINCT page_id, link FROM (SELECT page_id, url, CASE WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), href) ELSE href END AS link
   FROM (SELECT page_id, url, regexp_extract(tag, '"([^"]*)"', 1) AS href FROM anchors))
  WHERE regexp_extract(link, '^https?://([^/?#]*)', 1) = regexp_extract(url, '^https?://([^/?#]*)', 1)
   AND len(list_filter(string_split(regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) >= 2)) WHERE rank <= 50""", "fx_rich", anchors=ANCHORS))
def same_host_links(t):
    return U.same_host_links(P.page_links(t.fx_rich), 50)


@query("leads_by_domain", twin(f"SELECT id, url FROM (SELECT *, {HOST} AS domain FROM fx_contacts) WHERE domain = 'instagram.com'", "fx_contacts"))
def leads_by_domain(t):
    leads = t.fx_contacts.withColumn("domain", U._host("url"))
    return U.leads_by_domain(leads, "instagram.com").select("id", "url")


RESULTS = """SELECT o_custkey AS search, o_orderkey AS pos, CASE o_orderkey % 6
 WHEN 0 THEN concat('https://www.google.com/url?q=https%3A%2F%2Fwww.kompass.com%2Fc', o_orderkey % 20, '&sa=U')
 WHEN 1 THEN concat('/url?q=https%3A%2F%2Fwww.manta.com%2Fc', o_orderkey % 20, '&sa=U') WHEN 2 THEN concat('https://www.yelp.com/biz/', o_orderkey % 20)
 WHEN 3 THEN 'https://www.facebook.com/business/x' WHEN 4 THEN concat('https://plain', o_orderkey % 9, '.example.com/') ELSE concat('https://find.example.com/companies/', o_orderkey % 9) END AS href FROM orders"""
SITE = "CASE WHEN contains(href, 'url?q=') THEN replace(replace(regexp_extract(href, 'url\\?q=([^&]*)', 1), '%3A', ':'), '%2F', '/') ELSE href END"


@query("directory_domains", twin(f"""
SELECT search, CAST(rank AS INT) AS rank, site FROM found UNION ALL
SELECT search, CAST(i AS INT), ([{', '.join(q(s) for s in R.DIRECTORY_FALLBACK)}])[i] FROM (SELECT DISTINCT search FROM results WHERE search NOT IN (SELECT search FROM found)), range(1, 11) r(i)""",
                                 results=RESULTS, sites=f"SELECT search, pos, href, {SITE} AS site FROM results",
                                 found=f"""SELECT * FROM (SELECT search, site, row_number() OVER (PARTITION BY search ORDER BY min(pos), site) AS rank FROM sites
 WHERE NOT {sql_any('href', ['google.com', 'youtube.com'])} AND NOT {sql_any("replace(" + sql_netloc('site') + ", 'www.', '')", R.DIRECTORY_RESULT_SKIP)}
 AND {sql_any('lower(site)', R.DIRECTORY_RESULT_WORDS)} GROUP BY search, site) WHERE rank <= 10"""))
def directory_domains(t):
    return U.directory_domains(t.sql(RESULTS), 10)


PROFILES = """SELECT c_custkey AS id, concat('icp_', c_custkey) AS icp_identifier, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('buyer ', c_custkey % 9) END AS persona,
 lower(c_mktsegment) AS industry, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('region ', c_nationkey) END AS region FROM customer"""


def _templates_sql():
    import re
    parts = []
    for p, ts in R.QUERY_TEMPLATES.items():
        for i, t in enumerate(ts):
            pieces = re.split(r"(\{\w+\|[^}]*\})", t)
            expr = []
            for piece in pieces:
                m = re.match(r"\{(\w+)\|([^}]*)\}", piece)
                expr.append(f"coalesce(nullif({m[1]}, ''), {q(m[2])})" if m else q(piece))
            parts.append(f"SELECT icp_identifier, {q(p)} AS platform, {i} AS slot, concat({', '.join(expr)}) AS query FROM profiles")
    return " UNION ALL ".join(parts)


@query("query_templates", twin(_templates_sql(), profiles=PROFILES))
def query_templates(t):
    return U.query_templates(t.sql(PROFILES))


@query("similar_url_hint", twin("""
SELECT id, classification, confidence * 0.9 AS confidence FROM (SELECT p.id, c.classification, c.confidence,
 row_number() OVER (PARTITION BY p.id ORDER BY c.ts DESC, c.url) AS rn FROM probe p JOIN cache c
 ON regexp_extract(p.url, '^(https?://[^/?#]*)', 1) = regexp_extract(c.url, '^(https?://[^/?#]*)', 1)
 AND regexp_extract(c.url, '^https?://[^/?#]*([^?#]*)', 1) <> ''
 AND starts_with(regexp_extract(p.url, '^https?://[^/?#]*([^?#]*)', 1), regexp_replace(regexp_extract(c.url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '')))
WHERE rn = 1""", "fx_urls", cache=CACHE, probe="SELECT id, concat(regexp_replace(url, '/+$', ''), '/team/', id) AS url FROM fx_urls WHERE starts_with(url, 'http')"))
def similar_url_hint(t):
    from contactmill.operators import match as M
    u = t.fx_urls
    u.createOrReplaceTempView("fx_urls")
    cache = t.spark.sql(CACHE)
    probe = u.filter("url like 'http%'").select("id", F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/team/"), F.col("id")).alias("url"))
    return M.similar_url_hint(probe, cache).select("id", "classification", "confidence")
