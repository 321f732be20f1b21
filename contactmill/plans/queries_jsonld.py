"""JSON-LD, saved API answer and HTML block queries and their SQL twins."""

from pyspark.sql import functions as F

from contactmill.functions import json_rules as R
from contactmill.operators import html_blocks as H
from contactmill.operators import jsonld as L
from contactmill.operators import pages as P
from contactmill.plans.catalog import query
from contactmill.plans.derived import q, twin

# Saved pages with every JSON-LD shape the projections know.
DOCS = """SELECT o_orderkey AS page_id, CASE o_orderkey % 5
 WHEN 0 THEN concat('{"@type":"Person","name":"P', o_orderkey, '","jobTitle":["Head","Chair"],"url":"https://p/', o_orderkey, '","address":{"addressLocality":"Town","addressCountry":"FR"},"worksFor":[{"name":"Acme"}],"interactionStatistic":{"interactionType":"https://schema.org/FollowAction","userInteractionCount":', o_orderkey, '}}')
 WHEN 1 THEN concat('{"@graph":[{"@type":"Organization","name":"O', o_orderkey, '","numberOfEmployees":{"value":', o_orderkey % 500, '},"address":{"streetAddress":"', o_orderkey, ' Main","postalCode":"12345"},"sameAs":["https://s/1"]}]}')
 WHEN 2 THEN concat('{"@type":"DiscussionForumPosting","headline":"H', o_orderkey, '","articleBody":"B","@id":"https://x/', o_orderkey, '","commentCount":2,"author":{"@type":"Person","name":"A', o_orderkey, '","url":"https://a","sameAs":["https://linkedin.com/in/a","https://other"]},"comment":[{"text":"c1","author":{"name":"n1"}},{"text":"c2","author":{"name":"n2"}}],"interactionStatistic":[{"interactionType":"http://schema.org/LikeAction","userInteractionCount":7}]}')
 WHEN 3 THEN concat('{"@type":"Article","headline":"N', o_orderkey, '","name":"Letter","datePublished":"2025","author":{"name":"W"},"publisher":{"name":"Pub', o_orderkey % 9, '"},"identifier":"x1","thumbnailUrl":"t","wordCount":5}')
 ELSE concat('{"@type":"LocalBusiness","name":"L', o_orderkey, '","telephone":"+1 555 0', o_orderkey, '","email":"l', o_orderkey, '@firm.example.org","description":"Long text of the local business number ', o_orderkey, '","url":"https://l"}') END AS json FROM orders"""


def items(t):
    """The documents wrapped into script tags, so that the page reader is part of every query."""
    pages = t.sql(DOCS).select("page_id", F.lit("https://x.example.org").alias("url"),
                               F.concat(F.lit('<html><script type="application/ld+json">'), F.col("json"), F.lit("</script></html>")).alias("html"))
    return L.parsed(pages)


def d(body, **more):
    return twin(body, docs=DOCS, **more)


@query("jsonld_person", d("SELECT page_id, concat('P', page_id) AS name, 'Head' AS job_title, 'Town' AS location, 'Acme' AS company, page_id AS followers FROM docs WHERE page_id % 5 = 0"))
def jsonld_person(t):
    return L.person(items(t)).select("page_id", "name", "job_title", "location", "company", "followers")


@query("jsonld_org", d("""SELECT page_id, concat('O', page_id) AS name, page_id % 500 AS employees, concat(page_id, ' Main, 12345') AS address FROM docs WHERE page_id % 5 = 1
 UNION ALL SELECT page_id, concat('L', page_id), NULL, '' FROM docs WHERE page_id % 5 = 4"""))
def jsonld_org(t):
    return L.organization(items(t)).select("page_id", "name", "employees", "address")


@query("jsonld_post", d("SELECT page_id, concat('H', page_id) AS headline, concat('A', page_id) AS author_name, CAST(2 AS BIGINT) AS comment_count, CAST(7 AS BIGINT) AS likes FROM docs WHERE page_id % 5 = 2 UNION ALL SELECT page_id, concat('N', page_id), 'W', NULL, NULL FROM docs WHERE page_id % 5 = 3"))
def jsonld_post(t):
    return L.post(items(t)).select("page_id", "headline", "author_name", "comment_count", "likes")


@query("jsonld_comments", d("SELECT page_id, CAST(i - 1 AS INT) AS pos, concat('c', i) AS text, concat('n', i) AS author_name FROM docs, range(1, 3) r(i) WHERE page_id % 5 = 2"))
def jsonld_comments(t):
    return L.comments(items(t)).select("page_id", "pos", "text", "author_name")


@query("jsonld_newsletter", d("SELECT page_id, concat('N', page_id) AS headline, 'Letter' AS name, 'W' AS author_name FROM docs WHERE page_id % 5 = 3"))
def jsonld_newsletter(t):
    return L.newsletter(items(t)).select("page_id", "headline", "name", "author_name")


@query("jsonld_generic", d("SELECT page_id, regexp_extract(json, '\"@type\":\"([A-Za-z]+)\"', 1) AS type FROM docs"))
def jsonld_generic(t):
    return L.generic(items(t)).select("page_id", "type")


def _listed(k, names):
    return f"{k} IN ({', '.join(map(q, names))})"


TECHNICAL = "(contains(lower({0}), 'id') OR (contains(lower({0}), 'url') AND contains(lower({0}), 'thumb')))"
# The items of a page are its document, or the members of its graph (one, here).
TREE = """SELECT page_id, replace(t.fullkey, '"', '') AS path, t.atom->>'$' AS value, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' ELSE 'number' END AS kind
 FROM (SELECT page_id, coalesce(json_extract(json, '$."@graph"[0]'), json) AS item FROM docs) d, json_tree(d.item) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')"""
KEYED = r"SELECT *, keys[len(keys)] AS key, keys[:len(keys) - 1] AS inside FROM (SELECT *, list_filter(string_split(regexp_replace(path, '\[\d+\]', '', 'g'), '.'), lambda k: k <> '$') AS keys FROM tree)"
FILTERED = f"""SELECT page_id, path, value FROM keyed WHERE len(list_filter(keys, lambda k: {_listed('k', R.DROP)})) = 0
 AND len(list_filter(inside, lambda k: {_listed('k', R.CONTEXT)} OR NOT ({_listed('k', R.KEEP)} OR NOT {TECHNICAL.format('k')}))) = 0
 AND CASE WHEN key = '@type' THEN true WHEN {_listed('key', R.CONTEXT)} THEN false
  ELSE {_listed('key', R.KEEP)} OR (NOT {TECHNICAL.format('key')} AND (ends_with(path, ']') OR CASE kind WHEN 'string' THEN length(value) > 10 WHEN 'number' THEN NOT regexp_matches(lower(key), 'width|height') ELSE true END)) END
 AND NOT (kind = 'string' AND length(value) < 2)"""


@query("jsonld_filter", d(FILTERED, tree=TREE, keyed=KEYED))
def jsonld_filter(t):
    return L.jsonld_filter(L.P.jsonld_items(_pages(t)), max_depth=10).select("page_id", "path", "value")


@query("jsonld_filter_variant", d(FILTERED, tree=TREE, keyed=KEYED))
def jsonld_filter_variant(t):
    return L.jsonld_filter(L.P.jsonld_items(_pages(t)), leaves=L.variant_rows).select("page_id", "path", "value")


@query("jsonld_filter_custom", d("SELECT page_id, '$.name' AS path, concat('P', page_id) AS value FROM docs WHERE page_id % 5 = 0 UNION ALL SELECT page_id, '$.name', concat('O', page_id) FROM docs WHERE page_id % 5 = 1"))
def jsonld_filter_custom(t):
    rows = L.jsonld_filter(L.P.jsonld_items(_pages(t)), keep=["name"], drop=["headline", "publisher", "author"], types=False)
    return rows.filter("page_id % 5 < 2 and path = '$.name'").select("page_id", "path", "value")


def _pages(t):
    return t.sql(DOCS).select("page_id", F.lit("https://x.example.org").alias("url"), F.concat(F.lit('<script type="application/ld+json">'), F.col("json"), F.lit("</script>")).alias("html"))


@query("jsonld_client_info", d("""SELECT page_id, 'content' AS grp, 'headline' AS key, concat('N', page_id) AS value FROM docs WHERE page_id % 5 = 3 UNION ALL SELECT page_id, 'metadata', '@type', 'Article' FROM docs WHERE page_id % 5 = 3
 UNION ALL SELECT page_id, 'content', 'name', concat('Pub', page_id % 9) FROM docs WHERE page_id % 5 = 3"""))
def jsonld_client_info(t):
    # Article pages only: the last name by path order is the publisher's.
    art = L.P.jsonld_items(_pages(t)).filter(F.get_json_object("json", "$['@type']") == "Article")
    return L.client_info(art)


@query("any_to_text", d('''SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('Person P', page_id, ' Head Chair https://p/', page_id, ' Town FR Acme https://schema.org/FollowAction') WHEN 1 THEN concat('Organization O', page_id, ' ', page_id, ' Main 12345 https://s/1')
 WHEN 2 THEN concat('DiscussionForumPosting H', page_id, ' B https://x/', page_id, ' Person A', page_id, ' https://a https://linkedin.com/in/a https://other c1 n1 c2 n2 http://schema.org/LikeAction') WHEN 3 THEN concat('Article N', page_id, ' Letter 2025 W Pub', page_id % 9, ' x1 t')
 ELSE concat('LocalBusiness L', page_id, ' +1 555 0', page_id, ' l', page_id, '@firm.example.org Long text of the local business number ', page_id, ' https://l') END AS text FROM docs'''))
def any_to_text(t):
    return L.any_to_text(t.sql(DOCS))


BROKEN = """SELECT o_orderkey AS page_id, CASE o_orderkey % 4 WHEN 0 THEN concat('{"a": ', o_orderkey, ',}') WHEN 1 THEN concat('{''a'': ''v', o_orderkey, '''}') WHEN 2 THEN concat('{"a": "x}"} junk {"b": {"c": ', o_orderkey, '}}') ELSE 'none' END AS raw FROM orders"""


@query("json_repair_split", twin("""SELECT page_id, CAST(0 AS INT) AS pos, concat('{"a": ', page_id, '}') AS json FROM broken WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 0, concat('{"a": "v', page_id, '"}') FROM broken WHERE page_id % 4 = 1
 UNION ALL SELECT page_id, 0, '{"a": "x}"}' FROM broken WHERE page_id % 4 = 2 UNION ALL SELECT page_id, 1, concat('{"b": {"c": ', page_id, '}}') FROM broken WHERE page_id % 4 = 2""", broken=BROKEN))
def json_repair_split(t):
    return L.json_repair_split(t.sql(BROKEN))


API = """SELECT c_custkey AS page_id, 'https://i/api/web_profile_info/' AS url, concat('for (;;);{"data":{"user":{"username":"u', c_custkey, '","full_name":"', c_name, '","is_private":false,"edge_followed_by":{"count":', c_custkey * 3, '}}}}') AS body FROM customer
 UNION ALL SELECT c_custkey, 'https://i/graphql', concat('{"data":{"user":{"username":"old', c_custkey, '"}}}') FROM customer"""


@query("api_profile_fields", twin("SELECT c_custkey AS page_id, concat('u', c_custkey) AS username, c_name AS full_name, c_custkey * 3 AS followers_count, false AS is_private FROM customer"))
def api_profile_fields(t):
    return L.api_profile_fields(t.sql(API)).select("page_id", "username", "full_name", "followers_count", "is_private")


VIDEO = """SELECT o_orderkey AS page_id, concat(')]}''{"videoDetails":{"title":"T', o_orderkey, '","videoId":"v', o_orderkey, '","author":"au","viewCount":"', o_orderkey * 5, '"}}') AS body FROM orders
 UNION ALL SELECT o_orderkey, concat('{"header":{"channelHeaderRenderer":{"title":"Ch', o_orderkey, '","subscriberCountText":{"simpleText":"5K"}}}}') FROM orders WHERE o_orderkey % 2 = 0"""


@query("api_video_fields", twin("SELECT o_orderkey AS page_id, concat('T', o_orderkey) AS title, CAST(o_orderkey * 5 AS VARCHAR) AS views, CASE WHEN o_orderkey % 2 = 0 THEN concat('Ch', o_orderkey) ELSE 'au' END AS channel_name, CASE WHEN o_orderkey % 2 = 0 THEN '5K' END AS subscribers FROM orders"))
def api_video_fields(t):
    return L.api_video_fields(t.sql(VIDEO)).select("page_id", "title", "views", "channel_name", "subscribers")


@query("combine_sources", twin("SELECT page_id, s_name AS name FROM fx_pages JOIN supplier ON s_suppkey = page_id % 10", "fx_pages"))
def combine_sources(t):
    p = t.fx_pages
    return L.combine_sources(P.page_head(p), L.organization(L.parsed(p))).select("page_id", "name")


@query("first_reliable", twin("SELECT id, coalesce(CASE WHEN email NOT IN ('', 'N/A') THEN email END, CASE WHEN phone NOT IN ('', 'N/A') THEN phone END, 'none') AS best, CAST(1234 AS BIGINT) AS n FROM fx_contacts", "fx_contacts"))
def first_reliable(t):
    from contactmill.functions import text as X
    return t.fx_contacts.select("id", F.coalesce(X.first_reliable("email", "phone"), F.lit("none")).alias("best"), X.reliable_int(F.lit("x"), F.lit("1,234")).alias("n"))


@query("structured_business", d("""SELECT page_id, CASE page_id % 5 WHEN 1 THEN concat('O', page_id) WHEN 3 THEN concat('Pub', page_id % 9) WHEN 4 THEN concat('L', page_id) END AS company_name, CAST(NULL AS VARCHAR) AS legal_name,
 CASE WHEN page_id % 5 = 4 THEN concat('Long text of the local business number ', page_id) END AS description, CASE WHEN page_id % 5 = 4 THEN 'https://l' END AS website, CAST(NULL AS VARCHAR) AS founding_date FROM docs"""))
def structured_business(t):
    return L.structured_business(items(t))


@query("structured_contacts", d("SELECT page_id, 'phone' AS kind, concat('+1 555 0', page_id) AS value, 0.9::DOUBLE AS confidence FROM docs WHERE page_id % 5 = 4 UNION ALL SELECT page_id, 'email', concat('l', page_id, '@firm.example.org'), 0.9::DOUBLE FROM docs WHERE page_id % 5 = 4"))
def structured_contacts(t):
    return L.structured_contacts(items(t))


@query("structured_people", d("SELECT page_id, concat('A', page_id) AS name, CAST(NULL AS VARCHAR) AS title, 'https://a' AS profile_url, 'linkedin' AS platform, 'https://linkedin.com/in/a' AS url FROM docs WHERE page_id % 5 = 2"))
def structured_people(t):
    return L.structured_people(items(t)).select("page_id", "name", "title", "profile_url", F.inline("social"))


@query("structured_relevant", d("SELECT page_id, CASE WHEN page_id % 5 = 3 THEN concat('Pub', page_id % 9) END AS publisher FROM docs WHERE page_id % 5 <> 2"))
def structured_relevant(t):
    return L.structured_relevant(items(t)).select("page_id", F.get_json_object("json", "$.publisher"). alias("p")).select("page_id", F.get_json_object("p", "$.name").alias("publisher"))


@query("structured_company", d('''SELECT page_id, concat('O', page_id) AS name, concat('O', page_id) AS organization, NULL AS notes, concat(page_id, ' Main, 12345') AS location, NULL AS telephone, NULL AS email, NULL AS site, 'Organization' AS company_type, 0.7::DOUBLE AS confidence FROM docs WHERE page_id % 5 = 1
 UNION ALL SELECT page_id, concat('L', page_id), concat('L', page_id), concat('Long text of the local business number ', page_id), '', concat('+1 555 0', page_id), concat('l', page_id, '@firm.example.org'), 'https://l', NULL, 0.7::DOUBLE FROM docs WHERE page_id % 5 = 4'''))
def structured_company(t):
    return L.structured_company(items(t))


ROWS = """SELECT o_custkey AS page_id, o_orderkey, concat('<div class="listing-item"><h3>Acme Works ', o_orderkey, '</h3><span>Call (415) 555-', lpad(CAST(o_orderkey % 9000 AS VARCHAR(6)), 4, '0'), '</span><p>12 Long Harbour Street</p></div>') AS block FROM orders"""


@query("directory_listings", """SELECT page_id, CAST(rank AS INT) AS rank, name, phone FROM (SELECT o_custkey AS page_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank,
 concat('Acme Works ', o_orderkey) AS name, concat('(415) 555-', lpad(CAST(o_orderkey % 9000 AS VARCHAR), 4, '0')) AS phone FROM orders) WHERE rank <= 15""")
def directory_listings(t):
    # A saved page holds the listings of one customer, a bounded list.
    blocks = t.sql(ROWS).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "block"))).alias("b"))
    pages = blocks.select("page_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("b", lambda x: x["block"]), ""), F.lit("</body></html>")).alias("html"))
    return H.directory_listings(pages, 15).select("page_id", "rank", "name", F.array_join(F.filter("phone", lambda p: p.startswith("(")), ",").alias("phone"))


@query("company_page_record")
def company_page_record(t):
    return H.company_page_record(t.fx_rich).select("page_id", "name", F.array_join("email", ",").alias("email"), F.array_join("phone", ",").alias("phone"), "bio")
