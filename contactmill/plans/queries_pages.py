"""Saved-page queries and their SQL twins."""

from pyspark.sql import functions as F

from contactmill.functions import page_rules as R
from contactmill.operators import pages as P
from contactmill.plans.catalog import query
from contactmill.plans.derived import q, sql_any, sql_re, twin

ENT = "{0}"
for _e, _c in P.ENTITIES:
    ENT = f"replace({ENT}, {q(_e)}, {q(_c)})"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
RUNS = (f"list_filter(list_transform(string_split({ENT.format('regexp_replace(regexp_replace(html, ' + q(P.HIDDEN) + ', chr(1), ' + q('g') + '), ' + q(P.TAG) + ', chr(1), ' + q('g') + ')')}, chr(1)), "
        f"lambda s: {STRIP.format('s')}), lambda s: s <> '')")
TEXT = f"regexp_replace(array_to_string({RUNS}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def attr(tag, name):
    return f"regexp_extract({tag}, {q(rf'(?i)\b{name}\s*=\s*[\"' + chr(39) + ']([^\"' + chr(39) + ']*)[\"' + chr(39) + ']')}, 1)"


def texts(table):
    return f"SELECT page_id, url, html, {TEXT} AS text FROM {table}"


@query("html_text", f"SELECT page_id, text FROM ({texts('pages')})")
def html_text(t):
    return t.pages.select("page_id", P.html_text("html").alias("text"))


@query("jsonld_items", twin("""
SELECT page_id, CAST(i - 1 AS INT) AS pos, regexp_extract(items[i], '"name":"([^"]*)"', 1) AS name, regexp_extract(items[i], '"telephone":"([^"]*)"', 1) AS telephone
FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM
 (SELECT page_id, regexp_extract_all(html, '(?is)<script\\b[^>]*ld\\+json[^>]*>(.*?)</script\\s*>', 1) AS items FROM fx_pages))""", "fx_pages"))
def jsonld_items(t):
    j = lambda k: F.try_variant_get(F.try_parse_json("json"), f"$.{k}", "string").alias(k)
    return P.jsonld_items(t.fx_pages).select("page_id", "pos", j("name"), j("telephone"))


LINKS = f"""SELECT page_id, url, CAST(i - 1 AS INT) AS pos, {attr('tags[i]', 'href')} AS href,
 left({STRIP.format(ENT.format("regexp_replace(tags[i], '<[^>]*>', '', 'g')"))}, 200) AS text
 FROM (SELECT page_id, url, tags, unnest(range(1, len(tags) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, {q(P.ANCHOR)}) AS tags FROM {{0}}))"""


@query("links_images", twin(f"""
SELECT 'link' AS kind, page_id, pos, href AS target, text AS label FROM ({LINKS.format('fx_rich')})
UNION ALL SELECT 'image', page_id, CAST(i - 1 AS INT), {attr('tags[i]', 'src')}, {attr('tags[i]', 'alt')}
 FROM (SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<img\\b[^>]*>') AS tags FROM fx_rich))""", "fx_rich"))
def links_images(t):
    links = P.page_links(t.fx_rich).select(F.lit("link").alias("kind"), "page_id", "pos", F.col("href").alias("target"), F.col("text").alias("label"))
    images = P.page_images(t.fx_rich).select(F.lit("image").alias("kind"), "page_id", "pos", F.col("src").alias("target"), F.col("alt").alias("label"))
    return links.unionByName(images)


@query("page_sections")
def page_sections(t):
    from contactmill.operators import html_blocks as H
    return H.page_sections(t.fx_rich)


PATTERNS = f"""
SELECT DISTINCT page_id, 'email' AS kind, unnest(regexp_extract_all(text, {q(R.EMAIL)})) AS value FROM txt
UNION SELECT page_id, 'email', substr(href, 8) FROM links WHERE starts_with(href, 'mailto:')
UNION SELECT page_id, 'phone', p FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(text, {q(R.PHONE_RUN)}), lambda s: {STRIP.format('s')})) AS p FROM txt) WHERE length(p) >= 7"""


@query("contact_patterns", twin(PATTERNS, "fx_pages", txt=texts("fx_pages"), links=LINKS.format("fx_pages")))
def contact_patterns(t):
    c = P.contact_patterns(t.fx_pages)
    return (c.select("page_id", F.lit("email").alias("kind"), F.explode("emails").alias("value"))
            .unionByName(c.select("page_id", F.lit("phone").alias("kind"), F.explode("phones").alias("value"))))


@query("process_pages", twin("""
SELECT page_id, length(text) AS n_text, (SELECT count(*) FROM links l WHERE l.page_id = txt.page_id) AS n_links,
 CAST(len(regexp_extract_all(html, '(?is)<script\\b[^>]*ld\\+json[^>]*>(.*?)</script\\s*>', 1)) AS BIGINT) AS n_items FROM txt""",
                             "fx_pages", txt=texts("fx_pages"), links=LINKS.format("fx_pages")))
def process_pages(t):
    return P.process_pages(t.fx_pages).select("page_id", F.length("text").cast("bigint").alias("n_text"),
                                              F.size("links").cast("bigint").alias("n_links"), F.size("structured").cast("bigint").alias("n_items"))


META = f"""SELECT page_id, tags, i, coalesce(nullif({attr('tags[i]', 'name')}, ''), {attr('tags[i]', 'property')}) AS name, {ENT.format(attr('tags[i]', 'content'))} AS content
 FROM (SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<meta\\b[^>]*>') AS tags FROM fx_rich))"""


@query("page_meta", twin("""
SELECT page_id, name, content, CASE WHEN starts_with(name, 'og:') THEN 'open_graph' WHEN starts_with(name, 'twitter:') THEN 'twitter'
 WHEN starts_with(name, 'linkedin:') THEN 'linkedin' ELSE 'other' END AS grp FROM meta WHERE name <> '' AND content <> ''""", "fx_rich", meta=META))
def page_meta(t):
    return P.page_meta(t.fx_rich).drop("pos")


TITLE = STRIP.format(ENT.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


@query("page_head", f"SELECT page_id, {TITLE} AS title, regexp_extract(html, '(?i)<meta\\s+charset\\s*=\\s*[\"'']?([\\w-]+)', 1) AS charset FROM pages")
def page_head(t):
    return P.page_head(t.pages).select("page_id", "title", "charset")


HEAD = """SELECT page_id, max(content) FILTER (name = 'description') AS d, max(content) FILTER (name = 'og:title') AS t, max(content) FILTER (name = 'twitter:title') AS tw,
 max(content) FILTER (name = 'og:type') AS og_type, max(content) FILTER (name = 'og:url') AS og_url, max(content) FILTER (name = 'og:description') AS og_description FROM meta GROUP BY page_id"""
AT = r"'\(@([a-zA-Z0-9._]+)\)\s*•\s*Instagram'"


@query("instagram_meta", twin(rf"""
SELECT page_id, nullif(regexp_extract(d, '(?i)(\d+(?:\.\d+)?[KMB]?)\s*likes?', 1), '') AS likes_count, nullif(regexp_extract(d, '(?i)(\d+(?:,\d+)*)\s*comments?', 1), '') AS comments_count,
 nullif(regexp_extract(d, '- ([a-zA-Z0-9._]+)\s+(?:el|on)\s+', 1), '') AS username, nullif(regexp_extract(d, 'on (\w+ \d+, \d{{4}})', 1), '') AS post_date,
 nullif(regexp_extract(t, {AT}, 1), '') AS username_from_title, nullif(regexp_extract(t, '^([^@]+?)\s*\(@', 1), '') AS full_name,
 nullif(regexp_extract(tw, {AT}, 1), '') AS username_from_twitter, og_type AS content_type, nullif(regexp_extract(og_url, '/([A-Za-z0-9_-]+)/?$', 1), '') AS shortcode,
 nullif(regexp_extract(og_description, ':\s*"([^"]+)"', 1), '') AS caption FROM head""", "fx_rich", meta=META, head=HEAD))
def instagram_meta(t):
    return P.instagram_meta(P.page_head(t.fx_rich))


SCRIPTS = "SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script\\s*>', 1), lambda s: regexp_replace(s, '\\s', '', 'g') <> '') AS s FROM fx_rich"


def _script_sql(fields):
    out = []
    for name, kind, ps in fields:
        per = " ".join(f"WHEN regexp_matches(x, {q(p)}) THEN regexp_extract(x, {q(p)}, 1)" for p in reversed(ps))
        v = f"list_filter(list_transform(s, lambda x: CASE {per} END), lambda v: v IS NOT NULL)[-1]"
        out.append({"text": v, "flag": f"lower({v}) = 'true'", "whole": f"TRY_CAST({v} AS BIGINT)"}[kind] + f" AS {name}")
    return ", ".join(out)


@query("script_fields", twin(f"SELECT page_id, {_script_sql(R.INSTAGRAM_SCRIPT_FIELDS)} FROM scripts", "fx_rich", scripts=SCRIPTS))
def script_fields(t):
    return P.script_fields(t.fx_rich, R.INSTAGRAM_SCRIPT_FIELDS)


@query("youtube_script_fields", twin(f"SELECT page_id, {_script_sql(R.YOUTUBE_SCRIPT_FIELDS)} FROM scripts", "fx_rich", scripts=SCRIPTS))
def youtube_script_fields(t):
    return P.script_fields(t.fx_rich, R.YOUTUBE_SCRIPT_FIELDS)


CHANNELS = """SELECT o_orderkey AS page_id, concat('Clip ', o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' 12,345 views' WHEN 1 THEN ' 1.2M views' WHEN 2 THEN ' Views: 77' ELSE '' END,
 CASE o_orderkey % 3 WHEN 0 THEN ' 5.1K subscribers' WHEN 1 THEN ' subscribers: 90' ELSE '' END, CASE o_orderkey % 5 WHEN 0 THEN ' Published on May 3, 2024' WHEN 1 THEN ' 3 days ago' ELSE '' END) AS text FROM orders"""


def _first_sql(ps):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {q(p)}, 1), '')" for p in ps) + ")"


@query("youtube_text_fields", twin(f"SELECT page_id, {_first_sql(R.VIEW_PATTERNS)} AS views, {_first_sql(R.SUBSCRIBER_PATTERNS)} AS subscribers, {_first_sql(R.UPLOAD_DATE_PATTERNS)} AS upload_date FROM ch", ch=CHANNELS))
def youtube_text_fields(t):
    return P.youtube_text_fields(t.sql(CHANNELS))


def _keywords_sql(site):
    arr = "[" + ", ".join(q(w) for w in R.PAGE_KEYWORDS[site]) + "]"
    has = lambda w: f"list_contains(k, {q(w)})"
    return f"""SELECT page_id, array_to_string(k, ',') AS keywords, CASE WHEN {has('followers')} AND {has('following')} THEN 'profile_page' WHEN {has('caption')} OR {has('likes')} THEN 'post_page'
 WHEN {has('story')} THEN 'story_page' WHEN {has('feed')} THEN 'feed_page' ELSE 'unknown' END AS content_type, summary
 FROM (SELECT page_id, list_filter({arr}, lambda w: contains(lower(text), w)) AS k,
  array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: {STRIP.format('s')}), lambda s: s <> '')[1:10], ' | ') AS summary FROM txt)"""


@query("page_keywords", twin(" UNION ALL ".join(f"SELECT {q(s)} AS site, * FROM ({_keywords_sql(s)})" for s in R.PAGE_KEYWORDS), "fx_rich", txt=texts("fx_rich")))
def page_keywords(t):
    from functools import reduce
    txt = t.fx_rich.select("page_id", P.html_text("html").alias("text"))
    parts = [P.page_keywords(txt, s).select(F.lit(s).alias("site"), "page_id", F.array_join("keywords", ",").alias("keywords"), "content_type", "summary") for s in R.PAGE_KEYWORDS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("request_log_stats", twin("""SELECT scraper, count(*) AS total, count(*) FILTER (http_status BETWEEN 200 AND 299) AS successful,
 count(*) FILTER (NOT http_status BETWEEN 200 AND 299) AS failed FROM fx_run_log GROUP BY scraper""", "fx_run_log"))
def request_log_stats(t):
    return P.request_log_stats(t.fx_run_log)


@query("request_log_breakdown", twin("""SELECT scraper, 'http_status' AS kind, CAST(http_status AS VARCHAR) AS value, count(*) AS n FROM fx_run_log GROUP BY ALL
 UNION ALL SELECT scraper, 'status', status, count(*) FROM fx_run_log GROUP BY ALL""", "fx_run_log"))
def request_log_breakdown(t):
    return P.request_log_breakdown(t.fx_run_log)


def cnt(p):
    return f"len(regexp_extract_all(html, {q(p)}))"


@query("page_render_class", f"""
SELECT page_id, CAST(words AS INT) AS word_count, CAST(s AS INT) AS static_votes, CAST(d AS INT) AS dynamic_votes, CASE WHEN s > d THEN 'static' ELSE 'dynamic' END AS classification,
 greatest(s, d) / CAST(greatest(s + d, 1) AS DOUBLE) AS confidence, n_reasons FROM (SELECT page_id, words,
 (words > 500)::INT + (dens < 0.2)::INT + (ratio > 0.2)::INT AS s, (words < 100)::INT + (dens > 0.5)::INT + (spa > 0)::INT + (ph > 0)::INT + ns::INT AS d,
 CAST((ratio > 0.2)::INT + (ph > 0)::INT + ns::INT + (words > 500)::INT + (dens < 0.2)::INT + (spa > 0)::INT + (words < 100)::INT AS BIGINT) AS n_reasons
 FROM (SELECT page_id, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS words, length(text) / CAST(length(html) AS DOUBLE) AS ratio,
  {cnt(r'(?i)<script' + chr(92) + 'b')} / CAST(greatest({cnt('<[a-zA-Z]')}, 1) AS DOUBLE) AS dens,
  {' + '.join('(' + sql_re('html', m) + ')::INT' for m in R.SPA_MARKS)} + regexp_matches(html, '(?is)<script\\b[^>]*>[^<]*(?:React|Vue|Angular)')::INT AS spa,
  {cnt(R.PLACEHOLDER_MARKS)} AS ph, regexp_matches(html, '(?i)<noscript\\b') AS ns FROM ({texts('pages')})))""")
def page_render_class(t):
    return P.page_render_class(t.pages).withColumn("n_reasons", F.size("reasons").cast("bigint")).drop("reasons")


ROLES = """SELECT c_custkey AS id, concat(c_name, CASE c_custkey % 3 WHEN 0 THEN ' | Sales head | LinkedIn' WHEN 1 THEN ' | LinkedIn' ELSE '' END) AS og_title,
 concat(c_custkey, ' Main Street') AS street, CASE WHEN c_custkey % 2 = 0 THEN 'Town' ELSE '' END AS city, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'R' END AS region,
 CAST(c_nationkey AS VARCHAR(9)) AS zip, 'X' AS country FROM customer"""


@query("linkedin_title_part", twin("""SELECT id, string_split(og_title, ' | ')[2] AS job_title,
 concat_ws(', ', nullif(street, ''), nullif(city, ''), nullif(region, ''), nullif(zip, ''), nullif(country, '')) AS address FROM roles""", roles=ROLES))
def linkedin_title_part(t):
    return t.sql(ROLES).select("id", P.title_part("og_title").alias("job_title"), P.join_address("street", "city", "region", "zip", "country").alias("address"))


@query("login_wall_filter", twin(f"SELECT id, full_name FROM fx_contacts WHERE NOT {sql_any('lower(full_name)', P.SIGNUP_WORDS)} AND lower(industry) <> 'linkedin' AND NOT {sql_any('lower(industry)', P.SIGNUP_WORDS)}", "fx_contacts"))
def login_wall_filter(t):
    return t.fx_contacts.filter(~P.signup_row("full_name", "industry", "location", F.lit(""))).select("id", "full_name")


CHALLENGED = "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN concat(html, '<p>Checking your browser</p>') WHEN page_id % 7 = 0 THEN concat(html, '<form action=\"login.php\">Log in to Facebook</form>') ELSE html END AS html FROM pages"


@query("challenge_page_filter", twin(f"SELECT page_id, {sql_any('lower(html)', R.CHALLENGE_PHRASES)} AS challenge, {sql_any('lower(html)', R.FACEBOOK_LOGIN_PHRASES)} AND contains(lower(html), 'login.php') AS restricted FROM ch", ch=CHALLENGED))
def challenge_page_filter(t):
    return t.sql(CHALLENGED).select("page_id", P.challenge_page("html").alias("challenge"), P.facebook_restricted("html").alias("restricted"))


@query("page_category", twin("""
SELECT page_id, coalesce(CASE WHEN og_type NOT IN ('website', 'article', 'video.other') THEN regexp_replace(og_type, 'business\\.|books\\.|music\\.', '', 'g') END,
 CASE """ + " ".join(f"WHEN contains(lower(text), {q(w)}) THEN {q(w[0].upper() + w[1:])}" for w in R.PAGE_CATEGORY_WORDS) + """ END) AS category FROM head JOIN txt USING (page_id)""",
                             "fx_rich", meta=META, head=HEAD, txt=texts("fx_rich")))
def page_category(t):
    step = t.fx_rich.select("page_id", P.meta_tags("html").alias("m"), P.html_text("html").alias("text"))
    return step.select("page_id", P.page_category(P.meta_value("m", "og:type"), "text").alias("category"))
