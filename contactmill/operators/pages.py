"""Saved pages to facts: text, links, metadata, script fields and page classes.

Everything is a per-row expression over ``pages(page_id, url, html)``: no shuffle, one scan.  The nested HTML
cases, which regular expressions cannot express, are in ``html_blocks``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import page_rules as R
from contactmill.functions import text as X

ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->"
TAG = r"<[^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescape(c) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(X.col(c), F.lit(entity), F.lit(char))
    return c


def attr(tag, name: str) -> Column:
    return F.regexp_extract(X.col(tag), rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def html_text(html) -> Column:
    """Visible text: one trimmed line per text run, blank runs dropped."""
    flat = F.regexp_replace(F.regexp_replace(X.col(html), HIDDEN, "\u0001"), TAG, "\u0001")
    runs = F.filter(F.transform(F.split(unescape(flat), "\u0001"), X.strip), lambda s: s != "")
    return F.regexp_replace(F.array_join(runs, "\n"), r"\n{3,}", "\n\n")


def without_overlays(html) -> Column:
    """Remove consent and modal blocks that hold no nested block of the same tag."""
    return F.regexp_replace(X.col(html), r"(?is)<(div|section)\b[^>]*(?:class|id)\s*=\s*[\"'][^\"']*"
                            r"(?:cookie|consent|gdpr|modal|overlay)[^\"']*[\"'][^>]*>[^<]*(?:<(?!/?(?:div|section)\b)[^<]*)*</\1>", "")


def jsonld_blocks(html) -> Column:
    """JSON-LD items of a page as JSON texts; arrays are flattened, invalid blocks dropped."""
    blocks = F.transform(X.extract_all(html, r"(?is)<script\b[^>]*ld\+json[^>]*>(.*?)</script\s*>", 1), X.strip)
    items = F.flatten(F.transform(blocks, lambda b: F.when(
        b.startswith("["), F.coalesce(F.from_json(b, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(b))))
    return F.filter(items, lambda j: j.startswith("{") & F.try_parse_json(j).isNotNull())


def jsonld_items(pages: DataFrame) -> DataFrame:
    """One row per JSON-LD object, with ``@graph`` members as rows of their own."""
    items = pages.select("page_id", "url", F.posexplode(jsonld_blocks("html")).alias("pos", "json"))
    graph = F.from_json(F.get_json_object("json", "$.@graph"), "array<string>")
    return (items.withColumn("_g", F.when(F.size(graph) > 0, graph).otherwise(F.array("json")))
            .select("page_id", "url", "pos", F.posexplode("_g").alias("sub", "json")))


def anchors(html, cut: int | None = 200) -> Column:
    """Links with their text, of which the first ``cut`` characters are kept (None: all)."""
    def label(tag):
        text = X.strip(unescape(F.regexp_replace(tag, TAG, "")))
        return text if cut is None else F.substring(text, 1, cut)
    return F.transform(X.extract_all(html, ANCHOR), lambda tag: F.struct(attr(tag, "href").alias("href"), label(tag).alias("text")))


def page_links(pages: DataFrame, cut: int | None = 200) -> DataFrame:
    return (pages.select("page_id", "url", F.posexplode(anchors("html", cut)).alias("pos", "_a"))
            .select("page_id", "url", "pos", "_a.href", "_a.text"))


def page_images(pages: DataFrame) -> DataFrame:
    return (pages.select("page_id", F.posexplode(X.extract_all("html", r"(?i)<img\b[^>]*>")).alias("pos", "_t"))
            .select("page_id", "pos", attr("_t", "src").alias("src"), attr("_t", "alt").alias("alt")))


def text_emails(text) -> Column:
    return F.array_sort(F.array_distinct(X.extract_all(text, R.EMAIL)))


def text_phones(text) -> Column:
    runs = F.transform(X.extract_all(text, R.PHONE_RUN), X.strip)
    return F.array_sort(F.array_distinct(F.filter(runs, lambda p: F.length(p) >= 7)))


def mailto_targets(html) -> Column:
    hrefs = F.transform(anchors(html), lambda a: a["href"])
    return F.transform(F.filter(hrefs, lambda h: h.startswith("mailto:")), lambda h: F.substring(h, 8, 1_000_000))


def contact_patterns(pages: DataFrame) -> DataFrame:
    text = html_text("html")
    return pages.select("page_id", F.array_sort(F.array_union(text_emails(text), mailto_targets("html"))).alias("emails"),
                        text_phones(text).alias("phones"))


def process_pages(pages: DataFrame) -> DataFrame:
    """Text, links, images, JSON-LD items, emails and phones of each page, in one scan."""
    step = pages.select("page_id", "url", "html", html_text("html").alias("text"))
    return step.select(
        "page_id", "url", "html", "text", anchors("html").alias("links"),
        F.transform(X.extract_all("html", r"(?i)<img\b[^>]*>"),
                    lambda t: F.struct(attr(t, "src").alias("src"), attr(t, "alt").alias("alt"))).alias("images"),
        jsonld_blocks("html").alias("structured"),
        F.array_sort(F.array_union(text_emails("text"), mailto_targets("html"))).alias("emails"),
        text_phones("text").alias("phones"))


# --- metadata -------------------------------------------------------------------------------------------------

def meta_tags(html) -> Column:
    """Array of (name, content) in page order."""
    tags = F.transform(X.extract_all(html, r"(?is)<meta\b[^>]*>"), lambda t: F.struct(
        F.coalesce(F.nullif(attr(t, "name"), F.lit("")), attr(t, "property")).alias("name"),
        unescape(attr(t, "content")).alias("content")))
    return F.filter(tags, lambda m: (m["name"] != "") & (m["content"] != ""))


def meta_value(tags, name: str) -> Column:
    """Content of the last tag with this name, null when absent."""
    found = F.filter(X.col(tags), lambda m: m["name"] == name)
    return F.try_element_at(found, F.lit(-1))["content"]


def page_title(html) -> Column:
    return X.strip(unescape(F.regexp_extract(X.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_meta(pages: DataFrame) -> DataFrame:
    """One row per metadata entry with its group, for joins and audits."""
    group = (F.when(F.col("name").startswith("og:"), "open_graph").when(F.col("name").startswith("twitter:"), "twitter")
             .when(F.col("name").startswith("linkedin:"), "linkedin").otherwise("other"))
    return (pages.select("page_id", F.posexplode(meta_tags("html")).alias("pos", "_m"))
            .select("page_id", "pos", "_m.name", "_m.content").withColumn("grp", group))


def page_head(pages: DataFrame, *keep: str) -> DataFrame:
    """Title, charset and the common metadata values as columns, beside the columns in ``keep``."""
    step = pages.select("*", meta_tags("html").alias("_m"))
    return step.select("page_id", "url", *keep, page_title("html").alias("title"),
                       F.regexp_extract("html", r"(?i)<meta\s+charset\s*=\s*[\"']?([\w-]+)", 1).alias("charset"),
                       *[meta_value("_m", n).alias(a) for n, a in
                         [("description", "description"), ("og:title", "og_title"), ("og:type", "og_type"),
                          ("og:url", "og_url"), ("og:description", "og_description"), ("twitter:title", "twitter_title")]])


def instagram_meta(head: DataFrame) -> DataFrame:
    """Counts, names, date, short code and caption from the metadata texts."""
    d, t, at = F.col("description"), F.col("og_title"), r"\(@([a-zA-Z0-9._]+)\)\s*•\s*Instagram"
    return head.select(
        "page_id", X.extract(d, r"(?i)(\d+(?:\.\d+)?[KMB]?)\s*likes?").alias("likes_count"),
        X.extract(d, r"(?i)(\d+(?:,\d+)*)\s*comments?").alias("comments_count"),
        X.extract(d, r"- ([a-zA-Z0-9._]+)\s+(?:el|on)\s+").alias("username"),
        X.extract(d, r"on (\w+ \d+, \d{4})").alias("post_date"),
        X.extract(t, at).alias("username_from_title"), X.strip(X.extract(t, r"^([^@]+?)\s*\(@")).alias("full_name"),
        X.extract("twitter_title", at).alias("username_from_twitter"), F.col("og_type").alias("content_type"),
        X.extract("og_url", r"/([A-Za-z0-9_-]+)/?$").alias("shortcode"),
        X.extract("og_description", r':\s*"([^"]+)"').alias("caption"))


def script_texts(html) -> Column:
    return F.filter(X.extract_all(html, r"(?is)<script\b[^>]*>(.*?)</script\s*>", 1), lambda s: ~X.blank(s))


def script_field(scripts, patterns: list[str]) -> Column:
    """Within a script the last listed pattern wins, across scripts the last script with a match wins."""
    per_script = F.transform(X.col(scripts), lambda s: F.coalesce(*[
        F.when(s.rlike(p), F.regexp_extract(s, p, 1)) for p in reversed(patterns)]))
    return F.try_element_at(F.filter(per_script, lambda v: v.isNotNull()), F.lit(-1))


def script_fields(pages: DataFrame, fields) -> DataFrame:
    typed = {"text": lambda c: c, "flag": lambda c: F.lower(c) == "true", "whole": lambda c: c.try_cast("bigint")}
    step = pages.select("page_id", script_texts("html").alias("_s"))
    return step.select("page_id", *[typed[kind](script_field("_s", ps)).alias(name) for name, kind, ps in fields])


def first_pattern(text, patterns) -> Column:
    return F.coalesce(*[X.extract(text, p) for p in patterns])


def youtube_text_fields(pages: DataFrame) -> DataFrame:
    """``pages(page_id, text)`` -> views, subscribers and upload date by the first pattern that matches."""
    return pages.select("page_id", first_pattern("text", R.VIEW_PATTERNS).alias("views"),
                        first_pattern("text", R.SUBSCRIBER_PATTERNS).alias("subscribers"),
                        first_pattern("text", R.UPLOAD_DATE_PATTERNS).alias("upload_date"))


def page_keywords(pages: DataFrame, site: str, top: int | None = 10) -> DataFrame:
    """Site keywords present, the page kind they suggest and a summary (the first ``top`` non-empty lines; None: all)."""
    low = F.lower("text")
    found = X.hits(low, R.PAGE_KEYWORDS[site])
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda s: s != "")
    has = lambda w: F.array_contains("keywords", w)
    kind = (F.when(has("followers") & has("following"), "profile_page").when(has("caption") | has("likes"), "post_page")
            .when(has("story"), "story_page").when(has("feed"), "feed_page").otherwise("unknown"))
    return (pages.withColumn("keywords", found).withColumn("content_type", kind)
            .select("page_id", "keywords", "content_type", F.array_join(lines if top is None else F.slice(lines, 1, top), " | ").alias("summary")))


def request_log_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("scraper").agg(
        F.count("*").alias("total"), F.count_if(F.col("http_status").between(200, 299)).alias("successful"),
        F.count_if(~F.col("http_status").between(200, 299)).alias("failed"))


def request_log_breakdown(log: DataFrame) -> DataFrame:
    """Requests per status and per method-like event status, long form."""
    return (log.select("scraper", F.inline(F.array(
        F.struct(F.lit("http_status").alias("kind"), F.col("http_status").cast("string").alias("value")),
        F.struct(F.lit("status").alias("kind"), F.col("status").alias("value"))))).groupBy("scraper", "kind", "value").agg(F.count("*").alias("n")))


def page_render_class(pages: DataFrame) -> DataFrame:
    """Votes for a page that is complete as saved (static) or filled by scripts (dynamic)."""
    html, n = F.col("html"), lambda p: F.regexp_count("html", F.lit(p))
    votes = lambda conds: reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conds])
    spa = votes([html.rlike(m) for m in R.SPA_MARKS] + [html.rlike(r"(?is)<script\b[^>]*>[^<]*(?:React|Vue|Angular)")])
    step = pages.select("page_id", html_text("html").alias("text"), F.length("html").alias("size"),
                        (n(r"(?i)<script\b") / F.greatest(n(r"<[a-zA-Z]"), F.lit(1))).alias("script_density"),
                        spa.alias("spa"), n(R.PLACEHOLDER_MARKS).alias("placeholders"),
                        html.rlike(r"(?i)<noscript\b").alias("noscript"))
    words, ratio = F.col("word_count"), F.col("text_ratio")
    step = step.withColumn("word_count", F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+"))).withColumn(
        "text_ratio", F.length("text") / F.greatest("size", F.lit(1)))
    s = votes([words > 500, F.col("script_density") < 0.2, ratio > 0.2])
    d = votes([words < 100, F.col("script_density") > 0.5, F.col("spa") > 0, F.col("placeholders") > 0, F.col("noscript")])
    step = step.withColumn("static_votes", s).withColumn("dynamic_votes", d)
    s, d = F.col("static_votes"), F.col("dynamic_votes")
    notes = [(ratio > 0.2, "Good text-to-HTML ratio (>0.2)"), (F.col("placeholders") > 0, "Loading skeletons/placeholders detected"),
             (F.col("noscript"), "<noscript> present"), (words > 500, "Rich initial content (>500 words)"),
             (F.col("script_density") < 0.2, "Low script density (<20%)"), (F.col("spa") > 0, "SPA framework signatures present"),
             (words < 100, "Minimal initial content (<100 words)")]
    return step.select("page_id", "word_count", "static_votes", "dynamic_votes",
                       F.when(s > d, "static").otherwise("dynamic").alias("classification"),
                       (F.greatest(s, d) / F.greatest(s + d, F.lit(1))).alias("confidence"),
                       F.array_compact(F.array(*[F.when(c, t) for c, t in notes])).alias("reasons"))


def title_part(og_title) -> Column:
    """Second part of a 'name | role | site' title."""
    return F.try_element_at(F.split(X.col(og_title), r" \| "), F.lit(2))


def join_address(street, city, region, postal_code, country) -> Column:
    return F.concat_ws(", ", *[X.null_if_blank(c) for c in (street, city, region, postal_code, country)])


SIGNUP_WORDS = ["sign up", "signup", "join linkedin", "create account", "register", "get started",
                "welcome to linkedin", "member login", "log in", "continue with", "create profile"]  # fixed values


def signup_row(full_name, job_title, title, about) -> Column:
    fields = [F.lower(X.strip(F.coalesce(X.col(c), F.lit("")))) for c in (full_name, job_title, title, about)]
    return (X.any_of([X.has_any(f, SIGNUP_WORDS) for f in fields]) | (fields[1] == "linkedin")
            | (fields[3].contains("million+ members") & fields[3].contains("manage your professional identity")))


def facebook_restricted(html) -> Column:
    h = F.lower(X.col(html))
    return X.has_any(h, R.FACEBOOK_LOGIN_PHRASES) & h.contains("login.php")


def challenge_page(text) -> Column:
    return X.has_any(F.lower(X.col(text)), R.CHALLENGE_PHRASES)


def page_category(og_type, text) -> Column:
    og = X.col(og_type)
    own = F.when(X.filled(og) & ~og.isin("website", "article", "video.other"),
                 F.regexp_replace(og, r"business\.|books\.|music\.", ""))
    out = F
    for w in R.PAGE_CATEGORY_WORDS:
        out = out.when(F.contains(F.lower(X.col(text)), F.lit(w)), F.lit(w[:1].upper() + w[1:]))
    return F.coalesce(own, out.otherwise(F.lit(None).cast("string")))
