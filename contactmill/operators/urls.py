"""URL frontier: validate, classify, queue and count URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions import text as X
from contactmill.functions.text import up_to
from contactmill.functions import url_rules as R


# --- column rules ---------------------------------------------------------------------------------------------

def url_valid(url) -> Column:
    url = X.col(url)
    ok = url.rlike(r"^https?://") & (F.length(url) <= 2000) & url.rlike(R.URL_SHAPE)
    return F.coalesce(ok, F.lit(False))


def _host(url) -> Column:
    return F.regexp_replace(F.lower(X.netloc(url)), r"^www\.", "")


def url_type(url) -> Column:
    """Platform by host or parent host, then directory sites by substring, else general."""
    host = _host(url)
    out = F.when(~X.filled(url), F.lit("general"))
    for name, hosts in R.PLATFORM_HOSTS:
        out = out.when(host.rlike(r"(?:^|\.)(?:" + X.words_regex(hosts) + ")$"), name)
    return out.when(X.has_any(host, R.DIRECTORY_HOSTS), "company_directory").otherwise("general")


def url_bucket(url) -> Column:
    return X.first_rule(F.lower(X.netloc(url)), R.BUCKETS, F.lit("general"))


def url_platform(url) -> Column:
    return X.first_rule(F.lower(X.netloc(url)), R.CONTACT_PLATFORMS, F.lit("unknown"))


def url_domain(url) -> Column:
    url = X.col(url)
    full = F.when(url.rlike(r"^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.when(X.filled(url), F.nullif(F.regexp_replace(X.netloc(full), r"^www\.", ""), F.lit("")))


def linkedin_url_keep(url) -> Column:
    u = X.strip(url)
    host = F.lower(X.netloc(u))
    host_ok = (host == "www.linkedin.com") | host.rlike(r"^[^.]{2}\..*linkedin\.com$|^[^.]{2}\.linkedin\.com$")
    return F.coalesce(~u.rlike(R.LINKEDIN_REJECT) & u.rlike(R.LINKEDIN_ACCEPT) & host_ok, F.lit(False))


def linkedin_url_type(url) -> Column:
    u = F.lower(X.col(url))
    return (F.when(u.contains("/company/"), "company").when(u.contains("/newsletters/"), "newsletter")
            .when(u.contains("/in/"), "profile").when(u.contains("/posts/"), "post").otherwise("unknown"))


def linkedin_username(url) -> Column:
    kind = linkedin_url_type(url)
    part = lambda p: F.regexp_extract(X.col(url), rf"linkedin\.com/{p}/([^/?]+)", 1)
    return (F.when(kind == "profile", part("in")).when(kind == "company", part("company"))
            .when(kind == "newsletter", part("newsletters")).otherwise(""))


def instagram_content_type(url, is_video=None) -> Column:
    url = X.col(url)
    video = F.coalesce(X.col(is_video), F.lit(False)) if is_video is not None else F.lit(False)
    parts = F.filter(F.split(X.url_path(url), "/"), lambda p: p != "")
    return (F.when(~X.netloc(url).contains("instagram.com"), "unknown")
            .when(url.contains("/reel/") | (url.contains("/p/") & video), "video")
            .when(url.contains("/p/"), "article")
            .when((F.size(parts) == 1) & F.try_element_at(parts, F.lit(1)).rlike(r"^[\p{L}\p{N}._]+$"), "profile")
            .otherwise("unknown"))


def youtube_page_type(url) -> Column:
    u = F.lower(X.col(url))
    valid = F.coalesce(u.rlike(r"^https?://") & X.has_any(u, ["youtube.com", "youtu.be"]), F.lit(False))
    return (F.when(~valid, "invalid").when(u.contains("/shorts/"), "shorts").when(u.contains("/watch?v="), "video")
            .when(X.has_any(u, ["/@", "/channel/", "/c/"]), "channel").otherwise("unknown"))


def facebook_url_type(url, og_type=None) -> Column:
    url = X.col(url)
    og = F.lower(X.col(og_type)) if og_type is not None else F.lit(None).cast("string")
    by_path = [("profile", r"facebook\.com/profile\.php\?id=\d+"), ("group", r"facebook\.com/groups/[^/]+"),
               ("event", r"facebook\.com/events/[^/]+"),
               ("post", r"facebook\.com/[^/]+/posts/\d+|facebook\.com/story\.php\?story_fbid=\d+&id=\d+"),
               ("page", r"facebook\.com/(?:pages|pg)/[^/]+|facebook\.com/[^/]+/about/?")]
    by_og = [("profile", ["profile"]), ("page", R.FACEBOOK_PAGE_OG), ("group", ["community"]), ("event", ["event"]),
             ("post", ["video.other"])]
    out = F
    for name, pattern in by_path:
        out = out.when(url.rlike(pattern), F.lit(name))
    for name, values in by_og:
        out = out.when(og.isin(values), F.lit(name))
    plain = url.rlike(r"facebook\.com/[a-zA-Z0-9_.]+$") & ~url.rlike(R.FACEBOOK_SYSTEM)
    return out.when(plain, "page").otherwise("unknown")


def skip_url(url) -> Column:
    u = X.col(url)
    return F.coalesce(~u.rlike(r"^https?://") | X.has_any(F.lower(u), R.SKIPPED_URL_PARTS), F.lit(True))


def company_url(url) -> Column:
    """Looks like the profile page of one company."""
    u = F.lower(X.col(url))
    avoid = X.has_any(u, R.COMPANY_URL_AVOID)
    li = u.contains("linkedin.com/company/")
    out = F
    for site, paths in R.COMPANY_URL_SITES:
        on_site = u.contains(site)
        out = out.when(on_site & X.has_any(u, paths) & ~avoid, True)
        if site == "thomasnet.com":
            out = out.when(on_site & X.has_any(u, R.THOMASNET_OWN), False)
        if site in ("thomasnet.com", "indiamart.com"):
            out = out.when(on_site & li, True)
    return F.coalesce(out.otherwise(X.has_any(u, R.COMPANY_URL_WORDS) & ~avoid), F.lit(False))


def page_type(url, html) -> Column:
    u, h = F.lower(X.col(url)), F.lower(X.col(html))
    return (F.when(X.has_any(u, R.SEARCH_URL_MARKS) & X.has_any(h, R.SEARCH_PAGE_WORDS), "search_results")
            .when(X.has_any(u, R.DIRECTORY_URL_WORDS) & X.has_any(h, R.DIRECTORY_PAGE_WORDS), "company_directory")
            .when(X.has_any(u, R.PROFILE_URL_WORDS) & X.has_any(h, R.PROFILE_PAGE_WORDS), "company_profile")
            .when(X.has_any(h, R.LISTING_PAGE_WORDS), "company_directory").otherwise("unknown"))


def site_kind(url, html) -> Column:
    """Earlier page classifier with social, news and listing kinds."""
    u, h = F.lower(X.col(url)), F.lower(X.col(html))
    return (F.when(X.has_any(h, R.SITE_KIND_DIRECTORY_WORDS) | X.has_any(u, R.SITE_KIND_DIRECTORY_URLS), "company_directory")
            .when(X.has_any(u, R.SITE_KIND_SOCIAL), "social_media").when(X.has_any(h, R.SITE_KIND_NEWS), "news_article")
            .when(X.has_any(h, R.SITE_KIND_LISTING), "business_listing").otherwise("generic"))


def directory_search_url(site, term) -> Column:
    base = F.regexp_replace(X.col(site), r"/+$", "")
    out = F
    for host, path in R.DIRECTORY_SEARCH_PATHS:
        out = out.when(base.contains(host), F.concat(base, F.lit(path), F.replace(X.col(term), F.lit(" "), F.lit("+"))))
    return out.otherwise(F.lit(None).cast("string"))


def icp_identifier(product_name, icp_json, at) -> Column:
    """Readable slug of the product, the minute, and a short hash of the profile text."""
    kept = F.lower(F.regexp_replace(F.coalesce(X.col(product_name), F.lit("Unknown")), r"[^\p{L}\p{N}\s]", ""))
    slug = F.substring(F.replace(kept, F.lit(" "), F.lit("-")), 1, 20)
    return F.concat_ws("_", slug, F.date_format(at, "yyyyMMdd_HHmm"), F.substring(F.md5(X.col(icp_json)), 1, 8))


# --- table jobs -----------------------------------------------------------------------------------------------

def filter_valid_urls(urls: DataFrame) -> DataFrame:
    return urls.filter(url_valid("url")).withColumn("url_type", url_type("url"))


def valid_counts(urls: DataFrame) -> DataFrame:
    ok = url_valid("url")
    return urls.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key. Spark keeps at most one row per key and map task before the shuffle (window group limit),
    so a key that holds a third of all rows still sends only one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def url_ingest(arrivals: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """Rows to append: first arrival of every URL that is not stored yet."""
    fresh = arrivals.join(stored.select("url"), "url", "left_anti")
    return (first_per_key(fresh, ["url"], "created_at", "id")
            .withColumn("search_query", F.lower("search_query"))
            .withColumn("url_type", url_type("url")).withColumn("scraped_at", as_of)
            .withColumn("processed", F.lit(False)))


def ingest_counts(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """total / new / duplicate counts of an ingest; rows are reduced per URL before the lookup."""
    per_url = arrivals.groupBy("url").agg(F.count("*").alias("n"))
    known = stored.select("url").distinct().withColumn("known", F.lit(True))
    return (per_url.join(known, "url", "left")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                 F.count_if(F.col("known").isNull()).alias("new_urls"))
            .withColumn("duplicates", F.col("total") - F.col("new_urls")))


def urls_by(urls: DataFrame, search_query: str | None = None, url_type: str | None = None,
            icp_identifier: str | None = None) -> DataFrame:
    if search_query is not None:
        urls = urls.filter(F.col("search_query") == search_query.lower())
    if url_type is not None:
        urls = urls.filter(F.col("url_type") == url_type)
    if icp_identifier is not None:
        urls = urls.filter(F.col("icp_identifier") == icp_identifier)
    return urls


def urls_unprocessed(urls: DataFrame, limit: int | None = None, processed: bool = False) -> DataFrame:
    done = F.coalesce(F.col("processed"), F.lit(False))
    rows = urls.filter(done if processed else ~done)
    return rows.orderBy("created_at", "id").limit(limit) if limit else rows


def urls_mark_processed(urls: DataFrame, listed: DataFrame, as_of: Column) -> DataFrame:
    """New version of the URL table with the listed URLs marked; ``modified`` tells which rows changed."""
    marks = listed.select("url").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return (urls.join(marks, "url", "left")
            .withColumn("modified", hit)
            .withColumn("processed", F.when(hit, True).otherwise(F.col("processed")))
            .withColumn("processed_at", F.when(hit, as_of)).drop("_hit"))


def url_type_stats(urls: DataFrame) -> DataFrame:
    return urls.groupBy("url_type").agg(F.count("*").alias("n"))


def url_available_counts(urls: DataFrame) -> DataFrame:
    return urls.groupBy("url_type").agg(
        F.count_if(~F.coalesce(F.col("processed"), F.lit(False))).alias("available"))


def url_db_stats(urls: DataFrame) -> DataFrame:
    return urls.agg(F.count("*").alias("total"), F.countDistinct("search_query").alias("queries"),
                    F.countDistinct("url_type").alias("types"))


def url_type_share(urls: DataFrame) -> DataFrame:
    """Share per type; the unpartitioned window runs over one row per type."""
    return (url_type_stats(urls)
            .withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4)))


def query_expand(queries: DataFrame, sources: list[str]) -> DataFrame:
    """Base queries plus one variant per selected source that has a search filter (per-row explode, no join)."""
    filters = [F.struct(F.lit(n).alias("source"), F.lit(f).alias("site_filter"))
               for n, _, f, _ in R.SOURCES if n in sources and f]
    titled = X.has_any(F.lower("query"), ["director", "manager", "head"])
    strong = F.when(titled, F.concat(F.lit('intitle:("director" OR "manager" OR "head") '), F.col("query"))).otherwise(F.col("query"))
    base = F.array(F.struct(F.lit("base").alias("source"), F.lit("").alias("site_filter")), *filters)
    return (queries.withColumn("_v", F.explode(base))
            .withColumn("source", F.col("_v.source"))
            .withColumn("expanded", F.when(F.col("source") == "base", F.col("query"))
                        .otherwise(X.strip(F.concat_ws(" ", strong, F.col("_v.site_filter")))))
            .drop("_v"))


def query_clean(texts: DataFrame, column: str, min_length: int = 15, top: int | None = None) -> DataFrame:
    """Lines of a text without bullets, numbers and quotes; optional ordered distinct and top n. No shuffle."""
    lines = F.transform(F.split(F.col(column), "\n"), lambda s: F.regexp_replace(
        F.regexp_replace(X.strip(s), r"^[0-9.\-• \"']+", ""), r"[\"']+$", ""))
    lines = F.filter(lines, lambda s: F.length(s) > min_length)
    if top is not None:
        lines = F.slice(F.array_distinct(lines), 1, top)
    return texts.select("*", F.posexplode(lines).alias("pos", "query")).drop(column)


def route_urls(urls: DataFrame) -> DataFrame:
    """The source that takes each URL type."""
    pairs = F.create_map(*[F.lit(v) for n, t, _, _ in R.SOURCES for v in (t, n)])
    return urls.withColumn("source", F.try_element_at(pairs, F.col("url_type"))).filter(F.col("source").isNotNull())


def url_quota(urls: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """A reproducible sample of n URLs per type, ordered by a hash of the URL."""
    quotas = quotas or R.QUOTAS
    limits = F.create_map(*[F.lit(v) for kv in quotas.items() for v in kv])
    w = Window.partitionBy("url_type").orderBy(F.md5("url"), "url", "id")
    return (urls.withColumn("pick", F.row_number().over(w))
            .filter(F.col("pick") <= max(quotas.values()))
            .filter(F.col("pick") <= F.coalesce(F.try_element_at(limits, F.col("url_type")), F.lit(0))))


def classification_lookup(urls: DataFrame, cache: DataFrame, as_of: Column, ttl_days: int = 7,
                          decay: float = 0.02) -> DataFrame:
    """Newest cached class of each URL, dropped after the time to live, its confidence reduced per whole day.
    A manual override is a cache row with a newer time stamp."""
    newest = first_per_key(cache, ["url"], F.desc("ts"), F.desc("is_override"), "classification")
    age = X.age_seconds("ts", as_of)
    days = F.floor(age / 86400)
    conf = F.when(days > 0, F.round(F.greatest(F.lit(0.0), F.col("confidence") * F.pow(F.lit(1 - decay), days)), 6))
    return (urls.join(newest.filter(age <= ttl_days * 86400), "url")
            .withColumn("confidence", F.coalesce(conf, F.col("confidence"))))


def company_links(links: DataFrame, cap: int | None = None) -> DataFrame:
    """``links(page_id, url, href, text)`` -> company profile links of each page, made absolute; in order of the link, at most
    ``cap`` of them where that is given."""
    base = F.regexp_replace(F.col("url"), r"/+$", "")
    absolute = (F.when(F.col("href").startswith("http"), F.col("href"))
                .when(F.col("href").startswith("/"), F.concat(base, F.col("href")))
                .otherwise(F.concat_ws("/", base, F.col("href"))))
    low = F.lower("link")
    kept = (links.filter(company_url("href") & X.has_any(F.lower(F.trim("text")), R.COMPANY_LINK_WORDS))
            .withColumn("link", absolute)
            .filter((F.length("link") > 10) & ~F.col("link").rlike(r"\.(?:pdf|jpg|png)$")
                    & ~X.has_any(low, R.COMPANY_LINK_INTERNAL))
            .select("page_id", "link").distinct())
    w = Window.partitionBy("page_id").orderBy("link")
    return up_to(kept.withColumn("rank", F.row_number().over(w)), cap)


def same_host_links(links: DataFrame, cap: int | None = None) -> DataFrame:
    """Earlier variant: links on the page's own host with at least two path segments."""
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    absolute = F.when(F.col("href").startswith("/"), F.concat(base, F.col("href"))).otherwise(F.col("href"))
    segments = F.size(F.filter(F.split(X.url_path("link"), "/"), lambda s: s != ""))
    kept = (links.withColumn("link", absolute)
            .filter((X.netloc("link") == X.netloc("url")) & (segments >= 2)).select("page_id", "link").distinct())
    w = Window.partitionBy("page_id").orderBy("link")
    return up_to(kept.withColumn("rank", F.row_number().over(w)), cap)


def leads_by_domain(leads: DataFrame, domain: str) -> DataFrame:
    return leads.filter(F.col("domain") == domain).orderBy(F.desc("scraped_at"), "id")


def directory_domains(results: DataFrame, top: int | None = None) -> DataFrame:
    """``results(search, pos, href)`` -> directory sites of each search in result order; a fixed list when none fits."""
    wrapped = F.col("href").contains("url?q=")
    target = F.regexp_extract("href", r"url\?q=([^&]*)", 1)
    target = F.replace(F.replace(target, F.lit("%3A"), F.lit(":")), F.lit("%2F"), F.lit("/"))
    site = F.when(wrapped, target).otherwise(F.col("href"))
    host = F.replace(X.netloc("site"), F.lit("www."), F.lit(""))
    hits = (results.withColumn("site", site)
            .filter(~X.has_any("href", ["google.com", "youtube.com"]) & ~X.has_any(host, R.DIRECTORY_RESULT_SKIP))
            .filter(X.has_any(F.lower("site"), R.DIRECTORY_RESULT_WORDS)))
    first = hits.groupBy("search", "site").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("search").orderBy("pos", "site")
    found = (up_to(first.withColumn("rank", F.row_number().over(w)), top)
             .select("search", "rank", "site"))
    empty = results.select("search").distinct().join(found.select("search").distinct(), "search", "left_anti")
    fallback = F.array(*[F.lit(s) for s in R.DIRECTORY_FALLBACK[:top]])
    return found.unionByName(empty.select("search", F.posexplode(fallback).alias("rank", "site"))
                             .withColumn("rank", F.col("rank") + 1))


def query_templates(icps: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """``icps(icp_identifier, persona, industry, region)`` -> filled query templates (three per platform)."""
    rows = [F.struct(F.lit(p).alias("platform"), F.lit(i).alias("slot"), F.lit(t).alias("template"))
            for p, ts in R.QUERY_TEMPLATES.items() if platforms is None or p in platforms for i, t in enumerate(ts)]
    out = icps.select("icp_identifier", "persona", "industry", "region", F.inline(F.array(*rows)))
    filled = F.col("template")
    for name in ("persona", "industry", "region"):
        default = F.regexp_extract("template", r"\{" + name + r"\|([^}]*)\}", 1)
        value = F.when(X.filled(name), F.col(name)).otherwise(default)
        slot = F.regexp_extract("template", r"\{" + name + r"\|[^}]*\}", 0)
        filled = F.when(slot == "", filled).otherwise(F.replace(filled, slot, value))
    return out.select("icp_identifier", "platform", "slot", X.strip(filled).alias("query"))
