"""Contacts out of text and HTML: find, score, validate, normalise and join.

A document or page is one row, so arrays of finds are bounded by its text.  Nothing here shuffles, except the
enrichment join at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import contact_rules as R
from contactmill.functions import text as X

EMPTY = "array<string>"
DIGIT_RUN = r"\d[-.\s()]*\d[-.\s()]*\d"  # every phone pattern needs at least this
PHONE_KIND = "array<struct<value:string,clean_value:string,confidence:double,source:string,context:string>>"


def first_of(arr, key, kind: str, start=None) -> Column:
    """Fold that keeps the first item of every key; ``start`` holds items that were kept before."""
    start = F.array().cast(kind) if start is None else start.cast(kind)
    return F.aggregate(arr.cast(kind), start, lambda acc, x: F.when(
        F.exists(acc, lambda a: key(a) == key(x)), acc).otherwise(F.concat(acc, F.array(x))))


def finds(text, pattern: str) -> Column:
    """All matches with their zero-based start: array of (value, start).

    The gaps between matches come from one ``split`` and the start positions from a running sum over the zipped
    gaps, so the text is scanned twice whatever the number of matches.
    """
    text = X.col(text)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.filter(F.zip_with(X.extract_all(text, pattern), gaps,
                                 lambda v, g: F.struct(v.alias("value"), g.alias("gap"))), lambda z: z["value"].isNotNull())
    none = F.array().cast("array<struct<value:string,start:int>>")
    folded = F.aggregate(
        zipped, F.struct(F.lit(0).alias("pos"), none.alias("out")),
        lambda acc, z: F.struct(
            (acc["pos"] + z["gap"] + F.length(z["value"])).alias("pos"),
            F.concat(acc["out"], F.array(F.struct(z["value"].alias("value"), (acc["pos"] + z["gap"]).alias("start")))).alias("out")),
        lambda acc: acc["out"])
    return F.coalesce(folded, none)


def around(text, find, width: int) -> Column:
    """Lower-cased text from ``width`` characters before a find to ``width`` after it."""
    first = F.greatest(find["start"] - width, F.lit(0))
    size = find["start"] + F.length(find["value"]) + width - first
    return F.lower(F.substring(X.col(text), first + 1, size))


# --- phones ---------------------------------------------------------------------------------------------------

def phone_plausible(clean) -> Column:
    clean = X.col(clean)
    bare = F.regexp_replace(F.regexp_replace(clean, r"^\++", ""), r"^0+", "")
    limit = F.length(clean) * 0.7
    return F.coalesce((F.length(clean) >= 7) & F.length(bare).between(7, 15)
                      & (F.regexp_count(clean, F.lit("0")) <= limit) & (F.regexp_count(clean, F.lit("1")) <= limit), F.lit(False))


def phone_false_positive(value, context) -> Column:
    """Menu words nearby, a bare year, or a long digit run next to 'id'."""
    value, context = X.col(value), X.col(context)
    return (X.has_any(context, R.NAVIGATION_WORDS) | value.rlike(r"^\d{4}$")
            | (value.rlike(r"^\d{8,}$") & context.contains("id")))


def near_duplicate(phone, seen) -> Column:
    """Equal to, inside or around a number already kept, with a length difference of at most two."""
    return F.exists(seen, lambda s: (F.contains(s, phone) | F.contains(phone, s))
                    & (F.abs(F.length(s) - F.length(phone)) <= 2))


def drop_near_duplicates(candidates, seen) -> Column:
    """Keep, in order, every candidate whose ``clean_value`` is no near duplicate of an earlier kept one."""
    return F.aggregate(
        candidates, F.struct(seen.alias("seen"), F.array().cast(PHONE_KIND).alias("out")),
        lambda acc, c: F.when(near_duplicate(c["clean_value"], acc["seen"]), acc).otherwise(F.struct(
            F.concat(acc["seen"], F.array(c["clean_value"])).alias("seen"),
            F.concat(acc["out"], F.array(c)).alias("out"))),
        lambda acc: acc["out"])


def by_confidence(arr) -> Column:
    """Sort by confidence, highest first, ties in the given order."""
    keyed = F.transform(arr, lambda x, i: F.struct((-x["confidence"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def phones(text, html=None) -> Column:
    """Array of (value, clean_value, confidence, source, context), highest confidence first."""
    return X.let(F.coalesce(X.col(text), F.lit("")), lambda t: _phones(t, html))


def _phones(text, html) -> Column:
    links = X.extract_all(F.coalesce(X.col(html), F.lit("")), r"(?i)href=[\"']tel:([^\"']+)[\"']", 1) if html is not None \
        else F.array().cast(EMPTY)
    entry = lambda v, clean, conf, src, ctx: F.struct(v.alias("value"), clean.alias("clean_value"),
                                                      conf.cast("double").alias("confidence"), src.alias("source"), ctx.alias("context"))
    tel = F.transform(links, lambda t: entry(t, X.phone_key(t), F.lit(0.95), F.lit("tel_link"), F.lit("HTML tel: link")))
    tel = F.filter(tel, lambda t: t["clean_value"] != "")
    tel = first_of(tel, lambda t: t["clean_value"], PHONE_KIND)

    def candidate(f):
        near = F.lower(F.coalesce(around(text, f, 50), F.lit("")))
        conf = (F.lit(0.7) + F.when(X.has_any(near, R.PHONE_WORDS), 0.15).otherwise(0.0)
                + F.when(X.has_any(near, R.MOBILE_WORDS), 0.1).otherwise(0.0))
        return entry(X.strip(f["value"]), X.phone_key(f["value"]), conf, F.lit("text_pattern"), X.strip(near))

    lists = [F.transform(F.filter(finds(text, p), lambda f: phone_plausible(X.phone_key(f["value"]))
                                  & ~phone_false_positive(f["value"], around(text, f, 100))), candidate) for p in R.PHONE_PATTERNS]
    has_digits = text.rlike(DIGIT_RUN)
    found = F.when(has_digits, F.concat(*lists).cast(PHONE_KIND)).otherwise(F.array().cast(PHONE_KIND))
    kept = drop_near_duplicates(found, F.transform(tel, lambda t: t["clean_value"]))
    return by_confidence(F.concat(tel, kept))


# --- emails ---------------------------------------------------------------------------------------------------

def email_role(email) -> Column:
    return X.first_rule(F.lower(F.substring_index(X.col(email), "@", 1)), R.EMAIL_ROLES, F.lit("personal"))


def emails(text, html=None) -> Column:
    """Array of (value, confidence, role, source, is_personal), highest confidence first."""
    return X.let(F.coalesce(X.col(text), F.lit("")), lambda t: _emails(t, html))


def _emails(text, html) -> Column:
    def entry(value, conf, source):
        role = email_role(value)
        return F.struct(value.alias("value"), conf.cast("double").alias("confidence"), role.alias("role"),
                        F.lit(source).alias("source"), (~role.isin(R.SHARED_ROLES)).alias("is_personal"))

    kind = "array<struct<value:string,confidence:double,role:string,source:string,is_personal:boolean>>"
    if html is not None:
        raw = X.extract_all(F.coalesce(X.col(html), F.lit("")), r"(?i)href=[\"']mailto:([^\"']+)[\"']", 1)
        raw = F.array_distinct(F.filter(F.transform(raw, lambda m: X.strip(F.substring_index(m, "?", 1))), lambda m: m.contains("@")))
        linked = F.transform(raw, lambda m: entry(m, F.lit(0.95), "mailto_link"))
    else:
        linked = F.array().cast(kind)
    found = F.transform(finds(text, R.EMAIL), lambda f: entry(
        F.lower(f["value"]), F.when(X.has_any(around(text, f, 30), R.EMAIL_WORDS), 0.9).otherwise(0.8), "text_pattern"))
    kept = first_of(found, lambda e: e["value"], kind, linked)
    return F.when(text.contains("@") | (F.size(linked) > 0), by_confidence(kept)).otherwise(F.array().cast(kind))


# --- addresses ------------------------------------------------------------------------------------------------

def address_false_positive(address, context) -> Column:
    address = X.col(address)
    capitals = F.regexp_count(address, F.lit(r"\p{Lu}")) / F.length(address)
    return (X.has_any(F.lower(address), R.ADDRESS_REJECT_WORDS) | (capitals > 0.3)
            | X.has_any(X.col(context), R.ADDRESS_SENTENCE_WORDS))


def addresses(text) -> Column:
    """Array of (value, confidence, type, source), highest confidence first."""
    return X.let(F.coalesce(X.col(text), F.lit("")), _addresses)


def _addresses(text) -> Column:
    def entry(f):
        v = X.strip(f["value"])
        conf = (F.lit(0.6) + F.when(v.rlike(r"\d{5}(?:-\d{4})?"), 0.2).otherwise(0.0)
                + F.when(X.has_any(F.lower(v), R.ADDRESS_STREET_WORDS), 0.1).otherwise(0.0))
        return F.struct(v.alias("value"), conf.alias("confidence"),
                        F.when(F.lower(v).contains("box"), "po_box").otherwise("street").alias("type"),
                        F.lit("text_pattern").alias("source"))

    kind = "array<struct<value:string,confidence:double,type:string,source:string>>"
    lists = [F.transform(F.filter(finds(text, p), lambda f: ~address_false_positive(X.strip(f["value"]), around(text, f, 20))), entry)
             for p in R.ADDRESS_PATTERNS]
    once = first_of(F.concat(*lists), lambda a: a["value"], kind)
    return F.when(text.rlike(r"\d"), by_confidence(once)).otherwise(F.array().cast(kind))


# --- websites and social --------------------------------------------------------------------------------------

def skip_host(host, own_host) -> Column:
    host = X.col(host)
    bare = host.rlike(r"^[^.]*\.(?:tech|dev)$")
    return (host == X.col(own_host)) | X.has_any(host, R.SKIPPED_HOSTS) | bare


def is_social(host) -> Column:
    return X.has_any(host, R.SOCIAL_HOSTS)


def social_name(host) -> Column:
    return X.first_rule(host, R.SOCIAL_NAMES, F.lit("Unknown"))


def business_host(host) -> Column:
    return ~X.has_any(host, R.STORE_HOSTS) & X.has_any(host, R.BUSINESS_HOST_WORDS)


def absolute_url(url) -> Column:
    """Add the scheme where it is missing; null for relative links and fragments."""
    url = X.col(url)
    return (F.when(url.rlike(r"^https?://"), url).when(url.startswith("www."), F.concat(F.lit("https://"), url))
            .when(url.contains(".") & ~url.startswith("/"), F.concat(F.lit("https://"), url)))


def outlinks(text, html, url) -> Column:
    """Distinct absolute links in page order as (url, host), skipped hosts removed."""
    hrefs = X.extract_all(F.coalesce(X.col(html), F.lit("")), r"(?i)href=[\"']([^\"']+)[\"']", 1)
    found = F.concat(hrefs, X.extract_all(F.coalesce(X.col(text), F.lit("")), R.TEXT_URL))
    full = F.array_distinct(F.filter(F.transform(found, absolute_url), lambda u: u.isNotNull()))
    pairs = F.transform(full, lambda u: F.struct(u.alias("url"), F.lower(X.netloc(u)).alias("host")))
    return X.let(F.coalesce(X.netloc(url), F.lit("")), lambda own: F.filter(pairs, lambda p: ~skip_host(p["host"], own)))


def websites(links) -> Column:
    keep = F.filter(links, lambda p: ~is_social(p["host"]) & business_host(p["host"]))
    return F.transform(keep, lambda p: F.struct(p["url"].alias("url"), p["host"].alias("domain"),
                                                F.lit(0.8).alias("confidence"), F.lit("link_extraction").alias("source")))


def social_media(links) -> Column:
    keep = F.filter(links, lambda p: is_social(p["host"]))
    return F.transform(keep, lambda p: F.struct(social_name(p["host"]).alias("platform"), p["url"].alias("url"),
                                                F.lit(0.9).alias("confidence"), F.lit("link_extraction").alias("source")))


# --- strict validation ----------------------------------------------------------------------------------------

def strict_email(email) -> Column:
    email = X.col(email)
    low = F.lower(email)
    ok = (F.length(email).between(5, 100) & email.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
          & ~X.has_any(low, R.ASSET_SUFFIXES) & ~low.rlike(R.ASSET_WORDS) & ~email.rlike(r"\d{8,}")
          & ~F.substring_index(low, "@", -1).isin(R.SAMPLE_DOMAINS))
    return F.coalesce(ok, F.lit(False))


def strict_phone(phone) -> Column:
    phone = X.col(phone)
    shape = F.regexp_replace(phone, r"[^\d+\-().\s]", "")
    d = X.digits(phone)
    n = F.length(d)
    epoch = (n == 10) & d.rlike("^[12]") & d.try_cast("bigint").between(946684800, 2524608000)
    bad = ((shape.contains(".") & shape.contains(" ")) | ~n.between(7, 15) | ((n == 13) & d.startswith("1")) | epoch
           | (F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) == 0) | ((n >= 8) & d.rlike(R.RISING_DIGITS))
           | ((F.length(phone) == n) & (n > 10)) | (~phone.startswith("+") & d.startswith("0") & (n > 7)))
    return F.coalesce(~bad & (phone != ""), F.lit(False))


def strict_site(site) -> Column:
    return F.coalesce(X.col(site).rlike(r"^(?:https?://|www\.)"), F.lit(False))


def raw_contact_scan(html) -> Column:
    """Emails, phones and sites anywhere in the source, hidden elements and metadata included, strictly validated."""
    html = F.coalesce(X.col(html), F.lit(""))
    group = lambda p: 1 if "(" in p.replace("(?", "").replace(r"\(", "") else 0
    scan = lambda ps: F.concat(*[X.extract_all(html, p, group(p)) for p in ps])
    tidy = lambda arr, ok: F.array_sort(F.array_distinct(F.filter(F.transform(arr, X.strip), ok)))
    return F.struct(tidy(scan(R.SOURCE_EMAILS), strict_email).alias("emails"),
                    tidy(scan(R.SOURCE_PHONES), strict_phone).alias("phones"),
                    tidy(scan(R.SOURCE_SITES), strict_site).alias("websites"))


def merge_contact_sources(*arrays) -> Column:
    """Sorted union of several arrays; null arrays count as empty."""
    return F.array_sort(F.array_distinct(F.concat(*[X.clean_array(a) for a in arrays])))


def nanp_phone_valid(phone) -> Column:
    phone = X.col(phone)
    d = X.digits(phone)
    ok = ((F.length(X.strip(phone)) >= 10) & ((F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1")))
          & ~d.rlike(R.NANP_REJECT))
    return F.coalesce(ok, F.lit(False))


# --- lead text ------------------------------------------------------------------------------------------------

def lead_emails(text) -> Column:
    text = F.coalesce(X.col(text), F.lit(""))
    all_ = F.transform(F.concat(*[X.extract_all(text, p) for p in R.LEAD_EMAILS]), lambda e: F.lower(X.strip(e)))
    return F.array_sort(F.array_distinct(F.filter(all_, lambda e: e.contains("@") & e.contains(".") & (F.length(e) > 5))))


def lead_phones(text) -> Column:
    text = F.coalesce(X.col(text), F.lit(""))
    group = lambda p: 1 if r"(\+?\d[" in p else 0
    all_ = F.transform(F.concat(*[X.extract_all(text, p, group(p)) for p in R.LEAD_PHONES]), X.strip)
    return F.array_sort(F.array_distinct(F.filter(all_, nanp_phone_valid)))


def lead_sites(text) -> Column:
    return F.array_sort(F.array_distinct(X.extract_all(F.coalesce(X.col(text), F.lit("")), R.LEAD_SITES)))


def lead_social(text) -> Column:
    low = F.lower(X.col(text))
    return F.struct(*[X.extract(low, p).alias(n) for n, p in R.LEAD_SOCIAL])


def lead_text_contacts(leads: DataFrame, *columns: str) -> DataFrame:
    """Contacts and handles out of the text columns of a lead."""
    step = leads.withColumn("_t", F.concat_ws("\n", *columns))
    return step.select("id", lead_emails("_t").alias("emails"), lead_phones("_t").alias("phones"),
                       lead_sites("_t").alias("websites"), lead_social("_t").alias("social"))


def caption_email(text) -> Column:
    return F.when(X.col(text).contains("@"), X.extract(text, R.CAPTION_EMAIL, 0))


def caption_phone(text) -> Column:
    """First number of the first pattern whose first match has 10 to 15 digits, separators removed. Only texts with ten
    digits in a row, separators aside, are searched: no pattern finds so many elsewhere."""
    tries = []
    for p in R.CAPTION_PHONES:
        v = F.regexp_replace(X.extract(text, p, 0), r"[-.\s]+", "")
        tries.append(F.when(F.length(X.digits(v)).between(10, 15), v))
    return F.when(X.col(text).rlike(R.CAPTION_DIGITS), F.coalesce(*tries))


def social_handles(text) -> Column:
    """Array of (platform, username, url); one entry per platform and name, whatever its case."""
    return X.let(F.coalesce(X.col(text), F.lit("")), _handles)


def _handles(text) -> Column:
    parts = []
    for platform, prefix, suffix, patterns in R.HANDLE_PATTERNS:
        names = F.concat(*[X.extract_all(text, p, 1) for p in patterns])
        good = (lambda h: F.length(h) > 5) if platform == "email" else (lambda h: (F.length(h) > 1) & ~h.rlike(r"^\d+$"))
        names = F.filter(names, good)
        once = first_of(names, F.lower, EMPTY)
        parts.append(_linked(once, platform, prefix, suffix))
    return F.concat(*parts)


def _linked(names, platform: str, prefix: str, suffix: str) -> Column:
    return F.transform(names, lambda h: F.struct(F.lit(platform).alias("platform"), h.alias("username"),
                                                 F.concat(F.lit(prefix), h, F.lit(suffix)).alias("url")))


def fb_emails(html) -> Column:
    return F.array_sort(F.array_distinct(X.extract_all(html, R.FACEBOOK_EMAIL)))


def fb_phones(html) -> Column:
    return F.array_sort(F.array_distinct(F.filter(X.extract_all(html, R.FACEBOOK_PHONE), lambda p: F.length(X.digits(p)) >= 7)))


def contact_verdicts(leads: DataFrame) -> DataFrame:
    """``leads(id, emails, phones)`` -> one row per distinct value with its verdict and the reason."""
    both = F.concat(
        F.transform(F.array_distinct(X.clean_array("emails")), lambda e: F.struct(
            F.lit("email").alias("kind"), e.alias("value"), e.rlike(r"^[^@]+@[^@]+\.[^@]+$").alias("valid"), F.lit("regex").alias("reason"))),
        F.transform(F.array_distinct(X.clean_array("phones")), lambda p: F.struct(
            F.lit("phone").alias("kind"), p.alias("value"), (F.length(X.digits(p)) >= 7).alias("valid"), F.lit("length>=7").alias("reason"))))
    return leads.select("id", F.inline(both))


def enrich_contacts(leads: DataFrame, profiles: DataFrame, domain_emails: DataFrame) -> DataFrame:
    """Phones from a saved profile table (biography and business number) and emails from a saved domain table.

    ``profiles(username, biography, business_phone, website)`` has one row per name, ``domain_emails(domain,
    emails)`` one row per domain with its array, so the joins never multiply leads.  A domain that very many leads
    share is a skewed left join side, which adaptive execution splits.
    """
    from contactmill.operators.urls import url_domain
    j = (leads.join(profiles, "username", "left").withColumn("domain", url_domain("website"))
         .join(domain_emails.withColumnRenamed("emails", "found_emails"), "domain", "left"))
    found = F.array_compact(F.array(X.extract("biography", R.BIO_PHONE, 0), X.null_if_blank("business_phone")))
    return j.select("id", X.clean_array("found_emails").alias("emails"), found.alias("phone_numbers")).filter(
        (F.size("emails") > 0) | (F.size("phone_numbers") > 0))


def meaningful_contact(**cols) -> Column:
    """Any of the given columns filled (arrays: not empty)."""
    return X.any_of([X.filled(c) for c in cols.values()])


def crawl_meaningful(lead_type, name, company, source_url, *contacts) -> Column:
    """Contact present and a name or company; a social profile passes with its URL alone."""
    real = lambda c: F.coalesce(~X.col(c).isin(R.MISSING_WORDS), F.lit(False))
    social = (F.coalesce(X.col(lead_type), F.lit("")) == "social_media_profile") & real(source_url)
    return social | (X.any_of([real(c) for c in contacts]) & (real(name) | real(company)))
