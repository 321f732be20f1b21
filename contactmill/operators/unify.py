"""One projection per platform to the unified lead, and the rules that clean, validate and expand unified leads.

All projections are narrow per-row expressions: no shuffle, column pruning reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill import schemas
from contactmill.functions import text as X
from contactmill.operators import contacts as C
from contactmill.operators import scores as S

NAMES = ("instagram", "twitter", "facebook", "linkedin", "youtube", "tiktok")
STRINGS = "array<string>"


def txt(c) -> Column:
    return F.coalesce(X.col(c).cast("string"), F.lit(""))


def unified(url, platform, content_type, *, source=None, icp="default", profile=None, emails=None, phones=None, address="",
            websites=None, handles=None, other=None, bio_links=None, content=None, scraped_at=None, quality=None, **extra) -> list:
    """Columns of the unified table; whatever is not given is empty (nested) or null (additional fields)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    arr = lambda a: X.clean_array(a) if a is not None else F.array().cast(STRINGS)
    fill = lambda names, given: F.struct(*[txt(lit((given or {}).get(n, ""))).alias(n) for n in names])
    hand = F.struct(*[txt(lit((handles or {}).get(n, ""))).alias(n) for n in NAMES], arr(other).alias("other"))
    return [
        txt(url).alias("url"), lit(platform).alias("platform"), lit(content_type).alias("content_type"),
        lit(source or f"{platform}-scraper").alias("source"), lit(icp).alias("icp_identifier"),
        fill(("username", "full_name", "bio", "location", "job_title", "employee_count"), profile).alias("profile"),
        F.struct(arr(emails).alias("emails"), arr(phones).alias("phone_numbers"), txt(lit(address)).alias("address"),
                 arr(websites).alias("websites"), hand.alias("social_media_handles"), arr(bio_links).alias("bio_links")).alias("contact"),
        fill(("caption", "upload_date", "channel_name", "author_name"), content).alias("content"),
        (lit(scraped_at).cast("timestamp") if scraped_at is not None else F.lit(None).cast("timestamp")).alias("scraped_at"),
        (quality if quality is not None else F.lit(None).cast("double")).alias("data_quality_score"),
        *[lit(extra.get(c)).cast("string").alias(c) for c in schemas.EXTRAS]]


def unify_instagram(raw: DataFrame, icp="default") -> DataFrame:
    kind = F.col("content_type")
    profile = kind == "profile"
    return raw.filter(kind.isin("profile", "article", "video")).select(*unified(
        F.col("url"), "instagram", kind, icp=icp, scraped_at=F.col("scraped_at"),
        profile={"username": F.col("username"), "full_name": F.col("full_name"), "bio": F.col("biography"),
                 "job_title": F.col("business_category_name")},
        emails=F.array("business_email"), phones=F.array("business_phone_number"), handles={"instagram": F.col("username")},
        bio_links=F.col("bio_links"), content={"caption": F.when(~profile, F.col("caption")), "upload_date": F.when(~profile, F.col("post_date")),
                                              "author_name": F.col("username")},
        company_name=F.col("full_name"), quality=S.field_fill(*[X.filled(c) for c in (
            "full_name", "username", "url", "business_email", "business_phone_number")], F.lit(False))))


GENERIC_NAMES = [  # fixed values
    "sign up", "signup", "log in", "login", "register", "join now", "get started", "create account", "sign in", "signin",
    "continue", "next", "submit", "loading", "please wait", "error", "page not found", "404", "access denied",
    "unauthorized", "linkedin", "connect", "follow", "view profile"]


def linkedin_name_invalid(name) -> Column:
    n = F.lower(X.strip(txt(name)))
    return (n == "") | n.isin(GENERIC_NAMES)


def unify_linkedin(raw: DataFrame, icp="default") -> DataFrame:
    either = lambda a, b: F.when(X.filled(a), F.col(a)).otherwise(F.col(b))
    kind = F.when(F.col("url_type").isin("post", "newsletter"), "article").otherwise("profile")
    return raw.filter(~linkedin_name_invalid(either("author_name", "full_name"))).select(*unified(
        F.col("url"), "linkedin", kind, icp=icp, scraped_at=F.col("scraped_at"),
        profile={"username": F.col("username"), "full_name": either("full_name", "author_name"), "bio": either("about", "about_us"),
                 "location": F.col("location"), "job_title": F.col("job_title"),
                 "employee_count": F.when(F.col("employee_count") > 0, F.col("employee_count"))},
        address=F.col("address"), websites=F.array("website"), handles={"linkedin": either("username", "author_url")},
        content={"caption": F.col("headline"), "upload_date": F.col("date_published"), "author_name": either("author_name", "full_name")},
        company_name=F.col("full_name")))


def unify_youtube(raw: DataFrame, icp="default") -> DataFrame:
    """Channels become profiles, videos and shorts become videos; all handle links go to ``bio_links``."""
    kind = F.when(F.col("content_type") == "channel", "profile").when(F.col("content_type").isin("video", "shorts"), "video").otherwise(F.col("content_type"))
    m = F.coalesce(F.col("social_media_handles"), F.create_map().cast("map<string,array<struct<username:string,url:string>>>"))
    first = lambda n: F.get(F.try_element_at(m, F.lit(n)), F.lit(0))["username"]
    return raw.select(*unified(
        F.col("url"), "youtube", kind, icp=icp, scraped_at=F.col("scraped_at"),
        profile={"full_name": F.col("channel_name"), "bio": F.col("description")}, emails=F.col("email"),
        handles={**{n: first(n) for n in NAMES if n != "youtube"}, "youtube": F.col("channel_name")},
        bio_links=F.transform(F.flatten(F.map_values(m)), lambda h: h["url"]),
        content={"caption": F.col("title"), "upload_date": F.col("upload_date"), "channel_name": F.col("channel_name")},
        company_name=F.col("channel_name")))


def _ai_contacts() -> Column:
    return F.flatten(F.transform(F.filter("ai_leads", lambda a: a["ai_contacts"].isNotNull()), lambda a: a["ai_contacts"]))


def web_values(direct: str, nested: str) -> Column:
    """Distinct values of an array column and of the nested model contacts, in that order."""
    own = F.transform(X.clean_array(direct), X.strip)
    ai = F.coalesce(F.transform(_ai_contacts(), lambda c: X.strip(c[nested])), F.array().cast(STRINGS))
    return F.array_distinct(F.filter(F.concat(own, ai), lambda v: F.coalesce(v, F.lit("")) != ""))


def web_fallback(field: str, column: str | None) -> Column:
    """Organisation field of the first model lead, else the direct column."""
    org = F.get("ai_leads", F.lit(0))["organization_info"][field]
    own = F.col(column) if column else F.lit("")
    return X.strip(F.when(org.isNotNull(), org).otherwise(txt(own)))


def first_of_contacts(field: str) -> Column:
    vals = F.filter(F.transform(_ai_contacts(), lambda c: X.strip(c[field])), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.coalesce(F.get(vals, F.lit(0)), F.lit(""))


def unify_web(raw: DataFrame, icp="default") -> DataFrame:
    social = F.coalesce(F.col("social_media"), F.create_map().cast("map<string,string>"))
    other = F.map_values(F.map_filter(social, lambda k, v: ~k.isin(*NAMES) & (F.coalesce(v, F.lit("")) != "")))
    name = web_fallback("primary_name", "business_name")
    return raw.select(*unified(
        F.col("source_url"), "web", "profile", icp=icp, scraped_at=X.parse_ts("extraction_timestamp"),
        profile={"full_name": name, "location": web_fallback("location", "location")},
        emails=web_values("email", "email"), phones=web_values("phone", "phone"), address=web_fallback("location", None),
        websites=F.array("source_url"), handles={n: F.try_element_at(social, F.lit(n)) for n in NAMES}, other=F.array_sort(other),
        industry=web_fallback("industry", "industry"), lead_category=first_of_contacts("lead_category"),
        lead_sub_category=first_of_contacts("lead_sub_category"), company_name=name,
        company_type=web_fallback("organization_type", "company_type"), decision_makers=F.col("contact_person"),
        quality=S.field_fill(X.filled("business_name"), X.filled("source_url"), S.some("email"), S.some("phone"), S.some("ai_leads"))))


def unify_facebook(raw: DataFrame, icp="default") -> DataFrame:
    """``raw(url, url_type, scraped_at, extracted_data{...})``; unknown and restricted pages are dropped."""
    e, kind = (lambda f: F.col(f"extracted_data.{f}")), F.col("url_type")
    by = lambda **k: _switch(kind, k)
    return raw.filter(kind.isin("post", "page", "profile", "group", "event")).select(*unified(
        F.col("url"), "facebook", kind, icp=icp, scraped_at=F.col("scraped_at"),
        profile={"username": e("username"), "full_name": by(post=F.replace(txt(e("og_title")), F.lit(" | Facebook"), F.lit("")), other=e("name")),
                 "bio": by(post=e("og_description"), profile=e("bio"), other=e("description")),
                 "location": by(post=F.lit(""), other=e("location")),
                 "job_title": by(post=F.lit("Post"), page=e("category"), profile=e("job_title"), group=F.lit("Group"), event=F.lit("Event")),
                 "employee_count": by(group=e("member_count"), other=F.lit(""))},
        emails=e("emails"), phones=e("phone_numbers"), address=by(post=F.lit(""), group=F.lit(""), other=e("address")),
        websites=F.array(by(post=e("og_url"), page=e("website"), profile=e("website"), other=F.lit(None).cast("string"))),
        handles={"facebook": e("username")},
        content={"caption": by(post=e("og_description"), group=e("description"), event=e("description"), other=F.lit("")),
                 "upload_date": by(event=e("start_time"), other=F.lit("")), "channel_name": by(post=F.lit(""), other=e("name")),
                 "author_name": by(event=e("organizer"), other=e("name"))},
        company_name=e("name")))


def _switch(kind, cases: dict) -> Column:
    out = F
    for name, value in cases.items():
        if name != "other":
            out = out.when(kind == name, value)
    return out.otherwise(cases["other"]) if "other" in cases else out.otherwise(F.lit(""))


def _real(c) -> Column:
    return F.when(~X.col(c).isin("NA", "N/A", ""), X.col(c))


def unify_crawl(raw: DataFrame, icp="default") -> DataFrame:
    c = lambda f: _real(F.col(f"contact_info.{f}"))
    name = F.when(X.filled("name"), F.col("name")).otherwise(F.col("company_name"))
    return raw.select(*unified(
        F.col("source_url"), "web", F.col("content_type"), icp=icp, scraped_at=F.col("time"),
        profile={"full_name": name, "bio": F.col("bio"), "location": F.col("location")},
        emails=F.array(c("email")), phones=F.array(c("phone")), address=F.col("address"), websites=F.array(F.col("source_url"), c("website")),
        handles={"linkedin": c("linkedin"), "twitter": c("twitter")}, other=F.col("contact_info.socialmedialinks"),
        industry=F.col("industry"), lead_category=F.when(F.lower(txt("type")) == "lead", "potential_customer").otherwise("competitor"),
        lead_sub_category=F.col("lead_sub_category"), company_name=F.col("company_name"), company_type=F.col("company_type"),
        decision_makers=F.col("name")))


def unify_web_final(leads: DataFrame, icp="default") -> DataFrame:
    """Final web leads; a row needs a URL."""
    site = F.when(X.filled("source_url"), F.col("source_url")).otherwise(txt("website"))
    person = F.array_join(F.col("contact_person"), ", ")
    return leads.filter(site != "").select(*unified(
        site, "web", "profile", icp=icp, scraped_at=F.col("extraction_timestamp"),
        profile={"full_name": F.when(X.filled("business_name"), F.col("business_name")).otherwise(person), "location": F.col("address")},
        emails=F.col("email"), phones=F.col("phone"), address=F.col("address"), websites=F.array(site),
        industry=F.col("industry"), company_name=F.col("business_name"), decision_makers=person, quality=F.col("confidence_score")))


def unify_directory(raw: DataFrame, icp="default") -> DataFrame:
    """Directory rows; contacts and handles missing from the columns are read out of the free text."""
    text = F.concat_ws("\n", "notes", "bio")
    arr = lambda c, fallback: F.when(F.size(X.clean_array(c)) > 0, X.clean_array(c)).otherwise(fallback)
    found = C.lead_social(text)
    sites = arr("websites", C.lead_sites(text))
    return raw.withColumn("_t", text).select(*unified(
        F.col("source_url"), "web", F.col("page_type"), icp=icp, scraped_at=F.col("scraped_at"),
        profile={"full_name": F.col("name"), "bio": F.col("bio"), "location": F.col("location"), "employee_count": F.col("employee_count")},
        emails=arr("email", C.lead_emails("_t")), phones=arr("phone", C.lead_phones("_t")), address=F.col("address"), websites=sites,
        handles={n: F.coalesce(F.nullif(F.col(f"social_media.{n}"), F.lit("")), found[n]) if n != "tiktok" else found[n] for n in NAMES},
        other=F.filter(sites, lambda s: ~X.has_any(F.lower(X.netloc(s)), list(NAMES))),
        industry=F.col("industry"), revenue=F.col("revenue"), lead_category=F.coalesce("lead_category", F.lit("B2B")),
        lead_sub_category=F.coalesce("lead_sub_category", F.lit("Company")), company_name=F.col("organization"),
        company_type=F.col("company_type"), decision_makers=F.col("name")))


# --- rules on unified leads -----------------------------------------------------------------------------------

def clean_unified(leads: DataFrame) -> DataFrame:
    """Null profile fields become empty, empty array items disappear, missing columns are added."""
    fields = [f.name for f in leads.schema["profile"].dataType.fields]
    out = leads.withColumn("profile", F.struct(*[txt(f"profile.{f}").alias(f) for f in fields]))
    for a in ("emails", "phone_numbers", "websites", "bio_links"):
        out = out.withColumn("contact", F.col("contact").withField(a, X.clean_array(f"contact.{a}")))
    return ensure_schema(out)


def ensure_schema(leads: DataFrame) -> DataFrame:
    """Add the additional fields that the table does not have; present values are never touched."""
    for c in schemas.EXTRAS:
        if c not in leads.columns:
            leads = leads.withColumn(c, F.lit(None).cast("string"))
    return leads


def schema_gaps(leads: DataFrame) -> DataFrame:
    """How many rows lack each additional field (all of them, or none)."""
    missing = [c for c in schemas.EXTRAS if c not in leads.columns]
    return leads.agg(F.count("*").alias("rows"), F.lit(len(missing)).alias("missing_fields"),
                     (F.count("*") if missing else F.lit(0).cast("bigint")).alias("touched"))


def instagram_valid(raw: DataFrame) -> DataFrame:
    return raw.filter(X.any_of([~X.blank(c) for c in ("business_email", "business_phone_number", "username", "full_name")]))


def unified_valid() -> Column:
    """A contact, or at least a name."""
    some = lambda a: F.exists(X.clean_array(a), lambda v: ~X.blank(v))
    names = ("profile.full_name", "profile.username", "company_name", "content.author_name")
    return some("contact.emails") | some("contact.phone_numbers") | X.any_of([~X.blank(c) for c in names])


def linkedin_structured(rows: DataFrame) -> DataFrame:
    """``rows(url, json fields ld_*, meta fields og_*)`` -> one typed record per page; a name or headline is required."""
    from contactmill.operators.pages import title_part
    from contactmill.operators.urls import linkedin_url_type, linkedin_username
    kind = linkedin_url_type("url")
    name = X.first_reliable("ld_name", F.get(F.split("og_title", r" \| "), F.lit(0)))
    return rows.select(
        "url", kind.alias("url_type"), linkedin_username("url").alias("username"),
        F.when(kind == "post", F.lit(None).cast("string")).otherwise(name).alias("full_name"),
        F.when(kind == "profile", X.first_reliable("ld_job_title", title_part("og_title"))).alias("job_title"),
        F.when(kind == "post", X.first_reliable("ld_headline", "og_title")).alias("headline"),
        X.first_reliable("ld_description", "og_description").alias("about"),
        X.reliable_int("ld_followers").alias("followers"), X.reliable_int("ld_employees").alias("employee_count"),
    ).filter(X.filled("full_name") | X.filled("headline") | X.filled("job_title"))


def instagram_clean(rows: DataFrame) -> DataFrame:
    """Typed record per content type; empty business fields are null, contacts come from the caption or biography."""
    from contactmill.operators.urls import instagram_content_type
    kind = instagram_content_type("url", "is_video")
    post = F.col("content_type") != "profile"
    text = F.when(post, F.col("caption")).otherwise(F.col("biography"))
    num = lambda c: X.short_count_trimmed(c)
    return (rows.withColumn("content_type", kind).filter("content_type <> 'unknown'").select(
        "url", "content_type", "username", F.when(~post, F.col("full_name")).alias("full_name"),
        F.when(~post, num("followers_count")).alias("followers_count"), F.when(post, num("likes_count")).alias("likes_count"),
        F.when(post, F.col("caption")).alias("caption"), F.when(~post, F.col("biography")).alias("biography"),
        F.coalesce(F.when(~post, X.null_if_blank("business_email")), C.caption_email(text)).alias("business_email"),
        F.coalesce(F.when(~post, X.null_if_blank("business_phone_number")), F.when(post, C.caption_phone(text))).alias("business_phone_number")))


def youtube_clean(rows: DataFrame) -> DataFrame:
    """Merge API, script and metadata values by page type (in that order) into one record."""
    from contactmill.operators.urls import youtube_page_type
    kind = youtube_page_type("url")
    best = lambda f: X.first_reliable(f"api_{f}", f"script_{f}", f"meta_{f}")
    handles = C.social_handles(F.col("description"))
    step = rows.select("url", kind.alias("content_type"), best("title").alias("title"), best("channel_name").alias("channel_name"),
                       X.short_count(best("views")).alias("views"), X.short_count(best("subscribers")).alias("subscribers"),
                       best("description").alias("description"))
    return step.filter(F.col("content_type").isin("video", "shorts", "channel")).select(
        "url", "content_type", F.when(F.col("content_type") != "channel", F.col("title")).alias("title"), "channel_name",
        F.when(F.col("content_type") != "channel", F.col("views")).alias("views"),
        F.when(F.col("content_type") != "shorts", F.col("subscribers")).alias("subscribers"), "description",
        handles.alias("handles"))


# --- extraction to leads --------------------------------------------------------------------------------------

def lead_from_extraction(ext: DataFrame) -> DataFrame:
    """Extraction rows to the lead model: value arrays, composite confidences, contact persons."""
    conf = lambda a: S.composite_confidence(F.transform(a, lambda x: x["confidence"]))
    val = lambda a, f="value": F.transform(a, lambda x: x[f])
    named = F.array(*[F.when(F.size(a) > 0, F.struct(F.lit(k).alias("k"), conf(a).alias("v")))
                      for k, a in [("email", "emails"), ("phone", "phones"), ("address", "addresses"), ("website", "websites")]])
    return ext.select(
        X.lead_id(F.lit("web"), "url").alias("id"), F.col("url").alias("source_url"), F.col("company_name").alias("business_name"),
        val("people", "name").alias("contact_person"), val("emails").alias("email"), val("phones").alias("phone"),
        val("addresses").alias("address"), val("websites", "url").alias("website"), "social_media", "industry", "services",
        F.col("score.total_score").alias("lead_score"), F.col("score.classification").alias("lead_classification"),
        F.map_from_entries(F.array_compact(named)).alias("confidence_scores"), F.array("url").alias("data_sources"))


def final_leads(leads: DataFrame) -> DataFrame:
    """Main row of each URL plus rows for model contacts with a new name, email or phone and for other organisations.

    One narrow explode after the choice of the first row per URL: the rows of a lead are built from its own arrays.
    """
    from contactmill.operators.urls import first_per_key
    one = first_per_key(leads, ["source_url"], "id")
    ai = F.coalesce(F.col("ai_leads"), F.array().cast(f"array<{schemas.AI_LEAD}>"))
    blank = F.lit(None).cast("string")
    row = lambda kind, suffix, name, email, phone, org, a: F.struct(
        F.lit(kind).alias("lead_kind"), F.concat(F.col("id"), suffix).alias("final_id"), name.alias("contact_name"), email.alias("contact_email"),
        phone.alias("contact_phone"), org.alias("organization"), a.alias("ai"))
    none_ai = F.lit(None).cast(schemas.AI_LEAD)
    main = F.array(row("main", F.lit(""), blank, blank, blank, blank, none_ai))
    new = lambda v, known: (F.coalesce(v, F.lit("")) != "") & ~F.array_contains(X.clean_array(known), v)

    def per_lead(a, i):
        contacts = F.coalesce(a["ai_contacts"], F.array().cast(f"array<{schemas.AI_CONTACT}>"))
        indexed = F.transform(contacts, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        fresh = F.filter(indexed, lambda x: new(x["c"]["name"], "contact_person") | new(x["c"]["email"], "email") | new(x["c"]["phone"], "phone"))
        rows = F.transform(fresh, lambda x: row("contact", F.concat(F.lit("_contact_"), x["j"].cast("string")), x["c"]["name"], x["c"]["email"],
                                                x["c"]["phone"], blank, a))
        org = a["organization_info"]["primary_name"]
        other = (F.coalesce(org, F.lit("")) != "") & ~F.coalesce(org == F.col("business_name"), F.lit(False))
        return F.concat(rows, F.filter(F.array(row("organization", F.concat(F.lit("_org_"), i.cast("string")), blank, blank, blank, org, a)), lambda _: other))

    rows = F.concat(main, F.flatten(F.transform(ai, per_lead)))
    return one.withColumn("_r", F.explode(rows)).select("*", "_r.*").drop("_r")


def final_entry(rows: DataFrame) -> DataFrame:
    """Final columns of each row of ``final_leads``: own values first, model values where they exist."""
    pick = lambda v, arr: F.when(F.coalesce(v, F.lit("")) != "", F.array(v)).otherwise(X.clean_array(arr))
    best = F.array_sort(F.transform(F.col("ai.addresses"), lambda x, i: F.struct((-F.coalesce(x["confidence"], F.lit(0.0))).alias("k"), i.alias("i"), x["address"].alias("address"))))
    more = F.coalesce(F.col("ai.organization_info.services"), F.array().cast(STRINGS))
    return rows.select(
        F.col("final_id").alias("id"), "lead_kind", "source_url", pick(F.col("contact_name"), "contact_person").alias("contact_person"),
        F.coalesce("organization", "business_name").alias("business_name"), pick(F.col("contact_email"), "email").alias("email"),
        pick(F.col("contact_phone"), "phone").alias("phone"), F.get(best, F.lit(0))["address"].alias("address"),
        F.coalesce(F.nullif(F.col("ai.organization_info.industry"), F.lit("")), "industry").alias("industry"),
        F.array_sort(F.array_union(X.clean_array("services"), more)).alias("services"),
        S.overall_confidence("confidence_scores").alias("confidence_score"))


def has_contact() -> Column:
    return (F.size(web_values("email", "email")) > 0) | (F.size(web_values("phone", "phone")) > 0)


def leadgen_rows(raw: DataFrame, processed_at: Column, defaults: dict | None = None) -> DataFrame:
    """One CRM row per distinct email, or per distinct phone where a lead has no email.

    Names and the second contact come from the last model contact with that email or phone; constants such as
    employees and revenue stay null unless ``defaults`` gives them.
    """
    d = {"No of Employees": None, "Revenue": None, "Lead Score": None, **(defaults or {})}
    step = raw.withColumn("_e", web_values("email", "email")).withColumn("_p", web_values("phone", "phone")).withColumn("_c", _ai_contacts())
    by_mail = F.size("_e") > 0
    picked = step.withColumn("_kind", F.when(by_mail, "email").otherwise("phone")).withColumn("_v", F.explode(F.when(by_mail, F.col("_e")).otherwise(F.col("_p"))))
    match = F.filter("_c", lambda c: F.coalesce(F.when(F.col("_kind") == "email", X.strip(c["email"])).otherwise(X.strip(c["phone"])) == F.col("_v"), F.lit(False)))
    last = picked.withColumn("_m", F.try_element_at(match, F.lit(-1)))
    trimmed = lambda c: X.strip(txt(c))
    name = F.when(trimmed("_m.name") != "", trimmed("_m.name")).otherwise(trimmed("contact_person"))
    mail = F.col("_kind") == "email"
    const = lambda k: F.lit(d[k]).cast("string")
    return last.select(
        web_fallback("primary_name", "business_name").alias("Company Name"), web_fallback("industry", "industry").alias("Industry"),
        const("No of Employees").alias("No of Employees"), const("Revenue").alias("Revenue"),
        first_of_contacts("lead_category").alias("Lead Category"), first_of_contacts("lead_sub_category").alias("Lead Sub Category"),
        web_fallback("organization_type", "company_type").alias("Company Type"), trimmed("source_url").alias("Lead Source"),
        *[F.lit(None).cast("string").alias(c) for c in ("Product Interests", "Timeline", "Interest Level")],
        name.alias("Contact Name"), F.when(mail, F.col("_v")).otherwise(trimmed("_m.email")).alias("Email Address"),
        F.when(mail, trimmed("_m.phone")).otherwise(F.col("_v")).alias("Phone Number"), trimmed("source_url").alias("Company Website"),
        F.coalesce(F.date_format(X.parse_ts("extraction_timestamp"), "yyyy-MM-dd HH:mm:ss"), F.date_format(processed_at, "yyyy-MM-dd HH:mm:ss")).alias("Date Captured"),
        trimmed("contact_person").alias("Decision Makers"), F.coalesce(F.col("lead_score").cast("string"), const("Lead Score")).alias("Lead Score"),
        F.col("social_media").alias("Social Media Link"), F.col("id").alias("original_web_lead_id"),
        processed_at.alias("processed_at"), F.col("_kind").alias("primary_contact_type"))
