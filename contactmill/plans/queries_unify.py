"""Unify queries and their SQL twins; nested inputs are built in Spark, outputs are compared flattened."""

from pyspark.sql import functions as F

from contactmill import schemas
from contactmill.functions import text as X
from contactmill.operators import unify as G
from contactmill.plans.catalog import query
from contactmill.plans.derived import AS_OF_SQL, as_of, q, twin

ARR = "array<string>"
FLAT = {"username": "profile.username", "full_name": "profile.full_name", "bio": "profile.bio", "location": "profile.location", "job_title": "profile.job_title",
        "caption": "content.caption", "author_name": "content.author_name"}


def flat(df, *cols):
    """Shared flattened view of unified rows."""
    pick = [F.col(FLAT[c]).alias(c) if c in FLAT else F.col(c) for c in cols]
    return df.select("url", "platform", "content_type", *pick, F.array_join("contact.emails", ",").alias("emails"),
                     F.array_join("contact.phone_numbers", ",").alias("phones"))


IG = """SELECT id, concat('https://www.instagram.com/u', id) AS url, CASE id % 4 WHEN 0 THEN 'profile' WHEN 1 THEN 'article' WHEN 2 THEN 'video' ELSE 'unknown' END AS content_type,
 concat('u', id) AS username, full_name, concat('bio of ', full_name) AS biography, industry AS business_category_name, email AS business_email, phone AS business_phone_number,
 concat('trip ', id) AS caption, 'May 3, 2025' AS post_date, scraped_at FROM fx_contacts"""
LI = """SELECT id, url, CASE id % 4 WHEN 0 THEN 'profile' WHEN 1 THEN 'company' WHEN 2 THEN 'post' ELSE 'newsletter' END AS url_type, concat('u', id) AS username, full_name,
 CASE WHEN id % 6 = 0 THEN concat('Author ', id) ELSE '' END AS author_name, concat('about ', id) AS about, '' AS about_us, location, industry AS job_title, CAST(id % 50 AS BIGINT) AS employee_count,
 CAST(NULL AS VARCHAR(9)) AS address, concat('https://s', id, '.example.org') AS website, '' AS author_url, concat('head ', id) AS headline, '2025' AS date_published, scraped_at FROM fx_contacts"""


@query("unify_instagram", twin("""SELECT url, 'instagram' AS platform, content_type, username, coalesce(full_name, '') AS full_name, CASE WHEN content_type = 'profile' THEN '' ELSE caption END AS caption,
 coalesce(business_email, '') AS emails, coalesce(business_phone_number, '') AS phones FROM ig WHERE content_type <> 'unknown'""", "fx_contacts", ig=IG))
def unify_instagram(t):
    t.fx_contacts.createOrReplaceTempView("fx_contacts")
    return flat(G.unify_instagram(t.spark.sql(IG).withColumn("bio_links", F.array().cast(ARR))), "username", "full_name", "caption")


GEN = "(" + ", ".join(map(q, G.GENERIC_NAMES)) + ")"


@query("unify_linkedin", twin(f"""SELECT url, 'linkedin' AS platform, CASE WHEN url_type IN ('post', 'newsletter') THEN 'article' ELSE 'profile' END AS content_type, username,
 CASE WHEN full_name <> '' THEN full_name ELSE author_name END AS full_name, about AS bio, CASE WHEN author_name <> '' THEN author_name ELSE full_name END AS author_name, '' AS emails, '' AS phones
 FROM li WHERE lower(trim(CASE WHEN author_name <> '' THEN author_name ELSE full_name END)) NOT IN {GEN} AND trim(CASE WHEN author_name <> '' THEN author_name ELSE full_name END) <> ''""", "fx_contacts", li=LI))
def unify_linkedin(t):
    t.fx_contacts.createOrReplaceTempView("fx_contacts")
    return flat(G.unify_linkedin(t.spark.sql(LI)), "username", "full_name", "bio", "author_name")


@query("linkedin_name_invalid", twin(f"SELECT id, trim(full_name) = '' OR lower(trim(full_name)) IN {GEN} AS bad FROM fx_contacts", "fx_contacts"))
def linkedin_name_invalid(t):
    return t.fx_contacts.select("id", G.linkedin_name_invalid("full_name").alias("bad"))


@query("unify_youtube", twin("""SELECT url, 'youtube' AS platform, CASE id % 3 WHEN 0 THEN 'profile' ELSE 'video' END AS content_type, coalesce(full_name, '') AS full_name, concat('ig', id) AS instagram,
 concat('https://ig/', id, ',https://tw/', id) AS links, coalesce(email, '') AS emails, '' AS phones FROM fx_contacts""", "fx_contacts"))
def unify_youtube(t):
    h = lambda p: F.array(F.struct(F.concat(F.lit(p), F.col("id")).alias("username"), F.concat(F.lit(f"https://{p}/"), F.col("id")).alias("url")))
    raw = t.fx_contacts.select("url", "scraped_at", F.element_at(F.array(F.lit("channel"), F.lit("video"), F.lit("shorts")), (F.col("id") % 3 + 1).cast("int")).alias("content_type"),
                               F.col("full_name").alias("channel_name"), F.lit("d").alias("description"), F.lit("t").alias("title"), F.lit("x").alias("upload_date"),
                               F.array("email").alias("email"), F.create_map(F.lit("instagram"), h("ig"), F.lit("twitter"), h("tw")).alias("social_media_handles"))
    u = G.unify_youtube(raw)
    return u.select("url", "platform", "content_type", F.col("profile.full_name").alias("full_name"), F.col("contact.social_media_handles.instagram").alias("instagram"),
                    F.array_join("contact.bio_links", ",").alias("links"), F.array_join("contact.emails", ",").alias("emails"), F.array_join("contact.phone_numbers", ",").alias("phones"))


def web_raw(t):
    """Raw web leads with model contacts: every second lead has none, every fifth an organisation, every third two contacts."""
    c = t.fx_contacts
    contact = lambda n, mail, tel: F.struct(n.alias("name"), mail.alias("email"), tel.alias("phone"), F.lit(None).cast("string").alias("organization"), F.lit(None).cast("string").alias("role"),
                                            F.lit(0.8).alias("confidence"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("notes"),
                                            F.when(F.col("id") % 3 == 0, "B2B").alias("lead_category"), F.lit("Travel").alias("lead_sub_category"))
    ident = F.col("id").cast("string")
    null = F.lit(None).cast("string")
    contacts = F.filter(F.array(contact(F.concat(F.lit("Pat "), ident), F.concat(F.lit("pat"), ident, F.lit("@firm.example.org ")), null),
                                F.when(F.col("id") % 3 == 0, contact(F.concat(F.lit("Kim "), ident), null, F.concat(F.lit("555"), ident, F.lit("1234"))))), lambda x: x.isNotNull())
    org = F.struct(F.when(F.col("id") % 5 == 0, F.concat(F.lit("Org "), ident)).alias("primary_name"), F.when(F.col("id") % 4 == 1, F.lit("tourism")).alias("industry"),
                   F.array(F.lit("charter")).alias("services"), null.alias("location"), null.alias("organization_type"))
    addr = F.array(*[F.struct(F.concat(F.lit(f"{k} Road "), ident).alias("address"), F.lit("street").alias("type"), F.lit(v).alias("confidence"), null.alias("source"), null.alias("notes")) for k, v in ((1, 0.5), (2, 0.9))])
    ai = F.when(F.col("id") % 2 == 1, F.array(F.struct(contacts.alias("ai_contacts"), org.alias("organization_info"), addr.alias("addresses")).cast(schemas.AI_LEAD)))
    return c.select(ident.alias("id"), F.col("id").alias("nid"), F.col("url").alias("source_url"), F.col("full_name").alias("contact_person"),
                    F.concat(F.lit("Biz "), ident).alias("business_name"), F.array_compact(F.array("email")).alias("email"), F.array_compact(F.array("phone")).alias("phone"), "location",
                    F.create_map(F.lit("facebook"), F.concat(F.lit("fb"), ident), F.lit("threads"), F.concat(F.lit("th"), ident)).alias("social_media"), "industry", null.alias("company_type"),
                    F.array(F.lit("tours")).alias("services"), F.col("score").alias("lead_score"), F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extraction_timestamp"), ai.alias("ai_leads"))


# The same leads in SQL: m1/m2 the model contacts' email and phone, org the model organisation.
WEB = """SELECT *, CASE WHEN id % 2 = 1 THEN concat('pat', id, '@firm.example.org') END AS m1, CASE WHEN id % 2 = 1 AND id % 3 = 0 THEN concat('555', id, '1234') END AS p2,
 CASE WHEN id % 2 = 1 AND id % 5 = 0 THEN concat('Org ', id) END AS org, CASE WHEN id % 2 = 1 AND id % 4 = 1 THEN 'tourism' ELSE industry END AS ind,
 nullif(trim(email), '') AS e, nullif(trim(phone), '') AS p FROM fx_contacts"""


@query("unify_web", twin("""SELECT url, 'web' AS platform, 'profile' AS content_type, coalesce(org, concat('Biz ', id)) AS full_name, concat_ws(',', e, m1) AS emails, concat_ws(',', p, p2) AS phones, ind AS industry,
 CASE WHEN id % 2 = 1 AND id % 3 = 0 THEN 'B2B' ELSE '' END AS lead_category, concat('fb', id) AS facebook, concat('th', id) AS other, scraped_at FROM web""", "fx_contacts", web=WEB))
def unify_web(t):
    u = G.unify_web(web_raw(t))
    h = "contact.social_media_handles"
    return flat(u, "full_name", "industry", "lead_category", "scraped_at").join(
        u.select("url", F.col(f"{h}.facebook").alias("facebook"), F.array_join(f"{h}.other", ",").alias("other")), "url")


FB = """SELECT id, url, CASE id % 7 WHEN 0 THEN 'post' WHEN 1 THEN 'page' WHEN 2 THEN 'profile' WHEN 3 THEN 'group' WHEN 4 THEN 'event' WHEN 5 THEN 'restricted' ELSE 'unknown' END AS url_type, scraped_at, full_name AS name, email, phone, industry AS category FROM fx_contacts"""


@query("unify_facebook", twin("""SELECT url, 'facebook' AS platform, url_type AS content_type, CASE WHEN url_type = 'post' THEN concat('Shop ', id) ELSE coalesce(name, '') END AS full_name,
 CASE url_type WHEN 'post' THEN 'Post' WHEN 'page' THEN category WHEN 'profile' THEN 'boss' WHEN 'group' THEN 'Group' ELSE 'Event' END AS job_title,
 CASE WHEN url_type IN ('group', 'event') THEN 'desc' WHEN url_type = 'post' THEN 'ogd' ELSE '' END AS caption, coalesce(nullif(trim(email), ''), '') AS emails, coalesce(phone, '') AS phones FROM fb WHERE url_type NOT IN ('restricted', 'unknown')""", "fx_contacts", fb=FB))
def unify_facebook(t):
    t.fx_contacts.createOrReplaceTempView("fx_contacts")
    raw = t.spark.sql(FB)
    lit = lambda v, n: F.lit(v).cast("string").alias(n)
    data = F.struct("name", lit("un", "username"), lit("desc", "description"), lit("bio", "bio"), "category", lit("boss", "job_title"), lit("loc", "location"), lit("adr", "address"), lit(None, "website"),
                    F.array("email").alias("emails"), F.array("phone").alias("phone_numbers"), lit("9", "member_count"), lit("t0", "start_time"), lit("org", "organizer"),
                    F.concat(F.lit("Shop "), F.col("id"), F.lit(" | Facebook")).alias("og_title"), lit("ogd", "og_description"), lit("ogu", "og_url"))
    return flat(G.unify_facebook(raw.select("url", "url_type", "scraped_at", data.alias("extracted_data"))), "full_name", "job_title", "caption")


@query("unify_crawl", twin("""SELECT url, 'web' AS platform, 'page' AS content_type, CASE WHEN full_name <> '' THEN full_name ELSE concat('Biz ', id) END AS full_name,
 CASE WHEN id % 2 = 0 THEN 'potential_customer' ELSE 'competitor' END AS lead_category, coalesce(nullif(trim(email), ''), '') AS emails, CASE WHEN id % 9 = 0 THEN '' ELSE coalesce(phone, '') END AS phones FROM fx_contacts""", "fx_contacts"))
def unify_crawl(t):
    na = F.lit("NA")
    info = F.struct("email", F.when(F.col("id") % 9 == 0, na).otherwise(F.col("phone")).alias("phone"), na.alias("linkedin"), na.alias("twitter"), na.alias("website"), na.alias("others"), F.array(F.lit("x")).alias("socialmedialinks"))
    raw = t.fx_contacts.select(F.col("url").alias("source_url"), F.lit("page").alias("content_type"), F.col("full_name").alias("name"), F.concat(F.lit("Biz "), F.col("id")).alias("company_name"), info.alias("contact_info"),
                               F.when(F.col("id") % 2 == 0, "Lead").otherwise("competitor").alias("type"), "industry", "location", F.lit("").alias("bio"), F.lit("").alias("address"), F.lit("").alias("company_type"),
                               F.lit("").alias("lead_sub_category"), F.col("scraped_at").alias("time"))
    return flat(G.unify_crawl(raw), "full_name", "lead_category")


DIRS = """SELECT id, url AS source_url, full_name AS name, concat('write to desk', id, '@firm.example.org, tel: (415) 555-', lpad(CAST(id % 9000 AS VARCHAR(5)), 4, '0'), ' x.com/s', id) AS notes, '' AS bio, industry, email, phone, scraped_at FROM fx_contacts"""


@query("unify_directory", twin("""SELECT source_url AS url, 'web' AS platform, 'listing' AS content_type, coalesce(name, '') AS full_name, coalesce(nullif(trim(email), ''), concat('desk', id, '@firm.example.org')) AS emails,
 concat('s', id) AS twitter FROM dirs""", "fx_contacts", dirs=DIRS))
def unify_directory(t):
    t.fx_contacts.createOrReplaceTempView("fx_contacts")
    none = F.lit(None).cast("string")
    raw = (t.spark.sql(DIRS).withColumn("email", F.array("email")).withColumn("phone", F.array("phone")).withColumn("websites", F.array().cast(ARR)).withColumn("page_type", F.lit("listing"))
           .withColumn("social_media", F.struct(*[none.alias(n) for n in G.NAMES])))
    for c in ("organization", "address", "location", "employee_count", "revenue", "lead_category", "lead_sub_category", "company_type"):
        raw = raw.withColumn(c, none)
    u = G.unify_directory(raw)
    return flat(u, "full_name").drop("phones").join(u.select("url", F.col("contact.social_media_handles.twitter").alias("twitter")), "url")


def unified_table(t):
    """Unified rows of every contact, the input of the read and report queries."""
    c = t.fx_contacts
    return c.select("id", *G.unified(F.col("url"), F.col("platform"), "profile", source="table", icp=F.col("icp_identifier"), scraped_at=F.col("scraped_at"),
                                     profile={"full_name": F.col("full_name"), "location": F.col("location")}, emails=F.array("email"), phones=F.array("phone"),
                                     quality=F.col("score"), industry=F.col("industry"), company_name=F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("Biz "), F.col("id"))),
                                     lead_category=F.when(F.col("id") % 3 == 0, "B2B").when(F.col("id") % 3 == 1, "B2C")))


@query("clean_unified", twin("SELECT url, coalesce(full_name, '') AS full_name, coalesce(nullif(trim(email), ''), '') AS emails, 11 AS extra FROM fx_contacts", "fx_contacts"))
def clean_unified(t):
    u = unified_table(t).drop("revenue", "timeline")
    c = G.clean_unified(u)
    return c.select("url", F.col("profile.full_name").alias("full_name"), F.array_join("contact.emails", ",").alias("emails"), F.lit(len([x for x in schemas.EXTRAS if x in c.columns])).alias("extra"))


@query("ensure_schema", twin("SELECT count(*) AS rows, 2 AS missing_fields, count(*) AS touched FROM fx_contacts", "fx_contacts"))
def ensure_schema(t):
    return G.schema_gaps(unified_table(t).drop("revenue", "timeline"))


@query("instagram_valid", twin("SELECT id FROM fx_contacts WHERE trim(coalesce(email, '')) <> '' OR trim(coalesce(phone, '')) <> '' OR trim(coalesce(full_name, '')) <> ''", "fx_contacts"))
def instagram_valid(t):
    c = t.fx_contacts.withColumn("business_email", F.col("email")).withColumn("business_phone_number", F.col("phone")).withColumn("username", F.lit(""))
    return G.instagram_valid(c).select("id")


@query("unified_valid", twin("SELECT id FROM fx_contacts WHERE trim(coalesce(email, '')) <> '' OR trim(coalesce(phone, '')) <> '' OR trim(coalesce(full_name, '')) <> '' OR id % 7 <> 0", "fx_contacts"))
def unified_valid(t):
    return unified_table(t).filter(G.unified_valid()).select("id")


RECORDS = """SELECT c_custkey AS id, concat('https://www.linkedin.com/', CASE c_custkey % 4 WHEN 0 THEN 'in/' WHEN 1 THEN 'company/' WHEN 2 THEN 'posts/' ELSE 'newsletters/' END, 'u', c_custkey) AS url,
 CASE WHEN c_custkey % 3 = 0 THEN 'N/A' WHEN c_custkey % 3 = 1 THEN c_name ELSE '' END AS ld_name, '' AS ld_job_title, '' AS ld_headline, '' AS ld_description, '1,234' AS ld_followers, 'x' AS ld_employees,
 CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(c_name, ' | Sales head | LinkedIn') END AS og_title, 'about' AS og_description FROM customer"""


@query("linkedin_structured", twin("""
SELECT * FROM (SELECT url, CASE id % 4 WHEN 0 THEN 'profile' WHEN 1 THEN 'company' WHEN 2 THEN 'post' ELSE 'newsletter' END AS url_type, CASE WHEN id % 4 = 2 THEN '' ELSE concat('u', id) END AS username,
 CASE WHEN id % 4 <> 2 THEN coalesce(CASE WHEN ld_name NOT IN ('', 'N/A') THEN ld_name END, nullif(split_part(og_title, ' | ', 1), '')) END AS full_name,
 CASE WHEN id % 4 = 0 AND og_title <> '' THEN 'Sales head' END AS job_title, CASE WHEN id % 4 = 2 THEN nullif(og_title, '') END AS headline, CAST(1234 AS BIGINT) AS followers FROM rec)
WHERE coalesce(full_name, headline, job_title) IS NOT NULL""", rec=RECORDS))
def linkedin_structured(t):
    return G.linkedin_structured(t.sql(RECORDS)).drop("about", "employee_count")


IGR = """SELECT id, CASE id % 4 WHEN 0 THEN concat('https://www.instagram.com/u', id, '/') WHEN 1 THEN concat('https://www.instagram.com/p/', id, '/') WHEN 2 THEN concat('https://www.instagram.com/reel/', id, '/') ELSE 'https://www.instagram.com/explore/x/' END AS url, false AS is_video,
 concat('u', id) AS username, full_name, CAST(id * 37 AS VARCHAR(20)) AS followers_count, CAST(id * 11 AS VARCHAR(20)) AS likes_count, concat('mail me team', id, '@firm.example.org') AS caption, 'plain bio' AS biography, coalesce(email, '') AS business_email, '' AS business_phone_number FROM fx_contacts"""


def short(n):
    one = lambda d: f"replace(printf('%.1f', {n} / {d}), '.0', '')"
    return f"CASE WHEN {n} >= 1000000 THEN {one('1000000.0')} || 'M' WHEN {n} >= 1000 THEN {one('1000.0')} || 'K' ELSE CAST({n} AS VARCHAR) END"


@query("instagram_clean", twin("""SELECT url, CASE id % 4 WHEN 0 THEN 'profile' WHEN 1 THEN 'article' ELSE 'video' END AS content_type, username, CASE WHEN id % 4 = 0 THEN full_name END AS full_name,
 CASE WHEN id % 4 = 0 THEN nullif(business_email, '') ELSE concat('team', id, '@firm.example.org') END AS business_email FROM igr WHERE id % 4 <> 3""", "fx_contacts", igr=IGR))
def instagram_clean(t):
    t.fx_contacts.createOrReplaceTempView("fx_contacts")
    return G.instagram_clean(t.spark.sql(IGR)).select("url", "content_type", "username", "full_name", "business_email")


NUMBERS = "SELECT o_orderkey AS id, CAST(o_orderkey * 997 AS VARCHAR(20)) AS n FROM orders WHERE o_orderkey % 1000 <> 950"


@query("count_label", twin("SELECT id, CASE WHEN id * 997 < 1000 THEN CAST(id * 997 AS VARCHAR) WHEN id * 997 < 1000000 THEN 'K' WHEN id * 997 < 1000000000 THEN 'M' ELSE 'B' END AS unit FROM numbers", numbers=NUMBERS))
def count_label(t):
    # Rounding of the shown digits is covered by literal cases in the tests.
    lab = X.short_count("n")
    return t.sql(NUMBERS).select("id", F.when(lab.rlike("[KMB]$"), F.substring(lab, -1, 1)).otherwise(lab).alias("unit"))


STAMPS = """SELECT id, scraped_at, concat(CASE id % 4 WHEN 0 THEN concat(replace(CAST(scraped_at AS VARCHAR(40)), ' ', 'T'), 'Z') WHEN 1 THEN CAST(scraped_at AS VARCHAR(40)) WHEN 2 THEN concat('{"$date": "', replace(CAST(scraped_at AS VARCHAR(40)), ' ', 'T'), 'Z"}') ELSE 'soon' END, '') AS raw FROM fx_contacts"""


@query("parse_ts", twin("SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE scraped_at END AS ts FROM stamps", "fx_contacts", stamps=STAMPS))
def parse_ts(t):
    t.fx_contacts.createOrReplaceTempView("fx_contacts")
    return t.spark.sql(STAMPS).select("id", X.parse_ts("raw").alias("ts"))


YT = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN concat('https://www.youtube.com/watch?v=', o_orderkey) WHEN 1 THEN concat('https://www.youtube.com/shorts/', o_orderkey) WHEN 2 THEN concat('https://www.youtube.com/@c', o_orderkey) ELSE 'https://www.youtube.com/about' END AS url,
 CASE WHEN o_orderkey % 3 = 0 THEN concat('api ', o_orderkey) ELSE '' END AS api_title, concat('script ', o_orderkey) AS script_title, 'meta' AS meta_title, CAST(NULL AS VARCHAR(9)) AS api_channel_name, '' AS script_channel_name, concat('ch', o_orderkey) AS meta_channel_name,
 '5,000' AS api_views, '' AS script_views, '' AS meta_views, '' AS api_subscribers, '5.1K' AS script_subscribers, '' AS meta_subscribers, 'see twitch.tv/abc' AS api_description, '' AS script_description, '' AS meta_description FROM orders"""


@query("youtube_clean", twin("""SELECT url, CASE id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'shorts' ELSE 'channel' END AS content_type, CASE WHEN id % 4 = 2 THEN NULL WHEN id % 3 = 0 THEN api_title ELSE script_title END AS title, meta_channel_name AS channel_name,
 CASE WHEN id % 4 <> 2 THEN '5.0K' END AS views, CASE WHEN id % 4 <> 1 THEN '5.1K' END AS subscribers, CAST(1 AS BIGINT) AS n_handles FROM yt WHERE id % 4 <> 3""", yt=YT))
def youtube_clean(t):
    return G.youtube_clean(t.sql(YT)).withColumn("n_handles", F.size("handles").cast("bigint")).drop("handles", "description")


@query("has_contact", twin("SELECT CAST(id AS VARCHAR) AS id FROM web WHERE coalesce(e, p, m1) IS NOT NULL", "fx_contacts", web=WEB))
def has_contact(t):
    return web_raw(t).filter(G.has_contact()).select("id")


LEADGEN = """SELECT CAST(id AS VARCHAR) AS original_web_lead_id, 'email' AS kind, e AS mail, '' AS tel, trim(coalesce(full_name, '')) AS contact, coalesce(org, concat('Biz ', id)) AS company, ind FROM web WHERE e IS NOT NULL
 UNION ALL SELECT CAST(id AS VARCHAR), 'email', m1, '', concat('Pat ', id), coalesce(org, concat('Biz ', id)), ind FROM web WHERE m1 IS NOT NULL
 UNION ALL SELECT CAST(id AS VARCHAR), 'phone', '', p, trim(coalesce(full_name, '')), coalesce(org, concat('Biz ', id)), ind FROM web WHERE e IS NULL AND m1 IS NULL AND p IS NOT NULL"""


@query("leadgen_rows", twin("SELECT original_web_lead_id, kind, mail, tel, contact, company, ind FROM lg", "fx_contacts", web=WEB, lg=LEADGEN))
def leadgen_rows(t):
    r = G.leadgen_rows(web_raw(t), as_of())
    return r.select("original_web_lead_id", F.col("primary_contact_type").alias("kind"), F.col("Email Address").alias("mail"), F.col("Phone Number").alias("tel"),
                    F.col("Contact Name").alias("contact"), F.col("Company Name").alias("company"), F.col("Industry").alias("ind"))


def lead_model(t):
    """Lead rows with the model leads attached."""
    w = web_raw(t)
    return w.select("id", "source_url", F.array_compact(F.array("contact_person")).alias("contact_person"), "business_name", "email", "phone", "industry", "services", "ai_leads",
                    F.create_map(F.lit("email"), F.lit(0.8)).alias("confidence_scores"))


FINAL = """SELECT CAST(id AS VARCHAR) AS id, 'main' AS lead_kind, concat('Biz ', id) AS business_name, coalesce(email, '') AS email FROM web
 UNION ALL SELECT concat(id, '_contact_0'), 'contact', concat('Biz ', id), concat(m1, ' ') FROM web WHERE m1 IS NOT NULL
 UNION ALL SELECT concat(id, '_contact_1'), 'contact', concat('Biz ', id), coalesce(nullif(email, ''), '') FROM web WHERE p2 IS NOT NULL
 UNION ALL SELECT concat(id, '_org_0'), 'organization', org, coalesce(email, '') FROM web WHERE org IS NOT NULL"""


@query("final_leads", twin("SELECT * FROM f", "fx_contacts", web=WEB, f=FINAL))
def final_leads(t):
    rows = G.final_entry(G.final_leads(lead_model(t)))
    return rows.select("id", "lead_kind", "business_name", F.array_join("email", ",").alias("email"))


@query("final_entry", twin("""SELECT id, CASE WHEN lead_kind = 'main' THEN NULL ELSE concat('2 Road ', split_part(id, '_', 1)) END AS address, CASE WHEN lead_kind = 'main' THEN 'tours' ELSE 'charter,tours' END AS services, 0.8::DOUBLE AS confidence_score FROM f""", "fx_contacts", web=WEB, f=FINAL))
def final_entry(t):
    return G.final_entry(G.final_leads(lead_model(t))).select("id", "address", F.array_join("services", ",").alias("services"), "confidence_score")


@query("unify_web_final", twin("SELECT url, lead_kind, coalesce(business_name, '') AS full_name, email AS emails FROM (SELECT f.*, w.url FROM f JOIN web w ON CAST(w.id AS VARCHAR) = split_part(f.id, '_', 1))", "fx_contacts", web=WEB, f=FINAL))
def unify_web_final(t):
    rows = G.final_entry(G.final_leads(lead_model(t))).withColumn("website", F.lit("")).withColumn("extraction_timestamp", as_of())
    parts = None
    for k in ("main", "contact", "organization"):
        p = G.unify_web_final(rows.filter(F.col("lead_kind") == k)).select("url", F.lit(k).alias("lead_kind"), F.col("profile.full_name").alias("full_name"), F.array_join("contact.emails", ",").alias("emails"))
        parts = p if parts is None else parts.unionByName(p)
    return parts
