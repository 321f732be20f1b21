"""Join, lookup, deduplicate and merge queries and their SQL twins."""

from pyspark.sql import functions as F

from contactmill.operators import match as M
from contactmill.operators import merge as I
from contactmill.operators import scores as S
from contactmill.plans.catalog import query
from contactmill.plans.derived import AS_OF_SQL, as_of, twin

FIELDS = "full_name, url, company_name, content_type"
# Every third lead without contacts repeats the fields of the lead before it.
LEADS = """SELECT id, id AS ord, platform, email, phone, industry, location, score, scraped_at, full_name, concat('https://www.example.com/u', id - id % 3) AS url,
 concat('Company ', id % 40) AS company_name, platform AS content_type, concat('https://s', id % 90, '.example.org') AS website, 0.4 + (id % 50) / 100.0E0 AS data_confidence FROM fx_contacts"""
STORED = "SELECT * FROM leads WHERE id % 3 = 0"
NEW = "SELECT * FROM leads WHERE id % 3 <> 0"


def leads(t):
    t.fx_contacts.createOrReplaceTempView("fx_contacts")
    return (t.spark.sql(LEADS).withColumn("emails", F.array_compact(F.array("email"))).withColumn("phones", F.array_compact(F.array("phone")))
            .withColumn("websites", F.array("website")).withColumn("business_name", F.col("company_name")))


def split(t):
    df = leads(t)
    return df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")


def cte(body, **more):
    return twin(body, "fx_contacts", leads=LEADS, stored=STORED, fresh=NEW, **more)


EKEY = "CASE WHEN trim(coalesce(email, '')) <> '' THEN 'e:' || lower(trim(email)) END"
PKEY = "CASE WHEN trim(coalesce(phone, '')) <> '' THEN 'p:' || trim(phone) END"
DKEY = "CASE WHEN regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') <> '' THEN 'p:' || regexp_replace(phone, '[^0-9]', '', 'g') END"
NONE = f"({EKEY} IS NULL AND {PKEY} IS NULL)"
SAME = " AND ".join(f"(coalesce(n.{c}, '') = '' OR lower(trim(n.{c})) = lower(trim(s.{c})))" for c in FIELDS.split(", "))


def keyed(src, p=PKEY):
    return f"SELECT id, {EKEY} AS k FROM {src} WHERE {EKEY} IS NOT NULL UNION SELECT id, {p} FROM {src} WHERE {p} IS NOT NULL"


@query("dup_unified", cte(f"""SELECT DISTINCT id FROM nk WHERE k IN (SELECT k FROM sk)
 UNION SELECT n.id FROM fresh n WHERE {NONE} AND EXISTS (SELECT 1 FROM stored s WHERE {SAME})""", nk=keyed("fresh"), sk=keyed("stored")))
def dup_unified(t):
    new, stored = split(t)
    return M.dup_unified(new, stored)


@query("dup_crawl", cte(f"""SELECT id FROM fresh WHERE id NOT IN (SELECT id FROM nk WHERE k IN (SELECT k FROM sk) OR k IN (SELECT k FROM nk p WHERE p.id < nk.id))""",
                        nk=keyed("fresh") + f" UNION SELECT id, concat_ws(chr(1), lower(trim(full_name)), url, company_name, content_type) FROM fresh WHERE {NONE}",
                        sk=keyed("stored") + f" UNION SELECT id, concat_ws(chr(1), lower(trim(full_name)), url, company_name, content_type) FROM stored WHERE {NONE}"))
def dup_crawl(t):
    new, stored = split(t)
    return M.dup_crawl(new, stored)


WEB = " UNION SELECT id, 'w:' || lower(company_name) || chr(1) || website FROM {0}"


@query("dup_web", cte("SELECT DISTINCT id FROM nk WHERE k IN (SELECT k FROM sk)", nk=keyed("fresh", DKEY) + WEB.format("fresh"), sk=keyed("stored", DKEY) + WEB.format("stored")))
def dup_web(t):
    new, stored = split(t)
    return M.dup_web(new, stored)


@query("dup_log", cte(f"""SELECT s.url AS original_url, n.url AS duplicate_url, {AS_OF_SQL} AS merged_at FROM
 (SELECT nk.id, min(sk.id) AS sid FROM nk JOIN sk USING (k) GROUP BY nk.id) m JOIN fresh n USING (id) JOIN stored s ON s.id = m.sid""",
                      nk=keyed("fresh", DKEY) + WEB.format("fresh"), sk=keyed("stored", DKEY) + WEB.format("stored")))
def dup_log(t):
    new, stored = split(t)
    return M.dup_log(new, stored, as_of())


CLOSURE = """labels AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""


def closure_sql(body, key_sql):
    """Connected components by a recursive walk (the twin runs on small data)."""
    base = cte("", k=key_sql).rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{base}, n AS (SELECT DISTINCT a.id, b.id AS r FROM k a JOIN k b USING (k)), reach AS (SELECT id, r FROM n UNION SELECT reach.id, n.r FROM reach JOIN n ON reach.r = n.id),
 {CLOSURE} {body}"""


@query("components", closure_sql("SELECT id, component FROM labels", keyed("leads")))
def components(t):
    return M.components(leads(t).select("id", F.explode(M.contact_keys("emails", "phones")).alias("key")))


RICH = "(trim(coalesce(full_name, '')) <> '')::INT + (trim(coalesce(email, '')) <> '')::INT + (trim(coalesce(phone, '')) <> '')::INT + (score <> 0)::INT"
RAW_E = "CASE WHEN trim(coalesce(email, '')) <> '' THEN 'e:' || trim(email) END"


@query("dup_richest", closure_sql(f"""SELECT id, component, group_size FROM (SELECT l.id, coalesce(component, l.id) AS component, row_number() OVER w AS rn, count(*) OVER (PARTITION BY coalesce(component, l.id)) AS group_size
 FROM leads l LEFT JOIN labels USING (id) WINDOW w AS (PARTITION BY coalesce(component, l.id) ORDER BY {RICH} DESC, ord, l.id)) WHERE rn = 1""",
                                  f"SELECT id, {RAW_E} AS k FROM leads WHERE {RAW_E} IS NOT NULL UNION SELECT id, {PKEY} FROM leads WHERE {PKEY} IS NOT NULL"))
def dup_richest(t):
    df = leads(t).select("id", "ord", "full_name", "email", "phone", "score")
    kinds = [(n, k) for n, k in df.dtypes if n in ("full_name", "email", "phone", "score")]
    return M.dup_richest(df, S.richness(kinds)).select("id", "component", "group_size")


@query("by_ids", cte("SELECT id, url FROM leads WHERE id IN (SELECT s_suppkey * 3 FROM supplier) AND platform = 'linkedin'"))
def by_ids(t):
    ids = t.supplier.select((F.col("s_suppkey") * 3).alias("id"))
    return M.by_ids(leads(t).withColumn("status", F.col("platform")), ids, "linkedin").select("id", "url")


@query("leads_missing_contact", cte("SELECT id FROM leads WHERE email IS NULL OR phone IS NULL"))
def leads_missing_contact(t):
    return M.leads_missing_contact(leads(t)).select("id")


FOUND = "SELECT c_custkey AS id, concat('new', c_custkey, '@firm.example.org') AS mail FROM customer WHERE c_custkey % 5 = 0"


@query("apply_contacts", cte("SELECT id, coalesce(mail, email, '') AS emails, coalesce(phone, '') AS phones, website FROM leads LEFT JOIN found USING (id)", found=FOUND))
def apply_contacts(t):
    base = leads(t).select("id", F.struct("emails", F.col("phones").alias("phone_numbers"), "website").alias("contact"))
    found = t.sql(FOUND).select("id", F.array("mail").alias("emails"), F.array().cast("array<string>").alias("phone_numbers"))
    return M.apply_contacts(base, found).select("id", F.array_join("contact.emails", ",").alias("emails"),
                                                F.array_join("contact.phone_numbers", ",").alias("phones"), "contact.website")


POSTS = "SELECT o_orderkey AS id, concat('u', o_custkey) AS username, CASE WHEN o_orderkey % 4 = 0 THEN concat('p', o_orderkey, '@firm.example.org') ELSE '' END AS business_email, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR(20)) END AS business_phone_number FROM orders"
OWN = "SELECT c_custkey AS id, concat('u', c_custkey % 1000) AS username, CASE WHEN c_custkey % 6 = 0 THEN 'own@firm.example.org' END AS business_email, '' AS business_phone_number FROM customer"


@query("post_to_profile", twin("""SELECT username, o.id, coalesce(nullif(o.business_email, ''), p.e) AS business_email, coalesce(nullif(o.business_phone_number, ''), p.n) AS business_phone_number
 FROM (SELECT username, arg_min(business_email, id) FILTER (business_email <> '') AS e, arg_min(business_phone_number, id) FILTER (business_phone_number <> '') AS n FROM posts GROUP BY username) p
 JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY id) AS rn FROM own) WHERE rn = 1) o USING (username)""", posts=POSTS, own=OWN))
def post_to_profile(t):
    return M.post_to_profile(t.sql(POSTS), t.sql(OWN))


FIRMS = "SELECT p_partkey AS id, concat(p_name, ' ', p_type, ' ', CASE p_partkey % 3 WHEN 0 THEN 'ltd' WHEN 1 THEN 'limited' ELSE 'group' END) AS company_name, concat(p_size * 7, CASE p_partkey % 2 WHEN 0 THEN ' Main Street, ' ELSE ' main st. ' END, p_type) AS address FROM part"


# A closed form: the stock of names is a firm and its copies with one letter more, so similarity is known from the keys.
CHAIN = """SELECT p_partkey AS id, concat(substr(md5(CAST(p_partkey // 4 AS VARCHAR(20))), 1, 20), repeat('x', CAST(p_partkey % 4 AS INT) * 2)) AS company_name,
 concat(p_partkey // 4, ' ', substr(md5(CAST(p_partkey // 4 AS VARCHAR(20))), 1, 12), repeat('y', CAST(p_partkey % 4 AS INT) * 2)) AS address FROM part"""
CHAIN_SPARK = CHAIN.replace("p_partkey // 4", "p_partkey DIV 4")
CHAIN_PAIR = """SELECT a.{c} AS a, b.{c} AS b, CAST(round(200.0 * length(a.{c}) / (length(a.{c}) + length(b.{c}))) AS INT) AS percent
 FROM chain a JOIN chain b ON a.id // 4 = b.id // 4 AND a.id < b.id WHERE round(200.0 * length(a.{c}) / (length(a.{c}) + length(b.{c}))) >= {p}"""
# 20 letters and 0, 2, 4, 6 more: at 90 percent a name reaches the next one or two, never the whole chain, so the first
# takes the second and third and the fourth is left.
CHAIN_GROUP = "SELECT id, CASE WHEN id % 4 = 3 AND {n} THEN id ELSE id - id % 4 END AS \"group\" FROM chain"


@query("similar_chain_pairs", twin(CHAIN_PAIR.format(c="company_name", p=85), chain=CHAIN))
def similar_chain_pairs(t):
    return M.similar_company_pairs(t.sql(CHAIN_SPARK))


@query("similar_chain_addresses", twin(CHAIN_PAIR.format(c="address", p=80), chain=CHAIN))
def similar_chain_addresses(t):
    return M.similar_address_pairs(t.sql(CHAIN_SPARK))


@query("dedupe_chain", twin(CHAIN_GROUP.format(n="true"), chain=CHAIN))
def dedupe_chain(t):
    return I.dedupe_fuzzy(t.sql(CHAIN_SPARK), 90).select("id", "group")


@query("similar_company_pairs")
def similar_company_pairs(t):
    return M.similar_company_pairs(t.sql(FIRMS))


@query("similar_address_pairs")
def similar_address_pairs(t):
    return M.similar_address_pairs(t.sql(FIRMS))


NORM = "regexp_replace(lower(regexp_replace(address, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')"
for _l, _s in M.ADDRESS_SHORT:
    NORM = f"regexp_replace({NORM}, '\\b{_l}\\b', '{_s}', 'g')"
NORM = f"regexp_replace({NORM}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')"


@query("normal_address", twin(f"SELECT id, {NORM} AS address FROM firms", firms=FIRMS))
def normal_address(t):
    return t.sql(FIRMS).select("id", M.normal_address("address").alias("address"))


XKEY = f"""nullif(concat_ws('|', CASE WHEN trim(coalesce(email, '')) <> '' THEN 'email:' || lower(trim(email)) END, CASE WHEN trim(coalesce(phone, '')) <> '' THEN 'phone:' || trim(phone) END, CASE WHEN id % 2 = 0 THEN 'website:' || lower(website) END), '')"""
EXACT = f"SELECT *, CASE WHEN {XKEY} IS NULL THEN id ELSE min(id) OVER (PARTITION BY {XKEY}) END AS grp FROM leads"


def exact(t):
    return I.dedupe_exact(leads(t).withColumn("website", F.when(F.col("id") % 2 == 0, F.col("website"))))


@query("dedupe_exact", cte("SELECT id, grp FROM exact_groups", exact_groups=EXACT))
def dedupe_exact(t):
    return exact(t).select("id", F.col("group").alias("grp"))


@query("dedupe_fuzzy")
def dedupe_fuzzy(t):
    return I.dedupe_fuzzy(t.sql(FIRMS)).select("id", "group")


@query("dedupe_address")
def dedupe_address(t):
    return I.dedupe_address(t.sql(FIRMS)).select("id", "group")


GROUPED = "SELECT *, CAST(id % 200 AS BIGINT) AS grp FROM leads"


def grouped(t):
    return leads(t).withColumn("grp", (F.col("id") % 200).cast("bigint"))


@query("merge_leads", cte("""SELECT grp, min(id) AS lead_id, count(*) AS members, arg_min(company_name, id) FILTER (company_name <> '') AS company_name, arg_min(industry, id) FILTER (industry <> '') AS industry,
 max(score) AS score, max(data_confidence) AS data_confidence, max(scraped_at) AS scraped_at FROM g GROUP BY grp""", g=GROUPED))
def merge_leads(t):
    return I.merge_leads(grouped(t), "grp")


@query("merged_services", cte("SELECT DISTINCT grp, industry AS value FROM g UNION SELECT grp, location FROM g", g=GROUPED))
def merged_services(t):
    return I.merged_values(grouped(t).withColumn("services", F.array("industry", "location")), "grp", "services")


DIG = "regexp_replace(phone, '[^0-9]', '', 'g')"


@query("merge_contact_list", cte(f"""SELECT grp, kind, norm, arg_max(value, {{'c': confidence, 'o': -id, 'v': value}}) AS value, max(confidence) AS confidence FROM
 (SELECT grp, id, 'email' AS kind, email AS value, lower(trim(email)) AS norm, data_confidence AS confidence FROM g WHERE trim(email) <> '' UNION ALL
  SELECT grp, id, 'phone', phone, {DIG}, data_confidence FROM g WHERE length({DIG}) BETWEEN 7 AND 15 AND length(replace({DIG}, left({DIG}, 1), '')) > 0) GROUP BY grp, kind, norm""", g=GROUPED))
def merge_contact_list(t):
    g = grouped(t)
    kinds = F.array(F.struct(F.lit("email").alias("kind"), F.col("email").alias("value")), F.struct(F.lit("phone").alias("kind"), F.col("phone").alias("value")))
    c = g.select("grp", F.col("id").alias("ord"), F.col("data_confidence").alias("confidence"), F.inline(kinds))
    return I.merge_contact_list(c, "grp")


@query("merge_people", cte("""SELECT grp, arg_max(full_name, {'a': score, 'o': -id, 'n': full_name}) AS name, arg_max(industry, {'a': score, 'o': -id, 'n': full_name}) AS title, max(score) AS authority_score
 FROM g WHERE trim(full_name) <> '' GROUP BY grp, lower(trim(full_name))""", g=GROUPED))
def merge_people(t):
    p = grouped(t).select("grp", F.col("id").alias("ord"), F.col("full_name").alias("name"), F.col("industry").alias("title"), F.col("score").alias("authority_score"))
    return I.merge_people(p, "grp")


@query("merge_metadata", cte("SELECT grp, max(data_confidence) AS data_confidence, max(scraped_at) AS scraped_at, count(DISTINCT url) AS n_urls, min(url) AS first_url, array_to_string(list_sort(list(DISTINCT url)), ',') AS urls FROM g GROUP BY grp", g=GROUPED))
def merge_metadata(t):
    return I.merge_metadata(grouped(t), "grp").withColumn("urls", F.array_join("urls", ","))


@query("merge_by_confidence", cte("""SELECT grp, arg_max(email, {'c': data_confidence, 'o': -id}) FILTER (email <> '') AS email, max(data_confidence) FILTER (email <> '') AS email_confidence,
 arg_max(phone, {'c': data_confidence, 'o': -id}) FILTER (phone <> '') AS phone, max(data_confidence) FILTER (phone <> '') AS phone_confidence, max(score) AS score FROM g GROUP BY grp""", g=GROUPED))
def merge_by_confidence(t):
    g = grouped(t).withColumn("email_confidence", F.col("data_confidence")).withColumn("phone_confidence", F.col("data_confidence"))
    return I.merge_by_confidence(g, "grp", ["email", "phone"])


@query("merge_whole", cte("""SELECT m.grp, m.email, m.score, u.services, so.social FROM
 (SELECT grp, arg_max(email, {'c': data_confidence, 'o': -id}) FILTER (email <> '') AS email, max(score) AS score FROM g GROUP BY grp) m
 JOIN (SELECT grp, string_agg(v, ',' ORDER BY first_id, p) AS services FROM (SELECT grp, v, min(id) AS first_id, arg_min(p, {'i': id, 'p': p}) AS p FROM
  (SELECT grp, id, 0 AS p, industry AS v FROM g UNION ALL SELECT grp, id, 1, location FROM g) WHERE v IS NOT NULL GROUP BY grp, v) GROUP BY grp) u USING (grp)
 LEFT JOIN (SELECT grp, string_agg(k || '=' || v, ',' ORDER BY k) AS social FROM (SELECT grp, k, arg_min(v, id) AS v FROM
  (SELECT grp, id, platform AS k, CASE WHEN id % 2 = 0 THEN url ELSE '' END AS v FROM g) WHERE v <> '' GROUP BY grp, k) GROUP BY grp) so USING (grp)""", g=GROUPED))
def merge_whole(t):
    g = (grouped(t).withColumn("email_confidence", F.col("data_confidence")).withColumn("services", F.array("industry", "location"))
         .withColumn("social", F.create_map("platform", F.when(F.col("id") % 2 == 0, F.col("url")).otherwise(""))))
    out = I.merge_whole(g, "grp", ["email"], ["services"], "social")
    pairs = F.transform(F.array_sort(F.map_entries("social")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("grp", "email", "score", F.array_join("services", ",").alias("services"), F.array_join(pairs, ",").alias("social"))


@query("duplicate_groups", cte("""SELECT id, email, phone, group_size FROM (SELECT *, count(*) OVER (PARTITION BY coalesce(email, ''), coalesce(phone, ''), company_name) AS group_size FROM leads) WHERE group_size > 1"""))
def duplicate_groups(t):
    return I.duplicate_groups(leads(t), "email", "phone", "company_name").select("id", "email", "phone", "group_size")


@query("ordered_distinct", cte("SELECT id, array_to_string(list_filter([platform, industry, platform, location], lambda s, i: list_position([platform, industry, platform, location], s) = i), ',') AS items FROM leads"))
def ordered_distinct(t):
    from contactmill.functions.text import ordered_distinct as od
    return leads(t).select("id", F.array_join(od(F.array("platform", "industry", "platform", "location")), ",").alias("items"))


def run_input(t):
    """Leads whose company and address come from the part table, so that the fuzzy stages have something to do."""
    firms = t.sql(FIRMS).withColumnRenamed("company_name", "firm").withColumnRenamed("id", "fid")
    df = leads(t).select("id", "email", "phone", "website", "industry", "score", "data_confidence", "scraped_at")
    return df.join(firms, F.col("id") == F.col("fid")).withColumnRenamed("firm", "company_name").drop("fid")


@query("dedupe_stages")
def dedupe_stages(t):
    return I.dedupe_stages(run_input(t)).select("id", "company_name", "email", "phone")


@query("quality_run")
def quality_run(t):
    return I.quality_sorted(I.quality_run(run_input(t), as_of())).select("id", "quality", "grade")


@query("quality_summary")
def quality_summary(t):
    df = run_input(t)
    return I.quality_summary(df, I.quality_run(df, as_of()))
