"""Source, store, stream and composed-job queries and their SQL twins."""


from pyspark.sql import functions as F

from contactmill.functions import text as X
from contactmill.operators import pages as P
from contactmill.operators import unify as G
from contactmill.plans import lead_jobs as W
from contactmill.plans.catalog import query
from contactmill.plans.derived import AS_OF_SQL, URLS, as_of, twin
from contactmill.plans.queries_contacts import FOLD, email_sql, phone_candidates
from contactmill.plans.queries_match import LEADS, NEW, STORED, keyed, leads, split
from contactmill.plans.queries_unify import WEB, unified_table, web_raw
from contactmill.plans.queries_urls import QUEUE
from contactmill.session import scratch as shared_scratch
from contactmill.sources import readers as Rd
from contactmill.sources import store as A
from contactmill.streaming import jobs as St


def c(body, **more):
    return twin(body, "fx_contacts", leads=LEADS, stored=STORED, fresh=NEW, **more)


def scratch(t, name: str) -> str:
    """A new folder in the shared one, which every executor can reach."""
    return shared_scratch(t.spark, name)


# --- sources ----------------------------------------------------------------------------------------------------

@query("read_url_list", twin("SELECT url FROM fx_urls WHERE starts_with(url, 'http')", "fx_urls"))
def read_url_list(t):
    path = scratch(t, "urls")
    t.fx_urls.select(F.concat(F.lit(" "), F.col("url"))).write.text(path)
    return Rd.read_url_list(t.spark, path, "txt", http_only=True)


@query("read_url_list_json", twin("SELECT url FROM fx_urls WHERE id % 2 = 0 UNION ALL SELECT url FROM fx_urls WHERE id % 2 = 1", "fx_urls"))
def read_url_list_json(t):
    # Files of at most a thousand URLs; every other one is a plain list, the rest are objects with "urls".
    path = scratch(t, "urls")
    part = F.floor(F.col("id") / 1000)
    lists = t.fx_urls.groupBy(part.alias("part")).agg(F.collect_list("url").alias("urls"))
    lists.select(F.when(F.col("part") % 2 == 0, F.to_json("urls")).otherwise(F.to_json(F.struct("urls"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return Rd.read_url_list(t.spark, path, "json")


@query("read_url_list_csv", twin("SELECT url FROM fx_urls", "fx_urls"))
def read_url_list_csv(t):
    path = scratch(t, "urls")
    t.fx_urls.select("url", "id").write.csv(path)
    return Rd.read_url_list(t.spark, path, "csv")


LEAD_ROWS = "SELECT CAST(id AS VARCHAR(20)) AS id, url AS source_url, full_name AS business_name, industry, score AS lead_score, email FROM fx_contacts"


@query("read_leads", twin("SELECT id, source_url, lead_score FROM l", "fx_contacts", l=LEAD_ROWS))
def read_leads(t):
    path = scratch(t, "leads")
    t.fx_contacts.createOrReplaceTempView("fx_contacts")
    good = t.spark.sql(LEAD_ROWS).withColumn("email", F.array_compact(F.array("email")))
    good.select(F.to_json(F.struct(*good.columns)).alias("value")).unionAll(t.supplier.select(F.lit("{broken").alias("value"))).write.text(path)
    return Rd.readable(Rd.read_leads(t.spark, path)).select("id", "source_url", "lead_score")


@query("write_leads", twin("SELECT id, source_url FROM l", "fx_contacts", l=LEAD_ROWS))
def write_leads(t):
    path = scratch(t, "leads")
    t.fx_contacts.createOrReplaceTempView("fx_contacts")
    A.write_leads(t.spark.sql(LEAD_ROWS), path)
    return t.spark.read.parquet(path).select("id", "source_url")




@query("search_results_to_urls", "SELECT o_custkey AS search, concat('https://r', o_orderkey, '.example.org') AS url, concat('T', o_orderkey) AS title FROM orders")
def search_results_to_urls(t):
    # One saved answer per search, as the API gives them (a bounded page of results).
    items = t.orders.select(F.col("o_custkey").alias("search"), F.concat(F.lit('{"link":"https://r'), F.col("o_orderkey"), F.lit('.example.org","title":"T'), F.col("o_orderkey"), F.lit('","snippet":"s"}')).alias("i"))
    body = items.groupBy("search").agg(F.concat(F.lit('{"items":['), F.array_join(F.collect_list("i"), ","), F.lit("]}")).alias("body"))
    return Rd.search_results_to_urls(body).select("search", "url", "title")


ANSWERS = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN concat('Sure: ```json {"summary": "S', c_custkey, '", "overall_confidence": 0.5, "contacts": [{"name": "N', c_custkey, '"}]} ``` done')
 WHEN 1 THEN concat('I found {"summary": "S', c_custkey, '", "overall_confidence": 0.7} and more') WHEN 2 THEN 'nothing here' ELSE 'broken { "a": ' END AS answer FROM customer"""


@query("parse_model_json", twin("SELECT id, CASE WHEN id % 4 < 2 THEN concat('S', id) END AS summary, CASE WHEN id % 4 = 0 THEN concat('N', id) END AS name FROM (SELECT c_custkey AS id FROM customer)"))
def parse_model_json(t):
    p = Rd.parse_model_json(t.sql(ANSWERS))
    return p.select("id", "parsed.summary", F.get("parsed.contacts", F.lit(0))["name"].alias("name"))


@query("read_icp", "SELECT concat('Product ', r_regionkey) AS product, concat('buyer ', r_regionkey) AS persona, r_name AS region FROM region")
def read_icp(t):
    path = scratch(t, "icp")
    doc = F.to_json(F.struct(F.struct(F.concat(F.lit("Product "), F.col("r_regionkey")).alias("product_name")).alias("product_details"),
                             F.struct(F.array(F.concat(F.lit("buyer "), F.col("r_regionkey"))).alias("decision_maker_persona"), F.array("r_name").alias("region")).alias("icp_information")))
    t.region.select(doc.alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return Rd.read_icp(t.spark, path).select(F.col("product_details.product_name").alias("product"), "persona", "region")


# --- store ------------------------------------------------------------------------------------------------------

FIRST = "SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM leads WHERE id % 6 <> 0 AND url NOT IN (SELECT url FROM leads WHERE id % 6 = 0)"


@query("append_raw_leads", c("SELECT id, url FROM first_rows WHERE rn = 1", first_rows=FIRST))
def append_raw_leads(t):
    df = leads(t)
    return A.append_raw(df.filter("id % 6 <> 0"), df.filter("id % 6 = 0"), "crawler", as_of()).select("id", "url")


VALID = "(trim(coalesce(email, '')) <> '' OR trim(coalesce(phone, '')) <> '' OR trim(coalesce(full_name, '')) <> '' OR id % 7 <> 0)"


@query("append_unified", twin(f"SELECT id FROM fx_contacts WHERE id % 3 <> 0 AND {VALID}", "fx_contacts"))
def append_unified(t):
    u = unified_table(t)
    return A.append_unified(u.filter("id % 3 <> 0"), u.filter("id % 3 = 0")).select("id")


@query("append_counts", twin(f"SELECT count(*) AS total, count(*) FILTER (NOT {VALID}) AS failure, count(*) FILTER ({VALID} AND id % 3 <> 0) AS success, count(*) FILTER ({VALID} AND id % 3 = 0) AS duplicate FROM fx_contacts", "fx_contacts"))
def append_counts(t):
    u = unified_table(t)
    return A.append_counts(u, A.append_unified(u, u.filter("id % 3 = 0")), G.unified_valid())


UPD = "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'new' END AS industry FROM customer WHERE c_custkey % 5 = 0"


@query("apply_updates", c("SELECT l.id, coalesce(u.industry, l.industry) AS industry, u.id IS NOT NULL AS matched FROM leads l LEFT JOIN upd u USING (id)", upd=UPD))
def apply_updates(t):
    return A.apply_updates(leads(t), t.sql(UPD), "id").select("id", "industry", "matched")


@query("update_counts", c("SELECT count(*) AS matched, count(*) FILTER (u.industry IS NOT NULL) AS modified FROM leads l JOIN upd u USING (id)", upd=UPD))
def update_counts(t):
    return A.update_counts(leads(t), t.sql(UPD), "id")


@query("delete_where", c(f"SELECT id FROM leads WHERE NOT (platform = 'web' AND scraped_at < {AS_OF_SQL} - INTERVAL 30 DAY)"))
def delete_where(t):
    return A.delete_where(leads(t), (F.col("platform") == "web") & A.older_than(as_of(), 30)).select("id")


@query("deleted_count", c(f"SELECT count(*) AS deleted FROM leads WHERE scraped_at < {AS_OF_SQL} - INTERVAL 30 DAY"))
def deleted_count(t):
    return A.deleted_count(leads(t), A.older_than(as_of(), 30))


@query("write_version", c("SELECT id, platform FROM leads WHERE platform <> 'web'"))
def write_version(t):
    base = scratch(t, "table")
    df = leads(t).select("id", "platform", "url")
    A.write_version(df, base, 1, ["platform"])
    A.write_version(A.delete_where(A.read_version(t.spark, base), F.col("platform") == "web"), base, 2, ["platform"])
    return A.read_version(t.spark, base).select("id", "platform")


def export_rows(t):
    w = web_raw(t)
    return w.select("id", "source_url", "business_name", F.array_compact(F.array("contact_person")).alias("contact_person"), "email", "phone", "industry", "services", "lead_score",
                    F.create_map(F.lit("email"), F.lit(0.8)).alias("confidence_scores"), "social_media", "ai_leads")


@query("export_json_rows", twin("SELECT CAST(id AS VARCHAR) AS id, coalesce(nullif(trim(email), ''), '') AS email, industry, score AS lead_score FROM web", "fx_contacts", web=WEB))
def export_json_rows(t):
    path = scratch(t, "export")
    A.export_json(export_rows(t), path, as_of(), compress=True)
    return t.spark.read.schema("id string, email array<string>, industry string, lead_score double").json(f"{path}/leads").select("id", F.array_join("email", ",").alias("email"), "industry", "lead_score")


@query("export_json", twin("SELECT count(*) AS total_records, 'json' AS export_type FROM fx_contacts", "fx_contacts"))
def export_json(t):
    path = scratch(t, "export")
    A.export_json(export_rows(t), path, as_of(), compress=True)
    return t.spark.read.json(f"{path}/metadata").select("total_records", "export_type")


@query("validate_export", twin("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS corrupt, CAST(0 AS BIGINT) AS missing_required, count(*) AS declared, true AS valid FROM fx_contacts", "fx_contacts"))
def validate_export(t):
    path = scratch(t, "export")
    A.export_json(export_rows(t).drop("social_media"), path, as_of())
    return A.validate_export(t.spark, path)


@query("export_errors", c("""SELECT CAST(id AS VARCHAR) AS place, 'missing source_url' AS error FROM leads WHERE id % 4 = 0 UNION ALL SELECT '', 'missing id' FROM leads WHERE id % 5 = 0 AND id % 4 <> 0
 UNION ALL SELECT '', 'missing id' FROM leads WHERE id % 20 = 0 UNION ALL SELECT '{broken', 'not readable' FROM supplier""").replace("CAST(id AS VARCHAR) AS place, 'missing", "CASE WHEN id % 5 = 0 THEN '' ELSE CAST(id AS VARCHAR) END AS place, 'missing"))
def export_errors(t):
    path = scratch(t, "export")
    df = leads(t).select(F.when(F.col("id") % 5 == 0, "").otherwise(F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 4 != 0, F.col("url")).alias("source_url"), "industry")
    A.export_json(df, path, as_of())
    t.supplier.select(F.lit("{broken").alias("value")).write.mode("append").text(f"{path}/leads")
    return A.export_errors(t.spark, path)


@query("export_csv_flat", twin("SELECT CAST(id AS VARCHAR) AS id, coalesce(nullif(trim(email), ''), '') AS email, 0.8::DOUBLE AS confidence_email, concat('fb', id) AS social_facebook_url, CAST(CASE WHEN m1 IS NULL THEN 0 ELSE 1 END AS INT) AS ai_leads_count FROM web", "fx_contacts", web=WEB))
def export_csv_flat(t):
    return A.lead_flat(export_rows(t)).select("id", "email", "confidence_email", "social_facebook_url", "ai_leads_count")


@query("export_sheets", c("SELECT 'Total Leads' AS metric, CAST(count(*) AS VARCHAR) AS value FROM leads"))
def export_sheets(t):
    path = scratch(t, "sheets")
    A.export_sheets(leads(t).select(F.col("id").cast("string").alias("id"), "email", "phone", F.col("score").alias("lead_score"), F.col("scraped_at").alias("extraction_timestamp"),
                                    F.create_map(F.lit("email"), F.lit(0.8)).alias("confidence_scores")), path, ["email", "phone"])
    return t.spark.read.option("header", True).csv(f"{path}/summary").filter("metric = 'Total Leads'").select("metric", "value")


@query("export_filtered", c("SELECT id FROM leads WHERE score >= 5000"))
def export_filtered(t):
    path = scratch(t, "filtered")
    A.export_filtered(leads(t).select("id", "url", "score"), path, "json", as_of(), min_score=5000)
    return t.spark.read.json(f"{path}/leads").select("id")


@query("export_batched", c("SELECT id FROM leads"))
def export_batched(t):
    path = scratch(t, "batched")
    A.export_batched(leads(t).select("id", "url"), path, "json", 100)
    return t.spark.read.json(path).select("id")


@query("export_search", c("SELECT url FROM (SELECT url FROM leads WHERE regexp_matches(industry, '(?i)BUILD') ORDER BY url LIMIT 10000)"))
def export_search(t):
    path = scratch(t, "search")
    A.export_search(leads(t).select("url", "industry"), path, "json", "BUILD", ["industry"], 10000)
    return t.spark.read.json(path).select("url")


@query("unified_flat", twin("SELECT url, platform, coalesce(full_name, '') AS full_name, coalesce(location, '') AS location, coalesce(nullif(trim(email), ''), '') AS emails, coalesce(phone, '') AS phone_numbers, industry, icp_identifier, scraped_at, score AS data_quality_score FROM fx_contacts", "fx_contacts"))
def unified_flat(t):
    f = A.unified_flat(unified_table(t))
    assert len(f.columns) == 26
    return f.select("url", "platform", "full_name", "location", "emails", "phone_numbers", "industry", "icp_identifier", "scraped_at", "data_quality_score")


@query("unified_flat_rest", twin("""SELECT url, '' AS bio, '' AS job_title, '' AS address, '' AS websites, '' AS linkedin, '' AS twitter, '' AS facebook, '' AS instagram, '' AS youtube, '' AS tiktok,
 CASE WHEN id % 7 = 0 THEN '' ELSE concat('Biz ', id) END AS company_name, '' AS company_type, CASE id % 3 WHEN 0 THEN 'B2B' WHEN 1 THEN 'B2C' ELSE '' END AS lead_category, '' AS lead_sub_category, '' AS decision_makers, '' AS bdr FROM fx_contacts""", "fx_contacts"))
def unified_flat_rest(t):
    rest = ("bio", "job_title", "address", "websites", "linkedin", "twitter", "facebook", "instagram", "youtube", "tiktok", "company_name", "company_type", "lead_category", "lead_sub_category",
            "decision_makers", "bdr")
    return A.unified_flat(unified_table(t)).select("url", *[F.coalesce(c, F.lit("")).alias(c) for c in rest])


@query("write_raw_extraction", twin("SELECT page_id, url, true AS json_ld FROM fx_pages", "fx_pages"))
def write_raw_extraction(t):
    path = scratch(t, "raw")
    A.raw_extraction(t.fx_pages, as_of()).write.json(path)
    return t.spark.read.json(path).select("page_id", "metadata.url", "summary.json_ld")


# --- streams ----------------------------------------------------------------------------------------------------

@query("url_frontier_stream", twin("SELECT DISTINCT url, url_type FROM queue", "fx_urls", queue=QUEUE))
def url_frontier_stream(t):
    St.read_stream(t.spark, t.dir, "customer.parquet").createOrReplaceTempView("customer")
    t.nation.createOrReplaceTempView("nation")
    out = scratch(t, "frontier")
    St.run_to_files(St.url_frontier(t.spark.sql(URLS)), out)
    return t.spark.read.parquet(out).select("url", "url_type")


def windows_query(name, size, slide, sql):
    @query(name, sql)
    def run(t):
        out = scratch(t, name)
        St.run_to_files(St.activity_windows(St.read_stream(t.spark, t.dir, "events.parquet"), size, slide), out, mode="update")
        # The newest count of a window is in its last batch.
        return t.spark.read.parquet(out).groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))


windows_query("activity_windows", "1 day", None, "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
windows_query("activity_windows_sliding", "24 hours", "12 hours", """SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END - k * INTERVAL 12 HOUR AS w
 FROM events, range(0, 2) r(k)) GROUP BY ALL""")


@query("lead_upsert_stream", c("""SELECT id FROM leads WHERE id NOT IN (SELECT id FROM k WHERE key IN (SELECT key FROM k p WHERE p.id < k.id))""",
                               k="SELECT id, k AS key FROM (" + keyed("leads") + ") UNION SELECT id, concat_ws(chr(1), lower(trim(full_name)), url, company_name, content_type) FROM leads WHERE coalesce(trim(email), '') = '' AND coalesce(trim(phone), '') = ''"))
def lead_upsert_stream(t):
    src, out = scratch(t, "arrivals"), scratch(t, "store")
    leads(t).select("id", "ord", "emails", "phones", "full_name", "url", "company_name", "content_type").write.parquet(src)
    St.lead_upsert(St.read_stream(t.spark, src, "*.parquet"), out)
    return t.spark.read.parquet(out).select("id")


@query("retention_stream", c(f"SELECT id FROM leads WHERE scraped_at >= {AS_OF_SQL} - INTERVAL 30 DAY"))
def retention_stream(t):
    return St.retention(leads(t), as_of(), 30).select("id")


@query("request_sessions", """
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM
 (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, s""")
def request_sessions(t):
    return St.request_sessions(t.events)


@query("request_rate", "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1")
def request_rate(t):
    return St.request_rate(t.events)


# --- composed jobs ----------------------------------------------------------------------------------------------

@query("extract_leads")
def extract_leads(t):
    e = W.extract_leads(t.fx_rich)
    n = lambda col: F.size(col).alias("n_" + col)
    return e.select("page_id", "company_name", "industry", "size_estimate", n("phones"), n("emails"), n("addresses"), n("people"), F.round("intent_score", 2).alias("intent_score"),
                    F.round("data_confidence", 3).alias("data_confidence"), "score.total_score", "score.classification")


@query("lead_from_extraction")
def lead_from_extraction(t):
    return G.lead_from_extraction(W.extract_leads(t.fx_pages)).select("id", "source_url", "business_name", F.array_join("email", ",").alias("email"), "lead_score",
                                                                     F.round(F.col("confidence_scores")["email"], 6).alias("email_confidence"))


@query("process_leads", twin("SELECT count(*) AS n FROM web WHERE coalesce(e, m1) IS NULL AND p IS NOT NULL", "fx_contacts", web=WEB))
def process_leads(t):
    # Leads that only have a phone: one row per lead in, the richest per phone out; phones of this slice are distinct.
    out = W.process_leads(web_raw(t), as_of())
    return out.filter("primary_contact_type = 'phone'").agg(F.sum("group_size").alias("n"))


@query("process_counters")
def process_counters(t):
    raw = web_raw(t)
    rows = G.leadgen_rows(raw.filter(G.has_contact()), as_of())
    return W.process_counters(raw, rows, W.process_leads(raw, as_of()))


@query("flagship", twin("""SELECT source AS icp_identifier, 'web' AS platform, count(*) AS total, count(*) FILTER (ne > 0) AS with_email, count(*) FILTER (np > 0) AS with_phone, count(*) AS last_day FROM
 (SELECT doc_id, count(*) FILTER (starts_with(k, 'e:')) AS ne, count(*) FILTER (starts_with(k, 'p:')) AS np, bool_and(first = doc_id) AS mine FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM keys) GROUP BY doc_id)
 JOIN documents USING (doc_id) WHERE mine GROUP BY source""", cand=phone_candidates("documents", "doc_id"), e=email_sql("documents", "doc_id"),
                         ph=f"SELECT doc_id, unnest(kept).clean AS clean FROM (SELECT doc_id, {FOLD} AS kept FROM (SELECT doc_id, list({{'value': value, 'clean': clean, 'confidence': confidence}} ORDER BY k, i) AS c FROM cand GROUP BY doc_id))",
                         keys="SELECT doc_id, 'e:' || value AS k FROM e UNION SELECT doc_id, 'p:' || clean FROM ph"))
def flagship(t):
    return W.flagship(t.documents, as_of())
