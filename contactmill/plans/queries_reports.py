"""Report and read queries and their SQL twins."""

from datetime import date

from pyspark.sql import functions as F

from contactmill.functions import url_rules as R
from contactmill.operators import reads as K
from contactmill.operators import reports as J
from contactmill.plans.catalog import query
from contactmill.plans.derived import AS_OF_SQL, as_of, q, sql_rules, twin
from contactmill.plans.queries_match import LEADS, leads
from contactmill.plans.queries_unify import unified_table

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def c(body, **more):
    return twin(body, "fx_contacts", leads=LEADS, **more)


@query("collection_counts", c("SELECT platform AS collection, count(*) AS n FROM leads GROUP BY platform UNION ALL SELECT 'total', count(*) FROM leads"))
def collection_counts(t):
    df = leads(t)
    return J.collection_counts({p: df.filter(F.col("platform") == p) for p in ("instagram", "linkedin", "youtube", "facebook", "web")})


@query("collection_activity", c(f"SELECT platform, count(*) AS total, count(*) FILTER (scraped_at >= {NOW} - INTERVAL 7 DAY) AS recent, count(DISTINCT full_name) AS distinct_names FROM leads GROUP BY platform"))
def collection_activity(t):
    return J.collection_activity(leads(t), now(), who="full_name")


FIELDS = ["email", "phone", "industry", "full_name"]


@query("field_stats", c(" UNION ALL ".join(f"SELECT {q(f)} AS field, count(*) AS total, count(*) FILTER (coalesce({f}, '') <> '') AS non_null, count(*) FILTER (coalesce({f}, '') = '') AS empty, round(count(*) FILTER (coalesce({f}, '') <> '') / count(*)::DOUBLE, 4) AS rate FROM leads" for f in FIELDS)))
def field_stats(t):
    return J.field_stats(leads(t), FIELDS)


@query("field_values", c("SELECT field, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY value) AS rank FROM (SELECT DISTINCT 'industry' AS field, industry AS value FROM leads WHERE industry <> '' UNION SELECT 'location', location FROM leads WHERE location <> '')) WHERE rank <= 10"))
def field_values(t):
    return J.field_values(leads(t), ["industry", "location"], 10)


@query("platform_fill", twin("SELECT platform, count(*) AS total, count(*) FILTER (id % 7 <> 0) AS with_company_name, count(*) FILTER (industry <> '') AS with_industry, count(*) FILTER (id % 3 < 2) AS with_lead_category FROM fx_contacts GROUP BY platform", "fx_contacts"))
def platform_fill(t):
    return J.platform_fill(unified_table(t))


@query("icp_stats", twin(f"SELECT icp_identifier, platform, count(*) AS total, count(*) FILTER (trim(email) <> '') AS with_email, count(*) FILTER (trim(phone) <> '') AS with_phone, count(*) FILTER (scraped_at >= {NOW} - INTERVAL 24 HOUR) AS last_day FROM fx_contacts GROUP BY ALL", "fx_contacts"))
def icp_stats(t):
    return J.icp_stats(unified_table(t), now())


@query("storage_stats", c("SELECT count(*) AS total, round(avg(score), 4) AS avg_score, min(score) AS min_score, max(score) AS max_score, min(scraped_at) AS oldest, max(scraped_at) AS newest FROM leads"))
def storage_stats(t):
    return J.storage_stats(leads(t))


@query("storage_distribution", c("SELECT 'industry' AS kind, industry AS value, count(*) AS n FROM leads GROUP BY industry UNION ALL SELECT 'platform', platform, count(*) FROM leads GROUP BY platform"))
def storage_distribution(t):
    df = leads(t)
    return J.distribution(df, "industry").withColumn("kind", F.lit("industry")).unionByName(J.distribution(df, "platform").withColumn("kind", F.lit("platform")))


@query("summary_sheet", c("""SELECT CAST(0 AS INT) AS pos, 'Total Leads' AS metric, CAST(count(*) AS VARCHAR) AS value FROM leads UNION ALL SELECT 1, 'Average Score', printf('%.2f', round(avg(score), 4)) FROM leads UNION ALL SELECT 2, 'Minimum Score', printf('%.2f', min(score)) FROM leads
 UNION ALL SELECT 3, 'Maximum Score', printf('%.2f', max(score)) FROM leads UNION ALL SELECT 4, 'Oldest Lead', strftime(min(scraped_at), '%Y-%m-%d %H:%M:%S') FROM leads UNION ALL SELECT 5, 'Newest Lead', strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') FROM leads"""))
def summary_sheet(t):
    return J.summary_sheet(leads(t))


@query("statistics_sheet", c("SELECT 'email' AS field, count(*) FILTER (email <> '') AS filled, round(count(*) FILTER (email <> '') * 100.0 / count(*), 2)::DOUBLE AS fill_pct, round(avg(data_confidence), 4) AS mean_confidence FROM leads UNION ALL SELECT 'phone', count(*) FILTER (phone <> ''), round(count(*) FILTER (phone <> '') * 100.0 / count(*), 2)::DOUBLE, NULL FROM leads"))
def statistics_sheet(t):
    df = leads(t).withColumn("confidence_scores", F.create_map(F.lit("email"), F.col("data_confidence")))
    return J.statistics_sheet(df, ["email", "phone"])


@query("filter_stats", c("SELECT (SELECT count(*) FROM leads) AS raw_total, count(*) AS extracted, count(DISTINCT company_name) AS companies, count(DISTINCT industry) AS industries, count(*) FILTER (email <> '') AS email_based, count(*) FILTER (coalesce(email, '') = '') AS phone_based FROM leads WHERE email <> '' OR phone <> ''"))
def filter_stats(t):
    df = leads(t)
    ex = df.filter("email <> '' or phone <> ''").select(F.col("company_name").alias("Company Name"), F.col("industry").alias("Industry"), F.when(F.coalesce("email", F.lit("")) != "", "email").otherwise("phone").alias("primary_contact_type"))
    return J.filter_stats(df, ex)


@query("run_summary", twin("SELECT scraper, count(*) AS urls, count(*) FILTER (status = 'success') AS successful, round(count(*) FILTER (status = 'success') * 100.0 / count(*), 2)::DOUBLE AS success_pct, round(avg(seconds), 6) AS avg_seconds, round(count(*) / sum(seconds), 6) AS urls_per_second FROM fx_run_log GROUP BY scraper", "fx_run_log"))
def run_summary(t):
    return J.run_summary(t.fx_run_log)


@query("run_report", twin("SELECT coalesce(scraper, 'all') AS scraper, count(*) AS total, count(*) FILTER (status = 'success') AS stored, count(*) FILTER (status = 'signup_page') AS duplicates, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'success') / count(*)::DOUBLE, 6) AS success_rate, round(count(*) FILTER (status <> 'failed') / count(*)::DOUBLE, 6) AS validation_rate FROM fx_run_log GROUP BY ROLLUP (scraper)", "fx_run_log"))
def run_report(t):
    return J.run_report(t.fx_run_log)


@query("successful_sources", twin("SELECT count(*) AS sources, count(*) FILTER (ok > 0) AS successful FROM (SELECT scraper, count(*) FILTER (status = 'success') AS ok FROM fx_run_log GROUP BY scraper)", "fx_run_log"))
def successful_sources(t):
    return J.successful_sources(t.fx_run_log)


@query("category_report", c("SELECT industry AS category, count(*) AS n, count(*) FILTER (email <> '') AS with_email, count(*) FILTER (phone <> '') AS with_phone, round(count(*) * 100.0 / (SELECT count(*) FROM leads), 4)::DOUBLE AS share FROM leads GROUP BY industry"))
def category_report(t):
    return J.category_report(leads(t))


@query("category_samples", c("SELECT industry, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY id) AS rank FROM leads) WHERE rank <= 5"))
def category_samples(t):
    return J.samples(leads(t), "industry", 5).select("industry", "id", "rank")


@query("scrape_outcomes", twin("SELECT scraper, status, count(*) AS n FROM fx_run_log GROUP BY ALL", "fx_run_log"))
def scrape_outcomes(t):
    return J.scrape_outcomes(t.fx_run_log)


@query("enhancement_counts", c("SELECT count(*) FILTER (email IS NOT NULL OR phone IS NOT NULL) AS enhanced, count(*) FILTER (email IS NOT NULL) AS with_emails, count(*) FILTER (phone IS NOT NULL) AS with_phones FROM leads"))
def enhancement_counts(t):
    return J.enhancement_counts(leads(t).withColumn("phone_numbers", F.col("phones")))


ERR = sql_rules("lower(message)", J.ERROR_RULES, "'unknown'")


@query("error_stats", twin(f"SELECT error_type, n, error_type NOT IN ('private_profile', 'blocked_profile') AS retryable FROM (SELECT {ERR} AS error_type, count(*) AS n FROM fx_run_log WHERE message IS NOT NULL GROUP BY 1)", "fx_run_log"))
def error_stats(t):
    return J.error_stats(t.fx_run_log)


SRC = " UNION ALL ".join(f"SELECT {q(n)} AS name, {q(u)} AS url_type" for n, u, _, _ in R.SOURCES)


@query("source_registry", twin("SELECT name, r.url_type, count(id) AS urls FROM reg r LEFT JOIN (SELECT id, CASE WHEN contains(url, 'instagram.com') THEN 'instagram' WHEN contains(url, 'linkedin.com') THEN 'linkedin' ELSE 'other' END AS url_type FROM fx_urls) USING (url_type) GROUP BY ALL", "fx_urls", reg=SRC))
def source_registry(t):
    urls = t.fx_urls.select("id", F.when(F.col("url").contains("instagram.com"), "instagram").when(F.col("url").contains("linkedin.com"), "linkedin").otherwise("other").alias("url_type"))
    per_type = urls.groupBy("url_type").agg(F.count("id").alias("urls"))
    return J.source_registry(t.spark).select("name", "url_type").join(per_type, "url_type", "left").withColumn("urls", F.coalesce("urls", F.lit(0)).cast("bigint"))


# --- reads ------------------------------------------------------------------------------------------------------

@query("unified_page", c("SELECT url, scraped_at FROM fx_contacts WHERE platform = 'instagram' ORDER BY scraped_at DESC, url LIMIT 20 OFFSET 40"))
def unified_page(t):
    return K.newest(unified_table(t), F.col("platform") == "instagram", 40, 20).select("url", "scraped_at")


@query("unified_search", c("SELECT url FROM fx_contacts WHERE industry = 'machinery' ORDER BY url LIMIT 25"))
def unified_search(t):
    return K.search(unified_table(t), F.col("industry") == "machinery", 25).select("url")


@query("by_source", c("SELECT id FROM leads WHERE platform = 'web' ORDER BY scraped_at DESC, id LIMIT 30 OFFSET 10"))
def by_source(t):
    return K.newest(leads(t), F.col("platform") == "web", 10, 30, key="id").select("id")


@query("search_all", c("SELECT platform AS collection, id FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY id) AS rn FROM leads WHERE email IS NOT NULL) WHERE rn <= 7"))
def search_all(t):
    df = leads(t)
    return K.search_all({p: df.filter(F.col("platform") == p) for p in ("instagram", "linkedin", "youtube", "facebook", "web")}, F.col("email").isNotNull(), 7, "id").select("collection", "id")


@query("all_urls", c("SELECT url, id FROM fx_contacts"))
def all_urls(t):
    return K.all_urls(unified_table(t), "contact", "profile").select("url", "id")


@query("by_icp", c("SELECT url FROM fx_contacts WHERE icp_identifier = 'icp_1' ORDER BY scraped_at DESC, url LIMIT 100"))
def by_icp(t):
    return K.by_icp(unified_table(t), "icp_1", limit=100).select("url")


@query("recent", c(f"SELECT url FROM fx_contacts WHERE scraped_at >= {NOW} - INTERVAL 48 HOUR ORDER BY scraped_at DESC, url LIMIT 1000"))
def recent(t):
    return K.recent(unified_table(t), now(), 48, 1000).select("url")


@query("processing_filter", c("SELECT id FROM leads WHERE score > 5000 AND platform <> 'web'"))
def processing_filter(t):
    return leads(t).filter((F.col("score") > 5000) & (F.col("platform") != "web")).select("id")


@query("text_search", c("SELECT id FROM leads WHERE (regexp_matches(full_name, '(?i)customer#0+12') OR regexp_matches(industry, '(?i)customer#0+12') OR regexp_matches(email, '(?i)customer#0+12')) AND scraped_at >= TIMESTAMP '2024-01-02' AND scraped_at < TIMESTAMP '2024-01-21'"))
def text_search(t):
    return K.text_search(leads(t), "customer#0+12", ["full_name", "industry", "email"], date(2024, 1, 2), date(2024, 1, 20)).select("id")


@query("filter_leads", c("SELECT id FROM leads WHERE score >= 1000 AND score <= 8000 AND industry = 'building' AND scraped_at >= TIMESTAMP '2024-01-05'"))
def filter_leads(t):
    return K.filter_leads(leads(t), 1000, 8000, industry="building", since=F.lit("2024-01-05").cast("timestamp")).select("id")


@query("get_lead", c("SELECT id, url FROM leads WHERE id = 17"))
def get_lead(t):
    return K.get_lead(leads(t), 17).select("id", "url")


@query("quality_sorted", c("SELECT id, score AS quality FROM leads"))
def quality_sorted(t):
    from contactmill.operators.merge import quality_sorted as qs
    return qs(leads(t).withColumn("quality", F.col("score"))).select("id", "quality")


@query("sort_by_confidence", c("SELECT id, CASE WHEN id % 2 = 0 THEN 'b,a' ELSE 'a,b' END AS names FROM leads"))
def sort_by_confidence(t):
    from contactmill.operators.contacts import by_confidence
    s = lambda n, v: F.struct(v.cast("double").alias("confidence"), F.lit(n).alias("n"))
    arr = F.array(s("a", F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.9)), s("b", F.lit(0.5)))
    return leads(t).select("id", F.array_join(F.transform(by_confidence(arr), lambda x: x["n"]), ",").alias("names"))
