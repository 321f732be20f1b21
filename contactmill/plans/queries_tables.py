"""Queries over what is kept between runs: key indexes, daily sketches, folders updated in place, expiring leads; and over
keyword tables given as data."""

from pyspark.sql import functions as F

from contactmill.functions import business_rules as B
from contactmill.operators import keywords as K
from contactmill.operators import match as M
from contactmill.operators import reports as R
from contactmill.plans.catalog import ENTRIES, query
from contactmill.plans.derived import AS_OF_SQL, as_of, q, twin
from contactmill.plans.queries_business import BIZ_TEXT, facts_sql, industry_sql
from contactmill.plans.queries_jobs import c, scratch
from contactmill.plans.queries_match import leads, split
from contactmill.sources import keyindex as Ix
from contactmill.sources import store as A
from contactmill.streaming import expiry as Ex
from contactmill.streaming import jobs as St

# --- lookups in an index of the store's keys: the same answers as `dup_unified`, `dup_crawl`, `dup_web` ---------------


def index_query(name, twin_of, store_keys, lookup):
    @query(name, ENTRIES[twin_of].sql)
    def run(t):
        new, stored = split(t)
        # Half of the store is indexed at first, the other half added, as runs do.
        index = Ix.build_index(store_keys(stored.filter("id % 2 = 0")), scratch(t, "keys"), buckets=8, shards=4)
        Ix.add_keys(index, store_keys(stored.filter("id % 2 = 1")))
        return lookup(new, index)


index_query("dup_unified_indexed", "dup_unified", M.unified_store_keys, M.dup_unified_indexed)
index_query("dup_crawl_indexed", "dup_crawl", M.crawl_store_keys, M.dup_crawl_indexed)
index_query("dup_web_indexed", "dup_web", M.web_store_keys, lambda new, index: M.dup_web_indexed(new, index).select("id"))


# --- daily sketches ---------------------------------------------------------------------------------------------------

LAST_DAY = "DATE '2024-01-30'"
WITHIN = f"CAST(scraped_at AS DATE) <= {LAST_DAY} AND CAST(scraped_at AS DATE) > {LAST_DAY} - {{}}"
#: Five standard errors of a sketch.
ERROR = 5 * 1.04 / 2 ** (R.SKETCH / 2)


@query("activity_sketches", c(" UNION ALL ".join(f"SELECT {d} AS days, platform, count(*) AS total, count(DISTINCT url) AS exact_names, true AS within FROM leads WHERE {WITHIN.format(d)} GROUP BY platform" for d in (7, 30))))
def activity_sketches(t):
    path, last = scratch(t, "sketches"), F.expr(LAST_DAY)
    R.activity_sketches(leads(t), who="url").write.parquet(path)
    kept, out = t.spark.read.parquet(path), None
    for days in (7, 30):
        day = F.to_date("scraped_at")
        exact = leads(t).filter((day <= last) & (day > F.date_sub(last, days))).groupBy("platform").agg(F.countDistinct("url").alias("exact_names"))
        both = R.activity_between(kept, last, days).join(exact, "platform")
        one = both.select(F.lit(days).alias("days"), "platform", "total", "exact_names", (F.abs(F.col("distinct_names") - F.col("exact_names")) <= ERROR * F.col("exact_names")).alias("within"))
        out = one if out is None else out.unionByName(one)
    return out


SKETCHED = ["full_name", "email", "phone", "industry", "location"]


@query("field_sketches", c(" UNION ALL ".join(f"SELECT {q(f)} AS field, count(*) AS total, count(nullif({f}, '')) AS non_null, count(DISTINCT nullif({f}, '')) AS exact_values, true AS within FROM leads WHERE {WITHIN.format(30)}" for f in SKETCHED)))
def field_sketches(t):
    path, last, day = scratch(t, "sketches"), F.expr(LAST_DAY), F.to_date("scraped_at")
    R.field_sketches(leads(t), SKETCHED).write.parquet(path)
    some = leads(t).filter((day <= last) & (day > F.date_sub(last, 30)))
    exact = some.agg(*[F.countDistinct(F.nullif(F.col(f), F.lit(""))).alias(f) for f in SKETCHED])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("exact_values")) for f in SKETCHED])))
    both = R.fields_between(t.spark.read.parquet(path), last, 30).join(exact, "field")
    return both.select("field", "total", "non_null", "exact_values", (F.abs(F.col("distinct_values") - F.col("exact_values")) <= ERROR * F.col("exact_values")).alias("within"))


# --- folders updated in place -----------------------------------------------------------------------------------------

# A key has one to three updates; the last filled value of each column wins.
CHANGES = """SELECT c_custkey - c_custkey % 30 AS id, CAST(c_custkey % 30 AS INT) AS step, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('new ', c_custkey) END AS industry,
 CASE WHEN c_custkey % 30 = 1 THEN 'moved' END AS platform FROM customer WHERE c_custkey % 30 < 3"""


@query("update_partitions", c("""SELECT l.id, coalesce(u.platform, l.platform) AS platform, coalesce(u.industry, l.industry) AS industry FROM leads l LEFT JOIN
 (SELECT id, arg_max(industry, step) FILTER (industry IS NOT NULL) AS industry, max(platform) AS platform FROM changes GROUP BY id) u USING (id)""", changes=CHANGES))
def update_partitions(t):
    path = scratch(t, "table")
    leads(t).select("id", "industry", "url", "platform").write.partitionBy("platform").parquet(path)
    A.update_partitions(t.spark, path, t.sql(CHANGES), "id", "platform", order="step")
    return t.spark.read.parquet(path).select("id", "platform", "industry")


@query("delete_in_partitions", c(f"SELECT id FROM leads WHERE NOT (platform = 'web' AND scraped_at < {AS_OF_SQL} - INTERVAL 30 DAY)"))
def delete_in_partitions(t):
    path = scratch(t, "table")
    leads(t).select("id", "scraped_at", "platform").write.partitionBy("platform").parquet(path)
    A.delete_in_partitions(t.spark, path, (F.col("platform") == "web") & A.older_than(as_of(), 30), "platform")
    return t.spark.read.parquet(path).select("id")


# --- leads that expire by their own time ------------------------------------------------------------------------------

# Many of every fourth leads are seen again 14 days on; no sighting is later than the clock of the queries.
SIGHTINGS = "SELECT id, scraped_at FROM leads UNION ALL SELECT id, scraped_at + INTERVAL '14' DAY AS scraped_at FROM leads WHERE id % 4 = 0 AND id % 3 <> 0"


def arrivals(t):
    """Sightings in four arrivals by time, the second sightings of some leads a round late; then the clock."""
    leads(t).createOrReplaceTempView("leads")
    path = scratch(t, "sightings")
    rows = t.spark.sql(SIGHTINGS).withColumn("_round", F.least(F.datediff("scraped_at", F.expr("DATE '2024-01-01'")) / 15 + F.when(F.col("id") % 8 == 0, 1).otherwise(0), F.lit(3)).cast("int"))
    for r in range(4):
        rows.filter(F.col("_round") == r).drop("_round").write.mode("append").parquet(path)
    t.spark.range(1).select(F.lit(None).cast("long").alias("id"), as_of().alias("scraped_at")).select(*rows.drop("_round").columns).write.mode("append").parquet(path)
    return path


@query("retention_state_stream", c(f"SELECT id FROM sightings GROUP BY id HAVING max(scraped_at) >= {AS_OF_SQL} - INTERVAL 30 DAY", sightings=SIGHTINGS))
def retention_state_stream(t):
    path, out = arrivals(t), scratch(t, "expiry")
    Ex.run_expiry(St.read_stream(t.spark, path, "*.parquet", max_files=8), out, 30)
    return Ex.living(t.spark.read.parquet(out)).select("id")


# --- keyword tables ---------------------------------------------------------------------------------------------------

@query("industry_by_keywords", twin(industry_sql("biz", "id"), biz=BIZ_TEXT))
def industry_by_keywords(t):
    table = K.keyword_table(t.spark, B.INDUSTRIES, lambda w: 2 * len(w.split()))
    return K.industry_by(t.sql(BIZ_TEXT), table).select("id", "industry")


@query("services_by_keywords", f"SELECT doc_id, services FROM ({facts_sql('documents', 'doc_id')})")
def services_by_keywords(t):
    return K.services_by(t.documents, K.keyword_table(t.spark, B.SERVICES)).select("doc_id", F.array_join("services", ",").alias("services"))


WORDS = ", ".join(f"({q(label)}, {q(w)})" for label, ws in B.INTENTS.items() for w in ws)


@query("intents_by_keywords", twin("SELECT id, category, match FROM biz JOIN words ON contains(lower(text), match)", biz=BIZ_TEXT, words=f"SELECT * FROM (VALUES {WORDS}) AS v(category, match)"))
def intents_by_keywords(t):
    return K.intents_by(t.sql(BIZ_TEXT), K.keyword_table(t.spark, B.INTENTS)).select("id", F.inline("intents"))


# Every part's name is a keyword of its type, and the texts are what customers ordered.
PART_WORDS = "SELECT p_type AS label, CAST(dense_rank() OVER (ORDER BY p_type) AS INT) AS rank, lower(p_name) AS word, CAST(max(p_size) AS BIGINT) AS weight FROM part GROUP BY p_type, lower(p_name)"
PART_TEXT = "SELECT o_orderkey AS id, concat('We need ', a.p_name, ' and ', b.p_name, ', ', a.p_name, ' best of all, by ', o_orderpriority) AS text FROM orders JOIN part a ON a.p_partkey = o_custkey % 200 JOIN part b ON b.p_partkey = o_orderkey % 200"


@query("part_keywords", twin("""SELECT id, coalesce(arg_max(label, {'s': score, 'r': -rank}), 'general') AS industry FROM
 (SELECT t.id, label, rank, sum(weight * ((length(lower(text)) - length(replace(lower(text), word, ''))) // length(word))) AS score FROM texts t JOIN words ON contains(lower(text), word) GROUP BY ALL) GROUP BY id""", words=PART_WORDS, texts=PART_TEXT))
def part_keywords(t):
    return K.industry_by(t.sql(PART_TEXT), t.sql(PART_WORDS)).select("id", "industry")
