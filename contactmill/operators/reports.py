"""Counts and reports. Each report is one aggregation over one scan, never a query per value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions import text as X
from contactmill.functions.text import up_to
from contactmill.functions import url_rules as R


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def collection_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and the grand total (an empty table counts as zero)."""
    counts = union_all([df.agg(F.count("*").alias("n")).select(F.lit(n).alias("collection"), "n") for n, df in tables.items()])
    return counts.rollup("collection").agg(F.sum("n").alias("n")).withColumn("collection", F.coalesce("collection", F.lit("total")))


def collection_activity(leads: DataFrame, as_of: Column, by: str = "platform", who: str = "username", days: int = 7) -> DataFrame:
    return leads.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("scraped_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")).alias("recent"),
                                 F.countDistinct(who).alias("distinct_names"))


#: Registers of a sketch as a power of two: the estimate's standard error is about 1.04 / sqrt(2 ** 12), 1.6 per cent.
SKETCH = 12


def activity_sketches(leads: DataFrame, by: str = "platform", who: str = "username", ts: str = "scraped_at") -> DataFrame:
    """day, ``by``, total and a sketch of the names seen that day: the stored form, a few kilobytes a row at most. Days can
    be written as they end; sketches of one day from several runs add up too."""
    return leads.groupBy(F.to_date(ts).alias("day"), by).agg(F.count("*").alias("total"), F.hll_sketch_agg(who, F.lit(SKETCH)).alias("names"))


def activity_between(sketches: DataFrame, last_day: Column, days: int, by: str = "platform") -> DataFrame:
    """Rows and distinct names of the ``days`` days up to and including ``last_day``, from daily sketches alone."""
    part = sketches.filter((F.col("day") <= last_day) & (F.col("day") > F.date_sub(last_day, days)))
    return part.groupBy(by).agg(F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("names", F.lit(False))).alias("distinct_names"))


def field_sketches(leads: DataFrame, fields: list[str], ts: str = "scraped_at") -> DataFrame:
    """day, field, rows, filled rows and a sketch of the values, in one pass."""
    each = leads.select(F.to_date(ts).alias("day"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    filled = F.when(X.filled("value"), F.col("value"))
    return each.groupBy("day", "field").agg(F.count("*").alias("total"), F.count(filled).alias("non_null"), F.hll_sketch_agg(filled, F.lit(SKETCH)).alias("values"))


def fields_between(sketches: DataFrame, last_day: Column, days: int) -> DataFrame:
    """`field_stats` of the ``days`` days up to and including ``last_day``, with an estimate of the distinct values."""
    part = sketches.filter((F.col("day") <= last_day) & (F.col("day") > F.date_sub(last_day, days)))
    return part.groupBy("field").agg(F.sum("total").alias("total"), F.sum("non_null").alias("non_null"),
                                     F.hll_sketch_estimate(F.hll_union_agg("values", F.lit(False))).alias("distinct_values"))


def field_stats(leads: DataFrame, fields: list[str]) -> DataFrame:
    """Filled and empty rows per field, one pass; null and '' both count as empty."""
    one = leads.agg(F.count("*").alias("total"), *[F.count_if(X.filled(f)).alias(f) for f in fields])
    return one.select(F.lit(None).alias("_"), "total", F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("non_null")) for f in fields]))).select(
        "field", "total", "non_null", (F.col("total") - F.col("non_null")).alias("empty"),
        F.round(F.when(F.col("total") > 0, F.col("non_null") / F.col("total")).otherwise(0.0), 4).alias("rate"))


def field_values(leads: DataFrame, fields: list[str], top: int | None = None) -> DataFrame:
    """Distinct values of each categorical field, in order, up to ``top`` where that is given."""
    values = leads.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])))
    w = Window.partitionBy("field").orderBy("value")
    return up_to(values.filter(X.filled("value")).distinct().withColumn("rank", F.row_number().over(w)), top)


def platform_fill(leads: DataFrame) -> DataFrame:
    return leads.groupBy("platform").agg(F.count("*").alias("total"), *[
        F.count_if(X.filled(c)).alias("with_" + c) for c in ("company_name", "industry", "lead_category")])


def _some(c) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def icp_stats(leads: DataFrame, as_of: Column) -> DataFrame:
    """Per profile and platform: leads, with email, with phone, seen in the last day."""
    return leads.groupBy("icp_identifier", "platform").agg(
        F.count("*").alias("total"), F.count_if(_some("contact.emails")).alias("with_email"), F.count_if(_some("contact.phone_numbers")).alias("with_phone"),
        F.count_if(F.col("scraped_at") >= as_of - F.expr("INTERVAL 24 HOURS")).alias("last_day"))


def storage_stats(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count("*").alias("total"), F.round(F.avg("score"), 4).alias("avg_score"), F.min("score").alias("min_score"),
                     F.max("score").alias("max_score"), F.min("scraped_at").alias("oldest"), F.max("scraped_at").alias("newest"))


def distribution(leads: DataFrame, column: str) -> DataFrame:
    return leads.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def summary_sheet(leads: DataFrame) -> DataFrame:
    """Ordered metric/value rows, numbers as text with two decimals."""
    s = storage_stats(leads)
    two = lambda c: F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0)))
    rows = [("Total Leads", F.col("total").cast("string")), ("Average Score", two("avg_score")), ("Minimum Score", two("min_score")), ("Maximum Score", two("max_score")),
            ("Oldest Lead", F.date_format("oldest", "yyyy-MM-dd HH:mm:ss")), ("Newest Lead", F.date_format("newest", "yyyy-MM-dd HH:mm:ss"))]
    return s.select(F.posexplode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in rows])).alias("pos", "_r")).select("pos", "_r.*")


def statistics_sheet(leads: DataFrame, fields: list[str], confidences: str = "confidence_scores") -> DataFrame:
    """Per field: filled rows, share and mean confidence of the rows that have one."""
    conf = lambda f: F.try_element_at(F.col(confidences), F.lit(f))
    one = leads.agg(F.count("*").alias("total"), *[F.struct(F.count_if(X.filled(f)).alias("filled"), F.round(F.avg(conf(f)), 4).alias("conf")).alias(f) for f in fields])
    return one.select("total", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.filled").alias("filled"), F.col(f"{f}.conf").alias("mean_confidence")) for f in fields]))).select(
        "field", "filled", F.round(F.col("filled") * 100.0 / F.col("total"), 2).alias("fill_pct"), "mean_confidence")


def filter_stats(raw: DataFrame, extracted: DataFrame) -> DataFrame:
    r = raw.agg(F.count("*").alias("raw_total")).withColumn("_k", F.lit(1))
    e = extracted.agg(F.count("*").alias("extracted"), F.countDistinct("Company Name").alias("companies"), F.countDistinct("Industry").alias("industries"),
                      F.count_if(F.col("primary_contact_type") == "email").alias("email_based"),
                      F.count_if(F.col("primary_contact_type") == "phone").alias("phone_based")).withColumn("_k", F.lit(1))
    return r.join(e, "_k").drop("_k")


def run_summary(log: DataFrame) -> DataFrame:
    n, ok = F.count("*"), F.count_if(F.col("status") == "success")
    return log.groupBy("scraper").agg(n.alias("urls"), ok.alias("successful"), F.round(ok * 100.0 / n, 2).alias("success_pct"),
                                      F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.round(n / F.sum("seconds"), 6).alias("urls_per_second"))


def run_report(log: DataFrame) -> DataFrame:
    """Per source: stored, duplicate and failed rows, success and validation rates; one row for all sources."""
    stored, dup, bad = (F.count_if(F.col("status") == s) for s in ("success", "signup_page", "failed"))
    n = F.count("*")
    return (log.rollup("scraper").agg(n.alias("total"), stored.alias("stored"), dup.alias("duplicates"), bad.alias("failed"),
                                      F.round(stored / n, 6).alias("success_rate"), F.round((stored + dup) / n, 6).alias("validation_rate"))
            .withColumn("scraper", F.coalesce("scraper", F.lit("all"))))


def successful_sources(log: DataFrame) -> DataFrame:
    per = log.groupBy("scraper").agg(F.count_if(F.col("status") == "success").alias("ok"))
    return per.agg(F.count("*").alias("sources"), F.count_if(F.col("ok") > 0).alias("successful"))


def category_report(leads: DataFrame, column: str = "industry") -> DataFrame:
    """Categories by size with the share of rows and of contacts; the window runs over one row per category."""
    per = leads.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("n"), F.count_if(X.filled("email")).alias("with_email"), F.count_if(X.filled("phone")).alias("with_phone"))
    return per.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4)).orderBy(F.desc("n"), "category")


def samples(leads: DataFrame, column: str, n: int | None = None) -> DataFrame:
    w = Window.partitionBy(column).orderBy("id")
    return up_to(leads.withColumn("rank", F.row_number().over(w)), n)


def scrape_outcomes(log: DataFrame) -> DataFrame:
    return log.groupBy("scraper", "status").agg(F.count("*").alias("n"))


def enhancement_counts(leads: DataFrame) -> DataFrame:
    e, p = _some("emails"), _some("phone_numbers")
    return leads.agg(F.count_if(e | p).alias("enhanced"), F.count_if(e).alias("with_emails"), F.count_if(p).alias("with_phones"))


# Message words of each error kind, first match wins (fixed values).
ERROR_RULES = [("rate_limit", ["429", "rate limit"]), ("authentication_error", ["401", "unauthorized"]),
               ("blocked_profile", ["403", "forbidden"]), ("timeout", ["timeout", "timed out"]),
               ("network_error", ["connection", "network", "err_internet_disconnected", "err_name_not_resolved", "net::err_",
                                  "name not resolved"]), ("private_profile", ["private"])]
FINAL_ERRORS = ["private_profile", "blocked_profile"]


def error_type(message) -> Column:
    return X.first_rule(F.lower(X.col(message)), ERROR_RULES, F.lit("unknown"))


def error_stats(log: DataFrame) -> DataFrame:
    return (log.filter("message is not null").groupBy(error_type("message").alias("error_type")).agg(F.count("*").alias("n"))
            .withColumn("retryable", ~F.col("error_type").isin(FINAL_ERRORS)))


def source_registry(spark) -> DataFrame:
    return spark.createDataFrame(R.SOURCES, "name string, url_type string, site_filter string, description string")
