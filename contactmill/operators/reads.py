"""Filtered, sorted and paged reads. Sorts end in a unique key, so every page is reproducible; a sort with a limit runs
as a bounded top-k, not as a full sort."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions import text as X


def newest(leads: DataFrame, where: Column | None = None, skip: int = 0, limit: int | None = None, key: str = "url", after: tuple | None = None) -> DataFrame:
    """Newest rows first. ``after`` is (scraped_at, key) of the last row seen: the next page starts behind it, and a deep
    page costs no more than the first. ``skip`` counts rows instead, so it keeps skip + limit of them."""
    out = leads if where is None else leads.filter(where)
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        out = out.filter((F.col("scraped_at") < at) | ((F.col("scraped_at") == at) & (F.col(key) > last)))
    out = out.orderBy(F.desc("scraped_at"), key)
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit is not None else out


def search(leads: DataFrame, where: Column, limit: int, key: str = "url") -> DataFrame:
    return leads.filter(where).orderBy(key).limit(limit)


def search_all(tables: dict[str, DataFrame], where: Column, limit: int, key: str = "url") -> DataFrame:
    """The same filter on every table, at most ``limit`` rows of each, one result."""
    from contactmill.operators.reports import union_all
    rows = union_all([df.filter(where).withColumn("collection", F.lit(n)) for n, df in tables.items()])
    w = Window.partitionBy("collection").orderBy(key)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def all_urls(leads: DataFrame, *drop: str) -> DataFrame:
    return leads.drop(*drop).orderBy(F.desc("scraped_at"), "url")


def by_icp(leads: DataFrame, icp: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    return newest(leads, F.col("icp_identifier") == icp, skip, limit)


def recent(leads: DataFrame, as_of: Column, hours: int, limit: int | None = None) -> DataFrame:
    return newest(leads, F.col("scraped_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"), limit=limit)


def text_search(leads: DataFrame, pattern: str | None, fields: list[str], date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """Case-insensitive pattern in any field; the date range includes the whole last day and nothing after it."""
    out = leads
    if pattern:
        out = out.filter(X.any_of([F.coalesce(F.col(f).rlike("(?i)" + pattern), F.lit(False)) for f in fields]))
    if date_from:
        out = out.filter(F.col("scraped_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        out = out.filter(F.col("scraped_at") < F.lit(date_to + timedelta(days=1)).cast("timestamp"))
    return out


def filter_leads(leads: DataFrame, min_score: float | None = None, max_score: float | None = None, status: str | None = None,
                 industry: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    tests = [(min_score, lambda v: F.col("score") >= v), (max_score, lambda v: F.col("score") <= v), (status, lambda v: F.col("status") == v),
             (industry, lambda v: F.col("industry") == v), (since, lambda v: F.col("scraped_at") >= v), (until, lambda v: F.col("scraped_at") <= v)]
    for value, test in tests:
        if value is not None:
            leads = leads.filter(test(value))
    return leads


def get_lead(leads: DataFrame, lead_id) -> DataFrame:
    return leads.filter(F.col("id") == lead_id)
