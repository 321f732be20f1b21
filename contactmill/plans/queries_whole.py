"""Whole results of the queries that are also registered with the limit of a page or a short form."""

from pyspark.sql import functions as F

from contactmill.functions import page_rules as R
from contactmill.operators import business as E
from contactmill.operators import html_blocks as H
from contactmill.operators import jsonld as L
from contactmill.operators import pages as P
from contactmill.operators import reads as K
from contactmill.operators import urls as U
from contactmill.plans.catalog import ENTRIES, query
from contactmill.plans.queries_business import SECTIONS
from contactmill.plans.queries_jobs import scratch
from contactmill.plans.queries_jsonld import ROWS, items
from contactmill.plans.queries_match import leads
from contactmill.plans.queries_reports import now
from contactmill.plans.queries_unify import unified_table
from contactmill.sources import store as A


def whole(name: str, of: str, limit: str):
    """Register the query ``of`` without its limit: the twin is the same text with ``limit`` taken out."""
    sql = ENTRIES[of].sql
    if limit not in sql:
        raise ValueError(f"{of} has no {limit!r}")
    return query(name, sql.replace(limit, ""))


@whole("export_search_all", "export_search", " ORDER BY url LIMIT 10000")
def export_search_all(t):
    path = scratch(t, "search")
    A.export_search(leads(t).select("url", "industry"), path, "json", "BUILD", ["industry"])
    return t.spark.read.json(path).select("url")


@whole("recent_all", "recent", " ORDER BY scraped_at DESC, url LIMIT 1000")
def recent_all(t):
    return K.recent(unified_table(t), now(), 48).select("url")


@whole("by_icp_all", "by_icp", " ORDER BY scraped_at DESC, url LIMIT 100")
def by_icp_all(t):
    return K.by_icp(unified_table(t), "icp_1").select("url")


@whole("directory_listings_all", "directory_listings", " WHERE rank <= 15")
def directory_listings_all(t):
    # A saved page holds the listings of one customer, a bounded list.
    blocks = t.sql(ROWS).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "block"))).alias("b"))
    pages = blocks.select("page_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("b", lambda x: x["block"]), ""), F.lit("</body></html>")).alias("html"))
    return H.directory_listings(pages).select("page_id", "rank", "name", F.array_join(F.filter("phone", lambda p: p.startswith("(")), ",").alias("phone"))


@whole("company_links_all", "company_links", "\nWHERE rank <= 15")
def company_links_all(t):
    return U.company_links(P.page_links(t.fx_rich))


@whole("same_host_links_all", "same_host_links", " WHERE rank <= 50")
def same_host_links_all(t):
    return U.same_host_links(P.page_links(t.fx_rich))


@whole("section_select_all", "section_select", " WHERE rank <= 20")
def section_select_all(t):
    return E.relevant_sections(t.sql(SECTIONS)).select("page_id", "pos", "priority_score", "rank")


@query("links_whole", ENTRIES["links_images"].sql.split("\nUNION ALL SELECT 'image'")[0].replace(" left(", " (").replace(", 200) AS text", ") AS text"))
def links_whole(t):
    return P.page_links(t.fx_rich, cut=None).select(F.lit("link").alias("kind"), "page_id", "pos", F.col("href").alias("target"), F.col("text").alias("label"))


@whole("page_keywords_whole", "page_keywords", "[1:10]")
def page_keywords_whole(t):
    txt, out = t.fx_rich.select("page_id", P.html_text("html").alias("text")), None
    for s in R.PAGE_KEYWORDS:
        one = P.page_keywords(txt, s, top=None).select(F.lit(s).alias("site"), "page_id", F.array_join("keywords", ",").alias("keywords"), "content_type", "summary")
        out = one if out is None else out.unionByName(one)
    return out


@query("structured_company_whole", ENTRIES["structured_company"].sql)
def structured_company_whole(t):
    return L.structured_company(items(t), cut=None)
