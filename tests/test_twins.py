"""Registered queries against their SQL twins on the smallest tables. CHECK_ALL=1 runs every query."""

import os

import pytest

from contactmill.plans import load_all
from oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"
QUICK = ["url_type", "url_ingest", "url_quota", "company_links", "directory_domains", "similar_url_hint", "html_text", "contact_patterns", "script_fields", "page_render_class",
         "extract_phones", "extract_emails", "raw_contact_scan", "lead_text_contacts", "company_name", "industry", "section_select", "lead_score", "quality_score", "dup_unified",
         "dup_crawl", "components", "dup_richest", "merge_contact_list", "unify_web", "unify_facebook", "leadgen_rows", "final_leads", "icp_stats", "field_stats", "text_search",
         "jsonld_person", "json_repair_split", "directory_listings", "parse_model_json", "validate_export", "apply_updates", "url_frontier_stream", "lead_upsert_stream", "request_sessions", "flagship"]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(load_all()) if os.environ.get("CHECK_ALL") else QUICK)
def test_twin(spark, con, name):
    ok, note = compare(spark, con, SMALL, load_all()[name])
    assert ok, note


def test_every_query_is_listed_once():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200
