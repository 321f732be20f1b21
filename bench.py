"""Times the headline queries; prints one JSON line.

Each query is collected through a no-op sink (every row and column is computed, nothing goes to the driver). The first
run warms code generation up; the figure is the median of the next runs.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contactmill.plans import load_all
from contactmill.session import local_session

HEADLINE = ["url_type", "url_ingest", "url_type_stats", "classification_lookup", "similar_url_hint", "html_text", "contact_patterns", "process_pages",
            "extract_phones", "extract_emails", "extract_web_social", "social_handles", "industry", "services", "intent_score", "section_select",
            "lead_score", "quality_score", "unify_web", "leadgen_rows", "final_leads", "dup_unified", "dup_crawl", "components", "dup_richest",
            "merge_leads", "merge_contact_list", "dedupe_exact", "duplicate_groups", "icp_stats", "field_stats", "run_report", "text_search",
            "unified_page", "request_sessions", "extract_leads", "process_leads", "flagship"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    entries, times = load_all(), {}
    for name in names:
        took = []
        for i in range(runs + 1):
            t = time.time()
            entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t)
        times[name] = round(statistics.median(took[1:]), 3)
        print(f"{name} {took}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "contact_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
