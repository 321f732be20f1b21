"""Brute force, order and partition invariance, conservation and plan checks."""

import re

import pytest
from pyspark.sql import functions as F

from contactmill.functions import contact_rules as R
from contactmill.operators import contacts as C
from contactmill.operators import match as M
from contactmill.operators import merge as I
from contactmill.operators import urls as U
from contactmill.plans import lead_jobs as W
from contactmill.plans import load_all
from contactmill.plans.derived import as_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


NAMES = ["acme travel", "acme travels", "acme traveling", "blue harbour tours", "blue harbor tours", "tours blue harbour", "xyz", "xyzz", "abc",
         "north star coaches ltd", "north star coach ltd", "northstar coaches", "aaaaaaa", "aaaaaaaa", "aaaabaaa", "red bus", "red buses", "red busses"]


@pytest.mark.parametrize("percent,signature", [(85, 1), (85, 2), (85, 3), (80, 2)])
def test_similar_names_finds_every_pair(spark, percent, signature):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {(r.a, r.b, r.percent) for r in M.similar_names(df, percent, signature).collect()}
    pct = lambda a, b: round(200 * lcs(a, b) / (len(a) + len(b)))
    want = {(a, b, pct(a, b)) for a in NAMES for b in NAMES if a < b and pct(a, b) >= percent}
    assert got == want and want


def test_components_equal_union_find(spark):
    import random
    rnd = random.Random(7)
    pairs = [(i, f"k{rnd.randrange(120)}") for i in range(200) for _ in range(rnd.randrange(3))]
    pairs += [(i, f"chain{i}") for i in range(300, 360)] + [(i + 1, f"chain{i}") for i in range(300, 360)]
    pairs += [(i, "hot") for i in range(400, 700)]
    parent = {i: i for i, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    first = {}
    for i, k in sorted(pairs):
        a, b = find(i), find(first.setdefault(k, i))
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "id int, key string").repartition(5)
    assert {r.id: r.component for r in M.components(df).collect()} == {i: find(i) for i in parent}


def test_first_holders_is_order_and_partition_independent(spark):
    rows = [(i, i, [f"e:{i % 7}", f"p:{i % 11}"] if i % 3 else []) for i in range(60)]
    seen, want = set(), set()
    for i, _, keys in rows:
        if not any(k in seen for k in keys):
            want.add(i)
        seen |= set(keys)
    for parts in (1, 6):
        df = spark.createDataFrame(rows[::-1], "id int, ord int, keys array<string>").repartition(parts)
        assert {r.id for r in M.first_holders(df).collect()} == want


def brute_phones(text):
    kept, seen = [], []
    for p in R.PHONE_PATTERNS:
        for m in re.finditer(p, text, re.A):
            clean = re.sub(r"[^\d+]", "", m.group())
            bare = clean.lstrip("+").lstrip("0")
            ok = len(clean) >= 7 and 7 <= len(bare) <= 15 and clean.count("0") <= len(clean) * 0.7 and clean.count("1") <= len(clean) * 0.7
            near = lambda w: text[max(0, m.start() - w):m.end() + w].lower()
            bad = any(w in near(100) for w in R.NAVIGATION_WORDS) or re.match(r"^\d{4}$", m.group()) or (re.match(r"^\d{8,}$", m.group()) and "id" in near(100))
            if not ok or bad or any((clean in s or s in clean) and abs(len(s) - len(clean)) <= 2 for s in seen):
                continue
            kept.append((clean, round(0.7 + 0.15 * any(w in near(50) for w in R.PHONE_WORDS) + 0.1 * any(w in near(50) for w in R.MOBILE_WORDS), 6)))
            seen.append(clean)
    return sorted(kept)


def test_phones_equal_brute_force(spark, tables):
    texts = [r.text for r in tables.documents.select("text").collect()] + ["call +1 (415) 555-0199 or 415-555-0199", "card 4111 1111 1111 1111", "ip 192.168.100.200", "mobile 020 7946 0958"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", C.phones("text").alias("p")).collect()
    for r in rows:
        assert sorted((p["clean_value"], round(p["confidence"], 6)) for p in r.p) == brute_phones(texts[r.i]), r.i


def test_ingest_counts_conserve(spark, tables):
    u = tables.fx_urls
    r = U.ingest_counts(u, u.filter("id % 7 = 0")).first()
    assert r.total == r.new_urls + r.duplicates == u.count()


def test_dedupe_is_idempotent(spark, tables):
    from contactmill.plans.queries_match import run_input
    once = I.dedupe_stages(run_input(tables)).cache()
    again = I.dedupe_stages(once)
    assert again.count() == once.count() < run_input(tables).count()


def test_scores_stay_in_range(tables):
    r = W.extract_leads(tables.fx_rich).agg(F.min("score.total_score").alias("lo"), F.max("score.total_score").alias("hi")).first()
    assert 0 <= r.lo <= r.hi <= 100


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dup_unified", "dup_crawl", "dup_web", "dup_log", "similar_url_hint", "dedupe_exact", "merge_leads", "merge_contact_list",
                                  "duplicate_groups", "enrich_contacts", "url_ingest", "classification_lookup"])
def test_no_nested_loop_joins(spark, name):
    plan = plan_of(load_all()[name].run(spark, "/root/testdata/sf0.001"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_first_per_key_limits_before_the_shuffle(spark, tables):
    plan = plan_of(U.first_per_key(tables.fx_urls, ["url"], "id"))
    assert plan.count("WindowGroupLimit") == 2  # partial before the exchange, final after it


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    plan = plan_of(df.filter(F.col("c_custkey") == 5).select("c_name"))
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,5)]" in plan
