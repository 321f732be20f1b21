"""Operators that SQL cannot say, against a plain walk over the same rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contactmill.functions import contact_rules as R
from contactmill.operators import html_blocks as H
from contactmill.operators import jsonld as L
from contactmill.operators import unify as G
from contactmill.plans import lead_jobs as W
from contactmill.plans import load_all
from contactmill.plans.derived import as_of
from contactmill.plans.queries_unify import web_raw

SMALL = "/root/testdata/sf0.001"


def test_caption_contacts(spark):
    rng = random.Random(3)
    parts = ["9876543210", "+1 (415) 555-0100", "415-555-0100", "+44 2079 460 958", "12", "0", "x", " ", "a.b@firm.example.org", "@", ".", "-", "+", "é", "7", "b@c.museum1", "555 0100 222"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(600)] + [None, ""]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]

    def phone(t):
        for p in R.CAPTION_PHONES:
            m = re.search(p, t, re.A)
            v = re.sub(r"[-.\s]+", "", m.group(), flags=re.A) if m else ""
            if 10 <= len(re.sub(r"[^0-9]", "", v)) <= 15:
                return v
        return None

    def mail(t):
        m = re.search(R.CAPTION_EMAIL, t)
        return m.group() if m else None

    from contactmill.operators import contacts as C
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", C.caption_email("text").alias("e"), C.caption_phone("text").alias("p"))
    got = {r["id"]: (r["e"], r["p"]) for r in df.collect()}
    want = {i: (mail(t or ""), phone(t or "")) for i, t in enumerate(texts)}
    assert got == want and sum(v[1] is not None for v in want.values()) > 50


def test_people_of_the_saved_pages(spark):
    got = sorted(tuple(r) for r in load_all()["people"].run(spark, SMALL).collect())
    ids = [r[0] for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id").collect()]
    want = [(i, n, t, s, k) for i in ids if i % 4 == 0 for n, t, s, k in (("Anna Berg", "Managing Director", 0.9, "decision_maker"), ("Omar Diaz", "Analyst", 0.3, "staff"))]
    assert got == sorted(want)


TOKEN = re.compile(r"<(/?)([a-z0-9]+)[^>]*>|([^<]+)")


def sections(page):
    """Blocks of well-formed markup: text of an element is that of all elements inside, piece by piece."""
    out, stack, hidden = [], [], 0
    for close, tag, text in TOKEN.findall(page):
        if text:
            if text.strip() and not hidden:
                for n in stack:
                    n["text"] += text.strip()
        elif close:
            hidden -= tag in ("script", "style", "noscript")
            stack.pop()
        elif tag not in H.VOID:
            hidden += tag in ("script", "style", "noscript")
            n = {"tag": tag, "text": "", "parent": stack[-1]["tag"] if stack else ""}
            stack.append(n)
            if tag in H.R.SECTION_TAGS:
                out.append(n)
    return [(i, n["tag"], n["text"], n["parent"]) for i, n in enumerate(out) if len(n["text"]) > 7]


def made_page(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice(["div", "p", "li", "ul", "h2", "a", "span", "footer", "td", "section", "script"])
        inner = rng.choice(["short", "a longer text", " ", "x", "some words here"]) + (made_page(rng, depth + 1) if depth < 4 and tag != "script" and rng.random() < 0.6 else "")
        out += f"<{tag}>{inner}</{tag}>" + rng.choice(["", " tail ", "<br>"])
    return out


def test_page_sections(spark):
    rng = random.Random(4)
    pages = [(i, made_page(rng)) for i in range(80)]
    df = spark.createDataFrame([*pages, (900, None), (901, "")], "page_id long, html string").repartition(3)
    got = sorted((r["page_id"], r["pos"], r["tag"], r["text"], r["parent_tag"]) for r in H.page_sections(df).collect())
    assert got == sorted((i, *s) for i, p in pages for s in sections(p)) and len(got) > 200


def test_leads_of_an_extraction(spark):
    ext = W.extract_leads(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")).cache()
    rows = {r["source_url"]: r for r in G.lead_from_extraction(ext).collect()}
    for e in ext.collect():
        lead = rows[e["url"]]
        assert lead["email"] == [x["value"] for x in e["emails"]] and lead["phone"] == [x["value"] for x in e["phones"]]
        assert lead["contact_person"] == [x["name"] for x in e["people"]] and lead["lead_score"] == e["score"]["total_score"]
        assert set(lead["confidence_scores"]) == {k for k, f in (("email", "emails"), ("phone", "phones"), ("address", "addresses"), ("website", "websites")) if e[f]}


def test_process_leads_and_counters(spark, tables):
    """Every group of rows linked by e-mail or phone gives its richest row; counters agree."""
    raw = web_raw(tables)
    rows = [r.asDict() for r in G.leadgen_rows(raw.filter(G.has_contact()), as_of()).collect()]
    skip = ("_id", "original_web_lead_id", "processed_at", "primary_contact_type")
    named = []
    for r in rows:
        keys = {(k, r[c].strip()) for k, c in (("e", "Email Address"), ("p", "Phone Number")) if (r[c] or "").strip()}
        ident = ":".join(str(x) for x in (r["original_web_lead_id"], r["Email Address"], r["Phone Number"]) if x is not None)
        rich = sum(1 for c, v in r.items() if c not in skip and v is not None and (v.strip() != "" if isinstance(v, str) else v != 0 if isinstance(v, (int, float)) else not isinstance(v, list) and bool(v)))
        named.append((ident, rich, keys, r["primary_contact_type"]))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for ident, _, keys, _ in named:
        for k in keys:
            parent[root(k)] = root(ident)
    groups = {}
    for n in named:
        groups.setdefault(root(n[0]), []).append(n)
    best = {min(g, key=lambda n: (-n[1], n[0]))[0]: (len(g), min(g, key=lambda n: (-n[1], n[0]))[3]) for g in groups.values()}
    done = W.process_leads(raw, as_of())
    got = {r["id"]: (r["group_size"], r["primary_contact_type"]) for r in done.select("id", "group_size", "primary_contact_type").collect()}
    assert got == best and len(best) < len(rows)
    counters = W.process_counters(raw, G.leadgen_rows(raw.filter(G.has_contact()), as_of()), done).first().asDict()
    kinds = [k for _, k in best.values()]
    assert counters == {"total": raw.count(), "filtered": raw.filter(G.has_contact()).count(), "extracted": len(rows), "inserted": len(best),
                        "email_based": kinds.count("email"), "phone_based": kinds.count("phone")}


@pytest.mark.parametrize("depth", [None, 0, 2])
def test_variant_leaves_equal_the_walk(spark, depth):
    docs = ['{"a":[1,{"b":"x","c":[[true,false],null]}],"d":{"e":{"f":{"g":"deep"}}},"h":-2.5,"é":"ü","k z":"","n":null}', "[]", "{}", '"text"', "7", "null", "not json", None, '[[["a"],["b"]],{"x":[]}]', "[1,2,[3]]"]
    items = spark.createDataFrame([(i, 0, d) for i, d in enumerate(docs)], "page_id long, pos int, json string")
    rows = lambda df: sorted(tuple(r) for r in df.select("page_id", "path", "key", "kind", "value").collect())
    got = rows(L.variant_rows(items, depth))
    assert got == rows(L.path_rows(items, depth)) and (depth == 0 or len(got) > 8)
    assert "Python" not in L.variant_rows(items, depth)._jdf.queryExecution().executedPlan().toString()
    assert L.variant_rows(items.filter(F.lit(False)), depth).count() == 0
