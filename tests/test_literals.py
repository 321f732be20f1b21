"""Small literal cases with expected values worked out by hand from the rules."""

import math

import pytest
from pyspark.sql import functions as F

from contactmill.functions import text as X
from contactmill.operators import business as E
from contactmill.operators import contacts as C
from contactmill.operators import match as M
from contactmill.operators import pages as P
from contactmill.operators import reports as J
from contactmill.operators import scores as S
from contactmill.operators import unify as G
from contactmill.operators import urls as U


def check(spark, column, rule, cases):
    """All cases of one rule in one job."""
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], f"i int, {column} string")
    got = {r["i"]: r["r"] for r in rows.select("i", rule().alias("r")).collect()}
    for i, (value, want) in enumerate(cases):
        assert got[i] == want, (value, got[i], want)


def test_url_valid(spark):
    check(spark, "url", lambda: U.url_valid("url"), [
        ("ftp://a.com", False), ("http://localhost:80/x", True), ("https://a.com/" + "x" * 1990, False), ("https://a.com", True), (None, False)])


def test_url_type_and_bucket(spark):
    check(spark, "url", lambda: U.url_type("url"), [
        ("https://m.facebook.com/x", "facebook"), ("https://notfacebook.com", "general"), ("https://x.com/a", "twitter"),
        ("https://yelp.com/biz/a", "company_directory"), ("https://youtu.be/a", "general"), ("", "general")])
    check(spark, "url", lambda: U.url_bucket("url"), [("https://youtu.be/a", "youtube"), ("https://notfacebook.com", "facebook")])


def test_linkedin_rules(spark):
    check(spark, "url", lambda: U.linkedin_url_keep("url"), [
        ("https://www.linkedin.com/in/user-1/?x=1", True), ("https://in.linkedin.com/company/a", True),
        ("https://www.linkedin.com/jobs/view/1", False), ("https://www.linkedin.com/", False), ("https://help.linkedin.com/in/a", False)])
    check(spark, "url", lambda: U.linkedin_url_type("url"), [
        ("https://www.linkedin.com/in/a", "profile"), ("https://www.linkedin.com/company/a", "company"),
        ("https://www.linkedin.com/posts/a-activity-1-b", "post"), ("https://www.linkedin.com/newsletters/n-1", "newsletter"), ("https://a.com", "unknown")])


def test_instagram_content_type(spark, one):
    check(spark, "url", lambda: U.instagram_content_type("url"), [
        ("https://www.instagram.com/reel/A/", "video"), ("https://www.instagram.com/p/A/", "article"),
        ("https://www.instagram.com/name.x_1/", "profile"), ("https://www.instagram.com/explore/tags/", "unknown")])
    assert one({"url": "https://www.instagram.com/p/A/", "v": True}, lambda: U.instagram_content_type("url", "v")) == "video"


def test_classification_lookup(spark):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    urls = spark.createDataFrame([(1, "a"), (2, "b")], "id int, url string")
    cache = (spark.createDataFrame([("a", "static", 0.9, False, "2024-01-08 00:00:00"), ("b", "static", 0.9, False, "2024-01-02 11:00:00")],
                                   "url string, classification string, confidence double, is_override boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp")))
    assert [(r.id, r.confidence) for r in U.classification_lookup(urls, cache, now).collect()] == [(1, 0.86436)]


def test_contact_rules(spark):
    check(spark, "e", lambda: C.email_role("e"), [("hello@x.com", "contact"), ("Support1@x.com", "support"), ("jane@x.com", "personal"), ("hillary@x.com", "contact")])
    check(spark, "e", lambda: C.strict_email("e"), [("logo@2x.png", False), ("a@example.com", False), ("jane@firm.org", True)])
    check(spark, "p", lambda: C.strict_phone("p"), [("1700000000", False), ("5555555", False), ("0123456789", False), ("415-555-0199", True)])
    check(spark, "p", lambda: C.nanp_phone_valid("p"), [("(415) 555-0199", True), ("2025550199", False), ("123-456-7890", False)])


def test_caption_contacts(spark):
    check(spark, "t", lambda: C.caption_phone("t"), [
        ("call 9876543210 now", "9876543210"), ("+1 (415) 555-0199", "+1(415)5550199"), ("no 12345", None), ("id 98765432101234567", None)])
    check(spark, "t", lambda: C.caption_email("t"), [("mail me a.b@firm.travel!", "a.b@firm.travel"), ("none", None)])


def test_authority(spark):
    check(spark, "t", lambda: E.authority_score("t"), [
        ("CEO", 1.0), ("Vice President", 1.0), ("Marketing Director", 0.9), ("Team Lead", 0.7), ("Analyst", 0.3), ("Dean", 0.6), ("Driver", 0.2), ("", 0.0)])


def test_people(spark):
    text = "Intro.\n\nAbout us: Anna Berg, Managing Director. Omar Diaz - Analyst.\n\nThe end"
    row = spark.createDataFrame([(1, text, "")], "page_id int, text string, html string")
    got = {(p["name"], p["authority_score"]) for p in E.people(row).first()["people"]}
    assert ("Anna Berg", 0.9) in got
    lone = spark.createDataFrame([(1, "The shop was founded by Maria Rossi.", "")], "page_id int, text string, html string")
    assert [p["title"] for p in E.people(lone).first()["people"]][:1] == ["Founder"]


def test_classes_and_grades(spark):
    rows = spark.createDataFrame([(80.0,), (79.9,), (60.0,), (40.0,), (39.9,), (90.0,), (59.9,)], "s double")
    got = [(r.c, r.g) for r in rows.select(S.lead_class("s").alias("c"), S.grade("s").alias("g")).collect()]
    assert [c for c, _ in got[:5]] == ["hot", "warm", "warm", "cold", "research"] and got[5][1] == "A" and got[6][1] == "F"


def test_confidence_and_freshness(spark):
    r = spark.range(1).select(
        S.composite_confidence(F.array(F.lit(0.95), F.lit(0.9), F.lit(0.7))).alias("a"), S.composite_confidence(F.array(F.lit(0.7))).alias("b"),
        S.freshness(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-01")).alias("f0"), S.freshness(F.lit("2023-01-01").cast("timestamp"), F.lit("2024-01-01")).alias("f1"),
        S.freshness(F.lit(None).cast("timestamp"), F.lit("2024-01-01")).alias("f2")).first()
    assert r.a == 1.0 and round(r.b, 6) == 0.6 and r.f0 == 1.0 and math.isclose(r.f1, math.exp(-1)) and r.f2 == 0.5


def test_counts_as_labels(spark):
    check(spark, "n", lambda: X.short_count_trimmed("n"), [("16000", "16K"), ("1234567", "1.2M"), ("999", "999"), ("many", "many"), ("", None)])
    check(spark, "n", lambda: X.short_count("n"), [("16000", "16.0K"), ("1,234", "1.2K"), ("5.1K", "5.1K"), ("2000000000", "2.0B")])


def test_address_normal_form(spark):
    check(spark, "a", lambda: M.normal_address("a"), [("12 Main Street, Springfield", "12 main st springfield"), ("12 main st. springfield", "12 main st springfield")])


def test_error_types(spark):
    check(spark, "m", lambda: J.error_type("m"), [
        ("HTTP 429 Too Many Requests", "rate_limit"), ("HTTP 401 Unauthorized", "authentication_error"), ("HTTP 403 Forbidden", "blocked_profile"),
        ("Connection timeout", "timeout"), ("Network error", "network_error"), ("Profile is private", "private_profile"), ("odd", "unknown")])


def test_field_stats_counts_blank_as_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",)], "f string")
    r = J.field_stats(df, ["f"]).first()
    assert (r["total"], r["non_null"], r["empty"]) == (3, 1, 2)


def unified_row(spark, emails, author):
    return spark.range(1).select(*G.unified(F.lit("u"), "web", "profile", emails=F.array(*[F.lit(e) for e in emails]), content={"author_name": author}))


def test_unified_valid(spark):
    assert unified_row(spark, [" "], "").filter(G.unified_valid()).count() == 0
    assert unified_row(spark, [" "], "Ann").filter(G.unified_valid()).count() == 1


def raw_web(spark, emails, phones):
    from contactmill import schemas
    row = ("1", "https://a", "Pat", "Biz", emails, phones, None, None, "x", None, [], 1.0, "2024-01-01T00:00:00Z", None)
    return spark.createDataFrame([row], schemas.WEB_RAW)


def test_leadgen_rows(spark):
    at = F.lit("2024-02-01").cast("timestamp")
    mail = G.leadgen_rows(raw_web(spark, ["a@x.org", "b@x.org"], ["1"]), at).collect()
    assert [(r["Email Address"], r["primary_contact_type"]) for r in mail] == [("a@x.org", "email"), ("b@x.org", "email")]
    tel = G.leadgen_rows(raw_web(spark, [], ["1", "2"]), at).collect()
    assert [(r["Phone Number"], r["primary_contact_type"]) for r in tel] == [("1", "phone"), ("2", "phone")]


def test_dup_rules_differ_without_contacts(spark):
    kind = "id int, ord int, emails array<string>, phones array<string>, full_name string, url string, company_name string, content_type string"
    stored = spark.createDataFrame([(1, 1, ["a@x.org"], [], "Ann", "u", "C", "p")], kind)
    fresh = spark.createDataFrame([(2, 2, [], [], "ann", "u", "C", "p")], kind)
    assert [r.id for r in M.dup_unified(fresh, stored).collect()] == [2]
    assert [r.id for r in M.dup_crawl(fresh, stored).collect()] == [2]  # stays: the stored row has contacts


def test_exact_key_needs_the_whole_key(spark):
    from contactmill.operators import merge as I
    df = spark.createDataFrame([(1, "a@x.org", "1", None), (2, "a@x.org", "2", None), (3, None, None, None), (4, "A@x.org", "1", None)], "id int, email string, phone string, website string")
    assert {r.id: r.group for r in I.dedupe_exact(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}


def test_jsonld_filter(spark):
    from contactmill.operators import jsonld as L
    doc = ('{"@context":"x","@type":"Article","headline":"A headline here","identifier":"267","thumbnailUrl":"https://t","datePublished":"2025-05-29",'
           '"publisher":{"@type":"Organization","name":"Paper","logo":{"url":"https://l"}},"author":{"jobTitle":"Writer","name":"T K"}}')
    rows = L.jsonld_filter(spark.createDataFrame([(1, 0, doc)], "page_id int, pos int, json string")).collect()
    paths = {r["path"] for r in rows}
    assert {"$.headline", "$.publisher.name", "$.author.jobTitle"} <= paths
    assert not any("logo" in p or "identifier" in p or "date" in p.lower() or "thumb" in p for p in paths)


def test_html_text(spark):
    html = "<html><script>var a='</p>'</script><p>One &amp; two</p><!-- no --><b>three</b></html>"
    assert spark.createDataFrame([(html,)], "h string").select(P.html_text("h")).first()[0] == "One & two\nthree"
