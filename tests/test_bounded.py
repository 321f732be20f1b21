"""Rows per task, memory per batch, and rewritten rules against what they replace."""

import itertools

import pytest
from pyspark.sql import functions as F

from contactmill.functions import business_rules as B
from contactmill.functions import contact_rules as R
from contactmill.functions import text as X
from contactmill.operators import business as E
from contactmill.operators import contacts as C
from contactmill.operators import html_blocks as H
from contactmill.operators import jsonld as L
from contactmill.operators import match as M
from contactmill.plans import derived


@pytest.fixture
def orders(spark, tmp_path):
    spark.range(1000).select((F.col("id") * 4).alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    return derived.Tables(spark, str(tmp_path))


def test_narrow_rows_are_dealt_to_tasks(orders, monkeypatch):
    monkeypatch.setattr(derived, "ROWS_A_TASK", 50)
    sizes = [r["n"] for r in orders.orders.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) < 100


def test_the_test_on_words_stays_above_the_dealing(orders):
    s = orders.sql("SELECT o_custkey AS page_id, o_orderkey AS pos, 'p' AS tag, '' AS class, '' AS id, concat('Call us at 415-555-', 1000 + o_orderkey) AS text FROM orders")
    plan = E.relevant_sections(s)._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("Repartition")
    assert "privacy policy" in plan[:at] and "privacy policy" not in plan[at:]


def test_blocks_come_in_bounded_pieces(spark, monkeypatch):
    html = "<div>" + "".join(f"<p class='c{i}'>paragraph number {i}</p>" for i in range(100)) + "</div>"
    pages = spark.createDataFrame([(i, html if i % 3 else None) for i in range(30)], "page_id long, html string")
    want = sorted(map(tuple, H.page_sections(pages).collect()))
    assert len(want) == 2000
    seen = H.page_sections(pages.coalesce(1))
    monkeypatch.setattr(H, "PIECE", 1000)
    assert sorted(map(tuple, H.page_sections(pages).collect())) == want
    assert sorted(map(tuple, seen.collect())) == want


ITEMS = ['{"@type":"Person","name":"a","author":{"name":"b","@type":"Person","x":1.50,"sameAs":["u",{"z":1,"a":2}]},"email":"","url":null}',
         '{"@type":"Organization","name":{"b":1,"a":[1.0,2e3]},"publisher":"p","keywords":[],"worksFor":{"name":null,"url":"q\\"r"}}',
         '{"@type":"Article","headline":7,"publisher":{},"description":"line\\nbreak \\u00e9","parentOrganization":[{"name":"n"}]}',
         '{"@type":"Article"}', '{"@type":"Other","name":"n"}', '{"@type":"Service","telephone":true,"author":{"legalName":{"k":"v"}}}']


def test_relevant_fields_as_read_one_by_one(spark):
    items = L.parsed(spark.createDataFrame([(i, "u", f'<script type="application/ld+json">{j}</script>') for i, j in enumerate(ITEMS)], "page_id long, url string, html string"))
    get = lambda p: F.get_json_object("json", f"$.{p}")
    nested = [F.when(get(f).startswith("{"), F.to_json(F.struct(*[get(f"{f}['{n}']" if n.startswith("@") else f"{f}.{n}").alias(n) for n in B.STRUCTURED_NESTED_FIELDS]))).alias(f)
              for f in B.STRUCTURED_NESTED]
    kept = F.to_json(F.struct(F.col("type").alias("@type"), *[get(f).alias(f) for f in B.STRUCTURED_FIELDS], *nested))
    want = items.filter(X.has_any("type", B.STRUCTURED_TYPES)).select("page_id", "pos", kept.alias("json")).filter(F.size(F.json_object_keys("json")) > 1)
    got = L.structured_relevant(items)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    assert got._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") < 10


def test_a_document_is_parsed_once_for_all_its_fields(spark):
    pages = spark.createDataFrame([(1, "u", f'<script type="application/ld+json">{ITEMS[0]}</script>')], "page_id long, url string, html string")
    plan = L.person(L.parsed(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tryParseJson") + plan.count("try_parse_json") + plan.count("parse_json") <= 3
    assert [r["name"] for r in L.person(L.parsed(pages)).collect()] == ["a"]


def test_leaves_of_json_that_is_none(spark):
    docs = spark.createDataFrame([(1, '{"a":[1,true,"x"],"b":null}'), (2, "no json"), (3, None), (4, "[]")], "id long, json string")
    got = {r["id"]: r["p"] for r in docs.select("id", L.json_paths("json").alias("p")).collect()}
    assert [tuple(x) for x in got[1]] == [("$.a[0]", "a", "number", "1"), ("$.a[1]", "a", "bool", "true"), ("$.a[2]", "a", "string", "x")]
    assert got[2] is None and got[3] is None and got[4] == []


def test_captions_without_ten_digits_are_not_searched(spark):
    texts = ["call 9876543210 now", "+1 (555) 123-4567", "1-555-123-4567x", "+49 1234 567 8901", "12 34 56", "a@b.org", "x a.b@c.de, d@e.com", "no at", None, "",
             "555.123.4567", "+1(555)1234567", "1234 567  8901", "123-456-7890-12", "٣٤٥٦٧٨٩٠١٢", "+12 345 678 9012 3456"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    old = [F.regexp_replace(X.extract("text", p, 0), r"[-.\s]+", "") for p in R.CAPTION_PHONES]
    want = F.coalesce(*[F.when(F.length(X.digits(v)).between(10, 15), v) for v in old])
    mail = X.extract("text", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,6}", 0)
    for r in df.select("text", C.caption_phone("text").alias("p"), want.alias("wp"), C.caption_email("text").alias("e"), mail.alias("we")).collect():
        assert (r["p"], r["e"]) == (r["wp"], r["we"]), r["text"]
    plan = df.select(C.caption_phone("text").alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert R.CAPTION_DIGITS in plan


def test_dense_names_meet_with_few_rows_on_one_side(spark):
    """Every pair of short names over a small alphabet, against all pairs."""
    names = ["".join(x) + "abcabcabcabc"[:n] for x in itertools.product("abc", repeat=3) for n in (5, 6, 9, 12)]
    df = spark.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    got = M.similar_names(df, 85, dense=2)
    want = {(a, b) for a, b in itertools.combinations(sorted(set(names)), 2) if round(200 * M._lcs(a, b) / (len(a) + len(b))) >= 85}
    rows = [(r["a"], r["b"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_grams_of_names_are_counted_in_their_row(spark):
    df = spark.createDataFrame([("aaab", 4, "", True), ("a", 1, "", True), ("ab", 2, None, True)], "name string, n int, within string, free boolean")
    got = {r["name"]: r["grams"] for r in M._with_grams(df).collect()}
    assert got == {"aaab": ["aa1\u0001", "aa2\u0001", "ab1\u0001"], "a": [], "ab": []}
