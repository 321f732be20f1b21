"""Merges and the dedupe stages against a sequential walk, and lists in long form under one very large group."""

import random
from datetime import datetime, timedelta
from statistics import median

from pyspark.sql import functions as F

from contactmill.operators import match as M
from contactmill.operators import merge as I
from contactmill.operators import scores as S
from test_groups import ratio

SCHEMA = "id long, email string, phone string, website string, company_name string, address string, industry string, score double, data_confidence double, scraped_at timestamp, services array<string>"
SHORT = dict(M.ADDRESS_SHORT)


def made(n=140, seed=7):
    rng = random.Random(seed)
    names = ["north travel ltd", "north travel limited", "south tours", "southern tours", "alpha bus co", "alpha bus company", "x", "", None, "Blue Harbour Trading"]
    places = ["12 High Street", "12 high st", "13 High Street", "Long Avenue 4", "long ave 4", None, "", "7 Old Road, Town", "7 old rd town"]
    maybe = lambda x: x if rng.random() < 0.7 else None
    return [(i, maybe(f"A{rng.randrange(40)}@x.example.org" if rng.random() < 0.5 else f"a{rng.randrange(40)}@x.example.org"), maybe(f"555-010-{rng.randrange(30):04d}"), maybe(rng.choice(["s1.org", "S1.org", "s2.org", ""])),
             rng.choice(names), rng.choice(places), maybe(rng.choice(["travel", "general", "bus"])), rng.choice([0.0, 10.0, 55.5, None]), rng.choice([0.4, 0.9, None]),
             rng.choice([None, datetime(2024, 1, 1) + timedelta(days=rng.randrange(40))]), rng.choice([None, [], ["tour"], ["bus", "tour", None], [f"s{rng.randrange(9)}"]])) for i in range(n)]


def filled(v):
    return v if v not in (None, "") else None


def merged(rows):
    """Leads of one group, in order, as one."""
    first = rows[0]
    out = [first[0]] + [next((filled(r[i]) for r in rows if filled(r[i]) is not None), None) for i in range(1, 7)]
    out += [max((r[i] for r in rows if r[i] is not None), default=None) for i in (7, 8, 9)]
    return (*out, list(dict.fromkeys(s for r in rows for s in (r[10] or []) if s is not None)))


def stage(rows, same):
    """Walk in order: a lead joins the first head that is the same, else it is a head."""
    heads = []
    for r in rows:
        h = next((h for h in heads if same(h[0], r)), None)
        h.append(r) if h else heads.append([r])
    return [merged(h) for h in heads], {r[0]: h[0][0] for h in heads for r in h}


def key(r):
    parts = [("email:" + r[1].strip().lower()) if (r[1] or "").strip() else None, ("phone:" + r[2].strip()) if (r[2] or "").strip() else None, ("website:" + r[3].strip().lower()) if (r[3] or "").strip() else None]
    return "|".join(p for p in parts if p)


def close(percent):
    return lambda a, b: a is not None and b is not None and (a == b or ratio(a, b) >= percent)


def name(r):
    n = (r[4] or "").strip().lower()
    return n if len(n) >= 3 else None


def stages(spark, rows):
    texts = {r[0]: r[1] for r in spark.createDataFrame([(i, p) for i, p in enumerate({r[5] for r in rows})], "i long, p string").select("p", M.normal_address("p")).collect()}
    number = lambda a: (a or "")[:len(a or "") - len((a or "").lstrip("0123456789"))]

    def same_place(a, b):
        x, y = filled(texts.get(a[5])), filled(texts.get(b[5]))
        return close(80)(x, y) and (x == y or not number(x) or not number(y) or number(x) == number(y))

    out, member = rows, {r[0]: r[0] for r in rows}
    for same in (lambda a, b: key(a) != "" and key(a) == key(b), lambda a, b: close(85)(name(a), name(b)), same_place):
        out, to = stage(out, same)
        member = {i: to[m] for i, m in member.items()}
    return out, member


def test_dedupe_stages_equal_a_walk(spark):
    rows = made()
    want, member = stages(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in I.dedupe_stages(df).select(*df.columns).collect())
    assert got == sorted(want) and 5 < len(want) < len(rows) - 20
    kept, members, values = I.dedupe_long(df)
    assert {r["id"]: r["survivor"] for r in members.collect()} == member
    assert sorted(tuple(r) for r in kept.select(*df.columns[:-1]).collect()) == sorted(w[:-1] for w in want)
    lists = {r["survivor"]: (r["n"], r["items"]) for r in I.arrays_of(values, "survivor").collect()}
    every = {}
    for r in rows:
        every.setdefault(member[r[0]], {}).update(dict.fromkeys(s for s in r[10] or [] if s is not None))
    assert lists == {i: (len(v), list(v)) for i, v in every.items() if v} and {i: sorted(v) for i, v in every.items() if v} == {w[0]: sorted(w[10]) for w in want if w[10]}


def test_quality_run_reads_contact_confidences(spark):
    rows = made(60, 3)
    want, member = stages(spark, rows)
    rng = random.Random(2)
    contacts = [(i, k, v, rng.choice([0.2, 0.5, 0.9, None]), i) for i, e, p, *_ in rows for k, v in (("email", e), ("phone", p)) if v and rng.random() < 0.8]
    cf = spark.createDataFrame(contacts, "id long, kind string, value string, confidence double, ord long")
    as_of = F.lit(datetime(2024, 3, 1))
    got = {r["id"]: r for r in I.quality_run(spark.createDataFrame(rows, SCHEMA), as_of, cf).collect()}
    plain = {r["id"]: r for r in I.quality_run(spark.createDataFrame(rows, SCHEMA), as_of).collect()}
    norm = lambda k, v: v.strip().lower() if k == "email" else "".join(c for c in v if c.isdigit())
    best = {}
    for i, k, v, c, _ in contacts:
        at = best.setdefault(member[i], {})
        at[k, norm(k, v)] = max(at.get((k, norm(k, v)), 0.0), c or 0.0)
    assert set(got) == {w[0] for w in want} == set(plain)
    for w in want:
        mean = sum(best[w[0]].values()) / len(best[w[0]]) if best.get(w[0]) else 0.0
        base = (w[8] or 0.0) * 0.7
        extra = (max(0.0, min(1.0, base + mean * 0.3)) - max(0.0, min(1.0, base))) * 15
        assert abs(got[w[0]]["quality"] - plain[w[0]]["quality"] - extra) < 1e-5
    assert any(got[i]["quality"] > plain[i]["quality"] + 1 for i in got)


def test_quality_of_survivors_is_that_of_the_merged_rows(spark):
    rows = made(80, 5)
    want, _ = stages(spark, rows)
    as_of = F.lit(datetime(2024, 3, 1))
    got = {r["id"]: (r["quality"], r["grade"]) for r in I.quality_run(spark.createDataFrame(rows, SCHEMA), as_of).collect()}
    done = spark.createDataFrame(want, SCHEMA)
    v = done.withColumn("v", S.validate_lead(F.array("email"), F.array("phone"), F.array("website"), "company_name", "industry"))
    v = v.withColumn("c", S.completeness("v.contact_valid", F.size("v.phones") > 0, F.coalesce(F.col("email") != "", F.lit(False)), "industry", "score", "company_name"))
    total = S.quality_total("c", S.accuracy(F.size("v.errors"), F.size("v.warnings"), "v.valid"), S.freshness("scraped_at", as_of), S.reliability("data_confidence", F.array().cast("array<double>")))
    assert got == {r["id"]: (r["q"], r["g"]) for r in v.select("id", F.round(total, 6).alias("q")).withColumn("g", S.grade("q")).collect()}


def test_a_group_with_a_third_of_the_leads_is_spread(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2000 + 1).alias("grp"),
                                    F.array(F.concat(F.lit("s"), (F.col("id") % 20_000).cast("string")), F.lit("all")).alias("services"), F.array(F.lit(None).cast("string")).alias("intents"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        long = I.merged_long(df, "grp", ["services", "intents"])
        sizes = [r["count"] for r in long.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) <= 2 * median(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    hub = long.filter("grp = 0")
    assert hub.filter("value = 'all'").select("first_id", "first_pos").first() == (0, 1) and hub.count() == 10_001
    read = {r["grp"]: (r["n"], r["items"]) for r in I.arrays_of(long, "grp", most=1000).filter("grp < 2").collect()}
    assert read[0] == (hub.count(), None) and read[1][1][:2] == ["s2000", "all"]


def test_metadata_lists_urls_up_to_a_bound(spark):
    df = spark.createDataFrame([(1, "a", 0.5, None), (1, "b", None, datetime(2024, 1, 2)), (1, "a", 0.1, None), (2, None, None, None)], "g long, url string, data_confidence double, scraped_at timestamp")
    got = {r["g"]: (r["n_urls"], r["first_url"], r["urls"]) for r in I.merge_metadata(df, "g").collect()}
    assert got == {1: (2, "a", ["a", "b"]), 2: (0, None, [])}
    assert {r["g"]: r["urls"] for r in I.merge_metadata(df, "g", most=1).collect()} == {1: None, 2: []}


def test_flat_export_of_any_number_of_keys(spark):
    from contactmill.sources import store as A
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.map_from_arrays(
        F.array(F.lit("email"), F.concat(F.lit("k"), F.col("id").cast("string")), F.concat(F.lit("j"), (F.col("id") * 7).cast("string"))), F.array(F.lit(0.5), F.col("id") / 1000.0, F.lit(0.25))).alias("confidence_scores"))
    flat = A.lead_flat(df, most=3)
    assert flat.columns == ["confidence_email", "confidence_j0", "confidence_j10003", "confidence_rest", "id"]
    rows = flat.select("id", "confidence_email", F.from_json("confidence_rest", "map<string,double>").alias("r"), "confidence_j0", "confidence_j10003").collect()
    for r in rows:
        i = int(r["id"])
        have = {k: v for k, v in {**(r["r"] or {}), "email": r["confidence_email"], "j0": r["confidence_j0"], "j10003": r["confidence_j10003"]}.items() if v is not None}
        assert have == {"email": 0.5, f"k{i}": i / 1000.0, f"j{i * 7}": 0.25}
    assert "confidence_rest" not in A.lead_flat(df.limit(2)).columns
