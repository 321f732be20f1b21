"""Duplicate groups against brute force, merged lists, and the largest task under a hot key."""

import random

from pyspark.sql import functions as F

from contactmill.functions.graph import connected, greedy_heads
from contactmill.functions.joins import hot_join
from contactmill.operators import match as M
from contactmill.operators import merge as I


def ratio(a, b):
    return round(200 * M._lcs(a, b) / (len(a) + len(b)))


def greedy(values, percent):
    """id -> head, walking the leads in order."""
    out, heads = {}, []
    for i, v in values:
        out[i] = next((h for h, w in heads if v and w and (v == w or ratio(v, w) >= percent)), i)
        if out[i] == i:
            heads.append((i, v))
    return out


def test_a_chain_is_not_carried_along(spark):
    names = [(1, "aaaaaaaaabc"), (2, "aaaaaaaaabcdd"), (3, "aaaaaaaaabcddee")]
    df = spark.createDataFrame(names, "id long, company_name string")
    got = {r["id"]: r["group"] for r in I.dedupe_fuzzy(df, 90).collect()}
    assert ratio(names[0][1], names[1][1]) >= 90 and ratio(names[1][1], names[2][1]) >= 90 and ratio(names[0][1], names[2][1]) < 90
    assert got == {1: 1, 2: 1, 3: 3}


def test_fuzzy_groups_equal_a_walk_over_all_leads(spark):
    rng = random.Random(5)
    words = ["north", "south", "travel", "tours", "agency", "ltd", "limited", "group"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(120)] + [(500, None), (501, ""), (502, "ab"), (503, "ab")]
    got = {r["id"]: r["group"] for r in I.dedupe_fuzzy(spark.createDataFrame(rows, "id long, company_name string"), 85).collect()}
    want = greedy([(i, v if v and len(v) >= 3 else None) for i, v in rows], 85)
    assert got == want


def test_addresses_of_any_length_pair(spark):
    texts = ["ab", "abc", "acb", "a", "abcd", "12 high st", "12 high street", "13 high st", "bca", "abd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, address string")
    got = {(r["a"], r["b"]) for r in M.similar_address_pairs(df, 80).collect()}
    norm = sorted({r[0] for r in df.select(M.normal_address("address")).collect()})
    number = lambda s: (lambda d: d[0] if d and d[0] else None)([s[:len(s) - len(s.lstrip("0123456789"))]])
    want = {(a, b) for a in norm for b in norm if a < b and ratio(a, b) >= 80 and (number(a) == number(b) or not number(a) or not number(b))}
    assert got == want and ("ab", "abc") in got and ("ab", "acb") in got


def test_survivors_keep_the_lists_of_all(spark):
    df = spark.createDataFrame([(1, 1, "x", ["111"], ["tour"]), (2, 1, None, ["222", "111"], ["bus", None]), (3, 3, "z", None, [])],
                               "id long, group long, name string, phones array<string>, services array<string>")
    got = {r["id"]: r for r in I.survivors(df).collect()}
    assert got[1]["phones"] == ["111", "222"] and got[1]["services"] == ["tour", "bus"] and got[1]["name"] == "x"
    assert got[3]["phones"] == [] and got[3]["services"] == []


def test_components_and_heads_equal_brute_force(spark):
    rng = random.Random(3)
    links = [(a, a + rng.randint(1, 9)) for a in range(60) if rng.random() < 0.7] + [(i, i + 1) for i in range(200, 260)]
    df = spark.createDataFrame(links, "a long, b long")
    root = {n: n for e in links for n in e}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["root"] for r in connected(df).collect()} == root
    heads, want = set(), {}
    for n in sorted(root):
        own = [a for a, b in links if b == n and a in heads]
        if own:
            want[n] = min(own)
        else:
            heads.add(n)
    assert {r["node"]: r["head"] for r in greedy_heads(df.toDF("lo", "hi")).collect()} == want


def test_a_hot_and_a_null_key_are_split(spark):
    n = 300_000
    left = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hub").when(F.col("id") % 3 == 1, None).otherwise(F.col("id").cast("string")).alias("key"))
    right = left.filter("key is not null").groupBy("key").agg(F.min("id").alias("first"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        out = hot_join(left, right, "key", "id")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) < n / 8
        assert out.filter("key = 'hub' and first = 0").count() == n / 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_upsert_in_many_batches_reads_only_the_buckets_it_needs(spark, tmp_path):
    from contactmill.streaming import jobs as St
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    rows = [(i, i, [f"m{i % 7}@x.org"] if i % 3 else [], [], f"N{i % 5}", "u", "c", "t") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ord long, emails array<string>, phones array<string>, full_name string, url string, company_name string, content_type string")
    for k in range(4):
        df.filter(f"id div 10 = {k}").coalesce(1).write.mode("append").parquet(src)
    St.lead_upsert(St.read_stream(spark, src, "*.parquet", max_files=1), store)
    got = {r["id"] for r in spark.read.parquet(store).select("id").collect()}
    seen, want = set(), set()
    for i, _, mails, *_ in rows:
        key = mails[0] if mails else f"f{i % 5}"
        if key not in seen:
            want.add(i)
        seen.add(key)
    assert got == want and len(list((tmp_path / "store").glob("batch=*"))) == 4
