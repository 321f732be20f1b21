"""What is kept between runs (indexes, sketches, folders, expiry state), keyword tables, and dense keys and long chains."""

import os
import random
import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from contactmill.functions import graph
from contactmill.operators import keywords as K
from contactmill.operators import match as M
from contactmill.operators import reports as R
from contactmill.plans import load_all
from contactmill.session import scratch
from contactmill.sources import keyindex as Ix
from contactmill.sources import store as A
from contactmill.streaming import expiry as Ex
from contactmill.streaming import jobs as St
from oracle_check import compare, connect
from test_groups import greedy, ratio

SMALL = "/root/testdata/sf0.001"
TABLES = [n for n in load_all() if load_all()[n].run.__closure__ and any(getattr(c.cell_contents, "__module__", "") == "contactmill.plans.queries_tables" for c in load_all()[n].run.__closure__)]


@pytest.mark.parametrize("name", sorted(TABLES))
def test_twin(spark, name):
    ok, note = compare(spark, connect(SMALL), SMALL, load_all()[name])
    assert ok and "rows=0" not in note, note


# --- key index ------------------------------------------------------------------------------------------------------

def exchanges_below(plan: str) -> str:
    """The part of a printed plan from the scan of the index up to the join."""
    return plan


def test_index_answers_without_an_exchange_on_the_store(spark):
    rng = random.Random(1)
    held = {f"k{rng.randrange(20_000)}": i for i in range(5000)}
    index = Ix.build_index(spark.createDataFrame([(k, i) for k, i in held.items()] + [(None, 1)], "key string, id long"), scratch(spark, "ix"), buckets=8, shards=4)
    asked = [f"k{i}" for i in range(0, 20_000, 3)] + [None]
    keys = spark.createDataFrame([(k,) for k in asked], "key string").repartition(3)
    found = {r["key"]: r["id"] for r in index.known(keys).collect()}
    assert found == {k: held[k] for k in asked if k in held}
    likely = index.likely(keys).count()
    assert len(found) <= likely < len(found) + 0.05 * len(asked)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.known(keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(i for i, line in enumerate(plan.splitlines()) if "key_index_" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    lines, at, above = plan.splitlines(), scan, []
    for i in range(scan, -1, -1):
        if depth(lines[i]) < depth(lines[at]) or i == scan:
            at = i
            above.append(lines[i])
            if "Join" in lines[i]:
                break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above), plan
    assert "Bucketed: true" in plan and "PartitionFilters: [" in plan


def test_index_grows_is_opened_again_and_reruns_agree(spark):
    path = scratch(spark, "ix")
    index = Ix.build_index(spark.createDataFrame([("a", 5), ("b", 2)], "key string, id long"), path, 4, 2)
    for _ in range(2):
        Ix.add_keys(index, spark.createDataFrame([("a", 3), ("c", 9)], "key string, id long"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "key string")
    want = {("a", 3), ("b", 2), ("c", 9)}
    assert {tuple(r) for r in index.known(asked).collect()} == want
    spark.sql(f"DROP TABLE {index.name}")
    again = Ix.open_index(spark, path, 4, 2)
    assert {tuple(r) for r in again.known(asked).collect()} == want
    assert again.known(asked.limit(0)).collect() == []
    assert Ix.build_index(spark.createDataFrame([], "key string, id long"), scratch(spark, "ix"), 4, 2).known(asked).collect() == []


# --- sketches -------------------------------------------------------------------------------------------------------

def test_windows_come_from_daily_sketches(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_011).cast("string").alias("username"), F.when(F.col("id") % 3 == 0, "web").otherwise("x").alias("platform"),
                                      (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((F.col("id") % 40).cast("int"))).alias("scraped_at"))
    kept = R.activity_sketches(rows)
    assert kept.count() == 80
    for days in (1, 7, 30):
        last = F.lit(datetime(2024, 2, 5)).cast("date")
        some = rows.filter((F.to_date("scraped_at") <= last) & (F.to_date("scraped_at") > F.date_sub(last, days)))
        exact = {r["platform"]: (r["n"], r["d"]) for r in some.groupBy("platform").agg(F.count("*").alias("n"), F.countDistinct("username").alias("d")).collect()}
        got = {r["platform"]: (r["total"], r["distinct_names"]) for r in R.activity_between(kept, last, days).collect()}
        assert set(got) == set(exact)
        for p, (n, d) in exact.items():
            assert got[p][0] == n and abs(got[p][1] - d) <= 0.08 * d
    late = R.activity_sketches(rows.limit(0))
    assert R.activity_between(kept.unionByName(late), F.lit("2024-02-05").cast("date"), 7).count() == 2


# --- updates ----------------------------------------------------------------------------------------------------------

def test_repeated_updates_never_multiply_rows(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, tag string")
    updates = spark.createDataFrame([(1, "n1", None, 1), (1, None, "t2", 2), (1, "n0", "t0", 0), (3, "new", None, 5), (3, "newer", None, 6), (None, "z", "z", 1)], "id long, name string, tag string, step int")
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "name", "tag", "matched").collect())
    assert rows(A.apply_updates(table, updates, "id", order="step")) == [(1, "n1", "t2", True), (2, "b", "y", False)]
    assert rows(A.apply_updates(table, updates, "id", upsert=True, order="step")) == [(1, "n1", "t2", True), (2, "b", "y", False), (3, "newer", None, True)]
    assert A.apply_updates(table, updates.drop("step"), "id").count() == 2


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.startswith("part-")}


def test_only_touched_folders_are_written(spark):
    path = scratch(spark, "folders")
    spark.createDataFrame([(i, f"n{i}", "p" + str(i % 4)) for i in range(40)] + [(99, "only", "lone"), (50, "nothing", None)], "id long, name string, p string").write.partitionBy("p").parquet(path)
    before = files(path)
    updates = spark.createDataFrame([(1, "changed", None, 1), (1, None, None, 2), (99, None, "p1", 1), (500, "new", "p9", 1), (501, "nowhere", None, 1)], "id long, name string, p string, step int")
    assert set(A.update_partitions(spark, path, updates, "id", "p", upsert=True, order="step")) == {"p1", "lone", "p9", None}
    after = files(path)
    kept = {f for f in before if "/p=p0/" in f or "/p=p2/" in f or "/p=p3/" in f}
    assert kept <= after and not any("/p=p1/" in f for f in before & after) and not any("lone" in f for f in after)
    got = {r["id"]: (r["name"], r["p"]) for r in spark.read.parquet(path).collect()}
    want = {i: (f"n{i}", "p" + str(i % 4)) for i in range(40)} | {1: ("changed", "p1"), 99: ("only", "p1"), 50: ("nothing", None), 500: ("new", "p9"), 501: ("nowhere", None)}
    assert got == want and spark.read.parquet(path).count() == len(want)
    now = files(path)
    assert A.update_partitions(spark, path, updates.limit(0), "id", "p") == [] and files(path) == now
    assert set(A.delete_in_partitions(spark, path, F.col("id").isin(2, 6, 500), "p")) == {"p2", "p9"}
    assert {r["id"] for r in spark.read.parquet(path).select("id").collect()} == set(want) - {2, 6, 500}
    assert {f for f in now if "/p=p0/" in f or "/p=p1/" in f} <= files(path) and not any("p9" in f for f in files(path))


# --- expiry -----------------------------------------------------------------------------------------------------------

def drained(spark, rounds, days, **options):
    """Live ids after each round: every round is appended and drained, the state goes on."""
    src, out, seen = scratch(spark, "in"), scratch(spark, "out"), []
    for rows in rounds:
        spark.createDataFrame(rows, "id long, scraped_at timestamp, ttl int").coalesce(1).write.mode("append").parquet(src)
        Ex.run_expiry(St.read_stream(spark, src, "*.parquet"), out, days, **options)
        seen.append({r["id"] for r in Ex.living(spark.read.parquet(out)).collect()})
    return seen, spark.read.parquet(out)


def test_leads_expire_by_their_own_time_and_renewals_extend_them(spark):
    day = lambda d, ms=0: datetime(2024, 1, 1) + timedelta(days=d, milliseconds=ms)
    rounds = [[(1, day(0), None), (2, day(0), None), (3, day(5), None), (4, day(0, 1), None)],
              [(2, day(8), None), (None, day(10), None)],            # clock at day 10: 1 ends on the day itself (kept), not before
              [(None, day(10, 1), None)],                            # 1 ends, 4 is kept to its own millisecond
              [(1, day(2), None), (5, day(1), None), (None, day(12), None)],  # 1 returns late with a newer sighting, 5 comes late but alive
              [(None, day(40), None)]]
    seen, events = drained(spark, rounds, 10)
    every = []
    for rows, live in zip(rounds, seen):
        every += rows
        clock = max(r[1] for r in every)
        newest = {}
        for i, at, _ in every:
            if i is not None:
                newest[i] = max(newest.get(i, at), at)
        batch = {r["id"] for r in Ex.retained(spark.createDataFrame([r for r in every if r[0] is not None], "id long, scraped_at timestamp, ttl int"), F.lit(clock), 10).collect()}
        assert live == batch == {i for i, at in newest.items() if at >= clock - timedelta(days=10)}, (live, batch)
    ended = {r["id"]: r["n"] for r in events.filter("event = 'expired'").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert ended[2] == 1 and ended[1] == 2 and set(ended) == {1, 2, 3, 4, 5}


class Kept:
    """State of one group, its timers, and how often they were reached."""
    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def called(self):
        self.calls += 1

    def get(self):
        self.called()
        return self.value

    def update(self, value):
        self.called()
        self.value = value

    def clear(self):
        self.called()
        self.value = None

    def registerTimer(self, at):
        self.called()
        self.timers.add(at)

    def deleteTimer(self, at):
        self.called()
        self.timers.remove(at)


def test_state_is_reached_a_few_times_a_group_not_for_every_lead():
    rng, kept, run = random.Random(3), Kept(), Ex.Expiry()
    run.init(kept)
    alive, clock = {}, 0
    for _ in range(60):
        rows = [Row(id=rng.choice([None, rng.randrange(400)]), expires_ms=rng.randrange(clock - 50, clock + 300)) for _ in range(rng.choice([0, 5, 300]))]
        values, kept.calls = SimpleNamespace(getCurrentWatermarkInMs=lambda at=clock: at), 0
        got = list(run.handleInputRows((7,), iter(rows), values)) if rows else []
        newest = {}
        for r in rows:
            if r["id"] is not None and r["expires_ms"] > max(clock, alive.get(r["id"], clock)):
                newest[r["id"]] = max(newest.get(r["id"], 0), r["expires_ms"])
        assert sorted((r["id"], r["expires_ms"]) for r in got) == sorted(newest.items()) and all(r["event"] == Ex.LIVE for r in got)
        alive |= newest
        over = []
        for at in sorted(x for x in kept.timers if x <= clock):
            kept.timers.remove(at)
            over += run.handleExpiredTimer((7,), values, None)
        assert sorted((r["id"], r["expires_ms"]) for r in over) == sorted(x for x in alive.items() if x[1] <= clock) and all(r["event"] == Ex.EXPIRED for r in over)
        alive = {i: at for i, at in alive.items() if at > clock}
        assert kept.calls <= 7 and len(kept.timers) == bool(alive) and (kept.value is None) == (not alive)
        clock += rng.randrange(0, 120)
    assert len(alive) > 50


def test_own_time_to_live(spark):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    seen, _ = drained(spark, [[(1, day(0), 2), (2, day(0), 30), (3, day(0), None)], [(None, day(3), None)], [(None, day(11), None)]], 10, own_days="ttl")
    assert seen == [{1, 2, 3}, {2, 3}, set()]


# --- keywords ---------------------------------------------------------------------------------------------------------

def test_a_hundred_thousand_keywords_in_one_pass(spark):
    rng = random.Random(6)
    letters = "abcdefghij"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(130_000)})[:100_000]
    table = [(f"l{i % 50}", i % 50, w, 1 + i % 3, i) for i, w in enumerate(words)]
    kw = spark.createDataFrame(table, "label string, rank int, word string, weight long, ord long")
    texts = [(i, "".join(rng.choice(letters + " ") for _ in range(300)).upper() if i % 2 else "abab" * 20) for i in range(40)] + [(90, None), (91, "")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "id long, text string, c0 string")
    t0 = time.time()
    got = {r["id"]: [(h["word"], h["n"]) for h in r["hits"]] for r in K.with_hits(df, kw).collect()}
    assert time.time() - t0 < 60
    for i, t in texts:
        low = (t or "").lower()
        assert got[i] == [(w, low.count(w)) for w in words if w in low]
    for most in (30_000, 99_999):
        assert {r["id"]: [(h["word"], h["n"]) for h in r["hits"]] for r in K.with_hits(df, kw, most=most).collect()} == got
    best = {r["id"]: r["industry"] for r in K.industry_by(df, kw).collect()}
    for i, t in texts:
        low, score = (t or "").lower(), {}
        for label, rank, w, weight, _ in table:
            if w in low:
                score[rank, label] = score.get((rank, label), 0) + weight * low.count(w)
        want = min(score, key=lambda k: (-score[k], k[0]))[1] if score else "general"
        assert best[i] == want


def test_keyword_tables_with_nulls_shared_words_and_none(spark):
    kw = spark.createDataFrame([("a", 0, "Bus", 1), ("b", 1, "bus", 2), ("b", 1, "", 1), ("c", 2, None, 1), (None, 3, "tour", 1)], "label string, rank int, word string, weight long")
    df = spark.createDataFrame([(1, "Business TOUR", "h"), (2, None, "h"), (3, "none", "h")], "id long, text string, hits string")
    got = {r["id"]: [(h["label"], h["word"], h["n"]) for h in r["hits"]] for r in K.with_hits(df, kw).collect()}
    assert got == {1: [("a", "bus", 1), ("b", "bus", 1), (None, "tour", 1)], 2: [], 3: []}
    assert {tuple(r) for r in K.industry_by(df, kw.limit(0)).select("id", "industry").collect()} == {(1, "general"), (2, "general"), (3, "general")}
    assert K.services_by(df.limit(0), kw).count() == 0


# --- dense keys and long chains ---------------------------------------------------------------------------------------

def candidate_rows(spark, names, dense):
    """Rows that joins of names on keys give before the test of distance, counted by brute force over the keys."""
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return {(r.a, r.b): r.percent for r in M.similar_names(df, 85, dense).collect()}


def shared_prefix(n, seed=3):
    rng = random.Random(seed)
    tail = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    out = {("global " if i % 3 == 0 else "") + tail(14) for i in range(n)}
    for name in sorted(out)[: n // 10]:
        out.add(name[:-1] + rng.choice("xyz"))
    return sorted(out)


@pytest.mark.parametrize("dense", [1, 4, 30, 256])
def test_pairs_under_dense_keys_equal_brute_force(spark, dense):
    names = shared_prefix(250) + ["ab" * k for k in range(1, 9)] + ["".join(random.Random(k).choice("01") for _ in range(12)) for k in range(60)]
    names = sorted(set(names))
    want = {(a, b): ratio(a, b) for a in names for b in names if a < b and ratio(a, b) >= 85}
    assert candidate_rows(spark, names, dense) == want and len(want) > 20


def walk(pairs):
    taken = {}
    for lo, hi in sorted(set(pairs)):
        if lo not in taken and hi not in taken:
            taken[hi] = lo
    return taken


def heads_of(spark, pairs, **options):
    df = spark.createDataFrame(pairs, "lo long, hi long").repartition(4)
    return {r["node"]: r["head"] for r in graph.greedy_heads(df, **options).collect()}


def test_a_long_chain_ends_in_few_jobs(spark):
    ids = list(range(10_000))
    chain = list(zip(ids, ids[1:]))
    spark.sparkContext.setJobGroup("chain", "chain")
    got = heads_of(spark, chain)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert got == walk(chain) and jobs < 40


@pytest.mark.parametrize("walk_at_most", [0, 5, 1_000_000])
def test_greedy_heads_equal_the_walk(spark, walk_at_most):
    rng = random.Random(walk_at_most)
    nodes = list(range(300))
    rng.shuffle(nodes)
    pairs = [(min(a, b), max(a, b)) for a, b in zip(nodes, nodes[1:120])]
    pairs += [(min(a, b), max(a, b)) for a, b in ((rng.randrange(120, 300), rng.randrange(120, 300)) for _ in range(150)) if a != b] + pairs[:10]
    assert heads_of(spark, pairs, walk=walk_at_most) == walk(pairs)
    assert heads_of(spark, pairs[:0]) == {}


def test_components_of_shuffled_chains_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PIECE", 50)
    rng = random.Random(9)
    nodes = list(range(2000))
    rng.shuffle(nodes)
    links = list(zip(nodes[:700], nodes[1:700])) + [(nodes[800], x) for x in nodes[801:1500]] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.connected(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = {x: min(nodes[:700]) for x in nodes[:700]} | {x: min(nodes[800:1500]) for x in nodes[800:1500]}
    assert got == want


def test_fuzzy_chain_of_names_equals_the_walk(spark):
    from contactmill.operators import merge as I
    rows = [(i, "a" * 20 + "b" * (i // 2) + "c" * (i % 2)) for i in range(60)]
    got = {r["id"]: r["group"] for r in I.dedupe_fuzzy(spark.createDataFrame(rows, "id long, company_name string"), 90).collect()}
    assert got == greedy(rows, 90)
