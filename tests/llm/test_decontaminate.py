"""Benchmark decontamination: templates, items of very different lengths, and recall against aligning all pairs."""

import random

import numpy as np

from contactmill.llm import decontaminate

WORDS = [f"w{i}" for i in range(3000)]
HEAD = "Please read the following passage with care and then answer the question below it in one word only"


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.op9_decontaminate(d, b).collect()}


def test_a_template_alone_is_no_item(spark):
    rng = random.Random(1)
    items = [(i, f"{HEAD}: item {i} {text(rng, 12)}") for i in range(400)]
    only = [(d, f"{text(rng, 40)} {HEAD}. {text(rng, 40)}") for d in range(50)]
    copies = [(100 + k, f"{text(rng, 30)} {items[k * 7][1]} {text(rng, 30)}") for k in range(20)]
    tails = [(200 + k, f"{text(rng, 30)} {items[k * 7][1].split(': ')[1]} {text(rng, 30)}") for k in range(20)]
    got = found(spark, only + copies + tails, items)
    assert set(got) == {(100 + k, k * 7) for k in range(20)} | {(200 + k, k * 7) for k in range(20)}
    assert all(s == 1.0 for s in got.values())


def test_items_of_shared_parts_only_are_found_whole(spark):
    rng = random.Random(2)
    parts = [text(rng, 15) for _ in range(6)]
    items = [(i * 6 + j, f"{parts[i]} {parts[j]}") for i in range(6) for j in range(6) if i != j] + [(100 + k, f"{parts[k % 6]} {text(rng, 4)}") for k in range(12)]
    docs = [(0, f"{text(rng, 20)} {parts[0]} {parts[1]} {text(rng, 20)}"), (1, text(rng, 60))]
    got = found(spark, docs, items)
    assert got[0, 1] == 1.0 and not any(d == 1 for d, _ in got)


def test_a_long_item_does_not_widen_the_others(spark):
    rng = random.Random(3)
    long = text(rng, 10_000)
    items = [(0, long)] + [(1 + i, text(rng, 20)) for i in range(20)]
    docs = [(i, f"{text(rng, 3000)} {items[1 + i][1]} {text(rng, 3000)}") for i in range(10)] + [(50, f"{text(rng, 100)} {' '.join(long.split()[4000:4400])} {text(rng, 100)}")]
    got = found(spark, docs, items)
    assert set(got) == {(i, 1 + i) for i in range(10)} | {(50, 0)}
    d = spark.createDataFrame([(i, i, t) for i, t in docs], "_row long, _id long, text string")
    b = spark.createDataFrame([(i, i, t) for i, t in items], "item long, item_id long, text string")
    seed, _ = decontaminate.seeds_and_own(b)
    sizes = {(r["_row"], r["cls"]): len(r["text"].split()) for r in decontaminate.passages(d, decontaminate.seed_tables(seed)).collect()}
    assert all(n < 400 for (row, cls), n in sizes.items() if cls == 0)


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [rng.choice(WORDS)] if x < 2 * rate / 3 else [w, rng.choice(WORDS)] if x < rate else [w]
    return out


def test_recall_against_aligning_all_pairs(spark):
    rng = random.Random(4)
    items = [(i, (f"{HEAD} " if i % 3 == 0 else "") + text(rng, rng.randrange(8, 60))) for i in range(60)]
    docs = []
    for d in range(120):
        own = items[d % 60][1].split()
        docs.append((d, " ".join([text(rng, rng.randrange(5, 80)), *edited(rng, own, rng.choice([0, 0.1, 0.2, 0.3])), text(rng, rng.randrange(5, 80))])))
    docs += [(200 + d, text(rng, 150)) for d in range(30)]
    got = found(spark, docs, items)
    # The same score over all pairs, without seeds.
    grams, shared = {}, {}
    for i, t in items:
        w = decontaminate.words(t)
        for p in range(len(w) - 2):
            grams.setdefault(tuple(w[p:p + 3]), set()).add(i)
    for i, t in items:
        w = decontaminate.words(t)
        shared[i] = [p for p in range(len(w) - 2) if len(grams[tuple(w[p:p + 3])]) > decontaminate.TEMPLATE]
    want = set()
    for d, t in docs:
        passage = decontaminate.words(t)
        pairs = [(decontaminate.words(x), passage, decontaminate.own_words(len(decontaminate.words(x)), shared[i])) for i, x in items]
        for (i, _), (a, _, own), (s, m) in zip(items, pairs, decontaminate.align(pairs)):
            if s >= decontaminate.THRESHOLD * 2 * own.sum() and m >= min(decontaminate.MIN_MATCHED, own.sum()):
                want.add((d, i))
    assert set(got) <= want and len(want) > 100
    assert len(set(got) & want) >= 0.97 * len(want)


def test_template_words_give_nothing_and_cost_nothing():
    item = "a b c d t1 t2 t3 t4 t5 t6 e f g h".split()
    own = np.array([w[0] != "t" for w in item])
    assert decontaminate.align([(item, "a b c d e f g h".split(), own)]) == [(16, 8)]
    assert decontaminate.align([(item, item, own)]) == [(16, 8)]
    assert decontaminate.align([(item, "t1 t2 t3 t4 t5 t6".split(), own)]) == [(0, 0)]
