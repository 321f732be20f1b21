"""The training-data operators against brute force, and on nulls, empties, ties, repeats, long texts and odd columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from contactmill.llm import boosting, decontaminate, langid, maintext, mixing, pii, quality, simhash, tokens, toxicity, urltree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies long, _fp string, key string, score string, _row int, `_h` int"
WORDS = "the of and a to in is that for it was on are as with his they at be this from have or by one had not but what all were".split()


def sentence(rng, n=40):
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(60):
        out.append((i, sentence(rng), rng.choice(["en", "xx"]), rng.choice(["a", "b", None]), 1, 1, 1, "f", "k", "s", 1, 1))
    copy = list(out[3])
    copy[0] = 70
    near = list(out[4])
    near[0], near[1] = 71, out[4][1] + " tail"
    extra = [None, "", " \n\t ", "x", "word " * 30_000, "a" * 200_000, "é😀\x00 ok", "12345 +- @ 1.2.3.4"]
    out += [tuple(copy), tuple(near)] + [(80 + i, t, None, "a", None, None, None, None, None, None, None, None) for i, t in enumerate(extra)]
    out += [out[5], out[5], (None, sentence(rng), "en", "b", 1, 1, 1, "f", "k", "s", 1, 1), (None, None, None, None, *[None] * 8)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(60)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def ids(df, column="doc_id"):
    return sorted((r[column] is None, r[column] or 0) for r in df.select(column).collect())


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- 10: mixing ---------------------------------------------------------------------------------------------------

def fill(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        rate = left / max(1e-12, sum(w[s] for s in free)) if free else 0
        over = [s for s in free if w[s] * rate > 2 * sizes[s] + 1e-9]
        if not over:
            return {**out, **{s: w[s] * rate for s in free}}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)


def test_mix_meets_targets(docs, rows):
    got = mixing.op10_mixing(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want = fill(sizes)
    targets = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert targets == {(sizes[s], round(t, 6)) for s, t in want.items()}
    for s in sizes:
        own = [r for r in got if r["source_size"] == sizes[s]]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op10_mixing(docs.repartition(7)).collect()))


def test_mix_emits_every_copy_with_all_columns(docs, none):
    taken = sum(r["taken"] for r in mixing.op10_mixing(docs).collect())
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy_no"]
    assert sum(len(words(r["text"])) for r in out.collect()) == taken
    assert mixing.mix(none).count() == 0 and mixing.op10_mixing(none).count() == 0


def test_many_sources_fill_as_the_loop_does(spark):
    rng = random.Random(2)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 3000]) for i in range(70)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = fill(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


# --- 7: quality ---------------------------------------------------------------------------------------------------

def measured(t):
    w, win, hit = words(t), {}, set()
    for i in range(len(w) - 4):
        win.setdefault(tuple(w[i:i + 5]), []).append(i)
    for at in win.values():
        if len(at) > 1:
            for i in at:
                hit.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_equal_brute_force(spark, docs, rows, none):
    texts = ["a b c d e a b c d e", "x\nx\n \ny", "a a a a a a a", "# $ a|b", "a b c d e f a b c d e g"]
    more = spark.createDataFrame([(500 + i, t, "en", "a", *[None] * 8) for i, t in enumerate(texts)], SCHEMA)
    got = quality.op7_quality(docs.unionByName(more)).collect()
    want = sorted([(r[0] if r[0] is not None else -1, *measured(r[1])) for r in rows] + [(500 + i, *measured(t)) for i, t in enumerate(texts)])
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.op7_quality(none).count() == 0 and quality.good_documents(none).columns == docs.columns


def test_quality_thresholds_follow_the_group(spark):
    rng = random.Random(4)
    plain = [(i, sentence(rng, 60), "en", "prose") for i in range(200)]
    tables = [(i, " | ".join(sentence(rng, 60).split()), "en", "tables") for i in range(200, 400)]
    odd = [(400, " # ".join(sentence(rng, 60).split()), "en", "prose")]
    df = spark.createDataFrame(plain + tables + odd, "doc_id long, text string, lang string, source string")
    gone = {r["doc_id"] for r in quality.op7_quality(df).filter("not kept").collect()}
    assert gone == {400}
    assert {r["doc_id"] for r in quality.good_documents(df).collect()} == set(range(400))


def test_quality_thresholds_come_from_the_sketches(spark):
    """Levels that fixed cutoffs of 90, 360 and 180 per mille and q75 + 3.6 characters let pass, each rare in its group; the
    same levels stay where they are usual."""
    rng = random.Random(24)
    def some(n, length=4):
        return ["".join(rng.choice("bcdfglmnprstvaeiou") for _ in range(length)) for _ in range(n)]
    def lines(again):
        own = [" ".join(some(8)) for _ in range(20)]
        return "\n".join(own[:20 - again] + own[:again])
    rows = [(i, lines(0), "en", "plain") for i in range(200)]
    rows += [(200 + i, lines(2), "en", "refrains") for i in range(200)]
    repeats = some(90)
    odd = [lines(2), " ".join(some(93)) + " # # # # # #", " ".join(repeats + repeats[:6]), " ".join(some(100, 6)), " ".join(some(100, 2))]
    rows += [(400 + i, t, "en", "plain") for i, t in enumerate(odd)]
    got = quality.op7_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in got if r["doc_id"] >= 400)
    assert {r["doc_id"] for r in got if not r["kept"]} - set(range(200, 400)) == {400, 401, 402, 403, 404}
    assert all(r["kept"] == (not r["base_failed"]) for r in got if 200 <= r["doc_id"] < 400)


# --- 6: SimHash ---------------------------------------------------------------------------------------------------

def brute_fp(t):
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in words(t)]
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    if not sh:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = dict((i, i) for i in range(len(fps)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(docs, rows, none):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash(docs).collect())
    fps = [brute_fp(r[1]) for r in rows]
    comp = brute_components(fps)
    least = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    want = sorted(((r[0] is None, r[0] or 0), format(f, "016x"), least.get(c)) for r, f, c in zip(rows, fps, comp))
    assert got == want
    assert simhash.op6_simhash(none).count() == 0


def test_filter_keeps_one_of_copies_and_near_copies(docs, rows, none):
    shingles = [simhash.shingle_set((r[1] or "").encode()) for r in rows]
    root = brute_components([brute_fp(r[1]) for r in rows])
    for i in range(len(rows)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    least = {}
    for r, c in zip(rows, root):
        key = (r[0] is None, r[0] or 0)
        least[c] = min(key, least.get(c, key))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and ids(kept) == sorted(least.values())
    assert 4 in {r["doc_id"] for r in kept.collect()} and 71 not in {r["doc_id"] for r in kept.collect()}
    assert simhash.one_of_each(none).count() == 0


def similar_components(texts):
    """Root of every text over all pairs of shingle similarity 0.8 and over the fingerprints."""
    shingles = [simhash.shingle_set(t.encode()) for t in texts]
    root = brute_components([brute_fp(t) for t in texts])
    for i in range(len(texts)):
        for j in range(i):
            n = len(shingles[i] & shingles[j])
            if n >= 0.8 * (len(shingles[i]) + len(shingles[j]) - n) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def changed(rng, ws, at, n):
    return ws[:at] + ["".join(rng.choice("bcdfglmnprstvaeiou") for _ in range(rng.randint(2, 8))) for _ in range(n)] + ws[at + n:]


def test_filter_finds_every_near_copy(spark):
    """A tenth of the words in one run is new: the shingles agree to 0.8, no piece of a fingerprint of words need agree."""
    rng, texts = random.Random(21), []
    for _ in range(40):
        ws = changed(rng, [], 0, 300)
        texts += [" ".join(ws), " ".join(changed(rng, ws, rng.randrange(270), rng.randint(20, 32)))]
    got = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(similar_components(texts))


def test_large_group_of_near_copies_by_few_pairs(spark):
    """Copies of one text with one or two changed words, and chains between them: all are found, few pairs are compared."""
    rng, base = random.Random(22), changed(random.Random(23), [], 0, 120)
    texts = [" ".join(base)]
    for _ in range(250):
        ws = base
        for _ in range(rng.choice((1, 1, 2, 3))):
            ws = changed(rng, ws, rng.randrange(119), 1)
        texts.append(" ".join(ws))
    for k in range(10):
        ws = changed(rng, base, 12 * k, 3)
        texts += [" ".join(ws), " ".join(changed(rng, ws, rng.randrange(118), 1))]
    texts += [" ".join(changed(rng, [], 0, 60)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _doc long").withColumn("_k1", F.xxhash64("text")).withColumn("_k2", F.lit(0))
    got = simhash.one_of_each(df.select("doc_id", "text"))
    assert {r["doc_id"] for r in got.collect()} == set(similar_components(texts))
    slim = df.select("_doc", "_k1", "_k2", F.col("text").cast("binary").alias("_bytes"))
    nodes = simhash.with_fingerprint(slim.withColumn("_row", F.col("_doc")), order=simhash.frequent_shingles(slim))
    live = simhash.shared_shingles(nodes)
    assert live.filter("n <= 0").count() == 0 and simhash.met(live, None, 1).count() <= 12 * len(texts)


def test_bits_never_tell_agreeing_texts_apart():
    """Bits that differ are at most the shingles that differ, whatever the lengths; texts without common shingles differ in many."""
    rng = np.random.default_rng(24)
    for n in (1, 3, 40, 63, 64, 65, 500, 3000, 70_000):
        h = np.unique(rng.integers(-2**63, 2**63 - 1, n))
        for drop, add in ((0, 0), (n // 9, n // 9), (n // 5, 0), (0, n // 4), (n // 2, n)):
            other = np.unique(np.concatenate([h[drop:], rng.integers(-2**63, 2**63 - 1, add)]))
            assert simhash.bits_apart(simhash.odd_bits(h), simhash.odd_bits(other)) <= len(np.setxor1d(h, other))
        far = np.unique(rng.integers(-2**63, 2**63 - 1, n))
        assert n < 40 or 9 * simhash.bits_apart(simhash.odd_bits(h), simhash.odd_bits(far)) > len(h) + len(far)


def test_filter_reads_only_texts_that_may_agree_and_leaves_one_table(spark, monkeypatch, tmp_path):
    """Texts with a common beginning meet but do not agree: their texts are not read again. Tables of a step are gone after it."""
    rng = random.Random(25)
    base = changed(rng, [], 0, 24)
    texts = [" ".join(base + changed(rng, [], 0, 120)) for _ in range(60)]
    texts += [t + " more words" for t in texts[:3]] + [None, "", texts[5], texts[5]]
    monkeypatch.setattr("contactmill.session.ensure_checkpoint_dir", lambda _: str(tmp_path))
    read, plain = [], simhash.texts_of
    monkeypatch.setattr(simhash, "texts_of", lambda *a: read.append(plain(*a)) or read[-1])
    seen: list = []
    monkeypatch.setattr(simhash, "similar", lambda pairs, f=simhash.similar: seen.append(read[-1].count()) or f(pairs))
    got = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    left = {c for folder in tmp_path.glob("written-*") for f in folder.glob("*.parquet") for c in pq.read_schema(f).names}
    assert "_often" in left and not left & {"_sig", "_odd", "pos", "t"}
    kept = {r["doc_id"] for r in got.collect()}
    want = similar_components([t or "" for t in texts])
    assert kept == set(want) and sum(seen) <= 12


def test_dense_halves_lose_no_link(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        f = rng.choice(sorted(fps)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    comp = brute_components(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "_fp long")
    from contactmill.functions.graph import connected
    for dense in (0, 3, 256):
        label = {r["node"]: r["root"] for r in connected(simhash.links(nodes, dense)).collect()}
        signed = [int(np.uint64(f).view(np.int64)) for f in fps]
        groups, want = {}, {}
        for s, c in zip(signed, comp):
            groups.setdefault(label.get(s, s), set()).add(s)
            want.setdefault(c, set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


# --- 3: personal data ---------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    d = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(*m.span(), "email") for m in EMAIL.finditer(t)]
    out += [(*m.span(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(t) if 12 <= len(d(m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d(m)))) % 10 == 0]
    out += [(*m.span(), "phone") for m in PHONE.finditer(t) if 9 <= len(d(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1234567890@@..+- ()%é") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(t) == brute_spans(t)
    for t in ("1" * 300_000, "a" * 300_000 + "@b.c", "@" * 100_000, "+1" + "(" * 100_000, "1." * 100_000, "9 " * 100_000):
        pii.base_spans(t), pii.candidates(t)


def with_pii(rng, i):
    n = "".join(rng.choice("0123456789") for _ in range(15))
    card = next(n + c for c in "0123456789" if pii.luhn(n + c))
    item = [f"user{i}@mail.example.com", f"10.{i % 256}.3.4", card, f"+1 (469) 555-{i % 10000:04d}"][i % 4]
    return f"{sentence(rng, 12)} {item} {sentence(rng, 8)}"


def test_model_adds_disguised_spans_and_keeps_clean_text(spark, docs, none):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, with_pii(rng, i)) for i in range(400)], "doc_id long, text string")
    model = pii.fit(df)
    for t, kind in (("reach me (at) firm (dot) example.org now", "email"), ("the 469-555-3334 is on", "phone"), ("was 4111.1111.1111.1111 in", "card")):
        assert [k for _, _, k in pii.spans(t, model)[1]] == [kind], t
    for t in ("on 2021-03-04 it was", "at the dot of a line", "version 3.11 and 12,500 of 1999", "0810992847249404"):
        assert pii.spans(t, model)[1] == pii.base_spans(t), t
    out = pii.op3_pii(docs)
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[87]["spans"].startswith("ip:11:18") and by[87]["n_ip"] == 1 and by[80]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = pii.redacted(df)
    assert clean.columns == df.columns and clean.count() == 400 and clean.filter("text rlike '@|[0-9]{4}'").count() == 0
    assert pii.redacted(docs).columns == docs.columns and ids(pii.redacted(docs)) == ids(docs) and pii.op3_pii(none).count() == 0


def test_model_learns_from_documents_beyond_the_first_4000_by_hash(spark):
    ids = [r["id"] for r in spark.range(4300).orderBy(F.xxhash64("id"), "id").collect()]
    rng = random.Random(10)
    df = spark.createDataFrame([(d, "room 7 or 9" if i < 4000 else with_pii(rng, i)) for i, d in enumerate(ids)], "doc_id long, text string")
    model = pii.fit(df)
    assert model is not None and [k for _, _, k in pii.spans("the 469-555-3334 is on", model)[1]] == ["phone"]


def test_trees_do_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (900, 4))
    y = ((x[:, 0] > 4) ^ (x[:, 3] > 3)).astype(float)
    whole, start = boosting.fit(x, y, trees=13), boosting.start_of(y.mean())
    rows, (groups, at) = rng.permutation(900), np.unique(x, axis=0, return_inverse=True)
    blocks = [boosting.block(x[i], y[i], np.ones(len(i)), whole.edges, start) for i in np.array_split(rows, 7)]
    counted = boosting.block(groups, np.bincount(at.ravel(), y), np.bincount(at.ravel()), whole.edges, start)
    for dealt, parts in ((blocks, 5), ([counted], 2)):
        spread = boosting.fit_blocks(spark.sparkContext.parallelize(dealt, parts), whole.edges, start, trees=13)
        assert all(np.array_equal(getattr(spread, f), getattr(whole, f)) for f in ("feature", "cut", "leaf"))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    assert ((boosting.fit(x[:1500], y[:1500]).raw(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    points = pii.isotonic(np.array([0., 1, 2, 3, 4]), np.array([0, 1, 0, 1, 1]))
    assert np.all(np.diff(points[1]) >= 0)


# --- 4: toxicity --------------------------------------------------------------------------------------------------

def test_toxicity_finds_unseen_misspellings(spark, docs, labels, none):
    rng = random.Random(12)
    bad = ["idiot", "moron", "stupid", "worthless"]
    rows, marks = [], []
    for i in range(900):
        w, y = sentence(rng, rng.randint(20, 80)).split(), i % 5 == 3
        for _ in range(3 * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        marks.append((i, int(y)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.op4_toxicity(df, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    truth = dict(marks)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    model = toxicity.fit(df, spark.createDataFrame(marks, "doc_id long, toxic int"))
    plain, odd = sentence(rng, 40), sentence(rng, 40) + " idiott moronic stupidd idiotic"
    a, b = toxicity.score_texts([plain, odd], *model)
    assert a < 0.5 < b
    got = toxicity.op4_toxicity(docs, labels)
    assert ids(got) == ids(docs) and got.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert toxicity.op4_toxicity(none, labels).count() == 0 and toxicity.not_toxic(docs, labels.limit(0)).columns == docs.columns


# --- 1: language --------------------------------------------------------------------------------------------------

def test_languages_of_held_out_texts(spark, docs, none):
    rng = random.Random(13)
    parts = {"aa": ["tion", "the", "and", "ing"], "bb": ["ung", "der", "schen", "lich"], "cc": ["ción", "los", "mente", "que"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(30)), k) for i, k in enumerate(rng.choice(sorted(parts)) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = [r for r in langid.op1_langid(df).collect() if r["held_out"]]
    truth = {i: k for i, _, k in rows}
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 < r["score"] <= 1 for r in held)
    got = {r["doc_id"]: r for r in langid.op1_langid(docs).collect()}
    assert [got[i]["lang_pred"] for i in (80, 81, 82, 87)] == ["und"] * 4 and got[85]["lang_pred"] in ("en", "xx")
    assert langid.op1_langid(none).count() == 0


def test_more_languages_than_one_mask_holds(spark):
    rng = random.Random(18)
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(70)]
    rows = [(i, " ".join(stems[i % 70] + rng.choice("aeiou") for _ in range(12)), f"l{i % 70:02d}") for i in range(420)]
    out = langid.op1_langid(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 70:02d}" for r in out)


def test_bitmask_filter_returns_every_language():
    rng = np.random.default_rng(3)
    grams = [rng.integers(0, 2 ** 63, 5000).astype(np.uint64) for _ in range(3)]
    table = np.zeros(1 << 18, np.uint8)
    for i, g in enumerate(grams):
        for s in langid.slots(g, 1 << 18):
            table[s] |= np.uint8(1 << i)
    for i, g in enumerate(grams):
        masks = np.bitwise_and.reduce([table[s] for s in langid.slots(g, 1 << 18)])
        assert np.all(masks >> np.uint8(i) & np.uint8(1))
        assert (masks >> np.uint8((i + 1) % 3) & np.uint8(1)).mean() < 0.01


# --- 2: tokens ----------------------------------------------------------------------------------------------------

def test_tokens_equal_a_walk_over_bytes(spark, docs, none):
    encoding, _ = tokens.encoder()
    rng = random.Random(14)
    for _ in range(200):
        t = "".join(rng.choice(["the ", "a", "\n", "é", "ing", " ", "\n\n", "😀", "1"]) for _ in range(rng.randint(0, 40)))
        starts = tokens.line_starts(t)
        owner = [max(k for k, s in enumerate(starts) if s <= i) for i in range(len(t.encode()))]
        for rule in tokens.RULES:
            want, at = np.zeros(len(starts)), 0
            for i in encoding.encode_ordinary(t):
                size = len(encoding.decode_single_token_bytes(i))
                own, at = owner[at:at + size], at + size
                if rule == "start":
                    want[own[0]] += 1
                elif rule == "most":
                    want[max(sorted(set(own)), key=own.count)] += 1
                else:
                    for k in own:
                        want[k] += 1 / size
            assert np.allclose(tokens.count(t, starts, rule), want)
    got = tokens.op2_tokens(docs)
    sums = got.groupBy("doc_id", "doc_tokens").agg(F.sum("n_tokens").alias("n"), F.countDistinct("section").alias("k"), F.count("*").alias("rows"))
    assert sums.filter("n <> doc_tokens * (rows / k)").count() == 0
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    fields = tokens.attributed_fields(spark.createDataFrame([(1, "title", None, "body text"), (2, None, None, None)], "id long, a string, b string, c string"), "id", ["a", "b", "c"])
    by = {(r["id"], r["field"]): r["n_tokens"] for r in fields.collect()}
    assert by[1, "a"] + by[1, "b"] + by[1, "c"] == len(encoding.encode_ordinary("title\n\nbody text"))
    assert tokens.op2_tokens(none).count() == 0


# --- 9: decontamination -------------------------------------------------------------------------------------------

def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_recurrence():
    rng = random.Random(15)
    pairs = [([rng.choice("abcde") for _ in range(rng.randint(1, 12))], [rng.choice("abcdef") for _ in range(rng.randint(1, 25))]) for _ in range(300)]
    assert [s for s, _ in decontaminate.align(pairs)] == [brute_align(a, b) for a, b in pairs]


def test_copies_and_edits_of_items_are_found(spark, docs, none):
    rng = random.Random(16)
    def odd(n):
        return ["".join(rng.choice("bcdfglmnprstvaeiou") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    items = [odd(30) for _ in range(20)]
    rows, bad = [], set()
    for i in range(120):
        body = odd(rng.randint(50, 400))
        if i % 4 == 0:
            k, copy = i % 20, list(items[i % 20])
            if i % 8 == 0:
                for _ in range(4):
                    copy[rng.randrange(len(copy))] = "changed"
                del copy[rng.randrange(len(copy))]
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() if i % 12 == 0 else w + "," for w in copy]
            bad.add((i, k))
        rows.append((i, " ".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op9_decontaminate(df, bench).collect()}
    assert got == bad
    assert {r["doc_id"] for r in decontaminate.clean_documents(df, bench).collect()} == {i for i, _ in rows} - {i for i, _ in bad}
    assert decontaminate.clean_documents(docs, bench).columns == docs.columns and ids(decontaminate.clean_documents(docs, bench)) == ids(docs)
    assert decontaminate.op9_decontaminate(none, bench).count() == 0 and decontaminate.op9_decontaminate(docs, bench.limit(0)).count() == 0


def test_long_items_in_pieces_and_templated_items_are_found(spark):
    rng = random.Random(25)
    def odd(n):
        return ["".join(rng.choice("bcdfglmnprstvaeiou") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    long, mid, longer, form = odd(300), odd(120), odd(500), odd(40)
    items = {0: long, 1: mid, 2: longer, **{10 + k: form[:20] + odd(1) + form[20:] for k in range(5)}}
    pieces = odd(30) + long[:100] + odd(70) + long[100:200] + odd(70) + long[200:] + odd(30)
    apart = odd(200) + mid[:55] + odd(66) + mid[65:] + odd(900)
    docs = {0: pieces, 1: apart, 2: odd(100) + longer[150:350] + odd(100), 3: odd(50) + form[:20] + odd(1) + form[20:] + odd(50), 4: odd(600), 5: odd(100) + longer[150:200] + odd(100)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.op9_decontaminate(df, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2)} | {(3, 10 + k) for k in range(5)}
    assert got[0, 0] == pytest.approx(brute_align(long, pieces) / 600) and got[1, 1] == pytest.approx(brute_align(mid, apart) / 240)


# --- 5: urls ------------------------------------------------------------------------------------------------------

def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fit = [(h + p, v) for h, p, v in urltree.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit, key=lambda x: len(x[0])) if fit else (None, None)))


def test_rules_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?q#f", "https://www.example.com/en/1", "x://example.com/EN/", "http://foo.net/es/a://b", "http://foo.net?x=/es/",
            "http://foo.net#/fr/", "http://com/", "http://com", "http://ÄB.net/fr/", "http://notcom/x", "http://a.com:80/x", "//x.com/a"]
    rng = random.Random(17)
    rows = [(i, u, None) for i, u in enumerate(urls)]
    for i in range(400):
        rows.append((1000 + i, f"http://shop.org/spam/{i}", int(rng.random() < 0.95)))
        rows.append((2000 + i, f"http://shop.org/blog/{i}/post-{i}.html", int(rng.random() < 0.05)))
        rows.append((3000 + i, f"http://shop.org/{rng.choice(['en', 'de'])}/{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abcdefghijklmnopqrstuvwxyz')}", None))
    df = spark.createDataFrame(rows + rows[:3], "page_id long, url string, bad int")
    got = urltree.judged(df).collect()
    assert len(got) == len(rows) + 3
    by = {r["page_id"]: r for r in got}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule) and by[i]["verdict"] == (verdict or "allow"), u
    assert {by[1000 + i]["verdict"] for i in range(400)} == {"block"} and {by[2000 + i]["verdict"] for i in range(400)} == {"allow"}
    assert by[1001]["template"] == "spam/*" and by[2001]["template"] == "blog/*/*"
    assert urltree.judged(df.limit(0)).count() == 0


# --- 8: main text -------------------------------------------------------------------------------------------------

def test_main_text_of_page_shapes(spark):
    para = "This is a sentence, with some text. And one more, for good measure."
    cases = {
        f"<html><head><title>t</title></head><body><nav><a href=1>home</a></nav><article><h1>A &amp; B</h1><p>{para}<br>x<p>two  \n three</article><footer>f</footer></body></html>": f"A & B\n{para} x\ntwo three",
        f"<body><div id=menu><a href=1>x</a></div><div class=content><h2>H</h2><p>{para}</p><p>{para}</p><ul><li>one<li>two</ul></div><div class='side-bar sidebar'>{para}</div><section id='comments'><p>{para}</p></section></body>": f"H\n{para}\n{para}\none\ntwo",
        f"<article><script>if (a<b) '</p>'</script><form><p>{para}</p></form><p>ok</p><div class='ad'>{para}</div></article><p>{para}</p>": "ok",
        f"<main><p>{para}</p><!-- <p>no</p> --><style>p{{}}</style><aside>no</aside></main>": para,
        "": "", "just words": "just words", "<p>a<b>b</i>c": "abc", "<div><nav>x</nav></div>": "", "<p>1 < 2 &lt; 3 &#233;&nbsp;x</p>": "1 < 2 < 3 é x",
    }
    for page, want in cases.items():
        assert maintext.main_text(page) == want, page
    big = "<article>" + f"<p>{para}</p>" * 20_000 + "</article>"
    assert maintext.main_text(big).count("\n") == 19_999
    maintext.main_text("<" * 50_000), maintext.main_text("<p " * 20_000), maintext.main_text("<div>" * 3_000)
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", "<p>x</p>")], "page_id long, url string, html string")
    out = maintext.op8_main_text(df).collect()
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out) and maintext.op8_main_text(df.limit(0)).count() == 0
