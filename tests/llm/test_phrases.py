"""Collocations against brute force, and the parse they are counted in."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from contactmill.llm import phrases

SCHEMA = "doc_id long, text string, lang string, chunk string, own int, n long, phrase string, `_h` int"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def pieces(text):
    found = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]
    return [p for p in found if p]


def brute(rows, least, top=2000, covered=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in (1, 2, 3, 4):
                f.update((lang, tuple(p[i:i + k])) for i in range(len(p) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        inside = lambda long: any(long[i:i + len(w)] == w for i in range(len(long) - len(w) + 1))
        if any(g == lang and len(x) > len(w) and 100 * b >= covered * a and inside(x) for (g, x), b in found.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((score, a, " ".join(w), l, r))
    return sorted((lang, i, p, a, l, r, n[lang], s) for lang, found in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found, key=lambda x: (-x[0], -x[1], x[2].encode()))[:top], 1))


def corpus():
    rng = random.Random(4)
    vocabulary = ["New", "york", "city", "é", "😀", "a", "b", "İ", "the", "of", "x" * 40]
    line = lambda n: " ".join(rng.choice(vocabulary) + rng.choice([""] * 6 + [",", ".", "\t", "\n", "\r\n", "!?"]) for _ in range(n))
    shared = line(300)
    rows = [(line(rng.randrange(60)), rng.choice(["en", "fr", None, "und"])) for _ in range(60)]
    rows += [(line(20) + shared + line(20), "en") for _ in range(8)]
    rows += [(t, "en") for t in (None, "", " \t ", ".,;", "one", "same " * 30_000, "word" * 100_000, "\x00 \x00    ", "a\x0bb\x0cc")]
    return rows + [rows[0]] * 5


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("every", [1, 3, 16])
def test_against_brute_force(spark, every):
    rows = corpus()
    df = spark.createDataFrame([(i, t, g, "x", 1, 2, "p", 3) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    got = phrases.phrases(df, least=4, every=every)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collected(got) == brute(rows, 4)


def test_first_rows_and_covering(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string")
    assert collected(phrases.phrases(df, least=2, top=7, covered=50)) == brute(rows, 2, 7, 50)


def test_empty(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases.op13_phrases(none).collect() == []
    nothing = spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text string, lang string")
    assert phrases.op13_phrases(nothing).collect() == []


def test_slices_and_flushes_change_nothing(spark, monkeypatch):
    texts = pa.array([(t or "").encode() for t, _ in corpus()], pa.binary())
    whole = phrases.chunks_of(texts)
    chunks, own = [], []
    monkeypatch.setattr(phrases, "SLICE", 500)
    for lo, hi in phrases.slices(texts):
        c, _, o = phrases.chunks_of(texts.slice(lo, hi - lo))
        chunks += c.to_pylist()
        own += o.tolist()
    assert (chunks, own) == (whole[0].to_pylist(), whole[2].tolist())


@pytest.mark.parametrize("every", [1, 2, 5])
def test_own_parts_make_up_the_pieces_and_hold_every_phrase_once(every):
    texts = [t or "" for t, _ in corpus()]
    chunks, doc, own = phrases.chunks_of(pa.array([t.encode() for t in texts], pa.binary()), every)
    words, seen = [], Counter()
    for c, o in zip(chunks.to_pylist(), own.tolist()):
        w = c.split(" ")
        words += w[:o]
        assert len(w) in (o, o + phrases.OVERLAP)
        for i in range(o):
            seen.update(tuple(w[i:i + k]) for k in range(1, 5) if i + k <= len(w))
    every_piece = [p for t in texts for p in pieces(t)]
    assert words == [w for p in every_piece for w in p]
    assert seen == Counter(tuple(p[i:i + k]) for p in every_piece for i in range(len(p)) for k in range(1, 5) if i + k <= len(p))
    assert (np.diff(doc) >= 0).all()


def test_filter_has_every_frequent_phrase(spark):
    rows = [("en", f"w{i} v{i % 7}") for i in range(3000)] + [("fr", "w1 zz")]
    known = phrases.Known.of(spark.createDataFrame(rows, "lang string, phrase string").repartition(3), 2)
    asked = rows + [("fr", f"w{i} v{i % 7}") for i in range(3000)]
    codes, words, at = phrases.split_words(pa.array([p for _, p in asked]))
    hashes = phrases.run_hashes(phrases.marked(pa.array([g for g, _ in asked]), words, codes, np.repeat(np.arange(len(asked)), 2)), 2)[at[:-1]]
    has = known.has(hashes)
    assert has[:len(rows)].all() and has[len(rows):].mean() < 0.1


def test_products_beyond_64_bits(spark):
    big = 9 * 10 ** 18
    expr = "(cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"
    got = spark.createDataFrame([(big, big, big - 1)], "a long, l long, r long").selectExpr(f"{expr} as s").first()["s"]
    assert got == 2_000_000 * big // (2 * big - 1)


def test_binary_join_keeps_words():
    chunks, _, own = phrases.chunks_of(pa.array(["A b\tC, d".encode()], pa.binary()))
    assert chunks.to_pylist() == ["a b c", "d"] and own.tolist() == [3, 1]
    assert pc.sum(pc.binary_length(chunks)).as_py() == 6
