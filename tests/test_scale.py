"""Long texts, long runs of words and tables of names that have much in common."""

import random

import pytest
from pyspark.sql import functions as F

from contactmill.functions import business_rules as B
from contactmill.operators import business as E

PLAIN_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]*)*\s+[A-Z][a-z]+"
PLAIN = {"FOUNDED_BY": (r"(?i)(?:founded|started|established|owned)\s+by\s+(" + PLAIN_NAME + ")", 1),
         "NAME_IS_TITLE": (r"(?i)(" + PLAIN_NAME + r")\s+(?:is|was)\s+(?:the\s+)?([A-Z][^.]{2,30})", 2),
         "NAME_THEN_TITLE": (r"\b(" + PLAIN_NAME + r")\s*[,\-–—:]\s*([^,\n\r.]{3,50}?)(?=\s*[,\n\r.]|$)", 2),
         "TITLE_THEN_NAME": (r"\b([A-Z][^,\n\r:]{2,30}?)\s*[:\-–—]\s*(" + PLAIN_NAME + ")", 2)}
BITS = ["is", "was", "the", "Is", "A", "b", "John", "Smith", "Mc", "McDonald", "bus", ",", "-", ":", "\n", "  ", "ö", "9", "founded by",
        "owned  by", "O", "CEO", "Anna Berg", "is the", "was the", ".", " "]


@pytest.mark.parametrize("name", PLAIN)
def test_name_patterns_find_what_the_plain_ones_find(spark, name):
    rng = random.Random(5)
    texts = [("".join(rng.choice(BITS) + rng.choice([" ", " ", "", "\n", "  "]) for _ in range(rng.randint(1, 30))),) for _ in range(1500)]
    plain, groups = PLAIN[name]
    found = lambda p, g: F.filter(F.regexp_extract_all("s", F.lit(p), F.lit(g)), lambda x: x != "")
    df = spark.createDataFrame(texts, "s string")
    rows = df.select(*[found(p, g).alias(f"{k}{g}") for g in range(1, groups + 1) for k, p in (("a", plain), ("b", getattr(B, name)))]).collect()
    assert all(r[f"a{g}"] == r[f"b{g}"] for r in rows for g in range(1, groups + 1)) and any(r["a1"] for r in rows)


def test_people_of_texts_with_very_long_runs_of_words(spark):
    run = " ".join(["Anna", "der", "haus"] * 8000)
    texts = [run, f"founded by {run}", "our team: " + "Anna " * 20000, run + " nobody is. Omar Diaz is the director of it"]
    df = spark.createDataFrame([(i, t, f"<div class='team'>{t}</div>") for i, t in enumerate(texts)], "page_id int, text string, html string")
    got = {r["page_id"]: [p["name"] for p in r["people"]] for r in E.people(df).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["Omar Diaz"]}


def test_letter_classes_split_names_so_that_one_class_holds_few_differences():
    from contactmill.operators import match as M
    assert all(r // M.class_counts(r) <= (3 if r < 8 else 2) for r in range(400))
    assert len({M.class_counts(r) for r in range(400)}) < 14
    assert len(list(M._shortened("abcdefghij", 3))) == 1 + 10 + 45 + 120


def test_dense_random_names_meet_on_classes_and_find_every_pair(spark):
    """The joins on pairs and triples of grams gave hundreds of rows a name, each with all keys of that name."""
    from contactmill.operators import match as M
    from test_groups import ratio
    rng = random.Random(11)
    names = set()
    for _ in range(60):
        base = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(14, 24)))
        names |= {base, base + "xx", base[1:], base[:6] + base[7:], base[:9] + "f" + base[9:], base[:3] + "x" + base[4:]}
    names = sorted(names)
    got = {(r.a, r.b): r.percent for r in M.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), 85, 1).collect()}
    assert got == {(a, b): ratio(a, b) for a in names for b in names if a < b and ratio(a, b) >= 85} and len(got) > 300


def test_prefixes_with_their_tails_give_every_rest():
    from contactmill.operators import match as M
    rng = random.Random(12)
    for _ in range(300):
        part, j, most = "".join(rng.choice("abcx") for _ in range(rng.randint(0, 9))), rng.randint(1, 4), rng.randint(0, 3)
        got = {(skip + out, prefix.rstrip("\0") + rest) for prefix, skip, tail in M._prefixes(part, j, most)
               for out, rest in M._shortened(tail, min(most - skip, len(tail)) if tail else 0)}
        assert got == {(out, rest) for out, rest in M._shortened(part, min(most, len(part)))}
        split = [p for n in range(3) for p in M._prefixes(part, j, most, lambda c, n=n: ord(c) % 3 == n)]
        assert sorted(split) == sorted(M._prefixes(part, j, most))


def test_names_go_to_few_buckets_in_rounds(spark, monkeypatch):
    """Each rest of a name was a row, some 400 for one of 20 letters, all at once."""
    from contactmill.operators import match as M
    from test_groups import ratio
    rng, names = random.Random(13), set()
    for _ in range(25):
        base = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(18, 22)))
        names |= {base, base + "xxxxxx", base[2:], base[:6] + "g" + base[7:], base[::-1]}
    names = sorted(names)
    want = {(a, b): ratio(a, b) for a in names for b in names if a < b and ratio(a, b) >= 85}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    sent, plain, met = [], M._in_buckets, M._met
    monkeypatch.setattr(M, "_in_buckets", lambda rows, t: sent.append(rows.count()) or plain(rows, t))
    monkeypatch.setattr(M, "BUCKET", 60)
    assert {(r.a, r.b): r.percent for r in M.similar_names(df, 85, 1).collect()} == want and len(want) > 80
    assert len(sent) == 1 and 0 < sent[0] <= 120 * len(names)
    monkeypatch.setattr(M, "ROUND", sent[0] // 3)
    monkeypatch.setattr(M, "CHUNK", 7)
    monkeypatch.setattr(M, "_met", lambda rows, t: met(rows, t, 500))
    assert {(r.a, r.b): r.percent for r in M.similar_names(df, 85, 1).collect()} == want and len(sent) > 2


def test_addresses_meet_within_their_house_number_and_with_those_without_one(spark):
    from contactmill.operators import match as M
    df = spark.createDataFrame([(a,) for a in ("12 Main Street", "12 Main St.", "12 main streets", "13 Main Street", "Main Streets", "main strets", None, " ")], "address string")
    got = {(r.a, r.b) for r in M.similar_address_pairs(df).collect()}
    assert ("main streets", "main strets") in got and ("12 main streets", "main streets") in got
    assert not any(a[:2] == "13" and b[:2] == "12" or a[:2] == "12" and b[:2] == "13" for a, b in got)
