"""Fill-in-the-middle against brute force, and its chunks and cache."""

import hashlib
import random
import re

import numpy as np
import pytest

from contactmill.llm import fim

SCHEMA = "doc_id long, text string, fim_n string, form string, c0 string, _h int"


def brute(doc_id, text):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i:i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    n = len(lines)
    if not t or any(m in t for m in fim.MARKS):
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    spm = h[3] % 100 < 50
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(t)


def texts():
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("abcé😀 ß\t") for _ in range(rng.randrange(0, 400)))
    shared = "\n".join(line() for _ in range(60))
    out = [None, "", "\n", "\n\n\n", "x", "x\n", " \t ", "a<P>b\nc", "<M>", "<\n<S\n>P>", "é" * 50_000, "\n" * 50_000, "no line end " * 20_000]
    out += [shared + "\n" + line(), line() + shared, "\r\n".join(line() for _ in range(50)), shared[:-1]]
    return out + ["\n".join(line() for _ in range(rng.randrange(30))) for _ in range(80)]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, "a\nb\nc"), (None, None)]
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in fim.op11_fim(df).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_operator_keeps_other_columns_and_replaces_its_own(spark):
    df = spark.createDataFrame([(1, "a\nb", "old", "f", "zero", 3)], SCHEMA)
    got = fim.transformed(df)
    assert got.columns == ["doc_id", "text", "form", "c0", "_h", "fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    r = got.first()
    assert (r["form"], r["c0"], r["_h"], r["fim_n"]) == ("f", "zero", 3, 2)
    assert fim.transformed(df, rate=0).first()["fim_form"] == "plain"
    assert fim.transformed(df.limit(0)).count() == 0
    assert fim.op11_fim(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [t for t in texts() if t])
def test_chunks_cover_the_text_and_keep_code_points_whole(text):
    raw = text.encode()
    ends = fim.chunk_ends(np.frombuffer(raw, np.uint8))
    assert ends[-1] == len(raw) and ends == sorted(set(ends))
    sizes = np.diff([0, *ends])
    assert (sizes <= fim.LONGEST).all() and (sizes[:-1] >= fim.SHORTEST).all()
    at = 0
    for e in ends:
        raw[at:e].decode()
        at = e
    parts = fim.Parts(raw, fim.Memo())
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert parts.n == len(lines)
    for k in {0, 1, len(lines) // 2, len(lines) - 1, len(lines)}:
        assert parts.after(k) == (len("".join(lines[:k]).encode()), len("".join(lines[:k])))


def test_bounds_do_not_depend_on_blocks_or_place(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(32, 127, 200_000).astype(np.uint8)
    whole = fim.triggers(data)
    monkeypatch.setattr(fim, "BLOCK", 1000)
    assert (fim.triggers(data) == whole).all()
    moved = np.concatenate([rng.integers(32, 127, 777).astype(np.uint8), data])
    a, b = set(fim.chunk_ends(data)), {e - 777 for e in fim.chunk_ends(moved)}
    assert len(a & b) > 0.9 * len(a)


def test_shared_chunks_hit_the_cache_and_a_small_cache_changes_nothing():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh \n") for _ in range(100_000))
    memo = fim.Memo()
    fim.Parts(("head one\n" + shared).encode(), memo)
    first = memo.asked
    fim.Parts(("another head\n" + shared).encode(), memo)
    assert memo.hits > 0.9 * (memo.asked - first)
    tiny = fim.Memo(3000)
    for t in texts():
        raw = (t or "").encode()
        h = (12345, 99991, 5, 77)
        assert fim.arranged(raw, h, tiny) == fim.arranged(raw, h, fim.Memo())
        assert tiny.held <= max(3000, fim.LONGEST)
