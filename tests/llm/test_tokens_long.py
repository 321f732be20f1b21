"""Token counts of texts that are very long without a break."""

import random

import numpy as np
import pytest

from contactmill.llm import tokens


@pytest.mark.parametrize("limit", ["2", "3", "10"])
def test_ids_around_cut_white_space_are_those_of_one_encoding(monkeypatch, limit):
    import re
    monkeypatch.setattr(tokens, "LONG_BLANK", re.compile(tokens.LONG_BLANK.pattern.replace("10000", limit)))
    encoding, _ = tokens.encoder()
    rng = random.Random(int(limit))
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", " ", "　", " " * 12, "\n" * 5, "a", "Word", "'s", "1", "42", "!", "é", "😀", "\x1c", "​"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert tokens.encoded(encoding, text) == encoding.encode_ordinary(text), repr(text)


def test_five_million_blanks_and_letters(spark):
    encoding, _ = tokens.encoder()
    n = 5_000_000
    texts = [" " * n + "x", "x" + "\n" * n, "\t " * (n // 2) + "end", "a" * n, " " * 20_000, "a" + " " * 20_000 + "\n" + " " * 20_000 + "b"]
    got = {r["doc_id"]: r["doc_tokens"] for r in tokens.op2_tokens(spark.createDataFrame(list(enumerate(texts[:1] + texts[3:])), "doc_id long, text string")).select("doc_id", "doc_tokens").distinct().collect()}
    assert got[0] >= 1 and got[1] > 1 and set(got) == {0, 1, 2, 3}
    for t in texts[4:]:
        assert tokens.encoded(encoding, t) == encoding.encode_ordinary(t)
    for t in texts[:3]:
        ids = tokens.encoded(encoding, t)
        _, size = tokens.encoder()
        assert size[np.array(ids)].sum() == len(t.encode())
