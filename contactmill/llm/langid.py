"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: a slot is a bitmask with one bit per language, an n-gram
sets its language's bit in ``HASHES`` slots, and the AND of those slots returns every language that contains it. A text is
the popcount per language over all its n-grams (2 to 4 characters, word bounds included). A bit that is set by chance
counts too: with the filter's share of set bits f per language, f ** HASHES of the misses do, and the count is corrected
for them. The largest corrected count decides; the score is its share of all corrected counts.

An n-gram belongs to a language when it makes up at least ``LEAST`` of that language's n-grams and at least ``SHARE`` of
the rate it has in the language where it is most frequent. So a language has at most 1 / LEAST n-grams, a proven bound.

Learning uses text and non-null lang of rows that are not held out, at most ``PER_LANG`` per language, those with the
smallest hash of doc_id; prediction covers every row and whole texts. Null texts and texts without a letter are ``und``
with score 0. Ties go to the language that comes first; a text none of whose n-grams is known gets the language with most
learning rows and score 0. Without learning rows everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactmill.llm import ngrams
from contactmill.llm.common import bounded, doc_crc

SIZES = (2, 3, 4)
PER_LANG = 3000
LEAST = 5e-6
SHARE = 0.25
SLOTS = 1 << 20
HASHES = 3


def slots(h: np.ndarray, m: int = SLOTS, k: int = HASHES):
    """The k slots of each hash, by two halves of the hash (double hashing)."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(k):
        yield ((a + np.uint64(i) * b) % np.uint64(m)).astype(np.int64)


def counts(rows: DataFrame) -> DataFrame:
    """lang, text -> lang, gram, n: summed in the tasks first, then over all."""
    def run(batches):
        for b in batches:
            by: dict = {}
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                for a, z in ngrams.chunks(texts):
                    codes, owner = ngrams.squeezed(texts[a:z])
                    g, n = np.unique(np.concatenate([ngrams.hashed(codes, owner, s)[0] for s in SIZES]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, per_lang: int = PER_LANG):
    """(languages by learning rows, Bloom slots for each 64 of them, false positive rate per language). Runs jobs; the
    driver gets at most 1 / LEAST n-grams per language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(doc_crc(), F.lit(3)) != 1))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return [], [], np.zeros(0)
    chosen = bounded(known.select("doc_id", "lang"), "lang", sizes, per_lang).distinct()
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    each = counts(rows)
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    rated = each.withColumn("rate", rate).filter(F.col("rate") >= LEAST)
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    own = rated.join(top, "gram").filter(F.col("rate") >= SHARE * F.col("top")).select("lang", "gram").toPandas()
    tables, chance = [], []
    for first in range(0, len(langs), 64):
        part = langs[first:first + 64]
        width = next(w for w in (8, 16, 32, 64) if len(part) <= w)
        table = np.zeros(SLOTS, f"u{width // 8}")
        for i, lang in enumerate(part):
            h = own["gram"].to_numpy(np.int64)[(own["lang"] == lang).to_numpy()].view(np.uint64)
            for s in slots(h):
                table[s] |= table.dtype.type(1 << i)
        tables.append(table)
        chance += [(table >> table.dtype.type(i) & table.dtype.type(1)).mean() ** HASHES for i in range(len(part))]
    return langs, tables, np.array(chance)


def popcounts(texts: list[str], n_langs: int, table: np.ndarray):
    """Per text: n-grams, and hits per language."""
    total, hits = np.zeros(len(texts)), np.zeros((len(texts), n_langs))
    for a, z in ngrams.chunks(texts):
        codes, owner = ngrams.squeezed(texts[a:z])
        for s in SIZES:
            h, o = ngrams.hashed(codes, owner, s)
            mask = None
            for at in slots(h, len(table)):
                mask = table[at] if mask is None else mask & table[at]
            total[a:z] += np.bincount(o, minlength=z - a)
            if n_langs <= 8:
                both = np.bincount(o.astype(np.int64) << n_langs | mask, minlength=(z - a) << n_langs).reshape(z - a, -1)
                bit = np.arange(1 << n_langs)
                for i in range(n_langs):
                    hits[a:z, i] += both[:, bit >> i & 1 == 1].sum(1)
            else:
                for i in range(n_langs):
                    hits[a:z, i] += np.bincount(o, mask >> mask.dtype.type(i) & mask.dtype.type(1), z - a)
    return total, hits


def predict(texts: list[str | None], model) -> tuple[list[str], list[float]]:
    langs, tables, chance = model
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    plain = [t or "" for t in texts]
    parts = [popcounts(plain, min(64, len(langs) - 64 * k), table) for k, table in enumerate(tables)]
    total, hits = parts[0][0], np.concatenate([h for _, h in parts], axis=1)
    fixed = np.maximum((hits - total[:, None] * chance) / np.maximum(1 - chance, 1e-9), 0)
    best, whole = fixed.argmax(1), fixed.sum(1)
    score = np.where(whole > 0, fixed[np.arange(len(best)), best] / np.maximum(whole, 1e-12), 0.0)
    names = [langs[i] if n > 0 or any(map(str.isalpha, t)) else "und" for i, n, t in zip(best, total, plain)]
    return names, [0.0 if n == "und" else float(min(1.0, s)) for n, s in zip(names, score)]


def identified(df: DataFrame, model) -> DataFrame:
    """Replace ``_text`` by ``_lang`` and ``_score``; other columns pass."""
    names = [c for c in df.columns if c != "_text"]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score = predict(b.column("_text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "_lang", "_score"])

    return df.mapInArrow(run, df.select(*[F.col(f"`{c}`") for c in names]).schema.add("_lang", "string").add("_score", "double"))


def op1_langid(docs: DataFrame) -> DataFrame:
    out = identified(docs.select("doc_id", F.col("text").alias("_text")), learn(docs))
    return out.select("doc_id", F.coalesce(F.pmod(doc_crc(), F.lit(3)) == 1, F.lit(False)).alias("held_out"),
                      F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
