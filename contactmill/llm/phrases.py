"""Collocations of each language, counted in a prefix-free parse of the corpus.

Texts are split into pieces and words. A run of ``OVERLAP`` words whose hash falls into one residue class is a trigger; a
chunk goes from one trigger (or the start of a piece) up to and including the next (or the end of the piece), so that
neighbours overlap by the trigger alone and the bounds depend on the words only. Distinct chunks with their frequencies
are the dictionary, written once: a passage that stands in many documents is held, and read, once. A phrase belongs to the
chunk in whose own part (all but the trailing trigger) it starts; as phrases are at most one word longer than a trigger,
each occurrence lies whole in exactly one chunk. Phrases are counted inside distinct chunks, times the frequency.

Counting goes by length. A phrase can reach ``least`` only where both phrases that are one word shorter do, so occurrences
without these are left out by a Bloom filter over the frequent shorter ones; it errs on the side of counting, counts are
those of the phrases themselves (no hash stands for a phrase), and results do not depend on its size. It takes 16 bits a
phrase, 16 MB at most: beyond eight million frequent phrases it lets more occurrences pass to the count.

Counts, cuts and ranks are DataFrame operations; a hot first or last word is split, and the first rows of a language are
taken from the first rows of 64 parts of it.

A null text counts as empty, a null lang as ``und``; texts without words add nothing; repeated rows count as often as they
occur; an empty table gives an empty result; other columns are not read. A long text is parsed alone, others in groups of
about ``SLICE`` bytes. Runs jobs while it is built.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactmill.llm.common import hot_join, written

LONGEST = 4
OVERLAP = LONGEST - 1
EVERY = 16
LEAST = 30
TOP = 2000
COVERED = 80
UNIT = 2_000_000
SLICE = 8 << 20
GATHER = 2_000_000
MOST_BITS = 1 << 27
SALT = 64

#: Per byte: 1 for blanks between words, 2 for the ends of pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def run_hashes(one: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` items, by their first item; the last k - 1 places stand for shorter runs."""
    g = one.copy()
    for j in range(1, k):
        g[:len(g) - j] = mixed(g[:len(g) - j] * np.uint64(0x9E3779B97F4A7C15) + one[j:])
    return g


def slices(texts: pa.Array):
    """Parts of a binary array of about ``SLICE`` bytes, as (first, last)."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right"))
        yield at, max(at + 1, upto)
        at = max(at + 1, upto)


def words_of(texts: pa.Array):
    """Binary texts without nulls -> words in lower case, the text of each, and whether it starts a piece."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = (np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8))[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    kind = KIND[data]
    inside = kind == 0
    first = offsets[:-1][offsets[:-1] < len(data)]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[first], after[first[first > 0] - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[data[inside]])])
    doc = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.cumsum(kind == 2)[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (breaks[1:] != breaks[:-1])
    return words, doc, opens


def chunks_of(texts: pa.Array, every: int = EVERY):
    """Chunk strings, the text of each, and the number of words in its own part."""
    words, doc, opens = words_of(texts)
    n = len(words)
    if not n:
        return pa.array([], pa.string()), doc, np.zeros(0, np.int32)
    enc = words.dictionary_encode()
    hashes = run_hashes(word_hashes(enc.dictionary)[enc.indices.to_numpy()], OVERLAP)
    piece = np.cumsum(opens)
    whole = np.zeros(n, bool)
    whole[:max(0, n - OVERLAP + 1)] = piece[:max(0, n - OVERLAP + 1)] == piece[OVERLAP - 1:]
    begins = opens | (whole & (hashes % np.uint64(every) == 0))
    start = np.flatnonzero(begins)
    own_end = np.append(start[1:], n)
    closed = np.append(opens, True)[own_end]
    end = own_end + np.where(closed, 0, OVERLAP)
    size = end - start
    upto = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(start - upto[:-1], size) + np.arange(upto[-1])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), words.take(pa.array(take))), " ")
    return joined, doc[start], (own_end - start).astype(np.int32)


def dictionary(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """lang, chunk, own (words of the own part), n (how often the chunk occurs)."""
    def run(batches):
        for b in batches:
            texts, langs = pc.fill_null(b.column("text").cast(pa.binary()), b""), b.column("lang")
            for lo, hi in slices(texts):
                chunk, doc, own = chunks_of(texts.slice(lo, hi - lo), every)
                if len(chunk):
                    rows = pa.table({"lang": langs.slice(lo, hi - lo).take(pa.array(doc)), "chunk": chunk, "own": own})
                    few = rows.group_by(["lang", "chunk", "own"]).aggregate([([], "count_all")])
                    yield from few.rename_columns(["lang", "chunk", "own", "n"]).to_batches(max_chunksize=50_000)

    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    rows = given.mapInArrow(run, "lang string, chunk string, own int, n long")
    return rows.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


def split_words(strings: pa.Array):
    """Strings of words -> codes, distinct words, the offsets of each string's words."""
    lists = pc.split_pattern(strings, " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    enc = lists.flatten().dictionary_encode()
    return enc.indices.to_numpy().astype(np.int64), enc.dictionary, lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()


def marked(langs: pa.Array, words: pa.Array, codes, row) -> np.ndarray:
    """A hash of every word under its language."""
    lang = langs.dictionary_encode()
    return mixed(word_hashes(words)[codes] ^ word_hashes(lang.dictionary)[lang.indices.to_numpy()][row])


class Known:
    """Bloom filter over phrases of one length: two places a phrase in ``bits`` (a power of two) bits."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(hashes: np.ndarray, bits: int):
        return [hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for p in self.places(hashes, len(self.words) * 64):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out

    @classmethod
    def of(cls, frequent: DataFrame, k: int) -> Known:
        """Filter over the phrases of ``k`` words in ``frequent`` (lang, phrase); made of at most ``MOST_BITS`` bits."""
        bits = min(MOST_BITS, 1 << max(16, math.ceil(math.log2(16 * max(1, frequent.count())))))

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                codes, words, at = split_words(b.column("phrase"))
                row = np.repeat(np.arange(b.num_rows), np.diff(at))
                hashes = run_hashes(marked(b.column("lang"), words, codes, row), k)[at[:-1]]
                spots = np.concatenate(cls.places(hashes, bits))
                slot, where = np.unique(spots >> np.uint64(6), return_inverse=True)
                mask = np.zeros(len(slot), np.uint64)
                np.bitwise_or.at(mask, where, np.uint64(1) << (spots & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(mask.view(np.int64))], ["slot", "mask"])

        got = frequent.mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[got["slot"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
        return cls(words)


def counted(rows: pa.Table, k: int, known: Known | None):
    """Counts of the phrases of ``k`` words that start in the own part of the given chunks."""
    codes, words, at = split_words(rows["chunk"])
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(codes))
    valid = (place < (at[:-1] + rows["own"].to_numpy())[row]) & (place + k <= at[1:][row])
    langs = rows["lang"].combine_chunks()
    if known is not None:
        shorter = np.append(known.has(run_hashes(marked(langs, words, codes, row), k - 1)), False)
        valid &= shorter[:-1] & shorter[1:]
    here = np.flatnonzero(valid)
    lang = langs.dictionary_encode()
    key = lang.indices.to_numpy().astype(np.int64)[row[here]] * len(words) + codes[here]
    for j in range(1, k):
        key = np.unique(key, return_inverse=True)[1] * len(words) + codes[here + j]
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    n = np.zeros(len(first), np.int64)
    np.add.at(n, which, rows["n"].to_numpy()[row[here]])
    spot = here[first]
    parts = [words.take(pa.array(codes[spot + j])) for j in range(k)]
    return pa.table({"lang": langs.take(pa.array(row[spot])), "phrase": pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0], "n": n})


def phrase_counts(chunks: DataFrame, k: int, known: Known | None, least: int) -> DataFrame:
    """lang, phrase, n: phrases of ``k`` words with at least ``least`` occurrences."""
    shared = chunks.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        held, size = [], 0

        def flush():
            if size:
                yield from counted(pa.Table.from_batches(held), k, shared.value).to_batches(max_chunksize=50_000)

        for b in batches:
            # A word has a byte and a blank at least, so the bytes bound the words that are held.
            held.append(b)
            size += (pc.sum(pc.binary_length(b.column("chunk"))).as_py() or 0) // 2
            if size >= GATHER:
                yield from flush()
                held, size = [], 0
        yield from flush()

    rows = chunks.mapInArrow(run, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, every: int = EVERY) -> DataFrame:
    """Documents (lang, text) -> lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of each language.

    The score of a phrase is that of its weakest cut, ``UNIT`` * a / (l + r) with the whole count a and those of the parts;
    a phrase that a longer one covers in ``covered`` per cent of its occurrences is left out. Decimals keep it exact."""
    chunks = written(dictionary(docs, every))
    whole = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("_words"))
    levels, known = [], None
    for k in range(1, LONGEST + 1):
        levels.append(written(phrase_counts(chunks, k, known, least)))
        known = Known.of(levels[-1], k) if k < LONGEST else None
    counts = levels[0].unionByName(levels[1]).unionByName(levels[2]).unionByName(levels[3])
    found = levels[1].unionByName(levels[2]).unionByName(levels[3]).withColumnRenamed("n", "a")

    words = F.split("phrase", " ")
    part = lambda start, size: F.struct("lang", F.array_join(F.slice("_w", start, size), " "))
    cuts = found.withColumn("_w", words).select("*", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("_left"), part(F.col("cut") + 1, F.size("_w") - F.col("cut")).alias("_right"))
    side = lambda key, name: counts.select(F.struct("lang", "phrase").alias(key), F.col("n").alias(name))
    both = hot_join(written(cuts), side("_left", "l"), "_left", "phrase", how="inner")
    both = hot_join(written(both), side("_right", "r"), "_right", "phrase", how="inner")
    score = F.expr(f"(cast({UNIT} as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("_b"))

    longer = found.withColumn("_w", words).filter(F.size("_w") > 2)
    inner = longer.select("lang", "a", "_w", F.explode(F.sequence(F.lit(2), F.size("_w") - 1)).alias("_k"))
    inner = inner.select("lang", "a", "_w", "_k", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_k") + 1)).alias("_s"))
    cover = inner.groupBy("lang", F.array_join(F.slice("_w", F.col("_s"), F.col("_k")), " ").alias("phrase")).agg(F.max("a").alias("_cover"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    left = best.join(cover, ["lang", "phrase"], "left").filter(F.col("_cover").isNull() | (100 * big("_cover") < covered * big("a")))
    left = left.select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score").withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = left.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_at") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("_words").cast("long").alias("n"), "score")


def op13_phrases(docs: DataFrame) -> DataFrame:
    return phrases(docs.select("lang", "text"))
