"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages around them.

1. Own words. An n-gram (three words, lower-cased, punctuation stripped) that more than ``TEMPLATE`` items share is part of a
   template. An item's own words are those under no such n-gram; only they count for its score. An item without own words
   (all of it is shared) counts with all its words and seeds with n-grams of ``WHOLE`` words.
2. Seeds. Of its other n-grams every item gives those that at most ``max_items`` items have, and the rarest one of every
   stretch of ``STRETCH``. So a seed leads to ``TEMPLATE`` items at most, and text that only follows a template to none.
3. Passages. Bit tables (``SEED_BITS`` bits and two places a seed, 16 MB at most in all; they are all that is broadcast, and
   only say which n-grams are worth a join) tell which n-grams of a document can be seeds. Neighbouring hits form one passage with a margin on both
   sides; documents without a hit leave nothing behind. Items are dealt into classes by length (up to 64 words, 256, ...);
   the margin, and the gap at which passages part, is the longest length of the class: a wider gap costs an alignment more
   than either side of it can bring, and a long item widens no passage of the others.
4. Join. The passages' possible seeds meet the seeds of their class on the hash; this gives (passage, item) candidates, each
   once.
5. Alignment. Local alignment over words (match 2, mismatch and gap -1; template words give nothing and may be skipped free),
   many pairs at a time. The score of a pair is its best local score over that of the item's full copy; ``matched`` tells
   how many own words the alignment has in common.

A document is contaminated when the score reaches ``threshold`` for some item; of an item longer than ``LONG`` words, a
passage that scores as much as ``threshold`` asks of an item of ``LONG`` words is enough. Nulls and empty texts have no seed; an
item without words is never found; items with fewer words than the n-gram seed with all of them. Repeated rows are
judged each on its own; an empty table on either side gives an empty result; very long texts are cut into passages like any
other. `clean_documents` keeps all columns under their names, whatever they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactmill.llm.common import hot_join, text_key, written

GRAM = 3
MAX_ITEMS = 2
TEMPLATE = 8
WHOLE = 12
MOST_BITS = 1 << 27
SEED_BITS = 512
MARGIN = 64
WIDER = 4
STRETCH = 8
THRESHOLD = 0.5
LONG = 128
#: Words that must be matched (all of them, in a shorter item).
MIN_MATCHED = 8
MATCH, MISS, GAP = 2, -1, -1
_TOKEN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def word_hashes(ws: list[str], known: dict) -> np.ndarray:
    """64-bit hash of every word; ``known`` remembers frequent words between texts."""
    if len(known) > 500_000:
        known.clear()
    out = []
    for w in ws:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, np.uint64)


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hash of every run of n words (of all words, where there are fewer)."""
    n = min(n, len(h))
    if n == 0:
        return np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        g = (g ^ h[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return g.view(np.int64)


def length_class(n: int) -> int:
    """0 for items of up to ``MARGIN`` words, 1 up to ``WIDER`` times that, and so on."""
    c = 0
    while MARGIN * WIDER ** c < n:
        c += 1
    return c


def item_grams(items: DataFrame, n: int = GRAM) -> DataFrame:
    """item, text -> item, gram, pos, cls: every n-gram of every item, with the class of the item's length."""
    def run(batches):
        known: dict = {}
        for b in batches:
            ids, out, at, kind = [], [], [], []
            for i, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                ws = words(t)
                g = grams(word_hashes(ws, known), n)
                ids += [i] * len(g)
                out += g.tolist()
                at += range(len(g))
                kind += [length_class(len(ws))] * len(g)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64()), pa.array(at, pa.int32()), pa.array(kind, pa.int32())], ["item", "gram", "pos", "cls"])

    return items.select("item", "text").mapInArrow(run, "item long, gram long, pos int, cls int")


def with_items(each: DataFrame) -> DataFrame:
    """Adds ``n``, in how many items the n-gram is."""
    n = each.select("item", "gram").distinct().groupBy("gram").agg(F.count("*").alias("n"))
    return hot_join(each, n, "gram", "item", how="inner")


def seeds_and_own(items: DataFrame, max_items: int = MAX_ITEMS, template: int = TEMPLATE) -> tuple[DataFrame, DataFrame]:
    """(item, gram, cls, size) seeds, and (item, shared) the places of each item's template n-grams. Runs jobs."""
    each = written(with_items(written(item_grams(items))))
    own = each.filter(F.col("n") <= template)
    place = F.row_number().over(Window.partitionBy("item", F.floor(F.col("pos") / STRETCH)).orderBy("n", "gram"))
    seed = own.withColumn("place", place).filter((F.col("n") <= max_items) | (F.col("place") == 1)).select("item", "gram", "cls", F.lit(GRAM).alias("size"))
    shared = each.filter(F.col("n") > template).groupBy("item").agg(F.array_sort(F.collect_set("pos")).alias("shared"))
    # Items of which every n-gram is shared: the rarest of their longer ones.
    none = items.join(own.select("item").distinct(), "item", "left_anti")
    long = with_items(written(item_grams(none, WHOLE)))
    least = F.min("n").over(Window.partitionBy("item"))
    long = long.withColumn("least", least).filter(F.col("n") == F.col("least")).select("item", "gram", "cls", F.lit(WHOLE).alias("size"))
    return written(seed.unionByName(long).distinct()), written(shared.join(none.select("item"), "item", "left_anti"))


def first_place(gram: np.ndarray, bits: int) -> np.ndarray:
    """One of the two places of n-grams in a table of ``bits`` bits."""
    return gram.view(np.uint64) % np.uint64(bits)


def second_place(gram: np.ndarray, bits: int) -> np.ndarray:
    g = gram.view(np.uint64)
    return ((g ^ (g >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bits)


def held(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def seed_tables(seed: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """(size, class) -> bit table of its seeds. Slots of 64 bits that hold a seed reach the driver."""
    sizes = {(r["size"], r["cls"]): r["n"] for r in seed.groupBy("size", "cls").agg(F.countDistinct("gram").alias("n")).collect()}
    bits = {k: min(MOST_BITS // len(sizes), 1 << max(16, (SEED_BITS * n - 1).bit_length())) // 64 * 64 for k, n in sizes.items()}

    def run(batches):
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "cls")], 1)
            gram = b.column("gram").to_numpy(zero_copy_only=False)
            for k in {tuple(x) for x in keys.tolist()}:
                own = gram[(keys == k).all(1)]
                at = np.concatenate([first_place(own, bits[k]), second_place(own, bits[k])])
                slot, where = np.unique(at >> np.uint64(6), return_inverse=True)
                mask = np.zeros(len(slot), np.uint64)
                np.bitwise_or.at(mask, where, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array([k[0]] * len(slot), pa.int32()), pa.array([k[1]] * len(slot), pa.int32()), pa.array(slot.astype(np.int64)), pa.array(mask.view(np.int64))],
                                                 ["size", "cls", "slot", "mask"])

    spots = seed.select("size", "cls", "gram").mapInArrow(run, "size int, cls int, slot long, mask long").groupBy("size", "cls", "slot").agg(F.bit_or("mask").alias("mask"))
    out = {k: np.zeros(n // 64, np.uint64) for k, n in bits.items()}
    got = spots.toArrow()
    size, cls, slot, mask = (got[c].to_numpy() for c in ("size", "cls", "slot", "mask"))
    for k, table in out.items():
        here = (size == k[0]) & (cls == k[1])
        table[slot[here]] = mask[here].view(np.uint64)
    return out


def passages(docs: DataFrame, tables: dict) -> DataFrame:
    """_row, _id, text -> _row, _id, cls, _part, at (first word), text (the passage's words), grams (possible seeds in it)."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        tables, known = shared.value, {}
        for b in batches:
            out = ([], [], [], [], [], [], [])
            for row, own, t in zip(*(b.column(c).to_pylist() for c in ("_row", "_id", "text"))):
                ws = words(t)
                h = word_hashes(ws, known)
                made: dict = {}
                for (size, cls), bits in tables.items():
                    g = made[size] if size in made else made.setdefault(size, grams(h, size))
                    hit = np.flatnonzero(held(bits, first_place(g, len(bits) * 64)))
                    hit = hit[held(bits, second_place(g[hit], len(bits) * 64))]
                    if not len(hit):
                        continue
                    margin = MARGIN * WIDER ** cls
                    cuts = np.flatnonzero(np.diff(hit) > margin) + 1
                    for k, part in enumerate(np.split(hit, cuts)):
                        a, z = max(0, int(part[0]) - margin), int(part[-1]) + size + margin
                        for col, v in zip(out, (row, own, cls, k * (WHOLE + 1) + size, a, " ".join(ws[a:z]), np.unique(g[part]).tolist())):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))],
                                             ["_row", "_id", "cls", "_part", "at", "text", "grams"])

    return docs.select("_row", "_id", "text").mapInArrow(run, "_row long, _id long, cls int, _part long, at long, text string, grams array<long>")


def own_words(n: int, shared: list[int] | None) -> np.ndarray:
    """Which of an item's ``n`` words are its own: those under no template n-gram (all of them, if that leaves none)."""
    own = np.ones(n, bool)
    for p in shared or []:
        own[p:p + GRAM] = False
    return own if own.any() else np.ones(n, bool)


def align(pairs: list[tuple]) -> list[tuple[int, int]]:
    """Best local alignment of each (item words, passage words), or of these and which words are the item's own (without it
    all are): (score, own words matched). All pairs step together."""
    if not pairs:
        return []
    ids: dict = {}
    n, la, lb = len(pairs), max(len(p[0]) for p in pairs), max(len(p[1]) for p in pairs)
    A, B, own = np.full((n, la), -1, np.int32), np.full((n, lb), -2, np.int32), np.ones((n, la), bool)
    for i, (a, b, *mine) in enumerate(pairs):
        own[i, :len(a)] = mine[0] if mine else True
        A[i, :len(a)] = [ids.setdefault(w, len(ids)) for w in a]
        B[i, :len(b)] = [ids.setdefault(w, len(ids)) for w in b]
    # The score is kept in the high part of a number, the words matched in the low part: one maximum settles both.
    unit, step = np.int64(1 << 20), np.arange(lb + 1, dtype=np.int64) * np.int64(1 << 20)
    row, best = np.zeros((n, lb + 1), np.int64), np.zeros(n, np.int64)
    for j in range(la):
        same = A[:, j:j + 1] == B
        new = np.zeros_like(row)
        mine = own[:, j:j + 1]
        new[:, 1:] = np.maximum(np.where(same, row[:, :-1] + mine * (MATCH * unit + 1), row[:, :-1] + MISS * unit), row[:, 1:] + mine * (GAP * unit))
        np.maximum(new, 0, out=new)
        # A gap along the passage costs one per word: a running maximum of score plus distance.
        new = np.maximum(np.maximum.accumulate(new + step, axis=1) - step, 0)
        best = np.maximum(best, new.max(axis=1))
        row = new
    return [(int(x) >> 20, int(x) & 0xFFFFF) for x in best]


def near_hits(item: list[str], passage: list[str], known: dict) -> list[list[str]]:
    """The parts of a long passage around the n-grams that it shares with the item. Made for the longest item, the passage
    may hold much that a shorter one cannot reach."""
    reach = max(MARGIN, len(item))
    hit = np.flatnonzero(np.isin(grams(word_hashes(passage, known), min(GRAM, len(item))), grams(word_hashes(item, known))))
    if len(passage) <= 4 * reach or not len(hit):
        return [passage]
    return [passage[max(0, int(p[0]) - reach):int(p[-1]) + GRAM + reach] for p in np.split(hit, np.flatnonzero(np.diff(hit) > reach) + 1)]


KEYS = ["_row", "_id", "item_id", "at"]


def scored(pairs: DataFrame) -> DataFrame:
    """KEYS, passage, item_text, shared -> KEYS, score, matched, item_words, own_words."""
    def run(batches):
        known: dict = {}
        for b in batches:
            got, of, whole, mine = [], [], [], []
            for x, y, shared in zip(*(b.column(c).to_pylist() for c in ("item_text", "passage", "shared"))):
                item = words(x)
                own = own_words(len(item), shared)
                for part in near_hits(item, y.split(" "), known):
                    got.append((item, part, own))
                    of.append(len(whole))
                whole.append(len(item))
                mine.append(int(own.sum()))
            order = sorted(range(len(got)), key=lambda i: (len(got[i][1]), len(got[i][0])))
            res, start = [(0, 0)] * len(whole), 0
            while start < len(order):
                end = start + 1
                while end < len(order) and (end - start + 1) * (len(got[order[end]][1]) + 1) <= 200_000:
                    end += 1
                for i, r in zip(order[start:end], align([got[i] for i in order[start:end]])):
                    res[of[i]] = max(res[of[i]], r)
                start = end
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in KEYS], pa.array([s / max(1, MATCH * f) for (s, _), f in zip(res, mine)], pa.float64()),
                 pa.array([m for _, m in res], pa.int64()), pa.array(whole, pa.int64()), pa.array(mine, pa.int64())], [*KEYS, "score", "matched", "item_words", "own_words"])

    return pairs.select(*KEYS, "passage", "item_text", "shared").mapInArrow(run, "_row long, _id long, item_id long, at long, score double, matched long, item_words long, own_words long")


def matches(rows: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rows``: _row (unique, or the same for equal texts), _id (carried along) and text -> _row, _id, item_id, score, matched, item_words, at (first
    word of the passage), own_words: the best passage of every document and item that is enough. Items of equal text are
    one item, with the smallest id. Runs jobs: items, seeds and passages are written."""
    items = written(benchmark.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").cast("long").alias("item_id")).withColumn("item", F.xxhash64("text")))
    seed, shared = seeds_and_own(items)
    found = written(passages(rows.filter(F.col("text").isNotNull()), seed_tables(seed)))
    place = ["_row", "_id", "cls", "_part"]
    found = found.dropDuplicates(place)
    one = found.select(*place, F.explode("grams").alias("gram")).join(seed.select("item", "gram", "cls"), ["gram", "cls"]).select(*place, "item").distinct()
    there = found.select("_row", F.col("_id").alias("_i"), "cls", "_part", "at", F.col("text").alias("passage"))
    pairs = (one.join(there, ["_row", "cls", "_part"]).filter(F.col("_id").eqNullSafe(F.col("_i"))).drop("_i")
             .join(items.select("item", "item_id", F.col("text").alias("item_text")).join(shared, "item", "left"), "item"))
    enough = (F.col("score") >= threshold) | ((F.col("own_words") > LONG) & (F.col("score") * F.col("own_words") >= threshold * LONG))
    good = scored(pairs).filter(enough & (F.col("matched") >= F.least(F.lit(MIN_MATCHED), F.col("own_words"))))
    best = F.max(F.struct("score", "matched", "item_words", "at", "own_words")).alias("m")
    return good.groupBy("_row", "_id", "item_id").agg(best).select("_row", "_id", "item_id", "m.*")


def op9_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").alias("_id"), "text")
    return matches(rows, benchmark).select(F.col("_id").alias("doc_id"), "item_id", "score", "matched", "item_words", F.col("at").alias("passage_word"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a benchmark item, with all their columns."""
    names = docs.columns
    at = {n: f"c{i}" for i, n in enumerate(names)}
    one, two = text_key(F.col(at["text"]))
    rows = docs.toDF(*at.values()).select("*", one.alias("_row"), two.alias("_id"))
    # Whether a document goes depends on its text alone, so equal texts may share a key.
    bad = written(matches(rows.select("_row", "_id", F.col(at["text"]).alias("text")), benchmark).select("_row", "_id").distinct())
    return rows.join(bad, ["_row", "_id"], "left_anti").select(*[F.col(c).alias(n) for n, c in at.items()])
