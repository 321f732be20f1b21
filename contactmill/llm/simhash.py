"""SimHash near-duplicates by ball hashing in the middle.

A fingerprint has 64 bits; two link when they differ in at most 3. Split in two halves of 32 bits, linked fingerprints
differ by at most one bit, half the radius, in one of them. So every distinct fingerprint emits, for each half, all 33
variants of that half within one bit; variants are shuffled and meet the fingerprints that have exactly that half.
Colliding pairs are verified on all 64 bits and deduplicated. (Variants of the whole fingerprint would be 2,081 per
fingerprint, for the one side that must reach two bits; the halves need 66.)

A half shared by more than ``dense`` distinct fingerprints would give all their pairs. Inside such a half the balls are
formed again, on the other half: whoever reaches the same middle is within three bits, so all link to the smallest
fingerprint there, one link each. No link is lost and nothing is squared.

The filter (`one_of_each`) also removes near copies whose five-word shingles agree to 0.8 or more; most of those differ in
more than three bits. They come from an exact prefix join: shingles have one order for all texts, frequent ones last; of n
shingles a text keeps the first n // 5 + 1, and two texts that agree to 0.8 have one of those in common, at places that
leave enough shingles behind it. The order is learnt from a bounded sample and decides the cost only: under any order
every such pair is met. Texts that share a shingle are first compared with the one that has it earliest, twice; after
that only texts of different components are, so a large group of near copies gives a few links for each text. A pair is
first tested on a few bytes for each text that bound how far their shingles differ; only the texts of pairs that pass are
read again and compared. Tables of a step go when the next one has what it needs.

Nulls and texts without a word have fingerprint zero, linked like any other. Repeated rows each get their row. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType
from pyspark.sql.window import Window

from contactmill.functions.graph import connected
from contactmill.llm.common import forget, hot_join, text_key, written
from contactmill.llm.decontaminate import first_place, grams, held, second_place, seed_tables

SEED = 42
RADIUS = 3
DENSE = 256
SIMILARITY = 0.8
SHINGLE = 5
LOW = 0xFFFFFFFF
#: Texts from which the order of shingles is learnt, and frequent shingles that it knows.
SAMPLE = 20_000
FREQUENT = 1 << 17
#: Bits of `odd_bits`, at least and at most.
ODD_BITS = (64, 1 << 16)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint of UTF-8 bytes: bytes lower-case and split on exactly the ASCII letters and white
    space that the definition names."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    last = ends[min(width, len(words)) - 1:].tolist()
    h = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[i:i + 65536], last[i:i + 65536])], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def shingle_hashes(text: bytes | None, known: dict) -> np.ndarray:
    """64-bit hashes of the distinct five-word shingles (of all words, where there are fewer), sorted; ``known`` remembers
    the hashes of words between texts."""
    ws = text.lower().split() if text else []
    if len(known) > 500_000:
        known.clear()
    own = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w, SEED)) for w in ws], np.uint64)
    return np.unique(grams(own, SHINGLE)) if ws else np.zeros(1, np.int64)


def frequent_shingles(texts: DataFrame, n: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Texts ``_bytes`` with ``_doc`` and ``_k1`` -> sorted hashes of frequent shingles, and for each the power of two of its
    frequency in a sample of about ``n`` rows. Only the order of shingles depends on it."""
    share = min(1.0, n / max(1, texts.count()))
    part = F.pmod(F.xxhash64("_doc", "_k1"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches):
        known: dict = {}
        for b in batches:
            got = [shingle_hashes(x.as_py(), known) for x in b.column("_bytes")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got) if got else [], pa.int64())], ["h"])

    some = texts.withColumn("_part", part).filter(F.col("_part") < share).select("_bytes").mapInArrow(run, "h long")
    often = some.groupBy("h").agg(F.count("*").alias("n")).filter("n >= 4").orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    often = often.sort_values("h")
    return often["h"].to_numpy(np.int64), np.log2(often["n"].to_numpy(np.float64)).astype(np.int64)


def prefix(h: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a text in the order of all texts: those that a text of similarity 0.8 must share one of."""
    last = np.zeros(len(h), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        last = np.where(often[at] == h, rank[at], 0)
    return h[np.lexsort((h, last))][:len(h) // 5 + 1]


def odd_bits(h: np.ndarray) -> bytes:
    """One bit for each place that an odd number of a text's shingles fall on, with about as many places as shingles. A
    shingle that only one of two texts has changes one bit: texts differ in at least as many shingles as bits."""
    places = min(max(ODD_BITS[0], 1 << (len(h) - 1).bit_length()), ODD_BITS[1])
    count = np.bincount((h & (places - 1)).astype(np.int64), minlength=places)
    return np.packbits(count & 1 == 1).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two of `odd_bits` differ, the longer one folded to the length of the other."""
    x, y = (np.frombuffer(z, np.uint8) for z in (x, y))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def with_fingerprint(df: DataFrame, width: int = 3, order: tuple | None = None) -> DataFrame:
    """Replace the binary column ``_bytes`` by ``_fp``; other columns pass unchanged. With ``order`` (of
    `frequent_shingles`) also ``_s1``, ``_s2`` (what stands for the set of shingles), ``_n`` (its size), ``_sig`` (its prefix) and ``_odd`` (`odd_bits`)."""
    names = [c for c in df.columns if c != "_bytes"]
    shared = df.sparkSession.sparkContext.broadcast(order) if order is not None else None
    more = [("_s1", pa.int64()), ("_s2", pa.int64()), ("_n", pa.int64()), ("_sig", pa.list_(pa.int64())), ("_odd", pa.binary())] if order is not None else []

    def run(batches):
        known: dict = {}
        for b in batches:
            texts = [x.as_py() for x in b.column("_bytes")]
            new = [pa.array([fingerprint(t, width) for t in texts], pa.int64())]
            if shared is not None:
                often, rank = shared.value
                got = []
                for t in texts:
                    h = shingle_hashes(t, known)
                    raw = h.tobytes()
                    two = [int(np.uint64(xxhash.xxh64_intdigest(raw, k)).view(np.int64)) for k in (1, 2)]
                    got.append((*two, len(h), prefix(h, often, rank), odd_bits(h)))
                new += [pa.array([g[i] for g in got], ty) for i, (_, ty) in enumerate(more)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *new], [*names, "_fp", *[c for c, _ in more]])

    schema = df.select(*[F.col(f"`{c}`") for c in names]).schema.add("_fp", "long")
    for c, _ in more:
        schema = schema.add(c, {"_sig": ArrayType(LongType()), "_odd": BinaryType()}.get(c, LongType()))
    return df.mapInArrow(run, schema)


def _masks(radius: int) -> list[int]:
    out, last = [0], [0]
    for _ in range(radius):
        last = sorted({m | 1 << i for m in last for i in range(32) if not m >> i & 1})
        out += last
    return out


def _array(values) -> F.Column:
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")


def thick_keys(centres: DataFrame, dense: int) -> DataFrame:
    """Keys that more than ``dense`` fingerprints have. Written, so that Spark knows how few they are and need not shuffle
    the variants for them."""
    return written(centres.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > dense).select("key"))


def links(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """Distinct fingerprints ``_fp`` -> links ``a``, ``b``: enough of the pairs within three bits to connect all of them
    (every pair, but for those of a dense half, which are linked through a common middle)."""
    low, high = F.col("_fp").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("_fp", 32)
    tag = F.lit(1 << 32)
    centres = nodes.select("_fp", F.explode(F.array(low, high + tag)).alias("key"))
    near = _array(_masks(1))
    ball = nodes.select("_fp", F.explode(F.concat(F.transform(near, lambda m: low.bitwiseXOR(m)),
                                                  F.transform(near, lambda m: high.bitwiseXOR(m) + tag))).alias("key"))
    thick = thick_keys(centres, dense)
    c = centres.withColumnRenamed("_fp", "b")
    pairs = (ball.join(thick, "key", "left_anti").withColumnRenamed("_fp", "a").join(c, "key")
             .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b"))
    first = F.col("key") < tag
    own, other = F.when(first, low).otherwise(high + tag), F.when(first, high).otherwise(low)
    packed = ball.join(thick, "key", "left_semi").select("_fp", "key", (own == F.col("key")).alias("same"), other.alias("other"))
    wide = F.explode(F.when(F.col("same"), _array(_masks(2))).otherwise(near)).alias("mask")
    met = packed.select("_fp", "key", "same", "other", wide).select(
        "_fp", "key", F.col("other").bitwiseXOR(F.col("mask")).alias("middle"), (F.col("same") & (F.bit_count("mask") <= 1)).alias("centre"))
    hub = F.min(F.when(F.col("centre"), F.col("_fp"))).over(Window.partitionBy("key", "middle"))
    star = met.select("_fp", hub.alias("hub")).filter(F.col("hub") != F.col("_fp")).select(
        F.least("_fp", "hub").alias("a"), F.greatest("_fp", "hub").alias("b"))
    return pairs.unionByName(star).distinct()


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """``_row``, ``_n``, ``_sig`` -> ``h``, ``id``, ``n``, ``pos`` of the prefix shingles that two or more texts have. One
    shuffle; a frequent shingle takes part in it with one short row for each text."""
    each = nodes.select(F.col("_row").alias("id"), "_n", F.posexplode("_sig").alias("pos", "h"))
    each = each.select("h", "id", (F.shiftleft("_n", 31) + F.col("pos")).alias("at"))
    own = each.withColumn("many", F.count("*").over(Window.partitionBy("h"))).filter("many > 1")
    return own.select("h", "id", F.shiftright("at", 31).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).alias("pos"))


def may_agree(n, i, m, j):
    """Whether texts of n and m shingles can agree to 0.8 where their first common one stands at i and j."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - i, m - j) >= 4 * (n + m))


def met(live: DataFrame, roots: DataFrame | None, step: int, made: list | None = None) -> DataFrame:
    """Shared shingles and the components so far (``node``, ``root``) -> pairs ``a``, ``b`` of texts of different
    components that may agree. Step 1: each text with the one that has the shingle earliest; 2: the texts outside that
    one's component with the earliest of themselves; 3: these with all others. ``made`` gets the table that is written."""
    rows = live.withColumn("comp", F.col("id"))
    if roots is not None:
        named = hot_join(live, roots.select(F.col("node").alias("id"), "root"), "id", "h")
        rows = named.withColumn("comp", F.coalesce("root", "id")).drop("root")
    lead = F.min(F.struct("pos", "id", "n", "comp")).over(Window.partitionBy("h"))
    rows = rows.withColumn("lead", lead)
    rest = rows.filter("comp <> lead.comp")
    if step == 2:
        rest = rest.withColumn("lead", lead).filter("comp <> lead.comp")
    if step < 3:
        found = rest.select("id", "n", "pos", F.col("lead.id").alias("id_"), F.col("lead.n").alias("n_"), F.col("lead.pos").alias("pos_"))
    else:
        other = rows.select("h", *[F.col(c).alias(c + "_") for c in ("id", "n", "pos", "comp")])
        few = written(rest.select("h", "id", "n", "pos", "comp", F.col("lead.comp").alias("main")))
        if made is not None:
            made.append(few)
        found = few.join(other, "h").filter((F.col("comp") != F.col("comp_")) & ((F.col("comp_") == F.col("main")) | (F.col("id") < F.col("id_"))))
    found = found.filter(may_agree(F.col("n"), F.col("pos"), F.col("n_"), F.col("pos_")))
    return found.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def shingle_set(text: bytes | None) -> set:
    words = text.lower().split() if text else []
    return {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def similar(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, ta, tb (UTF-8) -> a, b of the pairs whose distinct five-word shingles agree to ``similarity``."""
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                p, q = shingle_set(x), shingle_set(y)
                n = len(p & q)
                ok.append(n >= similarity * (len(p) + len(q) - n))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def not_too_far(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` without those whose `odd_bits` differ in too many bits for texts that agree to 0.8."""
    def run(batches):
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("na", "nb", "oa", "ob"))
            ok = [9 * bits_apart(x, y) <= n + m for n, m, x, y in zip(*cols)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    t = lambda x: nodes.select(F.col("_row").alias(x), F.col("_n").alias("n" + x), F.col("_odd").alias("o" + x))
    return pairs.join(t("a"), "a").join(t("b"), "b").select("a", "b", "na", "nb", "oa", "ob").mapInArrow(run, "a long, b long")


ROW = ["_none", "_doc", "_k1", "_k2"]


def texts_of(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``_row``, ``t`` of the texts in ``pairs`` (not empty). A bit table (16 MB at most) of their keys leaves most others
    out before the shuffle. Runs jobs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct()
    wanted = written(nodes.select("_row", *ROW).join(ids, "_row"))
    table = seed_tables(wanted.select(F.lit(0).alias("size"), F.lit(0).alias("cls"), F.col("_k1").alias("gram")))[0, 0]
    shared = pairs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def asked(key: pd.Series) -> pd.Series:
        bits, k = shared.value, key.to_numpy(np.int64)
        return pd.Series(held(bits, first_place(k, len(bits) * 64)) & held(bits, second_place(k, len(bits) * 64)))

    return written(texts.filter(asked("_k1")).join(wanted, ROW).select("_row", "t").dropDuplicates(["_row"]))


def near_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows with ``_row`` (unique), ``_fp``, what `ROW` names (the document and the key of its text) and what
    `with_fingerprint` adds, and texts with `ROW` and ``t`` -> links between fingerprints that connect all texts whose
    shingles agree to ``SIMILARITY``. Texts of the same shingles are linked to the first of them, which alone goes on."""
    spark = rows.sparkSession
    first = F.min(F.struct("_row", "_fp", *ROW, "_n", "_sig", "_odd")).alias("n")
    whole = written(rows.groupBy("_s1", "_s2").agg(first).select("_s1", "_s2", "n.*"))
    forget(spark)
    live = written(shared_shingles(whole))
    nodes = written(whole.drop("_sig"))
    forget(spark, whole)
    same = rows.select("_s1", "_s2", F.col("_fp").alias("b")).distinct().join(nodes.select("_s1", "_s2", F.col("_fp").alias("a")), ["_s1", "_s2"])
    sure = tested = roots = None
    made = [nodes, live]
    for step in (1, 2, 3):
        pairs = met(live, roots, step, made)
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        good = written(not_too_far(pairs, nodes))
        made += [pairs, good]
        forget(spark)
        if not good.isEmpty():
            t = texts_of(good, nodes, texts)
            forget(spark)
            side = lambda x: t.select(F.col("_row").alias(x), F.col("t").alias("t" + x))  # noqa: E731, B023
            good = written(similar(good.join(side("a"), "a").join(side("b"), "b")))
            made.append(good)
            forget(spark, t)
        sure = good if sure is None else sure.unionByName(good)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if step < 3:
            roots = written(connected(sure))
            made.append(roots)
    fp = lambda x: nodes.select(F.col("_row").alias(x), F.col("_fp").alias("f" + x))
    named = sure.join(fp("a"), "a").join(fp("b"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    out = written(named.unionByName(same.select("a", "b")).filter("a <> b").distinct())
    forget(spark, *made)
    return out


def labelled(rows: DataFrame, first, more: DataFrame | None = None, dense: int = DENSE) -> DataFrame:
    """Rows with ``_fp`` -> ``_fp``, ``_first``: for every fingerprint the smallest ``first`` of its component, over the
    links of the fingerprints and those in ``more``."""
    nodes = rows.groupBy("_fp").agg(F.min(first).alias("_first"))
    edges = links(nodes.select("_fp"), dense)
    roots = written(connected(edges if more is None else edges.unionByName(more).distinct()))
    linked = roots.join(nodes, roots["node"] == nodes["_fp"])
    least = linked.groupBy("root").agg(F.min("_first").alias("_least"))
    named = roots.join(least, "root").select(F.col("node").alias("_fp"), "_least")
    return nodes.join(named, "_fp", "left").select("_fp", F.coalesce("_least", "_first").alias("_first"))


def op6_simhash(docs: DataFrame) -> DataFrame:
    rows = written(with_fingerprint(docs.select("doc_id", F.col("text").cast("binary").alias("_bytes"))))
    out = hot_join(rows, labelled(rows, F.col("doc_id")), "_fp", "doc_id", how="inner")
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_first").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents -> one row of every group of copies and near copies, the one with the smallest doc_id (of repeated rows,
    one); columns kept. Fingerprints within three bits link, and so do texts of similar shingles."""
    names = docs.columns
    at = {n: f"c{i}" for i, n in enumerate(names)}
    text, own = F.col(at["text"]), F.col(at["doc_id"])
    one, two = text_key(text)
    plain = docs.toDF(*at.values()).select("*", one.alias("_k1"), two.alias("_k2"))
    # Fingerprints are written without the texts; a row is known by its doc_id and the key of its text.
    slim = plain.select(own.isNull().alias("_none"), F.coalesce(own.cast("long"), F.lit(0)).alias("_doc"), "_k1", "_k2", text.cast("binary").alias("_bytes"))
    rows = written(with_fingerprint(slim.withColumn("_row", F.monotonically_increasing_id()), order=frequent_shingles(slim)))
    forget(docs.sparkSession)
    named = plain.select("*", own.isNull().alias("_none"), F.coalesce(own.cast("long"), F.lit(0)).alias("_doc"))
    more = near_links(rows, named.select(*ROW, text.cast("binary").alias("t")))
    chosen = labelled(rows.select("_fp", *ROW), F.struct(*ROW), more).select("_first.*").distinct()
    often = rows.groupBy(*ROW).agg(F.count("*").alias("n")).filter("n > 1").drop("n").withColumn("_often", F.lit(True))
    chosen = written(chosen.join(often, ROW, "left").withColumn("_often", F.coalesce("_often", F.lit(False))))
    forget(docs.sparkSession, rows, more)
    kept = named.join(chosen, ROW)
    # Of rows that repeat id and text, one stays; only those are compared once more.
    kept = kept.filter("not _often").unionByName(kept.filter("_often").dropDuplicates(ROW))
    return kept.select(*[F.col(c).alias(n) for n, c in at.items()])
