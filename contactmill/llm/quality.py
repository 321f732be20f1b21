"""Quality rules with thresholds that come from the data: quantile sketches per language and source.

Every document is measured; each measure is put into a log-linear bucket (six significant bits, so a value is known to
1/32). The counts per (language, source, measure, bucket) are the sketch: of bounded size, merged by adding, the same for
any split of the rows. A group with fewer than ``MIN_DOCS`` documents takes the sketch merged over its language, and that
one over everything. All thresholds are read from the sketches. A document goes when its mean word length lies further
than three quartile distances outside the quartiles, above or below, or when its share of symbols, repeated lines or
repeated words lies above q90 + 3 * (q90 - q50): most groups have none of these, so that their quartiles coincide; they
stay put while up to a tenth of a group is junk. The only constants are of the order of a bucket: a distance counts as one
bucket at least, and ``LEAST`` per mille of a share, or a single occurrence, are never held against a document.
Thresholds are joined back.

Everything is DataFrame functions. Null texts count as empty; a null language or source is a group of its own; an empty
table gives an empty result; repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactmill.llm.common import hot_join, written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
WINDOW = 5
MIN_DOCS = 50
FENCE = 3
HIGH = 90
#: Measures that are shares (per mille; word length is in hundredths of a character), and the size of a bucket in thousand.
SHARES = ("symbols", "dup_lines", "repeats")
MEASURES = (*SHARES, "word_length")
LEAST = 1000 >> 6


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    names = docs.columns
    t = F.coalesce(F.col(text), F.lit(""))
    one = docs.withColumn("_t", t)
    two = one.select(*names, "_t",
                     F.array_remove(F.split(F.translate("_t", "\t\n\x0b\f\r", " " * 5), " "), "").alias("_words"),
                     F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"))
    three = two.select(*names,
                       F.size("_words").cast("long").alias("n_words"),
                       F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
                       (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                       F.size("_lines").cast("long").alias("n_lines"),
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                       F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    base = [c for c in three.columns if c != "_hashes"]
    # A window is the hash of its five word hashes.
    five = F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))
    four = three.select(*base, F.when(F.size("_hashes") >= WINDOW, five).otherwise(F.array().cast("array<bigint>")).alias("_windows"))
    # Only texts in which a window occurs twice are sorted to find where.
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    at = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    five_ = four.select(*base, F.when(again, at).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")).alias("_at"))
    same = lambda k, x: F.coalesce(F.get(F.col("_at"), k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_at", lambda x, k: same(k - 1, x) | same(k + 1, x))
    starts = five_.select(*base, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_starts"))
    covered = F.aggregate("_starts", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                          lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n")), lambda s: s["n"])
    return starts.select(*base, covered.cast("long").alias("n_repeat_words"))


def rates() -> dict[str, Column]:
    """The measures that thresholds are for, as whole numbers; 0 for a text without words."""
    part = lambda a, b, unit: F.when(F.col(b) > 0, F.floor(F.lit(unit) * F.col(a) / F.col(b))).otherwise(0).cast("long")
    return {"symbols": part("n_symbols", "n_words", 1000), "dup_lines": part("n_dup_lines", "n_lines", 1000),
            "repeats": part("n_repeat_words", "n_words", 1000), "word_length": part("word_chars", "n_words", 100)}


#: The value with all but its six leading bits cleared.
BUCKET = "shiftleft(shiftright(value, cast(greatest(length(bin(value)) - 6, 0) as int)), cast(greatest(length(bin(value)) - 6, 0) as int))"


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in rates().items()])
    rows = measured.select("lang", "source", F.inline(each))
    return rows.groupBy("lang", "source", "measure", F.expr(BUCKET).alias("bucket")).agg(F.count("*").alias("n"))


def _width(bucket: str) -> Column:
    """Number of values in a bucket."""
    return F.expr(f"shiftleft(1L, cast(greatest(length(bin({bucket})) - 6, 0) as int))")


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches merged over ``by`` -> group size, upper fence per measure and the lower one of word length."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bucket")))
    q = ranked.groupBy(*by, "measure").agg(F.max("all").alias("docs"), at(25).alias("q25"), at(50).alias("mid"), at(75).alias("q75"), at(HIGH).alias("high"))
    # A quantile is any value of its bucket: the upper end counts above, the lower one below.
    reach = lambda far, near: FENCE * F.greatest(F.col(far) - F.col(near), _width(far))
    up = lambda far, near: F.col(far) + _width(far) - 1 + reach(far, near)
    fence = F.when(F.col("measure").isin(*SHARES), F.greatest(up("high", "mid"), F.lit(LEAST))).otherwise(up("q75", "q25"))
    return q.groupBy(*by).agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("measure") == m, fence)).alias(f"max_{m}") for m in MEASURES],
                              F.max(F.when(F.col("measure") == "word_length", F.col("q25") - reach("q75", "q25"))).alias("min_word_length"))


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) with the fences of each measure."""
    sketch = written(sketches(measured))
    own, lang = fences(sketch, ["lang", "source"]).alias("o"), fences(sketch, ["lang"]).alias("l")
    every = fences(sketch, []).first()
    names = [*[f"max_{m}" for m in MEASURES], "min_word_length"]
    both = own.join(lang, F.col("o.lang").eqNullSafe(F.col("l.lang")), "left")
    pick = lambda c: F.when(F.col("o.docs") >= MIN_DOCS, F.col(f"o.{c}")).when(F.col("l.docs") >= MIN_DOCS, F.col(f"l.{c}")).otherwise(F.lit(every[c]).cast("long"))
    return both.select(F.struct("o.lang", "o.source").alias("_group"), *[pick(c).alias(c) for c in names])


def judged(measured: DataFrame) -> DataFrame:
    """Measured rows (written ones: they are read twice) with ``base_failed``, ``kept`` and the thresholds used."""
    rows = measured.withColumn("_group", F.struct("lang", "source"))
    both = hot_join(rows, thresholds(measured), "_group", "doc_id", how="inner")
    fine = None
    once = {"symbols": F.col("n_symbols") <= 1, "dup_lines": F.col("n_dup_lines") <= 1, "repeats": F.col("n_repeat_words") <= 2 * WINDOW}
    for m, v in rates().items():
        ok = (v <= F.col(f"max_{m}")) | once.get(m, F.lit(False))
        fine = ok if fine is None else fine & ok
    fine = fine & (rates()["word_length"] >= F.col("min_word_length"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return both.withColumn("base_failed", failed).withColumn("kept", ~failed & fine).drop("_group")


def op7_quality(docs: DataFrame) -> DataFrame:
    measured = written(measures(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judged(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def good_documents(docs: DataFrame) -> DataFrame:
    """Documents that pass, with all their columns."""
    names = docs.columns
    at = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*at.values()).select("*", *[F.col(at[c]).alias(c) for c in ("doc_id", "lang", "source", "text")])
    kept = judged(written(measures(plain).drop("text"))).filter("kept")
    return kept.select(*[F.col(c).alias(n) for n, c in at.items()])
