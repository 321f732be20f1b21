"""Mixing sources to target weights by systematic sampling.

Within a source the expected copies of its documents (target words / words of the source) are summed up in order of
size; one offset per source is added, and a document is emitted once for every integer boundary its interval crosses.
In order of size the error of the words taken telescopes: it stays below the size of the largest document.

Nulls: a null source is a source of its own (last); a null text has size 0. Repeated rows are documents of their own.
Sources without words get the target 0 and emit nothing. An empty table gives an empty result. The result depends on
the rows alone: the offset is drawn from a digest of the source's name, ties in size go by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactmill.llm.common import n_words, ranked, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0


def source_offset(source) -> Column:
    """Offset in [0, 1) drawn from the name."""
    return F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def running(df: DataFrame, order: str, **sums: str) -> DataFrame:
    """Sums over all earlier rows by ``rank`` (a dense number from 1), block by block, so that no task holds all rows."""
    block = F.floor((F.col(order) - 1) / 4096)
    df = df.withColumn("_block", block)
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    outer = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_o_{n}") for n in sums])
    for n, c in sums.items():
        df = df.withColumn(n, F.coalesce(F.sum(c).over(inner), F.lit(0)))
    df = df.join(totals, "_block")
    return df.select(*[c for c in df.columns if c not in sums and not c.startswith("_")],
                     *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Source sizes (source, source_size) -> source, source_size, target.

    Sources in code point order (null last) take ``weights`` in turn and share ``share`` of all words; a target stops at
    ``cap`` times its source and the excess is shared anew. The fixed point is found in one pass: in order of
    size / weight the capped sources come first, and the rest share what those leave at one rate."""
    named = ranked(sizes, [], ["source"])
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank_in_group") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = named.withColumn("weight", weight.cast("long")).drop("rank_in_group").withColumn("ratio", F.col("source_size") / F.col("weight"))
    by_ratio = running(ranked(named, [], ["ratio", "source"]), "rank_in_group", size_before="source_size", weight_before="weight")
    whole = by_ratio.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight")).first()
    all_size, all_weight = whole["all_size"] or 0, whole["all_weight"] or 1
    by_ratio = written(by_ratio.withColumn("rate", (F.lit(share * all_size) - cap * F.col("size_before")) / (F.lit(all_weight) - F.col("weight_before"))))
    # The first source whose cap is not below the rate at its place starts the uncapped ones.
    rate = by_ratio.filter(F.col("rate") <= cap * F.col("ratio")).agg(F.min(F.struct("rank_in_group", "rate")).alias("m")).first()["m"]
    limit = F.col("source_size") * F.lit(cap)
    target = limit if rate is None else F.when(F.col("rank_in_group") < rate["rank_in_group"], limit).otherwise(F.col("weight") * F.lit(rate["rate"]))
    return by_ratio.select("source", "source_size", target.cast("double").alias("target"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows with ``doc_id``, ``source`` and ``size`` (and any other columns) -> the same rows with ``source_size``,
    ``target`` and ``copies``. ``docs`` is read three times (sizes, ranges, rows); a costly one should be written first."""
    names = docs.columns
    keep = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, keep))
    rows = docs.toDF(*keep).withColumn("source", F.col(at["source"]))
    sizes = rows.groupBy("source").agg(F.sum(at["size"]).cast("long").alias("source_size"))
    goal = targets(sizes, weights, share, cap).withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    placed = ranked(rows, ["source"], [at["size"], at["doc_id"]])
    g = goal.select(F.col("source").alias("_source"), "source_size", "target", "expected")
    both = placed.join(g, placed["source"].eqNullSafe(g["_source"]))
    offset = source_offset(F.col("source"))
    upto = lambda n: F.floor(n * F.col("expected") + offset)
    copies = (upto(F.col("rank_in_group")) - upto(F.col("rank_in_group") - 1)).cast("long")
    return both.select(*[F.col(k).alias(n) for n, k in at.items()], "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents -> the mixed corpus: every column, one row for every copy taken, numbered in ``copy_no`` (an input
    column of that name is replaced)."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    planned = plan_mix(rows, **options).filter(F.col("copies") > 0)
    numbered = planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"))
    return numbered.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "copy_no"], "copy_no")


def op10_mixing(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return plan_mix(written(slim)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
