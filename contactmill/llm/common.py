"""Helpers shared by the operators: words, bounded samples, distributed ranks; joins with hot keys and written tables are
those of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactmill.functions.joins import hot_join
from contactmill.session import forget, written

__all__ = ["WORD", "bounded", "doc_crc", "forget", "hot_join", "n_words", "ranked", "table", "written"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string"))


def text_key(text) -> tuple[Column, Column]:
    """96 bits that stand for a text in joins: what depends on the text alone needs no row number."""
    return F.xxhash64(text), F.coalesce(F.crc32(text), F.lit(-1))


def bounded(ids: DataFrame, group: str, sizes: dict, n: int) -> DataFrame:
    """At most ``n`` rows per group, those with the smallest hash of doc_id. ``sizes``: rows per group; with them a cut on
    the hash leaves about 1.5 n rows per group, so that the ranking never meets a whole group."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cut = F.create_map(*[x for g, size in sizes.items() for x in (F.lit(g), F.lit(1.5 * n / max(1, size)))])
    few = ids.filter(part < cut[F.col(group)])
    order = Window.partitionBy(group).orderBy(part, "doc_id")
    return few.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def ranked(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Add ``rank_in_group`` (from 1, over ``order`` within ``by``) without bringing a group into one task.

    Rows are range-partitioned by (by, order), so a hot group spreads over many tasks; the place of a row inside its
    partition comes with the sort, and only one row per (group, partition) takes part in the window that adds what
    earlier partitions hold. Writes the ranged rows once (ranges are drawn by sampling and must not be drawn twice)."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in [*by, *order]]
    placed = written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                     .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    starts = (placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(
                  Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # Written, so that its size is known: Spark then broadcasts it where it is small and the rows are not shuffled again.
    s, p = written(starts).alias("s"), placed.alias("p")
    same = F.col("p._part") == F.col("s._part")
    for c in by:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    rank = (F.col("s._before") + F.col("p._at") - F.col("s._first") + 1).alias("rank_in_group")
    return p.join(s, same).select(*[F.col(f"p.`{c}`") for c in df.columns], rank)
