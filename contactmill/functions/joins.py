"""Joins of many rows with one row per key, where a few keys may hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, salt: str, how: str = "left", spread: int = 32) -> DataFrame:
    """``left`` joined with ``right`` (at most one row per ``key``); a null key finds nothing.

    Adaptive execution does not split a side that was aggregated by the join key, so it is done here: the ``HOT_KEYS``
    keys with most rows of ``left`` (that fixed number is all that is broadcast; any other key holds less than a
    thousandth of the rows) are dealt over ``spread`` tasks by a hash of ``salt``, and their single row of ``right`` is
    repeated for each. Nothing runs while the plan is built; ``left`` is read twice, so a costly one should be written
    first."""
    hot = (left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > spread)
           .orderBy(F.desc("_n"), key).limit(HOT_KEYS).select(F.col(key).alias("_hot"), F.lit(True).alias("_h")))
    mark = lambda df: df.join(F.broadcast(hot), df[key].eqNullSafe(hot["_hot"]), "left").drop("_hot")
    lhs = mark(left).withColumn("_salt", F.when(F.col("_h"), F.pmod(F.xxhash64(salt), F.lit(spread))).otherwise(0).cast("int")).drop("_h")
    every = F.sequence(F.lit(0), F.lit(spread - 1))
    rhs = mark(right).withColumn("_salt", F.explode(F.when(F.col("_h"), every).otherwise(F.array(F.lit(0))))).drop("_h")
    return lhs.join(rhs, [key, "_salt"], how).drop("_salt")
