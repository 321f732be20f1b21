"""A persisted index of the keys a store holds, so that looking up a batch neither reads nor shuffles the store.

The index is a table of one row per key and addition (the key, and the smallest id that holds it), in folders by a hash of
the key (shards) and bucketed and sorted by the key inside them. A batch is looked up in three steps: its distinct keys
are tested against one Bloom filter per shard, which drops most keys the store does not have; folders of shards in which
none is left are not read; the rest joins the buckets as they lie, so only the batch is shuffled. Filters have at most
``MOST_BITS`` bits a shard, which bounds what is broadcast (``MOST_BITS`` / 8 * shards bytes for each addition); with more
keys they let more pass, and the join decides in any case.

Additions append; building again replaces. The folder holds everything: `open_index` finds an index of an earlier
session. Null keys are never held nor found.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
SHARDS = 16
MOST_BITS = 1 << 22


def shard_of(key, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _places(key) -> list[Column]:
    """Two numbers from 0 to 2**31 - 1 for a key, apart from the one that chooses the shard."""
    h = F.xxhash64(F.lit("bloom"), key)
    return [F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit((1 << 31) - 1))]


@dataclass
class KeyIndex:
    spark: SparkSession
    path: str
    buckets: int
    shards: int

    @property
    def name(self) -> str:
        return "key_index_" + hashlib.md5(self.path.encode()).hexdigest()[:16]

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, bits long, words array<bigint>").parquet(f"{self.path}_filters")

    def likely(self, keys: DataFrame) -> DataFrame:
        """``keys(key)`` -> distinct keys that the filters cannot rule out, with their shard."""
        asked = keys.filter("key is not null").select("key").distinct().withColumn("shard", shard_of("key", self.shards))
        both = asked.join(F.broadcast(self.filters()), "shard")
        for p in _places(F.col("key")):
            at = p.bitwiseAND(F.col("bits") - 1)
            word = F.element_at("words", (F.shiftright(at, 6) + 1).cast("int"))
            both = both.filter(F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return both.select("key", "shard").distinct()

    def known(self, keys: DataFrame) -> DataFrame:
        """``keys(key)`` -> ``key``, ``id`` of those that are held, with the smallest id. Runs a job that finds the shards
        to read (their numbers are all that reaches the driver)."""
        from contactmill.session import written
        asked = written(self.likely(keys))
        shards = [r["shard"] for r in asked.select("shard").distinct().collect()]
        held = self.table().filter(F.col("shard").isin(shards)).groupBy("key").agg(F.min("id").alias("id"))
        return held.join(asked.select("key"), "key")


def _filter_rows(keys: DataFrame, shards: int, bits: int) -> DataFrame:
    """shard, bits, words: one Bloom filter per shard that has a key."""
    places = F.explode(F.array(*[p.bitwiseAND(F.lit(bits - 1)) for p in _places(F.col("key"))]))
    at = keys.select(shard_of("key", shards).alias("shard"), places.alias("at"))
    masks = at.groupBy("shard", F.shiftright("at", 6).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))

    def run(batches):
        words: dict[int, np.ndarray] = {}
        for b in batches:
            for s, slot, mask in zip(*(b.column(c).to_pylist() for c in ("shard", "slot", "mask"))):
                if s not in words:
                    words[s] = np.zeros(bits // 64, np.int64)
                words[s][slot] = mask
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int32()), pa.array([bits] * len(words), pa.int64()), pa.array(list(words.values()), pa.list_(pa.int64()))],
                                             ["shard", "bits", "words"])

    return masks.repartition(shards, "shard").mapInArrow(run, "shard int, bits long, words array<bigint>")


def _write(index: KeyIndex, keys: DataFrame, mode: str) -> None:
    from contactmill.session import written
    once = written(keys.filter("key is not null").groupBy("key").agg(F.min("id").alias("id")))
    n = once.count()
    bits = min(MOST_BITS, 1 << max(10, math.ceil(math.log2(16 * max(1, n) / index.shards))))
    (once.withColumn("shard", shard_of("key", index.shards)).repartition(index.buckets, "key").write.mode(mode).format("parquet")
     .partitionBy("shard").bucketBy(index.buckets, "key").sortBy("key").option("path", index.path).saveAsTable(index.name))
    _filter_rows(once, index.shards, bits).write.mode(mode).parquet(f"{index.path}_filters")


def build_index(keys: DataFrame, path: str, buckets: int = BUCKETS, shards: int = SHARDS) -> KeyIndex:
    """``keys(key, id)`` -> an index in ``path``, in place of the one that is there. Runs jobs."""
    index = KeyIndex(keys.sparkSession, path, buckets, shards)
    _write(index, keys, "overwrite")
    return index


def add_keys(index: KeyIndex, keys: DataFrame) -> None:
    """Append keys; those that are held already do no harm."""
    _write(index, keys, "append")


def open_index(spark: SparkSession, path: str, buckets: int = BUCKETS, shards: int = SHARDS, id_type: str = "bigint") -> KeyIndex:
    """An index that an earlier session wrote, with the numbers it was built with."""
    index = KeyIndex(spark, path, buckets, shards)
    if not spark.catalog.tableExists(index.name):
        spark.sql(f"CREATE TABLE {index.name} (key STRING, id {id_type}, shard INT) USING parquet PARTITIONED BY (shard) "
                  f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.catalog.recoverPartitions(index.name)
    return index
