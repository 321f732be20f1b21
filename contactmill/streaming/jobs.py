"""Incremental jobs on Structured Streaming. Sinks are files, written per batch id, so a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.operators import match as M
from contactmill.operators import urls as U


def read_stream(spark: SparkSession, folder: str, pattern: str, max_files: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of what is there now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).parquet(folder)


def url_frontier(urls: DataFrame, keep_for: str = "60 days") -> DataFrame:
    """Classified URLs, each once within the time span (state is dropped after it)."""
    return U.filter_valid_urls(urls).withWatermark("created_at", keep_for).dropDuplicatesWithinWatermark(["url"])


def activity_windows(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), "event_type", "n"))


def request_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: start, end and number of events."""
    return (events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
            .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"))


def request_rate(events: DataFrame, size: str = "1 minute") -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "n")


def run_to_files(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Drain what is available now into ``out/batch=<id>``."""
    def write(df: DataFrame, batch_id: int):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}_progress").trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()


KEY_BUCKETS = 256


def lead_upsert(stream: DataFrame, store: str) -> None:
    """Append the leads of every batch that neither the store nor an earlier row of the batch has.

    The keys of stored leads are kept beside the store, in folders by a hash of the key; a batch reads only the folders
    its own keys fall into (at most ``KEY_BUCKETS`` numbers reach the driver). A batch that runs again reads the other
    batches and overwrites its own folders, so the result is the same.
    """
    keys = f"{store}_keys"
    bucket = F.pmod(F.xxhash64("key"), F.lit(KEY_BUCKETS)).cast("int")

    def merge(df: DataFrame, batch_id: int):
        spark = df.sparkSession
        rows = df.select("id", "ord", M.crawl_keys().alias("keys"))
        asked = [r[0] for r in rows.select(F.explode("keys").alias("key")).select(bucket).distinct().collect()]
        folder = spark._jvm.org.apache.hadoop.fs.Path(keys)
        stored = None
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            known = spark.read.schema("key string, batch long, bucket int").parquet(keys)
            stored = known.filter((F.col("batch") != batch_id) & F.col("bucket").isin(asked)).select(F.array("key").alias("keys"))
        fresh = df.join(M.first_holders(rows, stored), "id", "left_semi")
        fresh.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        new = spark.read.parquet(f"{store}/batch={batch_id}").select(F.explode(M.crawl_keys()).alias("key")).distinct()
        new.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{keys}/batch={batch_id}")
    q = (stream.writeStream.option("checkpointLocation", f"{store}_progress").trigger(availableNow=True).foreachBatch(merge).start())
    q.awaitTermination()


def retention(table: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Rows within their time to live."""
    from contactmill.sources.store import delete_where, older_than
    return delete_where(table, older_than(as_of, days))
