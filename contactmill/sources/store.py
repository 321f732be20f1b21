"""Writers: idempotent appends, updates and deletes as new table versions, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill import schemas
from contactmill.functions import text as X
from contactmill.operators.urls import first_per_key


# --- appends --------------------------------------------------------------------------------------------------

def append_raw(batch: DataFrame, stored: DataFrame | None, source: str, as_of: Column) -> DataFrame:
    """Rows to append to a platform table: stamped, first of each URL, none that is stored (``stored=None``: no
    uniqueness, as for web rows)."""
    stamped = batch.withColumn("scraped_at", as_of).withColumn("source", F.lit(source))
    if stored is None:
        return stamped
    return first_per_key(stamped.join(stored.select("url"), "url", "left_anti"), ["url"], "id")


def append_unified(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Valid unified rows with URL and platform whose URL is new; the profile identifier falls back to 'default'."""
    from contactmill.operators.unify import unified_valid
    ok = batch.filter(X.filled("url") & X.filled("platform") & unified_valid()).withColumn("icp_identifier", F.coalesce("icp_identifier", F.lit("default")))
    return first_per_key(ok.join(stored.select("url"), "url", "left_anti"), ["url"], "id")


def append_counts(batch: DataFrame, appended: DataFrame, valid: Column) -> DataFrame:
    """total = success + duplicate + failure."""
    b = batch.agg(F.count("*").alias("total"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("failure")).withColumn("_k", F.lit(1))
    a = appended.agg(F.count("*").alias("success")).withColumn("_k", F.lit(1))
    return b.join(a, "_k").drop("_k").withColumn("duplicate", F.col("total") - F.col("failure") - F.col("success"))


# --- new versions ---------------------------------------------------------------------------------------------

def last_updates(updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One update per key: of every column the last value that is not null, by ``order`` (which stays out of the result);
    without an order, and on ties, the greatest value. Updates without a key are left out."""
    cols = [c for c in updates.columns if c not in (key, order)]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(*([order] if order else []), c))).alias(c) for c in cols]
    one = updates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), *last)
    return one.select(key, *[F.col(f"{c}.`{c}`").alias(c) for c in cols])


def apply_updates(table: DataFrame, updates: DataFrame, key: str, upsert: bool = False, order: str | None = None) -> DataFrame:
    """New version of a table: filled update columns replace stored ones; ``upsert`` adds unknown keys. Updates of one key
    are applied in ``order``, the last value of each column wins (`last_updates`), so rows never multiply."""
    updates = last_updates(updates, key, order)
    cols = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias("_" + c) for c in cols], F.lit(True).alias("_hit"))
    joined = table.join(u, key, "full" if upsert else "left")
    joined = joined.withColumn("matched", F.coalesce(F.col("_hit"), F.lit(False)))
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(F.col("_" + c), F.col(c)) if c in table.columns else F.col("_" + c))
    return joined.drop("_hit", *["_" + c for c in cols])


def _replace_partitions(spark: SparkSession, path: str, partition: str, values: list, rows: DataFrame) -> None:
    """Rows in place of the folders of ``values``: folders that get rows are overwritten, those that get none removed, all
    others keep their files. The rows are written beside the table first, as they were read from it."""
    from contactmill.session import written
    rows = written(rows)
    filled = {r[0] for r in rows.select(partition).distinct().collect()}
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    jvm = spark._jvm
    for v in values:
        if v not in filled:
            folder = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(partition, None if v is None else str(v))
            at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{folder}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def update_partitions(spark: SparkSession, path: str, updates: DataFrame, key: str, partition: str, upsert: bool = False, order: str | None = None) -> list:
    """`apply_updates` on a table in folders by ``partition``: only folders that hold an updated key (or get a row) are read
    whole and written anew. An update may move a row to another folder. Returns the values of the folders written; only
    these reach the driver. Runs jobs: the table's keys are read once to find them. A run that is lost before the last
    write has changed nothing, and running it again gives the same."""
    from contactmill.session import written
    table, updates = spark.read.parquet(path), written(last_updates(updates, key, order))
    touched = table.select(key, partition).join(updates.select(key), key, "left_semi").select(partition).distinct()
    if partition in updates.columns:
        touched = touched.union(updates.filter(F.col(partition).isNotNull()).select(F.col(partition).cast(table.schema[partition].dataType))).distinct()
    values = {r[0] for r in touched.collect()} | ({None} if upsert else set())
    if not values:
        return []
    values = sorted(values, key=lambda v: (v is None, v))
    inside = X.any_of([F.col(partition).eqNullSafe(F.lit(v)) for v in values])
    # Folders that are not read hold no updated key, so a key unknown here is unknown; without a value it goes to the null folder.
    rows = apply_updates(table.filter(inside), updates, key, upsert).drop("matched").select(*table.columns)
    _replace_partitions(spark, path, partition, values, rows)
    return values


def delete_in_partitions(spark: SparkSession, path: str, condition: Column, partition: str) -> list:
    """`delete_where` on a table in folders by ``partition``: only folders with a row to delete are written anew. Returns
    their values. Runs jobs."""
    table = spark.read.parquet(path)
    values = [r[0] for r in table.filter(F.coalesce(condition, F.lit(False))).select(partition).distinct().collect()]
    if values:
        inside = X.any_of([F.col(partition).eqNullSafe(F.lit(v)) for v in values])
        _replace_partitions(spark, path, partition, values, delete_where(table.filter(inside), condition))
    return values


def update_counts(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    cols = [c for c in updates.columns if c != key and c in table.columns]
    both = table.select(key, *cols).join(updates.select(key, *[F.col(c).alias("_" + c) for c in cols]), key)
    changed = X.any_of([F.col("_" + c).isNotNull() & ~F.col(c).eqNullSafe(F.col("_" + c)) for c in cols])
    return both.agg(F.count("*").alias("matched"), F.count_if(changed).alias("modified"))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows that stay; a null condition keeps the row."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def deleted_count(table: DataFrame, condition: Column) -> DataFrame:
    return table.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("deleted"))


def older_than(as_of: Column, days: int, column: str = "scraped_at") -> Column:
    return F.col(column) < as_of - F.expr(f"INTERVAL {days} DAYS")


def write_version(df: DataFrame, base: str, version: int, partition_by: list[str] | None = None) -> None:
    """Write a table version into its own folder, then record it: readers never see a half-written version, and a
    failed job can simply run again."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{base}/v{version}")
    df.sparkSession.range(version, version + 1).toDF("version").coalesce(1).write.mode("append").parquet(f"{base}/versions")


def latest_version(spark: SparkSession, base: str) -> int:
    return spark.read.parquet(f"{base}/versions").agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{base}/v{latest_version(spark, base) if version is None else version}")


# --- exports --------------------------------------------------------------------------------------------------

def write_leads(leads: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    leads.write.mode(mode).format(fmt).save(path)


def export_metadata(leads: DataFrame, export_type: str, filters: dict | None, as_of: Column) -> DataFrame:
    """One row: type, time, number of rows, filters and the schema of the export."""
    return leads.agg(F.count("*").alias("total_records")).select(
        F.lit(export_type).alias("export_type"), as_of.alias("exported_at"), "total_records",
        F.lit("; ".join(f"{k}={v}" for k, v in sorted((filters or {}).items()))).alias("filters"),
        F.lit("1.0").alias("schema_version"), F.lit(leads.schema.json()).alias("schema"))


def export_json(leads: DataFrame, path: str, as_of: Column, compress: bool = False, filters: dict | None = None) -> None:
    """Leads as JSON lines under ``leads`` and the envelope under ``metadata``; many files, written in parallel."""
    leads.write.mode("overwrite").option("compression", "gzip" if compress else "none").option("ignoreNullFields", False).json(f"{path}/leads")
    export_metadata(leads, "json", filters, as_of).write.mode("overwrite").json(f"{path}/metadata")


def validate_export(spark: SparkSession, path: str, schema: str = schemas.LEAD) -> DataFrame:
    """Counts of readable and corrupt rows, rows without a required field, and whether the envelope count agrees."""
    rows = spark.read.schema(schema + ", _corrupt_record string").json(f"{path}/leads")
    bad = F.col("_corrupt_record").isNotNull()
    found = rows.agg(F.count("*").alias("rows"), F.count_if(bad).alias("corrupt"),
                     F.count_if(~bad & (X.blank("id") | X.blank("source_url"))).alias("missing_required")).withColumn("_k", F.lit(1))
    meta = spark.read.json(f"{path}/metadata").select(F.col("total_records").alias("declared"), F.lit(1).alias("_k"))
    return found.join(meta, "_k").drop("_k").withColumn("valid", (F.col("rows") == F.col("declared")) & (F.col("corrupt") == 0) & (F.col("missing_required") == 0))


#: Keys of a map column that get a column of their own in a flat export.
KEY_COLUMNS = 200


def _map_keys(leads: DataFrame, column: str, most: int) -> tuple[list[str], bool]:
    """The ``most`` keys of a map column that most rows have, in order, and whether there are more. Runs a job; keys are
    counted where they are, and only those chosen reach the driver."""
    if column not in leads.columns:
        return [], False
    counts = leads.select(F.explode(F.map_keys(column)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    found = [r["k"] for r in counts.orderBy(F.desc("n"), "k").limit(most + 1).collect()]
    return sorted(found[:most]), len(found) > most


def _rest(column: str, keys: list[str]) -> Column:
    """The entries of a map column under other keys, as JSON; null where there are none."""
    others = F.map_filter(column, lambda k, v: ~F.array_contains(F.array(*[F.lit(k) for k in keys]).cast("array<string>"), k))
    return F.when(F.size(others) > 0, F.to_json(others))


def export_errors(spark: SparkSession, path: str, schema: str = schemas.LEAD) -> DataFrame:
    """One row per fault of an export: where it is (lead, line or part), and what is wrong."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    def there(part: str) -> bool:
        folder = jvm(f"{path}/{part}")
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    kind = "place string, error string"
    missing = [(p, f"missing {p}") for p in ("leads", "metadata") if not there(p)]
    out = spark.createDataFrame(missing, kind)
    if there("leads"):
        rows = spark.read.schema(schema + ", _corrupt_record string").json(f"{path}/leads")
        faults = F.array_compact(F.array(
            F.when(F.col("_corrupt_record").isNotNull(), F.lit("not readable")),
            F.when(F.col("_corrupt_record").isNull() & X.blank("id"), F.lit("missing id")),
            F.when(F.col("_corrupt_record").isNull() & X.blank("source_url"), F.lit("missing source_url"))))
        out = out.unionByName(rows.select(F.coalesce("id", F.col("_corrupt_record"), F.lit("")).alias("place"), F.explode(faults).alias("error")))
    if there("metadata"):
        meta = spark.read.schema("export_type string, total_records long, schema string").json(f"{path}/metadata")
        faults = F.array_compact(F.array(F.when(F.col("total_records").isNull(), F.lit("missing total_records")), F.when(X.blank("schema"), F.lit("missing schema"))))
        out = out.unionByName(meta.select(F.lit("metadata").alias("place"), F.explode(faults).alias("error")))
    return out


def lead_flat(leads: DataFrame, fields: list[str] | None = None, most: int = KEY_COLUMNS) -> DataFrame:
    """Nested leads as one flat row each: lists joined, one column per key that occurs in ``confidence_scores`` and per
    key and field (url, followers, verified) in ``social_media``, sorted header. The ``most`` commonest keys of each get
    columns; where there are more, the entries of all others are JSON in ``confidence_rest`` and ``social_rest``. Runs jobs
    to find the keys."""
    out = leads
    for name, kind in leads.dtypes:
        if kind == "array<string>":
            out = out.withColumn(name, F.array_join(X.clean_array(name), "; "))
        elif kind.startswith("array<struct"):
            out = out.withColumn(name + "_count", F.coalesce(F.nullif(F.size(name), F.lit(-1)), F.lit(0)))
            out = out.withColumn(name, F.when(F.size(name) > 0, F.to_json(name)).otherwise(""))
    scores, more = _map_keys(leads, "confidence_scores", most)
    out = out.withColumns({"confidence_" + k: F.try_element_at("confidence_scores", F.lit(k)) for k in scores} | ({"confidence_rest": _rest("confidence_scores", scores)} if more else {}))
    sites, more = _map_keys(leads, "social_media", most)
    if more:
        out = out.withColumn("social_rest", _rest("social_media", sites))
    for k in sites:
        v, kind = F.try_element_at("social_media", F.lit(k)), leads.schema["social_media"].dataType.valueType
        for f in [x for x in kind.fieldNames() if x != "platform"] if hasattr(kind, "fieldNames") else []:
            out = out.withColumn(f"social_{k}_{f}", v[f])
        if not hasattr(kind, "fieldNames"):
            out = out.withColumn(f"social_{k}_url", v)
    out = out.drop("confidence_scores", "social_media")
    return out.select(*sorted(fields or out.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_sheets(leads: DataFrame, path: str, fields: list[str]) -> None:
    """Leads, summary and statistics as three CSV folders."""
    from contactmill.operators import reports as J
    write_csv(lead_flat(leads), f"{path}/leads")
    scored = leads.withColumn("score", F.col("lead_score")).withColumn("scraped_at", F.col("extraction_timestamp"))
    write_csv(J.summary_sheet(scored).orderBy("pos"), f"{path}/summary")
    write_csv(J.statistics_sheet(leads, fields), f"{path}/statistics")


def export_filtered(leads: DataFrame, path: str, fmt: str, as_of: Column, **conditions) -> None:
    from contactmill.operators.reads import filter_leads
    chosen = filter_leads(leads, **conditions)
    if fmt == "json":
        export_json(chosen, path, as_of, filters=conditions)
    else:
        write_csv(lead_flat(chosen), path)


def export_batched(leads: DataFrame, path: str, fmt: str, batch_size: int) -> None:
    """Files of at most ``batch_size`` rows."""
    leads.write.mode("overwrite").option("maxRecordsPerFile", batch_size).format(fmt).save(path)


def export_search(leads: DataFrame, path: str, fmt: str, pattern: str, fields: list[str], limit: int | None = None) -> None:
    from contactmill.operators.reads import text_search
    found = text_search(leads, pattern, fields).orderBy("url")
    (found if limit is None else found.limit(limit)).write.mode("overwrite").format(fmt).save(path)


def unified_flat(leads: DataFrame) -> DataFrame:
    """26 flat columns of the unified table, arrays joined."""
    j = lambda c: F.array_join(F.col(f"contact.{c}"), ", ").alias(c)
    h = lambda n: F.col(f"contact.social_media_handles.{n}").alias(n)
    return leads.select("url", "platform", *[F.col(f"profile.{c}").alias(c) for c in ("full_name", "bio", "location", "job_title")], j("emails"),
                        j("phone_numbers"), F.col("contact.address").alias("address"), j("websites"),
                        *[h(n) for n in ("linkedin", "twitter", "facebook", "instagram", "youtube", "tiktok")],
                        *["industry", "company_name", "company_type", "lead_category", "lead_sub_category", "decision_makers", "bdr"],
                        "scraped_at", "data_quality_score", "icp_identifier")


def raw_extraction(pages: DataFrame, as_of: Column) -> DataFrame:
    """Envelope of a saved page: what it is, which sources answered and how long they are, and the payload."""
    from contactmill.operators import pages as P
    step = pages.select("page_id", "url", P.jsonld_blocks("html").alias("json_ld"), P.meta_tags("html").alias("meta"), P.script_texts("html").alias("scripts"), P.html_text("html").alias("text"))
    return step.select(
        F.struct(as_of.alias("extracted_at"), "url", F.lit("page").alias("type")).alias("metadata"),
        F.struct((F.size("json_ld") > 0).alias("json_ld"), (F.size("meta") > 0).alias("meta"), (F.size("scripts") > 0).alias("scripts"),
                 F.length("text").alias("text_length")).alias("summary"),
        F.struct("json_ld", "meta", "text").alias("payload"), "page_id")
