"""Readers: URL lists, lead files, customer profiles, saved search answers and saved model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill import schemas
from contactmill.functions import text as X


def read_url_list(spark: SparkSession, path: str, fmt: str, http_only: bool = False) -> DataFrame:
    """URL list as JSON (a list, or an object with ``urls``), CSV (first column) or text; blank lines are dropped."""
    if fmt == "json":
        # A list file is one JSON document, so it is read whole; a table of URLs should be stored as lines or Parquet.
        doc = spark.read.text(path, wholetext=True)
        arr = F.coalesce(F.from_json(F.get_json_object("value", "$.urls"), "array<string>"), F.from_json("value", "array<string>"))
        rows = doc.select(F.explode(arr).alias("url"))
    elif fmt == "csv":
        rows = spark.read.csv(path, header=False).select(F.col("_c0").alias("url"))
    elif fmt == "txt":
        rows = spark.read.text(path).select(F.col("value").alias("url"))
    else:
        raise ValueError(f"unknown URL list format {fmt}")
    rows = rows.select(X.strip("url").alias("url")).filter("url <> ''")
    return rows.filter(F.col("url").startswith("http")) if http_only else rows


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """Lead files with the fixed schema; ``_corrupt_record`` holds what could not be read."""
    return spark.read.schema(schemas.LEAD + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def readable(leads: DataFrame) -> DataFrame:
    return leads.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_icp(spark: SparkSession, path: str) -> DataFrame:
    icp = spark.read.schema(schemas.ICP).option("multiLine", True).json(path)
    first = lambda f: F.get(F.col(f"icp_information.{f}"), F.lit(0))
    return icp.select("*", first("decision_maker_persona").alias("persona"), first("target_industry").alias("industry"), first("region").alias("region"))


def search_results_to_urls(responses: DataFrame) -> DataFrame:
    """``responses(body)`` of a search API -> url, title, snippet."""
    items = F.from_json(F.get_json_object("body", "$.items"), "array<struct<link:string,title:string,snippet:string>>")
    return (responses.select("*", F.posexplode(items).alias("pos", "_i")).select("*", F.col("_i.link").alias("url"), "_i.title", "_i.snippet")
            .drop("_i", "body").filter(X.filled("url")))


def model_json(text) -> Column:
    """First JSON object of a model answer: the fenced block, else from the first brace on (what follows the object is
    ignored by the parser); null when nothing parses."""
    fenced = X.extract(text, r"(?s)```json\s*(\{.*?\})\s*```")
    bare = X.extract(text, r"(?s)([\[{].*)")
    pick = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(pick(fenced), pick(bare))


def parse_model_json(answers: DataFrame, column: str = "answer") -> DataFrame:
    return answers.withColumn("parsed", F.from_json(model_json(column), schemas._struct(schemas.MODEL_OUTPUT))).drop(column)
