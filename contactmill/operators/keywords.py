"""Keyword tables as data: any number of keywords found in one pass over the texts.

A keyword table has one row per keyword: ``label``, ``rank`` (the label's place in the table), ``word`` and ``weight``. All
words are put into one automaton, built once per task, which walks each text once, however many words there are; a word is
found as a substring, as ``contains`` does. What a text holds is an array in its own row, so nothing is shuffled, and
labels, scores and choices are expressions on that array.

The words go to the tasks by broadcast, ``MOST`` of them at a time; a larger table takes one pass for each part of that
size, and no word is left out. Null and empty words are; a null text holds none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contactmill.functions import text as X

MOST = 200_000
HITS = "array<struct<rank:int,label:string,word:string,weight:bigint,n:bigint,ord:bigint>>"
KIND = pa.list_(pa.struct([("rank", pa.int32()), ("label", pa.string()), ("word", pa.string()), ("weight", pa.int64()), ("n", pa.int64()), ("ord", pa.int64())]))


def keyword_table(spark: SparkSession, table: dict, weight=lambda word: 1) -> DataFrame:
    """A table of labels and their words as keywords (label, rank, word, weight, ord)."""
    rows = [(label, rank, word, int(weight(word))) for rank, (label, words) in enumerate(table.items()) for word in words]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "label string, rank int, word string, weight long, ord long")


def automaton(words: list[str]):
    import ahocorasick
    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, (i, len(w)))
    if words:
        out.make_automaton()
    return out


def occurrences(machine, text: str) -> dict[int, int]:
    """Number of a word -> how often it occurs without overlapping itself."""
    count: dict[int, int] = {}
    free: dict[int, int] = {}
    for end, (i, size) in machine.iter(text):
        if end - size >= free.get(i, -1):
            count[i] = count.get(i, 0) + 1
            free[i] = end
    return count


def _pass(df: DataFrame, text: str, keywords: pa.Table) -> DataFrame:
    """Adds ``_hits`` for one part of the keywords."""
    names = keywords["word"].to_pylist()
    words = list(dict.fromkeys(names))
    at = {w: i for i, w in enumerate(words)}
    rows_of: list[list[int]] = [[] for _ in words]
    for r, w in enumerate(names):
        rows_of[at[w]].append(r)
    shared = df.sparkSession.sparkContext.broadcast((words, rows_of, keywords))

    def run(batches):
        words, rows_of, table = shared.value
        machine = automaton(words)
        for b in batches:
            row, n, size = [], [], [0]
            for t in b.column("_low").to_pylist():
                found = occurrences(machine, t) if t and words else {}
                for i, k in found.items():
                    row += rows_of[i]
                    n += [k] * len(rows_of[i])
                size.append(len(row))
            took = table.take(pa.array(row, pa.int64()))
            cols = [took[f.name].combine_chunks().cast(f.type) if f.name != "n" else pa.array(n, pa.int64()) for f in KIND.value_type]
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
            hits = pa.ListArray.from_arrays(pa.array(np.array(size, np.int32)), pa.StructArray.from_arrays(cols, fields=list(KIND.value_type)))
            yield pa.RecordBatch.from_arrays([*[c for c, f in zip(b.columns, b.schema.names) if f != "_low"], hits], [*[f for f in b.schema.names if f != "_low"], "_hits"])

    low = df.withColumn("_low", F.lower(F.col(text)))
    return low.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"_hits {HITS}").fields]))


def with_hits(df: DataFrame, keywords: DataFrame, text: str = "text", name: str = "hits", most: int = MOST) -> DataFrame:
    """Adds ``name``: the keywords the text holds, with their number ``n`` of occurrences, in the order of the table. Counts
    the table (a job) and collects it, ``most`` words at a time."""
    table = keywords.filter(X.filled("word"))
    table = table.select("label", F.col("rank").cast("int").alias("rank"), F.lower("word").alias("word"), F.col("weight").cast("long").alias("weight"),
                         (F.col("ord") if "ord" in keywords.columns else F.col("rank")).cast("long").alias("ord"))
    parts = max(1, math.ceil(table.count() / most))
    own = F.pmod(F.xxhash64("word"), F.lit(parts))
    # Columns keep their places under plain names, so that none can clash.
    at = [f"c{i}" for i in range(len(df.columns))]
    out, found = df.toDF(*at), []
    for p in range(parts):
        out = _pass(out, at[df.columns.index(text)], table.filter(own == p).orderBy("ord", "word").toArrow()).withColumnRenamed("_hits", f"_h{p}")
        found.append(f"_h{p}")
    every = F.array_sort(F.concat(*found) if parts > 1 else F.col(found[0]), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1)
                         .when(a["word"] < b["word"], -1).when(a["word"] > b["word"], 1).otherwise(0))
    return out.select(*[F.col(c).alias(n) for n, c in zip(df.columns, at) if n != name], every.alias(name))


def label_scores(hits) -> Column:
    """Hits -> array of (score, rank, label), one per label that has a hit; the score is the sum of weight times n."""
    hits = X.col(hits)
    labels = F.array_distinct(F.transform(hits, lambda h: F.struct(h["rank"].alias("rank"), h["label"].alias("label"))))
    total = lambda l: F.aggregate(F.filter(hits, lambda h: h["rank"] == l["rank"]), F.lit(0).cast("bigint"), lambda s, h: s + h["weight"] * h["n"])  # noqa: E731, E741
    return F.transform(labels, lambda l: F.struct(total(l).alias("score"), l["rank"].alias("rank"), l["label"].alias("label")))  # noqa: E741


def best_label(hits, default: str) -> Column:
    """The label of the highest score, the first in the table on ties; ``default`` where nothing was found."""
    ordered = F.array_sort(F.transform(label_scores(hits), lambda s: F.struct((-s["score"]).alias("low"), s["rank"].alias("rank"), s["label"].alias("label"))))
    return F.coalesce(F.get(ordered, F.lit(0))["label"], F.lit(default))


def labels_of(hits) -> Column:
    """Labels that have a hit, in the order of the table."""
    ordered = F.array_sort(F.array_distinct(F.transform(X.col(hits), lambda h: F.struct(h["rank"].alias("rank"), h["label"].alias("label")))))
    return F.transform(ordered, lambda s: s["label"])


def industry_by(pages: DataFrame, keywords: DataFrame, text: str = "text", default: str = "general") -> DataFrame:
    """Adds ``industry`` by a keyword table."""
    found = with_hits(pages, keywords, text, "_hits")
    return found.withColumn("industry", best_label("_hits", default)).drop("_hits")


def services_by(pages: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``services``: the labels of which a word occurs."""
    found = with_hits(pages, keywords, text, "_hits")
    return found.withColumn("services", labels_of("_hits")).drop("_hits")


def intents_by(pages: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``intents``: (category, match) in the order of the table."""
    found = with_hits(pages, keywords, text, "_hits")
    return found.withColumn("intents", F.transform("_hits", lambda h: F.struct(h["label"].alias("category"), h["word"].alias("match")))).drop("_hits")
