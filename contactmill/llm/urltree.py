"""URL filter: rules first, then a tree of path templates per host with smoothed labelled purity.

1. Segments that vary by their form (numbers, hex, anything with a digit) become a wildcard; equal paths of a host then
   are one leaf with its number of urls, of labelled urls and of bad ones. All later steps work on leaves.
2. Level by level, a node with more than ``BRANCHES`` different children, most of them rare, gets one wildcard child for
   those with at most ``RARE`` times the average number of urls; the frequent ones keep their own branch.
3. From the deepest level up, siblings whose share of bad urls does not differ from that of the other siblings
   (two-proportion test at ``Z``) merge into one wildcard branch; the ones that differ stay apart.
4. A template's purity is its share of bad urls, smoothed towards its host's, and that towards the overall share, by
   ``WEIGHT`` pseudo-urls each. Templates at or above ``REJECT`` are blocked.

What lies below ``DEPTH`` levels is one last segment, whole, so that templates may differ there too while the number of jobs
stays the same for any path. Nulls and urls without ``://`` have an empty host and path and are a host of
their own; repeated rows count as often as they occur; without labels nothing is blocked but by rule; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.llm.common import hot_join, written

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEPTH = 6
BRANCHES = 16
RARE = 2
Z = 1.96
WEIGHT = 10.0
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.lit(""))


def path_of(url) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_columns(host, path, rules=RULES) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict; null where none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return name, verdict


def leaf_path(path) -> Column:
    """Segments with the ones that vary by form as wildcards; those below DEPTH are joined to one."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))
    deep = F.concat(F.slice(parts, 1, DEPTH), F.array(F.array_join(F.slice(parts, DEPTH + 1, F.greatest(F.size(parts) - DEPTH, F.lit(0))), "/")))
    return F.when(F.size(parts) > DEPTH, deep).otherwise(parts)


def _prefix(level: int) -> Column:
    """Host and the template's first ``level`` segments as one key."""
    return F.concat_ws("/", F.lit(""), "host", F.lit(""), F.slice("template", 1, level))


def _set(level: int, cond) -> Column:
    """The template with its segment of this level (from 1) turned into a wildcard where ``cond`` holds."""
    return F.when(cond, F.transform("template", lambda s, i: F.when(i == level - 1, F.lit("*")).otherwise(s))).otherwise(F.col("template"))


def templates(leaves: DataFrame) -> DataFrame:
    """host, leaf, n, labelled, bad -> the same with ``template`` (array) and ``purity``."""
    t = leaves.withColumn("template", F.col("leaf"))
    depth = leaves.agg(F.max(F.size("leaf"))).first()[0] or 0
    for level in range(1, depth + 1):
        t = t.withColumn("_up", _prefix(level - 1)).withColumn("_seg", F.get("template", F.lit(level - 1)))
        child = t.filter(F.col("_seg").isNotNull()).groupBy("_up", "_seg").agg(F.sum("n").alias("n"))
        kinds = child.groupBy("_up").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).filter((F.col("kinds") > BRANCHES) & (F.col("kinds") * 4 > F.col("all")))
        rare = hot_join(written(child), kinds, "_up", "_seg", how="inner").filter(F.col("n") * F.col("kinds") <= RARE * F.col("all"))
        t = t.withColumn("_node", F.struct("_up", "_seg"))
        t = hot_join(written(t), rare.select(F.struct("_up", "_seg").alias("_node"), F.lit(True).alias("rare")), "_node", "leaf")
        t = t.withColumn("template", _set(level, F.coalesce("rare", F.lit(False)))).drop("_up", "_seg", "_node", "rare")
    t = written(t)
    for level in range(depth, 0, -1):
        t = t.withColumn("_up", _prefix(level - 1)).withColumn("_node", _prefix(level)).withColumn("_seg", F.get("template", F.lit(level - 1)))
        node = t.filter(F.col("_seg").isNotNull()).groupBy("_up", "_node").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
        whole = node.groupBy("_up").agg(F.sum("n").alias("nn"), F.sum("b").alias("bb"), F.count("*").alias("kinds"))
        rest_n, p = F.col("nn") - F.col("n"), F.try_divide("bb", "nn")
        gap = F.abs(F.try_divide("b", "n") - F.try_divide(F.col("bb") - F.col("b"), rest_n))
        # Null, so alike, where one side has no label.
        differs = gap > Z * F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), F.col("n")) + F.try_divide(F.lit(1), rest_n)))
        alike = node.join(whole, "_up").select("_node", ((F.col("kinds") > 1) & ~F.coalesce(differs, F.lit(False))).alias("alike"))
        t = hot_join(written(t), alike, "_node", "leaf")
        t = written(t.withColumn("template", _set(level, F.coalesce("alike", F.lit(False)))).drop("_up", "_node", "_seg", "alike"))
    every = t.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).first()
    share = (every["b"] or 0) / every["n"] if every["n"] else 0.0
    smooth = lambda b, n, prior: (b + WEIGHT * prior) / (n + WEIGHT)
    host = t.groupBy("host").agg(smooth(F.sum("bad"), F.sum("labelled"), F.lit(share)).alias("host_purity"))
    key = F.concat_ws("/", F.lit(""), "host", F.lit(""), "template")
    own = t.withColumn("_t", key).groupBy("_t", "host").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    own = own.join(host, "host").select("_t", smooth(F.col("b"), F.col("n"), F.col("host_purity")).alias("purity"))
    return hot_join(t.withColumn("_t", key), own, "_t", "leaf", how="inner").drop("_t")


def judged(pages: DataFrame) -> DataFrame:
    """page_id, url, bad (1, 0, or null where nothing is known) -> page_id, host, path, rule, verdict, template, purity."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "bad", host.alias("host"), path.alias("path"))
    rows = written(rows.withColumn("leaf", leaf_path(F.col("path"))).withColumn("_key", F.struct("host", "leaf")))
    leaves = rows.groupBy("host", "leaf").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = written(templates(leaves).select(F.struct("host", "leaf").alias("_key"), F.concat_ws("/", "template").alias("template"), "purity"))
    out = hot_join(rows, known, "_key", "page_id")
    name, verdict = rule_columns(F.col("host"), F.col("path"))
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")


def op5_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels: the last number of a page's path names a document; the page is bad where that one is marked toxic or of
    low quality."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})[^/]*/?$", 1).try_cast("long")
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    rows = written(pages.select("page_id", "url", number.alias("_doc")))
    return judged(hot_join(rows, marks, "_doc", "page_id").select("page_id", "url", "bad"))
