"""Connected components and greedy neighbourhoods over links, as Spark jobs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contactmill.functions.joins import hot_join
from contactmill.session import written

#: Links that a task brings together at a time, and pairs of a component that a task walks over.
PIECE = 500_000
WALK = 1_000_000


def _is_stars(links: DataFrame) -> bool:
    """Whether every node has one root and no root hangs on another."""
    nodes = links.select(F.col("b").alias("node"), "a").unionByName(links.select(F.col("a").alias("node"), "a"))
    return nodes.groupBy("node").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo <> hi").isEmpty()


def _to_smallest(rows: DataFrame) -> DataFrame:
    """``rows(u, v)`` with the smallest of u and all its v."""
    least = rows.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("least", "u"))
    return hot_join(rows, least, "u", "v", how="inner")


def _stars(a: list, b: list) -> dict:
    """Links -> node to the smallest node of its component."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def _contracted(links: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` with a < b -> links that connect the same nodes: those of a task are brought together, ``PIECE``
    at a time, into one star a component. Links near each other in order meet in one task, so a long chain becomes a few
    stars. Memory is that of a piece."""
    def run(batches):
        held, size = [], 0

        def flush():
            if size:
                t = pa.Table.from_batches(held)
                star = [(r, x) for x, r in _stars(t["a"].to_pylist(), t["b"].to_pylist()).items() if x != r]
                cols = [pa.array([s[i] for s in star], t.schema.field("a").type) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b"])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= PIECE:
                yield from flush()
                held, size = [], 0
        yield from flush()

    return links.repartitionByRange("a").mapInArrow(run, StructType(links.schema.fields))


def connected(links: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` -> ``node``, ``root`` (the smallest node reachable), by alternating large and small stars.

    Links that lie near each other are first brought together inside tasks. Every round then keeps the components and
    shortens the paths; it ends when all are stars, so long chains need more rounds but never fail. Links are written
    between rounds, and those of a hub are split. Runs jobs."""
    links = written(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    links = written(_contracted(links).distinct())
    while not _is_stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
        large = _to_smallest(both).filter(F.col("v") > F.col("u")).select(F.col("least").alias("a"), F.col("v").alias("b"))
        large = written(large.filter(F.col("a") < F.col("b")).distinct())
        near = _to_smallest(large.select(F.col("b").alias("u"), F.col("a").alias("v")))
        small = near.select(F.col("least").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        links = written(small.filter(F.col("a") < F.col("b")).distinct())
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _walked(pairs: DataFrame) -> DataFrame:
    """``pairs(root, lo, hi)`` -> ``node``, ``head``, each component walked in order by one task. What is held is which
    nodes of the present component are taken."""
    def run(batches):
        now, taken = None, {}
        for b in batches:
            done: list = []
            for r, lo, hi in zip(*(b.column(c).to_pylist() for c in ("root", "lo", "hi"))):
                if r != now:
                    now, taken = r, {}
                if lo not in taken and hi not in taken:
                    taken[hi] = lo
                    done.append((hi, lo))
            kind = b.schema.field("lo").type
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i in (0, 1)], ["node", "head"])

    kind = pairs.schema["lo"].dataType
    ordered = pairs.select("root", "lo", "hi").repartition("root").sortWithinPartitions("root", "lo", "hi")
    return ordered.mapInArrow(run, StructType().add("node", kind).add("head", kind))


def _rounds(pairs: DataFrame) -> DataFrame:
    """As `_walked`, for components too large for a task: in rounds, a node without an undecided earlier partner is a head,
    and its partners are taken."""
    left, taken = pairs, None
    while left.limit(1).count():
        heads = left.select(F.col("lo").alias("n")).distinct().join(left.select(F.col("hi").alias("n")).distinct(), "n", "left_anti")
        new = written(left.join(heads, left["lo"] == heads["n"], "left_semi").select(F.col("hi").alias("n")).distinct())
        gone = new.unionByName(heads)
        left = left.join(gone, left["lo"] == gone["n"], "left_anti")
        left = written(left.join(new, left["hi"] == new["n"], "left_anti"))
        taken = new if taken is None else written(taken.unionByName(new))
    if taken is None:
        return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("head")).limit(0)
    firm = pairs.join(taken, pairs["lo"] == taken["n"], "left_anti")
    return firm.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("head"))


def greedy_heads(pairs: DataFrame, walk: int = WALK) -> DataFrame:
    """Pairs ``lo``, ``hi`` (lo comes first) -> ``node``, ``head``: in order, every node that no earlier head is paired
    with becomes a head and takes the nodes paired with it; a node goes to the first such head. Nothing is transitive.

    Nodes of different components never meet, so each component is decided by itself: one of at most ``walk`` pairs by a
    walk in order inside a task (a chain of any length is one pass), larger ones in rounds over tables. Runs jobs."""
    pairs = written(pairs.select("lo", "hi").distinct())
    roots = connected(pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    named = written(hot_join(pairs, roots.select(F.col("node").alias("lo"), "root"), "lo", "hi", how="inner"))
    large = written(named.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > walk).select("root"))
    small = _walked(named.join(large, "root", "left_anti"))
    if large.isEmpty():
        return small
    return small.unionByName(_rounds(written(named.join(large, "root", "left_semi").select("lo", "hi"))))
