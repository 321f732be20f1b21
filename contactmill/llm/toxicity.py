"""Toxicity: a bag of subword embeddings, averaged, under a linear softmax; embeddings and softmax are trained jointly.

A text is the bag of its character n-grams (4 to 6 characters, word bounds included), hashed into buckets; each bucket has a
vector, the document is their mean (with ``PRIOR`` zero vectors, so that a handful of n-grams can't decide), a softmax
over two classes decides. Misspellings and compounds share n-grams with the
words seen in training. As both layers are linear, the trained model folds into one number per bucket, so a score needs
one gather per n-gram.

Labels are learnt from a bounded sample: of the labelled rows that are not held out, up to ``per_class`` of each class,
those with the smallest hash of doc_id; their gradient weighs as much as all rows of the class. Everything else runs over
every row and whole texts.

Nulls count as empty; a text without an n-gram gets the model's bias alone. Repeated labels count as toxic if any of them
is. Without labelled texts of both classes every score is 0 (1, where all labels are toxic).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.llm import ngrams
from contactmill.llm.common import bounded, doc_crc

SIZES = (4, 5, 6)
BUCKETS = 1 << 18
DIM = 8
PER_CLASS = 1500
#: The mean is taken times this, so that one n-gram in a long text can move the softmax.
SCALE = 100.0
PRIOR = 600
#: Training steps of 256 documents, whatever the sample's size.
STEPS = 200


def bag(texts, sizes=SIZES, buckets=BUCKETS):
    """(text, bucket) of every n-gram of the texts, size after size."""
    codes, owner = ngrams.squeezed(texts)
    for n in sizes:
        h, o = ngrams.hashed(codes, owner, n)
        yield o, (h & np.uint64(buckets - 1)).astype(np.int64)


def counted(rows: DataFrame) -> DataFrame:
    """``text``, ``y`` -> the distinct buckets of each text, how often each occurs, and all n-grams, as packed arrays."""
    def run(batches):
        for b in batches:
            ids, counts, totals = [], [], []
            for t in b.column("text").to_pylist():
                got = [h for _, h in bag([t])]
                u, c = np.unique(np.concatenate(got), return_counts=True)
                ids.append(u.astype("<i4").tobytes())
                counts.append(np.minimum(c, 65535).astype("<u2").tobytes())
                totals.append(int(c.sum()))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.array(totals, pa.int64())],
                                             ["y", "ids", "counts", "total"])
    return rows.select("y", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "y int, ids binary, counts binary, total long")


def train(ys, ids, counts, totals, weights, buckets=BUCKETS, dim=DIM, steps=STEPS, batch=256, rate=0.05, decay=1e-4, min_docs=5, seed=7):
    """Adam on the log loss; returns the folded model (one number per bucket, bias). Buckets that fewer than ``min_docs``
    texts have are left out."""
    rng = np.random.default_rng(seed)
    seen = np.zeros(buckets, np.int32)
    for i in ids:
        seen[i] += 1
    use = seen >= min_docs
    place = (np.cumsum(use) - 1).astype(np.int32)
    docs = [(place[i[use[i]]], (SCALE / (PRIOR + n) * c[use[i]]).astype(np.float32)) for i, c, n in zip(ids, counts, totals)]
    emb = rng.normal(0, 0.1, (int(use.sum()), dim)).astype(np.float32)
    top = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params, first, second = [emb, top, bias], [np.zeros_like(p) for p in (emb, top, bias)], [np.zeros_like(p) for p in (emb, top, bias)]
    step, per_epoch = 0, max(1, -(-len(docs) // batch))
    while step < steps:
        order = rng.permutation(len(docs))
        for rows in np.array_split(order, per_epoch)[:steps - step]:
            lr = rate * (1 - step / steps)
            n = [len(docs[r][0]) for r in rows]
            own = np.repeat(np.arange(len(rows)), n)
            idx, val = np.concatenate([docs[r][0] for r in rows]), np.concatenate([docs[r][1] for r in rows])
            delta = top[:, 1] - top[:, 0]
            logit = np.bincount(own, val * (emb @ delta)[idx], len(rows)) + bias[1] - bias[0]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            err = ((p - ys[rows]) * weights[rows]).astype(np.float32) / len(rows)
            g = np.bincount(idx, val * err[own], len(emb)).astype(np.float32)
            gd = emb.T @ g
            grads = [np.outer(g, delta) + decay * emb, np.stack([-gd, gd], 1), np.array([-err.sum(), err.sum()], np.float32)]
            step += 1
            for k, grad in enumerate(grads):
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.01 * (grad * grad - second[k])
                params[k] -= lr * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)
    folded = np.zeros(buckets, np.float32)
    folded[use] = emb @ (top[:, 1] - top[:, 0])
    return folded, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """Model from the labelled rows that are not held out. Runs jobs; a task trains on at most 2 * per_class packed rows."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.filter((F.pmod(doc_crc(), F.lit(5)) != 0) & F.col("y").isin(0, 1))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    constant = np.zeros(BUCKETS, np.float32), 30.0 if set(sizes) == {1} else -30.0
    if len(sizes) < 2:
        return constant
    chosen = bounded(known, "y", sizes, per_class)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def learn(batches):
        held = list(batches)
        rows = pa.Table.from_batches(held).to_pandas() if held else None
        model = fitted(rows, sizes) if held and rows["y"].nunique() == 2 else None
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model[0].tobytes()], pa.binary()), pa.array([model[1]], pa.float64())], ["folded", "bias"])

    # One task trains: it gets the bounded sample, packed.
    got = counted(texts).repartition(1).mapInArrow(learn, "folded binary, bias double").collect()
    return (np.frombuffer(got[0]["folded"], np.float32), got[0]["bias"]) if got else constant


def fitted(rows, sizes: dict):
    """The model of packed training rows (as `counted` gives them); ``sizes``: labelled rows of each class."""
    ys = rows["y"].to_numpy(np.float32)
    ids = [np.frombuffer(b, "<i4") for b in rows["ids"]]
    counts = [np.frombuffer(b, "<u2") for b in rows["counts"]]
    totals = rows["total"].to_numpy()
    order = sorted(range(len(ys)), key=lambda i: (ys[i], ids[i].tobytes()))
    ys, ids, counts, totals = ys[order], [ids[i] for i in order], [counts[i] for i in order], totals[order]
    n = {y: max(1, int((ys == y).sum())) for y in (0, 1)}
    weights = np.array([sizes[int(y)] / n[int(y)] for y in ys], np.float32)
    return train(ys, ids, counts, totals, weights / weights.mean())


def score_texts(texts, folded, bias) -> np.ndarray:
    out = np.empty(len(texts))
    for a, b in ngrams.chunks(texts):
        total, count = np.zeros(b - a), np.zeros(b - a)
        for o, h in bag(texts[a:b]):
            total += np.bincount(o, folded[h], b - a)
            count += np.bincount(o, minlength=b - a)
        out[a:b] = SCALE * total / (PRIOR + count) + bias
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def scored(df: DataFrame, model) -> DataFrame:
    """Add ``_score`` to rows with a column ``_text``; ``_text`` goes."""
    names = [c for c in df.columns if c != "_text"]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        folded, bias = shared.value
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(score_texts(texts, folded, bias), pa.float64())], [*names, "_score"])

    return df.mapInArrow(run, df.select(*[F.col(f"`{c}`") for c in names]).schema.add("_score", "double"))


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    out = scored(docs.select("doc_id", F.col("text").alias("_text")), model)
    return out.select("doc_id", F.coalesce(F.pmod(doc_crc(), F.lit(5)) == 0, F.lit(False)).alias("held_out"),
                      F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Documents scored below ``limit``, with all their columns."""
    model = fit(docs, labels)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = scored(plain.withColumn("_text", F.col(f"c{names.index('text')}")), model).filter(F.col("_score") < limit)
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
