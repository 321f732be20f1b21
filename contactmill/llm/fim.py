"""Fill-in-the-middle: every text is cut after two of its lines into prefix, middle and suffix, and put together anew.

A rolling hash of the last ``WINDOW`` bytes cuts a text into chunks whose bounds depend on the content alone, so that
copied passages give the same chunks wherever they stand. A chunk has a boundary summary: its code points, its line ends,
and whether it stops inside a line. Summaries are kept per task in a cache that compares the whole content of a chunk
before it answers (a dictionary over the bytes), holds at most ``CACHE`` bytes, and starts empty again beyond that: it
saves work and never changes a result. Summaries add up along a document, which gives its number of lines n and the
chunk in which a cut lies; only the (at most two) chunks with a cut are read again.

Nothing is shuffled; texts are read in blocks, so very long ones need memory for themselves and their output only.

A null text counts as empty, and an empty one is ``plain``, as is one that already holds a marker. A null id draws from
the empty string. Repeated rows draw the same cuts; an empty table gives an empty result. Input columns named like one of
the added ones (``fim_...``) are replaced, all others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WINDOW = 32
BITS = 10
SHORTEST = 256
LONGEST = 8192
BLOCK = 1 << 20
CACHE = 32 << 20
MARKS = ("<P>", "<S>", "<M>")
ADDED = "fim_n long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_text string"


def _gear() -> np.ndarray:
    """One number per byte value, by the finaliser of a 64-bit mixer."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def triggers(data: np.ndarray) -> np.ndarray:
    """Offsets at which a chunk may end: the hash of the ``WINDOW`` bytes before has ``BITS`` leading zeros, and a code
    point ends there."""
    found = []
    for at in range(0, len(data), BLOCK):
        lo = max(0, at - WINDOW + 1)
        h = GEAR[data[lo:at + BLOCK]]
        step = 1
        while step < WINDOW:
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        ends = np.flatnonzero(h[at - lo:] >> np.uint32(32 - BITS) == 0) + at + 1
        found.append(ends)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    ends = ends[ends < len(data)]
    return ends[(data[ends] & 0xC0) != 0x80]


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text in UTF-8, of ``SHORTEST`` to ``LONGEST`` bytes (the last may be shorter)."""
    out, last = [], 0
    for c in [*triggers(data).tolist(), len(data)]:
        if c - last < SHORTEST and c < len(data):
            continue
        while c - last > LONGEST:
            cut = last + LONGEST
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(cut)
            last = cut
        if c > last and (c - last >= SHORTEST or c == len(data)):
            out.append(c)
            last = c
    return out


def summary(chunk: bytes) -> tuple[int, int, bool]:
    """Code points, line ends, and whether the chunk stops inside a line."""
    return len(str(chunk, "utf-8")), chunk.count(b"\n"), not chunk.endswith(b"\n")


class Memo:
    """Summaries by content, of at most ``limit`` bytes of chunks."""

    def __init__(self, limit: int = CACHE):
        self.limit, self.held, self.known = limit, 0, {}
        self.asked = self.hits = 0

    def __call__(self, chunk: bytes) -> tuple[int, int, bool]:
        self.asked += 1
        got = self.known.get(chunk)
        if got is not None:
            self.hits += 1
            return got
        if self.held + len(chunk) > self.limit:
            self.known, self.held = {}, 0
        got = self.known[chunk] = summary(chunk)
        self.held += len(chunk)
        return got


class Parts:
    """A text as chunks with running sums of their summaries."""

    def __init__(self, raw: bytes, memo):
        self.raw, self.ends = raw, chunk_ends(np.frombuffer(raw, np.uint8))
        got, at = [], 0
        for e in self.ends:
            got.append(memo(raw[at:e]))
            at = e
        sums = np.array([g[:2] for g in got], np.int64).reshape(-1, 2).cumsum(0)
        self.chars, self.lines = sums[:, 0], sums[:, 1]
        self.n = int(self.lines[-1]) + got[-1][2] if got else 0

    def after(self, k: int) -> tuple[int, int]:
        """(bytes, code points) up to the end of line ``k``, counted from 1; 0 stands for the start."""
        if k == 0:
            return 0, 0
        if k > self.lines[-1]:
            return len(self.raw), int(self.chars[-1])
        j = int(np.searchsorted(self.lines, k))
        start = self.ends[j - 1] if j else 0
        inside = k - (int(self.lines[j - 1]) if j else 0)
        chunk = self.raw[start:self.ends[j]]
        cut = int(np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10)[inside - 1]) + 1
        return start + cut, (int(self.chars[j - 1]) if j else 0) + len(str(chunk[:cut], "utf-8"))


def arranged(raw: bytes, h: tuple, memo, rate: int = 100, spm: int = 50) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text under the four drawn numbers."""
    parts = Parts(raw, memo)
    marks = [m.encode() for m in MARKS]
    if not raw or h[2] % 100 >= rate or any(m in raw for m in marks):
        return parts.n, "plain", None, None, raw
    lo, hi = sorted((h[0] % (parts.n + 1), h[1] % (parts.n + 1)))
    (a, ca), (b, cb) = parts.after(lo), parts.after(hi)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = marks
    form, out = ("spm", (s, suffix, p, prefix, m, middle)) if h[3] % 100 < spm else ("psm", (p, prefix, s, suffix, m, middle))
    return parts.n, form, ca, cb - ca, b"".join(out)


def drawn(doc_id, seed: int) -> Column:
    """The first four groups of eight hex digits of the digest of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, cache: int = CACHE) -> DataFrame:
    """Documents with ``fim_n`` (lines), ``fim_form`` (plain, psm, spm), ``fim_prefix_chars``, ``fim_middle_chars`` and
    ``fim_text``. ``rate`` per cent of the texts are transformed, ``spm`` per cent of those in the order suffix first."""
    names = docs.columns
    at = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*at)
    text, doc_id = at[names.index("text")], F.col(at[names.index("doc_id")])
    given = plain.select(*at, drawn(doc_id, seed).alias("_h"))
    new = StructType.fromDDL(ADDED)

    def run(batches):
        memo = Memo(cache)
        for b in batches:
            rows = [arranged(t or b"", h, memo, rate, spm) for t, h in zip(b.column(text).cast(pa.binary()).to_pylist(), b.column("_h").to_pylist())]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            cols = [pa.array([r[i] for r in rows], pa.binary() if i == 4 else k).cast(k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in at], *cols], [*at, *new.names])

    done = given.mapInArrow(run, StructType([*plain.schema.fields, *new.fields]))
    return done.select(*[F.col(c).alias(n) for n, c in zip(names, at) if n not in new.names], *new.names)


def restored(output, form) -> Column:
    """The text that an output was made of: split at the markers, and put in order again."""
    part = F.split(output, "|".join(MARKS), -1)
    piece = lambda i: F.get(part, F.lit(i))
    return (F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1)))
            .otherwise(output))


def op11_fim(docs: DataFrame) -> DataFrame:
    done = transformed(docs.select("doc_id", "text"))
    back = restored(F.col("fim_text"), F.col("fim_form"))
    return done.select("doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
                       F.col("fim_middle_chars").alias("middle_chars"), F.sha2(F.col("fim_text"), 256).alias("output_sha256"),
                       F.sha2(back, 256).alias("restored_sha256"))
