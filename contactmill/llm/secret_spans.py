"""Secrets in texts: exact base rules, and further spans that a linear-chain conditional random field tags.

Base spans (assignments to a secret's name, access key ids, long hexadecimal runs) follow fixed patterns and stay whatever
the model says. For the rest a text is a sequence of tokens (runs of letters, digits and ``+/_-``), each tagged as the
begin of a secret, its inside, or outside. Features are the token's shape (length, kinds of characters and their changes,
hexadecimal digits, vowels, first characters), the words and separators around it, and those of the file (names of
secrets in it, share of characters of code). Viterbi finds the best tags; it is run only between tokens that are outside
on every best path (see ``crf.Chain.tags``), which is the same path. A span that overlaps a base span is left out. An
added span takes the kind it looks like: ``hex`` of hexadecimal digits alone, ``access`` of capitals and digits alone,
else ``assign``.

No table marks secrets, so the tags to learn from come from the corpus: base spans, and secrets of other formats and
things that only look like secrets, planted into texts at places drawn from a digest of the document. The sample is
bounded: the ``SAMPLE`` documents with the smallest hash of doc_id, at most ``PLACES`` windows of ``WINDOW`` tokens of
each. A margin for outside is then raised until ``PRECISION`` of the spans found in sampled documents that were kept out
of training are right (a span that was neither planted nor a base span counts as wrong); if it is never reached, nothing
is added. Everything else covers all rows and whole texts.

Nulls count as empty and have no spans; repeated rows each get theirs; an empty table trains nothing and returns nothing.
Texts are worked on in groups of about ``SLICE`` bytes, a longer one alone. In ``with_spans`` an input column ``secrets``
is replaced and all others stay. Runs a job for the training.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contactmill.llm import crf

KINDS = ("assign", "access", "hex")
SAMPLE = 1500
PLACES = 14
WINDOW = 14
PRECISION = 0.98
MARGINS = (0.0, 1.0, 2.0, 4.0, 6.0, 9.0)
SLICE = 4 << 20
SIZE = 1 << 15
REGION = 2000
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"

# The base patterns, on the bytes of a text (all their characters are ASCII). Runs of 24 and more hexadecimal digits are
# the runs of one and more that do not fail.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
NAMES = (b"passw", b"secret", b"token", b"api")

#: Classes of bytes: 0 between tokens, 1 lower, 2 upper, 3 digit, 4 sign, 5 part of a longer code point.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 5
CLASS[list(b"+/_-")] = 4
VOWEL, LOWHEX, UPHEX, CODE = (np.isin(np.arange(256), list(s)) for s in (b"aeiouyAEIOUY", b"0123456789abcdef", b"0123456789ABCDEF", b"={};:\"'<>"))
SECRET_WORDS = (b"password", b"passwd", b"passphrase", b"secret", b"token", b"apikey", b"api_key", b"credential", b"credentials", b"bearer", b"pwd", b"key")


def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, in order of start, then of kind."""
    out = []
    low = raw.lower()
    if any(n in low for n in NAMES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(raw)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Tokens:
    """Tokens of texts that lie end to end in ``data``; ``bounds`` are the texts' starts and the whole length."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        kind = CLASS[data]
        inside = kind > 0
        opens = bounds[:-1][bounds[:-1] < len(data)]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[opens], after[opens[opens > 0] - 1] = False, False
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(bounds, self.start, "right") - 1
        self.first = np.append(True, self.doc[1:] != self.doc[:-1])[:len(self.start)]
        self.kind = kind

    def _of(self, flags) -> np.ndarray:
        """Flagged bytes of each token."""
        upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return upto[self.end] - upto[self.start]

    def _eight(self, at, size) -> np.ndarray:
        """The bytes from ``at`` on, at most eight and ``size`` of them, as one number."""
        view = np.ndarray((len(self.data),), "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))
        keep = np.minimum(size, 8).astype(np.uint64)
        mask = np.where(keep >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(keep, 7) * np.uint64(8))) - np.uint64(1))
        return view[at] & mask

    def words(self) -> np.ndarray:
        """A number per token that stands for its letters, small ones and capitals alike."""
        size = self.end - self.start
        fold = np.uint64(0x2020202020202020)
        head = self._eight(self.start, size) | fold
        tail = self._eight(np.maximum(self.end - 8, self.start), size) | fold
        return mixed(head + mixed(tail + size.astype(np.uint64)))

    def _near(self, values, step) -> np.ndarray:
        """The value of the token ``step`` places on in the same text; 0 where there is none."""
        out = np.zeros(len(values), values.dtype)
        a, b = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
        out[a] = np.where(self.doc[a] == self.doc[b], values[b], 0)
        return out

    def features(self):
        """Yields one array of feature numbers per template."""
        if not len(self.start):
            return
        u = lambda x: np.asarray(x).astype(np.uint64)
        size = self.end - self.start
        kind, end, start = self.kind, self.end, self.start
        length = u(np.searchsorted([2, 3, 4, 6, 8, 11, 14, 17, 20, 24, 32, 40, 41, 64], size, "right"))
        share = lambda n: u(np.minimum(4, -(-4 * n // size)))
        digits, upper, signs = share(self._of(kind == 3)), share(self._of(kind == 2)), u(np.minimum(3, self._of(kind == 4)))
        turn = np.zeros(len(kind), bool)
        turn[1:] = kind[1:] != kind[:-1]
        turns = share(np.maximum(0, self._of(turn) - turn[start]))
        low, up = self._of(LOWHEX[self.data]) == size, self._of(UPHEX[self.data]) == size
        hexa = u(low) + u(up) * np.uint64(2)
        vowels = u(np.minimum(5, 8 * self._of(VOWEL[self.data]) // size))
        high = u(self._of(kind == 5) > 0)
        shape = digits + np.uint64(5) * (upper + np.uint64(5) * (np.minimum(signs, np.uint64(1)) + np.uint64(2) * (high + np.uint64(2) * hexa)))
        full = shape * np.uint64(16) + length
        rough = np.minimum(length, np.uint64(9)) * np.uint64(4) + u(digits > 0) + u(upper > 0) * np.uint64(2)
        word = self.words()
        ends = u(kind[start]) * np.uint64(6) + u(kind[end - 1])
        prefix = self._eight(start, np.minimum(size, 4))
        # Separators: the first bytes after a token, and how many.
        gap = np.where(np.append(self.first[1:], True), self.bounds[self.doc + 1], np.append(start[1:], 0)) - end
        after = np.where(gap > 0, self._eight(np.minimum(end, len(self.data) - 1), np.minimum(gap, 4)), np.uint64(0)) + (u(np.minimum(gap, 5)) << np.uint64(40))
        ahead = self._near(after, -1)
        known = np.isin(word, WORDS_KNOWN)
        docs = len(self.bounds) - 1
        names = u(np.minimum(2, np.bincount(self.doc, known, docs).astype(np.int64)))[self.doc]
        code = np.concatenate([[0], np.cumsum(CODE[self.data], dtype=np.int64)])
        code = code[self.bounds[1:]] - code[self.bounds[:-1]]
        code = u(np.searchsorted([0.002, 0.01, 0.03], code / np.maximum(1, np.diff(self.bounds)), "right"))[self.doc]
        w1, w2, n1 = self._near(word, -1), self._near(word, -2), self._near(word, 1)
        s1, f1 = self._near(full, -1), self._near(full, 1)
        by = np.uint64(16)
        for i, v in enumerate((full, digits * by + length, upper * by + length, signs * by + length, turns * by + length, hexa * by + length, vowels * by + length,
                               ends * by + length, shape, turns * by + vowels + (shape << np.uint64(10)), word, w1, w2, n1, ahead, after, w1 + ahead * np.uint64(3),
                               w1 + ahead * np.uint64(3) + rough * np.uint64(0x10001), mixed(ahead) + full, mixed(after) + full, mixed(s1) + full, mixed(f1) + full,
                               w2 + w1 * np.uint64(5), names * np.uint64(64) + rough, code * np.uint64(64) + rough, prefix, prefix + (length << np.uint64(36)))):
            yield (mixed((v + np.uint64(i + 1)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i)) >> np.uint64(40)).astype(np.int64) & (SIZE - 1)


def of_texts(raws: list[bytes]) -> Tokens:
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raws], dtype=np.int64)])
    return Tokens(np.frombuffer(b"".join(raws), np.uint8), bounds)


WORDS_KNOWN = of_texts(list(SECRET_WORDS)).words()


def grouped(tags: np.ndarray, tokens: Tokens) -> list[tuple[int, int, int]]:
    """Tags -> (text, start, end) in bytes of the text, from a begin (or an inside after an outside) to the last inside."""
    hit = np.flatnonzero(tags)
    if not len(hit):
        return []
    fresh = (tags[hit] == crf.BEGIN) | tokens.first[hit] | np.append(True, hit[1:] != hit[:-1] + 1)
    begins = np.flatnonzero(fresh)
    lasts = np.append(begins[1:], len(hit)) - 1
    doc = tokens.doc[hit[begins]]
    at = tokens.bounds[doc]
    return list(zip(doc.tolist(), (tokens.start[hit[begins]] - at).tolist(), (tokens.end[hit[lasts]] - at).tolist()))


def looks_like(raw: bytes) -> str:
    value = re.sub(rb"[^A-Za-z0-9+/_]", b"", raw)
    if re.fullmatch(rb"[0-9a-fA-F]+", value):
        return "hex"
    return "access" if re.fullmatch(rb"[A-Z0-9]+", value) else "assign"


def found(raws: list[bytes], model) -> list[list[tuple[int, int, str, bool]]]:
    """Spans of each text, (start, end, kind, whether a base rule gave it) in bytes."""
    out = [[(a, b, k, True) for a, b, k in base_spans(r)] for r in raws]
    if model is None:
        return out
    chain, margin = model
    tokens = of_texts(raws)
    if len(tokens.start):
        e = chain.emissions(tokens.features())
        e[:, crf.OUTSIDE] += margin
        base = [list(o) for o in out]
        for doc, a, b in grouped(chain.tags(e, tokens.first), tokens):
            if not any(x < b and a < y for x, y, _, _ in base[doc]):
                out[doc].append((a, b, looks_like(raws[doc][a:b]), False))
    return [sorted(o, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for o in out]


def in_code_points(raw: bytes, spans: list) -> list:
    """Spans in code points for spans in bytes."""
    if not spans or raw.isascii():
        return spans
    rest = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)])
    return [(a - int(rest[a]), b - int(rest[b]), *more) for a, b, *more in spans]


def _digest(doc_id, i) -> bytes:
    return hashlib.sha256(f"{doc_id}/{i}".encode()).digest()


def secret_of(d: bytes) -> bytes:
    """A made secret in a format other than those of the base rules."""
    hexa, text = d.hex(), re.sub(rb"[+/=]", b"", base64.b64encode(d + d))
    value = (text[:24 + d[1] % 20], hexa[:32 + 8 * (d[1] % 3)].upper().encode(), text[:10 + d[1] % 12],
             b"-".join(text[8 * i:8 * i + 8 + d[1] % 4] for i in range(2 + d[1] % 3)))[d[0] % 4]
    plain = (b"ghp_" + text[:36], b"sk_live_" + text[:24], b"xoxb-" + str(int.from_bytes(d[4:9], "big")).encode() + b"-" + text[:24], b"AIza" + text[:35],
             hexa[:40].upper().encode(), text[:40], b"glpat-" + text[:20], base64.b64encode(d)[:40].rstrip(b"="))[d[2] % 8]
    head = (b"passphrase: ", b"pwd=", b"pwd = \"", b"Authorization: Bearer ", b"private key ", b"credential: ", b"auth_key=", b"DB_PASS=", b"login / ", b"my password is ",
            b"the secret is ", b"token ", b"access key: ", b"client key \"", b"pass: ", b"key: ")[d[3] % 16]
    return (head + b"\0" + value) if d[4] % 3 else b"\0" + plain


def lookalike_of(d: bytes) -> bytes:
    """Something that only looks like a secret."""
    hexa, n = d.hex(), int.from_bytes(d[:8], "big")
    word = lambda i: bytes(97 + d[(i + j) % 32] % 26 if j % 2 else b"aeiou"[d[(i + j) % 32] % 5] for j in range(3 + d[i] % 7))
    return (f"{hexa[:8]}-{hexa[8:12]}-{hexa[12:16]}-{hexa[16:20]}-{hexa[20:32]}".encode(), str(n)[:10 + d[9] % 9].encode(), b"commit " + hexa[:7 + d[9] % 4].encode(),
            f"{1990 + d[9] % 60}-{1 + d[10] % 12:02d}-{1 + d[11] % 28:02d}T{d[12] % 24:02d}:{d[13] % 60:02d}:{d[14] % 60:02d}Z".encode(), b"-".join(word(i) for i in range(3 + d[9] % 4)),
            b"".join(word(i).title() for i in range(3 + d[9] % 4)), b"_".join(word(i) for i in range(2 + d[9] % 4)).upper(), b"/".join(word(i) for i in range(2 + d[9] % 4)),
            b"the secret of " + word(3), b"a token of " + word(4), b"password reset for " + word(5), b"key " + word(6), b"pass: " + word(7), b"+" + str(n)[:11].encode(),
            f"{str(n)[:4]}-{str(n)[4:8]}-{str(n)[8:12]}-{str(n)[12:16]}".encode(), b"v" + ".".join(str(x % 30) for x in d[9:12]).encode(), b"".join(word(i) for i in range(5)),
            f"{word(3).decode()}{d[9]}@{word(5).decode()}.example.org".encode(), b"is" + str(d[9]).encode() + b"x" + str(d[10]).encode(), b"https://" + word(2) + b".example.com/" + word(9) + str(n)[:6].encode())[d[8] % 20]


def windows(raw: bytes, spans: list, focus: list | None, most: int):
    """(features, tags) of windows around tokens of one text: those at the places ``focus``, or at most ``most`` of those
    that look unlike words, with a few others."""
    tokens = of_texts([raw])
    n = len(tokens.start)
    if not n:
        return
    x = np.stack(list(tokens.features()), 1)
    y = np.zeros(n, np.int64)
    for a, b in spans:
        at = np.flatnonzero((tokens.start < b) & (tokens.end > a))
        y[at] = crf.INSIDE
        y[at[:1]] = crf.BEGIN
    if focus is not None:
        places = [int(np.searchsorted(tokens.end, a, "right")) for a in focus]
    else:
        size, digits = tokens.end - tokens.start, tokens._of(tokens.kind == 3)
        odd = np.flatnonzero((size >= 14) | ((digits > 0) & (digits < size)) | (tokens._of(tokens.kind == 4) > 0) | (tokens._of(tokens.kind == 2) > 1) | (y > 0))
        draw = np.random.default_rng(zlib.crc32(raw))
        places = [*draw.permutation(odd)[:most - 3].tolist(), *draw.integers(0, n, 3).tolist()]
    for p in places:
        lo = max(0, min(p, n - 1) - WINDOW // 2)
        while lo and y[lo] == crf.INSIDE:
            lo -= 1
        hi = min(n, lo + WINDOW)
        yield x[lo:hi], y[lo:hi]


def examples(raw: bytes, doc_id):
    """Windows of one sampled document: as it is, with secrets planted, and with lookalikes."""
    base = base_spans(raw)
    values = [(m.start(1), m.end(1)) if (m := ASSIGN.match(raw, a)) and k == "assign" else (a, b) for a, b, k in base]
    yield from windows(raw, values, None, PLACES - 4)
    gaps = [m.start() for m in re.finditer(rb" ", raw[:REGION * 4])] or [len(raw)]
    for i in range(4):
        d = _digest(doc_id, i)
        at = gaps[int.from_bytes(d[20:24], "big") % len(gaps)]
        lo = max(0, at - REGION // 2)
        left, right = raw[lo:at], raw[at:at + REGION // 2]
        new = secret_of(d) if i % 2 == 0 else lookalike_of(d)
        head, cut, value = new.partition(b"\0")
        start = len(left) + 1 + len(head) if cut else None
        text = left + b" " + new.replace(b"\0", b"") + (b"\"" if head.endswith(b"\"") else b"") + right
        inside = [(a - lo, b - lo) for a, b in values if lo <= a and b <= at] + [(a - at + len(text) - len(right), b - at + len(text) - len(right)) for a, b in values if at <= a and b <= at + len(right)]
        own = [(start, start + len(value))] if cut else []
        yield from windows(text, inside + own, [start if cut else len(left) + 1], 1)


def fit(docs: DataFrame, sample: int = SAMPLE):
    """(chain, margin), or None where the sample gives no secret or the precision is not reached. Runs a job; one task
    trains on the windows of at most ``sample`` documents."""
    ids = docs.filter("doc_id is not null and text is not null").select(F.xxhash64("doc_id").alias("h"), "doc_id")
    chosen = ids.orderBy("h", "doc_id").limit(sample).select("doc_id").distinct()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                got = list(examples(t, d))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(got), pa.int64()), pa.array([x.ravel() for x, _ in got], pa.list_(pa.int64())),
                                                      pa.array([y for _, y in got], pa.list_(pa.int64()))], ["doc_id", "x", "y"])

    def learn(batches):
        held = list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained(pa.Table.from_batches(held)) if held else None)], pa.binary())], ["model"])

    rows = texts.mapInArrow(run, "doc_id long, x array<long>, y array<long>").repartition(1)
    got = rows.mapInArrow(learn, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def trained(rows: pa.Table):
    ids, ys, xs = rows["doc_id"].to_pylist(), rows["y"].to_pylist(), [np.array(x, np.int64) for x in rows["x"].to_pylist()]
    if not any(any(y) for y in ys):
        return None
    templates = len(xs[0]) // len(ys[0])
    order = sorted(range(len(ids)), key=lambda i: (ids[i], xs[i].tobytes()))
    longest = max(len(y) for y in ys)
    x, y = np.zeros((len(ids), longest, templates), np.int64), np.zeros((len(ids), longest), np.int64)
    size, out = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    for to, i in enumerate(order):
        size[to] = len(ys[i])
        x[to, :size[to]], y[to, :size[to]] = xs[i].reshape(-1, templates), ys[i]
        out[to] = zlib.crc32(str(ids[i]).encode()) % 4 == 1
    if out.all() or not out.any():
        out[:] = False
    chain = crf.fit(x[~out], y[~out], size[~out], SIZE)
    tests = out if out.any() else ~out
    for margin in MARGINS:
        right = total = 0
        for f, want, n in zip(x[tests], y[tests], size[tests]):
            e = chain.emissions(f[:n].T)
            e[:, crf.OUTSIDE] += margin
            got, told = runs(chain.decode(e)), runs(want[:n])
            right += len(got & told)
            total += len(got)
        if total and right >= PRECISION * total:
            return chain, margin
    return None


def runs(tags) -> set[tuple[int, int]]:
    """Spans of tokens."""
    out, start = set(), None
    for i, t in enumerate([*tags, crf.OUTSIDE]):
        if start is not None and t != crf.INSIDE:
            out.add((start, i))
            start = None
        if t == crf.BEGIN or (t == crf.INSIDE and start is None):
            start = i
    return out


def parts(texts: list[bytes]):
    """Runs of texts of about ``SLICE`` bytes."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > SLICE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def with_spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents with ``secrets``: their spans (kind, start, end in code points, whether a base rule gave it)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    names = docs.columns
    at = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*at)
    text = at[names.index("text")]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            raws = pc.fill_null(b.column(text).cast(pa.binary()), b"").to_pylist()
            spans = [in_code_points(r, s) for few in parts(raws) for r, s in zip(few, found(few, shared.value))]
            new = pa.array([[{"kind": k, "start": s, "end": e, "base": own} for s, e, k, own in x] for x in spans], kind)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in at], new], [*at, "_new"])

    done = plain.mapInArrow(run, StructType([*plain.schema.fields, *StructType.fromDDL(f"_new {SPANS}").fields]))
    return done.select(*[F.col(c).alias(n) for n, c in zip(names, at) if n != "secrets"], F.col("_new").alias("secrets"))


def op12_secrets(docs: DataFrame) -> DataFrame:
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return with_spans(docs.select("doc_id", "text")).select("doc_id", *[count(k) for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))
