"""Personal data: exact base rules, and further spans that boosted trees pick from the proposals of loose generators.

Base spans (e-mail, IP, card, phone) follow fixed patterns and stay whatever the model says. Generators with high recall
propose overlapping spans that those patterns miss: disguised addresses, phone numbers without a plus sign, cards and
addresses with unusual separators. Format and context features of each proposal go through gradient boosted trees; scores
are calibrated on documents kept out of training, and for each kind the threshold is the lowest one at which the
calibrated precision reaches ``PRECISION`` (no threshold, no extra spans, where it is never reached).

No table marks personal data, so the labels come from the corpus: base spans are positives; each also gives disguised
twins in its own place (positive) and broken ones, such as a card with a wrong digit or a date in its stead (negative);
proposals beside base spans are negatives. Trees, calibration and thresholds come from all rows and whole texts: equal
examples are counted, the trees grow on histograms summed over Spark's tasks, calibration and thresholds on counts per step of
the score.

Nulls count as empty and have no spans; repeated rows each get theirs and count as often as they are there; an empty table
trains nothing and returns nothing.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.llm import boosting

KINDS = ("email", "ip", "card", "phone")
#: Distinct examples a task; steps of one point of the score (log odds).
BLOCK = 25_000
STEPS = 256
PRECISION = 0.95
NEAR = 24
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# The base patterns. Possessive repeats and the look-behind change no match; they keep long runs linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def small_part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 4 and int(p or 0) <= 255


def emails(t: str):
    """Matches of the e-mail pattern, found from each @ so that long texts stay linear."""
    free, at = 0, t.find("@")
    while at >= 0:
        run = t[free:at]
        start = free + len(run.rstrip(LOCAL))
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = t.find("@", free)


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order of start, then of kind."""
    out = []
    if "@" in t:
        out += [(a, b, "email") for a, b in emails(t)]
    for m in IP.finditer(t):
        if all(map(small_part, m.group().split("."))):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 12:
            d = NOT_DIGIT.sub("", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


GENERATORS = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}[ ]?(?:@|[\[(][ ]?at[ ]?[\])]|[ ]at[ ])[ ]?[\w-]{1,63}(?:(?:\.|[ ]?[\[(][ ]?dot[ ]?[\])][ ]?|[ ]dot[ ])[\w-]{1,63}){1,5}(?![\w-])", re.I)),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:[ ]?(?:\.|\[\.\]|,)[ ]?[0-9]{1,3}){3}(?![\w.])")),
    ("card", re.compile(r"(?<![\w.])[0-9](?:[ ./-]{0,2}[0-9]){11,18}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{0,2}\(?[0-9]{2,4}\)?){2,5}(?!\w)")),
)
HINT = re.compile(r"[0-9@]|\bdot\b|\[dot", re.I)
#: Spark's pattern for texts that may have a base span or a hint.
HINTED = r"[0-9@]|(?i:dot)"
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "pay", "account"),
        "phone": ("tel", "phone", "call", "mobile", "fax")}
FEATURES = 30


def candidates(t: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), kind) for kind, g in GENERATORS for m in g.finditer(t)] if HINT.search(t) else []


def features(t: str, start: int, end: int, kind: str) -> list[float]:
    s, left, right = t[start:end], t[max(0, start - NEAR):start], t[end:end + NEAR]
    digits = NOT_DIGIT.sub("", s)
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    low = left.lower()
    parts = [g.lstrip("0") or "0" for g in groups]
    return [*[float(kind == k) for k in KINDS], len(s), len(digits), sum(c.isalpha() for c in s), len(groups), max(sizes), min(sizes),
            s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("(") + s.count("["), s.startswith(("+", "00")), "@" in s,
            "dot" in s.lower(), " at " in s.lower() or "at]" in s.lower() or "at)" in s.lower(), luhn(digits) if 12 <= len(digits) <= 19 else -1,
            len(groups) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts), len(set(sizes)), int(digits[0]) if digits else -1,
            any(c in low for c in CUES[kind]), any(c in low for k in KINDS if k != kind for c in CUES[k]),
            bool(left) and left[-1].isalnum(), bool(right) and right[0].isalnum(), sum(c.isdigit() for c in left + right),
            len(sizes) == 3 and sizes in ([4, 2, 2], [2, 2, 4]), len(s.rpartition(".")[2]) if "." in s else 0]


def twins(t: str, start: int, end: int, kind: str, pick: int):
    """A base span in disguise (True) and broken (False), as (text, start, end, label)."""
    s, out = t[start:end], []
    digits = NOT_DIGIT.sub("", s)
    if kind == "email":
        user, _, host = s.partition("@")
        out = [(f"{user} at {host.replace('.', ' dot ')}", True), (f"{user}(at){host}", True), (f"{user}[at]{host.replace('.', '[dot]')}", True),
               (f"{user} (at) {host.replace('.', ' (dot) ', 1 + pick % 2)}", True),
               (f"at {user} at 3.{pick % 10}", False), (f"{user[:3]} at the.{pick % 10}", False)]
    elif kind == "ip":
        out = [(s.replace(".", "[.]"), True), (s.replace(".", " . "), True), (s.replace(".", ",", 3), False), (f"{s.rpartition('.')[0]}.{300 + pick % 600}", False),
               (f"{1 + pick % 9}.0.{pick % 7}.{pick % 3} beta", False)]
    elif kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + pick % 8) % 10)
        out = [(".".join(re.findall(".{1,4}", digits)), True), ("  ".join(re.findall(".{1,4}", digits)), True), (wrong, False),
               (" ".join(re.findall(".{1,4}", wrong)), False), (".".join(re.findall(".{1,4}", wrong)), False)]
    else:
        n = digits[-10:]
        out = [(f"({n[:3]}) {n[3:6]}-{n[6:]}", True), (f"{n[:3]}-{n[3:6]}-{n[6:]}", True), (f"00{digits[0]} {n[:3]} {n[3:6]} {n[6:]}", True),
               (f"20{pick % 100:02d}-{1 + pick % 12:02d}-{1 + pick % 28:02d}", False), (f"{1 + pick % 28:02d}/{1 + pick % 12:02d}/{1900 + pick % 130}", False),
               (n, False), (f"{n[:2]} {n[2:4]} {n[4:6]}", False), (f"{n[:3]}.{n[3:6]}.{n[6:9]}", False)]
    for new, label in out:
        yield t[:start] + new + t[end:], start, start + len(new), label


def examples(t: str, pick: int):
    """(features, label) of one training document."""
    base = base_spans(t)
    spots = {(a, b, k) for a, b, k in base}
    for a, b, k in candidates(t):
        if (a, b, k) in spots:
            yield features(t, a, b, k), 1
        elif not any(x < b and a < y for x, y, _ in base):
            yield features(t, a, b, k), 0
    for a, b, k in base:
        lo, hi = max(0, a - 80), b + 80
        for new, s, e, label in twins(t[lo:hi], a - lo, b - lo, k, pick):
            for x, y, kk in candidates(new):
                if kk == k and x < e and s < y and (not label or (x <= s and y >= e)):
                    yield features(new, x, y, kk), int(label)


def fit(docs: DataFrame):
    """(trees, calibration points, threshold per kind), or None without examples of both labels. Learns from all rows; runs
    a few jobs over them, then one a level of each tree over the distinct examples. The driver gets counts only: per value of
    a feature, per bin of a level, and per kind and step of the score."""
    def run(batches):
        for b in batches:
            held, xs, ys = [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                out = zlib.crc32(str(d).encode()) % 4 == 1
                for x, y in examples(t, d or 0):
                    held.append(out)
                    xs.append(np.array(x, np.int32).tobytes())
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.bool_()), pa.array(xs, pa.binary()), pa.array(ys, pa.int64())], ["held", "x", "y"])

    texts = docs.select("doc_id", "text").filter(F.col("text").rlike(HINTED))
    rows = texts.mapInArrow(run, "held boolean, x binary, y long").groupBy("held", "x").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).persist()
    try:
        return trained(rows)
    finally:
        rows.unpersist()


def arrays(batch) -> tuple:
    """Features, positives and number of a batch of examples."""
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).reshape(-1, FEATURES)
    return x, batch.column("pos").to_numpy(), batch.column("n").to_numpy()


def trained(rows: DataFrame):
    """(trees, calibration points, threshold per kind) from counted examples; None without both labels."""
    sizes = {r["held"]: r for r in rows.groupBy("held").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()}
    if not 0 < sum(r["pos"] for r in sizes.values()) < sum(r["n"] for r in sizes.values()):
        return None
    apart = len(sizes) == 2 and 0 < sizes[False]["pos"] < sizes[False]["n"]
    own, out = (rows.filter("not held"), rows.filter("held")) if apart else (rows, rows)
    used = [r for h, r in sizes.items() if not (apart and h)]

    def values(batches):
        for b in batches:
            x, _, n = arrays(b)
            for k, c in enumerate(x.T):
                v, at = np.unique(c, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(np.bincount(at, n).astype(np.int64))], ["feature", "value", "n"])

    # All features are lengths, counts or flags of a span whose pattern is bounded, so they have few values.
    got = own.mapInArrow(values, "feature int, value int, n long").groupBy("feature", "value").agg(F.sum("n").alias("n")).orderBy("feature", "value").collect()
    edges = []
    for k in range(FEATURES):
        mine = [r for r in got if r["feature"] == k]
        edges.append(boosting.bounds(np.array([r["value"] for r in mine]), np.array([r["n"] for r in mine])))
    start = boosting.start_of(sum(r["pos"] for r in used) / sum(r["n"] for r in used))

    def packed(batches):
        held = list(batches)
        if held:
            x, pos, n = (np.concatenate(c) for c in zip(*map(arrays, held)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(boosting.block(x, pos, n, edges, start))], pa.binary())], ["block"])

    parts = max(2, -(-sum(r["rows"] for r in used) // BLOCK))
    blocks = own.select("x", "pos", "n").repartition(parts).mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))
    trees = boosting.fit_blocks(blocks, edges, start)

    def grades(batches):
        for b in batches:
            x, pos, n = arrays(b)
            keys, at = np.unique(np.stack([x[:, :len(KINDS)].argmax(1), steps(trees, x)], 1), axis=0, return_inverse=True)
            at = at.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *[pa.array(np.bincount(at, v, len(keys)).astype(np.int64)) for v in (n, pos)]],
                                             ["kind", "step", "n", "pos"])

    counts = out.mapInArrow(grades, "kind long, step long, n long, pos long").groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    kind, step, n, pos = (np.array([r[c] for r in counts]) for c in ("kind", "step", "n", "pos"))
    points = isotonic(step, pos, n)
    return trees, points, thresholds(kind, np.interp(step, *points), pos, n)


def steps(trees, x) -> np.ndarray:
    """Scores of examples in steps of 1 / ``STEPS``."""
    return np.rint(trees.raw(x) * STEPS).astype(np.int64)


def thresholds(kind, prob, pos, n) -> dict:
    limits = {}
    for i, name in enumerate(KINDS):
        own = kind == i
        best = np.inf
        for level in sorted(set(prob[own].tolist()), reverse=True):
            at = own & (prob >= level)
            if pos[at].sum() / n[at].sum() >= PRECISION:
                best = level
            else:
                break
        limits[name] = max(0.5, best)
    return limits


def isotonic(raw, y, n=None):
    """Scores -> calibrated probability: pools neighbours until the share of positives rises with the score. ``y`` of ``n``
    (one, if not given) are positive."""
    blocks: list = []
    for r, v, k in sorted(zip(raw.tolist(), y.tolist(), (np.ones(len(y), int) if n is None else n).tolist())):
        if blocks and blocks[-1][3] == r:
            blocks[-1][0] += v
            blocks[-1][1] += k
        else:
            blocks.append([v, k, r, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v1, n1, _, hi = blocks.pop()
            blocks[-1][0] += v1
            blocks[-1][1] += n1
            blocks[-1][3] = hi
    xs, ps = [], []
    for v, n, lo, hi in blocks:
        xs += [lo, hi] if hi > lo else [lo]
        ps += [v / n] * (2 if hi > lo else 1)
    return np.array(xs), np.array(ps)


def spans(t: str, model) -> tuple[list, list]:
    """(base spans, all spans) of one text."""
    base = base_spans(t)
    if model is None:
        return base, base
    extra = [c for c in candidates(t) if not any(a < c[1] and c[0] < b for a, b, _ in base)]
    if not extra:
        return base, base
    trees, points, limits = model
    prob = np.interp(steps(trees, np.array([features(t, *c) for c in extra], np.int32)), *points)
    taken: list = []
    for p, c in sorted(zip(prob.tolist(), extra), key=lambda x: (-x[0], x[1])):
        if p >= limits[c[2]] and not any(a < c[1] and c[0] < b for a, b, _ in taken):
            taken.append(c)
    return base, sorted(base + taken, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def op3_pii(docs: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        model = shared.value
        for b in batches:
            cols = [[] for _ in range(6)]
            for t in b.column("text").to_pylist():
                base, every = spans(t or "", model)
                kinds = [k for _, _, k in base]
                for c, v in zip(cols, (*[kinds.count(k) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                                             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(t: str, model) -> str:
    """The text with every span replaced by its kind in square brackets; overlapping spans become one."""
    out, at, end = [], 0, 0
    for a, b, k in spans(t, model)[1]:
        if a >= end:
            out += [t[at:a], f"[{k.upper()}]"]
        end = max(end, b)
        at = end
    return "".join(out) + t[at:] if out else t


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with personal data masked in ``text`` (and ``n_chars``, where there is one, kept in step); all rows and
    columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        model = shared.value
        for b in batches:
            new = pa.array([None if t is None else masked(t, model) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, "_new"])

    done = plain.mapInArrow(run, plain.select("*").schema.add("_new", "string"))
    changed = ~F.col(f"c{at}").eqNullSafe(F.col("_new"))
    own = {"text": lambda c: F.col("_new"), "n_chars": lambda c: F.when(changed, F.length("_new").cast("long")).otherwise(F.col(c))}
    return done.select(*[own.get(n, F.col)(f"c{i}").alias(n) for i, n in enumerate(names)])
