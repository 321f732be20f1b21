"""Joins and lookups."""

from __future__ import annotations

import itertools
import math
import zlib
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.functions import text as X
from contactmill.functions.graph import connected
from contactmill.functions.joins import hot_join
from contactmill.session import forget, written


def similar_url_hint(probe: DataFrame, cache: DataFrame) -> DataFrame:
    """Newest cached class whose path is a prefix of the probe's path on the same site, confidence reduced by 10%.

    Written as an equi-join: the cache is reduced to the newest row per (site, path); a probe is expanded to those
    prefixes of its own path whose length occurs in the cache for its site, as hashes of eight bytes. Rows and bytes grow
    with the number of such lengths, not with the size of a site or of a path; a hit is verified on the text.
    """
    site = lambda c: F.concat_ws("://", X.scheme(c), X.netloc(c))
    newest = (cache.filter(X.url_path("url") != "")
              .select(site("url").alias("site"), F.regexp_replace(X.url_path("url"), r"/+$", "").alias("prefix"),
                      "ts", "url", "classification", "confidence"))
    newest = (newest.groupBy("site", "prefix")
              .agg(F.max_by(F.struct("ts", "classification", "confidence", "url"), F.struct("ts", F.expr("-crc32(url)"))).alias("hit")))
    newest = newest.withColumn("len", F.length("prefix"))
    lengths = newest.groupBy("site").agg(F.collect_set("len").alias("lens"))
    probes = hot_join(probe.select("id", site("url").alias("site"), X.url_path("url").alias("path")), lengths, "site", "id", how="inner")
    probes = probes.select("id", "site", "path", F.explode(F.filter("lens", lambda n: n <= F.length("path"))).alias("len"))
    probes = probes.withColumn("_k", F.xxhash64("site", "len", F.expr("substring(path, 1, len)")))
    keyed = newest.withColumn("_k", F.xxhash64("site", "len", "prefix")).select("_k", "prefix", F.col("site").alias("_site"), "hit")
    met = probes.join(keyed, "_k").filter((F.col("site") == F.col("_site")) & F.expr("prefix = substring(path, 1, len)"))
    best = met.groupBy("id").agg(F.max_by("hit", F.struct(F.col("hit.ts"), F.expr("-crc32(hit.url)"))).alias("hit"))
    return best.select("id", "hit.classification", (F.col("hit.confidence") * 0.9).alias("confidence"))


# --- contact keys ---------------------------------------------------------------------------------------------

def email_key(c) -> Column:
    return F.when(~X.blank(c), F.concat(F.lit("e:"), F.lower(X.strip(c))))


def phone_key(c) -> Column:
    return F.when(X.digits(c) != "", F.concat(F.lit("p:"), X.digits(c)))


def raw_phone_key(c) -> Column:
    return F.when(~X.blank(c), F.concat(F.lit("p:"), X.strip(c)))


def contact_keys(emails, phones, phone=raw_phone_key) -> Column:
    """Distinct keys of the contacts of one lead."""
    arr = lambda a: F.coalesce(X.col(a), F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(F.transform(arr(emails), email_key), F.transform(arr(phones), phone))))


def _low(fields) -> list[Column]:
    return [F.lower(X.strip(F.coalesce(X.col(f), F.lit("")))) for f in fields]


def field_mask(*fields) -> Column:
    """Which of the fields are filled, as bits."""
    return reduce(lambda a, b: a + b, [F.when(c != "", 2 ** i).otherwise(0) for i, c in enumerate(_low(fields))])


def subset_keys(*fields, masks=None) -> Column:
    """Keys of every non-empty subset of the filled fields (or of those in ``masks``): what a partially filled row could
    ask for."""
    low, keys = _low(fields), []
    for mask in range(1, 2 ** len(fields)) if masks is None else sorted(masks):
        used = [low[i] for i in range(len(fields)) if mask >> i & 1]
        keys.append(F.when(reduce(and_, [u != "" for u in used]), F.concat_ws("\u0001", F.lit(f"f{mask}:"), *used)))
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def full_key(*fields) -> Column:
    """Key over exactly the filled fields (null when none is filled)."""
    low, mask = _low(fields), field_mask(*fields)
    return F.when(mask > 0, F.concat_ws("\u0001", F.concat(F.lit("f"), mask.cast("string"), F.lit(":")),
                                        *[F.nullif(c, F.lit("")) for c in low]))


def _known(rows: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """Ids of rows that share a key with the store. The stored keys are reduced to one row each; a key that very many new
    rows hold is split before the join."""
    keyed = rows.select("id", F.explode("keys").alias("key"))
    return hot_join(keyed, stored_keys.select(F.explode("keys").alias("key")).distinct(), "key", "id", how="inner").select("id").distinct()


def dup_unified(leads: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids of leads that the store already has: same email or phone; a lead without contacts matches on those of
    name, URL, company and type that it has, whatever contacts the stored lead holds."""
    fields = ("full_name", "url", "company_name", "content_type")
    c = contact_keys("emails", "phones")
    # At most 15 masks of filled fields occur among the new rows; stored rows get keys for those only. Runs a job.
    asked = leads.filter(F.size(c) == 0).select(field_mask(*fields).alias("m")).distinct().collect()
    masks = [r["m"] for r in asked if r["m"]]
    new = leads.select("id", F.when(F.size(c) > 0, c).otherwise(F.array_compact(F.array(full_key(*fields)))).alias("keys"))
    old = stored.select(F.concat(contact_keys("emails", "phones"), subset_keys(*fields, masks=masks)).alias("keys"))
    return _known(new, old)


def first_holders(rows: DataFrame, stored_keys: DataFrame | None = None) -> DataFrame:
    """``rows(id, ord, keys)`` -> ids that hold every one of their keys first, in arrival order and after the store.

    Each key is reduced to its first holder (partial aggregation before the shuffle), then holders are counted per
    id: no join on the key, so a key shared by a third of all rows costs one row per map task.
    """
    held = rows.select(F.explode("keys").alias("key"), "ord", "id")
    if stored_keys is not None:
        blocked = stored_keys.select(F.explode("keys").alias("key")).select(
            "key", F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"))
        held = held.unionByName(blocked)
    # Nulls sort first, so a stored key wins over every arrival.
    first = held.groupBy("key").agg(F.min(F.struct("ord", "id")).alias("h")).select(F.col("h.id").alias("id"))
    owned = first.filter("id is not null").groupBy("id").agg(F.count("*").alias("owned"))
    kept = rows.join(owned, "id", "left").filter(F.coalesce(F.col("owned"), F.lit(0)) == F.size("keys"))
    return kept.select("id")


def crawl_keys() -> Column:
    """Emails and phones of a lead; of one without contacts, its name, URL, company and type."""
    c = contact_keys("emails", "phones")
    return F.when(F.size(c) > 0, c).otherwise(F.array_compact(F.array(full_key("full_name", "url", "company_name", "content_type"))))


def dup_crawl(leads: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids of the batch that are new: no email or phone of an earlier row or of the store; rows without contacts are
    compared with other rows without contacts on name, URL, company and type."""
    keys = crawl_keys().alias("keys")
    return first_holders(leads.select("id", "ord", keys), stored.select(keys))


def web_keys(emails, phones, websites, name) -> Column:
    """Any email, any phone by digits, or business name with a website."""
    n = F.lower(X.strip(F.coalesce(X.col(name), F.lit(""))))
    sites = F.transform(X.clean_array(websites), lambda w: F.when(n != "", F.concat(F.lit("w:"), n, F.lit("\u0001"), X.strip(w))))
    return F.array_distinct(F.array_compact(F.concat(contact_keys(emails, phones, phone_key), sites)))


def dup_web(leads: DataFrame, stored: DataFrame) -> DataFrame:
    keys = web_keys("emails", "phones", "websites", "business_name").alias("keys")
    return _known(leads.select("id", keys), stored.select(keys))


# --- the same rules against a persisted index of the store's keys -----------------------------------------------------

def unified_store_keys(stored: DataFrame) -> DataFrame:
    """(key, id) of a store for `dup_unified_indexed`: contacts, and every non-empty subset of the fields a lead without
    contacts is compared on."""
    keys = F.concat(contact_keys("emails", "phones"), subset_keys("full_name", "url", "company_name", "content_type"))
    return stored.select(F.explode(keys).alias("key"), "id")


def crawl_store_keys(stored: DataFrame) -> DataFrame:
    return stored.select(F.explode(crawl_keys()).alias("key"), "id")


def web_store_keys(stored: DataFrame) -> DataFrame:
    return stored.select(F.explode(web_keys("emails", "phones", "websites", "business_name")).alias("key"), "id")


def _known_in(rows: DataFrame, index) -> DataFrame:
    """(id, first): ids of ``rows(id, keys)`` that share a key with the index, with the smallest id that holds one."""
    keyed = rows.select("id", F.explode("keys").alias("key"))
    found = index.known(keyed.select("key")).withColumnRenamed("id", "_first")
    return hot_join(keyed, found, "key", "id", how="inner").groupBy("id").agg(F.min("_first").alias("first"))


def dup_unified_indexed(leads: DataFrame, index) -> DataFrame:
    """`dup_unified` against a ``sources.keyindex`` over `unified_store_keys`: the store itself is not read."""
    c = contact_keys("emails", "phones")
    fields = ("full_name", "url", "company_name", "content_type")
    keys = F.when(F.size(c) > 0, c).otherwise(F.array_compact(F.array(full_key(*fields))))
    return _known_in(leads.select("id", keys.alias("keys")), index).select("id")


def dup_crawl_indexed(leads: DataFrame, index) -> DataFrame:
    """`dup_crawl` against an index over `crawl_store_keys`."""
    rows = leads.select("id", "ord", crawl_keys().alias("keys"))
    found = index.known(rows.select(F.explode("keys").alias("key")))
    return first_holders(rows, found.select(F.array("key").alias("keys")))


def dup_web_indexed(leads: DataFrame, index) -> DataFrame:
    """`dup_web` against an index over `web_store_keys`, with the first stored lead each one duplicates."""
    return _known_in(leads.select("id", web_keys("emails", "phones", "websites", "business_name").alias("keys")), index)


def dup_log(leads: DataFrame, stored: DataFrame, merged_at: Column) -> DataFrame:
    """For each duplicate the first stored lead it duplicates."""
    keys = web_keys("emails", "phones", "websites", "business_name")
    first = (stored.select(F.explode(keys).alias("key"), "id", "url").groupBy("key")
             .agg(F.min(F.struct("id", "url")).alias("o")))
    return (hot_join(leads.select("id", "url", F.explode(keys).alias("key")), first, "key", "id", how="inner")
            .groupBy("id", "url").agg(F.min("o").alias("o"))
            .select(F.col("o.url").alias("original_url"), F.col("url").alias("duplicate_url"), merged_at.alias("merged_at")))


def by_ids(leads: DataFrame, ids: DataFrame, status: str | None = None) -> DataFrame:
    out = leads.join(ids.select("id").distinct(), "id", "left_semi")
    return out if status is None else out.filter(F.col("status") == status)


def leads_missing_contact(leads: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.size(c) == 0, F.lit(True))
    return leads.filter(empty("emails") | empty("phones"))


def apply_contacts(leads: DataFrame, found: DataFrame) -> DataFrame:
    """``leads(id, contact{...})`` with the emails and phones that were found; other contact fields stay."""
    f = found.select("id", F.col("emails").alias("_e"), F.col("phone_numbers").alias("_p"))
    pick = lambda new, old: F.when(F.size(new) > 0, F.col(new)).otherwise(F.col(old))
    return (leads.join(f, "id", "left")
            .withColumn("contact", F.col("contact").withField("emails", pick("_e", "contact.emails"))
                        .withField("phone_numbers", pick("_p", "contact.phone_numbers"))).drop("_e", "_p"))


def post_to_profile(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """First profile row of each post author; missing contact fields come from the author's first post that has them."""
    from contactmill.operators.urls import first_per_key
    per_user = posts.filter(X.filled("username")).groupBy("username").agg(*[
        F.min_by(F.when(X.filled(c), F.col(c)), F.when(X.filled(c), F.col("id"))).alias("_" + c)
        for c in ("business_email", "business_phone_number")])
    own = first_per_key(profiles, ["username"], "id")
    fill = lambda c: F.coalesce(X.null_if_blank(c), F.col("_" + c)).alias(c)
    return per_user.join(own, "username").select("username", "id", fill("business_email"), fill("business_phone_number"))


# --- entities -------------------------------------------------------------------------------------------------

def components(members: DataFrame) -> DataFrame:
    """Connected components of ``members(id, key)``: ids that share a key belong together, transitively.

    Every key is first reduced to a star: its smallest id by partial aggregation, then one link per id that holds it, so
    a hub costs one link per id and its rows are split. Links, not members, go through the rounds (`graph.connected`),
    and ids that share no key never enter them; they come back as their own component. Runs jobs."""
    keyed = members.filter(F.col("key").isNotNull() & F.col("id").isNotNull())
    first = keyed.groupBy("key").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    links = hot_join(keyed, first, "key", "id", how="inner").filter("id <> _first").select(F.col("_first").alias("a"), F.col("id").alias("b")).distinct()
    found = written(connected(links))
    return (members.select("id").distinct().join(found.select(F.col("node").alias("id"), F.col("root").alias("component")), "id", "left")
            .select("id", F.coalesce("component", "id").alias("component")))


def dup_richest(rows: DataFrame, richness: Column) -> DataFrame:
    """``rows(id, ord, email, phone, ...)`` -> the richest row of every group linked by email or phone (ties: first
    arrival); rows without contacts stay."""
    keys = F.array_compact(F.array(F.when(~X.blank("email"), F.concat(F.lit("e:"), X.strip("email"))),
                                   F.when(~X.blank("phone"), F.concat(F.lit("p:"), X.strip("phone")))))
    scored = rows.withColumn("_rich", richness)
    comp = components(scored.select("id", F.explode(keys).alias("key")))
    grouped = scored.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = grouped.groupBy("component").agg(F.min(F.struct((-F.col("_rich")).alias("r"), "ord", "id")).alias("b"), F.count("*").alias("group_size"))
    return best.select(F.col("b.id").alias("id"), "component", "group_size").join(rows, "id")


# --- fuzzy names ----------------------------------------------------------------------------------------------

def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


@F.pandas_udf(T.IntegerType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insert/delete similarity in whole percent: 2 * LCS / (len a + len b)."""
    return pd.Series([round(200 * _lcs(x, y) / (len(x) + len(y))) if x or y else 0 for x, y in zip(a, b)], dtype="int32")


# Non-deterministic only so that a filter on the result is not pushed below the projection (it would run twice).
ratio = _ratio.asNondeterministic()


#: A gram that more names than this have in their prefix is dense: names with one meet on letter classes.
DENSE = 256
BINS = 16
#: Rows of a bucket of names, about; rows that are shuffled in a round, rows met at a time, and rests held at a time.
BUCKET = 300_000
ROUND = 20_000_000
CHUNK = 50_000
PASS_ROWS = 4_000_000
#: Grams whose frequency the tasks know; only the order of grams, and which are dense, depends on it.
KNOWN = 1 << 17


def class_counts(room: int) -> int:
    """Into how many classes of letters two names that differ by ``room`` letters are split, so that some class holds few of
    the differences: three at most, two for long names, where letters left out would be in too many places."""
    if room < 8:
        return 1 + (room > 3)
    k = 3
    while 3 * k <= room:
        k = {3: 5}.get(k, k * 8 // 5)
    return k


def _dealt(letters: list, k: int) -> dict:
    """Letters, the one in most names first, dealt to k classes of about equal weight."""
    total, out = [0] * k, {}
    for letter, n in letters:
        out[letter] = i = total.index(min(total))
        total[i] += n
    return out


def _shortened(s: str, most: int):
    """(number of letters left out, rest) for every rest of ``s`` without up to ``most`` letters."""
    now = {s}
    for j in range(most + 1):
        yield from ((j, v) for v in now)
        now = {v[:i] + v[i + 1:] for v in now for i in range(len(v))} if j < most else now


def _prefixes(part: str, j: int, most: int, letters=None) -> list[tuple[str, int, str]]:
    """(prefix, letters left out so far, what follows) for every prefix of ``j`` letters that ``part`` has after up to ``most``
    letters are left out, at its earliest place, from which all rests with that prefix can be had. Rests shorter than ``j`` are
    a prefix by themselves, with an end mark. With ``letters``, a test, only prefixes whose first letter passes (an end mark counts as one)."""
    now, out, size = {"": 0}, [], len(part)
    for t in range(j):
        if size - t <= most:
            out += [(p + "\0", size - t, "") for p in now if p or letters is None or letters("\0")]
        then: dict = {}
        for p, at in now.items():
            for i in range(at, min(size, t + most + 1)):
                if t or letters is None or letters(part[i]):
                    q = p + part[i]
                    then[q] = min(then.get(q, size), i + 1)
        now = then
    return out + [(p, at - j, part[at:]) for p, at in now.items()]


def _met(rows: dict, t: float, pass_rows: int | None = None):
    """Rows of whole buckets -> index arrays of the pairs that may be similar, some millions at a time. All rests of a row (its tail without up to as many
    letters as it may still lose) become hashes, which are sorted; equal ones meet. Hashes are made in passes of about ``pass_rows``, pairs by
    their distance in the sorted order, so memory follows the number of rows."""
    mixed = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    meta = rows["meta"]
    k, cls, skip, budget = meta >> 18, meta >> 8 & 1023, meta >> 4 & 15, meta & 15
    n, sig, start = rows["n"].astype(np.int64), rows["sig"].view(np.uint64), mixed(rows["bucket"].view(np.uint64))
    sizes = np.fromiter(map(len, rows["tail"]), np.int64, len(meta))
    blocks, total = [], 0
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        code = np.frombuffer("".join(rows["tail"][i] for i in own.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), size)
        code = mixed(code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for d in range(min(size, int(budget[own].max())) + 1):
            here = budget[own] >= d
            blocks.append((own[here], code[here], size, d))
            total += int(here.sum()) * math.comb(size, d)
    passes = total // (pass_rows or PASS_ROWS) + 1
    kinds = np.array([class_counts(r) for r in range(2 * int(n.max()) + 2)])
    found, many = [], 0
    for turn in range(passes):
        hashes, at, lost = [], [], []
        for own, code, size, d in blocks:
            for keep in itertools.combinations(range(size), size - d):
                h = start[own]
                for c in keep:
                    h = (h ^ code[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(32)
                mine = h % np.uint64(passes) == np.uint64(turn) if passes > 1 else slice(None)
                hashes.append(h[mine])
                at.append(own[mine])
                lost.append((skip[own] + d)[mine])
        h, at, lost = np.concatenate(hashes), np.concatenate(at), np.concatenate(lost)
        order = np.lexsort((at, h))
        h, at, lost = h[order], at[order], lost[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        h, at, lost = h[fresh], at[fresh], lost[fresh]
        left, apart = np.arange(len(h)), 0
        while len(left):
            apart += 1
            left = left[left + apart < len(h)]
            left = left[h[left] == h[left + apart]]
            x, y, out = at[left], at[left + apart], lost[left] + lost[left + apart]
            room = np.floor((n[x] + n[y]) * (1 - t) + 1e-9).astype(np.int64)
            # Where the whole class agrees, the shorter rests do as well and need not meet.
            ok = (np.bitwise_count(sig[x] ^ sig[y]) <= room) & (out <= (room - cls[x]) // k[x]) & (kinds[room] == k[x])
            ok &= (rows["free"][x] | rows["free"][y]) & ((out == 0) | (rows["whole"][x] != rows["whole"][y]))
            ok &= np.minimum(n[x], n[y]) * 2.0 >= (n[x] + n[y]) * t - 1e-9
            found.append(x[ok] * len(n) + y[ok])
            many += len(found[-1])
            if many > PASS_ROWS:
                pairs = np.unique(np.concatenate(found))
                yield pairs // len(n), pairs % len(n)
                found, many = [], 0
    if many:
        pairs = np.unique(np.concatenate(found))
        yield pairs // len(n), pairs % len(n)


def _in_buckets(rows: DataFrame, t: float) -> DataFrame:
    """Rows ordered by ``bucket`` in each task -> pairs of names that may be similar, whole buckets at a time."""
    cols = ["bucket", "name", "n", "free", "sig", "whole", "meta", "tail"]

    def run(batches):
        def pairs(table):
            plain = {c: table[c].to_numpy() for c in cols if c not in ("name", "tail")}
            for x, y in _met(plain | {"tail": table["tail"].to_pylist()}, t):
                a, b = table["name"].take(pa.array(x)), table["name"].take(pa.array(y))
                yield from pa.table([a, b], ["a", "b"]).combine_chunks().to_batches(max_chunksize=10_000)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            bucket = batch.column("bucket").to_numpy()
            ends = np.flatnonzero(bucket[1:] != bucket[:-1])
            if size >= CHUNK and len(ends):
                cut = int(ends[-1]) + 1
                yield from pairs(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held, size = [batch.slice(cut)], batch.num_rows - cut
        if size:
            yield from pairs(pa.Table.from_batches(held))

    return rows.select(*cols).mapInArrow(run, "a string, b string")


def _by_classes(names: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of ``names(name, n, within, free)`` that may be similar; none that is gets lost.

    Split the letters into k classes: a letter that one name has and the other has not belongs to one class, so of ``room``
    differences class i holds at most (room - i) // k for some i (else there were more than ``room``), which k keeps at three or
    less. In that class what is left of both names agrees after leaving out so many letters in all, so names meet on those rests.

    Rests are not shuffled: names are, to the buckets of what their rests begin with (some tens for a name of 20 letters), and the rests of
    a bucket are made and met inside its task (`_met`). Buckets are gone through in rounds of about ``ROUND`` rows, so the disk in use does not grow with
    the table. Pairs whose counts of letters differ by more than the room fall before anything else is computed. Runs jobs;
    the letters (200 of them) and the lengths of names, both few, come to the driver to be dealt."""
    spark = names.sparkSession
    lengths = {r["n"]: r["count"] for r in names.groupBy("n").count().collect()}
    letters = [(r["c"], r["n"]) for r in names.select(F.explode(F.array_distinct(F.split("name", ""))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
               .orderBy(F.desc("n"), "c").limit(200).collect() if r["c"]]
    splits: dict = {}
    for x in lengths:
        for y in lengths:
            if min(x, y) * 2.0 >= (x + y) * t - 1e-9:
                r = math.floor((x + y) * (1 - t) + 1e-9)
                k = class_counts(r)
                splits.setdefault(x, {})[k] = max(splits.setdefault(x, {}).get(k, 0), r)
    dealt = {k: _dealt(letters, k) for k in {k for e in splits.values() for k in e} | {BINS}}
    n_parts, total = int(spark.conf.get("spark.sql.shuffle.partitions")), sum(lengths.values())
    deep: dict = {}
    for k in dealt:
        own = max(2, len(letters) // k)
        deep[k] = next((j for j in range(1, 9) if total * math.comb(j + 3, 3) <= BUCKET * own ** j and (total < BUCKET or k * own ** j >= 2 * n_parts)), 8)
    # Rounds: (class, part of the first letters) until there are about ROUND rows.
    rounds, full = [[]], 0
    for k in sorted({k for e in splits.values() for k in e}):
        for i in range(k):
            rows = sum(c * math.comb(deep[k] + (splits[x][k] - i) // k, deep[k]) for x, c in lengths.items() if k in splits[x] and splits[x][k] >= i)
            parts = max(1, math.ceil(rows / ROUND))
            for part in range(parts):
                if full and full + rows / parts > ROUND:
                    rounds.append([])
                    full = 0
                rounds[-1].append((k, i, part, parts))
                full += rows / parts

    def emit(todo):
        def run(batches):
            tests = {(part, parts): None if parts == 1 else (lambda c, part=part, parts=parts: zlib.crc32(c.encode("utf-8", "surrogatepass")) % parts == part)
                     for _, _, part, parts in todo}
            h = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            for b in batches:
                out: list = [[] for _ in range(6)]
                for at, (name, within) in enumerate(zip(b.column("name").to_pylist(), b.column("within").to_pylist())):
                    bins, mine = [0] * BINS, splits[len(name)]
                    for c in name:
                        bins[dealt[BINS].get(c, ord(c) % BINS)] += 1
                    sig = signed(sum(((1 << min(n, 4)) - 1) << 4 * i for i, n in enumerate(bins)))
                    for k, i, part, parts in todo:
                        if k not in mine or mine[k] < i:
                            continue
                        most, of = (mine[k] - i) // k, dealt[k]
                        own = "".join([c for c in name if of.get(c, ord(c) % k) == i])
                        whole = signed(h(own))
                        for prefix, skip, tail in _prefixes(own, deep[k], most, tests[part, parts]):
                            for col, v in zip(out, (at, signed(h(f"{k} {i} {prefix}\1{within}")), sig, whole, k << 18 | i << 8 | skip << 4 | (most - skip if tail else 0), tail)):
                                col.append(v)
                same = b.select(["name", "n", "free"]).take(pa.array(out[0], pa.int64()))
                new = [pa.array(v, ty) for v, ty in zip(out[1:], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*same.columns, *new], ["name", "n", "free", "bucket", "sig", "whole", "meta", "tail"])

        return run

    made = []
    for todo in rounds:
        rows = names.mapInArrow(emit(todo), "name string, n int, free boolean, bucket long, sig long, whole long, meta long, tail string")
        rows = rows.repartition(max(n_parts, ROUND // 500_000 if len(rounds) > 1 else 1), "bucket").sortWithinPartitions("bucket")
        room = F.floor((F.length("a") + F.length("b")) * (1 - t) + 1e-9).cast("int")
        made.append(written(_in_buckets(rows, t).filter(F.levenshtein("a", "b") <= room).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        forget(spark)
    return reduce(DataFrame.unionByName, made)


def _with_grams(names: DataFrame) -> DataFrame:
    """Adds ``grams``: the two-letter grams of each name, with what it is compared within. The k-th repeat of a gram inside a
    name is a gram of its own. A name without anything to be compared within has none."""
    def run(batches):
        for b in batches:
            out = []
            for name, within in zip(b.column("name").to_pylist(), b.column("within").to_pylist()):
                times: dict = {}
                for g in map("".join, zip(name, name[1:])) if name and within is not None else ():
                    times[g] = times.get(g, 0) + 1
                out.append([f"{g}{k}\u0001{within}" for g, n in times.items() for k in range(1, n + 1)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.string()))], [*b.schema.names, "grams"])

    return names.mapInArrow(run, T.StructType([*names.schema.fields, T.StructField("grams", T.ArrayType(T.StringType()))]))


def _most(grams: DataFrame) -> list[tuple[str, int]]:
    """The ``KNOWN`` most frequent values of ``g``, with their number."""
    top = grams.groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g").limit(KNOWN)
    return [(r["g"], r["n"]) for r in top.collect()]


def _with_keys(names: DataFrame, known: dict) -> DataFrame:
    """``need`` and ``grams`` replaced by ``keys``: the first grams in order of rarity, those that a similar name must share one of."""
    shared = names.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        df = shared.value
        for b in batches:
            out = []
            for gs, need in zip(b.column("grams").to_pylist(), b.column("need").to_pylist()):
                out.append(sorted(gs, key=lambda g: (df.get(g, 0), g))[:max(len(gs) - need + 1, 1)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.list_(pa.string()))], [*b.schema.names[:-2], "keys"])

    return names.mapInArrow(run, T.StructType([*names.schema.fields[:-2], T.StructField("keys", T.ArrayType(T.StringType()))]))


def _without(names: DataFrame, thick: set) -> DataFrame:
    """``keys`` without the dense ones, and ``thick``, how many these are."""
    shared = names.sparkSession.sparkContext.broadcast(thick)

    def run(batches):
        dense = shared.value
        for b in batches:
            keys = b.column("keys").to_pylist()
            rare = [sorted(g for g in gs if g not in dense) for gs in keys]
            new = [pa.array(rare, pa.list_(pa.string())), pa.array([len(x) - len(y) for x, y in zip(keys, rare)], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names, "thick"])

    return names.mapInArrow(run, T.StructType([*names.schema.fields, T.StructField("thick", T.IntegerType())]))


def similar_names(names: DataFrame, percent: int, dense: int = DENSE) -> DataFrame:
    """``names(name)``, distinct -> (a, b, percent) for every pair a < b at or above ``percent``; none is missed. With a column
    ``within``, a text, only names with the same one are compared; with a column ``free``, only pairs where one is free.

    Two names this similar share at least ``need`` two-letter grams (each deletion breaks at most two grams of a name,
    each insertion one).  Sorted by rarity, the first ``grams - need + 1`` grams of both then have one in common: an equi-join
    on single rare grams finds every such pair.

    A gram that more than ``dense`` names have in that prefix would give all its pairs. Names that have one meet on classes
    of letters instead (`_by_classes`), which tell names of random letters apart however many there are. Names that agree
    in most of their letters still meet, and are told apart by their counts of letters and then by distance.

    Where the longer name is so short that no common gram is implied (up to 3 letters at 80 percent), names are joined on
    a common letter: there are only so many names of that length. Runs jobs."""
    t = (percent - 0.5) / 100.0
    shortest = lambda n: F.ceil(n * (t / (2 - t)) - 1e-9)
    need_of = lambda n: F.greatest(F.ceil((n + shortest(n)) * (1.5 * t - 1) - 1 - 1e-9), F.lit(1)).cast("int")
    if percent < 70:
        raise ValueError("below 70 percent similar names need not share a gram")
    own = ["name", "n", "within", "free"]
    n_parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = names.select("name", F.length("name").alias("n"), F.col("within") if "within" in names.columns else F.lit("").alias("within"),
                         F.col("free") if "free" in names.columns else F.lit(True).alias("free"))
    # One row per distinct name, with its grams: written once. The rows are short but much work follows from each, so the
    # partition number is set by hand (adaptive execution would merge them by size), and by a hash, which is not how they come.
    sized = written(_with_grams(sized.repartition(n_parts, F.xxhash64("name"))))
    # The most frequent grams are known to all tasks; the others count as rarer than these. Grams are not shuffled with names.
    known = dict(_most(sized.select(F.explode("grams").alias("g"))))
    ordered = written(_with_keys(sized.withColumn("need", need_of(F.col("n"))).select(*own, "need", "grams"), known))
    thick = {g for g, n in _most(ordered.select(F.explode("keys").alias("g"))) if n > dense}
    told = written(_without(ordered, thick))
    # Edit distance never exceeds the insert/delete distance, so this JVM test is safe and leaves little to the UDF.
    room = F.floor((F.col("a.n") + F.col("b.n")) * (1 - t) + 1e-9).cast("int")
    close = F.least("a.n", "b.n") * 2.0 >= (F.col("a.n") + F.col("b.n")) * t - 1e-9
    also = F.col("a.free") | F.col("b.free")

    keyed = told.select("name", "n", "free", "keys", F.explode("keys").alias("sig"))
    a, b = keyed.alias("a"), keyed.alias("b")
    # A pair that has several rare grams in common is kept on the first.
    first = F.col("a.sig") == F.get(F.array_intersect("a.keys", "b.keys"), F.lit(0))
    near = (a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.name") < F.col("b.name")) & close & also & first)
            .filter(F.levenshtein("a.name", "b.name") <= room).select(F.col("a.name").alias("a"), F.col("b.name").alias("b")))
    # A pair with dense grams in common only: both have one.
    hot = told.filter("thick > 0").select(*own)
    if not hot.isEmpty():
        near = near.unionByName(_by_classes(hot, t))
    few = sized.filter((F.col("n") > 0) & ((F.col("n") + shortest(F.col("n"))) * (1.5 * t - 1) - 1 - 1e-9 <= 0))
    few = few.select("name", "within", "free", F.explode(F.array_distinct(F.split("name", ""))).alias("letter")).filter("letter <> ''")
    x, y = few.alias("x"), few.alias("y")
    tiny = x.join(y, (F.col("x.letter") == F.col("y.letter")) & (F.col("x.within") == F.col("y.within")) & (F.col("x.name") < F.col("y.name"))
                  & (F.col("x.free") | F.col("y.free"))).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    near = near.unionByName(tiny).distinct()
    return near.withColumn("percent", ratio("a", "b")).filter(F.col("percent") >= percent)


def similar_company_pairs(leads: DataFrame, percent: int = 85) -> DataFrame:
    """Pairs of distinct lower-cased company names; equal names are one entry, so they never form pairs."""
    names = leads.select(F.lower(X.strip("company_name")).alias("name")).filter(F.length("name") >= 3).distinct()
    return similar_names(names, percent)


ADDRESS_SHORT = [("street", "st"), ("avenue", "ave"), ("road", "rd"), ("boulevard", "blvd"), ("lane", "ln"),
                 ("drive", "dr"), ("court", "ct"), ("place", "pl"), ("apartment", "apt")]  # fixed values


def normal_address(c) -> Column:
    out = F.regexp_replace(F.lower(X.strip(c)), r"\s+", " ")
    for long, short in ADDRESS_SHORT:
        out = F.regexp_replace(out, rf"\b{long}\b", short)
    return F.regexp_replace(out, r"[^\p{L}\p{N}_\s-]", "")


def similar_address_pairs(leads: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs of distinct normalised addresses; two different house numbers never match, so addresses with a number are
    compared with those of the same number, and all of them with those that have none. Runs jobs."""
    names = leads.select(normal_address("address").alias("name")).filter(F.col("name") != "").distinct()
    names = written(names.withColumn("within", X.extract("name", r"^(\d+)")))
    pairs = similar_names(names.filter("within is not null"), percent)
    if names.filter("within is null").isEmpty():
        return pairs
    return pairs.unionByName(similar_names(names.select("name", F.col("within").isNull().alias("free")), percent))
