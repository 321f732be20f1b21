"""Column helpers shared by every operator.

Everything here returns a Spark ``Column`` built from JVM functions only, so the expressions stay inside
whole-stage code generation and can be pushed around freely by Catalyst.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of white space (``trim`` only removes blanks)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def blank(c) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def filled(c) -> Column:
    """Not null and not the empty string."""
    return F.coalesce(col(c), F.lit("")) != ""


def null_if_blank(c) -> Column:
    return F.when(~blank(c), col(c))


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def let(value, body) -> Column:
    """``body(v)`` with ``value`` computed once. A higher-order function evaluates everything in its lambda again for
    every element, so a costly input (a lower-cased text, a stripped page) has to be bound to a variable first."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def sql_text(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(sql_text, value)) + ")"
    return repr(value)


def word_array(words) -> Column:
    """Constant array in one expression text: building it literal by literal costs a driver call per word."""
    return F.expr(sql_text(list(words)))


def table_array(rows: list[dict]) -> Column:
    """Constant array of structs, in one expression text."""
    return F.expr("array(" + ", ".join(
        "struct(" + ", ".join(f"{sql_text(v)} AS `{k}`" for k, v in r.items()) + ")" for r in rows) + ")")


def has_any(c, words) -> Column:
    """True when the text contains at least one of the words. Plain substring search: much faster on long texts than an
    alternation pattern, and a constant array keeps the generated code of a rule chain small."""
    words = list(words)
    if len(words) <= 2:
        test = any_of([col(c).contains(w) for w in words])
    else:
        test = let(c, lambda t: F.exists(word_array(words), lambda w: F.contains(t, w)))
    return F.coalesce(test, F.lit(False))


def hits(c, words) -> Column:
    """The words found in the text, in the order of the word list."""
    return let(c, lambda t: F.filter(word_array(words), lambda w: F.contains(t, w)))


def n_hits(c, words) -> Column:
    """How many different words the text contains."""
    return F.size(hits(c, words))


def weighted_hits(c, weights, cap: int | None = None) -> Column:
    """Sum of weight times occurrences (each word counted at most ``cap`` times); ``weights`` are (word, weight)."""
    table = table_array([{"word": w, "weight": v} for w, v in weights])

    def add(t, total, row):
        seen = F.try_divide(F.length(t) - F.length(F.replace(t, row["word"], F.lit(""))), F.length(row["word"])).cast("int")
        seen = F.least(seen, F.lit(cap)) if cap else seen
        return F.when(F.contains(t, row["word"]), total + seen * row["weight"]).otherwise(total)

    return let(c, lambda t: F.aggregate(table, F.lit(0), lambda total, row: add(t, total, row)))


def first_rule(c, rules, default) -> Column:
    """``rules`` is an ordered list of (label, words); the first rule with a contained word wins."""
    out = None
    for label, words in rules:
        cond = has_any(c, words)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(default)


def occurrences(c, word: str) -> Column:
    """Non-overlapping occurrences of ``word``."""
    c = col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def words_regex(words) -> str:
    return "|".join(re.escape(w) for w in words)


def extract(c, pattern: str, group: int = 1) -> Column:
    """First match or null (``regexp_extract`` alone gives '' when nothing matches)."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def extract_all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), group)


def digits(c) -> Column:
    return F.regexp_replace(col(c), r"[^0-9]", "")


def phone_key(c) -> Column:
    """Digits and the plus sign only."""
    return F.regexp_replace(col(c), r"[^0-9+]", "")


def netloc(url) -> Column:
    """Authority part of a URL, '' when there is none; never fails on malformed input."""
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def scheme(url) -> Column:
    return F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)


def url_path(url) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def title_case(c) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}]+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, F.initcap), "")


def ordered_distinct(arr) -> Column:
    """Distinct items, first position kept."""
    return F.array_distinct(col(arr))


def clean_array(arr) -> Column:
    """Drop null and blank items; a null array becomes empty."""
    return F.filter(F.coalesce(col(arr), F.array().cast("array<string>")), lambda x: ~blank(x))


def as_array(c) -> Column:
    """Wrap a scalar into an array (null gives an empty array)."""
    return F.when(filled(c), F.array(col(c))).otherwise(F.array().cast("array<string>"))


def first_reliable(*cols, zero_is_missing: bool = False) -> Column:
    """First value that is neither null, blank nor 'N/A'."""
    bad = ["", "N/A"] + (["0"] if zero_is_missing else [])
    return F.coalesce(*[F.when(~col(c).isin(*bad), col(c)) for c in cols])


def reliable_int(*cols) -> Column:
    """First reliable value as a whole number, thousands separators removed; 0 when none parses."""
    return F.coalesce(*[F.regexp_replace(col(c), ",", "").try_cast("bigint") for c in cols], F.lit(0).cast("bigint"))


def parse_ts(c, fallback=None) -> Column:
    """ISO text with 'Z', an offset or no zone (taken as UTC), or a ``{"$date": ...}`` wrapper."""
    raw = F.coalesce(F.get_json_object(F.when(col(c).startswith("{"), col(c)), "$.$date"), col(c))
    ok = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), raw.try_cast("timestamp"))
    return F.coalesce(ok, fallback) if fallback is not None else ok


def epoch_ts(c) -> Column:
    """Seconds since 1970 as a timestamp."""
    return F.timestamp_micros((col(c).cast("double") * 1_000_000).cast("bigint"))


def short_count_trimmed(c) -> Column:
    """16000 -> 16K, 1234567 -> 1.2M; a trailing .0 is removed."""
    n = col(c).try_cast("bigint")
    one = lambda d: F.replace(F.format_string("%.1f", n / d), F.lit(".0"), F.lit(""))
    return (F.when(n >= 1_000_000, F.concat(one(1e6), F.lit("M")))
            .when(n >= 1_000, F.concat(one(1e3), F.lit("K")))
            .when(n.isNotNull(), n.cast("string"))
            .when(filled(c), col(c)))


def short_count(c) -> Column:
    """1234 -> 1.2K, with B for billions; text that is already shortened passes through."""
    n = F.regexp_replace(col(c), ",", "").try_cast("bigint")
    one = lambda d: F.format_string("%.1f", n / d)
    return (F.when(~filled(c), None)
            .when(col(c).rlike(r"\d+[KMB]"), col(c))
            .when(n >= 1_000_000_000, F.concat(one(1e9), F.lit("B")))
            .when(n >= 1_000_000, F.concat(one(1e6), F.lit("M")))
            .when(n >= 1_000, F.concat(one(1e3), F.lit("K")))
            .when(n.isNotNull(), n.cast("string"))
            .otherwise(col(c)))


def lead_id(platform, url) -> Column:
    """Deterministic identifier of a lead."""
    return F.sha2(F.concat_ws(":", col(platform), col(url)), 256)


def age_seconds(ts, as_of) -> Column:
    return F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(col(ts))


def whole_days(ts, as_of) -> Column:
    return F.floor(age_seconds(ts, as_of) / 86400)


def tagged(kind: str, arr) -> Column:
    """Array of values -> array of (kind, value), for a single ``inline`` over several lists."""
    return F.transform(col(arr), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def once(df, **exprs):
    """Add columns through a generator, so that later filters on them stay above it. A plain projection would be copied
    into every filter that follows, and its expressions would run once more for each."""
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def up_to(ranked, n: int | None):
    """Rows with ``rank`` up to ``n``; all of them without a limit."""
    return ranked if n is None else ranked.filter(F.col("rank") <= n)
