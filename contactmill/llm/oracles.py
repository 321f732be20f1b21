"""SQL twins (DuckDB) of the operators that SQL can express. Parameters are written out, not taken from the operators."""

RATES = {"symbols": ("n_symbols", "n_words", 1000), "dup_lines": ("n_dup_lines", "n_lines", 1000),
         "repeats": ("n_repeat_words", "n_words", 1000), "word_length": ("word_chars", "n_words", 100)}
#: What is never held against a document: 15 per mille of a share, or one occurrence (of repeated words: two windows).
ONCE = {"symbols": "n_symbols <= 1", "dup_lines": "n_dup_lines <= 1", "repeats": "n_repeat_words <= 10", "word_length": "false"}


def _fence(name: str, by: str) -> str:
    """Fences per group ``by``, from the sketch merged over it."""
    g, grouped = (by + ", ", f"GROUP BY {by}") if by else ("", "")
    part = f"PARTITION BY {g}measure"
    cols = ", ".join(f"max(fence) FILTER (measure = '{m}') AS max_{m}" for m in RATES)
    at = lambda q: f"min(bucket) FILTER (upto * 100 >= whole * {q})"
    width = lambda b: f"(1::BIGINT << greatest(length(bin({b})) - 6, 0))"
    reach = lambda far, near: f"3 * greatest({far} - {near}, {width(far)})"
    up = lambda far, near: f"{far} + {width(far)} - 1 + {reach(far, near)}"
    return f"""{name} AS (SELECT {g}max(docs) AS docs, {cols}, max(low) AS min_word_length FROM
 (SELECT *, CASE WHEN measure = 'word_length' THEN {up('q75', 'q25')} ELSE greatest({up('high', 'mid')}, 15) END AS fence, CASE WHEN measure = 'word_length' THEN q25 - {reach('q75', 'q25')} END AS low FROM
 (SELECT {g}measure, max(whole) AS docs, {at(25)} AS q25, {at(50)} AS mid, {at(75)} AS q75, {at(90)} AS high
 FROM (SELECT *, sum(n) OVER ({part} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER ({part}) AS whole FROM (SELECT {g}measure, bucket, sum(n) AS n FROM sketch GROUP BY {g}measure, bucket)) GROUP BY {g}measure)) {grouped})"""


def _chosen(column: str) -> str:
    return f"CASE WHEN own.docs >= 50 THEN own.{column} WHEN by_lang.docs >= 50 THEN by_lang.{column} ELSE every.{column} END"


FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT uid, i, array_to_string(words[i:i + 4], ' ') AS x FROM (SELECT uid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT uid, i FROM (SELECT *, count(*) OVER (PARTITION BY uid, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT uid, sum(step) AS n FROM (SELECT uid, least(5, i - lag(i, 1, -100) OVER (PARTITION BY uid ORDER BY i)) AS step FROM twice) GROUP BY uid),
m AS (SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
 length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
 FROM w LEFT JOIN rep USING (uid)),
r AS (SELECT *, {", ".join(f"CASE WHEN {b} > 0 THEN {u} * {a} // {b} ELSE 0 END AS r_{m}" for m, (a, b, u) in RATES.items())} FROM m),
each AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, r_{m} AS value FROM r" for m in RATES)}),
sketch AS (SELECT lang, source, measure, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bucket, count(*) AS n FROM each GROUP BY ALL),
{_fence("own", "lang, source")}, {_fence("by_lang", "lang")}, {_fence("every", "")}
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {FAILED} AS base_failed, NOT {FAILED}
 AND {" AND ".join(f"(r_{m} <= {_chosen('max_' + m)} OR {ONCE[m]})" for m in RATES)} AND r_word_length >= {_chosen('min_word_length')} AS kept
FROM r JOIN own ON r.lang IS NOT DISTINCT FROM own.lang AND r.source IS NOT DISTINCT FROM own.source JOIN by_lang ON r.lang IS NOT DISTINCT FROM by_lang.lang, every
"""

OP10 = """
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS rn,
 coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
 coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w),
r AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - 2.0::DOUBLE * size_before) / ((SELECT sum(weight) FROM w) - weight_before) AS rate FROM o),
f AS (SELECT min(rn) AS rn, arg_min(rate, rn) AS rate FROM r WHERE rate <= 2.0::DOUBLE * (source_size / weight)),
t AS (SELECT source, source_size, CASE WHEN f.rn IS NULL OR r.rn < f.rn THEN source_size * 2.0::DOUBLE ELSE weight * f.rate END AS target FROM r, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS expected, CAST(('0x' || substr(md5(coalesce(source, '')), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS shift FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS rn FROM d)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * (floor(rn * expected + shift) - floor((rn - 1) * expected + shift)) AS BIGINT) AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
c AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, [CAST('0x' || substr(digest, i, 8) AS BIGINT) FOR i IN [1, 9, 17, 25]] AS h FROM d),
k AS (SELECT *, len(lines) AS n, least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS lo, greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS hi,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(lines[1:lo], '') AS prefix, array_to_string(lines[lo + 1:hi], '') AS middle, array_to_string(lines[hi + 1:], '') AS suffix FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(t) AS restored_sha256
FROM p
"""

OP13 = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) AS r(k)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, k, a, j, array_to_string(w[:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.k, a, j, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
 FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x AND l.k = j JOIN f r ON r.lang = cuts.lang AND r.phrase = y AND r.k = cuts.k - j),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
g AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100::HUGEINT * c.a >= 80::HUGEINT * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM g) JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op7_quality": OP7, "op10_mixing": OP10, "op11_fim": OP11, "op13_phrases": OP13}
