"""Contact queries and their SQL twins."""

from pyspark.sql import functions as F

from contactmill.functions import contact_rules as R
from contactmill.functions import text as X
from contactmill.operators import contacts as C
from contactmill.operators import pages as P
from contactmill.plans.catalog import query
from contactmill.plans.derived import q, sql_any, sql_netloc, sql_re, sql_rules, twin
from contactmill.plans.queries_pages import STRIP, texts
from contactmill.plans.queries_urls import FULL


def finds(table, key, pattern, extra=""):
    """Match value ``v`` and zero-based start ``st`` of every match, one row each."""
    return f"""(SELECT {key}, text, i, m[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS st{extra}
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, {q(pattern)}) AS m, regexp_split_to_array(text, {q(pattern)}) AS g FROM {table})))"""


def ctx(width):
    return f"lower(substr(text, greatest(st - {width}, 0) + 1, st + length(v) + {width} - greatest(st - {width}, 0)))"


DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
PKEY = "regexp_replace({0}, '[^0-9+]', '', 'g')"
BARE = "regexp_replace(regexp_replace({0}, '^\\++', ''), '^0+', '')"


def plausible(c):
    n = lambda ch: f"(length({c}) - length(replace({c}, '{ch}', '')))"
    return (f"(length({c}) >= 7 AND length({BARE.format(c)}) BETWEEN 7 AND 15 AND {n('0')} <= length({c}) * 0.7::DOUBLE AND {n('1')} <= length({c}) * 0.7::DOUBLE)")


FALSE_PHONE = f"({sql_any(ctx(100), R.NAVIGATION_WORDS)} OR regexp_matches(v, '^\\d{{4}}$') OR (regexp_matches(v, '^\\d{{8,}}$') AND contains({ctx(100)}, 'id')))"


def phone_candidates(table, key):
    parts = [f"""SELECT {key}, {k} AS k, i, {STRIP.format('v')} AS value, {PKEY.format('v')} AS clean,
 0.7::DOUBLE + CASE WHEN {sql_any(ctx(50), R.PHONE_WORDS)} THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN {sql_any(ctx(50), R.MOBILE_WORDS)} THEN 0.1::DOUBLE ELSE 0 END AS confidence
 FROM {finds(table, key, p)} WHERE {plausible(PKEY.format('v'))} AND NOT {FALSE_PHONE}""" for k, p in enumerate(R.PHONE_PATTERNS)]
    return " UNION ALL ".join(parts)


# Keep each candidate, in order, unless a kept one is nearly the same number (list_reduce over one-item lists).
FOLD = """list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda s: (contains(s.clean, x[1].clean) OR contains(x[1].clean, s.clean))
 AND abs(length(s.clean) - length(x[1].clean)) <= 2)) > 0 THEN acc ELSE list_concat(acc, x) END)"""


@query("extract_phones", twin(f"""
SELECT doc_id, kept[j].value AS value, kept[j].clean AS clean_value, kept[j].confidence AS confidence FROM
 (SELECT doc_id, kept, unnest(range(1, len(kept) + 1)) AS j FROM (SELECT doc_id, {FOLD} AS kept FROM
  (SELECT doc_id, list({{'value': value, 'clean': clean, 'confidence': confidence}} ORDER BY k, i) AS c FROM cand GROUP BY doc_id)))""",
                              cand=phone_candidates("documents", "doc_id")))
def extract_phones(t):
    return (t.documents.select("doc_id", F.inline(C.phones("text")))
            .select("doc_id", "value", "clean_value", "confidence"))


@query("extract_phones_pages", twin("SELECT page_id, regexp_extract(html, 'href=\"tel:([^\"]*)\"', 1) AS value, 0.95::DOUBLE AS confidence FROM fx_pages", "fx_pages"))
def extract_phones_pages(t):
    return (t.fx_pages.select("page_id", F.explode(C.phones(P.html_text("html"), "html")).alias("p"))
            .filter("p.source = 'tel_link'").select("page_id", "p.value", "p.confidence"))


RUN = r"\+?\d[-.\s()\d]{5,17}"
CANDS = f"SELECT doc_id, text, i, v, st FROM {finds('documents', 'doc_id', RUN)}"


@query("phone_plausible", twin(f"SELECT doc_id, v AS value, {plausible(PKEY.format('v'))} AS ok FROM cands", cands=CANDS))
def phone_plausible(t):
    return t.documents.select("doc_id", F.explode(X.extract_all("text", RUN)).alias("value")).withColumn("ok", C.phone_plausible(X.phone_key("value")))


@query("phone_near_dup", twin("""
SELECT id, array_to_string(list_transform(kept, lambda s: s.clean), ',') AS kept FROM (SELECT id, """ + FOLD + """ AS kept FROM
 (SELECT id, list({'clean': n} ORDER BY c_custkey) AS c FROM (SELECT c_custkey // 40 AS id, c_custkey, CAST(5550100 + c_custkey % 400 * 37 AS VARCHAR(20)) AS n FROM customer) GROUP BY id))"""))
def phone_near_dup(t):
    # Forty numbers stand for one page here; the operator itself works inside a row.
    rows = t.customer.select(F.expr("c_custkey div 40").alias("id"), "c_custkey", (F.lit(5550100) + F.col("c_custkey") % 400 * 37).cast("string").alias("n"))
    arr = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "n"))).alias("a"))
    blank = F.lit("")
    cand = F.transform("a", lambda s: F.struct(s["n"].alias("value"), s["n"].alias("clean_value"), F.lit(0.7).alias("confidence"),
                                               blank.alias("source"), blank.alias("context")))
    kept = C.drop_near_duplicates(cand, F.array().cast("array<string>"))
    return arr.select("id", F.array_join(F.transform(kept, lambda k: k["clean_value"]), ",").alias("kept"))


@query("phone_false_positive", twin(f"SELECT doc_id, v AS value, {FALSE_PHONE} AS bad FROM cands", cands=CANDS))
def phone_false_positive(t):
    f = t.documents.select("doc_id", "text", F.explode(C.finds("text", RUN)).alias("f"))
    return f.select("doc_id", "f.value", C.phone_false_positive("f.value", C.around("text", F.col("f"), 100)).alias("bad"))


ROLE = sql_rules("split_part(lower({0}), '@', 1)", R.EMAIL_ROLES, "'personal'")


def email_sql(table, key):
    return f"""SELECT {key}, lower(v) AS value, min(i) AS i, arg_min(CASE WHEN {sql_any(ctx(30), R.EMAIL_WORDS)} THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END, i) AS confidence
 FROM {finds(table, key, R.EMAIL)} GROUP BY {key}, lower(v)"""


@query("extract_emails", twin(f"""
SELECT doc_id, value, confidence, {ROLE.format('value')} AS role, 'text_pattern' AS source, {ROLE.format('value')} NOT IN ('info', 'contact', 'sales', 'support') AS is_personal FROM e""",
                              e=email_sql("documents", "doc_id")))
def extract_emails(t):
    return t.documents.select("doc_id", F.inline(C.emails("text")))


@query("extract_emails_pages", twin("""
SELECT page_id, value, max(confidence) AS confidence FROM (SELECT page_id, value, confidence FROM e UNION ALL
 SELECT page_id, split_part(regexp_extract(html, 'href="mailto:([^"]*)"', 1), '?', 1), 0.95::DOUBLE FROM fx_pages) GROUP BY page_id, value""",
                                    "fx_pages", txt=texts("fx_pages"), e=email_sql("txt", "page_id")))
def extract_emails_pages(t):
    return t.fx_pages.select("page_id", F.inline(C.emails(P.html_text("html"), "html"))).select("page_id", "value", "confidence")


MAILS = """SELECT c_custkey AS id, concat(CASE c_custkey % 9 WHEN 0 THEN 'Info' WHEN 1 THEN 'hello' WHEN 2 THEN 'quote' WHEN 3 THEN 'Support1' WHEN 4 THEN 'admin' WHEN 5 THEN 'promo' WHEN 6 THEN 'logo' WHEN 7 THEN '12345678901' ELSE 'jane' END,
 '@', CASE c_custkey % 7 WHEN 0 THEN 'example.com' WHEN 1 THEN 'shop.png' WHEN 2 THEN 'bad' ELSE 'firm.example.org' END) AS email,
 CASE c_custkey % 8 WHEN 0 THEN '1700000000' WHEN 1 THEN concat('(415) 555-', lpad(CAST(c_custkey % 9000 AS VARCHAR(5)), 4, '0')) WHEN 2 THEN '5555555' WHEN 3 THEN '0123456789'
  WHEN 4 THEN concat('+44 20 7946 0', lpad(CAST(c_custkey % 900 AS VARCHAR(5)), 3, '0')) WHEN 5 THEN concat('202555', lpad(CAST(c_custkey % 9000 AS VARCHAR(5)), 4, '0')) WHEN 6 THEN '12.5 em 400' ELSE concat('415-555-', lpad(CAST(c_custkey % 9000 AS VARCHAR(5)), 4, '0')) END AS phone,
 CASE c_custkey % 3 WHEN 0 THEN 'www.a.example.org' WHEN 1 THEN 'https://b.example.org' ELSE 'ftp://c' END AS site FROM customer"""


@query("email_role", twin(f"SELECT id, {ROLE.format('email')} AS role FROM mails", mails=MAILS))
def email_role(t):
    return t.sql(MAILS).select("id", C.email_role("email").alias("role"))


def strict_email_sql(e):
    return (f"(length({e}) BETWEEN 5 AND 100 AND regexp_matches({e}, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$') AND NOT {sql_any(f'lower({e})', R.ASSET_SUFFIXES)} "
            f"AND NOT {sql_re(f'lower({e})', R.ASSET_WORDS)} AND NOT regexp_matches({e}, '\\d{{8,}}') AND split_part(lower({e}), '@', 2) NOT IN ({', '.join(map(q, R.SAMPLE_DOMAINS))}))")


def strict_phone_sql(p):
    d = DIGITS.format(p)
    shape = f"regexp_replace({p}, '[^\\d+\\-().\\s]', '', 'g')"
    return (f"(NOT (contains({shape}, '.') AND contains({shape}, ' ')) AND length({d}) BETWEEN 7 AND 15 AND NOT (length({d}) = 13 AND starts_with({d}, '1')) "
            f"AND NOT (length({d}) = 10 AND regexp_matches({d}, '^[12]') AND coalesce(TRY_CAST({d} AS BIGINT), 0) BETWEEN 946684800 AND 2524608000) "
            f"AND length(replace({d}, left({d}, 1), '')) > 0 AND NOT (length({d}) >= 8 AND {sql_re(d, R.RISING_DIGITS)}) "
            f"AND NOT (length({p}) = length({d}) AND length({d}) > 10) AND NOT (NOT starts_with({p}, '+') AND starts_with({d}, '0') AND length({d}) > 7))")


def nanp_sql(p):
    d = DIGITS.format(p)
    return (f"(length({STRIP.format(p)}) >= 10 AND (length({d}) = 10 OR (length({d}) = 11 AND starts_with({d}, '1'))) AND NOT {sql_re(d, R.NANP_REJECT)})")


@query("strict_contacts", twin(f"SELECT id, {strict_email_sql('email')} AS email_ok, {strict_phone_sql('phone')} AS phone_ok, regexp_matches(site, '^(https?://|www\\.)') AS site_ok, {nanp_sql('phone')} AS nanp_ok FROM mails", mails=MAILS))
def strict_contacts(t):
    return t.sql(MAILS).select("id", C.strict_email("email").alias("email_ok"), C.strict_phone("phone").alias("phone_ok"),
                               C.strict_site("site").alias("site_ok"), C.nanp_phone_valid("phone").alias("nanp_ok"))


@query("nanp_phone_valid", twin(f"SELECT doc_id, v AS value, {nanp_sql('v')} AS ok FROM cands", cands=CANDS))
def nanp_phone_valid(t):
    return t.documents.select("doc_id", F.explode(X.extract_all("text", RUN)).alias("value")).withColumn("ok", C.nanp_phone_valid("value"))


PLACES = """SELECT c_custkey AS id, concat('Visit us at ', c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' Long Meadow Street Springfield 12345' WHEN 1 THEN ' North Harbour Road' WHEN 2 THEN ' BIG SHOUTING TEXT AVENUE' ELSE ' Our contact page street' END,
 '; mail P.O. Box ', c_nationkey, ' today.') AS text FROM customer"""


def address_sql(table, key):
    parts = [f"""SELECT {key}, {k} AS k, i, {STRIP.format('v')} AS value, text, st, v FROM {finds(table, key, p)}""" for k, p in enumerate(R.ADDRESS_PATTERNS)]
    bad = (f"({sql_any('lower(value)', R.ADDRESS_REJECT_WORDS)} OR (length(value) - length(regexp_replace(value, '\\p{{Lu}}', '', 'g'))) / CAST(length(value) AS DOUBLE) > 0.3::DOUBLE OR {sql_any(ctx(20), R.ADDRESS_SENTENCE_WORDS)})")
    return f"SELECT DISTINCT {key}, value FROM ({' UNION ALL '.join(parts)}) WHERE NOT {bad}"


@query("extract_addresses", twin(f"""
SELECT *, CASE WHEN contains(lower(value), 'box') THEN 'po_box' ELSE 'street' END AS type,
 0.6::DOUBLE + CASE WHEN regexp_matches(value, '\\d{{5}}(?:-\\d{{4}})?') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {sql_any('lower(value)', R.ADDRESS_STREET_WORDS)} THEN 0.1::DOUBLE ELSE 0 END AS confidence FROM a""",
                                 places=PLACES, a=address_sql("places", "id")))
def extract_addresses(t):
    return t.sql(PLACES).select("id", F.inline(C.addresses("text"))).drop("source")


@query("address_false_positive", twin("SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id", a=address_sql("documents", "doc_id")))
def address_false_positive(t):
    return t.documents.select("doc_id", F.explode(C.addresses("text")).alias("a")).groupBy("doc_id").agg(F.count("*").alias("n"))


SITES = """SELECT o_orderkey AS id, concat('https://www.own', o_orderkey % 9, '.example.org/p') AS url,
 concat('<a href="https://www.facebook.com/shop', o_orderkey, '">f</a> <a href="/about">a</a> <link href="https://cdn.jsdelivr.net/x.css">') AS html,
 concat('see www.acme-company', o_orderkey % 40, '.org and http://twitter.com/u', o_orderkey, ' or plain.dev or training-institute.org/x, own', o_orderkey % 9, '.example.org') AS text FROM orders"""
HREF = r"""(?i)href=["']([^"']+)["']"""
ABS = "CASE WHEN regexp_matches(u, '^https?://') THEN u WHEN starts_with(u, 'www.') OR (contains(u, '.') AND NOT starts_with(u, '/')) THEN 'https://' || u END"
OUT = f"""SELECT DISTINCT id, own, link, lower({sql_netloc('link')}) AS host FROM (SELECT id, {sql_netloc('url')} AS own, {ABS} AS link FROM
 (SELECT id, url, unnest(list_concat(regexp_extract_all(html, {q(HREF)}, 1), regexp_extract_all(text, {q(R.TEXT_URL)}))) AS u FROM sites)) WHERE link IS NOT NULL"""
SKIPH = f"(host = own OR {sql_any('host', R.SKIPPED_HOSTS)} OR regexp_matches(host, '^[^.]*\\.(tech|dev)$'))"
SOCIAL = sql_any("host", R.SOCIAL_HOSTS)
BIZ = f"(NOT {sql_any('host', R.STORE_HOSTS)} AND {sql_any('host', R.BUSINESS_HOST_WORDS)})"


@query("extract_web_social", twin(f"""
SELECT id, link AS url, {sql_rules('host', R.SOCIAL_NAMES, "'Unknown'")} AS label, 0.9::DOUBLE AS confidence FROM o WHERE NOT {SKIPH} AND {SOCIAL}
UNION ALL SELECT id, link, host, 0.8::DOUBLE FROM o WHERE NOT {SKIPH} AND NOT {SOCIAL} AND {BIZ}""", sites=SITES, o=OUT))
def extract_web_social(t):
    links = t.sql(SITES).select("id", C.outlinks("text", "html", "url").alias("o"))
    social = links.select("id", F.inline(C.social_media(F.col("o")))).select("id", "url", F.col("platform").alias("label"), "confidence")
    web = links.select("id", F.inline(C.websites(F.col("o")))).select("id", "url", F.col("domain").alias("label"), "confidence")
    return social.unionByName(web)


@query("domain_rules", twin(f"SELECT id, link AS url, {SKIPH} AS skipped, {SOCIAL} AS social, {BIZ} AS business, {sql_rules('host', R.SOCIAL_NAMES, chr(39) + 'Unknown' + chr(39))} AS name FROM o", sites=SITES, o=OUT))
def domain_rules(t):
    from contactmill.functions.text import extract_all, netloc
    raw = F.concat(extract_all("html", HREF, 1), extract_all("text", R.TEXT_URL))
    rows = (t.sql(SITES).select("id", netloc("url").alias("own"), F.explode(F.array_distinct(F.filter(F.transform(raw, C.absolute_url), lambda u: u.isNotNull()))).alias("url"))
            .withColumn("host", F.lower(netloc("url"))))
    return rows.select("id", "url", C.skip_host("host", "own").alias("skipped"), C.is_social("host").alias("social"),
                       C.business_host("host").alias("business"), C.social_name("host").alias("name"))


def scan_sql(ps, ok):
    lists = [f"regexp_extract_all(html, {q(p)}, {g})" for p, g in ps]
    return f"SELECT DISTINCT page_id, v FROM (SELECT page_id, {STRIP.format('u')} AS v FROM (SELECT page_id, unnest({' || '.join(lists)}) AS u FROM fx_rich)) WHERE {ok}"


@query("raw_contact_scan", twin(f"""
SELECT page_id, 'email' AS kind, v AS value FROM ({scan_sql([(R.SOURCE_EMAILS[0], 0), (R.SOURCE_EMAILS[1], 1), (R.SOURCE_EMAILS[2], 1)], strict_email_sql('v'))})
UNION ALL SELECT page_id, 'phone', v FROM ({scan_sql([(R.SOURCE_PHONES[0], 0), (R.SOURCE_PHONES[1], 1), (R.SOURCE_PHONES[2], 1), (R.SOURCE_PHONES[3], 0)], strict_phone_sql('v'))})
UNION ALL SELECT page_id, 'website', v FROM ({scan_sql([(R.SOURCE_SITES[0], 0), (R.SOURCE_SITES[1], 0)], "regexp_matches(v, '^(https?://|www.)')")})""", "fx_rich"))
def raw_contact_scan(t):
    s = t.fx_rich.select("page_id", C.raw_contact_scan("html").alias("s")).select("page_id", "s.*")
    return s.select("page_id", F.inline(F.concat(X.tagged("email", "emails"), X.tagged("phone", "phones"), X.tagged("website", "websites"))))


@query("merge_contact_sources", twin("""
SELECT id, array_to_string(list_sort(list_distinct(list_filter([email, phone, concat('x', id % 3), concat('x', id % 2)], lambda v: v IS NOT NULL AND v <> ''))), ',') AS merged FROM fx_contacts""", "fx_contacts"))
def merge_contact_sources(t):
    c = t.fx_contacts
    return c.select("id", F.array_join(C.merge_contact_sources(F.array("email", "phone"), F.array(F.concat(F.lit("x"), F.col("id") % 3)), F.array(F.concat(F.lit("x"), F.col("id") % 2))), ",").alias("merged"))


NOTES = """SELECT c_custkey AS id, concat('Write to Team', c_custkey % 90, '@Firm.example.org or info@x', c_custkey % 9, '.example.org') AS notes,
 concat('tel: (415) 555-', lpad(CAST(c_custkey % 9000 AS VARCHAR(5)), 4, '0'), ' or 2025550199, site https://www.acme', c_custkey % 50, '.example.org/a_b') AS bio,
 concat('instagram.com/Shop', c_custkey, '/ x.com/s', c_custkey, ' https://linkedin.com/company/c', c_custkey) AS description FROM customer"""
NOTE_TEXT = "SELECT id, concat_ws(chr(10), notes, bio, description) AS text FROM notes"
LEAD_PHONE_SQL = " || ".join("regexp_extract_all(text, {}, {})".format(q(p), 1 if r"(\+?\d[" in p else 0) for p in R.LEAD_PHONES)


@query("lead_text_contacts", twin(f"""
SELECT id, 'email' AS kind, v AS value FROM (SELECT DISTINCT id, lower({STRIP.format('u')}) AS v FROM (SELECT id, unnest({' || '.join(f'regexp_extract_all(text, {q(p)})' for p in R.LEAD_EMAILS)}) AS u FROM nt)) WHERE length(v) > 5
UNION ALL SELECT DISTINCT id, 'phone', v FROM (SELECT id, {STRIP.format('u')} AS v FROM (SELECT id, unnest({LEAD_PHONE_SQL}) AS u FROM nt)) WHERE {nanp_sql('v')}
UNION ALL SELECT DISTINCT id, 'website', unnest(regexp_extract_all(text, {q(R.LEAD_SITES)})) FROM nt
UNION ALL SELECT id, k, v FROM ({' UNION ALL '.join(f"SELECT id, {q(n)} AS k, regexp_extract(lower(text), {q(p)}, 1) AS v FROM nt" for n, p in R.LEAD_SOCIAL)}) WHERE v <> ''""", notes=NOTES, nt=NOTE_TEXT))
def lead_text_contacts(t):
    c = C.lead_text_contacts(t.sql(NOTES), "notes", "bio", "description")
    lists = [X.tagged("email", "emails"), X.tagged("phone", "phones"), X.tagged("website", "websites")]
    social = F.filter(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(f"social.{n}").alias("value")) for n, _ in R.LEAD_SOCIAL]), lambda s: s["value"].isNotNull())
    return c.select("id", F.inline(F.concat(*lists, social)))


@query("caption_contacts")
def caption_contacts(t):
    return t.documents.select("doc_id", C.caption_email("text").alias("email"), C.caption_phone("text").alias("phone"))


HANDLES = """SELECT o_orderkey AS id, concat('follow instagram.com/Shop', o_orderkey % 70, '/ and Instagram.com/shop', o_orderkey % 70, ' twitter.com/a', o_orderkey, ' tiktok.com/@t.', o_orderkey % 9, ' fb.com/f', o_orderkey, ' linkedin.com/in/l-', o_orderkey,
 ' discord.gg/d', o_orderkey, ' twitch.tv/9', o_orderkey % 10, ' mail b', o_orderkey, '@firm.example.org') AS text FROM orders"""


def _handles_sql():
    parts = []
    for n, pre, suf, ps in R.HANDLE_PATTERNS:
        ok = "length(h) > 5" if n == "email" else "length(h) > 1 AND NOT regexp_matches(h, '^\\d+$')"
        parts.append(f"""SELECT id, {q(n)} AS platform, arg_min(h, j) AS username, concat({q(pre)}, arg_min(h, j), {q(suf)}) AS url FROM
 (SELECT id, l[j] AS h, j FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT id, {' || '.join(f'regexp_extract_all(text, {q(p)}, 1)' for p in ps)} AS l FROM hs))) WHERE {ok} GROUP BY id, lower(h)""")
    return " UNION ALL ".join(parts)


@query("social_handles", twin(_handles_sql(), hs=HANDLES))
def social_handles(t):
    return t.sql(HANDLES).select("id", F.inline(C.social_handles("text")))


@query("fb_contacts", twin(f"""
SELECT DISTINCT page_id, 'email' AS kind, unnest(regexp_extract_all(html, {q(R.FACEBOOK_EMAIL)})) AS value FROM fx_rich
UNION SELECT page_id, 'phone', v FROM (SELECT page_id, unnest(regexp_extract_all(html, {q(R.FACEBOOK_PHONE)})) AS v FROM fx_rich) WHERE length({DIGITS.format('v')}) >= 7""", "fx_rich"))
def fb_contacts(t):
    p = t.fx_rich
    return (p.select("page_id", F.lit("email").alias("kind"), F.explode(C.fb_emails("html")).alias("value"))
            .unionByName(p.select("page_id", F.lit("phone").alias("kind"), F.explode(C.fb_phones("html")).alias("value"))))


@query("contact_verdicts", twin(f"""
SELECT id, 'email' AS kind, email AS value, regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$') AS valid, 'regex' AS reason FROM fx_contacts WHERE email <> ''
UNION ALL SELECT id, 'phone', phone, length({DIGITS.format('phone')}) >= 7, 'length>=7' FROM fx_contacts WHERE phone <> ''""", "fx_contacts"))
def contact_verdicts(t):
    return C.contact_verdicts(t.fx_contacts.select("id", F.array("email").alias("emails"), F.array("phone").alias("phones")))


PROFILES = """SELECT concat('u', c_custkey) AS username, CASE WHEN c_custkey % 3 = 0 THEN concat('call +1 415-555-', lpad(CAST(c_custkey % 9000 AS VARCHAR(5)), 4, '0')) ELSE 'hello' END AS biography,
 CASE WHEN c_custkey % 4 = 0 THEN '4155550000' ELSE '' END AS business_phone, CASE WHEN c_custkey % 5 <> 0 THEN concat('https://www.firm', c_custkey % 40, '.example.org/x') END AS website FROM customer"""
DOMAINS = "SELECT concat('firm', s_suppkey, '.example.org') AS domain, concat('office@firm', s_suppkey, '.example.org') AS mail FROM supplier WHERE s_suppkey < 30"
BIO = "nullif(regexp_extract(biography, " + q(R.BIO_PHONE) + ", 0), '')"


@query("enrich_contacts", twin(f"""
SELECT id, coalesce(mail, '') AS emails, concat_ws(',', {BIO}, nullif(business_phone, '')) AS phones FROM (SELECT c_custkey AS id, concat('u', c_custkey) AS username FROM customer)
LEFT JOIN (SELECT *, nullif(regexp_replace({sql_netloc(FULL.replace('url', 'website'))}, '^www\\.', ''), '') AS domain FROM profiles) USING (username) LEFT JOIN doms USING (domain)
WHERE mail IS NOT NULL OR {BIO} IS NOT NULL OR nullif(business_phone, '') IS NOT NULL""", profiles=PROFILES, doms=DOMAINS))
def enrich_contacts(t):
    leads = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("u"), F.col("c_custkey")).alias("username"))
    doms = t.sql(DOMAINS).select("domain", F.array("mail").alias("emails"))
    out = C.enrich_contacts(leads, t.sql(PROFILES), doms)
    return out.select("id", F.array_join("emails", ",").alias("emails"), F.array_join("phone_numbers", ",").alias("phones"))


@query("meaningful_contact", twin("""
SELECT id, coalesce(email, '') <> '' OR coalesce(phone, '') <> '' AS any_contact,
 (industry = 'social_media_profile' AND url NOT IN ('NA', '', 'N/A')) OR ((coalesce(email, '') NOT IN ('NA', '', 'N/A') OR coalesce(phone, '') NOT IN ('NA', '', 'N/A')) AND full_name NOT IN ('NA', '', 'N/A')) AS crawl_ok FROM fx_contacts""", "fx_contacts"))
def meaningful_contact(t):
    return t.fx_contacts.select("id", C.meaningful_contact(email="email", phone="phone").alias("any_contact"),
                                C.crawl_meaningful("industry", "full_name", F.lit(""), "url", "email", "phone").alias("crawl_ok"))
