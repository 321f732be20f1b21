"""Business, people, intent and score queries and their SQL twins."""

from pyspark.sql import functions as F

from contactmill.functions import business_rules as B
from contactmill.operators import business as E
from contactmill.operators import pages as P
from contactmill.operators import scores as S
from contactmill.plans.catalog import query
from contactmill.plans.derived import AS_OF_SQL, as_of, q, sql_any, sql_hits, sql_netloc, sql_re, sql_rules, twin
from contactmill.plans.queries_pages import STRIP, texts

TITLES = """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN concat('Acme ', c_custkey, ' Inc. - Home') WHEN 1 THEN 'I am looking for a school? Best Institute' WHEN 2 THEN 'Blue Training Company | Courses'
 WHEN 3 THEN '' WHEN 4 THEN 'What is the best way' WHEN 5 THEN concat('Harbour ', c_name, ' Pvt Ltd') WHEN 6 THEN 'Home' WHEN 7 THEN 'Consulting' ELSE 'one two three four five six seven eight nine ten' END AS title,
 concat('https://www.big-shop', c_custkey % 30, '.example.org/x') AS url FROM customer"""


@query("company_name", twin(rf"""
WITH a AS (SELECT id, title, {sql_netloc('url')} AS net, regexp_replace(regexp_replace(regexp_replace(title, '^[iI]\s+am\s+.*?[.?]\s*', ''), '^\w+\s+(?:am|is|are|was|were)\s+.*$', ''),
  '(?i)\s*[-|:–—]\s*(?:home|welcome|official site|website).*$', '') AS t FROM titles),
b AS (SELECT *, upper(left(split_part(replace(net, 'www.', ''), '.', 1), 1)) || substr(split_part(replace(net, 'www.', ''), '.', 1), 2) AS raw_label,
 {STRIP.format("regexp_replace(" + STRIP.format("regexp_split_to_array(t, '[-|:–—]')[1]") + f", {q(B.TITLE_DESCRIPTORS)}, '', 'g')")} AS name FROM a),
c AS (SELECT *, replace(raw_label, '-s', '-S') AS label, {STRIP.format("regexp_replace(regexp_replace(name, '\\s+', ' ', 'g'), '(?i)((^| )(inc|llc|ltd|corp|company|co|pvt)\\.*)+$', '')")} AS words FROM b),
d AS (SELECT *, CASE WHEN words <> '' THEN words WHEN t <> '' THEN regexp_split_to_array({STRIP.format('t')}, '\s+')[1] ELSE 'Unknown' END AS n FROM c)
SELECT id, CASE WHEN title = '' OR len(regexp_split_to_array({STRIP.format('t')}, '\s+')) > 8 OR {sql_any('lower(t)', B.TITLE_QUESTION_WORDS)} OR length(n) < 2 OR lower(n) IN ({', '.join(map(q, B.GENERIC_TITLES))})
 THEN label ELSE n END AS company_name FROM d""".strip().replace("WITH a AS", ", a AS", 1), titles=TITLES))
def company_name(t):
    return t.sql(TITLES).select("id", E.company_name("title", "url").alias("company_name"))


LOW = "lower(text)"
OCC = lambda k: f"((length({LOW}) - length(replace({LOW}, {q(k)}, ''))) // {len(k)}) * {2 * len(k.split())}"
SCORES = "[" + ", ".join("CAST(" + " + ".join(OCC(k) for k in ks) + " AS BIGINT)" for ks in B.INDUSTRIES.values()) + "]"
NAMES = "[" + ", ".join(map(q, B.INDUSTRIES)) + "]"
BIZ_TEXT = """SELECT o_orderkey AS id, concat('We are a ', CASE o_orderkey % 8 WHEN 0 THEN 'travel agency and tour operator' WHEN 1 THEN 'charter bus company' WHEN 2 THEN 'family owned hotel resort' WHEN 3 THEN 'college for every student'
 WHEN 4 THEN 'nonprofit foundation' WHEN 5 THEN 'medical clinic' WHEN 6 THEN 'nationwide corporate enterprise' ELSE 'small business' END, ' with ', o_orderkey % 190, ' employees. ',
 CASE o_orderkey % 6 WHEN 0 THEN 'Get a quote for your team outing.' WHEN 1 THEN 'Planning a trip? Hire a bus, bus booking online, group travel itinerary.' WHEN 2 THEN 'We are hiring, apply now.' WHEN 3 THEN 'SEO and SaaS consulting.' WHEN 4 THEN 'Guided tour and sightseeing cruise holiday package.' ELSE '' END) AS text FROM orders"""


def industry_sql(src, key):
    return f"SELECT {key}, CASE WHEN list_max(s) > 0 THEN ({NAMES})[list_position(s, list_max(s))] ELSE 'general' END AS industry FROM (SELECT {key}, {SCORES} AS s FROM {src})"


@query("industry", industry_sql("documents", "doc_id"))
def industry(t):
    return E.industry(t.documents).select("doc_id", "industry")


@query("industry_profiles", twin(industry_sql("biz", "id"), biz=BIZ_TEXT))
def industry_profiles(t):
    return E.industry(t.sql(BIZ_TEXT)).select("id", "industry")


SERV = "[" + ", ".join(f"CASE WHEN {sql_any(LOW, ws)} THEN {q(n)} END" for n, ws in B.SERVICES.items()) + "]"
NUM = f"TRY_CAST(nullif(regexp_extract({LOW}, '(\\d+)\\s*(?:employees|staff|team members)', 1), '') AS BIGINT)"
SIZE = (f"CASE WHEN {sql_any(LOW, B.LARGE_WORDS)} THEN 'large' WHEN {sql_any(LOW, B.COUNTED_WORDS)} THEN CASE WHEN {NUM} > 100 THEN 'large' WHEN {NUM} > 20 THEN 'medium' WHEN {NUM} IS NOT NULL THEN 'small' ELSE 'unknown' END "
        f"WHEN {sql_any(LOW, B.SMALL_WORDS)} THEN 'small' ELSE 'unknown' END")
TOPIC = f"least({sql_hits(LOW, B.TOPIC_WORDS)} / 10.0::DOUBLE, 1.0::DOUBLE)"


def facts_sql(src, key):
    return f"SELECT {key}, array_to_string(list_filter({SERV}, lambda x: x IS NOT NULL), ',') AS services, {SIZE} AS size_estimate, {TOPIC} AS topic FROM {src}"


def facts(df, key):
    return df.select(key, F.array_join(E.services("text"), ",").alias("services"), E.size_estimate("text").alias("size_estimate"), E.topic_relevance("text").alias("topic"))


@query("services", facts_sql("documents", "doc_id"))
def services(t):
    return facts(t.documents, "doc_id")


@query("size_estimate", twin(facts_sql("biz", "id"), biz=BIZ_TEXT))
def size_estimate(t):
    return facts(t.sql(BIZ_TEXT), "id")


@query("topic_relevance", twin(f"SELECT id, round({TOPIC}, 6) AS topic FROM biz", biz=BIZ_TEXT))
def topic_relevance(t):
    return t.sql(BIZ_TEXT).select("id", F.round(E.topic_relevance("text"), 6).alias("topic"))


def _gate_sql():
    others = B.GATE_SECONDARY + B.GATE_PLACES + B.GATE_ACTIVITIES
    every = B.GATE_PRIMARY + others + B.GATE_TRANSPORT
    head = lambda c: f"{sql_hits(f'lower({c})', B.GATE_PRIMARY)} * 2 + {sql_hits(f'lower({c})', others)}"
    occ = " + ".join(f"least((length({LOW}) - length(replace({LOW}, {q(k)}, ''))) // {len(k)}, 3) * {2 if k in B.GATE_PRIMARY else 1}" for k in every)
    return f"SELECT page_id, CAST({sql_hits('lower(url)', every)} + {head('title')} + {head('description')} + {occ} AS INT) AS score FROM gate"


GATE = "SELECT id AS page_id, text, concat('https://a.example.org/tour/', id) AS url, concat('Trip ', id) AS title, CASE WHEN id % 2 = 0 THEN 'Hotel in Paris' ELSE '' END AS description FROM biz"


@query("topic_gate", twin(f"SELECT page_id, score, score >= 3 AS keep, score >= 5 AS strong FROM ({_gate_sql()})", biz=BIZ_TEXT, gate=GATE))
def topic_gate(t):
    t.sql(BIZ_TEXT).createOrReplaceTempView("biz")
    return E.topic_gate(t.spark.sql(GATE))


PEOPLE = """SELECT c_custkey AS id, concat(CASE c_custkey % 5 WHEN 0 THEN 'Anna' WHEN 1 THEN 'OMAR' WHEN 2 THEN 'McKenna' WHEN 3 THEN 'omar' ELSE 'Career' END, ' ', CASE c_custkey % 7 WHEN 0 THEN 'Berg' WHEN 1 THEN 'O''Connor' WHEN 2 THEN 'Bank' WHEN 3 THEN 'X' ELSE 'Diaz' END) AS name,
 CASE c_custkey % 9 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Vice President' WHEN 2 THEN 'Marketing Director' WHEN 3 THEN 'Team Lead' WHEN 4 THEN 'Analyst' WHEN 5 THEN 'Dean' WHEN 6 THEN 'Driver' WHEN 7 THEN 'the' ELSE '12 answers' END AS title FROM customer"""
AUTH = "CASE WHEN title = '' THEN 0.0::DOUBLE ELSE " + sql_rules("lower(title)", B.AUTHORITY, "0.2") + " END"


@query("authority_score", twin(f"SELECT id, CAST({AUTH} AS DOUBLE) AS authority, {AUTH} > 0.5 AS decision_maker FROM people", people=PEOPLE))
def authority_score(t):
    a = E.authority_score("title")
    return t.sql(PEOPLE).select("id", a.alias("authority"), (a > 0.5).alias("decision_maker"))


@query("person_valid", twin(rf"""SELECT id, length(name) BETWEEN 3 AND 50 AND len(string_split(name, ' ')) >= 2 AND NOT {sql_any('lower(name)', B.NAME_EXCLUDED)}
 AND len(list_filter(string_split(name, ' '), lambda p: NOT (regexp_matches(p, '^\p{{Lu}}') AND (length(p) = 1 OR regexp_matches(p, '^.[^\p{{Lu}}]*\p{{Ll}}[^\p{{Lu}}]*$') OR regexp_matches(p, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$')
  OR contains(p, '''') OR contains(p, 'Mc') OR contains(p, 'Mac'))))) = 0 AS name_ok, length(title) BETWEEN 2 AND 100 AND NOT {sql_re('lower(title)', B.NOT_TITLE)} AS title_ok,
 {sql_any('lower(name)', B.NOT_PERSON_WORDS)} OR {sql_any('lower(title)', B.NOT_TITLE_PHRASES)} OR len(string_split(name, ' ')) > 4 AS not_person FROM people""", people=PEOPLE))
def person_valid(t):
    return t.sql(PEOPLE).select("id", E.person_name_valid("name").alias("name_ok"), E.title_valid("title").alias("title_ok"), E.not_person("name", "title").alias("not_person"))


@query("people")
def people(t):
    pages = t.fx_rich.select("page_id", P.html_text("html").alias("text"), "html")
    return E.people(pages).select("page_id", F.inline("people"))


INT_ROWS = " UNION ALL ".join(f"SELECT {q(c)} AS category, {q(k)} AS match" for c, ks in B.INTENTS.items() for k in ks)
WEIGHT = "CASE category " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in B.INTENT_WEIGHTS.items()) + " ELSE 0 END"


@query("intent", twin("SELECT doc_id, category, match FROM documents JOIN words ON contains(lower(text), match)", words=INT_ROWS))
def intent(t):
    return t.documents.select("doc_id", F.inline(E.intent_hits("text")))


HITS = "SELECT id, category, match FROM biz JOIN words ON contains(lower(text), match)"


def one_sql(c):
    return f"CASE WHEN {sql_any(c, B.HIGH_INTENT)} THEN 0.3::DOUBLE WHEN {sql_any(c, B.MEDIUM_INTENT)} THEN 0.1::DOUBLE ELSE 0 END"


@query("intent_score", twin(f"SELECT id, CAST(coalesce(max({WEIGHT}), 0) AS DOUBLE) AS intent_score, round(least(coalesce(sum({one_sql('category')} + {one_sql('match')}), 0), 1), 6) AS intent_points FROM biz LEFT JOIN hits USING (id) GROUP BY id", biz=BIZ_TEXT, words=INT_ROWS, hits=HITS))
def intent_score(t):
    return t.sql(BIZ_TEXT).withColumn("h", E.intent_hits("text")).select(
        "id", E.intent_score(F.col("h")).alias("intent_score"), F.round(S.intent_points("h"), 6).alias("intent_points"))


# --- scores over derived finds ----------------------------------------------------------------------------------

FACTS = """SELECT c_custkey AS id, c_custkey % 4 AS n_mail, c_custkey % 3 AS n_tel, c_custkey % 5 AS n_addr, c_custkey % 7 AS n_ppl, (c_custkey % 11) / 10.0E0 AS topic,
 CASE c_custkey % 6 WHEN 0 THEN 'travel_agency' WHEN 1 THEN 'education' WHEN 2 THEN 'sports' WHEN 3 THEN 'corporate' WHEN 4 THEN 'government' ELSE 'general' END AS industry,
 CASE c_custkey % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' WHEN 2 THEN 'small' ELSE 'unknown' END AS size, (c_custkey % 101) / 100.0E0 AS conf, (c_custkey % 21) / 20.0E0 AS intent,
 CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * CAST(c_custkey % 720 AS INT) AS ts, c_name AS company FROM customer"""


def facts_df(t):
    f = t.sql(FACTS)
    rep = lambda s, n: F.array_repeat(s, F.col(n).cast("int"))
    return (f.withColumn("emails", rep(F.struct((F.col("id") % 2 == 0).alias("is_personal"), F.col("conf").alias("confidence")), "n_mail"))
            .withColumn("phones", rep(F.struct(F.col("conf").alias("confidence")), "n_tel"))
            .withColumn("addresses", rep(F.struct(F.col("conf").alias("confidence")), "n_addr"))
            .withColumn("people", rep(F.struct(F.col("conf").alias("authority_score")), "n_ppl"))
            .withColumn("services", F.when(F.col("id") % 3 == 0, F.array(F.lit("group_travel"), F.lit("corporate_travel"), F.lit("finance"))).otherwise(F.array(F.lit("finance")))))


CQ = """least(1, CASE WHEN n_mail > 0 THEN 0.3 ELSE 0 END + CASE WHEN n_mail > 0 AND id % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN n_tel > 0 THEN 0.3 ELSE 0 END + CASE WHEN n_tel > 0 AND conf > 0.8::DOUBLE THEN 0.1 ELSE 0 END
 + CASE WHEN n_addr > 0 THEN 0.2 ELSE 0 END + CASE WHEN n_ppl > 0 THEN 0.1 ELSE 0 END + CASE WHEN n_ppl > 0 AND conf > 0.8::DOUBLE THEN 0.1 ELSE 0 END)::DOUBLE"""
IN = lambda ls: "(" + ", ".join(map(q, ls)) + ")"
BR = f"least(1::DOUBLE, topic * 0.5::DOUBLE + CASE WHEN industry IN {IN(B.RELEVANCE_HIGH)} THEN 0.3::DOUBLE WHEN industry IN {IN(B.RELEVANCE_MEDIUM)} THEN 0.2::DOUBLE WHEN industry IN {IN(B.RELEVANCE_LOW)} THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.2::DOUBLE ELSE 0 END)"
OS = f"(CASE size WHEN 'large' THEN 0.5::DOUBLE WHEN 'medium' THEN 0.3::DOUBLE WHEN 'small' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN industry IN {IN(B.SIZE_HIGH)} THEN 0.3::DOUBLE WHEN industry IN {IN(B.SIZE_LOW)} THEN 0.2::DOUBLE ELSE 0 END)"
TOTAL = "round((cq * 0.3::DOUBLE + br * 0.25::DOUBLE + intent * 0.2::DOUBLE + conf * 0.15::DOUBLE + os * 0.1::DOUBLE) * 100, 6)"
CLASS = "CASE WHEN {0} >= 80 THEN 'hot' WHEN {0} >= 60 THEN 'warm' WHEN {0} >= 40 THEN 'cold' ELSE 'research' END"


@query("contact_quality", twin(f"SELECT id, round({CQ}, 6) AS score FROM facts", facts=FACTS))
def contact_quality(t):
    return facts_df(t).select("id", F.round(S.contact_quality("emails", "phones", "addresses", "people"), 6).alias("score"))


@query("business_relevance", twin(f"SELECT id, round({BR}, 6) AS score FROM facts", facts=FACTS))
def business_relevance(t):
    return facts_df(t).select("id", F.round(S.business_relevance("topic", "industry", "services"), 6).alias("score"))


@query("intent_points", twin(f"SELECT id, round(least(coalesce(sum({one_sql('category')} + {one_sql('match')}), 0), 1), 6) AS points FROM biz LEFT JOIN hits USING (id) GROUP BY id", biz=BIZ_TEXT, words=INT_ROWS, hits=HITS))
def intent_points(t):
    return t.sql(BIZ_TEXT).withColumn("h", E.intent_hits("text")).select("id", F.round(S.intent_points("h"), 6).alias("points"))


@query("opportunity_size", twin(f"SELECT id, round({OS}, 6) AS score FROM facts", facts=FACTS))
def opportunity_size(t):
    return facts_df(t).select("id", F.round(S.opportunity_size("size", "industry"), 6).alias("score"))


@query("lead_score", twin(f"SELECT id, round({TOTAL}, 1) AS total_score, {CLASS.format(TOTAL)} AS classification, round(cq * 100, 1) AS contact_factor FROM (SELECT *, {CQ} AS cq, {BR} AS br, {OS} AS os FROM facts)", facts=FACTS))
def lead_score(t):
    f = (facts_df(t).withColumn("cq", S.contact_quality("emails", "phones", "addresses", "people"))
         .withColumn("br", S.business_relevance("topic", "industry", "services")).withColumn("os", S.opportunity_size("size", "industry")))
    return f.withColumn("s", S.lead_score("cq", "br", "intent", "conf", "os")).select(
        "id", "s.total_score", "s.classification", F.col("s.factor_scores.contact_quality").alias("contact_factor"))


@query("lead_class", twin(f"SELECT id, {CLASS.format('score / 100')} AS cls FROM fx_contacts", "fx_contacts"))
def lead_class(t):
    return t.fx_contacts.select("id", S.lead_class(F.col("score") / 100).alias("cls"))


@query("data_confidence", twin("SELECT id, round(CASE WHEN n_mail + n_tel + n_addr > 0 THEN conf ELSE 0.5 END, 3)::DOUBLE AS conf FROM facts", facts=FACTS))
def data_confidence(t):
    return facts_df(t).select("id", F.round(E.data_confidence(F.transform("emails", lambda e: F.struct(e["confidence"].alias("confidence"))), F.col("phones"), F.col("addresses")), 3).alias("conf"))


@query("composite_confidence", twin("SELECT id, round(CASE WHEN n_tel > 0 THEN least(conf + least(((CASE WHEN conf > 0.8::DOUBLE THEN n_tel ELSE 0 END) - 1) * 0.1::DOUBLE, 0.2::DOUBLE), 1) ELSE 0 END, 6) AS conf FROM facts", facts=FACTS))
def composite_confidence(t):
    return facts_df(t).select("id", F.round(S.composite_confidence(F.transform("phones", lambda p: p["confidence"])), 6).alias("conf"))


@query("overall_confidence", twin("SELECT id, round(CASE WHEN n_mail = 0 THEN 0.5 WHEN n_tel = 0 THEN conf ELSE (conf + intent) / 2 END, 6)::DOUBLE AS conf FROM facts", facts=FACTS))
def overall_confidence(t):
    m = (F.when(F.col("n_mail") == 0, F.create_map().cast("map<string,double>")).when(F.col("n_tel") == 0, F.create_map(F.lit("email"), F.col("conf")))
         .otherwise(F.create_map(F.lit("email"), F.col("conf"), F.lit("phone"), F.col("intent"))))
    return facts_df(t).select("id", F.round(S.overall_confidence(m), 6).alias("conf"))


MAIL_OK = "coalesce(regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$'), false)"
DIG = "regexp_replace(phone, '[^0-9]', '', 'g')"
TEL_OK = f"coalesce(length({DIG}) BETWEEN 7 AND 15 AND length(replace({DIG}, left({DIG}, 1), '')) > 0, false)"
CHECKED = f"""SELECT *, {MAIL_OK} AS mail_ok, {TEL_OK} AS tel_ok, (CASE WHEN email <> '' AND NOT {MAIL_OK} THEN 1 ELSE 0 END) + (CASE WHEN coalesce(email, '') = '' AND NOT {TEL_OK} THEN 1 ELSE 0 END) AS n_err,
 (CASE WHEN trim(lower(full_name)) IN ('', 'unknown', 'n/a', 'none') THEN 1 ELSE 0 END) + (CASE WHEN industry IN ('', 'general') THEN 1 ELSE 0 END) + (CASE WHEN phone <> '' AND NOT {TEL_OK} THEN 1 ELSE 0 END) AS n_warn FROM fx_contacts"""


def checked(t):
    c = t.fx_contacts
    return c.withColumn("v", S.validate_lead(F.array("email"), F.array("phone"), F.array().cast("array<string>"), "full_name", "industry"))


@query("validate_lead", twin("SELECT id, CAST(n_err AS BIGINT) AS errors, CAST(n_warn AS BIGINT) AS warnings, n_err = 0 AS valid, CASE WHEN tel_ok THEN phone ELSE '' END AS phones FROM checked", "fx_contacts", checked=CHECKED))
def validate_lead(t):
    return checked(t).select("id", F.size("v.errors").cast("bigint").alias("errors"), F.size("v.warnings").cast("bigint").alias("warnings"), "v.valid", F.array_join("v.phones", ",").alias("phones"))


COMP = """least(((CASE WHEN tel_ok AND (coalesce(email, '') = '' OR mail_ok) THEN 1 ELSE 0 END) + (CASE WHEN industry NOT IN ('', 'general', 'n/a', 'none', 'unknown') THEN 1 ELSE 0 END) + (CASE WHEN score > 0 THEN 1 ELSE 0 END)
 + (CASE WHEN trim(full_name) <> '' THEN 0.5 ELSE 0 END) + (CASE WHEN email <> '' THEN 0.5 ELSE 0 END))::DOUBLE / (3.0 + (CASE WHEN trim(full_name) <> '' THEN 0.5 ELSE 0 END) + (CASE WHEN email <> '' THEN 0.5 ELSE 0 END))::DOUBLE, 0.95::DOUBLE)"""
ACC = "greatest(0::DOUBLE, least(1::DOUBLE, 1::DOUBLE - n_err * 0.3::DOUBLE - n_warn * 0.1::DOUBLE - CASE WHEN n_err = 0 THEN 0 ELSE 0.2::DOUBLE END))"
DAYS = f"floor((epoch({AS_OF_SQL}) - epoch({{0}})) / 86400)"
FRESH = f"coalesce(least(1::DOUBLE, exp(-{DAYS.format('scraped_at')} / 365.0::DOUBLE)), 0.5::DOUBLE)"
QUAL = f"round(({COMP} * 0.4::DOUBLE + {ACC} * 0.3::DOUBLE + {FRESH} * 0.15::DOUBLE + 0.8::DOUBLE * 0.7::DOUBLE * 0.15::DOUBLE) * 100, 6)"
GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


def parts(t):
    none = F.array().cast("array<double>")
    return (checked(t).withColumn("complete", S.completeness("v.contact_valid", F.size("v.phones") > 0, X_filled("email"), "industry", "score", "full_name"))
            .withColumn("accurate", S.accuracy(F.size("v.errors"), F.size("v.warnings"), "v.valid"))
            .withColumn("fresh", S.freshness("scraped_at", as_of())).withColumn("reliable", S.reliability(F.lit(0.8), none))
            .withColumn("total", F.round(S.quality_total("complete", "accurate", "fresh", "reliable"), 6)))


def X_filled(c):
    return F.coalesce(F.col(c), F.lit("")) != ""


@query("completeness", twin(f"SELECT id, round({COMP}, 6) AS score FROM checked", "fx_contacts", checked=CHECKED))
def completeness(t):
    return parts(t).select("id", F.round("complete", 6).alias("score"))


@query("accuracy", twin(f"SELECT id, round({ACC}, 6) AS score FROM checked", "fx_contacts", checked=CHECKED))
def accuracy(t):
    return parts(t).select("id", F.round("accurate", 6).alias("score"))


@query("freshness", twin(f"SELECT id, round({FRESH}, 6) AS score FROM checked", "fx_contacts", checked=CHECKED))
def freshness(t):
    return parts(t).select("id", F.round("fresh", 6).alias("score"))


@query("reliability", twin("SELECT id, round(0.7::DOUBLE * conf + 0.3::DOUBLE * CASE WHEN n_tel > 0 THEN conf ELSE 0 END, 6) AS score FROM facts", facts=FACTS))
def reliability(t):
    return facts_df(t).select("id", F.round(S.reliability("conf", F.transform("phones", lambda p: p["confidence"])), 6).alias("score"))


@query("quality_score", twin(f"SELECT id, round({QUAL}, 1) AS total, {GRADE.format(QUAL)} AS grade FROM checked", "fx_contacts", checked=CHECKED))
def quality_score(t):
    return parts(t).select("id", F.round("total", 1).alias("total"), S.grade("total").alias("grade"))


@query("grade", twin(f"SELECT id, {GRADE.format('score / 100')} AS grade FROM fx_contacts", "fx_contacts"))
def grade(t):
    return t.fx_contacts.select("id", S.grade(F.col("score") / 100).alias("grade"))


@query("field_fill_score", twin("SELECT id, round(((full_name <> '')::INT + (coalesce(email, '') <> '')::INT + (coalesce(phone, '') <> '')::INT + (url <> '')::INT + 0 + 0) / 6.0, 6)::DOUBLE AS score FROM fx_contacts", "fx_contacts"))
def field_fill_score(t):
    f = [X_filled(c) for c in ("full_name", "email", "phone", "url")] + [F.lit(False), F.lit(False)]
    return t.fx_contacts.select("id", F.round(S.field_fill(*f), 6).alias("score"))


@query("richness", twin("""SELECT id, CAST((id <> 0)::INT + 1 + 1 + (trim(full_name) <> '')::INT + (trim(coalesce(email, '')) <> '')::INT + (trim(coalesce(phone, '')) <> '')::INT + 1 + 1 + 1 + (score <> 0)::INT + 1 AS INT) AS n FROM fx_contacts""", "fx_contacts"))
def richness(t):
    c = t.fx_contacts
    return c.select("id", S.richness(c.dtypes).alias("n"))


@query("has_field", twin("SELECT id, trim(full_name) <> '' AS name, score <> 0 AS score, (email IS NOT NULL AND email <> '') AS emails FROM fx_contacts", "fx_contacts"))
def has_field(t):
    from contactmill.functions.text import clean_array
    return t.fx_contacts.select("id", S.has_field("full_name", "string").alias("name"), S.has_field("score", "double").alias("score"), S.has_field(clean_array(F.array("email")), "array<string>").alias("emails"))


# --- sections ---------------------------------------------------------------------------------------------------

SECTIONS = """SELECT o_custkey AS page_id, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'footer' WHEN 1 THEN 'p' WHEN 2 THEN 'li' ELSE 'h2' END AS tag,
 CASE o_orderkey % 5 WHEN 0 THEN 'contact-box' WHEN 1 THEN 'about' ELSE '' END AS class, CASE o_orderkey % 6 WHEN 0 THEN 'about' ELSE '' END AS id,
 CASE o_orderkey % 9 WHEN 0 THEN concat('Write to desk', o_orderkey, '@firm.example.org for the office') WHEN 1 THEN 'Our team and staff, company founder' WHEN 2 THEN 'Privacy policy and terms' WHEN 3 THEN 'short' WHEN 4 THEN concat('Call us at 415-555-', lpad(CAST(o_orderkey % 9000 AS VARCHAR(6)), 4, '0'))
  WHEN 5 THEN 'Meet the ceo, director and manager of the company office' ELSE concat('Plain words ', o_orderkey) END AS text FROM orders"""
S_MAIL = "regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')"
S_TEL = "(text LIKE 'Call us at 415-555-%')"
S_CONF = f"""round((CASE WHEN {S_TEL} THEN 0.4 ELSE 0 END + CASE WHEN {S_MAIL} THEN 0.4 ELSE 0 END + least({sql_hits('lower(text)', B.SECTION_WORDS)} * 0.05, 0.2) + CASE WHEN tag IN ('footer', 'header') THEN 0.1 ELSE 0 END
 + CASE WHEN contains(concat(class, ' ', id), 'contact') THEN 0.2 ELSE 0 END + CASE WHEN contains(concat(class, ' ', id), 'about') THEN 0.15 ELSE 0 END), 6)::DOUBLE"""
RANKED = f"SELECT *, {S_MAIL} OR {S_TEL} AS contact_found, least({S_CONF}, 1) AS confidence FROM sections WHERE length(text) >= 10 AND ({S_CONF} >= 0.3 OR {S_MAIL} OR {S_TEL})"


@query("section_rank", twin("SELECT page_id, pos, confidence, contact_found FROM ranked", sections=SECTIONS, ranked=RANKED))
def section_rank(t):
    return E.section_rank(t.sql(SECTIONS)).select("page_id", "pos", "confidence", "contact_found")


EVERY = "lower(concat_ws(chr(10), text, class, id))"
PRIO = f"round((confidence + least({sql_hits(EVERY, B.SECTION_VALUABLE)} * 0.1, 0.3) + CASE WHEN contact_found THEN 0.2 ELSE 0 END + CASE WHEN tag IN ('footer', 'header', 'aside') THEN 0.1 ELSE 0 END), 6)::DOUBLE"


@query("section_select", twin(f"""SELECT page_id, pos, priority_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority_score DESC, pos) AS rank FROM
 (SELECT *, least(p, 1) AS priority_score FROM (SELECT *, {PRIO} AS p FROM ranked) WHERE p >= 0.4 AND NOT {sql_any(EVERY, B.SECTION_IRRELEVANT)})) WHERE rank <= 20""", sections=SECTIONS, ranked=RANKED))
def section_select(t):
    return E.relevant_sections(t.sql(SECTIONS), 20).select("page_id", "pos", "priority_score", "rank")


@query("section_company", twin(f"SELECT page_id, pos, left(text, 100) AS name FROM sections WHERE length(text) >= 10 AND ({sql_any('lower(text)', B.COMPANY_TEXT_WORDS)} OR len(string_split(text, ' ')) >= 3)", sections=SECTIONS))
def section_company(t):
    return E.section_company(t.sql(SECTIONS)).select("page_id", "pos", "name")
