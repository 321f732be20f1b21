"""Company facts, people, intent and page sections, as per-row expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions import business_rules as B
from contactmill.functions import text as X
from contactmill.functions.text import up_to

plus = lambda parts: reduce(lambda a, b: a + b, parts)
PERSON = "array<struct<name:string,title:string,authority_score:double,contact_type:string>>"


# --- company --------------------------------------------------------------------------------------------------

def company_name(title, url) -> Column:
    """Company name out of a page title, with the site's host label as the way out."""
    title = F.coalesce(X.col(title), F.lit(""))
    label = X.title_case(F.substring_index(F.replace(X.netloc(F.coalesce(X.col(url), F.lit(""))), F.lit("www."), F.lit("")), ".", 1))
    label = F.coalesce(F.nullif(label, F.lit("")), F.lit("Unknown"))
    t = F.regexp_replace(title, r"^[iI]\s+am\s+.*?[.?]\s*", "")
    t = F.regexp_replace(t, r"^\w+\s+(?:am|is|are|was|were)\s+.*$", "")
    t = F.regexp_replace(t, r"(?i)\s*[-|:–—]\s*(?:home|welcome|official site|website).*$", "")
    sentence = (F.size(F.split(X.strip(t), r"\s+")) > 8) | X.has_any(F.lower(t), B.TITLE_QUESTION_WORDS)
    name = X.strip(F.get(F.split(t, r"[-|:–—]"), F.lit(0)))
    name = X.strip(F.regexp_replace(name, B.TITLE_DESCRIPTORS, ""))
    words = X.strip(F.regexp_replace(F.regexp_replace(name, r"\s+", " "),
                                     r"(?i)(?:(?:^| )(?:" + "|".join(B.COMPANY_SUFFIXES) + r")\.*)+$", ""))
    first = F.get(F.split(X.strip(t), r"\s+"), F.lit(0))
    name = F.when(words != "", words).when(t != "", first).otherwise("Unknown")
    generic = (F.length(name) < 2) | F.lower(name).isin(B.GENERIC_TITLES)
    return F.when((title == "") | sentence | generic, label).otherwise(name)


def industry_scores(text, table=None) -> Column:
    """Array of scores in table order: occurrences times twice the number of words of each keyword."""
    return X.let(F.lower(X.col(text)), lambda low: F.array(*[
        X.weighted_hits(low, [(k, 2 * len(k.split())) for k in ks]) for ks in (table or B.INDUSTRIES).values()]))


def industry_of(scores, table=None) -> Column:
    names = F.array(*[F.lit(n) for n in (table or B.INDUSTRIES)])
    best = F.array_max(scores)
    return F.when(best > 0, F.try_element_at(names, F.array_position(scores, best).cast("int"))).otherwise("general")


def industry(pages: DataFrame, text: str = "text", table=None) -> DataFrame:
    return (pages.withColumn("_scores", industry_scores(text, table))
            .withColumn("industry", industry_of(F.col("_scores"), table)).drop("_scores"))


def services(text, table=None) -> Column:
    tags = X.table_array([{"name": n, "words": ws} for n, ws in (table or B.SERVICES).items()])
    return X.let(F.lower(X.col(text)), lambda low: F.transform(
        F.filter(tags, lambda s: F.exists(s["words"], lambda w: F.contains(low, w))), lambda s: s["name"]))


def size_estimate(text) -> Column:
    return X.let(F.lower(X.col(text)), _size)


def _size(low) -> Column:
    count = X.extract(low, r"(\d+)\s*(?:employees|staff|team members)").try_cast("bigint")
    counted = X.has_any(low, B.COUNTED_WORDS)
    return (F.when(X.has_any(low, B.LARGE_WORDS), "large")
            .when(counted & (count > 100), "large").when(counted & (count > 20), "medium").when(counted & count.isNotNull(), "small")
            .when(counted, "unknown").when(X.has_any(low, B.SMALL_WORDS), "small").otherwise("unknown"))


def topic_relevance(text, words=None) -> Column:
    return F.least(X.n_hits(F.lower(X.col(text)), words or B.TOPIC_WORDS) / 10.0, F.lit(1.0))


def topic_gate(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, title, description, text)`` -> weighted keyword score; keep from 3, strong from 5."""
    others = B.GATE_SECONDARY + B.GATE_PLACES + B.GATE_ACTIVITIES
    every = B.GATE_PRIMARY + others + B.GATE_TRANSPORT
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    head = lambda c: X.n_hits(low(c), B.GATE_PRIMARY) * 2 + X.n_hits(low(c), others)
    body = X.weighted_hits("_low", [(k, 2 if k in B.GATE_PRIMARY else 1) for k in every], cap=3)
    total = X.n_hits(low("url"), every) + head("title") + head("description") + body
    return (pages.withColumn("_low", low("text")).withColumn("score", total)
            .select("page_id", "score", (F.col("score") >= 3).alias("keep"), (F.col("score") >= 5).alias("strong")))


# --- people ---------------------------------------------------------------------------------------------------

def authority_score(title) -> Column:
    score = X.first_rule(F.lower(X.col(title)), B.AUTHORITY, F.lit(0.2))
    return F.when(X.filled(title), score).otherwise(F.lit(0.0))


def person_name_valid(name) -> Column:
    name = X.col(name)
    parts = F.split(X.strip(name), r"\s+")
    cased = lambda p: ((F.length(p) == 1) | p.rlike(r"^.[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$") | p.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")
                       | p.rlike(r"'|Mc|Mac"))
    return F.coalesce(F.length(name).between(3, 50) & (F.size(parts) >= 2) & ~X.has_any(F.lower(name), B.NAME_EXCLUDED)
                      & F.forall(parts, lambda p: p.rlike(r"^\p{Lu}") & cased(p)), F.lit(False))


def title_valid(title) -> Column:
    title = X.col(title)
    return F.coalesce(F.length(title).between(2, 100) & ~F.lower(title).rlike(B.NOT_TITLE), F.lit(False))


def not_person(name, title) -> Column:
    name = X.col(name)
    return (X.has_any(F.lower(name), B.NOT_PERSON_WORDS) | X.has_any(F.lower(X.col(title)), B.NOT_TITLE_PHRASES)
            | (F.size(F.split(X.strip(name), r"\s+")) > 4))


def _person(name, title) -> Column:
    score = authority_score(title)
    return F.struct(name.alias("name"), title.alias("title"), score.alias("authority_score"),
                    F.when(score > 0.5, "decision_maker").otherwise("staff").alias("contact_type"))


def _pairs(section, pattern: str, name_group: int, title_group: int) -> Column:
    return F.zip_with(X.extract_all(section, pattern, name_group), X.extract_all(section, pattern, title_group),
                      lambda n, t: F.struct(X.strip(n).alias("name"), X.strip(t).alias("title")))


def team_sections(text, html) -> Column:
    found = F.concat(*[X.extract_all(F.coalesce(X.col(html), F.lit("")), p, 1) for p in B.TEAM_HTML],
                     *[X.extract_all(F.coalesce(X.col(text), F.lit("")), p, 1) for p in B.TEAM_TEXT])
    return F.filter(F.transform(found, X.strip), lambda s: F.length(s) > 20)


def section_people(section) -> Column:
    clean = X.strip(F.regexp_replace(F.regexp_replace(X.col(section), r"<[^>]+>", " "), r"\s+", " "))
    both = F.concat(_pairs(clean, B.NAME_THEN_TITLE, 1, 2), _pairs(clean, B.TITLE_THEN_NAME, 2, 1))
    good = F.filter(both, lambda p: person_name_valid(p["name"]) & title_valid(p["title"]))
    return F.transform(good, lambda p: _person(p["name"], p["title"]))


def sentence_people(text) -> Column:
    parts = F.split(F.coalesce(X.col(text), F.lit("")), r"[.!?]+")
    named = F.flatten(F.transform(parts, lambda s: F.concat(
        F.transform(X.extract_all(s, B.FOUNDED_BY, 1), lambda n: F.struct(X.strip(n).alias("name"), F.lit("Founder").alias("title"))),
        _pairs(s, B.NAME_IS_TITLE, 1, 2))))
    good = F.filter(named, lambda p: person_name_valid(p["name"]))
    return F.transform(good, lambda p: _person(p["name"], p["title"]))


def people_kept(people) -> Column:
    """First mention of each name (blanks and case ignored), non-persons and weak titles dropped, strongest first."""
    from contactmill.operators.contacts import first_of
    good = F.filter(people, lambda p: ~not_person(p["name"], p["title"]) & (p["authority_score"] >= 0.2))
    once = first_of(good, lambda p: F.replace(F.lower(p["name"]), F.lit(" "), F.lit("")), PERSON)
    keyed = F.transform(once, lambda p, i: F.struct((-p["authority_score"]).alias("k"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


def people(pages: DataFrame) -> DataFrame:
    """``pages(page_id, text, html)`` plus ``people``: team sections first, sentences only where those give nobody."""
    step = pages.withColumn("_sec", team_sections("text", "html"))
    step = step.withColumn("_in", F.flatten(F.transform("_sec", section_people)).cast(PERSON))
    found = F.when(F.size("_in") > 0, F.col("_in")).otherwise(sentence_people("text").cast(PERSON))
    return step.withColumn("_all", found).withColumn("people", people_kept(F.col("_all"))).drop("_sec", "_in", "_all")


# --- intent ---------------------------------------------------------------------------------------------------

def intent_hits(text, table=None) -> Column:
    """Array of (category, match) in table order."""
    rows = X.table_array([{"category": c, "match": k} for c, ks in (table or B.INTENTS).items() for k in ks])
    return X.let(F.lower(F.coalesce(X.col(text), F.lit(""))), lambda low: F.filter(rows, lambda r: F.contains(low, r["match"])))


def intent_score(hits, weights=None) -> Column:
    """Weight of the strongest category found."""
    w = F.create_map(*[F.lit(v) for kv in (weights or B.INTENT_WEIGHTS).items() for v in kv])
    return F.coalesce(F.array_max(F.transform(hits, lambda h: F.coalesce(F.try_element_at(w, h["category"]), F.lit(0.0)))), F.lit(0.0))


def data_confidence(*lists) -> Column:
    """Mean confidence over several lists of finds, 0.5 when all are empty."""
    conf = F.concat(*[F.transform(a, lambda x: x["confidence"]) for a in lists])
    mean = F.aggregate(conf, F.lit(0.0), lambda a, c: a + c) / F.size(conf)
    return F.when(F.size(conf) > 0, mean).otherwise(F.lit(0.5))


# --- sections -------------------------------------------------------------------------------------------------

def section_rank(sections: DataFrame) -> DataFrame:
    """``sections(page_id, pos, tag, text, class, id)`` -> sections with a contact or enough confidence."""
    from contactmill.operators import contacts as C
    s = X.once(sections.filter(F.length("text") >= 10), phones=C.phones("text"), emails=C.emails("text"), addresses=C.addresses("text"),
               _links=C.outlinks("text", F.lit(""), F.lit("")))
    has = lambda c: F.size(c) > 0
    web = has(C.websites(F.col("_links"))) | has(C.social_media(F.col("_links")))
    n = X.n_hits(F.lower("text"), B.SECTION_WORDS)
    marked = lambda w: F.lower(F.concat_ws(" ", "class", "id")).contains(w)
    pts = lambda cond, v: F.when(cond, F.lit(v)).otherwise(0.0)
    s = X.once(s, contact_found=has("phones") | has("emails") | has("addresses") | web, keyword_matches=n)
    score = plus([pts(has("phones"), 0.4), pts(has("emails"), 0.4), pts(has("addresses"), 0.2), pts(web, 0.2),
                  F.least(F.col("keyword_matches") * 0.05, F.lit(0.2)), pts(F.col("tag").isin("footer", "header"), 0.1),
                  pts(marked("contact"), 0.2), pts(marked("about"), 0.15)])
    return (X.once(s, _raw=F.round(score, 6)).filter((F.col("_raw") >= 0.3) | F.col("contact_found"))
            .withColumn("confidence", F.least("_raw", F.lit(1.0))).drop("_raw", "_links"))


def _everything() -> Column:
    return F.lower(F.concat_ws("\n", "text", "class", "id"))


def relevant_sections(sections: DataFrame, top: int | None = None) -> DataFrame:
    """`section_select` of `section_rank`: the cheap test on words comes first, so that irrelevant sections never meet the
    contact patterns. It is held where it is: it would be moved below the repartition of a small scan, into its few tasks."""
    s = X.once(sections, _all=_everything())
    return _by_priority(section_rank(s.filter(~X.has_any("_all", B.SECTION_IRRELEVANT)).drop("_all")), top)


def section_select(ranked: DataFrame, top: int | None = None) -> DataFrame:
    """Relevant sections by priority, at most ``top`` per page where that is given."""
    return _by_priority(ranked.filter(~X.has_any(_everything(), B.SECTION_IRRELEVANT)), top)


def _by_priority(relevant: DataFrame, top: int | None) -> DataFrame:
    everything = _everything()
    direct = (F.size("phones") > 0) | (F.size("emails") > 0) | (F.size("addresses") > 0)
    pts = lambda cond, v: F.when(cond, F.lit(v)).otherwise(0.0)
    priority = (F.col("confidence") + F.least(X.n_hits(everything, B.SECTION_VALUABLE) * 0.1, F.lit(0.3)) + pts(direct, 0.2)
                + pts(F.col("tag").isin("footer", "header", "aside"), 0.1))
    kept = (X.once(relevant, _p=F.round(priority, 6))
            .filter(F.col("_p") >= 0.4).withColumn("priority_score", F.least("_p", F.lit(1.0))).drop("_p"))
    w = Window.partitionBy("page_id").orderBy(F.desc("priority_score"), "pos")
    return up_to(kept.withColumn("rank", F.row_number().over(w)), top)


def section_company(sections: DataFrame) -> DataFrame:
    """Company record out of a section text: long enough, and company words or at least three words."""
    low = F.lower("text")
    ok = (F.length("text") >= 10) & (X.has_any(low, B.COMPANY_TEXT_WORDS) | (F.size(F.split(X.strip("text"), r"\s+")) >= 3))
    return sections.filter(ok).select("page_id", "pos", F.substring("text", 1, 100).alias("name"), F.col("text").alias("notes"),
                                      F.lit(0.4).alias("confidence"), F.lit("B2B").alias("lead_category"))
