"""Composed jobs: saved pages or documents in, scored and deduplicated leads out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import business_rules as B
from contactmill.functions import text as X
from contactmill.operators import business as E
from contactmill.operators import contacts as C
from contactmill.operators import match as M
from contactmill.operators import pages as P
from contactmill.operators import reports as J
from contactmill.operators import scores as S
from contactmill.operators import unify as G

EMAIL_KIND = "array<struct<value:string,confidence:double,role:string,source:string,is_personal:boolean>>"


def _organisations(blocks) -> Column:
    return F.filter(blocks, lambda j: F.get_json_object(j, "$['@type']").isin(*B.STRUCTURED_ORG_TYPES))


def extract_leads(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> one extraction row per page.

    One scan, no shuffle: contacts, JSON-LD organisation, company facts, people, intent and scores are all built from the
    page's own text. Each step names what the next one reuses, so no expensive expression runs twice.
    """
    s = pages.select("page_id", "url", "html", P.html_text("html").alias("text"), _organisations(P.jsonld_blocks("html")).alias("orgs"))
    tel = F.transform(F.filter("orgs", lambda j: F.get_json_object(j, "$.telephone").isNotNull()), lambda j: F.struct(
        F.get_json_object(j, "$.telephone").alias("value"), X.phone_key(F.get_json_object(j, "$.telephone")).alias("clean_value"),
        F.lit(0.9).alias("confidence"), F.lit("structured_data").alias("source"), F.lit("JSON-LD").alias("context")))
    mail = F.transform(F.filter("orgs", lambda j: F.get_json_object(j, "$.email").isNotNull()), lambda j: F.struct(
        F.get_json_object(j, "$.email").alias("value"), F.lit(0.9).alias("confidence"), C.email_role(F.get_json_object(j, "$.email")).alias("role"),
        F.lit("structured_data").alias("source"), F.lit(False).alias("is_personal")))
    s = s.select("*", F.concat(C.phones("text", "html"), tel.cast(C.PHONE_KIND)).alias("phones"), F.concat(C.emails("text", "html"), mail.cast(EMAIL_KIND)).alias("emails"),
                 C.addresses("text").alias("addresses"), C.outlinks("text", "html", "url").alias("_links"), E.industry_scores("text").alias("_scores"),
                 E.services("text").alias("services"), E.size_estimate("text").alias("size_estimate"), E.topic_relevance("text").alias("topic_relevance"),
                 E.intent_hits("text").alias("intents"))
    last = F.try_element_at(F.filter(F.transform("orgs", lambda j: F.get_json_object(j, "$.name")), lambda n: n.isNotNull()), F.lit(-1))
    s = s.select("*", C.websites(F.col("_links")).alias("websites"), C.social_media(F.col("_links")).alias("social_media"), E.industry_of(F.col("_scores")).alias("industry"),
                 F.coalesce(last, E.company_name(P.page_title("html"), "url")).alias("company_name"), E.intent_score(F.col("intents")).alias("intent_score"),
                 E.data_confidence(F.col("phones"), F.col("emails"), F.col("addresses")).alias("data_confidence"))
    s = E.people(s)
    s = s.select("*", S.contact_quality("emails", "phones", "addresses", "people").alias("_cq"), S.business_relevance("topic_relevance", "industry", "services").alias("_br"),
                 S.intent_points("intents").alias("_in"), S.opportunity_size("size_estimate", "industry").alias("_op"))
    return s.withColumn("score", S.lead_score("_cq", "_br", "_in", "data_confidence", "_op")).drop("html", "text", "orgs", "_links", "_scores", "_cq", "_br", "_in", "_op")


def document_leads(documents: DataFrame, as_of: Column) -> DataFrame:
    """Unified leads out of plain documents: those with a valid contact, one lead per document.

    The cheap test on the raw text goes first, so most documents never meet the pattern lists.
    """
    maybe = documents.filter(F.col("text").contains("@") | F.col("text").rlike(C.DIGIT_RUN))
    found = X.once(maybe, e=C.emails("text"), p=C.phones("text"))
    rows = found.filter((F.size("e") > 0) | (F.size("p") > 0)).select(
        F.col("doc_id").alias("id"), *G.unified(F.concat(F.lit("doc://"), F.col("doc_id")), "web", "profile", source="documents", icp=F.col("source"), scraped_at=as_of,
                                               emails=F.transform("e", lambda x: x["value"]), phones=F.transform("p", lambda x: x["clean_value"])))
    return rows  # every row has a contact, so it is valid


def first_leads(leads: DataFrame) -> DataFrame:
    """Leads that hold each of their contacts first (by id)."""
    keys = M.contact_keys("contact.emails", "contact.phone_numbers")
    return leads.join(M.first_holders(leads.select("id", F.col("id").alias("ord"), keys.alias("keys"))), "id", "left_semi")


def flagship(documents: DataFrame, as_of: Column) -> DataFrame:
    """Documents -> contacts -> unified leads -> first holder of each contact -> counts per source and platform."""
    return J.icp_stats(first_leads(document_leads(documents, as_of)), as_of)


def process_leads(raw: DataFrame, as_of: Column) -> DataFrame:
    """Raw web leads -> CRM rows, the richest of every group linked by email or phone."""
    rows = G.leadgen_rows(raw.filter(G.has_contact()), as_of)
    plain = [(n, k) for n, k in rows.dtypes]
    rows = (rows.withColumn("id", F.concat_ws(":", "original_web_lead_id", "Email Address", "Phone Number")).withColumn("ord", F.col("id"))
            .withColumn("email", F.col("Email Address")).withColumn("phone", F.col("Phone Number")))
    return M.dup_richest(rows, S.richness(plain)).drop("ord", "email", "phone")


def process_counters(raw: DataFrame, rows: DataFrame, inserted: DataFrame) -> DataFrame:
    """total, filtered, extracted, inserted, email_based, phone_based."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("_k", F.lit(1))
    r = one(raw, F.count("*").alias("total"), F.count_if(G.has_contact()).alias("filtered"))
    e = one(rows, F.count("*").alias("extracted"))
    i = one(inserted, F.count("*").alias("inserted"), F.count_if(F.col("primary_contact_type") == "email").alias("email_based"),
            F.count_if(F.col("primary_contact_type") == "phone").alias("phone_based"))
    return r.join(e, "_k").join(i, "_k").drop("_k")
