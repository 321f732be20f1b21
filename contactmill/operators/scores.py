"""Scores and validation as pure column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactmill.functions import business_rules as B
from contactmill.functions import text as X


def points(*pairs) -> Column:
    """Sum of the values whose condition holds."""
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(float(v))).otherwise(0.0) for c, v in pairs])


def some(arr) -> Column:
    return F.coalesce(F.size(X.col(arr)) > 0, F.lit(False))


def contact_quality(emails, phones, addresses, people) -> Column:
    return F.least(F.lit(1.0), points(
        (some(emails), 0.3), (F.exists(X.col(emails), lambda e: e["is_personal"]), 0.1), (some(phones), 0.3),
        (F.exists(X.col(phones), lambda p: p["confidence"] > 0.8), 0.1), (some(addresses), 0.2), (some(people), 0.1),
        (F.exists(X.col(people), lambda p: p["authority_score"] > 0.8), 0.1)))


def business_relevance(topic, industry, services) -> Column:
    i = X.col(industry)
    tier = F.when(i.isin(B.RELEVANCE_HIGH), 0.3).when(i.isin(B.RELEVANCE_MEDIUM), 0.2).when(i.isin(B.RELEVANCE_LOW), 0.1).otherwise(0.0)
    match = F.size(F.array_intersect(X.col(services), F.array(*[F.lit(s) for s in B.RELEVANT_SERVICES])))
    return F.least(F.lit(1.0), X.col(topic) * 0.5 + tier + F.least(match * 0.1, F.lit(0.2)))


def intent_points(hits) -> Column:
    """0.3 or 0.1 for each category and each match, by high or medium words; at most 1."""
    def one(c):
        return F.when(X.has_any(F.lower(c), B.HIGH_INTENT), 0.3).when(X.has_any(F.lower(c), B.MEDIUM_INTENT), 0.1).otherwise(0.0)
    total = F.aggregate(X.col(hits), F.lit(0.0), lambda a, h: a + one(h["category"]) + one(h["match"]))
    return F.least(total, F.lit(1.0))


def opportunity_size(size, industry) -> Column:
    s, i = X.col(size), X.col(industry)
    return (F.when(s == "large", 0.5).when(s == "medium", 0.3).when(s == "small", 0.2).otherwise(0.0)
            + F.when(i.isin(B.SIZE_HIGH), 0.3).when(i.isin(B.SIZE_LOW), 0.2).otherwise(0.0))


def lead_total(contact, relevance, intent, confidence, opportunity) -> Column:
    """Weighted total on a scale of 100, not rounded."""
    return (X.col(contact) * 0.30 + X.col(relevance) * 0.25 + X.col(intent) * 0.20 + X.col(confidence) * 0.15
            + X.col(opportunity) * 0.10) * 100


def lead_class(total) -> Column:
    t = X.col(total)
    return F.when(t >= 80, "hot").when(t >= 60, "warm").when(t >= 40, "cold").otherwise("research")


def lead_score(contact, relevance, intent, confidence, opportunity) -> Column:
    """Total, class and the five factors (on a scale of 100)."""
    total = F.round(lead_total(contact, relevance, intent, confidence, opportunity), 6)
    pct = lambda c: F.round(X.col(c) * 100, 1)
    return F.struct(F.round(total, 1).alias("total_score"), lead_class(total).alias("classification"), F.struct(
        pct(contact).alias("contact_quality"), pct(relevance).alias("business_relevance"), pct(intent).alias("intent_indicators"),
        pct(confidence).alias("data_confidence"), pct(opportunity).alias("opportunity_size")).alias("factor_scores"))


def composite_confidence(confidences) -> Column:
    """Best confidence plus 0.1 for every further one above 0.8 (minus 0.1 when there is none), within [.., 1]."""
    c = X.col(confidences)
    strong = F.size(F.filter(c, lambda v: v > 0.8))
    return F.when(F.size(c) > 0, F.least(F.array_max(c) + F.least((strong - 1) * 0.1, F.lit(0.2)), F.lit(1.0))).otherwise(0.0)


def overall_confidence(scores) -> Column:
    """Mean of a map of confidences, 0.5 when empty."""
    v = F.map_values(X.col(scores))
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.5)


# --- data quality ---------------------------------------------------------------------------------------------

def email_ok(c) -> Column:
    return F.coalesce(X.col(c).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), F.lit(False))


def phone_ok(c) -> Column:
    d = X.digits(c)
    return F.coalesce(F.length(d).between(7, 15) & (F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) > 0), F.lit(False))


def validate_lead(emails, phones, websites, company, industry) -> Column:
    """``emails``/``phones``/``websites`` are arrays of values. Gives the valid phones, errors, warnings and verdict."""
    e, p, w = (X.clean_array(c) for c in (emails, phones, websites))
    good = F.filter(p, phone_ok)
    none = ~(some(e) | some(good) | some(w))
    text = lambda c: F.coalesce(X.strip(c), F.lit(""))
    errors = F.concat(F.transform(F.filter(e, lambda v: ~email_ok(v)), lambda v: F.concat(F.lit("Invalid email: "), v)),
                      F.when(none, F.array(F.lit("No contact method available"))).otherwise(F.array().cast("array<string>")))
    warnings = F.concat(F.array_compact(F.array(
        F.when(F.lower(text(company)).isin("", "unknown", "n/a", "none"), F.lit("Missing or invalid company name")),
        F.when(text(industry).isin("", "general"), F.lit("Industry not classified")))),
        F.transform(F.filter(p, lambda v: ~phone_ok(v)), lambda v: F.concat(F.lit("Invalid phone removed: "), v)))
    return F.struct(good.alias("phones"), errors.alias("errors"), warnings.alias("warnings"),
                    (F.size(errors) == 0).alias("valid"),
                    (F.size(F.filter(e, lambda v: ~email_ok(v))) == 0).alias("contact_valid"))


def completeness(contact_valid, has_phone, has_email, industry, total_score, company) -> Column:
    text = F.lower(F.coalesce(X.strip(industry), F.lit("")))
    name, mail = ~X.blank(company), X.col(has_email)
    got = points((X.col(contact_valid) & X.col(has_phone), 1), (~text.isin("", "general", "n/a", "none", "unknown"), 1),
                 (F.coalesce(X.col(total_score), F.lit(0.0)) > 0, 1), (name, 0.5), (mail, 0.5))
    return F.least(got / (3.0 + points((name, 0.5), (mail, 0.5))), F.lit(0.95))


def accuracy(n_errors, n_warnings, valid) -> Column:
    raw = 1.0 - X.col(n_errors) * 0.3 - X.col(n_warnings) * 0.1 - F.when(X.col(valid), 0.0).otherwise(0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def freshness(ts, as_of) -> Column:
    # ``least`` ignores nulls, so a missing time is handled first.
    return F.when(X.col(ts).isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.exp(-X.whole_days(ts, as_of) / 365.0)))


def reliability(data_confidence, confidences) -> Column:
    c = X.col(confidences)
    mean = F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(X.col(data_confidence), F.lit(0.0)) * 0.7 + mean * 0.3))


def quality_total(complete, accurate, fresh, reliable) -> Column:
    return (X.col(complete) * 0.40 + X.col(accurate) * 0.30 + X.col(fresh) * 0.15 + X.col(reliable) * 0.15) * 100


def grade(total) -> Column:
    t = X.col(total)
    return F.when(t >= 90, "A").when(t >= 80, "B").when(t >= 70, "C").when(t >= 60, "D").otherwise("F")


def field_fill(*present) -> Column:
    """Share of conditions that hold."""
    return points(*[(c, 1) for c in present]) / float(len(present))


def richness(df_columns, skip=("_id", "original_web_lead_id", "processed_at", "primary_contact_type")) -> Column:
    """Filled scalar columns of a row; ``df_columns`` are (name, type) pairs. Lists, zero and false do not count."""
    tests = []
    for name, kind in df_columns:
        c = F.col(f"`{name}`")
        if name in skip or kind.startswith("array"):
            continue
        if kind == "string":
            tests.append(~X.blank(c))
        elif kind == "boolean":
            tests.append(F.coalesce(c, F.lit(False)))
        elif kind.startswith(("struct", "map", "timestamp", "date")):
            tests.append(c.isNotNull())
        else:
            tests.append(F.coalesce(c != 0, F.lit(False)))
    return reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in tests])


def has_field(c, kind: str) -> Column:
    """Non-empty test of a (nested) field of the given type."""
    c = X.col(c)
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind == "string":
        return ~X.blank(c)
    if kind in ("int", "bigint", "double", "float"):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()
