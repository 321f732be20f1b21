"""Deduplicate and merge: groups become one lead, values stay in long form so that no group is ever collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions import text as X
from contactmill.functions.graph import greedy_heads
from contactmill.functions.joins import hot_join
from contactmill.operators import match as M
from contactmill.session import written


def exact_key(email, phone, website) -> Column:
    """Composite key of the first email, phone and website host; null when all are missing."""
    part = lambda name, c, low=True: F.when(~X.blank(c), F.concat(F.lit(name + ":"), F.lower(X.strip(c)) if low else X.strip(c)))
    return F.nullif(F.concat_ws("|", part("email", email), part("phone", phone, False), part("website", website)), F.lit(""))


def first_filled(c, order) -> Column:
    """Value of the first row (by ``order``) that has one."""
    ok = X.filled(c)
    return F.min_by(F.when(ok, X.col(c)), F.when(ok, X.col(order)))


def merge_leads(leads: DataFrame, group: str) -> DataFrame:
    """One row per group: first filled business fields, the higher score (ties: first), the best confidence, the latest
    time and the number of members. Aggregates only, all with partial results before the shuffle."""
    fields = [first_filled(c, "id").alias(c) for c in ("company_name", "industry", "size_estimate") if c in leads.columns]
    return leads.groupBy(group).agg(
        F.min("id").alias("lead_id"), F.count("*").alias("members"), *fields,
        F.max("score").alias("score"), F.max("data_confidence").alias("data_confidence"), F.max("scraped_at").alias("scraped_at"))


def merged_values(leads: DataFrame, group: str, column: str) -> DataFrame:
    """Union of an array column over each group (services, intents, source URLs) in long form."""
    return leads.select(group, F.explode(column).alias("value")).distinct()


def contact_norm(kind, value) -> Column:
    """Comparison key of a contact; null drops it (phones need 7 to 15 digits, not all equal)."""
    from contactmill.operators.scores import phone_ok
    v = X.col(value)
    d = X.digits(v)
    return (F.when(X.col(kind) == "phone", F.when(phone_ok(v), d))
            .when(X.col(kind) == "address", M.normal_address(v)).otherwise(F.nullif(F.lower(X.strip(v)), F.lit(""))))


def merge_contact_list(contacts: DataFrame, group: str) -> DataFrame:
    """``contacts(group, kind, value, confidence, ord)`` -> per group the most confident spelling of each contact.

    ``max`` over a struct keeps partial results per map task, and the group key includes the contact itself, so even a
    group with a third of all rows is spread over its distinct contacts.
    """
    best = F.max(F.struct(F.col("confidence"), (-F.col("ord")).alias("o"), F.col("value"))).alias("b")
    return (contacts.withColumn("norm", contact_norm("kind", "value")).filter("norm is not null")
            .groupBy(group, "kind", "norm").agg(best).select(group, "kind", "norm", "b.value", "b.confidence"))


def merge_people(people: DataFrame, group: str) -> DataFrame:
    """``people(group, name, title, authority_score, ord)`` -> one entry per lower-cased name, higher authority first."""
    best = F.max(F.struct("authority_score", (-F.col("ord")).alias("o"), "name", "title")).alias("b")
    return (people.withColumn("norm", F.lower(X.strip("name"))).filter("norm <> ''").groupBy(group, "norm").agg(best)
            .select(group, "b.name", "b.title", "b.authority_score"))


def merge_metadata(leads: DataFrame, group: str, most: int | None = None) -> DataFrame:
    """Best confidence, latest time, number of the URLs and their list, for groups with at most ``most`` of them (by default
    `MOST_VALUES`; null beyond). `merged_values` has the URLs of every group in long form."""
    one = leads.groupBy(group).agg(F.max("data_confidence").alias("data_confidence"), F.max("scraped_at").alias("scraped_at"), F.min("url").alias("first_url"))
    urls = leads.select(group, F.lit("urls").alias("column"), F.col("url").alias("value")).filter(F.col("value").isNotNull()).distinct()
    lists = arrays_of(urls.select("*", F.lit(0).alias("first_id"), F.lit(0).alias("first_pos")), group, MOST_VALUES if most is None else most)
    none = F.array().cast("array<string>")
    return one.join(lists, group, "left").select(group, "data_confidence", "scraped_at", F.coalesce("n", F.lit(0)).alias("n_urls"), "first_url",
                                                 F.when(F.col("n").isNull(), none).otherwise(F.col("items")).alias("urls"))


def merge_by_confidence(leads: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Per field the value with the highest confidence (``<field>_confidence``), ties to the first lead."""
    aggs = []
    for f in fields:
        ok = X.filled(f)
        rank = F.struct(F.col(f + "_confidence"), (-F.col("id")).alias("o"))
        aggs.append(F.max_by(F.when(ok, F.col(f)), F.when(ok, rank)).alias(f))
        aggs.append(F.max(F.when(ok, F.col(f + "_confidence"))).alias(f + "_confidence"))
    return leads.groupBy(group).agg(*aggs, F.max("score").alias("score"))


def united(leads: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Array columns united per group, in order of first appearance (by id). Values are reduced to distinct ones per
    group before they meet, so what comes together in one row is what the merged lead holds."""
    kinds = dict(leads.dtypes)
    out = leads.select(group).distinct()
    for c in columns:
        each = leads.select(group, "id", F.posexplode(c).alias("_pos", "_v")).filter(F.col("_v").isNotNull())
        once = each.groupBy(group, "_v").agg(F.min(F.struct("id", "_pos")).alias("_at"))
        union = once.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(c))
        out = out.join(union, group, "left").withColumn(c, F.coalesce(c, F.array().cast(kinds[c])))
    return out


def filled_in(leads: DataFrame, group: str, column: str) -> DataFrame:
    """A map column (social profiles) filled in per group: of every key the first filled value, by id."""
    each = leads.select(group, "id", F.explode(column).alias("_key", "_value")).filter(X.filled(F.col("_value").cast("string")))
    first = each.groupBy(group, "_key").agg(F.min_by("_value", "id").alias("_value"))
    return first.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_key", "_value")))).alias(column))


# --- merged lists in long form ----------------------------------------------------------------------------------------

def merged_long(leads: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """The array columns of all leads of a group united, as rows: group, ``column``, ``value``, and ``first_id``,
    ``first_pos`` where it came first, which is the order of the merged list. This is the stored form of a merged lead's
    lists: a value costs one row, wherever its group is large or small, and partial aggregation comes before the shuffle."""
    def tagged(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(c).alias("column"), i.alias("pos"), v.cast("string").alias("value")))
    each = F.concat(*map(tagged, columns))
    rows = leads.select(group, "id", F.inline(each)).filter(F.col("value").isNotNull())
    return (rows.groupBy(group, "column", "value").agg(F.min(F.struct("id", "pos")).alias("_at"))
            .select(group, "column", "value", F.col("_at.id").alias("first_id"), F.col("_at.pos").alias("first_pos")))


#: Values that a reader puts into one row at most.
MOST_VALUES = 10_000


def arrays_of(long: DataFrame, group: str, most: int = MOST_VALUES) -> DataFrame:
    """A reader of `merged_long`: group, column, ``n`` and ``items``, the list in order for lists of at most ``most`` values
    and null for longer ones, which are read as rows (``n`` tells)."""
    sizes = long.groupBy(group, "column").agg(F.count("*").alias("n"))
    keyed = long.withColumn("_k", F.struct(group, "column"))
    small = sizes.filter(F.col("n") <= most).select(F.struct(group, "column").alias("_k"))
    # Values of lists that are too long leave before the lists are put together.
    lists = keyed.join(small, "_k", "left_semi").groupBy(group, "column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_id", "first_pos", "value"))), lambda x: x["value"]).alias("items"))
    return sizes.join(lists, [group, "column"], "left")


def merge_whole(leads: DataFrame, group: str, fields: list[str], lists: list[str], social: str | None = None) -> DataFrame:
    """`merge_by_confidence` with the unions (services, intents, data sources) and social profiles of all leads."""
    out = merge_by_confidence(leads, group, fields).join(united(leads, group, lists), group)
    return out if social is None else out.join(filled_in(leads, group, social), group, "left")


def dedupe_exact(leads: DataFrame) -> DataFrame:
    """Adds ``group``: leads with the same composite key share the smallest id; keyless leads stay alone and take no part
    in the join. A hot key is split."""
    k = leads.withColumn("_key", exact_key("email", "phone", "website"))
    keyed = k.filter("_key is not null")
    first = keyed.groupBy("_key").agg(F.min("id").alias("group"))
    alone = k.filter("_key is null").withColumn("group", F.col("id"))
    return hot_join(keyed, first, "_key", "id", how="inner").unionByName(alone).drop("_key")


def _by_pairs(leads: DataFrame, value: Column, pairs: DataFrame) -> DataFrame:
    """Adds ``group``: in order of id, a lead that no earlier head is similar to becomes a head and takes all later leads
    with its own or a similar value. What it takes takes nothing itself, so similarity is never carried along a chain.

    Works on distinct values, each with its first id; leads without a value stay alone and take no part in the join."""
    v = leads.withColumn("_v", F.nullif(value, F.lit("")))
    named, alone = v.filter("_v is not null"), v.filter("_v is null").withColumn("group", F.col("id"))
    first = named.groupBy("_v").agg(F.min("id").alias("_first"))
    at = lambda c: first.select(F.col("_v").alias(c), F.col("_first").alias("id_" + c))
    ids = pairs.join(at("a"), "a").join(at("b"), "b").select(F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi"))
    heads = greedy_heads(ids)
    group = first.join(heads, first["_first"] == heads["node"], "left").select("_v", F.coalesce("head", "_first").alias("group"))
    return hot_join(named, group, "_v", "id", how="inner").unionByName(alone).drop("_v")


def dedupe_fuzzy(leads: DataFrame, percent: int = 85) -> DataFrame:
    name = F.lower(X.strip("company_name"))
    return _by_pairs(leads, F.when(F.length(name) >= 3, name), M.similar_company_pairs(leads, percent))


def dedupe_address(leads: DataFrame, percent: int = 80) -> DataFrame:
    return _by_pairs(leads, M.normal_address("address"), M.similar_address_pairs(leads, percent))


def survivors(grouped: DataFrame) -> DataFrame:
    """The first lead of each group with missing fields filled from the others, in order, and the union of every array
    column (contacts, services, intents, URLs), in order of first appearance.

    An array's values are reduced to distinct ones per group before they meet, so what comes together in one row is what
    the merged lead holds."""
    kinds = dict(grouped.dtypes)
    keep = [c for c in grouped.columns if c not in ("id", "group", "score", "data_confidence", "scraped_at")]
    lists = [c for c in keep if kinds[c].startswith("array")]
    aggs = [first_filled(c, "id").alias(c) if kinds[c] == "string" else F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
            for c in keep if c not in lists]
    tops = [F.max(c).alias(c) for c in ("score", "data_confidence", "scraped_at") if c in grouped.columns]
    out = grouped.groupBy("group").agg(F.count("*").alias("_n"), *aggs, *tops).drop("_n")
    if lists:
        out = out.join(united(grouped, "group", lists), "group")
    return out.select(F.col("group").alias("id"), *[c for c in grouped.columns if c not in ("id", "group")])


def dedupe_stages(leads: DataFrame) -> DataFrame:
    """Exact, then fuzzy company, then address; each stage works on the survivors of the one before. Runs jobs: every
    stage is written."""
    for stage in (dedupe_exact, dedupe_fuzzy, dedupe_address):
        leads = written(survivors(written(stage(leads))))
    return leads


def dedupe_long(leads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`dedupe_stages` for leads with lists: (survivors without the lists, members, values).

    The stages see scalar columns only. ``members`` has the survivor of every lead, ``values`` the lists of all leads united
    per survivor in long form (`merged_long`), so that no stage puts the lists of a group into one row."""
    lists = [n for n, k in leads.dtypes if k.startswith("array")]
    ids = written(leads.select("id", F.col("id").alias("survivor")))
    rows = written(leads.drop(*lists))
    for stage in (dedupe_exact, dedupe_fuzzy, dedupe_address):
        grouped = written(stage(rows))
        ids = written(hot_join(ids, grouped.select(F.col("id").alias("survivor"), "group"), "survivor", "id", how="inner").select("id", F.col("group").alias("survivor")))
        rows = written(survivors(grouped))
    if not lists:
        return rows, ids, leads.sparkSession.createDataFrame([], "survivor long, column string, value string, first_id long, first_pos int")
    return rows, ids, merged_long(leads.select("id", *lists).join(ids, "id"), "survivor", lists)


def duplicate_groups(leads: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key triple occurs more than once, with the size of their group, in long form."""
    lk = [F.coalesce(F.col(k), F.lit("")) for k in keys]
    tagged = leads.withColumn("_k", F.concat_ws("\u0001", *lk)).filter(X.any_of([c != "" for c in lk]))
    sizes = tagged.groupBy("_k").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return hot_join(tagged, sizes, "_k", "id", how="inner").drop("_k")


def contact_confidence(contacts: DataFrame, members: DataFrame) -> DataFrame:
    """``contacts(id, kind, value, confidence, ord)`` of all leads and ``members(id, survivor)`` -> survivor and the mean
    confidence of its merged contacts (the best one of each e-mail and phone)."""
    named = contacts.filter(F.col("kind").isin("email", "phone")).join(members, "id")
    return merge_contact_list(named, "survivor").groupBy("survivor").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("_contacts"))


def quality_run(leads: DataFrame, as_of: Column, contacts: DataFrame | None = None) -> DataFrame:
    """Survivors of all stages, validated and scored, best first. ``contacts`` (id, kind, value, confidence, ord) are the
    contacts found for the leads given; those of a survivor's whole group count for its reliability."""
    from contactmill.operators import scores as S
    if contacts is None:
        kept = dedupe_stages(leads).withColumn("_list", F.array().cast("array<double>"))
    else:
        rows, members, values = dedupe_long(leads)
        kept = rows.join(contact_confidence(contacts, members).withColumnRenamed("survivor", "id"), "id", "left")
        kept = kept.withColumn("_list", F.array_compact(F.array("_contacts"))).drop("_contacts")
    v = kept.withColumn("v", S.validate_lead(F.array("email"), F.array("phone"), X.as_array("website"), "company_name", "industry"))
    v = v.withColumn("complete", S.completeness("v.contact_valid", F.size("v.phones") > 0, X.filled("email"), "industry", "score", "company_name"))
    total = S.quality_total("complete", S.accuracy(F.size("v.errors"), F.size("v.warnings"), "v.valid"),
                            S.freshness("scraped_at", as_of), S.reliability("data_confidence", "_list"))
    return v.withColumn("quality", F.round(total, 6)).withColumn("grade", S.grade("quality")).drop("v", "complete", "_list")


def quality_summary(original: DataFrame, processed: DataFrame) -> DataFrame:
    n = original.agg(F.count("*").alias("original_count"))
    p = processed.agg(F.count("*").alias("final_count"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 4).alias("average_quality"))
    both = n.select("original_count", F.lit(1).alias("_one")).join(p.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("duplicates_removed", F.col("original_count") - F.col("final_count"))


def quality_sorted(leads: DataFrame) -> DataFrame:
    return leads.orderBy(F.desc("quality"), "id")
