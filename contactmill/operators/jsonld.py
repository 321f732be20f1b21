"""Saved JSON: typed projections over JSON-LD and API answers, and path rows for JSON of unknown shape."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.functions import business_rules as B
from contactmill.functions import json_rules as R
from contactmill.functions import text as X
from contactmill.operators import pages as P
from contactmill.session import written

ORG_TYPES = ("Organization", "LocalBusiness", "WebSite", "Corporation", "TravelAgency", "NewsMediaOrganization")
POST_TYPES = ("DiscussionForumPosting", "VideoObject", "Article", "SocialMediaPosting", "NewsArticle", "BlogPosting")


def at(doc, path: str, kind: str = "string") -> Column:
    """Value at a path of a parsed document, null when missing or of another type."""
    return F.try_variant_get(X.col(doc), path, kind)


def parsed(pages: DataFrame) -> DataFrame:
    """JSON-LD items with the parsed document ``d`` and its first type. Parsed once: a filter on the type stays above it."""
    items = X.once(P.jsonld_items(pages), d=F.try_parse_json("json"))
    return items.withColumn("type", F.coalesce(at("d", '$["@type"][0]'), at("d", '$["@type"]')))


def _count_of(action: str) -> Column:
    """Interaction count of an action, whether the statistic is one object or a list of them."""
    one = lambda p: F.when(at("d", f"{p}.interactionType").endswith(action), at("d", f"{p}.userInteractionCount", "bigint"))
    path = "$.interactionStatistic"
    return F.coalesce(one(path), *[one(f"{path}[{i}]") for i in range(4)])


def person(items: DataFrame) -> DataFrame:
    return items.filter(F.col("type") == "Person").select(
        "page_id", at("d", "$.name").alias("name"), F.coalesce(at("d", "$.jobTitle[0]"), at("d", "$.jobTitle")).alias("job_title"),
        at("d", "$.description").alias("description"), at("d", "$.url").alias("profile_url"),
        at("d", "$.address.addressLocality").alias("location"), at("d", "$.address.addressCountry").alias("country"),
        at("d", "$.worksFor[0].name").alias("company"), _count_of("FollowAction").alias("followers"))


def organization(items: DataFrame) -> DataFrame:
    part = lambda f: at("d", f"$.address.{f}")
    return items.filter(F.col("type").isin(*ORG_TYPES)).select(
        "page_id", "type", at("d", "$.name").alias("name"), at("d", "$.description").alias("description"), at("d", "$.url").alias("site"),
        at("d", "$.telephone").alias("telephone"), at("d", "$.email").alias("email"),
        P.join_address(part("streetAddress"), part("addressLocality"), part("addressRegion"), part("postalCode"), part("addressCountry")).alias("address"),
        at("d", "$.numberOfEmployees.value", "bigint").alias("employees"), at("d", "$.sameAs[0]").alias("same_as"))


def post(items: DataFrame) -> DataFrame:
    who = lambda f: F.coalesce(at("d", f"$.author.{f}"), at("d", f"$.creator.{f}"))
    return items.filter(F.col("type").isin(*POST_TYPES)).select(
        "page_id", at("d", "$.headline").alias("headline"), F.coalesce(at("d", "$.articleBody"), at("d", "$.description")).alias("body"),
        at("d", "$.datePublished").alias("date_published"), F.coalesce(at("d", '$["@id"]'), at("d", "$.url")).alias("post_url"),
        who("name").alias("author_name"), who("url").alias("author_url"), at("d", "$.commentCount", "bigint").alias("comment_count"),
        _count_of("LikeAction").alias("likes"))


def comments(items: DataFrame) -> DataFrame:
    arr = F.from_json(F.get_json_object("json", "$.comment"), "array<struct<text:string,datePublished:string,author:struct<name:string>,creator:struct<name:string>>>")
    return items.filter(F.col("type").isin(*POST_TYPES)).select("page_id", F.posexplode(arr).alias("pos", "c")).select(
        "page_id", "pos", "c.text", F.col("c.datePublished").alias("date_published"), F.coalesce("c.author.name", "c.creator.name").alias("author_name"))


def newsletter(items: DataFrame) -> DataFrame:
    return items.filter(F.col("type") == "Article").select(
        "page_id", at("d", "$.headline").alias("headline"), at("d", "$.name").alias("name"), at("d", "$.datePublished").alias("date_published"),
        at("d", "$.author.name").alias("author_name"), at("d", "$.commentCount", "bigint").alias("comment_count"))


def generic(items: DataFrame) -> DataFrame:
    return items.select("page_id", "type", at("d", "$.name").alias("name"), at("d", "$.headline").alias("headline"), at("d", "$.description").alias("description"),
                        F.coalesce(at("d", "$.url"), at("d", '$["@id"]')).alias("item_url"), at("d", "$.datePublished").alias("date_published"))


def clean_api(text) -> Column:
    """Strip the guards some APIs put before their JSON."""
    return F.regexp_replace(X.col(text), r"^(?:\)\]\}'\s*|for \(;;\);\s*)", "")


def api_profile_fields(responses: DataFrame) -> DataFrame:
    """``responses(page_id, url, body)`` -> user columns; the profile call comes before query calls."""
    from contactmill.operators.urls import first_per_key
    r = responses.withColumn("d", F.try_parse_json(clean_api("body"))).withColumn(
        "rank", F.when(F.col("url").contains("web_profile_info"), 0).otherwise(1)).filter(at("d", "$.data.user.username").isNotNull())
    u = lambda f, kind="string": at("d", f"$.data.user.{f}", kind)
    return first_per_key(r, ["page_id"], "rank", "url").select(
        "page_id", *[u(f).alias(f) for f in ("username", "full_name", "biography", "external_url", "business_email", "business_phone_number", "business_category_name")],
        *[u(f, "boolean").alias(f) for f in ("is_private", "is_verified", "is_business_account", "is_professional_account")],
        u("edge_followed_by.count", "bigint").alias("followers_count"), u("edge_follow.count", "bigint").alias("following_count"),
        u("edge_owner_to_timeline_media.count", "bigint").alias("posts_count"))


def api_video_fields(responses: DataFrame) -> DataFrame:
    """Video and channel columns out of player and browse answers."""
    r = responses.withColumn("d", F.try_parse_json(clean_api("body")))
    v = lambda f, kind="string": F.max(at("d", f"$.videoDetails.{f}", kind))
    head, meta = "$.header.channelHeaderRenderer", "$.metadata.channelMetadataRenderer"
    return r.groupBy("page_id").agg(
        v("title").alias("title"), v("videoId").alias("video_id"), v("viewCount").alias("views"), v("lengthSeconds").alias("duration"), v("publishDate").alias("upload_date"),
        F.coalesce(F.max(at("d", f"{meta}.title")), F.max(at("d", f"{head}.title")), v("author")).alias("channel_name"),
        F.max(at("d", f"{head}.subscriberCountText.simpleText")).alias("subscribers"),
        F.coalesce(F.max(at("d", f"{meta}.description")), v("shortDescription")).alias("description"))


# --- JSON of unknown shape: path rows -------------------------------------------------------------------------

PATHS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("key", T.StringType()),
                                  T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def _leaves(text, max_depth):
    """Leaf values (path, key, kind, value) in document order, without recursion; None for text that is not JSON."""
    try:
        todo = [(json.loads(text), "$", "", 0)]
    except (TypeError, ValueError, RecursionError):
        return None
    out = []
    while todo:
        node, path, key, depth = todo.pop()
        if max_depth is not None and depth > max_depth:
            continue
        if isinstance(node, dict):
            todo += [(v, f"{path}.{k}", k, depth + 1) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(v, f"{path}[{i}]", key, depth + 1) for i, v in reversed(list(enumerate(node)))]
        elif node is not None:
            kind = "bool" if isinstance(node, bool) else "number" if isinstance(node, (int, float)) else "string"
            out.append((path, key, kind, str(node).lower() if kind == "bool" else str(node)))
    return out


def json_paths(docs, max_depth: int | None = None) -> Column:
    """Leaf values with their path, nearest key and kind, at every depth (down to ``max_depth``, where it is given)."""
    @F.arrow_udf(PATHS)
    def rows(texts: pa.Array) -> pa.Array:
        starts, valid, found = [0], [], ([], [], [], [])
        for t in texts:
            leaves = _leaves(t.as_py(), max_depth)
            for leaf in leaves or ():
                for own, v in zip(found, leaf):
                    own.append(v)
            valid.append(leaves is None)
            starts.append(len(found[0]))
        leaf = pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in found], names=[f.name for f in PATHS.elementType])
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), leaf, mask=pa.array(valid, pa.bool_()))
    return rows(docs)


def path_rows(items: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``items(page_id, pos, json)`` -> one row per leaf value."""
    return items.select("page_id", "pos", F.inline(json_paths("json", max_depth)))


def variant_rows(items: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`path_rows` without Python: documents become variants, and objects and lists are exploded level by level until none
    is left (or ``max_depth`` is reached). A document is spread over rows as soon as it is opened, so a very large one is no
    task of its own. Runs a job for each level, which is written. Rows come in no order; a document that names a key twice
    in one object is no variant and gives no rows, numbers are written as SQL does."""
    spark, out, depth = items.sparkSession, None, 0
    now = items.select("page_id", "pos", F.lit("$").alias("path"), F.lit("").alias("key"), F.try_parse_json("json").alias("v")).filter(F.col("v").isNotNull())
    while max_depth is None or depth <= max_depth:
        now = written(now.withColumn("_type", F.schema_of_variant("v")))
        kind = (F.when(F.col("_type") == "BOOLEAN", "bool").when(F.col("_type") == "STRING", "string").otherwise("number"))
        inside = F.col("_type").startswith("OBJECT") | F.col("_type").startswith("ARRAY")
        leaves = now.filter(~inside & (F.col("_type") != "VOID")).select("page_id", "pos", "path", "key", kind.alias("kind"), F.try_variant_get("v", "$", "string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        open_ = now.filter(inside)
        if open_.isEmpty():
            break
        each = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_at", "_name", "_value"))
        name = F.coalesce("_name", "key")
        step = F.when(F.col("_name").isNotNull(), F.concat(F.lit("."), F.col("_name"))).otherwise(F.concat(F.lit("["), F.col("_at").cast("string"), F.lit("]")))
        now, depth = each.select("page_id", "pos", F.concat("path", step).alias("path"), name.alias("key"), F.col("_value").alias("v")), depth + 1
    return out


def jsonld_filter(items: DataFrame, keep=None, drop=None, min_string: int = 2, types: bool = True, max_depth: int | None = None, leaves=None) -> DataFrame:
    """Leaf rows worth keeping: no dropped key anywhere on the path; each key listed or, unless it looks technical,
    a nested object, a number or a text of more than ten characters. ``leaves`` reads them: `path_rows` (the default) or
    `variant_rows`."""
    keep, drop = keep or R.KEEP, drop or R.DROP
    keys = F.filter(F.split(F.regexp_replace("path", r"\[\d+\]", ""), r"\."), lambda k: k != "$")
    one_of = lambda k, names: k.isin(*names)
    inner = F.slice("_keys", F.lit(1), F.greatest(F.size("_keys") - 1, F.lit(0)))
    technical = lambda k: F.contains(F.lower(k), F.lit("id")) | (F.contains(F.lower(k), F.lit("url")) & F.contains(F.lower(k), F.lit("thumb")))
    nested_ok = F.forall(inner, lambda k: ~one_of(k, R.CONTEXT) & (one_of(k, keep) | ~technical(k)))
    value_ok = (F.when(F.col("kind") == "string", F.length("value") > 10)
                .when(F.col("kind") == "number", ~F.lower("key").rlike("width|height")).otherwise(True))
    in_list = F.col("path").rlike(r"\]$")
    leaf = one_of(F.col("key"), keep) | (~technical(F.col("key")) & (value_ok | in_list))
    leaf = F.when(F.col("key") == "@type", F.lit(types)).when(one_of(F.col("key"), R.CONTEXT), F.lit(False)).otherwise(leaf)
    short = (F.col("kind") == "string") & (F.length("value") < min_string)
    rows = (leaves or path_rows)(items, max_depth).filter(leaf & ~short)
    # The keys of a path are split once, for the rows that are left.
    return X.once(rows, _keys=keys).filter(~F.exists("_keys", lambda k: one_of(k, drop)) & nested_ok).drop("_keys")


def client_group(key) -> Column:
    out = F
    for name, keys in R.GROUPS:
        out = out.when(X.col(key).isin(*keys), name)
    return out.otherwise("content")


def client_info(items: DataFrame) -> DataFrame:
    """Kept values by group; a later value of the same key replaces an earlier one."""
    rows = jsonld_filter(items).filter(~F.col("path").rlike(r"\]$") & ~X.blank("value")).withColumn("grp", client_group("key"))
    return rows.groupBy("page_id", "grp", "key").agg(F.max_by("value", F.struct("pos", "path")).alias("value"))


def any_to_text(docs: DataFrame) -> DataFrame:
    """All text values of a JSON document, in order, joined by blanks; plain text stays as it is."""
    return docs.withColumn("_p", json_paths("json")).select(
        "page_id", F.when(F.col("_p").isNull(), F.col("json")).otherwise(
            F.array_join(F.transform(F.filter("_p", lambda r: r["kind"] == "string"), lambda r: r["value"]), " ")).alias("text"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_objects(docs: pd.Series) -> pd.Series:
    """Top-level JSON objects of a text, by brace balance outside strings."""
    def cut(text):
        out, depth, start, quoted, skip = [], 0, 0, False, False
        for i, ch in enumerate(text or ""):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = depth > 0
            elif ch == "{":
                start = i if depth == 0 else start
                depth += 1
            elif ch == "}" and depth:
                depth -= 1
                if depth == 0:
                    out.append(text[start:i + 1])
        return out
    return docs.map(cut)


def repair(text) -> Column:
    """Decode entities, drop trailing commas, turn single-quoted values into double-quoted ones."""
    c = P.unescape(F.replace(F.replace(X.strip(text), F.lit("&apos;"), F.lit("'")), F.lit(" "), F.lit(" ")))
    c = F.regexp_replace(c, r",(\s*[}\]])", "$1")
    return F.regexp_replace(c, r"(?<!\\)'([^']*)'(?=\s*[,:\]}])", '"$1"')


def json_repair_split(docs: DataFrame) -> DataFrame:
    """``docs(page_id, raw)`` -> valid objects of each text. A text that parses after the cheap JVM repair never reaches
    Python; only the rest is split by brace balance."""
    # The JSON parser ignores what follows the first object, so text after a closing brace goes to the splitter.
    step = docs.withColumn("fixed", repair("raw"))
    single = F.try_parse_json("fixed").isNotNull() & ~F.col("fixed").rlike(r"\}\s*[^\s,\]}]")
    whole = step.filter(single).select("page_id", F.lit(0).alias("pos"), F.col("fixed").alias("json"))
    rest = (step.filter(~single).select("page_id", F.posexplode(split_objects("fixed")).alias("pos", "json"))
            .filter(F.try_parse_json("json").isNotNull()))
    return whole.unionByName(rest)


# --- compositions ---------------------------------------------------------------------------------------------

def combine_sources(head: DataFrame, orgs: DataFrame) -> DataFrame:
    """JSON-LD values first, then metadata; a page without JSON-LD takes its name from the title before the bar."""
    j = head.join(orgs.select("page_id", F.col("name").alias("ld_name"), F.col("description").alias("ld_description")), "page_id", "left")
    short = X.strip(F.substring_index(F.coalesce("og_title", "title"), "|", 1))
    return j.select("page_id", F.coalesce("ld_name", F.nullif(short, F.lit(""))).alias("name"),
                    F.coalesce("ld_description", "og_description", "description").alias("description"), "og_url", "title")


def structured_business(items: DataFrame) -> DataFrame:
    """Business facts per page: the last organisation wins, a publisher fills a missing name."""
    org = F.col("type").isin(*B.STRUCTURED_ORG_TYPES)
    last = lambda path, cond=org: F.max_by(F.when(cond, at("d", path)), F.when(cond & at("d", path).isNotNull(), F.struct("pos", "sub")))
    any_item = F.lit(True)
    return items.groupBy("page_id").agg(
        F.coalesce(last("$.name"), last("$.publisher.name", any_item)).alias("company_name"), last("$.legalName").alias("legal_name"),
        last("$.description").alias("description"), F.coalesce(last("$.publisher.url", any_item), last("$.url")).alias("website"),
        last("$.foundingDate").alias("founding_date"))


def structured_contacts(items: DataFrame) -> DataFrame:
    """Phones and emails of organisations with confidence 0.9."""
    org = items.filter(F.col("type").isin(*B.STRUCTURED_ORG_TYPES))
    return org.select("page_id", F.inline(F.array(
        F.struct(F.lit("phone").alias("kind"), at("d", "$.telephone").alias("value")),
        F.struct(F.lit("email").alias("kind"), at("d", "$.email").alias("value"))))).filter("value is not null").withColumn("confidence", F.lit(0.9))


def structured_people(items: DataFrame) -> DataFrame:
    a = lambda f: at("d", f"$.author['{f}']")
    links = F.from_json(F.get_json_object("json", "$.author.sameAs"), "array<string>")
    site = lambda s: F.when(s.contains("linkedin.com"), "linkedin").when(s.contains("instagram.com"), "instagram").when(s.rlike(r"twitter\.com|x\.com"), "twitter")
    social = F.filter(F.transform(links, lambda s: F.struct(site(s).alias("platform"), s.alias("url"))), lambda s: s["platform"].isNotNull())
    return items.filter(a("@type") == "Person").select("page_id", a("name").alias("name"), a("jobTitle").alias("title"),
                                                           a("url").alias("profile_url"), social.alias("social"))


def structured_relevant(items: DataFrame) -> DataFrame:
    """Items of the relevant types reduced to the relevant fields, as JSON (missing fields are left out)."""
    tops = list(dict.fromkeys([*B.STRUCTURED_FIELDS, *B.STRUCTURED_NESTED]))
    found = [f"_top{i}" for i in range(len(tops))]
    at_top = dict(zip(tops, found))
    # Every text is read once for all its fields.
    rows = items.filter(X.has_any("type", B.STRUCTURED_TYPES)).select("page_id", "pos", "type", F.json_tuple("json", *tops).alias(*found))
    nested = []
    for i, f in enumerate(B.STRUCTURED_NESTED):
        own, inside = F.col(at_top[f]), [f"_in{i}_{j}" for j in range(len(B.STRUCTURED_NESTED_FIELDS))]
        rows = rows.select("*", F.json_tuple(F.when(own.startswith("{"), own), *B.STRUCTURED_NESTED_FIELDS).alias(*inside))
        nested.append(F.when(own.startswith("{"), F.to_json(F.struct(*[F.col(c).alias(n) for c, n in zip(inside, B.STRUCTURED_NESTED_FIELDS)]))).alias(f))
    kept = F.to_json(F.struct(F.col("type").alias("@type"), *[F.col(at_top[f]).alias(f) for f in B.STRUCTURED_FIELDS], *nested))
    return X.once(rows, _kept=kept).select("page_id", "pos", F.col("_kept").alias("json")).filter(F.size(F.json_object_keys("json")) > 1)


def structured_company(items: DataFrame, cut: int | None = 200) -> DataFrame:
    """JSON-LD item to a company record; a name is required, notes keep the first ``cut`` characters of the description
    (None: all)."""
    o = organization(items)
    kind = (F.when(F.col("type").contains("Organization"), "Organization").when(F.col("type").contains("Corporation"), "Corporation")
            .when(F.col("type").contains("Company"), "Company"))
    notes = F.col("description") if cut is None else F.when(F.length("description") > cut, F.concat(F.substring("description", 1, cut), F.lit("..."))).otherwise(F.col("description"))
    return o.filter(X.filled("name")).select("page_id", "name", F.col("name").alias("organization"), notes.alias("notes"), F.col("address").alias("location"),
                                             "telephone", "email", "site", kind.alias("company_type"), F.lit(0.7).alias("confidence"))
