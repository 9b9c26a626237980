"""Structured data: blocks of pages, their fields as rows, and rules as a table."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.urls import is_one_time_action
from ..storage import materialize
from .findings import findings
from .pages import attr, union_all

# Types that are articles or local businesses, and what each type must have: one of
# these fields (`+`: it is enough that the field is there, empty or not), the rule, how grave it is.
ARTICLES = ["Article", "NewsArticle", "BlogPosting", "TechArticle"]
BUSINESSES = [
    "LocalBusiness", "Restaurant", "Store", "MedicalBusiness", "MedicalClinic", "LegalService", "FinancialService", "AutomotiveBusiness", "ChildCare", "DryCleaningOrLaundry",
    "EmergencyService", "EmploymentAgency", "EntertainmentBusiness", "FoodEstablishment", "GovernmentOffice", "HealthAndBeautyBusiness", "HomeAndConstructionBusiness", "LodgingBusiness",
    "ProfessionalService", "RadioStation", "RealEstateAgent", "RecyclingCenter", "SelfStorage", "ShoppingCenter", "SportsActivityLocation", "TelevisionStation", "TouristInformationCenter", "TravelAgency",
]
REQUIRED = [
    (["Product"], "name", "product_missing_name", "high"), (["Product"], "image", "product_missing_image", "high"),
    (["Product"], "offers review aggregateRating", "product_no_offer_or_rating", "high"),
    (["Product"], "sku gtin gtin8 gtin12 gtin13 gtin14 mpn", "product_no_identifier", "low"),
    (["Offer"], "+price", "offer_missing_price", "high"),
    (["Offer"], "+priceCurrency", "offer_missing_priceCurrency", "high"),
    (["Offer"], "+availability", "offer_missing_availability", "high"),
    (["AggregateRating"], "+ratingValue", "rating_missing_value", "high"), (["AggregateRating"], "+reviewCount +ratingCount", "rating_missing_count", "high"),
    (ARTICLES, "headline", "article_missing_headline", "high"), (ARTICLES, "image", "article_missing_image", "medium"),
    (ARTICLES, "datePublished", "article_missing_date_published", "medium"), (ARTICLES, "author", "article_missing_author", "medium"),
    (["Recipe"], "name", "recipe_missing_name", "high"), (["Recipe"], "image", "recipe_missing_image", "high"),
    (["Recipe"], "recipeIngredient", "recipe_missing_recipeIngredient", "high"), (["Recipe"], "recipeInstructions", "recipe_missing_recipeInstructions", "high"),
    (["Event"], "name", "event_missing_name", "high"),
    (["Event"], "startDate", "event_missing_startDate", "high"),
    (["Event"], "location", "event_missing_location", "high"),
    (BUSINESSES, "name", "localbusiness_missing_name", "high"),
    (BUSINESSES, "address", "localbusiness_missing_address", "high"),
    (BUSINESSES, "telephone url", "localbusiness_no_contact", "medium"),
    (["Organization"], "name", "organization_missing_name", "high"),
    (["Organization"], "url", "organization_missing_url", "medium"),
    (["Organization"], "sameAs", "organization_missing_same_as", "medium"),
    (["VideoObject"], "name", "video_missing_name", "high"), (["VideoObject"], "description", "video_missing_description", "high"),
    (["VideoObject"], "thumbnailUrl", "video_missing_thumbnailUrl", "high"), (["VideoObject"], "uploadDate", "video_missing_uploadDate", "high"),
]
# Types that search no longer shows, availabilities, what a page says of them, and eagerness.
DEPRECATED = [
    "BookAction", "ReadAction", "BorrowAction", "Course", "CourseInfo", "ClaimReview", "EstimatedSalary", "Occupation", "LearningVideo",
    "LearningResource", "SpecialAnnouncement", "Vehicle", "Car", "VehicleListing", "PracticeProblem", "Quiz", "FAQPage", "HowTo",
]
AVAILABILITY = ["InStock", "OutOfStock", "OnlineOnly", "InStoreOnly", "PreOrder", "PreSale", "BackOrder", "SoldOut", "Discontinued", "LimitedAvailability"]
#: Texts of a page that go with an availability.
STOCK_TEXTS = {
    "https://schema.org/InStock": ["in stock", "available", "add to cart", "add to bag", "buy now"],
    "https://schema.org/OutOfStock": ["out of stock", "sold out", "unavailable"],
    "https://schema.org/PreOrder": ["pre-order", "preorder", "pre order"],
    "https://schema.org/BackOrder": ["back order", "backorder", "backordered"],
    "https://schema.org/SoldOut": ["sold out"],
    "https://schema.org/Discontinued": ["discontinued", "no longer available"],
    "https://schema.org/LimitedAvailability": ["limited stock", "limited availability", "few left"],
}
EAGERNESS = ["immediate", "eager", "moderate", "conservative"]


def jsonld_scripts(elements: DataFrame) -> DataFrame:
    """(url, block, raw) of the JSON-LD scripts of pages."""
    return elements.where(
        (F.col("tag") == "script") & (F.lower(F.trim(attr("type"))) == "application/ld+json")
    ).select("url", F.col("seq").alias("block"), F.col("text").alias("raw"))


def _kind(c: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(c), "^([A-Z]+)", 1)


#: A string, a mark, or another scalar of a JSON text.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+')


class _Nodes:
    """Table function: the objects of a JSON text that lists and @graph hold, however deep, with
    their places. One pass over the text with a stack; each object is a piece of it."""

    def eval(self, raw: str):
        # A frame: closing mark, where it begins, the list of places it has if it is opened
        # (else None), number of items, whether a key comes next, the last key, whether it has a graph.
        frames, root = [], True
        for m in _TOKEN.finditer(raw):
            token, top = m[0], frames[-1] if frames else None
            if token in "]}" and len(token) == 1:
                frame = frames.pop()
                if token == "}" and frame[2] is not None and not frame[6]:
                    yield frame[2], raw[frame[1] : m.end()]
            elif token == ",":
                top[3], top[4] = top[3] + 1, True
            elif token == ":":
                top[4] = False
            elif top and top[0] == "}" and top[4]:
                top[5] = token
                if top[2] is not None and json.loads(token) == "@graph":
                    top[5], top[6] = "@graph", True
            elif token in "[{" and len(token) == 1:
                at = None
                if root:
                    at = []
                elif top[2] is not None and top[0] == "]":
                    at = [*top[2], top[3]]
                elif top[2] is not None and top[5] == "@graph":
                    at = top[2] if token == "[" else [*top[2], 0]
                frames.append(["]" if token == "[" else "}", m.start(), at, 0, True, None, False])
            root = False


class _Tagged:
    """Table function: the places of strings of a JSON text that hold a script tag."""

    def eval(self, raw: str):
        frames = []  # closing mark, path, number of items, whether a key comes next, the last key
        for m in _TOKEN.finditer(raw):
            token, top = m[0], frames[-1] if frames else None
            if token in "]}" and len(token) == 1:
                frames.pop()
            elif token == ",":
                top[2], top[3] = top[2] + 1, True
            elif token == ":":
                top[3] = False
            elif top and top[0] == "}" and top[3]:
                top[4] = json.loads(token)
            elif token in "[{" and len(token) == 1 or token[0] == '"' and _SCRIPT.search(json.loads(token)):
                path = "" if not top else f"{top[1]}[{top[2]}]" if top[0] == "]" else f"{top[1]}.{top[4]}" if top[1] else top[4]
                if token[0] == '"':
                    yield (path,)
                else:
                    frames.append(["]" if token == "[" else "}", path, 0, True, None])


_SCRIPT = re.compile(r"<\s*/?\s*script", re.IGNORECASE)


def jsonld_blocks(scripts: DataFrame) -> DataFrame:
    """(url, block, at, node variant, types) of each object of the scripts; lists and @graph
    are opened, however deep they lie, `at` being the places in them. Text that is no JSON (or is
    nested deeper than Spark parses, 1,000 levels) has a null node. A table function opens a
    text in one pass, so the depth of a page costs no further stage."""
    nodes = F.udtf(_Nodes, returnType="at array<int>, piece string")
    given = scripts.select("url", "block", "raw", F.try_parse_json("raw").isNotNull().alias("fine"))
    opened = given.where("fine").lateralJoin(nodes(F.col("raw").outer())).select("url", "block", "at", F.try_parse_json("piece").alias("node"))
    broken = given.where("not fine").select("url", "block", F.array().cast("array<int>").alias("at"), F.try_parse_json(F.lit("{")).alias("node"))
    one = F.try_variant_get("node", "$['@type']", "string")
    many = F.try_variant_get("node", "$['@type']", "array<string>")
    types = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    return materialize(opened.unionByName(broken).withColumn("types", types), "jsonld")


def _entries(c: Column) -> Column:
    return F.coalesce(F.try_variant_get(c, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def script_texts(nodes: DataFrame) -> DataFrame:
    """(url, block, path) of strings inside the nodes that hold a script tag, at any depth."""
    tagged = F.udtf(_Tagged, returnType="path string")
    given = nodes.select("url", "block", F.to_json("node").alias("json")).where(F.col("json").rlike(r"(?i)<\s*/?\s*script"))
    return given.lateralJoin(tagged(F.col("json").outer())).select("url", "block", "path")


def validate_jsonld(blocks: DataFrame) -> DataFrame:
    """Findings (url, block, severity, rule, detail). Missing fields come from a join of the
    nodes' types with the table of required fields; the offers and the rating of a product
    are nodes too. Nodes without a type are not judged."""
    blocks = materialize(blocks, "blocks")
    whole = blocks.where("node is not null and size(types) > 0")

    def inner(field: str, kind: str) -> DataFrame:
        value = F.try_variant_get("node", f"$.{field}", "variant")
        parts = F.when(_kind(value) == "ARRAY", F.try_variant_get("node", f"$.{field}", "array<variant>")).when(_kind(value) == "OBJECT", F.array(value))
        rows = whole.where(F.array_contains("types", "Product")).select("url", "block", "at", F.posexplode(parts).alias("i", "node"))
        return rows.where(_kind(F.col("node")) == "OBJECT").select("url", "block", F.concat("at", F.array("i")).alias("at"), "node", F.array(F.lit(kind)).alias("types"))

    nodes = union_all([whole, inner("offers", "Offer"), inner("aggregateRating", "AggregateRating")])
    there = F.map_keys(_entries(F.col("node")))
    full = F.map_keys(F.map_filter(_entries(F.col("node")), lambda k, v: ~F.to_json(v).isin("null", '""', "[]", "{}", "0", "false")))
    nodes = materialize(nodes.withColumn("fields", F.concat(full, F.transform(there, lambda k: F.concat(F.lit("+"), k)))), "nodes")
    rules = blocks.sparkSession.createDataFrame(
        [(t, fields.split(), rule, severity) for kinds, fields, rule, severity in REQUIRED for t in kinds],
        "type string, any array<string>, rule string, severity string",
    )
    typed = nodes.select("url", "block", "fields", F.explode(F.array_distinct("types")).alias("type"))
    missing = typed.join(rules, "type").where(~F.arrays_overlap("any", "fields")).select("url", "block", "severity", "rule", F.col("type").alias("detail"))
    old = typed.where(F.col("type").isin(*DEPRECATED)).select("url", "block", F.lit("high"), F.lit("deprecated_type"), "type")
    value = lambda f: F.coalesce(F.try_variant_get("node", f"$.{f}", "string"), F.lit(""))
    offers = nodes.where(F.array_contains("types", "Offer"))
    currency = offers.where((value("priceCurrency") != "") & ~value("priceCurrency").rlike("^[A-Z]{3}$")).select(
        "url", "block", F.lit("high"), F.lit("offer_invalid_currency"), value("priceCurrency"),
    )
    stock = offers.where(
        (value("availability") != "") & ~F.substring_index(value("availability"), "/", -1).isin(*AVAILABILITY)
    ).select("url", "block", F.lit("medium"), F.lit("offer_unknown_availability"), value("availability"))
    unsafe = script_texts(whole).select("url", "block", F.lit("high"), F.lit("unsanitized_user_content"), "path")
    broken = blocks.where("node is null").select("url", "block", F.lit("high"), F.lit("invalid_json"), F.lit(""))
    lists = nodes.where(F.array_contains("types", "BreadcrumbList")).withColumn("items", F.try_variant_get("node", "$.itemListElement", "array<variant>"))
    none = lists.where("coalesce(size(items), 0) <= 0").select("url", "block", F.lit("high"), F.lit("breadcrumb_missing_items"), F.lit(""))
    part = lambda f: F.try_variant_get("item", f"$.{f}", "string")
    crumbs = lists.select("url", "block", "at", F.posexplode("items").alias("i", "item")).where(_kind(F.col("item")) == "OBJECT").select(
        "url", "block", "at", "i", part("position").alias("position"), F.coalesce(part("name"), F.lit("")).alias("name"),
    )
    again = F.row_number().over(Window.partitionBy("url", "block", "at", "position").orderBy("i"))  # the crumbs of one list
    twice = crumbs.where("position is not null").withColumn("n", again).where("n > 1").select(
        "url", "block", F.lit("high"), F.lit("breadcrumb_duplicate_position"), "position",
    )
    placeless = crumbs.where("position is null").select("url", "block", F.lit("high"), F.lit("breadcrumb_item_missing_position"), F.col("i").cast("string"))
    nameless = crumbs.where("name = ''").select("url", "block", F.lit("high"), F.lit("breadcrumb_item_missing_name"), F.coalesce("position", F.lit("")))
    out = missing
    for rows in (old, currency, stock, unsafe, broken, none, twice, placeless, nameless):
        out = out.union(rows)
    return out


def jsonld_regressions(blocks: DataFrame, baselines: DataFrame) -> DataFrame:
    """(url, template, type): types that the template of a page (template, pattern, type)
    has in the baseline and the page has not. Baselines are a site's configuration: their
    templates become part of the plan, so each address is tested once, with patterns that are
    compiled once, and joined with nothing."""
    rows = baselines.where("pattern is not null").select("template", "pattern", "type").distinct().collect()
    templates: dict = {}
    for r in sorted(rows, key=lambda r: (r["template"] or "", r["pattern"], r["type"] or "")):
        templates.setdefault((r["template"], r["pattern"]), []).append(r["type"])
    if not templates:
        return blocks.select("url", F.lit("").alias("template"), F.lit("").alias("type")).limit(0)
    listed = lambda name, types: F.array(*[F.struct(F.lit(name).cast("string").alias("template"), F.lit(x).cast("string").alias("type")) for x in types])
    wanted = F.flatten(F.array(*[F.when(F.col("url").rlike(p), listed(n, t)).otherwise(F.array().cast("array<struct<template:string,type:string>>")) for (n, p), t in templates.items()]))
    have = blocks.groupBy("url").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("have"))  # of one page
    found = have.select("url", "have", F.explode(F.array_distinct(wanted)).alias("w"))
    return found.where(~F.array_contains("have", F.col("w.type"))).select("url", "w.template", "w.type")


def schema_consistency(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings (url, severity, rule, detail) where a page's first product and first trail differ
    from its texts (url, h1, text, nav)."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    kind = lambda t: F.array_contains("types", t)
    value = lambda p: F.try_variant_get("node", p, "string")
    place = F.struct("block", "at")
    facts = F.struct(
        value("$.name").alias("name"), F.coalesce(value("$.offers[0].price"), value("$.offers.price")).alias("price"),
        F.coalesce(value("$.offers[0].priceCurrency"), value("$.offers.priceCurrency")).alias("currency"),
        F.coalesce(value("$.offers[0].availability"), value("$.offers.availability")).alias("stock"),
        F.try_variant_get("node", "$.offers", "variant").isNotNull().alias("sold"),
    )
    alone = F.struct(value("$.price").alias("price"), value("$.priceCurrency").alias("currency"), value("$.availability").alias("stock"))
    trail = F.try_variant_get("node", "$.itemListElement", "array<variant>")
    first = lambda t, what: F.min_by(F.when(kind(t), what), F.when(kind(t), place))
    per = blocks.where("node is not null").groupBy("url").agg(
        first("Product", facts).alias("product"), first("Offer", alone).alias("offer"), first("BreadcrumbList", trail).alias("trail"),
    )
    c = F.col
    rows = per.join(texts, "url")
    rows = rows.select(
        "url", "product", "trail",
        *(F.when(c("product.sold"), c(f"product.{x}")).when(c("product").isNotNull(), c(f"offer.{x}")).alias(x) for x in ("price", "currency", "stock")),
        plain(c("product.name")).alias("name"), plain(c("h1")).alias("h1"), F.lower(F.coalesce("text", F.lit(""))).alias("text"),
        plain(c("nav")).alias("nav"),
    )
    number = c("price").try_cast("double")
    grouped = F.format_number(number, 2)
    forms = F.array(F.format_string("%.2f", number), F.format_string("%.0f", F.floor(number + 0.5).cast("double")), grouped, F.translate(grouped, ",.", ".,"))
    signals = F.create_map(*[F.lit(x) for k, v in STOCK_TEXTS.items() for x in (k, ",".join(v))])
    shows = lambda s: F.exists(F.split(s, ","), lambda x: c("text").contains(x))
    known = F.try_element_at(signals, F.coalesce("stock", F.lit("")))
    items = F.filter(F.transform(F.coalesce("trail", F.array().cast("array<variant>")), lambda x: plain(F.try_variant_get(x, "$.name", "string"))), lambda x: x != "")
    hidden = F.filter(items, lambda x: ~c("nav").contains(x))
    out = [
        ("name_no_h1", "medium", (c("name") != "") & (c("h1") == ""), c("name")),
        ("name_mismatch", "high", (c("name") != "") & (c("h1") != "") & ~c("h1").contains(c("name")) & ~c("name").contains(c("h1")), c("h1")),
        (
            "price_mismatch", "high",
            c("price").isNotNull() & (F.coalesce("currency", F.lit("")) != "") & ~F.coalesce(F.exists(forms, lambda f: c("text").contains(f)), F.lit(False)),
            c("price"),
        ),
        ("stock_mismatch", "high", ~shows(known), c("stock")),
        ("stock_conflict", "high", (c("stock") == "https://schema.org/OutOfStock") & shows(signals["https://schema.org/InStock"]), c("stock")),
        ("breadcrumb_no_nav", "medium", c("trail").isNotNull() & (c("nav") == ""), None),
    ]
    unseen = rows.where(c("trail").isNotNull() & (c("nav") != "")).select("url", F.explode(hidden).alias("detail"))
    return findings(rows, out).unionByName(unseen.select("url", F.lit("medium").alias("severity"), F.lit("breadcrumb_item_not_visible").alias("rule"), "detail"))


@F.pandas_udf(ArrayType(StringType()))
def _where_patterns(rules: pd.Series) -> pd.Series:
    """Addresses and selectors (marked `selector:`) of the rules' conditions, which may nest
    without bound, so that no path of SQL reaches all."""
    import json

    def inside(where) -> list[str]:
        if not isinstance(where, dict):
            return []
        listed = lambda v: v if isinstance(v, list) else [v] if isinstance(v, str) else []
        out = [str(v) for v in listed(where.get("href_matches"))] + [f"selector:{v}" for v in listed(where.get("selector_matches"))]
        for word in ("and", "or", "not"):
            below = where.get(word)
            for part in below if isinstance(below, list) else [below]:
                out += inside(part)
        return out

    return rules.map(lambda text: inside(json.loads(text)) if text else [])


def speculation_audit(elements: DataFrame) -> DataFrame:
    """Findings (url, severity, rule, detail) on speculation rules; detail names the action, its
    rule's place and the addresses. Rules without eagerness are immediate if they list URLs."""
    scripts = elements.where((F.col("tag") == "script") & (F.lower(attr("type")) == "speculationrules")).select("url", "seq", F.try_parse_json("text").alias("node"))
    broken = scripts.where("node is null").select("url", F.lit("high").alias("severity"), F.lit("invalid_json").alias("rule"), F.lit("").alias("detail"))
    actions = F.map_filter(_entries(F.col("node")), lambda k, v: k.isin("prefetch", "prerender"))
    rules = scripts.where("node is not null").select("url", "seq", F.explode(actions).alias("action", "rules")).select(
        "url", "seq", "action", F.posexplode(F.try_variant_get("rules", "$", "array<variant>")).alias("i", "r"),
    )
    # The rules of all scripts of a page count as one list for each action.
    no = F.row_number().over(Window.partitionBy("url", "action").orderBy("seq", "i")) - 1
    urls = F.coalesce(F.try_variant_get("r", "$.urls", "array<string>"), F.array().cast("array<string>"))
    said = F.try_variant_get("r", "$.eagerness", "string")
    rows = rules.select(
        "url", "action", no.alias("no"), said.alias("said"), F.try_variant_get("r", "$.urls", "array<variant>").isNotNull().alias("lists"),
        F.concat(urls, _where_patterns(F.to_json(F.try_variant_get("r", "$.where", "variant")))).alias("patterns"),
    )
    rows = rows.withColumn("eager", F.coalesce("said", F.when(F.col("lists"), "immediate").otherwise("conservative")))
    c = F.col
    which = lambda f: F.array_join(F.filter("patterns", f), " ")
    origin = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    broad, selectors = which(lambda x: x.contains("*") | x.contains("{")), which(lambda x: x.startswith("selector:"))
    once, other = which(is_one_time_action), which(lambda x: x.rlike("^https?://") & (F.regexp_extract(x, "^(https?://[^/?#]+)", 1) != origin))
    detail = lambda what: F.concat_ws(" ", "action", "no", what)
    prerender, now = c("action") == "prerender", c("eager") == "immediate"
    return broken.unionByName(findings(rows, [
        ("unknown_eagerness", "medium", c("said").isNotNull() & ~c("said").isin(*EAGERNESS), detail(c("said"))),
        ("default_immediate", "medium", c("said").isNull() & now, detail(F.lit(None).cast("string"))),
        ("immediate_broad_pattern", "high", now & (broad != "") & prerender, detail(broad)),
        ("immediate_broad_pattern", "medium", now & (broad != "") & ~prerender, detail(broad)),
        ("immediate_selector", "high", prerender & now & (selectors != ""), detail(selectors)),
        ("one_time_action", "high", prerender & (once != ""), detail(once)),
        ("cross_origin", "medium", other != "", detail(other)),
    ]))


def baseline_rows(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "template string, pattern string, type string")
