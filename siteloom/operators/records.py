"""Records and field metrics: contracts, page experience, titles, structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_contract(records: DataFrame, contract: DataFrame) -> DataFrame:
    """(record_id, path, rule) of records (record_id, body JSON text) that break a contract
    (path, type, nullable, non_empty, enum, iso_datetime, valid_url). A field that is
    missing differs from one that is null; a wrong type ends a field's checks. Booleans
    are no integers. The contract's rows are an array of each record: nothing is joined."""
    rules = [r.asDict() for r in contract.collect()]  # a contract is written by hand: some dozen rows
    body = F.try_parse_json("body")
    made = []
    for r in rules:
        path, parent = "$." + r["path"], "$." + r["path"].rpartition(".")[0]
        value = F.try_variant_get(body, path, "variant")
        kind = F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)
        text = F.coalesce(F.try_variant_get(body, path, "string"), F.lit(""))
        up = F.try_variant_get(body, parent, "variant") if "." in r["path"] else None
        cut = F.is_variant_null(up) if up is not None else F.lit(False)
        missing = value.isNull() & ~F.coalesce(cut, F.lit(False))
        null = F.coalesce(F.is_variant_null(value), F.lit(False)) | F.coalesce(cut, F.lit(False))
        kinds = {
            "string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"],
            "array": ["ARRAY"], "object": ["OBJECT"],
        }[r["type"]]
        rule = F.when(missing, "missing").when(null, None if r["nullable"] else "null").when(~kind.isin(*kinds), "type")
        if r["non_empty"]:
            rule = rule.when(text.isin("", "[]", "{}"), "empty")
        if r["enum"]:
            rule = rule.when(~text.isin(*r["enum"]), "enum")
        if r["iso_datetime"]:
            rule = rule.when(text.try_cast("timestamp").isNull(), "iso_datetime")
        if r["valid_url"]:
            rule = rule.when(~text.rlike(r"(?i)^https?://[^/?#]+"), "url")
        made.append(F.when(rule.isNotNull(), F.struct(F.lit(r["path"]).alias("path"), rule.alias("rule"))))
    broken = records.where(body.isNull()).select("record_id", F.lit("").alias("path"), F.lit("invalid_json").alias("rule"))
    found = records.where(body.isNotNull()).select(
        "record_id", F.explode(F.array_compact(F.array(*made))).alias("v"),
    ).select("record_id", "v.*") if made else broken.limit(0)
    return found.union(broken)


def contract_summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("path", "rule").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("records"))


def flatten_crux(records: DataFrame) -> DataFrame:
    """(target, metric, p75, good, needs_improvement, poor, period_end) of stored field-data
    records (target, record JSON text); p75 may be text or number."""
    metric = "struct<histogram:array<struct<density:double>>,percentiles:struct<p75:string>>"
    schema = f"metrics map<string,{metric}>, collectionPeriod struct<lastDate:struct<year:int,month:int,day:int>>"
    rows = records.select("target", F.from_json("record", schema).alias("r")).select(
        "target", F.col("r.collectionPeriod.lastDate").alias("d"), F.explode("r.metrics").alias("metric", "m"),
    )
    share = lambda i: F.round(F.get("m.histogram.density", F.lit(i)) * 100, 4)
    return rows.select(
        "target", "metric", F.col("m.percentiles.p75").try_cast("double").alias("p75"), share(0).alias("good"), share(1).alias("needs_improvement"),
        share(2).alias("poor"), F.make_date("d.year", "d.month", "d.day").alias("period_end"),
    )


def dedupe_targets(urls: DataFrame, as_origin: bool = True) -> DataFrame:
    """(url, target): what is asked for each URL; distinct targets are the requests."""
    target = F.regexp_extract(F.lower("url"), r"^(https?://[^/?#]+)", 1) if as_origin else F.col("url")
    return urls.select("url", target.alias("target")).distinct()


RUM = "metric string, value double, rating string, url string, pageTemplate string, userAgent string, connectionType string, timestamp bigint, attribution map<string,string>"


def device_type(agent: Column) -> Column:
    return F.when(agent.rlike("(?i)mobile|iphone|android.*mobile"), "mobile").when(agent.rlike("(?i)tablet|ipad|android"), "tablet").otherwise("desktop")


def read_rum(lines: DataFrame) -> DataFrame:
    """Beacons (value JSON text) in one wide shape; layout shift is kept times 1000; lines
    that are no beacon go."""
    rows = lines.select(F.from_json("value", RUM).alias("b")).select("b.*").where("metric is not null and value is not null")
    scaled = F.round(F.when(F.col("metric") == "CLS", F.col("value") * 1000).otherwise(F.col("value"))).cast("long")
    return rows.withColumn("value", scaled).withColumn("device", device_type(F.coalesce("userAgent", F.lit("")))).withColumn("at", F.timestamp_millis("timestamp"))


def rum_p75(beacons: DataFrame, by: list[str]) -> DataFrame:
    """(metric, by, p75, beacons), exact. Values are counted first, so that a task holds the
    counts of a segment's different values, whole milliseconds, and not its beacons."""
    counts = beacons.groupBy("metric", *by, "value").agg(F.count("*").alias("n"))
    return counts.groupBy("metric", *by).agg(F.percentile("value", 0.75, F.col("n")).alias("p75"), F.sum("n").alias("beacons"))


def lcp_breakdown(rows: DataFrame) -> DataFrame:
    """Rows (url, ttfb, load_start, load_end, lcp in ms) with the rating and four phases."""
    c = F.col
    gap = lambda a, b: F.greatest(F.lit(0), a - b)
    rating = F.when(c("lcp") <= 2500, "good").when(c("lcp") <= 4000, "needs-improvement").otherwise("poor")
    return rows.select(
        "url", "lcp", rating.alias("rating"), F.greatest(F.lit(0), c("ttfb")).alias("ttfb"), gap(c("load_start"), c("ttfb")).alias("load_delay"),
        gap(c("load_end"), c("load_start")).alias("load_time"), gap(c("lcp"), c("load_end")).alias("render_delay"),
    )


def build_product_jsonld(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(id, jsonld) of products (id, name, description, sku, image, price, currency,
    in_stock, brand, rating, reviews). Strict: null without name and price, <>& escaped,
    rating rounded to one place; nulls are left out of the JSON."""
    c = F.col
    stock = F.concat(F.lit("https://schema.org/"), F.when(c("in_stock"), "InStock").otherwise("OutOfStock"))
    typed = lambda t, *cols: F.struct(F.lit(t).alias("@type"), *cols)
    offer = typed("Offer", c("price").cast("string").alias("price"), c("currency").alias("priceCurrency"), stock.alias("availability"))
    score = F.round("rating", 1) if strict else c("rating")
    rating = F.when(c("reviews") > 0, typed("AggregateRating", score.alias("ratingValue"), c("reviews").alias("reviewCount")))
    text = F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), "name", "description", "sku", "image",
            F.when(c("brand").isNotNull(), typed("Brand", c("brand").alias("name"))).alias("brand"), offer.alias("offers"),
            rating.alias("aggregateRating"),
        )
    )
    if strict:
        for mark in "<>&":
            code = f"\\u{ord(mark):04x}"  # so that no text can end the script element
            text = F.replace(text, F.lit(mark), F.lit(code))
        text = F.when(F.col("name").isNotNull() & (F.trim("name") != "") & F.col("price").isNotNull(), text)
    return rows.select("id", text.alias("jsonld"))


def build_breadcrumb_jsonld(rows: DataFrame) -> DataFrame:
    """(id, jsonld) of trails (id, items array<struct<name,url>>)."""
    items = F.transform("items", lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), x["url"].alias("item")))
    return rows.select(
        "id",
        F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement"))).alias("jsonld"),
    )


def page_titles(rows: DataFrame, brand: str, tagline: str = "") -> DataFrame:
    """(id, title) of pages (id, type, product, category, n, headline, h1)."""
    has = lambda *cs: F.coalesce(F.least(*[(F.trim(F.coalesce(c, F.lit(""))) != "").cast("int") for c in cs], F.lit(1)) == 1, F.lit(False))
    end = F.lit(f" | {brand}")
    c = F.col
    title = F.when((c("type") == "product") & has("product", "category"), F.concat("product", F.lit(", "), "category", end))
    title = title.when(
        (c("type") == "category") & has("category") & (F.coalesce("n", F.lit(0)) > 0),
        F.concat("category", F.lit(", "), c("n").cast("string"), F.lit(" Products"), end),
    ).when((c("type") == "category") & has("category"), F.concat("category", end))
    title = title.when(
        (c("type") == "article") & has("headline"), F.concat("headline", end),
    ).when(c("type") == "home", f"{brand}, {tagline}" if tagline else brand).when(has("h1"), F.concat("h1", end)).otherwise(brand)
    return rows.select("id", title.alias("title"))


def product_alt(rows: DataFrame) -> DataFrame:
    """(id, alt) of products (id, name, color, category, attribute): what there is, joined."""
    full = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    lead = F.concat_ws(" ", full("color"), full("category"), F.concat(F.lit("with "), full("attribute")))
    return rows.select("id", F.concat_ws(", ", F.nullif(lead, F.lit("")), full("name")).alias("alt"))
