"""URL operators on tables: canonical URLs, redirects, slugs, lint, facets, variants."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import urls as u
from ..storage import Rounds, materialize
from .findings import findings

# Parameters of canonical URLs, reserved path words, lint limits.
INDEXABLE = ["category", "brand", "type"]
NOT_INDEXABLE = [
    "sort", "order", "page", "view", "display", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid",
    "mc_cid", "mc_eid", "ref", "sessionid", "sid",
]
INSIGNIFICANT = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "sessionid", "sid", "source",
    "mc_cid", "mc_eid", "sort", "order", "view", "display",
]
RESERVED = [
    "admin", "api", "static", "assets", "login", "logout", "register", "search", "feed", "sitemap", "robots", "favicon", "null", "undefined", "new",
    "edit", "delete", "settings", "profile", "account", "help", "support", "about", "contact", "privacy", "terms", "status", "health", "metrics",
]
MAX_LENGTH, MAX_DEPTH, MAX_ENCODED = 2048, 8, 0.20


def generate_canonical(rows: DataFrame, base_url: str = "https://example.com") -> DataFrame:
    """`rows` (path, params map) with canonical and dropped (unknown names, sorted)."""
    kept = F.array_sort(F.map_entries(F.map_filter("params", lambda k, v: k.isin(*INDEXABLE) & (F.coalesce(v, F.lit("")) != ""))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")
    unknown = F.array_sort(F.filter(F.map_keys("params"), lambda k: ~k.isin(*INDEXABLE, *NOT_INDEXABLE)))
    return rows.select(
        "*", F.concat(F.lit(base_url), "path", F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")).alias("canonical"),
        unknown.alias("dropped"),
    )


def compute_canonical(rows: DataFrame, origin: str) -> DataFrame:
    """`rows` (path, query, override) with canonical: the override if it is an absolute
    URL, else origin and path with the last non-empty `page`, if there is one."""
    pages = F.filter(u.query_pairs(F.coalesce("query", F.lit(""))), lambda p: (p["name"] == "page") & (p["value"] != ""))
    page = F.get(F.reverse(pages), F.lit(0))["value"]
    built = F.concat(F.lit(origin.rstrip("/")), "path", F.when(page.isNotNull(), F.concat(F.lit("?page="), page)).otherwise(""))
    return rows.withColumn("canonical", F.when(u.is_abs_http(F.trim("override")), F.trim("override")).otherwise(built))


def expected_redirect(rows: DataFrame, slash: str = "forbid", host: str | None = None) -> DataFrame:
    """(method, url) rows whose URL is to be redirected, with target: https, host without
    www (or `host`), slash policy, and no tracking parameters for GET and HEAD."""
    p = u.url_parts(F.col("url"))
    name = F.lit(host) if host else F.regexp_replace(p["host"], r"^www\.", "")
    kept = F.array_join(F.transform(F.filter(u.query_pairs(p["query"]), lambda x: ~u.is_tracking(x["name"], "edge")), lambda x: x["text"]), "&")
    query = F.when(F.upper("method").isin("GET", "HEAD"), kept).otherwise(p["query"])
    target = u.normalize_url_slash(u.joined(F.lit("https"), name, p["path"], query), slash)
    return rows.withColumn("target", target).where("target <> url")


def slug_redirects(requests: DataFrame, articles: DataFrame) -> DataFrame:
    """requests (id, slug) answered: 404, 301 to the current slug, or 200."""
    rows = requests.join(articles.select("id", F.col("slug").alias("current")), "id", "left")
    status = F.when(F.col("current").isNull(), 404).when(F.coalesce("slug", F.lit("")) != F.col("current"), 301).otherwise(200)
    return rows.select("id", "slug", status.alias("status"), F.when(status == 301, F.concat(F.lit("/articles/"), "id", F.lit("/"), "current")).alias("location"))


@F.pandas_udf(StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    """Letters without their marks (NFKD), which SQL functions don't offer."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x.replace("ß", "ss").replace("æ", "ae").replace("ø", "o")).encode("ascii", "ignore").decode())


def slugify(text: Column, max_len: int = 80) -> Column:
    """Lower-case ASCII words joined by hyphens, cut at the last hyphen within max_len;
    `untitled` if nothing is left, -2 after reserved words."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_without_marks(text)), "[^a-z0-9]+", "-"), "^-|-$", "")
    head = F.left(s, F.lit(max_len))
    cut = F.when(F.length(s) <= max_len, s).when(F.substring(s, max_len + 1, 1) == "-", head).when(head.contains("-"), F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)
    slug = F.when(F.coalesce(cut, F.lit("")) == "", "untitled").otherwise(cut)
    return F.when(slug.isin(*RESERVED), F.concat(slug, F.lit("-2"))).otherwise(slug)


def assign_slugs(rows: DataFrame, existing: DataFrame, max_len: int = 80, rounds: int = 20) -> DataFrame:
    """rows (id, base) with slug, no two alike and none in `existing` (slug): the ids of a base,
    in order, get the numbers that are free, 1 being the base itself and n `base-n`.

    The k-th free number of a base is k and as many as are taken up to it, which one window
    counts. Names of two bases that meet (`a-2` as a base, and as the second of `a`) go to the
    lower number; the other id is dealt again in the next round. A base with a great many ids is
    one task's sort, which spills."""
    open_, taken, done, kept = rows.select("id", "base"), existing.select("slug").distinct(), None, Rounds("slugs")
    for _ in range(rounds):
        number = F.regexp_extract("slug", r"-([1-9][0-9]{0,8})$", 1)
        used = taken.select(F.col("slug").alias("base"), F.lit(1).alias("t")).union(
            taken.where(number.try_cast("int") > 1).select(F.regexp_replace("slug", "-[0-9]+$", ""), number.cast("int"))
        )
        used = used.distinct().join(open_.select("base").distinct(), "base", "left_semi")
        by = Window.partitionBy("base")
        # A taken number t, the i-th of its base, stands before the free number t - i + 1.
        marks = used.select(
            "base", (F.col("t") - F.row_number().over(by.orderBy("t")) + 1).alias("k"), F.lit(1).alias("mark"),
            F.lit(None).cast(rows.schema["id"].dataType).alias("id"),
        )
        asks = open_.select("base", F.row_number().over(by.orderBy("id")).alias("k"), F.lit(0).alias("mark"), "id")
        n = (F.col("k") + F.sum("mark").over(by.orderBy("k", F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0))).cast("int")
        suffix = F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("-"), F.col("n").cast("string")))
        named = marks.unionByName(asks).withColumn("n", n).where("mark = 0").select(
            "id", "base", "n", F.concat(F.col("base").substr(F.lit(1), F.lit(max_len) - F.length(suffix)), suffix).alias("slug"),
        )
        first = F.row_number().over(Window.partitionBy("slug").orderBy("n", "id"))
        named = materialize(named.join(taken.withColumn("used", F.lit(True)), "slug", "left").withColumn("first", first), "slugs")
        good = named.where("used is null and first = 1").select("id", "base", "slug")
        done = good if done is None else done.unionByName(good)
        open_ = named.where("used is not null or first > 1").select("id", "base")
        if open_.isEmpty():
            return done
        taken = kept.write(taken.union(named.select("slug")).distinct())
    raise RuntimeError("slugs did not settle")


def lint_urls(rows: DataFrame, slash: str = "forbid", key: str = "url") -> DataFrame:
    """Findings (key, severity, rule, detail) of URLs; a reserved word is one finding for each segment."""
    p = u.url_parts(F.col("url"))
    segments = F.filter(F.split(p["path"], "/"), lambda x: x != "")
    names = F.array_distinct(F.transform(u.query_pairs(p["query"]), lambda x: x["name"]))
    found = F.filter(names, lambda n: F.lower(n).isin(*INSIGNIFICANT))
    percent = F.length("url") - F.length(F.replace(F.col("url"), F.lit("%"), F.lit("")))
    inner = (p["path"] != "") & (p["path"] != "/")
    rules = [
        ("parse_failed", "error", F.col("url").isNull() | F.col("url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://\[[^\]]*$"), None),
        ("mixed_case_path", "error", p["path"] != F.lower(p["path"]), p["path"]),
        ("missing_trailing_slash", "error", inner & ~p["path"].endswith("/") & F.lit(slash == "require"), None),
        ("unwanted_trailing_slash", "error", inner & p["path"].endswith("/") & F.lit(slash == "forbid"), None),
        ("insignificant_params_in_canonical", "error", F.size(found) > 0, F.array_join(found, ", ")),
        ("url_too_long", "warning", F.length("url") > MAX_LENGTH, F.length("url")),
        ("high_encoded_density", "warning", percent * 3 / F.length("url") > MAX_ENCODED, None),
        ("deep_path_nesting", "warning", F.size(segments) > MAX_DEPTH, F.size(segments)),
    ]
    reserved = rows.select(key, F.explode(F.filter(segments, lambda s: F.lower(F.substring_index(s, ".", 1)).isin(*RESERVED))).alias("detail"))
    return findings(rows, rules, key).unionByName(reserved.select(key, F.lit("warning").alias("severity"), F.lit("reserved_slug_in_path").alias("rule"), "detail"))


def lint_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def facet_signature(params: Column) -> Column:
    clean = F.filter(F.transform(F.map_entries(params), lambda p: F.concat_ws("=", F.trim(F.lower(p["key"])), F.trim(F.lower(p["value"])))), lambda x: ~x.endswith("="))
    return F.array_join(F.array_sort(clean), "&")


def register_facets(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim(F.lower("category_slug")).alias("category_slug"), facet_signature(F.col("facets")).alias("signature")).distinct()


# Parameters that only track, and those that show the same set another way.
FACET_TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "gbraid", "wbraid", "dclid", "fbclid", "msclkid", "mc_cid",
    "mc_eid", "sessionid", "sid", "PHPSESSID", "jsessionid", "_ga", "_gl",
]
FACET_VIEWS = ["sort", "order", "per_page", "page_size", "items_per_page", "view", "display"]


def classify_facets(requests: DataFrame, registry: DataFrame, origin: str = "https://example.com") -> DataFrame:
    """requests (id, category_slug, params) by tier. 1: the category itself, or registered
    facets, indexed under their own URL whatever else the request says. 2: only tracking or
    viewing parameters; the category is canonical. 3: other facets; not indexed, without a
    canonical, which would contradict it."""
    facets = F.map_filter("params", lambda k, v: ~k.isin(*FACET_TRACKING, *FACET_VIEWS))
    rows = requests.withColumn("signature", facet_signature(facets)).withColumn("plain", F.size(facets) == 0).withColumn("any", F.size("params") > 0).withColumn("slug", F.trim(F.lower("category_slug")))
    known = registry.select(F.col("category_slug").alias("slug"), "signature", F.lit(True).alias("known"))
    rows = rows.join(known, ["slug", "signature"], "left").withColumn("known", F.coalesce("known", F.lit(False)) & ~F.col("plain"))
    tier = F.when(F.col("plain"), F.when(F.col("any"), 2).otherwise(1)).when(F.col("known"), 1).otherwise(3)
    base = F.concat(F.lit(origin + "/category/"), "category_slug")
    canonical = F.when(F.col("plain"), base).when(F.col("known"), F.concat(base, F.lit("?"), "signature"))
    return rows.select(
        "id", "category_slug", "signature", tier.alias("tier"), canonical.alias("canonical"),
        F.when(tier == 3, "noindex, follow").otherwise("index, follow").alias("robots"),
    )


def hreflang_variants(paths: DataFrame, locales: list[tuple[str, str]], origin: str, default: str) -> DataFrame:
    """Each path in each locale (code, prefix), and x-default: the locales are an array
    of the row, so nothing is joined."""
    prefixes = "|".join(re.escape(p.strip("/")) for _, p in locales if p.strip("/"))
    plain = F.regexp_replace("path", rf"^/({prefixes})(?=/|$)", "") if prefixes else F.col("path")
    bare = F.rtrim(plain, F.lit("/"))
    codes = [*locales, ("x-default", dict(locales)[default])]
    made = F.array(
        *[F.struct(F.lit(code).alias("lang"), F.concat(F.lit(origin + ("/" + p.strip("/") if p.strip("/") else "")), F.when((bare == "") & F.lit(not p.strip("/")), "/").otherwise(bare)).alias("href")) for code, p in codes]
    )
    return paths.select("path", F.explode(made).alias("v")).select("path", "v.*")
