"""Readers. All return DataFrames of fixed shape; dirty rows are dropped or counted, never fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of plain or gzipped log files, without blank ones."""
    return spark.read.text(path).where(F.trim("value") != "")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and those that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


# Header names that crawl exports use.
ALIASES = {
    "source_url": ["source_url", "source", "from", "from_url"], "target_url": ["target_url", "destination", "target", "to", "to_url"],
    "target_status_code": ["target_status_code", "status_code", "status"], "anchor": ["anchor", "anchor_text"],
}


def read_edges(raw: DataFrame) -> DataFrame:
    """Links of a crawl export, by the names its header has; rows without source or
    target go, a status that is no number is 0."""
    names = {c.strip().lower().replace(" ", "_"): c for c in raw.columns}
    cols = {to: next((F.col(f"`{names[a]}`") for a in known if a in names), None) for to, known in ALIASES.items()}
    if cols["source_url"] is None or cols["target_url"] is None:
        raise ValueError(f"no source and target among {raw.columns}")
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    status = cols["target_status_code"]
    out = raw.select(
        text(cols["source_url"]).alias("source_url"), text(cols["target_url"]).alias("target_url"),
        F.coalesce(status.cast("string").try_cast("double").cast("int") if status is not None else F.lit(None).cast("int"), F.lit(0)).alias("target_status_code"),
        (text(cols["anchor"]) if cols["anchor"] is not None else F.lit("")).alias("anchor"),
    )
    return out.where("source_url <> '' and target_url <> ''")


def read_sitemaps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(sitemap, pos, loc, lastmod) of the url entries of sitemap files."""
    schema = "loc string, lastmod string"
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", "true").schema(schema).load(path)
    return rows.select(
        F.col("_metadata.file_path").alias("sitemap"), F.monotonically_increasing_id().alias("pos"), F.trim("loc").alias("loc"),
        F.trim("lastmod").alias("lastmod"),
    ).where("loc <> ''")


def read_sitemap_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(sitemap, child) of the entries of sitemap index files."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").option("ignoreNamespace", "true").schema("loc string").load(path)
    return rows.select(F.col("_metadata.file_path").alias("sitemap"), F.trim("loc").alias("child")).where("child <> ''")


def expand_sitemaps(index: DataFrame, entries: DataFrame, root: str, depth: int = 5) -> DataFrame:
    """The entries (sitemap, ...) of all sitemaps that `root` reaches through index rows
    (sitemap, child) in at most `depth` steps; each sitemap once. Deeper ones raise."""
    spark = entries.sparkSession
    front = seen = spark.createDataFrame([(root,)], "sitemap string")
    for step in range(depth + 1):
        front = index.join(front, "sitemap").select(F.col("child").alias("sitemap")).distinct().join(seen, "sitemap", "left_anti")
        front = materialize(front, "sitemaps")
        if front.isEmpty():
            break
        if step == depth:
            raise RuntimeError(f"sitemaps lie deeper than {depth}")
        seen = materialize(seen.union(front), "sitemaps")
    return entries.join(seen.distinct(), "sitemap", "left_semi")


def read_hreflang(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(url, lang, href) of the alternates of sitemap entries; the last declaration of a
    language wins."""
    schema = "loc string, `link` array<struct<_rel: string, _hreflang: string, _href: string>>"
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", "true").schema(schema).load(path)
    links = rows.select(
        F.trim("loc").alias("url"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("entry"),
        F.posexplode("link").alias("at", "l"),
    ).where("l._rel = 'alternate' and l._href is not null")
    return links.groupBy("url", F.lower(F.trim("l._hreflang")).alias("lang")).agg(F.max_by(F.trim("l._href"), F.struct("file", "entry", "at")).alias("href"))


def read_ip_ranges(spark: SparkSession, path: str, crawler: str, ord: int = 0) -> DataFrame:
    """(crawler, ord, cidr) of a published prefix file."""
    schema = "prefixes array<struct<ipv4Prefix: string, ipv6Prefix: string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("prefixes").alias("p"))
    return rows.select(
        F.lit(crawler).alias("crawler"), F.lit(ord).alias("ord"), F.coalesce("p.ipv4Prefix", "p.ipv6Prefix").alias("cidr"),
    ).where(r"cidr rlike '^[0-9a-fA-F.:]+/[0-9]+$'")


def flatten_inspections(rows: DataFrame) -> DataFrame:
    """(url, verdict, coverage, google_canonical, user_canonical, last_crawl, canonical_differs)
    of stored index inspections (url, inspectionResult.indexStatusResult)."""
    r = "inspectionResult.indexStatusResult"
    out = rows.select(
        "url", F.col(f"{r}.verdict").alias("verdict"), F.col(f"{r}.coverageState").alias("coverage"),
        F.col(f"{r}.googleCanonical").alias("google_canonical"), F.col(f"{r}.userCanonical").alias("user_canonical"),
        F.col(f"{r}.lastCrawlTime").alias("last_crawl"),
    )
    return out.withColumn("canonical_differs", F.coalesce(F.col("google_canonical") != F.col("user_canonical"), F.lit(False)))


def expand_sitemaps_recursive(index: DataFrame, entries: DataFrame, root: str, depth: int = 5) -> DataFrame:
    """`expand_sitemaps` as one recursive query of Spark's own, which is as good where sitemaps
    hardly share children: Spark keeps each way to a sitemap until the end."""
    reached = index.sparkSession.sql(
        """WITH RECURSIVE reached(sitemap, step) AS (
               SELECT :root, 0 UNION ALL SELECT i.child, r.step + 1 FROM reached r JOIN {index} i ON i.sitemap = r.sitemap WHERE r.step <= :depth)
           SELECT sitemap, min(step) AS step FROM reached GROUP BY sitemap""",
        args={"root": root, "depth": depth}, index=index,
    )
    if reached.where(F.col("step") > depth).limit(1).count():
        raise RuntimeError(f"sitemaps lie deeper than {depth}")
    return entries.join(reached, "sitemap", "left_semi")
