"""Queries over readers, writers and continuous jobs: files are written from the given
tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl, logs
from ..sources import readers, writers
from ..storage import new_path
from ..streaming import jobs
from .logs import raw_lines
from .views import table, view


def _text(df: DataFrame, column, tag: str) -> str:
    path = new_path(df.sparkSession, tag)
    df.select(column.alias("value")).write.text(path)
    return path


def _edges(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "crawl-export")
    rows = view(s, d, "v_edges").select(F.col("source_url").alias("Source"), F.when(F.col("target_status_code") == 404, " ").otherwise(F.col("target_url")).alias("Destination"), F.when(F.col("target_status_code") == 0, "n/a").otherwise(F.col("target_status_code").cast("string")).alias("Status Code"))
    rows.write.option("header", "true").csv(path)
    return readers.read_edges(s.read.option("header", "true").csv(path)).select("source_url", "target_url", "target_status_code")


def _sitemap_xml(s: SparkSession, d: str) -> str:
    c = F.col
    links = F.concat(*[F.concat(F.lit(f'<xhtml:link rel="alternate" hreflang="{lang}" href="'), "loc", F.lit(f"/{end}\"/>")) for lang, end in (("EN", "old"), ("en", "en"), (" fr ", "fr"))])
    entry = F.concat(F.lit("<url><loc> "), c("loc"), F.lit(" </loc><lastmod>"), c("lastmod"), F.lit("</lastmod>"), links, F.lit("</url>"))
    # One file for each sitemap of at most 40,000 entries, as the format asks.
    files = view(s, d, "v_sitemap").groupBy((F.col("pos") % 4).alias("no"), F.expr("pos div 160000").alias("part")).agg(F.array_join(F.collect_list(entry), "").alias("entries"))
    path = new_path(s, "sitemaps")
    files.select("no", "part", F.concat(F.lit('<urlset xmlns:xhtml="http://www.w3.org/1999/xhtml">'), "entries", F.lit("</urlset>")).alias("value")).write.partitionBy("no", "part").text(path)
    return path


def _ranges(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "ranges")
    k = F.col("s_suppkey")
    rows = table(s, d, "supplier").select("s_suppkey", F.array(F.struct(F.concat(F.lit("10."), k % 256, F.lit(".0.0/16")).alias("ipv4Prefix"), F.lit(None).cast("string").alias("ipv6Prefix")), F.struct(F.lit("broken").alias("ipv4Prefix"), F.lit(None).cast("string").alias("ipv6Prefix")), F.struct(F.lit(None).cast("string").alias("ipv4Prefix"), F.concat(F.lit("2001:"), k, F.lit("::/32")).alias("ipv6Prefix"))).alias("prefixes"))
    # Published prefix files are small documents: one for each thousand suppliers.
    files = rows.select((k / 1000).cast("int").alias("no"), F.explode("prefixes").alias("p")).groupBy("no").agg(F.collect_list("p").alias("prefixes"))
    files.write.partitionBy("no").json(path)
    return readers.read_ip_ranges(s, path, "bot", 3)


def _written(s: SparkSession, d: str) -> DataFrame:
    """Days that are written twice are there once."""
    path = new_path(s, "enriched")
    rows = logs.enrich_logs(view(s, d, "v_logs"), view(s, d, "v_ranges"))
    writers.write_enriched(rows, path)
    writers.write_enriched(rows, path)
    return s.read.parquet(path).select("event_id", "remote_addr", "path", "status", "bytes_sent", "verified_crawler", F.to_date("log_date").alias("log_date"))


def _report(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "report")
    rows = view(s, d, "v_logs").groupBy("status").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    writers.write_report(rows, path, "csv")
    return s.read.option("header", "true").schema("status int, methods string").csv(path)


def _inspections(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    row = F.struct(F.struct(F.lit("PASS").alias("verdict"), F.lit("Indexed").alias("coverageState"), F.concat(F.lit("/p/"), k).alias("googleCanonical"), F.concat(F.lit("/p/"), F.when(k % 4 == 0, k + 1).otherwise(k)).alias("userCanonical"), F.lit("2024-01-01").alias("lastCrawlTime")).alias("indexStatusResult"))
    return readers.flatten_inspections(table(s, d, "pages").select("url", row.alias("inspectionResult")))


def _enriched_stream(s: SparkSession, d: str) -> DataFrame:
    """The continuous form of enrichment gives the rows of the batch."""
    src, out, mark = (new_path(s, x) for x in ("lines", "stream", "mark"))
    raw_lines(s, d).write.text(src)
    jobs.enrich_stream(jobs.stream_lines(s, src), view(s, d, "v_ranges"), out, mark, None).awaitTermination()
    return s.read.parquet(out).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "remote_addr", "method", "uri", "path", "status", "bytes_sent", "user_agent", F.round("request_time", 6).alias("request_time"), "verified_crawler", "crawler_purpose", "verified_googlebot")


_SEEN = "url string, page bigint, lastmod string, content_hash string, last_seen string"
#: What a page says and holds the k-th time: dates of odd pages move, texts of every third one.
_LASTMOD = "case when {id} % 5 = 0 then '' when {id} % 7 = 0 then concat('0', {k}, '/01/2024') else concat('2024-0', 1 + ({k} - 1) * ({id} % 2), '-10') end"
_HELD = "case when {id} % 11 = 0 and {k} = 2 then null else concat('h', case when {id} % 3 = 0 then {k} else 0 end) end"


def _freshness_stream(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Findings and state of pages that are seen in three batches, one file each; the last time, each
    is there twice, the earlier one to be passed over. Rows of the table that share a URL are
    pages of their own."""
    src, out, mark = (new_path(s, x) for x in ("fetched", "found", "mark"))
    pages = table(s, d, "pages").where("url is not null").repartition(1)
    for k in (1, 2, 3):
        one = lambda k, day: pages.selectExpr("url", "page_id page", _LASTMOD.format(id="page_id", k=k) + " lastmod", _HELD.format(id="page_id", k=k) + " content_hash", f"'2024-02-0{day}' last_seen")
        rows = one(3, 3).union(one(1, 2)).repartition(1) if k == 3 else one(k, k)
        rows.write.mode("append").parquet(src)
    jobs.freshness_stream(s.readStream.schema(_SEEN).option("maxFilesPerTrigger", 1).parquet(src), out, mark).awaitTermination()
    return s.read.schema("url string, severity string, rule string, detail string").parquet(out), jobs.freshness_state(s, mark)


_FOUND = f"""WITH v AS (SELECT url, k, {_LASTMOD.format(id="page_id", k="k")} AS lastmod, {_HELD.format(id="page_id", k="k")} AS h FROM pages, (VALUES (1), (2), (3)) AS t(k) WHERE url IS NOT NULL),
    r AS (SELECT *, coalesce(lag(lastmod) OVER w, '') AS old, last_value(h IGNORE NULLS) OVER (PARTITION BY url ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM v WINDOW w AS (PARTITION BY url ORDER BY k)),
    m AS (SELECT *, CASE WHEN lastmod <> '' AND old <> '' THEN lastmod NOT LIKE '%/%' AND lastmod > old ELSE lastmod <> '' AND old = '' END AS moved FROM r)
    SELECT url, 'warning' AS severity, 'overactive_lastmod' AS rule, lastmod AS detail FROM m WHERE h = held AND moved UNION ALL SELECT url, 'warning', 'stale_lastmod', lastmod FROM m WHERE h <> held AND NOT moved
    UNION ALL SELECT url, 'notice', 'lastmod_missing', '' FROM m WHERE lastmod = '' UNION ALL SELECT url, 'error', 'lastmod_format', lastmod FROM m WHERE lastmod LIKE '%/%'"""


def _expanded(s: SparkSession, d: str, expand=readers.expand_sitemaps) -> DataFrame:
    """Entries of the sitemaps that an index reaches: two of four, one of them through a second index."""
    entries = view(s, d, "v_sitemap").select("sitemap", "loc")
    path = new_path(s, "sitemap-index")
    rows = s.createDataFrame([(f"<sitemapindex><sitemap><loc> {a} </loc></sitemap><sitemap><loc>{b}</loc></sitemap></sitemapindex>", no) for no, a, b in ((0, "https://site.example.com/sitemap-1.xml", "https://site.example.com/more.xml"), (1, "https://site.example.com/sitemap-3.xml", "https://site.example.com/root.xml"))], "value string, no int")
    rows.write.partitionBy("no").text(path)
    index = readers.read_sitemap_index(s, path).select(F.when(F.col("sitemap").contains("no=0"), "https://site.example.com/root.xml").otherwise("https://site.example.com/more.xml").alias("sitemap"), "child")
    return expand(index, entries, "https://site.example.com/root.xml")


ENTRIES: dict[str, tuple] = {
    "read_edges": (_edges, "SELECT source_url, target_url, target_status_code FROM v_edges WHERE target_status_code <> 404"),
    "read_sitemaps": (lambda s, d: readers.read_sitemaps(s, _sitemap_xml(s, d)).select("loc", "lastmod"), "SELECT loc, lastmod FROM v_sitemap"),
    "read_hreflang": (lambda s, d: readers.read_hreflang(s, _sitemap_xml(s, d)), "SELECT loc AS url, l AS lang, loc || '/' || l AS href FROM v_sitemap, (VALUES ('en'), ('fr')) AS x(l)"),
    "read_url_list": (lambda s, d: readers.read_url_list(s, _text(table(s, d, "pages"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("# "), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("  "), "url")).otherwise(""), "urls")), "SELECT url FROM pages WHERE page_id % 3 = 1"),
    "read_ip_ranges": (_ranges, "SELECT 'bot' AS crawler, 3 AS ord, p AS cidr FROM (SELECT '10.' || (s_suppkey % 256) || '.0.0/16' AS p FROM supplier UNION ALL SELECT '2001:' || s_suppkey || '::/32' FROM supplier)"),
    "write_enriched": (_written, "SELECT event_id, remote_addr, path, status, bytes_sent, verified_crawler, timestamp::DATE AS log_date FROM v_enriched"),
    "write_report": (_report, "SELECT status, string_agg(DISTINCT method, '; ' ORDER BY method) AS methods FROM v_logs GROUP BY 1"),
    "flatten_inspections": (_inspections, "SELECT url, 'PASS' AS verdict, 'Indexed' AS coverage, '/p/' || page_id AS google_canonical, '/p/' || (page_id + CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END) AS user_canonical, '2024-01-01' AS last_crawl, page_id % 4 = 0 AS canonical_differs FROM pages"),
    "percentile_linear": (lambda s, d: view(s, d, "v_logs").groupBy("status").agg(F.round(crawl.percentile_linear("bytes_sent", 0.9), 6).alias("p90")), "SELECT status, round(quantile_cont(bytes_sent::DOUBLE, 0.9), 6) AS p90 FROM v_logs GROUP BY 1"),
    "stream_enrich": (_enriched_stream, "SELECT date_trunc('second', timestamp) AS timestamp, remote_addr, method, uri, path, status, bytes_sent, user_agent, round(request_time, 6) AS request_time, verified_crawler, crawler_purpose, verified_googlebot FROM v_enriched WHERE event_id % 50 <> 49"),
    "stream_freshness": (lambda s, d: _freshness_stream(s, d)[1],
        f"SELECT url, {_LASTMOD.format(id='page_id', k=3)} AS lastmod, {_HELD.format(id='page_id', k=3)} AS content_hash, '2024-02-03' AS last_seen FROM pages WHERE url IS NOT NULL"),
    "stream_freshness_findings": (lambda s, d: _freshness_stream(s, d)[0], _FOUND),
    "expand_sitemaps": (_expanded, "SELECT sitemap, loc FROM v_sitemap WHERE sitemap LIKE '%-1.xml' OR sitemap LIKE '%-3.xml'"),
    "expand_sitemaps_recursive": (lambda s, d: _expanded(s, d, readers.expand_sitemaps_recursive), "SELECT sitemap, loc FROM v_sitemap WHERE sitemap LIKE '%-1.xml' OR sitemap LIKE '%-3.xml'"),
}
