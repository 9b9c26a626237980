"""Queries over logs and crawl analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl, logs, sketches
from ..sources.readers import read_log_lines
from ..storage import materialize, new_path
from .views import view

AS_OF, FROM, TO = "2024-01-31", "2024-01-05", "2024-01-28"


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log records rendered as lines in four formats; every 50th is broken."""
    v = view(spark, sf_dir, "v_logs").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    ncsa = F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss '+0000'")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cat = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    c = F.col
    combined = cat(c("remote_addr"), " - - [", ncsa, '] "', c("method"), " ", c("uri"), ' HTTP/1.1" ', c("status"), " ", c("bytes_sent"), ' "', c("referer"), '" "', c("user_agent"), '" ', c("request_time").cast("decimal(12,6)"))
    nginx = F.to_json(F.struct(iso.alias("timestamp"), "remote_addr", "method", "host", c("uri").alias("request_uri"), "status", "bytes_sent", "referer", "user_agent", "request_time"))
    cloud = F.to_json(F.struct((F.unix_seconds("timestamp") * F.when(c("k") % 2 == 0, 1).otherwise(1000000000)).alias("EdgeStartTimestamp"), c("remote_addr").alias("ClientIP"), c("method").alias("ClientRequestMethod"), c("host").alias("ClientRequestHost"), c("uri").alias("ClientRequestURI"), c("status").alias("EdgeResponseStatus"), c("bytes_sent").alias("EdgeResponseBytes"), c("referer").alias("ClientRequestReferer"), c("user_agent").alias("ClientRequestUserAgent"), (c("request_time") * 1000).alias("OriginResponseDurationMs")))
    alb = cat("https ", iso, " app/lb ", c("remote_addr"), ":5000 10.0.0.1:80 0.0 ", c("request_time").cast("decimal(12,6)"), " 0.0 ", c("status"), " 200 10 ", c("bytes_sent"), ' "', c("method"), " https://", c("host"), ":443", c("uri"), ' HTTP/1.1" "', c("user_agent"), '" - -')
    line = F.when(c("event_id") % 50 == 49, cat("broken ", c("event_id"))).when(c("event_id") % 4 == 0, combined).when(c("event_id") % 4 == 1, nginx).when(c("event_id") % 4 == 2, cloud).otherwise(alb)
    path = new_path(spark, "lines")
    v.select(line.alias("value")).write.text(path)
    return read_log_lines(spark, path)


def _v(name: str):
    return lambda spark, d: view(spark, d, name)


_logs, _ranges = _v("v_logs"), _v("v_ranges")


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return logs.enrich_logs(_logs(spark, d), _ranges(spark, d))


def _from_lines(spark: SparkSession, d: str) -> DataFrame:
    good, _ = logs.parse_logs(raw_lines(spark, d))
    return logs.enrich_logs(good, _ranges(spark, d))


def _access(spark: SparkSession, d: str) -> DataFrame:
    return crawl.access_view(_enriched(spark, d))


def _parse(kind: int, fmt: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        lines = raw_lines(spark, d)
        good, _ = logs.parse_logs(logs.detect_log_format(lines).where(F.col("log_format") == fmt).select("value"), fmt)
        return good.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "remote_addr", "method", "uri", "path", "status", "bytes_sent", "user_agent", F.round("request_time", 6).alias("request_time"))

    sql = f"""SELECT date_trunc('second', timestamp) AS timestamp, remote_addr, method, uri, regexp_extract(uri, '^([^?]+)', 1) AS path, status, bytes_sent, user_agent, round(request_time, 6) AS request_time
        FROM v_logs WHERE event_id % 50 <> 49 AND event_id % 4 = {kind}"""
    return query, sql


def _dns(spark: SparkSession, d: str) -> DataFrame:
    ips = _logs(spark, d).select(F.col("remote_addr").alias("ip"), "k").distinct()
    k = F.col("k") % 6
    ptr = ips.where(k != 5).select("ip", F.when(k == 0, None).when(k == 1, "crawl.example.net").when(k == 2, "evil-googlebot.com").otherwise(F.concat(F.lit("h"), F.regexp_replace("ip", "[.:]", "-"), F.lit(".googlebot.com"))).alias("host"))
    fwd = ips.where(k >= 3).select(F.concat(F.lit("h"), F.regexp_replace("ip", "[.:]", "-"), F.lit(".googlebot.com")).alias("host"), F.array(F.when(k == 3, F.col("ip")).otherwise("192.0.2.1")).alias("addrs"))
    return logs.dns_confirm(_logs(spark, d), ptr, fwd)


def _locale(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.with_path(_logs(spark, d)).withColumn("accept_language", F.expr("CASE k % 5 WHEN 0 THEN 'fr-CH, fr;q=0.9, en;q=0.8' WHEN 1 THEN 'de;q=0.5,es;q=0.7' WHEN 2 THEN 'ja' WHEN 3 THEN null ELSE 'en-US,en' END"))
    return logs.locale_demand(rows, ["en", "fr", "de", "es"])


def _depth_sketches(s: SparkSession, d: str) -> DataFrame:
    """Depths from sketches of days, and whether the distinct addresses are within the stated bound."""
    rows = _enriched(s, d)
    told = sketches.depth_report(materialize(sketches.daily_depths(rows), "sketches"), AS_OF)
    exact = crawl.depth_distribution(rows, AS_OF).select("depth", F.col("unique_urls").alias("exact"))
    return told.join(exact, "depth").select("depth", "requests", (F.abs(F.col("unique_urls") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")).alias("within"))


def _parameter_sketches(s: SparkSession, d: str) -> DataFrame:
    rows = _enriched(s, d)
    told = sketches.parameter_report(materialize(sketches.daily_parameters(rows), "sketches"), AS_OF, min_distinct=0)
    exact = rows.where("verified_googlebot").where(crawl._since(AS_OF, 30)).groupBy(F.substring_index("uri", "?", 1).alias("path")).agg(
        F.countDistinct(F.regexp_extract("uri", r"\?(.*)$", 1)).alias("exact"))
    return told.join(exact, "path").select("path", "requests", "parameterized", (F.abs(F.col("unique_queries") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")).alias("within"))


def _latency_sketches(s: SparkSession, d: str) -> DataFrame:
    """Times by hour of the day from sketches of days, and whether their ranks are within the stated bound."""
    rows = _enriched(s, d)
    told = sketches.latency_report(materialize(sketches.daily_latencies(rows), "sketches"), AS_OF, 30)
    seen = rows.where("verified_googlebot and status = 200 and request_time is not null").where(crawl._since(AS_OF, 30)).select(F.hour("timestamp").alias("hour"), "request_time")
    share = lambda cond: F.avg(cond.cast("int"))
    t = F.col("request_time")
    near = lambda c, q: (share(t < F.col(c)) <= q + sketches.RANK_ERROR) & (share(t <= F.col(c)) >= q - sketches.RANK_ERROR)
    return seen.join(told, "hour").groupBy("hour", "requests").agg((near("p50", 0.5) & near("p95", 0.95)).alias("within"))


_DAYS = "verified_googlebot AND timestamp >= DATE '2024-01-31' - INTERVAL 30 DAY"


ENTRIES: dict[str, tuple] = {
    "detect_log_format": (lambda s, d: logs.detect_log_format(raw_lines(s, d)).groupBy("log_format").agg(F.count("*").alias("n")),
        "SELECT CASE WHEN event_id % 50 = 49 OR event_id % 4 = 0 THEN 'combined' WHEN event_id % 4 = 1 THEN 'nginx_json' WHEN event_id % 4 = 2 THEN 'cloudflare' ELSE 'alb' END AS log_format, count(*) AS n FROM v_logs GROUP BY 1"),
    "parse_combined": _parse(0, "combined"), "parse_nginx_json": _parse(1, "nginx_json"), "parse_cloudflare": _parse(2, "cloudflare"), "parse_alb": _parse(3, "alb"),
    "parse_logs_counts": (lambda s, d: (lambda g, b: g.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("kind"), "n").union(b.agg(F.count("*").alias("n")).select(F.lit("rejected").alias("kind"), "n")))(*logs.parse_logs(raw_lines(s, d))),
        "SELECT CASE WHEN event_id % 50 = 49 THEN 'rejected' ELSE 'accepted' END AS kind, count(*) AS n FROM v_logs GROUP BY 1"),
    "parse_by_index": (lambda s, d: logs.parse_by_index(raw_lines(s, d).where("value rlike '^[0-9a-f:.]+ - -'")).select("url", "status", "bytes_sent"),
        "SELECT uri AS url, status, bytes_sent FROM v_logs WHERE event_id % 50 <> 49 AND event_id % 4 = 0"),
    "with_path": (lambda s, d: logs.with_path(_logs(s, d)).select("event_id", "path"), "SELECT event_id, regexp_extract(uri, '^([^?]+)', 1) AS path FROM v_logs"),
    "verify_crawler": (lambda s, d: logs.verify_crawler(_logs(s, d), _ranges(s, d)).select("event_id", "verified_crawler"), "SELECT event_id, verified_crawler FROM v_classified"),
    "ua_claim": (lambda s, d: logs.ua_claim(_logs(s, d)).select("event_id", "claimed_crawler"), "SELECT event_id, CASE WHEN user_agent LIKE '%Googlebot%' THEN 'googlebot' WHEN user_agent LIKE '%GPTBot%' THEN 'gptbot' ELSE '' END AS claimed_crawler FROM v_logs"),
    "anonymize_ip": (lambda s, d: _enriched(s, d).select("event_id", "remote_addr"), "SELECT event_id, remote_addr FROM v_enriched"),
    "enrich_logs": (lambda s, d: _enriched(s, d).select("timestamp", "remote_addr", "method", "host", "uri", "path", "status", "bytes_sent", "user_agent", "request_time", "verified_crawler", "crawler_purpose", "verified_googlebot", "event_id"), "SELECT * FROM v_enriched"),
    "enrichment_summary": (lambda s, d: logs.enrichment_summary(_enriched(s, d)),
        "SELECT verified_crawler, count(*) AS requests, count(*) FILTER (WHERE status >= 400) AS errors, count(DISTINCT path) AS paths, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM v_enriched GROUP BY 1"),
    "enrichment_totals": (lambda s, d: logs.enrichment_totals(_enriched(s, d)),
        "SELECT count(*) AS total_requests, count(*) FILTER (WHERE verified_crawler <> '') AS verified_crawlers, count(DISTINCT verified_crawler) FILTER (WHERE verified_crawler <> '') AS distinct_crawler_types FROM v_enriched"),
    "googlebot_verification": (lambda s, d: logs.googlebot_verification(_logs(s, d), _ranges(s, d)),
        """SELECT CASE WHEN verified_crawler IN ('googlebot', 'special-crawlers') AND user_agent LIKE '%Googlebot%' THEN 'accepted' WHEN user_agent LIKE '%Googlebot%' THEN 'rejected_ip'
             WHEN verified_crawler IN ('googlebot', 'special-crawlers') THEN 'rejected_ua' ELSE 'rejected_both' END AS outcome, count(*) AS requests FROM v_classified GROUP BY 1"""),
    "spoofed_agents": (lambda s, d: logs.spoofed_agents(_logs(s, d), _ranges(s, d)),
        "SELECT left(user_agent, 120) AS user_agent, count(*) AS requests FROM v_classified WHERE verified_crawler = '' AND (user_agent LIKE '%Googlebot%' OR user_agent LIKE '%GPTBot%') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "crawler_verification_report": (lambda s, d: logs.crawler_verification_report(_logs(s, d), _ranges(s, d)),
        """WITH r AS (SELECT *, CASE WHEN user_agent LIKE '%Googlebot%' THEN 'googlebot' WHEN user_agent LIKE '%GPTBot%' THEN 'gptbot' ELSE '' END AS c FROM v_classified)
           SELECT CASE WHEN verified_crawler <> '' THEN verified_crawler ELSE c END AS crawler, count(*) FILTER (WHERE verified_crawler <> '') AS verified, count(*) FILTER (WHERE verified_crawler = '' AND c <> '') AS spoofed FROM r WHERE verified_crawler <> '' OR c <> '' GROUP BY 1"""),
    "keep_verified": (lambda s, d: logs.keep_verified(_logs(s, d), _ranges(s, d)).select("event_id", "verified_crawler"), "SELECT event_id, verified_crawler FROM v_classified WHERE verified_crawler <> ''"),
    "ip_membership": (lambda s, d: logs.ip_membership(_logs(s, d), _ranges(s, d)), "SELECT DISTINCT remote_addr, CASE WHEN verified_crawler <> '' THEN 'match' ELSE 'miss' END AS membership FROM v_classified"),
    "dns_confirm": (_dns, "SELECT DISTINCT remote_addr AS ip, CASE k % 6 WHEN 0 THEN 'no_ptr' WHEN 1 THEN 'wrong_domain' WHEN 2 THEN 'wrong_domain' WHEN 3 THEN 'confirmed' WHEN 4 THEN 'forward_mismatch' ELSE 'indeterminate' END AS outcome FROM v_logs"),
    "locale_demand": (_locale, "SELECT CASE k % 5 WHEN 0 THEN 'fr' WHEN 1 THEN 'es' ELSE 'en' END AS locale, count(*) AS requests FROM v_enriched JOIN v_logs USING (event_id) WHERE path NOT LIKE '%.css' GROUP BY 1"),
    "crawl_frequency": (lambda s, d: crawl.crawl_frequency(_enriched(s, d), AS_OF),
        "SELECT path, count(*) AS crawl_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, date_diff('day', max(timestamp)::DATE, DATE '2024-01-31') AS days_since_last_crawl FROM v_enriched WHERE verified_googlebot AND status = 200 AND timestamp >= DATE '2024-01-31' - INTERVAL 30 DAY GROUP BY path"),
    # Minimum slice: lines -> records -> crawler -> enriched -> share of each day.
    "status_by_day": (lambda s, d: crawl.status_by_day(_from_lines(s, d), AS_OF),
        "SELECT date_trunc('day', timestamp)::DATE AS day, status, count(*) AS requests, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY date_trunc('day', timestamp)), 2)::DOUBLE AS pct_of_day FROM v_enriched WHERE verified_googlebot AND event_id % 50 <> 49 AND timestamp >= DATE '2024-01-31' - INTERVAL 14 DAY GROUP BY date_trunc('day', timestamp), status"),
    "depth_distribution": (lambda s, d: crawl.depth_distribution(_enriched(s, d), AS_OF),
        "SELECT len(string_split(trim(path, '/'), '/'))::INT AS depth, count(*) AS requests, count(DISTINCT path) AS unique_urls FROM v_enriched WHERE verified_googlebot AND status = 200 AND timestamp >= DATE '2024-01-31' - INTERVAL 30 DAY GROUP BY 1"),
    "depth_from_sketches": (_depth_sketches, f"SELECT len(string_split(trim(path, '/'), '/'))::INT AS depth, count(*) AS requests, true AS within FROM v_enriched WHERE {_DAYS} AND status = 200 GROUP BY 1"),
    "parameters_from_sketches": (_parameter_sketches,
        f"SELECT string_split(uri, '?')[1] AS path, count(*) AS requests, count(*) FILTER (WHERE regexp_extract(uri, '[?](.*)$', 1) <> '') AS parameterized, true AS within FROM v_enriched WHERE {_DAYS} GROUP BY 1"),
    "latency_from_sketches": (_latency_sketches, f"SELECT extract(hour FROM timestamp)::INT AS hour, count(*) AS requests, true AS within FROM v_enriched WHERE {_DAYS} AND status = 200 AND request_time IS NOT NULL GROUP BY 1"),
    "latency_by_hour": (lambda s, d: crawl.latency_by_hour(_enriched(s, d), AS_OF, exact=True).select("hour", *(F.round(c, 8).alias(c) for c in ("p50", "p95", "p99")), "requests"),
        "SELECT date_trunc('hour', timestamp) AS hour, round(quantile_cont(request_time, 0.5), 8) AS p50, round(quantile_cont(request_time, 0.95), 8) AS p95, round(quantile_cont(request_time, 0.99), 8) AS p99, count(*) AS requests FROM v_enriched WHERE verified_googlebot AND status = 200 AND timestamp >= DATE '2024-01-31' - INTERVAL 7 DAY GROUP BY 1"),
    "latency_by_hour_approx": (lambda s, d: crawl.latency_by_hour(_enriched(s, d), AS_OF).select("hour", *(F.round(c, 8).alias(c) for c in ("p50", "p95", "p99")), "requests"),
        "SELECT date_trunc('hour', timestamp) AS hour, round(quantile_disc(request_time, 0.5), 8) AS p50, round(quantile_disc(request_time, 0.95), 8) AS p95, round(quantile_disc(request_time, 0.99), 8) AS p99, count(*) AS requests FROM v_enriched WHERE verified_googlebot AND status = 200 AND timestamp >= DATE '2024-01-31' - INTERVAL 7 DAY GROUP BY 1"),
    "parameter_proliferation": (lambda s, d: crawl.parameter_proliferation(_enriched(s, d), AS_OF, min_distinct=2),
        """WITH p AS (SELECT path, regexp_extract(uri, '[?](.*)$', 1) AS q FROM v_enriched WHERE verified_googlebot AND timestamp >= DATE '2024-01-31' - INTERVAL 30 DAY)
           SELECT path, count(*) AS total_crawls, count(*) FILTER (WHERE q <> '') AS parameterized_crawls, count(DISTINCT q) AS unique_parameter_combinations, round(100.0 * count(*) FILTER (WHERE q <> '') / count(*), 2)::DOUBLE AS pct_parameterized
           FROM p GROUP BY path HAVING count(DISTINCT q) > 2 ORDER BY 4 DESC, 1 LIMIT 100"""),
    "uncrawled_pages": (lambda s, d: crawl.uncrawled_pages(view(s, d, "v_sitemap_paths"), _enriched(s, d), AS_OF),
        "SELECT path AS uncrawled_path FROM v_sitemap_paths WHERE path NOT IN (SELECT path FROM v_enriched WHERE verified_googlebot AND status IN (200, 304) AND timestamp >= DATE '2024-01-31' - INTERVAL 30 DAY)"),
    "url_class_distribution": (lambda s, d: crawl.url_class_distribution(_access(s, d), FROM, TO),
        """SELECT CASE WHEN uri LIKE '%utm_source%' THEN 'tracking' WHEN uri LIKE '%?page=%' THEN 'pagination' WHEN uri LIKE '%size=s' THEN 'multi_facet' WHEN uri LIKE '%?color=%' THEN 'single_facet' ELSE 'clean_url' END AS url_class,
             count(*) AS requests, count(DISTINCT uri) AS unique_urls, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent_of_total FROM v_enriched WHERE user_agent LIKE '%Googlebot%' AND timestamp::DATE BETWEEN '2024-01-05' AND '2024-01-28' GROUP BY 1"""),
    "url_class_weekly": (lambda s, d: crawl.url_class_weekly(_access(s, d), FROM, TO),
        """SELECT (timestamp::DATE - CAST(dayofweek(timestamp::DATE) AS INT))::DATE AS week, CASE WHEN uri LIKE '%utm_source%' THEN 'wasted' WHEN uri LIKE '%size=s' THEN 'multi_facet' WHEN uri LIKE '%?%=%' THEN 'single_facet' ELSE 'clean_url' END AS url_class,
             count(*) AS requests FROM v_enriched WHERE user_agent LIKE '%Googlebot%' AND timestamp::DATE BETWEEN '2024-01-05' AND '2024-01-28' GROUP BY 1, 2"""),
    "top_wasted_paths": (lambda s, d: crawl.top_wasted_paths(_access(s, d), FROM, TO),
        "SELECT path, count(*) AS requests, count(DISTINCT uri) AS unique_urls_with_params FROM v_enriched WHERE user_agent LIKE '%Googlebot%' AND timestamp::DATE BETWEEN '2024-01-05' AND '2024-01-28' AND uri LIKE '%?%=%' GROUP BY path ORDER BY 2 DESC, 1 LIMIT 50"),
    "facet_status_distribution": (lambda s, d: crawl.facet_status_distribution(_access(s, d), FROM, TO),
        "SELECT status AS status_code, count(*) AS requests, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent_of_total FROM v_enriched WHERE user_agent LIKE '%Googlebot%' AND timestamp::DATE BETWEEN '2024-01-05' AND '2024-01-28' AND uri LIKE '%?%=%' GROUP BY 1"),
    "status_distribution": (lambda s, d: crawl.status_distribution(_logs(s, d)),
        "SELECT CASE WHEN status IN (200, 304, 404, 410) THEN status::VARCHAR WHEN status = 301 THEN '3xx' WHEN status = 500 THEN '5xx' ELSE 'other' END AS bucket, count(*) AS requests, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM v_logs GROUP BY 1"),
    "top_patterns": (lambda s, d: crawl.top_patterns(_logs(s, d)).select("pattern", "requests", "share", "bytes_total", F.round("p50", 8).alias("p50"), F.round("p95", 8).alias("p95"), "redirects", "redirect_ratio", F.array_join(F.transform(F.map_entries("status_breakdown"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("statuses")),
        """WITH l AS (SELECT regexp_extract(uri, '^([^?]+)', 1) AS pattern, CASE WHEN status IN (200, 304, 404) THEN status::VARCHAR WHEN status = 301 THEN '3xx' ELSE '5xx' END AS bucket, bytes_sent, request_time FROM v_logs),
             b AS (SELECT pattern, string_agg(bucket || ':' || n, ',' ORDER BY bucket) AS statuses FROM (SELECT pattern, bucket, count(*) AS n FROM l GROUP BY ALL) GROUP BY 1),
             t AS (SELECT pattern, count(*) AS requests, round(count(*)::DOUBLE / (SELECT count(*) FROM l), 6) AS share, sum(bytes_sent)::BIGINT AS bytes_total, round(quantile_cont(request_time, 0.5), 8) AS p50, round(quantile_cont(request_time, 0.95), 8) AS p95,
                          count(*) FILTER (WHERE bucket = '3xx') AS redirects, round(count(*) FILTER (WHERE bucket = '3xx')::DOUBLE / count(*), 6) AS redirect_ratio FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
           SELECT t.*, b.statuses FROM t JOIN b USING (pattern)"""),
    "pattern_statuses": (lambda s, d: crawl.pattern_statuses(_logs(s, d)),
        "SELECT regexp_extract(uri, '^([^?]+)', 1) AS pattern, CASE WHEN status IN (200, 304, 404) THEN status::VARCHAR WHEN status = 301 THEN '3xx' ELSE '5xx' END AS bucket, count(*) AS requests FROM v_logs GROUP BY 1, 2"),
    "parameter_frequency": (lambda s, d: crawl.parameter_frequency(_logs(s, d)),
        "SELECT split_part(p, '=', 1) AS parameter, count(*) AS occurrences FROM (SELECT unnest(string_split(regexp_extract(uri, '[?](.*)$', 1), '&')) AS p FROM v_logs) WHERE p <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "asset_share": (lambda s, d: crawl.asset_share(_logs(s, d)), "SELECT sum(a)::BIGINT AS asset_requests, count(*) AS requests, round(avg(a), 6) AS share FROM (SELECT CASE WHEN regexp_extract(uri, '^([^?]+)', 1) LIKE '%.css' THEN 1 ELSE 0 END AS a FROM v_logs)"),
    "small_200s": (lambda s, d: crawl.small_200s(_logs(s, d)), "SELECT uri, bytes_sent, timestamp FROM v_logs WHERE status = 200 AND bytes_sent > 0 AND bytes_sent < 1024 ORDER BY 2, 1, 3 LIMIT 200"),
    "crawl_waste_report": (lambda s, d: crawl.crawl_waste_report(_logs(s, d)),
        """SELECT * FROM (SELECT 'status' AS section, CASE WHEN status IN (200, 304, 404) THEN status::VARCHAR WHEN status = 301 THEN '3xx' ELSE '5xx' END AS name, count(*)::DOUBLE AS value FROM v_logs GROUP BY 1, 2)
           UNION ALL (SELECT 'pattern', regexp_extract(uri, '^([^?]+)', 1), count(*)::DOUBLE FROM v_logs GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 10)
           UNION ALL (SELECT 'parameter', split_part(p, '=', 1), count(*)::DOUBLE FROM (SELECT unnest(string_split(regexp_extract(uri, '[?](.*)$', 1), '&')) AS p FROM v_logs) WHERE p <> '' GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 10)
           UNION ALL SELECT 'asset', 'share', round(avg(CASE WHEN regexp_extract(uri, '^([^?]+)', 1) LIKE '%.css' THEN 1 ELSE 0 END), 6) FROM v_logs
           UNION ALL SELECT 'small_200s', 'count', count(*) FILTER (WHERE status = 200 AND bytes_sent > 0 AND bytes_sent < 1024)::DOUBLE FROM v_logs"""),
    "crawl_alerts": (lambda s, d: crawl.crawl_alerts(crawl.status_distribution(_logs(s, d)).select(F.col("bucket").alias("metric"), F.col("share").alias("value")), s.createDataFrame([("404", 0.01), ("5xx", 0.5), ("3xx", 0.05)], "metric string, most double")),
        """WITH m AS (SELECT CASE WHEN status = 404 THEN '404' WHEN status = 301 THEN '3xx' ELSE 'x' END AS metric, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS value FROM v_logs GROUP BY 1)
           SELECT metric, value, CASE metric WHEN '404' THEN 0.01 ELSE 0.05 END::DOUBLE AS most FROM m WHERE (metric = '404' AND value > 0.01) OR (metric = '3xx' AND value > 0.05)"""),
}
