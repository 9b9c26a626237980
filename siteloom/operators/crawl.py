"""Crawl analytics over enriched logs. Dates are arguments, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

from .logs import split_path


def _since(as_of: str, days: int) -> Column:
    return F.col("timestamp") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")


def _share(n: Column, whole: Column) -> Column:
    return F.round(100.0 * n.cast("double") / whole, 2)


def crawl_frequency(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = logs.where(F.col("verified_googlebot") & (F.col("status") == 200) & _since(as_of, days))
    out = rows.groupBy("path").agg(F.count("*").alias("crawl_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return out.withColumn("days_since_last_crawl", F.datediff(F.lit(as_of).cast("date"), F.to_date("last_seen")).cast("long"))


def status_by_day(logs: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    rows = logs.where(F.col("verified_googlebot") & _since(as_of, days))
    out = rows.groupBy(F.to_date("timestamp").alias("day"), "status").agg(F.count("*").alias("requests"))
    return out.withColumn("pct_of_day", _share(F.col("requests"), F.sum("requests").over(Window.partitionBy("day"))))


def depth_distribution(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Requests by number of path segments; the root counts as one."""
    rows = logs.where(F.col("verified_googlebot") & (F.col("status") == 200) & _since(as_of, days))
    return rows.groupBy(F.size(F.split(F.expr("trim(BOTH '/' FROM path)"), "/")).alias("depth")).agg(
        F.count("*").alias("requests"), F.countDistinct("path").alias("unique_urls"),
    )


def latency_by_hour(logs: DataFrame, as_of: str, days: int = 7, exact: bool = False) -> DataFrame:
    """p50, p95 and p99 of the request time. Approximate by default: the state of one
    hour is then bounded; exact ones hold each distinct value of the hour."""
    rows = logs.where(F.col("verified_googlebot") & (F.col("status") == 200) & _since(as_of, days))
    p = lambda q: F.percentile("request_time", q) if exact else F.percentile_approx("request_time", q)
    return rows.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(
        p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.count("*").alias("requests"),
    )


def parameter_proliferation(logs: DataFrame, as_of: str, days: int = 30, min_distinct: int = 50, top: int = 100) -> DataFrame:
    rows = logs.where(F.col("verified_googlebot") & _since(as_of, days)).select(
        split_path(F.col("uri")).alias("path"), F.regexp_extract("uri", r"\?(.*)$", 1).alias("query"),
    )
    out = rows.groupBy("path").agg(
        F.count("*").alias("total_crawls"), F.count_if(F.col("query") != "").alias("parameterized_crawls"),
        F.countDistinct("query").alias("unique_parameter_combinations"),
    )
    out = out.where(F.col("unique_parameter_combinations") > min_distinct).withColumn("pct_parameterized", _share(F.col("parameterized_crawls"), F.col("total_crawls")))
    return out.orderBy(F.desc("unique_parameter_combinations"), "path").limit(top)


def uncrawled_pages(sitemap: DataFrame, logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = logs.where(F.col("verified_googlebot") & F.col("status").isin(200, 304) & _since(as_of, days)).select("path").distinct()
    return sitemap.where(F.col("snapshot_date") == F.lit(as_of).cast("date")).join(recent, "path", "left_anti").select(F.col("path").alias("uncrawled_path"))


# Classes of URLs, first match wins.
URL_CLASSES = [
    ("tracking", r"\butm_"), ("session", r"\bsessionid="), ("session", r"\bsid="), ("sort", r"\bsort="), ("per_page", r"\bper_page="),
    ("view", r"\bview="), ("pagination", r"\bpage="), ("multi_facet", r"\?.*=.*&.*="), ("single_facet", r"\?[^=]+="),
]
_FACET = r"\?[^=]+="


def url_class(uri: Column) -> Column:
    return F.coalesce(*[F.when(uri.rlike(p), name) for name, p in URL_CLASSES], F.lit("clean_url"))


def access_view(logs: DataFrame) -> DataFrame:
    """The four columns that the facet reports take."""
    return logs.select(F.col("uri").alias("request_uri"), "user_agent", F.to_date("timestamp").alias("request_date"), F.col("status").alias("status_code"))


def _bot(access: DataFrame, start: str, end: str) -> DataFrame:
    return access.where(F.col("user_agent").contains("Googlebot") & F.col("request_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def url_class_distribution(access: DataFrame, start: str, end: str) -> DataFrame:
    out = _bot(access, start, end).groupBy(url_class(F.col("request_uri")).alias("url_class")).agg(
        F.count("*").alias("requests"), F.countDistinct("request_uri").alias("unique_urls"),
    )
    return out.withColumn("percent_of_total", _share(F.col("requests"), F.sum("requests").over(Window.partitionBy())))


def url_class_weekly(access: DataFrame, start: str, end: str) -> DataFrame:
    """Weeks begin on Sunday."""
    uri = F.col("request_uri")
    kind = F.when(uri.rlike(r"\butm_|\bsessionid=|\bsid="), "wasted").when(uri.rlike(r"\?.*=.*&.*="), "multi_facet").when(uri.rlike(_FACET), "single_facet").otherwise("clean_url")
    week = F.date_sub("request_date", F.dayofweek("request_date") - 1)
    return _bot(access, start, end).groupBy(week.alias("week"), kind.alias("url_class")).agg(F.count("*").alias("requests"))


def top_wasted_paths(access: DataFrame, start: str, end: str, k: int = 50) -> DataFrame:
    rows = _bot(access, start, end).where(F.col("request_uri").rlike(_FACET))
    return rows.groupBy(split_path(F.col("request_uri")).alias("path")).agg(
        F.count("*").alias("requests"), F.countDistinct("request_uri").alias("unique_urls_with_params"),
    ).orderBy(F.desc("requests"), "path").limit(k)


def facet_status_distribution(access: DataFrame, start: str, end: str) -> DataFrame:
    out = _bot(access, start, end).where(F.col("request_uri").rlike(_FACET)).groupBy("status_code").agg(F.count("*").alias("requests"))
    return out.withColumn("percent_of_total", _share(F.col("requests"), F.sum("requests").over(Window.partitionBy())))


def status_bucket(status: Column) -> Column:
    named = F.when(status.isin(200, 304, 404, 410), status.cast("string"))
    return F.coalesce(
        named,
        F.when(status.between(300, 399), "3xx").when(status.between(500, 599), "5xx").when(status.between(200, 299), "2xx_other").when(status.between(400, 499), "4xx_other").otherwise("other"),
    )


def status_distribution(logs: DataFrame) -> DataFrame:
    out = logs.groupBy(status_bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("requests"))
    return out.withColumn("share", F.round(F.col("requests").cast("double") / F.sum("requests").over(Window.partitionBy()), 6))


def percentile_linear(col: str | Column, p: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(col, p)


def top_patterns(logs: DataFrame, k: int = 50) -> DataFrame:
    """The most requested paths with their share, statuses and exact times. Ties go by path.

    Paths are counted by status first. Only the times of the k paths found are looked at,
    and these as counts of each value in order, so that a hot path is a sort, which spills,
    and never a value held in memory. A path without times has null percentiles.
    """
    rows = logs.select(split_path(F.col("uri")).alias("pattern"), status_bucket(F.col("status")).alias("bucket"), "bytes_sent", "request_time")
    cells = materialize(
        rows.groupBy("pattern", "bucket").agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"), F.count("request_time").alias("timed")),
        "patterns",
    )
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    per = cells.groupBy("pattern").agg(
        F.sum("n").alias("requests"), F.sum("bytes").alias("bytes_total"), F.sum("timed").alias("timed"),
        F.sum(F.when(F.col("bucket") == "3xx", F.col("n")).otherwise(0)).alias("redirects"),
    )
    top = materialize(per.orderBy(F.desc("requests"), "pattern").limit(k), "patterns")
    statuses = cells.join(top.select("pattern"), "pattern").groupBy("pattern").agg(  # nine at most
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("status_breakdown")
    )
    times = rows.where("request_time is not null").join(top.select("pattern", "timed"), "pattern").groupBy("pattern", "timed", "request_time").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("pattern").orderBy("request_time"))
    times = times.withColumn("upto", upto)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("request_time")))
    place = lambda p: (F.col("timed") - 1) * F.lit(p)
    between = lambda p: at(F.floor(place(p))) + (at(F.ceil(place(p))) - at(F.floor(place(p)))) * F.first(place(p) - F.floor(place(p)))
    times = times.groupBy("pattern").agg(between(0.5).alias("p50"), between(0.95).alias("p95"))
    out = top.join(statuses, "pattern", "left").join(times, "pattern", "left")
    ratio = lambda a, b: F.round(a.cast("double") / b, 6)
    return out.select(
        "pattern", "requests", ratio(F.col("requests"), F.lit(total)).alias("share"), "bytes_total", "p50", "p95", "redirects",
        ratio(F.col("redirects"), F.col("requests")).alias("redirect_ratio"), "status_breakdown",
    ).orderBy(F.desc("requests"), "pattern")


def pattern_statuses(logs: DataFrame) -> DataFrame:
    return logs.groupBy(split_path(F.col("uri")).alias("pattern"), status_bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("requests"))


def query_params(uri: Column) -> Column:
    """(name, value) of each parameter, in order, decoded; blank values are kept."""
    query = F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1)
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(
        pairs,
        lambda x: F.struct(
            plain(F.substring_index(x, "=", 1)).alias("name"),
            plain(F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("value"),
        ),
    )


def parameter_frequency(logs: DataFrame, k: int = 50) -> DataFrame:
    rows = logs.select(F.explode(query_params(F.col("uri"))).alias("p"))
    return rows.groupBy(F.col("p.name").alias("parameter")).agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "parameter").limit(k)


def is_asset(uri: Column) -> Column:
    path = split_path(uri)
    return path.rlike(
        r"(?i)\.(css|js|mjs|map|png|jpe?g|gif|svg|webp|avif|ico|woff2?|ttf|otf|eot)([?#]|$)"
    ) | path.rlike(r"(?i)^/(static|assets|_next|_nuxt|build|dist|public|cdn)/")


def asset_share(logs: DataFrame) -> DataFrame:
    asset = is_asset(F.col("uri")).cast("int")
    return logs.agg(F.sum(asset).alias("asset_requests"), F.count("*").alias("requests"), F.round(F.avg(asset), 6).alias("share"))


def small_200s(logs: DataFrame, threshold: int = 1024, k: int = 200) -> DataFrame:
    """Successful answers so small that they may be errors in disguise."""
    rows = logs.where((F.col("status") == 200) & (F.col("bytes_sent") > 0) & (F.col("bytes_sent") < threshold))
    return rows.select("uri", "bytes_sent", "timestamp").orderBy("bytes_sent", "uri", "timestamp").limit(k)


def crawl_waste_report(logs: DataFrame, k: int = 10) -> DataFrame:
    """The waste figures in long form: section, name, value. The logs are counted once by path,
    status and size; all figures but the parameters' are sums of these counts."""
    small = (F.col("status") == 200) & (F.col("bytes_sent") > 0) & (F.col("bytes_sent") < 1024)
    rows = logs.select(
        split_path(F.col("uri")).alias("pattern"), status_bucket(F.col("status")).alias("bucket"), is_asset(F.col("uri")).alias("asset"),
        F.coalesce(small, F.lit(False)).alias("small"),
    )
    cells = materialize(rows.groupBy("pattern", "bucket", "asset", "small").agg(F.count("*").alias("n")), "waste")
    row = lambda df, section, name, value: df.select(
        F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"),
    )
    n = F.sum("n")
    parts = [
        row(cells.groupBy("bucket").agg(n.alias("v")), "status", F.col("bucket"), F.col("v")),
        row(cells.groupBy("pattern").agg(n.alias("v")).orderBy(F.desc("v"), "pattern").limit(k), "pattern", F.col("pattern"), F.col("v")),
        row(parameter_frequency(logs, k), "parameter", F.col("parameter"), F.col("occurrences")),
        row(cells.agg(F.round(F.sum(F.when(F.col("asset"), F.col("n")).otherwise(0)).cast("double") / n, 6).alias("v")), "asset", F.lit("share"), F.col("v")),
        row(cells.agg(F.coalesce(F.sum(F.when(F.col("small"), F.col("n"))), F.lit(0)).alias("v")), "small_200s", F.lit("count"), F.col("v")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def crawl_alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics (metric, value) over the limits of thresholds (metric, most)."""
    return metrics.join(thresholds, "metric").where("value > most").select("metric", "value", "most")
