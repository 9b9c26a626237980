"""Daily summaries of crawler logs that add up: a report over 30 days merges 30 small rows
instead of reading the logs again.

Distinct addresses are HyperLogLog sketches of 2^`LG` registers, whose relative error is 1.04 /
sqrt(2^LG) at one standard deviation (1.6 % at 12, so 5 % holds at three); times are KLL
sketches, whose ranks are off by about 1.3 % (at k = 200). Counts are exact. Merging keeps
these bounds, in any order, so a day that comes late is merged in like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 12
#: Stated bounds of the errors: of distinct counts, relative, and of ranks.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.03


def _within(as_of: str, days: int) -> Column:
    """Days from `days` before as_of on, as the exact reports have it by time."""
    return F.col("log_date") >= F.date_sub(F.lit(as_of).cast("date"), days)


def daily_depths(logs: DataFrame) -> DataFrame:
    """(log_date, depth, requests, urls) of the search bot's answers 200: by number of path segments,
    with a sketch of the addresses."""
    rows = logs.where(F.col("verified_googlebot") & (F.col("status") == 200))
    depth = F.size(F.split(F.expr("trim(BOTH '/' FROM path)"), "/"))
    return rows.groupBy(F.to_date("timestamp").alias("log_date"), depth.alias("depth")).agg(F.count("*").alias("requests"), F.hll_sketch_agg("path", LG).alias("urls"))


def depth_report(days_of: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(depth, requests, unique_urls) of `daily_depths`: unique_urls is an estimate."""
    return days_of.where(_within(as_of, days)).groupBy("depth").agg(F.sum("requests").alias("requests"), F.hll_sketch_estimate(F.hll_union_agg("urls")).alias("unique_urls"))


def daily_parameters(logs: DataFrame) -> DataFrame:
    """(log_date, path, requests, parameterized, queries): query strings of each path as a sketch (of
    their hashes, as sketches pass over empty strings)."""
    query = F.regexp_extract("uri", r"\?(.*)$", 1)
    rows = logs.where(F.col("verified_googlebot")).select(F.to_date("timestamp").alias("log_date"), F.substring_index("uri", "?", 1).alias("path"), query.alias("query"))
    return rows.groupBy("log_date", "path").agg(F.count("*").alias("requests"), F.count_if(F.col("query") != "").alias("parameterized"), F.hll_sketch_agg(F.xxhash64("query"), LG).alias("queries"))


def parameter_report(days_of: DataFrame, as_of: str, days: int = 30, min_distinct: int = 50) -> DataFrame:
    """(path, requests, parameterized, unique_queries) of paths with over min_distinct query strings, estimated."""
    out = days_of.where(_within(as_of, days)).groupBy("path").agg(
        F.sum("requests").alias("requests"), F.sum("parameterized").alias("parameterized"), F.hll_sketch_estimate(F.hll_union_agg("queries")).alias("unique_queries"),
    )
    return out.where(F.col("unique_queries") > min_distinct)


def daily_latencies(logs: DataFrame) -> DataFrame:
    """(log_date, hour, requests, times): a sketch of the request times of each hour of the day."""
    rows = logs.where(F.col("verified_googlebot") & (F.col("status") == 200) & F.col("request_time").isNotNull())
    return rows.groupBy(F.to_date("timestamp").alias("log_date"), F.hour("timestamp").alias("hour")).agg(F.count("*").alias("requests"), F.kll_sketch_agg_double("request_time").alias("times"))


def latency_report(days_of: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(hour, requests, p50, p95) over the days, by hour of the day."""
    rows = days_of.where(_within(as_of, days)).groupBy("hour").agg(F.sum("requests").alias("requests"), F.kll_merge_agg_double("times").alias("times"))
    at = lambda q: F.kll_sketch_get_quantile_double("times", F.lit(q))
    return rows.select("hour", "requests", at(0.5).alias("p50"), at(0.95).alias("p95"))
