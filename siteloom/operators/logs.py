"""Access logs: formats, crawler verification, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import anonymize_ip, ip_bits
from ..storage import materialize

FIELDS = ["timestamp", "remote_addr", "method", "host", "uri", "path", "status", "bytes_sent", "referer", "user_agent", "request_time"]

# Crawler names, purposes and the user-agent tokens they claim, in order.
REGISTRY = [
    ("googlebot", "search", ["Googlebot"]),
    ("special-crawlers", "search", ["AdsBot", "Storebot", "Mediapartners", "Googlebot-Image", "Googlebot-News", "Googlebot-Video"]),
    ("user-triggered-fetchers", "search", ["Google-Site-Verification", "FeedFetcher-Google", "Google-Read-Aloud", "APIs-Google"]),
    ("bingbot", "search", ["bingbot", "BingPreview"]),
    ("gptbot", "ai_training", ["GPTBot"]),
    ("oai_searchbot", "ai_search", ["OAI-SearchBot"]),
    ("chatgpt_user", "ai_search", ["ChatGPT-User"]),
    ("claudebot", "ai_training", ["ClaudeBot", "Claude-User", "anthropic-ai"]),
    ("applebot", "search", ["Applebot"]),
]
# Tokens of genuine search fetchers; strict mode takes the first alone.
SEARCH_TOKENS = [
    "Googlebot", "Googlebot-Image", "Googlebot-News", "Googlebot-Video", "Storebot-Google", "AdsBot-Google", "AdsBot-Google-Mobile",
    "Mediapartners-Google", "APIs-Google", "FeedFetcher-Google", "Google-Read-Aloud", "GoogleOther",
]

_COMBINED = r'^(\S+) \S+ \S+ \[?([^\]]+?)\]? "([A-Z]+) (\S+)(?: [^"]*)?" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"(?: "?([\d.]+)"?)?\s*$'


def split_path(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^([^?]+)", 1)


def with_path(logs: DataFrame) -> DataFrame:
    return logs.withColumn("path", split_path(F.col("uri")))


def detect_log_format(lines: DataFrame) -> DataFrame:
    """`lines` with log_format of each line, so that mixed files work."""
    v, first = F.ltrim(F.col("value")), F.substring_index(F.ltrim(F.col("value")), " ", 1)
    key = lambda *names: F.greatest(*[v.contains(f'"{n}"').cast("int") for n in names]) == 1
    kind = F.when(
        v.startswith("{") & key("EdgeStartTimestamp", "ClientRequestURI", "ClientIP"), "cloudflare",
    ).when(v.startswith("{"), "nginx_json").when(first.isin("http", "https", "h2", "grpcs", "ws", "wss"), "alb").otherwise("combined")
    return lines.withColumn("log_format", kind)


def _moment(c: Column) -> Column:
    """NCSA, ISO or epoch time (seconds, or nanoseconds above 1e12)."""
    epoch = c.try_cast("decimal(24,3)")
    micros = F.when(epoch > 1e12, F.floor(epoch / 1000)).otherwise(F.floor(epoch * 1_000_000)).cast("long")
    return F.coalesce(F.try_to_timestamp(c, F.lit("dd/MMM/yyyy:HH:mm:ss Z")), F.timestamp_micros(micros), c.try_cast("timestamp"))


def _shape(rows: DataFrame, **cols: Column) -> DataFrame:
    uri = cols["uri"]
    row = {
        "timestamp": _moment(cols["timestamp"]),
        "remote_addr": cols["remote_addr"],
        "method": cols["method"],
        "host": cols.get("host", F.lit("")),
        "uri": uri,
        "path": split_path(uri),
        "status": cols["status"].try_cast("int"),
        "bytes_sent": F.coalesce(cols["bytes_sent"].try_cast("long"), F.lit(0).cast("long")),
        "referer": cols.get("referer", F.lit("")),
        "user_agent": cols["user_agent"],
        "request_time": cols.get("request_time", F.lit(None)).try_cast("double"),
    }
    fine = row["timestamp"].isNotNull() & (F.coalesce(uri, F.lit("")) != "") & row["status"].isNotNull()
    return rows.withColumn("record", F.when(fine, F.struct(*[c.alias(k) for k, c in row.items()])))


def parse_combined(lines: DataFrame) -> DataFrame:
    """`lines` with record (null if the line is malformed): the NCSA combined form,
    time in NCSA or ISO form, with a request time at the end if there is one."""
    g = lambda i: F.regexp_extract("value", _COMBINED, i)
    return _shape(
        lines, timestamp=g(2), remote_addr=g(1), method=g(3), uri=g(4), status=g(5), bytes_sent=g(6), referer=F.when(g(7) == "-", "").otherwise(g(7)),
        user_agent=g(8), request_time=F.nullif(g(9), F.lit("")),
    )


def _json(lines: DataFrame, names: list[str]) -> dict[str, Column]:
    return {n: F.get_json_object("value", f"$.{n}") for n in names}


def parse_nginx_json(lines: DataFrame) -> DataFrame:
    j = _json(
        lines,
        [
            "timestamp", "time_iso8601", "remote_addr", "method", "request_method", "host", "uri", "request_uri", "status", "bytes_sent",
            "body_bytes_sent", "referer", "http_referer", "user_agent", "http_user_agent", "request_time",
        ],
    )
    either = lambda *names: F.coalesce(*[j[n] for n in names], F.lit(""))
    return _shape(
        lines, timestamp=either("timestamp", "time_iso8601"), remote_addr=either("remote_addr"), method=either("method", "request_method"),
        host=either("host"), uri=either("uri", "request_uri"), status=either("status"), bytes_sent=either("bytes_sent", "body_bytes_sent"),
        referer=either("referer", "http_referer"), user_agent=either("user_agent", "http_user_agent"), request_time=j["request_time"],
    )


def parse_cloudflare(lines: DataFrame) -> DataFrame:
    j = _json(
        lines,
        [
            "EdgeStartTimestamp", "ClientIP", "ClientRequestMethod", "ClientRequestHost", "ClientRequestURI", "EdgeResponseStatus",
            "EdgeResponseBytes", "ClientRequestReferer", "ClientRequestUserAgent", "OriginResponseDurationMs",
        ],
    )
    text = lambda n: F.coalesce(j[n], F.lit(""))
    return _shape(
        lines, timestamp=text("EdgeStartTimestamp"), remote_addr=text("ClientIP"), method=text("ClientRequestMethod"), host=text("ClientRequestHost"),
        uri=text("ClientRequestURI"), status=text("EdgeResponseStatus"), bytes_sent=text("EdgeResponseBytes"), referer=text("ClientRequestReferer"),
        user_agent=text("ClientRequestUserAgent"), request_time=j["OriginResponseDurationMs"].try_cast("double") / 1000,
    )


def parse_alb(lines: DataFrame) -> DataFrame:
    """Load-balancer lines: tokens are quoted or free of blanks. Client 3, target time 6,
    status 8, bytes 11, request 12, agent 13 (from 0)."""
    tokens = F.regexp_extract_all("value", F.lit(r'"([^"]*)"|(\S+)'), F.lit(0))
    t = lambda i: F.regexp_replace(F.coalesce(F.get(tokens, F.lit(i)), F.lit("")), '^"|"$', "")
    url = F.get(F.split(t(12), " "), F.lit(1))
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-z]+://[^/]+", "")
    return _shape(
        lines, timestamp=t(1), remote_addr=F.regexp_replace(t(3), r":\d+$", ""), method=F.substring_index(t(12), " ", 1),
        host=F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://([^/:]+)", 1), uri=F.when((uri == "") & (url != ""), "/").otherwise(uri),
        status=t(8), bytes_sent=t(11), user_agent=t(13), request_time=F.when(t(6) != "-1", t(6)),
    )


PARSERS = {"combined": parse_combined, "nginx_json": parse_nginx_json, "cloudflare": parse_cloudflare, "alb": parse_alb}


def parse_logs(lines: DataFrame, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines). Blank lines are neither. Without `fmt`, each line is
    parsed in its own format."""
    lines = lines.where(F.trim("value") != "")
    lines = lines.withColumn("log_format", F.lit(fmt)) if fmt else detect_log_format(lines)
    parsed = None
    for kind, parse in PARSERS.items():
        if fmt in (None, kind):
            part = parse(lines.where(F.col("log_format") == kind))
            parsed = part if parsed is None else parsed.unionByName(part)
    return parsed.where("record is not null").select("record.*"), parsed.where("record is null").drop("record")


def parse_by_index(lines: DataFrame, status: int = 9, url: int = 7, size: int = 10, rtime: int | None = None) -> DataFrame:
    """url, status, bytes_sent, request_time by the quoted request, or else by the
    number of the blank-separated field (from 1)."""
    f = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(f, F.lit(i - 1))
    quoted = F.regexp_extract("value", r'"(?:GET|POST|HEAD|PUT|DELETE|OPTIONS|PATCH) (\S+)[^"]*" (\d{3}) (\d+|-)', 1)
    q = lambda i: F.regexp_extract("value", r'"(?:GET|POST|HEAD|PUT|DELETE|OPTIONS|PATCH) (\S+)[^"]*" (\d{3}) (\d+|-)', i)
    pick = lambda a, b: F.when(quoted != "", a).otherwise(b)
    out = lines.select(
        pick(q(1), at(url)).alias("url"), pick(q(2), at(status)).try_cast("int").alias("status"),
        F.coalesce(pick(q(3), at(size)).try_cast("long"), F.lit(0)).alias("bytes_sent"),
        (at(rtime) if rtime else F.lit(None)).try_cast("double").alias("request_time"),
    )
    return out.where("url is not null and status is not null")


def verify_crawler(logs: DataFrame, ranges: DataFrame, out: str = "verified_crawler") -> DataFrame:
    """`logs` with the crawler whose range holds remote_addr ('' if none); where ranges
    overlap, the lowest ord wins. Malformed ranges match nothing.

    Where few prefix lengths occur, there is one lookup of an address prefix for each, which
    Spark answers by broadcasts: the logs are not shuffled. Of more lengths than `FEW_LENGTHS`, or more
    ranges than `FEW_RANGES`, the distinct addresses are looked up instead, in one join
    whatever the number of lengths, and joined to the logs once. Streams keep to the former.
    """
    cut = ranges.select("crawler", "ord", F.split("cidr", "/").alias("p")).select(
        "crawler", "ord", ip_bits(F.col("p")[0]).alias("bits"), F.get("p", F.lit(1)).try_cast("int").alias("plen"),
    )
    cut = cut.where("bits is not null and plen between 0 and length(bits)").select(
        F.length("bits").alias("size"), "plen", F.expr("left(bits, plen)").alias("prefix"), F.struct("ord", "crawler").alias("hit"),
    )
    cut = materialize(cut.groupBy("size", "plen", "prefix").agg(F.min("hit").alias("hit")), "ranges")
    lengths = sorted((r["size"], r["plen"]) for r in cut.select("size", "plen").distinct().collect())  # 161 at most
    if not logs.isStreaming and (len(lengths) > FEW_LENGTHS or cut.count() > FEW_RANGES):
        found = lookup(logs.select("remote_addr").distinct(), cut, lengths).select(F.col("remote_addr").alias("_addr"), F.col("hit.crawler").alias(out))
        return logs.drop(out).join(found, F.col("remote_addr") == F.col("_addr"), "left").drop("_addr").withColumn(out, F.coalesce(out, F.lit("")))
    rows = logs.withColumn("_bits", ip_bits(F.col("remote_addr")))
    hits = []
    for size, plen in lengths:
        name = f"_hit_{size}_{plen}"
        part = cut.where((F.col("size") == size) & (F.col("plen") == plen)).select(F.col("prefix").alias("_prefix"), F.col("hit").alias(name))
        rows = rows.join(part, F.when(F.length("_bits") == size, F.expr(f"left(_bits, {plen})")) == F.col("_prefix"), "left").drop("_prefix")
        hits.append(F.col(name))
    best = F.array_min(F.array(*hits))["crawler"] if hits else F.lit(None)
    return rows.withColumn(out, F.coalesce(best, F.lit(""))).drop("_bits", *[f"_hit_{s}_{p}" for s, p in lengths])


#: So many ranges are broadcast without a second thought, some 10 MB; so many joins are one plan.
FEW_RANGES, FEW_LENGTHS = 100_000, 10


def lookup(addresses: DataFrame, cut: DataFrame, lengths: list[tuple[int, int]]) -> DataFrame:
    """(remote_addr, hit) of distinct addresses: one row for each prefix length, one join."""
    sizes = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(p).alias("plen")) for s, p in lengths])
    rows = addresses.withColumn("bits", ip_bits(F.col("remote_addr"))).where("bits is not null")
    rows = rows.select("remote_addr", "bits", F.explode(F.filter(sizes, lambda x: x["size"] == F.length("bits"))).alias("x"))
    rows = rows.select("remote_addr", F.col("x.size").alias("size"), F.col("x.plen").alias("plen"), F.expr("left(bits, x.plen)").alias("prefix"))
    return rows.join(cut, ["size", "plen", "prefix"]).groupBy("remote_addr").agg(F.min("hit").alias("hit"))


def ua_claim(logs: DataFrame, out: str = "claimed_crawler") -> DataFrame:
    """`logs` with the first crawler of the registry one of whose tokens the agent holds."""
    ua = F.lower(F.coalesce("user_agent", F.lit("")))
    claim = F.coalesce(*[F.when(ua.contains(t.lower()), name) for name, _, tokens in REGISTRY for t in tokens], F.lit(""))
    return logs.withColumn(out, claim)


def with_purpose(logs: DataFrame) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for name, purpose, _ in REGISTRY for x in (name, purpose)])
    return logs.withColumn("crawler_purpose", F.coalesce(F.try_element_at(pairs, F.col("verified_crawler")), F.lit("")))


def with_googlebot(logs: DataFrame) -> DataFrame:
    return logs.withColumn("verified_googlebot", F.col("verified_crawler").isin("googlebot", "special-crawlers"))


def enrich_logs(raw: DataFrame, ranges: DataFrame, anonymize: bool = True) -> DataFrame:
    """Records without the referer, with path, crawler, purpose and the search flag.
    The crawler is verified before the address is made anonymous."""
    rows = with_googlebot(with_purpose(verify_crawler(with_path(raw), ranges))).drop("referer")
    return rows.withColumn("remote_addr", anonymize_ip(F.col("remote_addr"))) if anonymize else rows


def enrichment_summary(enriched: DataFrame) -> DataFrame:
    """Requests, errors, distinct paths and share for each verified crawler ('' is none)."""
    every = Window.partitionBy()
    counts = enriched.groupBy("verified_crawler").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.countDistinct("path").alias("paths"),
    )
    return counts.withColumn("share", F.round(100.0 * F.col("requests") / F.sum("requests").over(every), 4).cast("double"))


def enrichment_totals(enriched: DataFrame) -> DataFrame:
    """One row: all requests, those of verified crawlers, and how many kinds of these there are."""
    real = F.col("verified_crawler") != ""
    return enriched.agg(
        F.count("*").alias("total_requests"), F.count_if(real).alias("verified_crawlers"),
        F.count_distinct(F.when(real, F.col("verified_crawler"))).alias("distinct_crawler_types"),
    )


def googlebot_verification(logs: DataFrame, ranges: DataFrame, strict: bool = False) -> DataFrame:
    """Requests by outcome of the two tests, address and agent."""
    tokens = SEARCH_TOKENS[:1] if strict else SEARCH_TOKENS
    ua = F.coalesce("user_agent", F.lit(""))
    named = F.greatest(*[ua.contains(t).cast("int") for t in tokens], F.lit(0)) == 1
    rows = verify_crawler(logs, ranges, "_c")
    inside = F.col("_c").isin("googlebot", "special-crawlers", "user-triggered-fetchers")
    kind = F.when(ip_bits(F.col("remote_addr")).isNull(), "unparseable").when(inside & named, "accepted").when(named, "rejected_ip").when(inside, "rejected_ua").otherwise("rejected_both")
    return rows.groupBy(kind.alias("outcome")).agg(F.count("*").alias("requests"))


def spoofed_agents(logs: DataFrame, ranges: DataFrame, k: int = 5) -> DataFrame:
    """The agents that most often claim to be a crawler from addresses that are none."""
    rows = ua_claim(verify_crawler(logs, ranges)).where("verified_crawler = '' and claimed_crawler <> ''")
    return rows.groupBy(F.left("user_agent", F.lit(120)).alias("user_agent")).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "user_agent").limit(k)


def crawler_verification_report(logs: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each crawler, requests verified by address, and requests that only claim it."""
    rows = ua_claim(verify_crawler(logs, ranges))
    name = F.when(F.col("verified_crawler") != "", F.col("verified_crawler")).otherwise(F.col("claimed_crawler"))
    return rows.groupBy(name.alias("crawler")).agg(
        F.count_if(F.col("verified_crawler") != "").alias("verified"),
        F.count_if(F.expr("verified_crawler = '' and claimed_crawler <> ''")).alias("spoofed"),
    ).where("crawler <> ''")


def keep_verified(logs: DataFrame, ranges: DataFrame) -> DataFrame:
    return verify_crawler(logs, ranges).where("verified_crawler <> ''")


def dns_confirm(logs: DataFrame, ptr: DataFrame, fwd: DataFrame) -> DataFrame:
    """Addresses with outcome: their name must end in a known domain and resolve back to
    them. A name that is null was not found; an address missing from `ptr`, or a name
    missing from `fwd`, was not looked up: indeterminate."""
    rows = logs.select(F.col("remote_addr").alias("ip")).distinct().join(ptr.withColumn("looked", F.lit(True)), "ip", "left").join(fwd, "host", "left")
    host = F.rtrim(F.lower("host"), F.lit("."))
    outcome = F.when(F.col("looked").isNull(), "indeterminate").when(F.col("host").isNull(), "no_ptr").when(~host.rlike(r"\.(googlebot|google)\.com$"), "wrong_domain").when(F.col("addrs").isNull(), "indeterminate").when(F.array_contains("addrs", F.col("ip")), "confirmed").otherwise("forward_mismatch")
    return rows.select("ip", outcome.alias("outcome"))


def ip_membership(logs: DataFrame, ranges: DataFrame, lists_loaded: bool = True) -> DataFrame:
    """Addresses with match, miss, or indeterminate (no address, or lists missing)."""
    rows = verify_crawler(logs.select("remote_addr").distinct(), ranges, "_c")
    kind = F.when(ip_bits(F.col("remote_addr")).isNull(), "indeterminate").when(F.col("_c") != "", "match").when(F.lit(not lists_loaded), "indeterminate").otherwise("miss")
    return rows.select("remote_addr", kind.alias("membership"))


def negotiate(accept: Column, supported: list[str], default: str = "en") -> Column:
    """The supported language that the Accept-Language header likes best; ties by place."""
    item = lambda x, i: F.struct(
        (-F.coalesce(F.nullif(F.regexp_extract(x, r"q=([0-9.]+)", 1), F.lit("")).try_cast("double"), F.lit(1.0))).alias("q"), i.alias("at"),
        F.lower(F.regexp_extract(x, r"^\s*([A-Za-z]+)", 1)).alias("lang"),
    )
    liked = F.filter(F.array_sort(F.transform(F.split(F.coalesce(accept, F.lit("")), ","), item)), lambda s: s["lang"].isin(*supported) & (s["q"] < 0))
    return F.coalesce(F.get(liked, F.lit(0))["lang"], F.lit(default))


def locale_demand(logs: DataFrame, supported: list[str], default: str = "en") -> DataFrame:
    """Requests by the locale that they would be sent to; paths with a locale prefix and
    neutral ones (assets, api) are left out."""
    rows = logs.where(~F.col("path").rlike(rf"^/({'|'.join(supported)})(/|$)") & ~F.col("path").rlike(r"^/(api|static|assets)/|\.[a-z0-9]{2,5}$"))
    return rows.groupBy(negotiate(F.col("accept_language"), supported, default).alias("locale")).agg(F.count("*").alias("requests"))
