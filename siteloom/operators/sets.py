"""Sitemaps, hreflang sets and robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u
from ..storage import Rounds, materialize
from .findings import findings
from .pages import TEXT, _in_order, has_noindex, tagged, within

MAX_URLS, MAX_BYTES = 50_000, 50 * 1024 * 1024
# Names of hosts that are not for the public, and codes taken for others.
STAGING = r"\bstaging\b|\bstage\b|\bdev\b|\btest\b|\bpreview\b|\.local\b"
CONFUSED = {"uk": "gb", "cn": "zh", "jp": "ja", "kr": "ko", "gr": "el", "cz": "cs"}
HREFLANG = r"^(x-default|[a-z]{2}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?)$"
_DAY, _FULL = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def sitemap_limits(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Findings on sitemaps with too many entries, or files (sitemap, bytes) too large."""
    rows = sizes.join(entries.groupBy("sitemap").agg(F.count("*").alias("urls")), "sitemap", "left").fillna(0, ["urls"])
    return findings(
        rows,
        [("too_many_urls", "error", F.col("urls") > MAX_URLS, F.col("urls")), ("too_large", "error", F.col("bytes") > MAX_BYTES, F.col("bytes"))],
        "sitemap",
    )


def lastmod_valid(c: Column) -> Column:
    return c.rlike(_DAY) | c.rlike(_FULL)


def lastmod_checks(entries: DataFrame) -> DataFrame:
    """(sitemap, rule, n): entries with a malformed date, and sitemaps whose ten or more
    dates lie within an hour."""
    bad = entries.where(
        (F.col("lastmod") != "") & ~lastmod_valid(F.col("lastmod"))
    ).groupBy("sitemap").agg(F.count("*").alias("n")).select("sitemap", F.lit("lastmod_format").alias("rule"), "n")
    stamps = entries.where(lastmod_valid(F.col("lastmod"))).select("sitemap", F.unix_timestamp(F.col("lastmod").try_cast("timestamp")).alias("t"))
    same = stamps.groupBy("sitemap").agg(F.count("t").alias("n"), (F.max("t") - F.min("t")).alias("span")).where("n >= 10 and span < 3600")
    return bad.union(same.select("sitemap", F.lit("lastmod_all_alike"), "n"))


def staging_leaks(entries: DataFrame) -> DataFrame:
    return entries.where(u.url_parts(F.col("loc"))["host"].rlike(STAGING)).select("sitemap", "loc")


def sitemap_entry_audit(entries: DataFrame, fetches: DataFrame, heads: DataFrame, rules: DataFrame | None = None, agent: str = "googlebot") -> DataFrame:
    """Findings (loc, severity, rule, detail) of entries by their stored fetch and head."""
    rows = entries.select("loc").join(
        fetches.select(F.col("url").alias("loc"), "status", "hops", "x_robots_tag"), "loc", "left",
    ).join(heads.select(F.col("url").alias("loc"), "canonical", "robots"), "loc", "left")
    c = F.col
    out = findings(
        rows,
        [
            ("not_fetched", "notice", c("status").isNull(), None), ("redirect_chain", "warning", c("hops") > 0, c("hops")),
            ("http_status", "error", c("status") != 200, c("status")), ("noindex_header", "error", has_noindex(c("x_robots_tag")), None),
            ("noindex_meta", "error", has_noindex(c("robots")), None),
            ("canonical_mismatch", "warning", (c("canonical") != "") & (u.normalize_url_slash(c("canonical")) != u.normalize_url_slash(c("loc"))), c("canonical")),
        ],
        "loc",
    )
    if rules is not None:
        blocked = robots_allowed(entries.select(F.col("loc").alias("url"), F.lit(agent).alias("user_agent")).distinct(), rules).where("not allowed")
        out = out.union(blocked.select(F.col("url").alias("loc"), F.lit("error"), F.lit("robots_disallow"), "user_agent"))
    return out


def freshness_rules(rows: DataFrame) -> DataFrame:
    """Findings (url, severity, rule, detail) of what was seen of URLs (n_lastmod, n_content_hash)
    beside what was known (lastmod, content_hash; null: nothing). A date moved if it is later
    than the known one, both being valid, or if none was known."""
    c = F.col
    now, old = F.coalesce("n_lastmod", F.lit("")), F.coalesce("lastmod", F.lit(""))
    both = c("n_content_hash").isNotNull() & c("content_hash").isNotNull()
    later = lastmod_valid(now) & lastmod_valid(old) & (now.try_cast("timestamp") > old.try_cast("timestamp"))
    moved = F.coalesce(F.when((now != "") & (old != ""), later).otherwise((now != "") & (old == "")), F.lit(False))
    return findings(
        rows,
        [
            ("overactive_lastmod", "warning", both & moved & (c("n_content_hash") == c("content_hash")), now),
            ("stale_lastmod", "warning", both & ~moved & (c("n_content_hash") != c("content_hash")), now),
            ("lastmod_missing", "notice", now == "", None), ("lastmod_format", "error", (now != "") & ~lastmod_valid(now), now),
        ],
    )


def freshness(current: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, new state) of url, lastmod, content_hash, last_seen: a date that moved
    without the content, content that moved without the date, missing or malformed
    dates. Rows not seen now stay; a failed fetch keeps the last hash."""
    now = current.select("url", *(F.col(c).alias(f"n_{c}") for c in ("lastmod", "content_hash", "last_seen")))
    rows = now.join(prior, "url", "full")
    c = F.col
    found = freshness_rules(rows.where("n_last_seen is not null"))
    seen = c("n_last_seen").isNotNull()
    state = rows.select(
        "url", F.when(seen, c("n_lastmod")).otherwise(c("lastmod")).alias("lastmod"),
        F.coalesce("n_content_hash", "content_hash").alias("content_hash"), F.coalesce("n_last_seen", "last_seen").alias("last_seen"),
    )
    return found, state


def content_hash(elements: DataFrame, drop: tuple = ("script", "style", "noscript", "nav", "header", "footer", "aside")) -> DataFrame:
    """(url, content_hash) of the text in main, else article, else the body, in document order."""
    rows = within(elements, dropped=tagged(*drop), m=tagged("main"), a=tagged("article"))
    rows = rows.where((F.col("tag") == TEXT) & ~F.col("dropped") & ~F.col("in_head")).select("url", "seq", "text", "m", "a")
    best = rows.groupBy("url").agg(F.max("m").alias("has_m"), F.max("a").alias("has_a"))
    kept = rows.join(best, "url").where("if(has_m, m, if(has_a, a, true))")
    return kept.groupBy("url").agg(F.sha2(_in_order().cast("binary"), 256).alias("content_hash"))


def hreflang_bidirectional(links: DataFrame) -> DataFrame:
    """Findings (url, rule, lang, href): targets that don't link back, or have no entry."""
    rows = links.where("lang <> 'x-default' and url <> href").select("url", "lang", "href")
    back = links.select(F.col("url").alias("href"), F.col("href").alias("url")).distinct().withColumn("back", F.lit(True))
    sources = links.select(F.col("url").alias("href")).distinct().withColumn("listed", F.lit(True))
    out = rows.join(sources, "href", "left").join(back, ["url", "href"], "left").where("back is null")
    return out.select("url", F.when(F.col("listed").isNull(), "missing_target_entry").otherwise("missing_return_link").alias("rule"), "lang", "href")


def hreflang_codes(links: DataFrame) -> DataFrame:
    """Findings (url, rule, lang): no link to itself, malformed codes, codes of countries
    taken for languages."""
    selfless = links.groupBy("url").agg(F.max((F.col("url") == F.col("href")).cast("int")).alias("own")).where("own = 0").select(
        "url", F.lit("missing_self").alias("rule"), F.lit("").alias("lang"),
    )
    bad = links.where(~F.col("lang").rlike(HREFLANG)).select("url", F.lit("invalid_code").alias("rule"), "lang")
    confused = links.where(F.substring_index("lang", "-", 1).isin(*CONFUSED)).select("url", F.lit("confused_code").alias("rule"), "lang")
    return selfless.union(bad).union(confused)


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of edges (a, b): each node takes the least label near it, and that
    node's own label, until nothing changes. A hub is one key of a partial aggregation."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both, kept = materialize(both.distinct(), "pairs"), Rounds("labels")
    labels = kept.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("old"))
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("component").alias("far")), "next", "left")
        new = kept.write(jump.select("node", F.least("next", F.coalesce("far", "next")).alias("component"), "old"))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def hreflang_clusters(links: DataFrame, require_default: bool = True) -> DataFrame:
    """(cluster, pages, has_default, ok) of pages that alternates connect."""
    nodes = connected_components(links.select(F.col("url").alias("a"), F.col("href").alias("b")))
    default = links.groupBy("url").agg(F.max((F.col("lang") == "x-default").cast("int")).alias("d"))
    out = nodes.join(default, nodes.node == default.url, "left").groupBy(F.col("component").alias("cluster")).agg(
        F.count("*").alias("pages"), (F.coalesce(F.max("d"), F.lit(0)) == 1).alias("has_default"),
    )
    return out.where("pages > 1").withColumn("ok", F.col("has_default") | F.lit(not require_default))


def hreflang_status(links: DataFrame, fetches: DataFrame) -> DataFrame:
    """(href, rule) of alternates that redirect, don't answer 200, or were not fetched."""
    rows = links.select("href").distinct().join(fetches.select(F.col("url").alias("href"), "status", "final_url"), "href", "left")
    rule = F.when(
        F.col("status").isNull() | (F.col("status") == 0), "url_fetch_failed",
    ).when(F.col("status") != 200, "url_non_200").when(F.col("final_url") != F.col("href"), "url_redirects")
    return rows.select("href", rule.alias("rule")).where("rule is not null")


def robots_lines(docs: DataFrame) -> DataFrame:
    """(host, line, key, value, group_id) of robots files (host, body): user-agent, allow,
    disallow and crawl-delay lines. A mark at the start is stripped. User-agent lines in a row
    open one group; a blank line, a comment of its own or any other of these keys ends the row."""
    lines = docs.select("host", F.posexplode(F.split(F.regexp_replace("body", "^\ufeff", ""), r"\r?\n")).alias("at", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    key = F.when(clean == "", "").otherwise(F.lower(F.trim(F.substring_index(clean, ":", 1))))
    rows = lines.select("host", (F.col("at") + 1).alias("line"), key.alias("key"), F.trim(F.regexp_replace(clean, r"^[^:]*:", "")).alias("value"), clean.alias("clean"))
    rows = rows.where("key = '' or (contains(clean, ':') and key in ('user-agent', 'allow', 'disallow', 'crawl-delay'))").drop("clean")
    w = Window.partitionBy("host").orderBy("line")  # the lines of one file
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    return rows.withColumn("opens", opens.cast("int")).withColumn("group_id", F.sum("opens").over(w).cast("int") - 1).where("key <> '' and group_id >= 0").drop("opens")


def robots_rules(docs: DataFrame) -> DataFrame:
    """(host, group_id, agent, directive, path, line) of robots files (host, body). A group
    without allow and disallow lines is one row with an empty path for each agent: it is the
    agent's own, and lets everything pass."""
    lines = materialize(robots_lines(docs), "robots")
    agents = lines.where("key = 'user-agent'").groupBy("host", "group_id", F.lower("value").alias("agent")).agg(F.min("line").alias("first"))
    paths = lines.where("key in ('allow', 'disallow')").select("host", "group_id", F.col("key").alias("directive"), F.col("value").alias("path"), "line")
    rows = agents.join(paths, ["host", "group_id"], "left")
    return rows.select(
        "host", "group_id", "agent", F.coalesce("directive", F.lit("")).alias("directive"), F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("line", "first").alias("line"),
    )


def _matches(target: Column, parts: Column, ends: Column) -> Column:
    """Whether `parts`, the texts between the wildcards of a robots path behind its literal
    head, follow each other in `target` from character `at` on, the last one at the end if `ends`.
    Each is taken where it first stands, so a path is passed over once and nothing is tried again."""
    last = F.coalesce(F.element_at(parts, -1), F.lit(""))
    free = F.when(ends & (F.size(parts) > 0), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    def step(at: Column, part: Column) -> Column:
        found = F.position(part, target, at)
        return F.when((at == 0) | (part == ""), at).when(found == 0, F.lit(0)).otherwise(found + F.length(part))

    reached = F.aggregate(free, F.col("at"), step)
    closed = F.when(F.size(parts) == 0, F.col("at") == F.length(target) + 1).otherwise(
        F.endswith(target, last) & (F.length(target) - F.length(last) + 1 >= reached)
    )
    return (reached > 0) & (~ends | closed)


def robots_index(rules: DataFrame) -> DataFrame:
    """Rules (host, agent, directive, size, head, parts, ends): the literal head of each path, up to
    its first wildcard, the texts between the wildcards, and whether it ends with $. A path
    with text behind its $ matches nothing and is left out."""
    path = F.col("path")
    body = F.regexp_extract(path, r"^([^$]*)", 1)
    texts = F.split(body, r"\*")
    return rules.where("path <> '' and directive in ('allow', 'disallow')").where(~path.rlike(r"\$.*[^*$]")).select(
        "host", "agent", "directive", F.length(F.regexp_replace("path", "[*$]", "")).alias("size"), texts[0].alias("head"),
        F.slice(texts, F.lit(2), F.size(texts)).alias("parts"), path.contains("$").alias("ends"),
    ).distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, user_agent) with allowed. The longest agent token that the user agent
    holds decides, else *; groups of the same token are one. Of the rules that match, the
    one with most characters besides * and $ wins, and allow on a tie; no rule: allowed. Empty
    paths say nothing."""
    parts = u.url_parts(F.col("url"))
    rows = urls.distinct().withColumn("parts", parts).withColumn("host", F.col("parts.host")).withColumn(
        "target",
        F.concat(
            F.when(F.col("parts.path") == "", "/").otherwise(F.col("parts.path")),
            F.when(F.col("parts.query") != "", F.concat(F.lit("?"), "parts.query")).otherwise(""),
        ),
    )
    tokens = rules.where("agent <> ''").select("host", "agent").distinct()
    fit = rows.select("host", "user_agent").distinct().join(tokens, "host").where((F.col("agent") == "*") | F.lower("user_agent").contains(F.col("agent")))
    chosen = fit.groupBy("host", "user_agent").agg(F.max_by("agent", F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))).alias("agent"))
    mine = rows.select("url", "user_agent", "host", "target").join(chosen, ["host", "user_agent"], "left")
    # A path meets the rules of its agent by those of its prefixes that are as long as some rule's head.
    index = materialize(robots_index(rules), "robots")
    lengths = index.groupBy("host", "agent").agg(F.collect_set(F.length("head")).alias("lengths"))  # of one file's paths
    asked = mine.join(lengths, ["host", "agent"]).select("url", "user_agent", "host", "agent", "target", F.explode("lengths").alias("n")).where(F.length("target") >= F.col("n"))
    asked = asked.select("url", "user_agent", "host", "agent", "target", F.left("target", "n").alias("head"))
    met = asked.join(index, ["host", "agent", "head"]).withColumn("at", F.length("head") + 1)
    hits = met.where(_matches(F.col("target"), F.col("parts"), F.col("ends"))).groupBy("url", "user_agent").agg(
        F.max(F.struct("size", F.when(F.col("directive") == "allow", 1).otherwise(0).alias("ok"))).alias("best")
    )
    return mine.join(hits, ["url", "user_agent"], "left").select("url", "user_agent", (F.coalesce("best.ok", F.lit(1)) == 1).alias("allowed"))


# Paths that hold what a page is rendered with.
ASSET_PATHS = r"\.css\$?$|\.js\$?$|^/(static|assets|_next|_nuxt|build)/?$"


def robots_lint(docs: DataFrame) -> DataFrame:
    """Findings (host, severity, rule, detail) on robots files (host, body). A rule is found
    once for its group, whatever agents the group names."""
    first = findings(docs, [("bom", "warning", F.col("body").startswith("\ufeff"), None)], "host")
    lines = materialize(robots_lines(docs), "robots")
    google = F.col("value").rlike("(?i)googlebot")
    groups = lines.where("key = 'user-agent'").groupBy("host", "group_id").agg(F.max(F.col("value") == "*").alias("all"), F.max(google).alias("google"))
    rules = lines.where("key <> 'user-agent'").join(groups, ["host", "group_id"])
    c = F.col
    no = c("key") == "disallow"
    found = findings(rules, [
        ("catch_all_disallow", "error", c("all") & no & (c("value") == "/"), c("line")),
        ("crawl_delay_for_googlebot", "warning", c("google") & (c("key") == "crawl-delay"), c("value")),
        ("asset_blocked", "warning", (c("all") | c("google")) & no & c("value").rlike(ASSET_PATHS), c("value")),
    ], "host")
    maps = docs.select("host", F.explode(F.split("body", r"\r?\n")).alias("l")).select(
        "host", F.trim(F.regexp_extract(F.regexp_replace("l", "#.*$", ""), r"(?i)^\ufeff?\s*sitemap\s*:\s*(.*)$", 1)).alias("map"),
    )
    more = findings(maps, [("sitemap_not_absolute", "error", (c("map") != "") & ~c("map").rlike("^https?://"), c("map"))], "host")
    return first.union(found).union(more)


def robots_assertions(tests: DataFrame, rules: DataFrame) -> DataFrame:
    """tests (url, user_agent, expected) that come out otherwise."""
    return tests.join(
        robots_allowed(tests.select("url", "user_agent"), rules), ["url", "user_agent"],
    ).where("allowed <> expected").select("url", "user_agent", "expected", "allowed")


def robots_deploy_check(fetches: DataFrame, expected: DataFrame, tests: DataFrame | None = None, alternates: DataFrame | None = None, agent: str = "Googlebot") -> DataFrame:
    """Findings (host, severity, rule, detail) on deployed robots files: fetches (host, status,
    content_type, hops, body) against expected (host, body).

    A file that is answered is also asked: the search bot `agent` must reach the site's root, and
    tests (url, user_agent, expected) must come out on it as expected. alternates (host,
    canonical, status, location) are other hosts of a site: they may serve the file or send on
    to that of the canonical host (its URL), and nothing else.
    """
    c = F.col
    rows = fetches.join(expected.select("host", c("body").alias("wanted")), "host", "left")
    digest = lambda x: F.sha2(c(x).cast("binary"), 256)
    ok, status = c("status") == 200, F.coalesce("status", F.lit(0))
    found = findings(
        rows,
        [
            ("reachability", "error", status == 0, None), ("canonical_redirect", "error", status.between(300, 399), c("status")),
            ("status", "error", (status != 0) & ~ok & ~status.between(300, 399), c("status")),
            ("content_type", "warning", ok & ~F.lower(F.coalesce("content_type", F.lit(""))).contains("text/plain"), c("content_type")),
            ("redirected", "warning", ok & (c("hops") > 0), c("hops")),
            ("body_differs", "error", ok & c("wanted").isNotNull() & (digest("body") != digest("wanted")), digest("body")),
            ("unexpected_host", "notice", c("wanted").isNull(), None),
        ],
        "host",
    )
    live = fetches.where(ok).select("host", "body")
    rules = materialize(robots_rules(live), "robots")
    root = live.select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), F.lit(agent).alias("user_agent"))
    shut = robots_allowed(root, rules).where("not allowed").select("url")
    found = found.unionByName(shut.select(u.url_parts(c("url"))["host"].alias("host"), F.lit("error").alias("severity"), F.lit("search_bot_blocked").alias("rule"), c("url").alias("detail")))
    if tests is not None:
        asked = tests.withColumn("host", u.url_parts(c("url"))["host"]).join(live.select("host"), "host").select("url", "user_agent", "expected")
        failed = robots_assertions(asked, rules)
        detail = F.concat_ws(" ", "user_agent", "url", F.when(c("expected"), "must pass").otherwise("must not pass"))
        found = found.unionByName(failed.select(u.url_parts(c("url"))["host"].alias("host"), F.lit("error").alias("severity"), F.lit("assertion_failed").alias("rule"), detail.alias("detail")))
    if alternates is not None:
        sent, to = status.between(300, 399), F.coalesce("location", F.lit(""))
        found = found.unionByName(findings(alternates, [
            ("alt_host_fetch", "warning", status == 0, None),
            ("alt_host_redirect", "warning", sent & (to != c("canonical")) & ~to.endswith("/robots.txt"), to),
            ("alt_host_status", "error", (status != 0) & ~ok & ~sent, c("status")),
        ], "host"))
    return found
