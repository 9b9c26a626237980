"""The link graph of a crawl: rank, depth, orphans, broken links.

Loops are bounded, each round ends in a table in the shared folder, and convergence is
read through one aggregate a round. Hubs are met by partial aggregation and by joins
that adaptive execution splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import Rounds, materialize


def build_graph(edges: DataFrame, ok_only: bool = False, drop_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices (url), links (src, dst, anchor)). Parallel links collapse, the greatest
    anchor staying; with ok_only, only 2xx targets count; a self-link makes a vertex."""
    rows = edges.where(F.col("target_status_code").between(200, 299)) if ok_only else edges
    vertices = rows.select(F.col("source_url").alias("url")).union(rows.select("target_url")).distinct()
    links = rows.where("source_url <> target_url") if drop_self else rows
    return vertices, links.groupBy(F.col("source_url").alias("src"), F.col("target_url").alias("dst")).agg(F.max("anchor").alias("anchor"))


def written_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices (url), links (src, dst) without self-links) of the 2xx links, written: what takes
    several looks at the graph makes the edges once."""
    links = materialize(build_graph(edges, ok_only=True)[1].select("src", "dst"), "links")
    vertices = materialize(links.select(F.col("src").alias("url")).union(links.select("dst")).distinct(), "vertices")
    return vertices, links.where("src <> dst")


def resolve_homepage(vertices: DataFrame, url: str) -> str | None:
    """The vertex that is `url`, with or without its last slash."""
    other = url[:-1] if url.endswith("/") else url + "/"
    found = {r["url"] for r in vertices.where(F.col("url").isin(url, other)).collect()}
    return url if url in found else other if other in found else None


#: Targets in one list of a page's links.
LISTED = 4096


def numbered_graph(vertices: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices (url, id, links), lists (src, targets)) with numbers instead of addresses, in ranges:
    each task of the vertices counts on from its own base. `links` is the number of links
    that go out of a vertex (null: none). Lists, which take a fraction of the room of single
    links, are those of all targets; a page of more than LISTED links has several. Both are written.
    Sources are joined last, so a page's links are together when they are counted and listed."""
    numbered = materialize(vertices.select("url").distinct().withColumn("id", F.monotonically_increasing_id()), "numbers")
    end = lambda c, name: numbered.select(F.col("url").alias(c), F.col("id").alias(name))
    pairs = materialize(links.select("src", "dst").join(end("dst", "b"), "dst").join(end("src", "a"), "src").select(F.col("a").alias("src"), F.col("b").alias("dst")), "pairs")
    out = materialize(pairs.groupBy("src").agg(F.count("*").alias("links")), "out")
    hubs = materialize(out.where(F.col("links") > LISTED).select("src", F.ceil(F.col("links") / LISTED).alias("lists")), "hubs")
    part = F.pmod(F.xxhash64("dst"), F.coalesce("lists", F.lit(1).cast("long")))
    lists = pairs.join(hubs, "src", "left").groupBy("src", part.alias("part")).agg(F.collect_list("dst").alias("targets")).select("src", "targets")
    return materialize(numbered.join(out.withColumnRenamed("src", "id"), "id", "left").select("url", "id", "links"), "vertices"), materialize(lists, "lists")


def pagerank(vertices: DataFrame, links: DataFrame, d: float = 0.85, tol: float = 1e-6, max_iter: int = 200, rounds: int | None = None) -> DataFrame:
    """(url, rank), summing to 1; what dangling vertices hold is spread evenly. Ends when
    ranks change by less than N * tol in all, or after `rounds`, if given; ranks that still
    change after `max_iter` rounds raise.

    Pages are numbers while ranks move.
    """
    numbered, lists = numbered_graph(vertices, links)
    return numbered.select("url", "id").join(numbered_ranks(numbered, lists, d, tol, max_iter, rounds), "id").select("url", "rank")


def numbered_ranks(numbered: DataFrame, lists: DataFrame, d: float = 0.85, tol: float = 1e-6, max_iter: int = 200, rounds: int | None = None) -> DataFrame:
    """(id, rank) of a numbered graph, as `pagerank`. A round is one job: the rank that dangling
    pages hold and the change in all are observed while the round's table is written. The lists
    are met by hashed ranks, not sorted in each round."""
    n = numbered.count()
    if not n:
        return numbered.select("id", F.lit(0.0).alias("rank"))
    kept = Rounds("ranks")
    ranks = numbered.select("id", "links", F.lit(1.0 / n).alias("rank"))

    def written(new: DataFrame, change: Column) -> tuple[DataFrame, float, float]:
        seen = Observation()
        total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        new = new.observe(seen, total(F.when(F.col("links").isNull(), F.col("rank"))).alias("lost"), total(change).alias("change"))
        return kept.write(new.select("id", "links", "rank")), seen.get["lost"], seen.get["change"]

    ranks, lost, _ = written(ranks, F.lit(0.0))
    for _ in range(rounds or max_iter):
        sent = ranks.where("links is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("links")).alias("share"))
        got = lists.join(sent.hint("shuffle_hash"), "src").select(F.explode("targets").alias("dst"), "share").groupBy("dst").agg(F.sum("share").alias("got"))
        new = ranks.withColumnRenamed("rank", "old").join(got, F.col("id") == F.col("dst"), "left")
        new = new.withColumn("rank", F.lit((1 - d) / n + d * lost / n) + d * F.coalesce("got", F.lit(0.0)))
        ranks, lost, change = written(new, F.abs(F.col("rank") - F.col("old")))
        if not rounds and change < n * tol:
            break
    else:
        if not rounds:
            raise RuntimeError(f"ranks still change after {max_iter} rounds")
    return ranks.select("id", "rank")


def click_depth(links: DataFrame, home: str, max_depth: int = 10_000, written: bool = False) -> DataFrame:
    """(url, depth) of all pages that links reach from the homepage. The links are written
    once, unless they are `written`, and each round writes its new pages alone: a page of depth n + 1 is a target of the
    last front that no front has. Pages beyond `max_depth` raise."""
    links = links.where("src <> dst").select("src", "dst")
    links = links if written else materialize(links, "links")
    # Of one row, which Spark knows: the size of local Python rows is unknown, so all links would be sorted to meet them.
    first = links.sparkSession.range(1).select(F.lit(home).cast("string").alias("url"), F.lit(0).alias("depth"))
    return _walk(first, lambda front: links.join(front, front["url"] == links["src"]).select(F.col("dst").alias("url")), max_depth)


def numbered_depth(numbered: DataFrame, lists: DataFrame, home: str, max_depth: int = 10_000) -> DataFrame:
    """(id, depth) of a numbered graph, as `click_depth`."""
    first = numbered.where(F.col("url") == home).select("id", F.lit(0).alias("depth"))
    return _walk(first, lambda front: lists.join(front, front["id"] == lists["src"]).select(F.explode("targets").alias("id")), max_depth)


def _walk(first: DataFrame, targets: Callable[[DataFrame], DataFrame], max_depth: int) -> DataFrame:
    """`first` (a key, depth) and all that is reached from it, `targets` giving those of a front."""
    key, fronts = first.columns[0], [first]
    for depth in range(1, max_depth + 1):
        seen = fronts[0].select(key)
        for f in fronts[1:]:
            seen = seen.union(f.select(key))
        step = targets(fronts[-1].select(key)).distinct().join(seen, key, "left_anti")
        front = materialize(step.withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        fronts.append(front)
        if len(fronts) > 50:  # a long chain: fewer tables to look through
            whole = fronts[0]
            for f in fronts[1:-1]:
                whole = whole.union(f)
            fronts = [materialize(whole, "seen"), fronts[-1]]
    else:
        raise RuntimeError(f"pages lie deeper than {max_depth}")
    out = fronts[0]
    for f in fronts[1:]:
        out = out.union(f)
    return out


def degrees(vertices: DataFrame, links: DataFrame) -> DataFrame:
    n = lambda c, name: links.groupBy(F.col(c).alias("url")).agg(F.count("*").alias(name))
    return vertices.join(n("dst", "in_degree"), "url", "left").join(n("src", "out_degree"), "url", "left").fillna(0, ["in_degree", "out_degree"])


def orphans(vertices: DataFrame, links: DataFrame, home: str, known: DataFrame | None = None) -> DataFrame:
    """Pages that no other page links to, but the homepage; and known ones not crawled."""
    out = vertices.join(links.where("src <> dst").select(F.col("dst").alias("url")), "url", "left_anti").where(F.col("url") != home)
    return out.union(known.select("url").join(vertices, "url", "left_anti")).distinct() if known is not None else out


def link_status_counts(edges: DataFrame) -> DataFrame:
    """Broken (400 and over, or no answer) and redirected links of each source."""
    s = F.col("target_status_code")
    return edges.groupBy(F.col("source_url").alias("url")).agg(
        F.count_if((s >= 400) | (s < 100)).alias("broken_links"), F.count_if(s.between(300, 399)).alias("redirect_links"),
    )


def link_report(edges: DataFrame, home: str, known: DataFrame | None = None, **rank) -> DataFrame:
    """Rank, depth, degrees, links and orphan mark of each page; known pages that were
    not crawled are added without rank and depth. Edges and graph are written once for all parts,
    and all of them but the links' states are made of the numbered graph."""
    edges = materialize(edges, "edges")
    vertices, links = written_graph(edges)
    numbered, lists = numbered_graph(vertices, links)
    into = lists.select(F.explode("targets").alias("id")).groupBy("id").agg(F.count("*").alias("in_degree"))
    crawled = numbered.withColumnRenamed("links", "out_degree").join(numbered_ranks(numbered, lists, **rank), "id")
    crawled = crawled.join(numbered_depth(numbered, lists, home), "id", "left").join(into, "id", "left")
    pages = vertices if known is None else vertices.union(known.select("url")).distinct()
    out = pages.join(crawled, "url", "left").join(link_status_counts(edges), "url", "left")
    url = F.col("url")
    orphan = url.isNotNull() & (F.col("id").isNull() | (F.col("in_degree").isNull() & (url != home)))
    depth = F.when(url == home, 0).otherwise(F.col("depth"))
    n = [F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree", "broken_links", "redirect_links")]
    return out.select("url", "rank", depth.alias("depth"), *n, orphan.alias("orphan"))


def depth_bucket(depth: Column) -> Column:
    return F.when(depth.isNull(), "unreachable").when(depth >= 5, "5+").otherwise(depth.cast("string"))


def depth_buckets(vertices: DataFrame, depths: DataFrame) -> DataFrame:
    return vertices.join(depths, "url", "left").groupBy(depth_bucket(F.col("depth")).alias("bucket")).agg(F.count("*").alias("pages"))


def depth_summary(depths: DataFrame, near: int = 3) -> DataFrame:
    return depths.agg(
        F.count("*").alias("reachable"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 3).alias("avg_depth"),
        F.round(100.0 * F.count_if(F.col("depth") <= near).cast("double") / F.count("*"), 2).alias("pct_near"),
    )


def unreachable(vertices: DataFrame, depths: DataFrame) -> DataFrame:
    return vertices.join(depths, "url", "left_anti")


def top_pages(metric: DataFrame, by: str, n: int = 20) -> DataFrame:
    return metric.orderBy(F.desc(by), "url").limit(n)


def sitemap_diff(sitemap: DataFrame, vertices: DataFrame) -> DataFrame:
    """(url, side): only in the sitemap, or only in the graph."""
    one = sitemap.select("url").distinct().join(vertices, "url", "left_anti").withColumn("side", F.lit("sitemap"))
    return one.union(vertices.join(sitemap.select("url"), "url", "left_anti").withColumn("side", F.lit("graph")))


def at_risk(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("url")
    for p in parts[1:]:
        out = out.union(p.select("url"))
    return out.distinct()


def graph_verdict(report: DataFrame) -> DataFrame:
    """One row: counts and a verdict of the link report, and whether the top rank is tied.
    Pages are counted by rank first, so that no task sees them all."""
    c = F.col
    by_rank = report.where("rank is not null").groupBy("rank").agg(
        F.count("*").alias("pages"), F.count_if(c("orphan")).alias("orphans"), F.count_if(c("depth").isNull()).alias("unreachable"),
        F.sum("broken_links").alias("broken"),
    )
    sums = by_rank.agg(
        F.sum("pages").alias("pages"), F.sum("orphans").alias("orphans"), F.sum("unreachable").alias("unreachable"), F.sum("broken").alias("broken"),
        F.max_by("pages", "rank").alias("at_top"),
    )
    bad = c("orphans") + c("unreachable")
    verdict = F.when((bad == 0) & (c("broken") == 0), "healthy").when(bad * 10 > c("pages"), "poor").otherwise("needs work")
    return sums.select(
        *(F.coalesce(x, F.lit(0)).alias(x) for x in ("pages", "orphans", "unreachable")), "broken", (c("at_top") > 1).alias("tied"),
        verdict.alias("verdict"),
    )


def internal_links(pages: DataFrame) -> DataFrame:
    """(url, target): distinct links of pages (url, html) to their own host, absolute."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]+)"""), F.lit(1))
    rows = pages.select(
        "url", F.regexp_extract("url", r"^(https?)://", 1).alias("scheme"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.explode(hrefs).alias("href"),
    )
    absolute = F.when(F.col("href").startswith("//"), F.concat("scheme", F.lit(":"), "href")).when(
        F.col("href").startswith("/"), F.concat("scheme", F.lit("://"), "host", "href"),
    ).when(F.col("href").rlike("(?i)^https?://"), F.col("href"))
    return rows.withColumn("target", absolute).where(F.regexp_extract("target", r"^https?://([^/?#]+)", 1) == F.col("host")).select("url", "target").distinct()


def broken_internal_links(pages: DataFrame, statuses: DataFrame) -> DataFrame:
    """(url, target, status) of internal links whose stored fetch isn't 200, or is missing (null)."""
    return internal_links(pages).join(
        statuses.select(F.col("url").alias("target"), "status"), "target", "left",
    ).where("status is null or status <> 200").select("url", "target", "status")
