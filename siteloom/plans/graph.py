"""Queries over the link graph and URLs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as fu
from ..operators import graph, urls
from ..operators.findings import findings_summary
from ..storage import materialize
from .views import table, view

HOME, ROUNDS = "/p/1", 10


def _edges(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_edges")


def _graph(s: SparkSession, d: str):
    return graph.written_graph(_edges(s, d))


def _depths(s: SparkSession, d: str) -> DataFrame:
    return graph.click_depth(_graph(s, d)[1], HOME, written=True)


def _with_depths(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vertices, links = _graph(s, d)
    return vertices, graph.click_depth(links, HOME, written=True)


def _at_risk(s: SparkSession, d: str) -> DataFrame:
    vertices, links = _graph(s, d)
    return graph.at_risk(graph.orphans(vertices, links, HOME), graph.unreachable(vertices, graph.click_depth(links, HOME, written=True)), graph.sitemap_diff(_known(s, d), vertices))


def _known(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.concat(F.lit("/p/"), "p_partkey").alias("url"))


_G = """WITH RECURSIVE ok AS (SELECT * FROM v_edges WHERE target_status_code BETWEEN 200 AND 299), v AS (SELECT source_url AS url FROM ok UNION SELECT target_url FROM ok),
    l AS (SELECT DISTINCT source_url AS src, target_url AS dst FROM ok WHERE source_url <> target_url), known AS (SELECT '/p/' || p_partkey AS url FROM part),
    walk AS (SELECT '/p/1' AS url, 0 AS depth UNION SELECT l.dst, walk.depth + 1 FROM walk JOIN l ON l.src = walk.url WHERE walk.depth < 40), depths AS (SELECT url, min(depth)::INT AS depth FROM walk GROUP BY url),
    orphan AS (SELECT url FROM v WHERE url NOT IN (SELECT dst FROM l) AND url <> '/p/1') """


def _pagerank_sql(rounds: int = ROUNDS) -> str:
    sql = _G + ", n AS (SELECT count(*) AS n FROM v), o AS (SELECT src, count(*) AS links FROM l GROUP BY src), r0 AS (SELECT url, 1.0::DOUBLE / n AS rank FROM v, n)"
    for i in range(rounds):
        sql += f", r{i + 1} AS (SELECT v.url, (0.15 / n.n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE url NOT IN (SELECT src FROM o)) / n.n + 0.85 * coalesce(g.got, 0))::DOUBLE AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT l.dst, sum(r.rank / o.links) AS got FROM l JOIN r{i} r ON r.url = l.src JOIN o ON o.src = l.src GROUP BY l.dst) g ON g.dst = v.url)"
    return sql


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(*_graph(s, d), rounds=ROUNDS)


def _report(s: SparkSession, d: str) -> DataFrame:
    return graph.link_report(_edges(s, d), HOME, _known(s, d), rounds=ROUNDS)


_REPORT = _pagerank_sql() + f""", i AS (SELECT dst AS url, count(*) AS n FROM l GROUP BY 1), b AS (SELECT source_url AS url, count(*) FILTER (WHERE target_status_code >= 400 OR target_status_code < 100) AS broken_links, count(*) FILTER (WHERE target_status_code BETWEEN 300 AND 399) AS redirect_links FROM v_edges GROUP BY 1),
    rep AS (SELECT p.url, round(r.rank, 8) AS rank, depths.depth, coalesce(i.n, 0) AS in_degree, coalesce(o.links, 0) AS out_degree, coalesce(b.broken_links, 0) AS broken_links, coalesce(b.redirect_links, 0) AS redirect_links,
        p.url IN (SELECT url FROM orphan) OR p.url NOT IN (SELECT url FROM v) AS orphan
    FROM (SELECT url FROM v UNION SELECT url FROM known) p LEFT JOIN r{ROUNDS} r ON r.url = p.url LEFT JOIN depths ON depths.url = p.url LEFT JOIN i ON i.url = p.url LEFT JOIN o ON o.src = p.url LEFT JOIN b ON b.url = p.url) """


def _settled(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Ranks that change by less than 1e-6 in all, whatever the number of pages."""
    return graph.pagerank(vertices, links, tol=1e-6 / max(1, vertices.count()))


def _converged(s: SparkSession, d: str) -> DataFrame:
    return _settled(*graph.written_graph(view(s, d, "v_links")))


def _residual(s: SparkSession, d: str) -> DataFrame:
    """Whether the converged ranks meet their own equation: what one more round would change."""
    vertices, links = graph.written_graph(view(s, d, "v_links"))
    out = links.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("links"))
    ranks = materialize(_settled(vertices, links).join(out, "url", "left"), "ranks")
    sent = ranks.where("links is not null").select(F.col("url").alias("src"), (F.col("rank") / F.col("links")).alias("share"))
    got = links.join(sent, "src").groupBy(F.col("dst").alias("url")).agg(F.sum("share").alias("got"))
    rows = materialize(ranks.join(got, "url", "left"), "residual")
    lost = rows.agg(F.count("*").alias("n"), F.sum(F.when(F.col("links").isNull(), F.col("rank")).otherwise(0.0)).alias("lost")).first()
    new = 0.15 / lost["n"] + 0.85 * lost["lost"] / lost["n"] + 0.85 * F.coalesce("got", F.lit(0.0))
    return rows.agg(F.count("*").alias("pages"), (F.abs(F.sum("rank") - 1) < 1e-6).alias("sums_to_one"), (F.sum(F.abs(new - F.col("rank"))) < 1e-6).alias("settled"))


def _urls(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_urls")


_P = "regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?', {})"
_Q = "list_filter(string_split(" + _P.format(4) + ", '&'), lambda p: p <> '')"
_BASE = _P.format(1) + " || '://' || " + _P.format(2)
_PATH = "CASE WHEN rtrim(" + _P.format(3) + ", '/') = '' THEN '/' ELSE rtrim(" + _P.format(3) + ", '/') END"
_TAIL = "CASE WHEN len({q}) = 0 THEN '' ELSE '?' || array_to_string({q}, '&') END"


def _strip(rules: str, test: str) -> tuple:
    kept = f"list_filter({_Q}, lambda p: NOT ({test}))"
    return (lambda s, d: _urls(s, d).select("page_id", fu.strip_tracking(F.col("url"), rules).alias("stripped")), f"SELECT page_id, {_BASE} || {_P.format(3)} || {_TAIL.format(q=kept)} AS stripped FROM v_urls")


def _names(rules: str) -> str:
    return "(" + ", ".join(f"'{x}'" for x in fu.TRACKING[rules]) + ")"


def _facet_requests(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("id"), F.when(k % 2 == 0, "Shoes").otherwise("hats").alias("category_slug"), F.map_filter(F.create_map(F.lit("color"), F.when(k % 3 == 0, " Black ").when(k % 3 == 1, "white").otherwise(""), F.lit("brand"), F.when(k % 5 == 0, "Nike").otherwise(""), F.lit("sort"), F.when(k % 7 == 0, "price").otherwise(""), F.lit("utm_source"), F.lit("x")), lambda n, v: v != "").alias("params"))


def _registry(s: SparkSession) -> DataFrame:
    return urls.register_facets(s.createDataFrame([("shoes", {"color": "black"}), ("Shoes", {"Color": " BLACK"}), ("shoes", {"color": "white"}), ("shoes", {"brand": "nike"})], "category_slug string, facets map<string,string>"))


def _lint(s: SparkSession, d: str) -> DataFrame:
    return urls.lint_urls(_urls(s, d), key="page_id")


_RES = "(" + ", ".join(f"'{x}'" for x in urls.RESERVED) + ")"
_INS = "(" + ", ".join(f"'{x}'" for x in urls.INSIGNIFICANT) + ")"
_NAMES = "list_transform(q, lambda x: split_part(x, '=', 1))"
_LINT = f"""WITH p AS (SELECT page_id, url, {_P.format(3)} AS path, {_Q} AS q FROM v_urls), n AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, list_filter({_NAMES}, lambda x, i: lower(x) IN {_INS} AND list_position({_NAMES}, x) = i) AS names FROM p),
    f AS (SELECT page_id, 'error' AS severity, 'mixed_case_path' AS rule, path AS detail FROM n WHERE path <> lower(path)
    UNION ALL SELECT page_id, 'error', 'unwanted_trailing_slash', '' FROM n WHERE path NOT IN ('', '/') AND path LIKE '%/'
    UNION ALL SELECT page_id, 'error', 'insignificant_params_in_canonical', array_to_string(names, ', ') FROM n WHERE len(names) > 0
    UNION ALL SELECT page_id, 'error', 'parse_failed', '' FROM n WHERE url IS NULL
    UNION ALL SELECT page_id, 'warning', 'url_too_long', length(url)::VARCHAR FROM n WHERE length(url) > 2048
    UNION ALL SELECT page_id, 'warning', 'high_encoded_density', '' FROM n WHERE (length(url) - length(replace(url, '%', ''))) * 3.0 / length(url) > 0.2
    UNION ALL SELECT page_id, 'warning', 'deep_path_nesting', len(seg)::VARCHAR FROM n WHERE len(seg) > 8
    UNION ALL SELECT page_id, 'warning', 'reserved_slug_in_path', s FROM (SELECT page_id, unnest(seg) AS s FROM n) WHERE lower(split_part(s, '.', 1)) IN {_RES}) """

ENTRIES: dict[str, tuple] = {
    "build_graph": (lambda s, d: graph.build_graph(_edges(s, d))[1], "SELECT source_url AS src, target_url AS dst, max(anchor) AS anchor FROM v_edges GROUP BY 1, 2"),
    "resolve_homepage": (lambda s, d: s.createDataFrame([(graph.resolve_homepage(_graph(s, d)[0], HOME + "/"),)], "home string"), _G + "SELECT max(url) AS home FROM v WHERE url IN ('/p/1', '/p/1/')"),
    "pagerank": (lambda s, d: _ranked(s, d).select("url", F.round("rank", 8).alias("rank")), _pagerank_sql() + f"SELECT url, round(rank, 8) AS rank FROM r{ROUNDS}"),
    "click_depth": (_depths, _G + "SELECT url, depth FROM depths"),
    "degrees": (lambda s, d: graph.degrees(*_graph(s, d)), _G + "SELECT v.url, (SELECT count(*) FROM l WHERE dst = v.url) AS in_degree, (SELECT count(*) FROM l WHERE src = v.url) AS out_degree FROM v"),
    "orphans": (lambda s, d: graph.orphans(*_graph(s, d), HOME, _known(s, d)), _G + "SELECT url FROM orphan UNION SELECT url FROM known WHERE url NOT IN (SELECT url FROM v)"),
    "link_status_counts": (lambda s, d: graph.link_status_counts(_edges(s, d)), "SELECT source_url AS url, count(*) FILTER (WHERE target_status_code >= 400 OR target_status_code < 100) AS broken_links, count(*) FILTER (WHERE target_status_code BETWEEN 300 AND 399) AS redirect_links FROM v_edges GROUP BY 1"),
    "link_report": (lambda s, d: _report(s, d).withColumn("rank", F.round("rank", 8)), _REPORT + "SELECT * FROM rep"),
    "depth_buckets": (lambda s, d: graph.depth_buckets(*_with_depths(s, d)), _G + "SELECT CASE WHEN depth IS NULL THEN 'unreachable' WHEN depth >= 5 THEN '5+' ELSE depth::VARCHAR END AS bucket, count(*) AS pages FROM v LEFT JOIN depths USING (url) GROUP BY 1"),
    "depth_summary": (lambda s, d: graph.depth_summary(_depths(s, d)), _G + "SELECT count(*) AS reachable, max(depth) AS max_depth, round(avg(depth), 3) AS avg_depth, round(100.0 * count(*) FILTER (WHERE depth <= 3) / count(*), 2)::DOUBLE AS pct_near FROM depths"),
    "unreachable": (lambda s, d: graph.unreachable(*_with_depths(s, d)), _G + "SELECT url FROM v WHERE url NOT IN (SELECT url FROM depths)"),
    "top_pages": (lambda s, d: graph.top_pages(graph.degrees(*_graph(s, d)).select("url", "in_degree"), "in_degree"), _G + "SELECT dst AS url, count(*) AS in_degree FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "sitemap_diff": (lambda s, d: graph.sitemap_diff(_known(s, d), _graph(s, d)[0]), _G + "SELECT url, 'sitemap' AS side FROM known WHERE url NOT IN (SELECT url FROM v) UNION ALL SELECT url, 'graph' FROM v WHERE url NOT IN (SELECT url FROM known)"),
    "at_risk": (_at_risk, _G + "SELECT url FROM orphan UNION SELECT url FROM v WHERE url NOT IN (SELECT url FROM depths) UNION SELECT url FROM known WHERE url NOT IN (SELECT url FROM v)"),
    "graph_verdict": (lambda s, d: graph.graph_verdict(_report(s, d).withColumn("rank", F.round("rank", 8))), _REPORT + "SELECT count(*) AS pages, count(*) FILTER (WHERE orphan) AS orphans, count(*) FILTER (WHERE depth IS NULL) AS unreachable, sum(broken_links)::BIGINT AS broken, count(*) FILTER (WHERE rank = (SELECT max(rank) FROM rep)) > 1 AS tied, CASE WHEN count(*) FILTER (WHERE orphan) + count(*) FILTER (WHERE depth IS NULL) = 0 AND sum(broken_links) = 0 THEN 'healthy' WHEN (count(*) FILTER (WHERE orphan) + count(*) FILTER (WHERE depth IS NULL)) * 10 > count(*) THEN 'poor' ELSE 'needs work' END AS verdict FROM rep WHERE rank IS NOT NULL"),
    "pagerank_converged": (_converged, None),
    "pagerank_residual": (_residual, "SELECT (SELECT count(*) FROM (SELECT source_url FROM v_links WHERE target_status_code BETWEEN 200 AND 299 UNION SELECT target_url FROM v_links WHERE target_status_code BETWEEN 200 AND 299)) AS pages, true AS sums_to_one, true AS settled"),
    "all_links_report": (lambda s, d: graph.link_report(view(s, d, "v_links"), HOME, _known(s, d), rounds=ROUNDS).withColumn("rank", F.round("rank", 8)), _REPORT.replace("v_edges", "v_links") + "SELECT * FROM rep"),
    "broken_internal_links": (lambda s, d: graph.broken_internal_links(table(s, d, "pages").select("url", "html"), table(s, d, "pages").selectExpr("regexp_extract(url, '^(https?://[^/]+)', 1) || '/the' url", "200 status").distinct()),
        r"""WITH l AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''#]+)', 1)) AS href FROM pages), t AS (SELECT DISTINCT url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS target FROM l WHERE href LIKE '/%' AND href NOT LIKE '//%')
           SELECT url, target, CAST(NULL AS INT) AS status FROM t WHERE target NOT LIKE '%/the' OR target NOT IN (SELECT regexp_extract(url, '^(https?://[^/]+)', 1) || '/the' FROM pages)"""),
    "url_parts": (lambda s, d: _urls(s, d).select("page_id", fu.url_parts(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.host", "u.path", "u.query"), f"SELECT page_id, lower({_P.format(1)}) AS scheme, lower({_P.format(2)}) AS host, {_P.format(3)} AS path, {_P.format(4)} AS query FROM v_urls"),
    "normalize_url_compare": (lambda s, d: _urls(s, d).select("page_id", fu.normalize_url_compare(F.col("url")).alias("normal")), f"SELECT page_id, lower({_BASE}) || {_PATH} || CASE WHEN {_P.format(4)} = '' THEN '' ELSE '?' || {_P.format(4)} END AS normal FROM v_urls"),
    "normalize_url_sorted": (lambda s, d: _urls(s, d).select("page_id", fu.normalize_url_sorted(F.col("url")).alias("normal")), f"SELECT page_id, lower({_BASE}) || {_PATH} || {_TAIL.format(q='list_sort(' + _Q + ')')} AS normal FROM v_urls"),
    "normalize_url_slash": (lambda s, d: _urls(s, d).select("page_id", fu.normalize_url_slash(F.col("url"), "require").alias("normal")), f"SELECT page_id, lower({_BASE}) || rtrim({_P.format(3)}, '/') || '/' || {_TAIL.format(q=_Q)} AS normal FROM v_urls"),
    "strip_tracking_audit": _strip("audit", f"lower(split_part(p, '=', 1)) IN {_names('audit')} OR lower(p) LIKE 'utm\\_%' ESCAPE '\\'"),
    "strip_tracking_normalize": _strip("normalize", f"lower(split_part(p, '=', 1)) IN {_names('normalize')}"),
    "strip_tracking_edge": _strip("edge", f"split_part(p, '=', 1) IN {_names('edge')}"),
    "tracking_params": (lambda s, d: _urls(s, d).select("page_id", F.array_join(F.array_sort(fu.tracking_params(F.col("url"))), ",").alias("names")), f"SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform({_Q}, lambda p: split_part(p, '=', 1)), lambda n: lower(n) IN {_names('audit')} OR lower(n) LIKE 'utm\\_%' ESCAPE '\\'))), ',') AS names FROM v_urls"),
    "canonical_query": (lambda s, d: _urls(s, d).select("page_id", fu.canonical_query(fu.url_parts(F.col("url"))["query"]).alias("query")), f"SELECT page_id, array_to_string(list_sort(list_transform(list_filter({_Q}, lambda p: split_part(p, '=', 2) <> ''), lambda p: split_part(p, '=', 1) || '=' || lower(split_part(p, '=', 2)))), '&') AS query FROM v_urls"),
    "is_abs_http": (lambda s, d: _urls(s, d).select("page_id", fu.is_abs_http(F.col("url")).alias("ok")), "SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS ok FROM v_urls"),
    "is_one_time_action": (lambda s, d: _urls(s, d).select("page_id", fu.is_one_time_action(F.col("url")).alias("once")), "SELECT page_id, regexp_matches(url, '(?i)/(checkout|confirm|payment|pay|cart|logout|delete|cancel|verify|api)(/|[?]|$)') AS once FROM v_urls"),
    "generate_canonical": (lambda s, d: urls.generate_canonical(_facet_requests(s, d).select("id", F.concat(F.lit("/"), "category_slug").alias("path"), F.map_concat("params", F.create_map(F.lit("type"), F.concat(F.lit("t"), F.col("id") % 3))).alias("params"))).select("id", "canonical", F.array_join("dropped", ",").alias("dropped")),
        "SELECT p_partkey AS id, 'https://example.com/' || CASE WHEN p_partkey % 2 = 0 THEN 'Shoes' ELSE 'hats' END || '?' || CASE WHEN p_partkey % 5 = 0 THEN 'brand=Nike&' ELSE '' END || 'type=t' || (p_partkey % 3) AS canonical, CASE WHEN p_partkey % 3 < 2 THEN 'color' ELSE '' END AS dropped FROM part"),
    "compute_canonical": (lambda s, d: urls.compute_canonical(table(s, d, "part").selectExpr("p_partkey id", "'/c/' || p_partkey path", "CASE p_partkey % 3 WHEN 0 THEN 'page=2&page=3&x=1' WHEN 1 THEN 'page=' ELSE null END query", "CASE p_partkey % 4 WHEN 0 THEN 'https://cms.example.com/o' WHEN 1 THEN '/rel' END override"), "https://s.example.com/").select("id", "canonical"),
        "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'https://cms.example.com/o' ELSE 'https://s.example.com/c/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '?page=3' ELSE '' END END AS canonical FROM part"),
    "expected_redirect": (lambda s, d: urls.expected_redirect(_urls(s, d).withColumn("method", F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST"))).select("page_id", "target"),
        f"WITH t AS (SELECT page_id, url, 'https://' || regexp_replace(lower({_P.format(2)}), '^www[.]', '') || {_PATH} || CASE WHEN page_id % 2 = 0 THEN {_TAIL.format(q='list_filter(' + _Q + ', lambda p: split_part(p, ' + chr(39) + '=' + chr(39) + ', 1) NOT IN ' + _names('edge') + ')')} ELSE {_TAIL.format(q=_Q)} END AS target FROM v_urls) SELECT page_id, target FROM t WHERE target <> url"),
    "slug_redirects": (lambda s, d: urls.slug_redirects(table(s, d, "part").selectExpr("p_partkey id", "CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN 'old' END slug"), table(s, d, "part").where("p_partkey % 5 <> 0").selectExpr("p_partkey id", "replace(p_name, ' ', '-') slug")),
        "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN 'old' END AS slug, (CASE WHEN p_partkey % 5 = 0 THEN 404 WHEN p_partkey % 4 = 0 THEN 200 ELSE 301 END)::INT AS status, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 <> 0 THEN '/articles/' || p_partkey || '/' || replace(p_name, ' ', '-') END AS location FROM part"),
    "slugify": (lambda s, d: table(s, d, "part").select("p_partkey", urls.slugify(F.concat(F.lit(" É"), "p_name", F.lit("! ")), 9).alias("slug")),
        "WITH s AS (SELECT p_partkey, 'e' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS s FROM part) SELECT p_partkey, CASE WHEN length(s) <= 9 THEN s WHEN substr(s, 10, 1) = '-' THEN left(s, 9) WHEN contains(left(s, 9), '-') THEN regexp_replace(left(s, 9), '-[^-]*$', '') ELSE left(s, 9) END AS slug FROM s"),
    "assign_slugs": (lambda s, d: urls.assign_slugs(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("base")), s.createDataFrame([("red-widget-2",), ("small-ring",)], "slug string")),
        """WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part), f AS (SELECT *, n + CASE WHEN base = 'small-ring' OR (base = 'red-widget' AND n > 1) THEN 1 ELSE 0 END AS m FROM n)
           SELECT id, base, base || CASE WHEN m = 1 THEN '' ELSE '-' || m END AS slug FROM f"""),
    "lint_urls": (_lint, _LINT + "SELECT * FROM f"),
    "lint_summary": (lambda s, d: urls.lint_summary(_lint(s, d)), _LINT + "SELECT rule, severity, count(*) AS n FROM f GROUP BY 1, 2"),
    "findings_summary": (lambda s, d: findings_summary(_lint(s, d), "page_id"), _LINT + "SELECT page_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, 0::BIGINT AS notices, count(*) FILTER (WHERE severity = 'error') > 0 AS blocked FROM f GROUP BY 1"),
    "classify_facets": (lambda s, d: urls.classify_facets(_facet_requests(s, d), _registry(s)),
        """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Shoes' ELSE 'hats' END AS category_slug, concat_ws('&', CASE WHEN p_partkey % 5 = 0 THEN 'brand=nike' END, CASE p_partkey % 3 WHEN 0 THEN 'color=black' WHEN 1 THEN 'color=white' END) AS signature FROM part),
             k AS (SELECT *, (CASE WHEN signature = '' THEN 2 WHEN category_slug = 'Shoes' AND signature IN ('color=black', 'color=white', 'brand=nike') THEN 1 ELSE 3 END)::INT AS tier FROM r)
           SELECT id, category_slug, signature, tier, CASE tier WHEN 1 THEN 'https://example.com/category/' || category_slug || '?' || signature WHEN 2 THEN 'https://example.com/category/' || category_slug END AS canonical, CASE WHEN tier = 3 THEN 'noindex, follow' ELSE 'index, follow' END AS robots FROM k"""),
    "hreflang_variants": (lambda s, d: urls.hreflang_variants(table(s, d, "part").selectExpr("CASE p_partkey % 2 WHEN 0 THEN '/fr' ELSE '' END || '/p/' || p_partkey || '/' path"), [("en", ""), ("fr", "/fr"), ("de", "/de")], "https://h.example.com", "en"),
        "SELECT CASE p_partkey % 2 WHEN 0 THEN '/fr' ELSE '' END || '/p/' || p_partkey || '/' AS path, l AS lang, 'https://h.example.com' || x || '/p/' || p_partkey AS href FROM part, (VALUES ('en', ''), ('fr', '/fr'), ('de', '/de'), ('x-default', '')) AS t(l, x)"),
}
