"""Views over the given tables in the shapes that the operators take.

The SQL is valid in Spark and in DuckDB, so a query and its oracle see the same rows.
A view may name base tables and views listed before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["v_base"] = "SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events"

VIEWS["v_logs"] = """
SELECT ts AS timestamp,
       CASE WHEN user_id % 3 = 0 THEN '66.249.' || CAST(64 + user_id % 32 AS STRING) || '.' || CAST(k AS STRING)
            WHEN user_id % 3 = 1 AND user_id % 5 = 0 THEN '::ffff:66.249.66.' || CAST(k AS STRING)
            ELSE '203.0.113.' || CAST(k AS STRING) END AS remote_addr,
       CASE WHEN k % 11 = 0 THEN 'POST' ELSE 'GET' END AS method,
       'www.example.com' AS host,
       '/' || event_type || '/' || CAST(user_id AS STRING) || CASE WHEN user_id % 9 = 0 THEN '/a/b/' || CAST(k AS STRING) WHEN user_id % 13 = 0 THEN '.css' ELSE '' END
           || CASE k % 6 WHEN 0 THEN '?utm_source=feed' WHEN 1 THEN '?color=c' || CAST(k % 10 AS STRING) || '&size=s' WHEN 2 THEN '?page=' || CAST(k AS STRING) WHEN 3 THEN '?color=blue' ELSE '' END AS uri,
       CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 404 ELSE 500 END WHEN k % 10 = 0 THEN 301 WHEN k % 7 = 0 THEN 304 ELSE 200 END AS status,
       CAST(floor(value * 20) AS BIGINT) AS bytes_sent,
       'https://ref.example.com/' || CAST(user_id % 10 AS STRING) AS referer,
       CASE WHEN user_id % 7 = 0 THEN 'Mozilla/5.0 (compatible; GPTBot/1.0)' WHEN user_id % 2 = 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)' ELSE 'Mozilla/5.0 (X11; Linux) Safari/537.36' END AS user_agent,
       value / 1000 AS request_time, event_id, user_id, k
FROM v_base"""

VIEWS["v_ranges"] = """
SELECT * FROM (VALUES ('googlebot', 0, '66.249.64.0/20'), ('special-crawlers', 1, '66.249.80.0/20'),
    ('user-triggered-fetchers', 2, '66.249.72.0/21'), ('gptbot', 4, '203.0.113.0/28')) AS t(crawler, ord, cidr)"""

VIEWS["v_sitemap_paths"] = "SELECT '/' || t || '/' || CAST(p_partkey AS STRING) AS path, DATE '2024-01-31' AS snapshot_date FROM part, (VALUES ('view'), ('click')) AS x(t) WHERE p_partkey % 3 <> 1"

# The crawler of an address by plain arithmetic; the operator takes another way.
VIEWS["v_classified"] = """
SELECT l.*, CASE WHEN addr LIKE '66.249.%' AND o3 BETWEEN 64 AND 79 THEN 'googlebot' WHEN addr LIKE '66.249.%' AND o3 BETWEEN 80 AND 95 THEN 'special-crawlers'
                 WHEN addr LIKE '203.0.113.%' AND o4 < 16 THEN 'gptbot' ELSE '' END AS verified_crawler
FROM (SELECT *, CAST(regexp_extract(addr, '^[0-9]+[.][0-9]+[.]([0-9]+)', 1) AS INT) AS o3, CAST(regexp_extract(addr, '([0-9]+)$', 1) AS INT) AS o4
      FROM (SELECT *, replace(remote_addr, '::ffff:', '') AS addr FROM v_logs) AS a) AS l"""

VIEWS["v_enriched"] = """
SELECT timestamp, CASE WHEN remote_addr LIKE '%:%' THEN '0000:0000:0000:0:0:0:0:0' ELSE regexp_replace(addr, '[0-9]+$', '0') END AS remote_addr, method, host, uri, regexp_extract(uri, '^([^?]+)', 1) AS path, status, bytes_sent,
       user_agent, request_time, verified_crawler,
       CASE verified_crawler WHEN '' THEN '' WHEN 'gptbot' THEN 'ai_training' ELSE 'search' END AS crawler_purpose,
       verified_crawler IN ('googlebot', 'special-crawlers') AS verified_googlebot, event_id
FROM v_classified"""

# Links of a crawl: between all consecutive line items. Pages without links to or from them come from mapped ids; no row is dropped.
VIEWS["v_edges"] = """
SELECT DISTINCT '/p/' || CAST(CASE WHEN a.l_partkey % 17 = 0 THEN a.l_partkey + 1 ELSE a.l_partkey END AS STRING) AS source_url,
       '/p/' || CAST(CASE WHEN b.l_partkey % 20 = 0 THEN b.l_partkey + 1 ELSE b.l_partkey END AS STRING) AS target_url,
       CASE WHEN a.l_returnflag = 'A' AND a.l_suppkey % 9 = 0 THEN 404 WHEN a.l_returnflag = 'N' AND a.l_suppkey % 7 = 0 THEN 301 WHEN a.l_suppkey % 50 = 0 THEN 0 ELSE 200 END AS target_status_code,
       'a' || CAST(a.l_quantity AS INT) AS anchor
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""

VIEWS["v_links"] = "SELECT * FROM v_edges"

VIEWS["v_urls"] = """
SELECT page_id, url || CASE page_id % 7 WHEN 0 THEN '&utm_source=x&b=2' WHEN 1 THEN '' WHEN 2 THEN '&gclid=1' WHEN 3 THEN '&SID=9&a=1' ELSE '' END AS url FROM pages WHERE url LIKE '%?%' AND url NOT LIKE '%#%'
UNION ALL SELECT page_id, url FROM pages WHERE url NOT LIKE '%?%' OR url LIKE '%#%'
UNION ALL SELECT 100000 + p_partkey, 'https://Shop.example.com/' || CASE p_partkey % 5 WHEN 0 THEN 'Admin/' WHEN 1 THEN 'a/b/c/d/e/f/g/h/i/' WHEN 2 THEN '%C3%A9%C3%A8/' ELSE 'cart/' END || CAST(p_partkey AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '?sort=up&color=red' ELSE '' END FROM part"""

# Stored fetches of pages, their head elements by page.
VIEWS["v_fetches"] = """
SELECT page_id, 'https://site.example.com/p/' || CAST(page_id AS STRING) AS url,
       CASE WHEN page_id % 19 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 503 ELSE 200 END AS status,
       CASE WHEN page_id % 11 = 0 THEN 'https://site.example.com/' ELSE 'https://site.example.com/p/' || CAST(page_id AS STRING) END AS final_url,
       CASE WHEN page_id % 8 = 0 THEN 'text/html' WHEN page_id % 8 = 1 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS content_type,
       CASE WHEN page_id % 6 = 0 THEN 'no-store' WHEN page_id % 6 = 1 THEN 'max-age=2592000' WHEN page_id % 6 = 2 THEN 'max-age=60' ELSE '' END AS cache_control,
       CASE WHEN page_id % 14 = 0 THEN 'noindex, nofollow' ELSE '' END AS x_robots_tag,
       CASE WHEN page_id % 3 = 0 THEN '"e' || CAST(page_id AS STRING) || '"' ELSE '' END AS etag,
       page_id % 12 AS hops, html, page_id % 4 <> 3 AS should_index
FROM pages"""

# Pages of a list with structured data, speculation rules, headings, links and images put in by page_id.
VIEWS["v_rich"] = """
SELECT page_id, 'https://site.example.com/l?page=' || CAST(page_id AS STRING) AS url,
       '<html><head><title>T' || CAST(page_id AS STRING) || '</title>'
       || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<link rel="canonical" href="/l?page=' || CAST(page_id AS STRING) || '">' WHEN 4 THEN '<link rel="canonical" href="https://other.example.com/">' ELSE '<link rel="canonical" href="/l?page=1">' END
       || CASE WHEN page_id % 12 = 0 THEN '<meta name="robots" content="NOINDEX, follow">' ELSE '' END
       || CASE WHEN page_id % 10 = 3 THEN '<script src="http://cdn.example.com/a.js"></script>' ELSE '' END
       || '<script type="application/ld+json">' || CASE page_id % 4
            WHEN 0 THEN '{"@context":"https://schema.org","@type":"Product","name":"P' || CAST(page_id AS STRING) || '"' || CASE WHEN page_id % 8 = 0 THEN ',"image":"i.png"' ELSE '' END
                || ',"offers":{"@type":"Offer","price":"' || CAST(page_id AS STRING) || '.50","priceCurrency":"' || CASE WHEN page_id % 3 = 0 THEN 'usd' ELSE 'USD' END
                || '","availability":"https://schema.org/' || CASE page_id % 5 WHEN 0 THEN 'Gone' WHEN 1 THEN 'OutOfStock' ELSE 'InStock' END || '"}}'
            WHEN 1 THEN '{"@graph":[{"@type":"HowTo","name":"h"},[[{"@type":["Organization"],"name":"o"}]],{"@type":"BreadcrumbList","itemListElement":[{"position":1,"name":"a"},{"position":1,"name":"b"}]}]}'
            WHEN 2 THEN '{"@type": broken' ELSE '[[[[[[{"@type":"NewsArticle","author":{"bio":["ok","x <script>"]}}]]]]]]' END
       || '</script><script type="speculationrules">' || CASE page_id % 3
            WHEN 0 THEN '{"prerender":[{"urls":["/a","/cart"],"eagerness":"eager"}]}' WHEN 1 THEN '{"prefetch":[{"where":{"and":[{"href_matches":"/*"},{"not":{"selector_matches":".x"}}]},"eagerness":"immediate"}],"other":[]}'
            ELSE '{"prefetch":[{"eagerness":"fast"}],"prerender":[{"urls":["https://cdn.example.com/x"]}]}' END
       || '</script></head><body>' || CASE WHEN page_id % 3 = 0 THEN '<nav class="crumbs"><ul><li>a<li>c</ul></nav>' ELSE '' END
       || '<h1><span>' || CASE WHEN page_id % 8 = 0 THEN 'Q' ELSE 'P' END || '</span>' || CAST(page_id AS STRING) || '</h1><h3>in <b>stock</b></h3><aside><h2>x</h2></aside><p>costs ' || CASE WHEN page_id % 16 = 0 THEN 'nothing' ELSE CAST(page_id AS STRING) || '.50' END
       || CASE WHEN page_id % 15 = 2 THEN '<p>Page not found' ELSE '' END
       || CASE WHEN page_id % 14 = 0 THEN '<div class="pagination"><button>1</button></div>' WHEN page_id % 7 = 0 THEN '' ELSE '<a href="' || CASE WHEN page_id % 2 = 0 THEN '#' WHEN page_id % 6 = 1 THEN '/l?page=1' ELSE '/l?page=3' END || '"><span>Next</span></a>' END
       || '<img src="a.png"><img alt="photo 3"><a href="/q"><img alt="name"></a><a href="/r"></a><button></button></body></html>' AS html
FROM pages"""

# Pages with canonicals of all kinds, in head, body and header.
VIEWS["v_canonicals"] = """
SELECT page_id, 'https://site.example.com/c/' || CAST(page_id AS STRING) AS url,
       'https://site.example.com/c/' || CAST(page_id AS STRING) || CASE WHEN page_id % 13 = 8 THEN '?utm_source=z&gclid=1' ELSE '' END AS final_url,
       CASE WHEN page_id % 13 = 10 THEN 404 ELSE 200 END AS status,
       CASE page_id % 13 WHEN 11 THEN '<https://other.example.com/c/' || CAST(page_id AS STRING) || '>; rel="canonical"'
           WHEN 12 THEN '<./x/../../z>; rel=canonical' END AS link,
       '<html><head>' || CASE WHEN page_id % 13 = 5 THEN '<base href="https://cdn.example.com/x/">' ELSE '' END
       || CASE page_id % 13 WHEN 1 THEN '' WHEN 2 THEN '<link rel="canonical" href="/c/' || CAST(page_id AS STRING) || '">' WHEN 3 THEN '<link rel="canonical" href="https://site.example.com/C/' || CAST(page_id AS STRING) || '">'
           WHEN 4 THEN '<link rel="canonical" href=" ">' WHEN 5 THEN '<link rel="canonical" href="../c/' || CAST(page_id AS STRING) || '">' WHEN 6 THEN '<link rel="canonical" href="mailto:a@b.co">'
           WHEN 7 THEN '<link rel="canonical" href="https://site.example.com/c/' || CAST(page_id AS STRING) || '?utm_source=a">' WHEN 9 THEN '' WHEN 11 THEN ''
           ELSE '<link rel="Canonical" href="https://SITE.example.com:443/c/' || CAST(page_id AS STRING) || '">' END
       || CASE WHEN page_id % 13 = 2 OR page_id % 13 = 3 THEN '<link rel="canonical" href="https://site.example.com/c/' || CAST(page_id AS STRING) || '">' ELSE '' END || '</head><body>'
       || CASE WHEN page_id % 13 = 9 THEN '<link rel="canonical" href="https://site.example.com/c/' || CAST(page_id AS STRING) || '">' ELSE '' END || '<p>x</body></html>' AS html
FROM pages"""

# Stored answers with what a second, conditional request got.
VIEWS["v_answers"] = """
SELECT f.page_id, CASE WHEN f.page_id % 31 = 5 THEN 'https://h' || CAST(f.page_id AS STRING) || '.example.com/robots.txt' WHEN f.page_id % 31 = 6 THEN 'https://site.example.com/s-' || CAST(f.page_id AS STRING) || '.xml' ELSE f.url END AS url,
       f.final_url, CASE WHEN f.page_id % 37 = 1 THEN 0 ELSE f.status END AS status, f.hops, f.content_type, f.cache_control, f.x_robots_tag, f.etag,
       CASE WHEN f.page_id % 4 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' ELSE '' END AS last_modified,
       CASE WHEN f.page_id % 9 = 2 THEN '<https://site.example.com/l?page=1>; rel="canonical"' ELSE '' END AS link,
       CASE WHEN f.page_id % 6 = 0 THEN 304 WHEN f.page_id % 6 = 3 THEN 200 END AS conditional_status, f.page_id % 2 = 1 AS in_sitemap, r.html
FROM v_fetches f JOIN v_rich r ON r.page_id = f.page_id"""

VIEWS["v_heads"] = """
SELECT page_id, url, CAST(CASE WHEN page_id % 10 = 0 THEN 0 WHEN page_id % 10 = 1 THEN 2 ELSE 1 END AS INT) AS n_title,
       CASE WHEN page_id % 10 = 2 THEN '' WHEN page_id % 10 = 3 THEN 'Home' ELSE 'Page ' || CAST(page_id AS STRING) END AS title,
       CAST(CASE WHEN page_id % 9 = 0 THEN 0 WHEN page_id % 9 = 1 THEN 2 ELSE 1 END AS INT) AS n_canonical,
       CASE WHEN page_id % 9 = 2 THEN '/p/' || CAST(page_id AS STRING) WHEN page_id % 9 = 3 THEN 'https://other.example.com/p' WHEN page_id % 9 = 4 THEN 'https://site.example.com/p/' || CAST(page_id + 1 AS STRING) ELSE url END AS canonical,
       CAST(CASE WHEN page_id % 5 = 0 THEN 0 WHEN page_id % 5 = 1 THEN 2 ELSE 1 END AS INT) AS n_description,
       CASE WHEN page_id % 7 = 0 THEN 'noindex' WHEN page_id % 7 = 1 THEN 'index, follow' ELSE '' END AS robots,
       CASE WHEN page_id % 13 = 0 THEN 'none' ELSE '' END AS googlebot,
       page_id % 4 <> 0 AS has_og_title, page_id % 6 <> 0 AS has_og_image, page_id % 8 <> 0 AS has_og_url, page_id % 3 <> 0 AS has_twitter_card,
       CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 11 = 1 THEN 'width=device-width, user-scalable=no' ELSE 'width=device-width' END AS viewport,
       CASE WHEN page_id % 16 = 0 THEN '' WHEN page_id % 16 = 1 THEN 'iso-8859-1' ELSE 'utf-8' END AS charset
FROM v_fetches"""

VIEWS["v_sitemap"] = """
SELECT 'https://site.example.com/sitemap-' || CAST(page_id % 4 AS STRING) || '.xml' AS sitemap, page_id AS pos,
       CASE WHEN page_id % 21 = 0 THEN 'https://staging.example.com/p/' ELSE 'https://site.example.com/p/' END || CAST(page_id AS STRING) AS loc,
       CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN '01/02/2024' WHEN page_id % 4 = 2 THEN '2024-01-15T10:00:00Z' ELSE '2024-01-' || lpad(CAST(1 + page_id % 28 AS STRING), 2, '0') END AS lastmod
FROM pages"""

VIEWS["v_hreflang"] = """
SELECT 'https://h.example.com/' || s.l || '/' || CAST(page_id AS STRING) AS url, t.l AS lang, 'https://h.example.com/' || t.l || '/' || CAST(page_id AS STRING) AS href
FROM pages, (VALUES ('en'), ('fr'), ('de'), ('uk')) AS s(l), (VALUES ('en'), ('fr'), ('de'), ('uk'), ('x-default')) AS t(l)
WHERE NOT (page_id % 7 = 0 AND s.l = 'fr' AND t.l = 'en') AND NOT (page_id % 5 = 0 AND s.l = 'de') AND NOT (page_id % 3 = 0 AND t.l = 'x-default') AND NOT (page_id % 11 = 0 AND s.l = t.l)"""

VIEWS["v_robots"] = """
SELECT * FROM (VALUES ('site.example.com', 0, '*', 'disallow', '/p/1', 2), ('site.example.com', 0, '*', 'allow', '/p/12', 3), ('site.example.com', 0, '*', 'disallow', '/*.pdf$', 4), ('site.example.com', 0, '*', 'disallow', '', 5),
    ('site.example.com', 1, 'googlebot', 'disallow', '/p/2', 7), ('site.example.com', 1, 'googlebot', 'allow', '/p/2', 8), ('site.example.com', 1, 'googlebot', 'disallow', '/p/3*5', 9), ('site.example.com', 2, 'googlebot-news', 'disallow', '/', 11)) AS t(host, group_id, agent, directive, path, line)"""


def with_views(names: list[str], spark_dir: str | None = None) -> str:
    """The CTEs of views and all that they need; base tables too, for Spark."""
    wanted: set[str] = set()

    def add(sql: str) -> None:
        for name in [*VIEWS, *TABLES]:
            if name not in wanted and re.search(rf"\b{name}\b", sql):
                wanted.add(name)
                add(VIEWS.get(name, ""))

    add(" ".join(names))
    parts = [f"{t} AS (SELECT * FROM parquet.`{spark_dir}/{t}.parquet`)" for t in TABLES if spark_dir and t in wanted]
    return ", ".join(parts + [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in wanted])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(f"WITH {with_views([name], sf_dir)} SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not names:
        return sql
    head = with_views(names)
    if m := re.match(r"\s*WITH (RECURSIVE )?", sql):
        return f"WITH {m[1] or ''}{head}, {sql[m.end():]}"
    return f"WITH {head} {sql}"
