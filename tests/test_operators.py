"""Golden cases: what the queries' views don't bring up."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siteloom.functions import urls as u
from siteloom.functions.addresses import anonymize_ip, ip_bits
from siteloom.operators import chains, graph, jsonld, logs, pages, records, sets, urls
from siteloom.sources import readers, writers
from siteloom.storage import materialize
from siteloom.streaming import jobs


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


SHOP = "https://shop.example.org"
ALIKE = [
    [f"{SHOP}/Depot/", f"{SHOP}/Depot", "HTTPS://Shop.Example.ORG:443/Depot", f"{SHOP}/Depot#top"], [f"{SHOP}/a%20b/%C3%BC", f"{SHOP}/a b/ü"], ["http://xn--dn-xka.example:8080/q?z=1", "http://dün.example:8080/q/?z=1"],
    ["http://dün.example/q?z=1"], [f"{SHOP}/depot"], [f"{SHOP}/Depot?tab=2"], ["http://shop.example.org/Depot"],
]


def test_url_comparison(spark):
    forms = {url: one(spark, u.normalize_url_compare, url) for group in ALIKE for url in group}
    groups = [{forms[url] for url in group} for group in ALIKE]
    assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == len(ALIKE)


@pytest.mark.parametrize(("url", "rules", "stripped"), [
    ("https://s.example.org/x?UTM_Term=a&keep=&mc_cid=1&k=v#f", "audit", "https://s.example.org/x?keep=&k=v"), ("https://s.example.org/x?utm_custom=1&source=n", "audit", "https://s.example.org/x?source=n"),
    ("https://s.example.org/x?utm_custom=1&source=n", "normalize", "https://s.example.org/x?utm_custom=1"), ("https://s.example.org/x?GCLID=1&gclid=2", "edge", "https://s.example.org/x?GCLID=1"),
])
def test_strip_tracking(spark, url, rules, stripped):
    assert one(spark, lambda c: u.strip_tracking(c, rules), url) == stripped


@pytest.mark.parametrize(("href", "want"), [
    ("/a?b", "https://s.example.org:8443/a?b"), ("c", "https://s.example.org:8443/x/c"), ("?p=2", "https://s.example.org:8443/x/y?p=2"), ("#t", "https://s.example.org:8443/x/y?q#t"),
    ("//o.example.net/z", "https://o.example.net/z"), ("mailto:a@b.co", "mailto:a@b.co"), ("", "https://s.example.org:8443/x/y?q"),
])
def test_resolve(spark, href, want):
    assert one(spark, lambda c: u.resolve(F.lit("https://s.example.org:8443/x/y?q#old"), c), href) == want


@pytest.mark.parametrize(("ip", "bits"), [("1.2.3.4", 32), ("2001:db8::1", 128), ("::ffff:1.2.3.4", 32), ("1.2.3.400", None), ("nothing", None), ("::", 128), ("1:2:3", None)])
def test_ip_bits(spark, ip, bits):
    got = one(spark, ip_bits, ip)
    assert (len(got) if got else None) == bits


def test_anonymize(spark):
    assert [one(spark, anonymize_ip, x) for x in ("10.1.2.3", "2001:db8:1:2::5", "x", "")] == ["10.1.2.0", "2001:0db8:0001:0:0:0:0:0", "", ""]


def test_crawler_by_ipv6_and_order(spark):
    ranges = spark.createDataFrame([("b", 1, "2001:db8::/32"), ("a", 0, "2001:db8:1::/48"), ("c", 2, "broken/8"), ("d", 3, "10.0.0.0/8")], "crawler string, ord int, cidr string")
    rows = spark.createDataFrame([("2001:db8:1::9",), ("2001:db8:2::9",), ("10.9.9.9",), ("11.0.0.1",), (None,)], "remote_addr string")
    assert sorted(map(tuple, logs.verify_crawler(rows, ranges).collect()), key=str) == sorted([("2001:db8:1::9", "a"), ("2001:db8:2::9", "b"), ("10.9.9.9", "d"), ("11.0.0.1", ""), (None, "")], key=str)


def test_log_lines(spark):
    lines = [
        '1.1.1.1 - - [05/Jan/2024:10:00:00 +0000] "GET /a?x=1 HTTP/1.1" 200 - "-" "UA"', '1.1.1.1 - - [2024-01-05T10:00:00Z] "GET /b HTTP/1.1" 304 5 "r" "UA" 0.5', "   ", "nonsense",
        '{"EdgeStartTimestamp":1704448800,"ClientIP":"2.2.2.2","ClientRequestMethod":"GET","ClientRequestURI":"/c","EdgeResponseStatus":200,"EdgeResponseBytes":7,"ClientRequestUserAgent":"x"}', '{"time_iso8601":"2024-01-05T10:00:00+00:00","remote_addr":"3.3.3.3","request_method":"GET","request_uri":"/d","status":"404","body_bytes_sent":"x","http_user_agent":"y","request_time":0}',
        'h2 2024-01-05T10:00:00.1Z app/x 4.4.4.4:99 10.0.0.1:80 0.0 0.25 0.0 200 200 1 77 "GET https://e.com:443/e?q=1 HTTP/2" "Agent \'q" - -',
    ]
    good, bad = logs.parse_logs(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r["path"]: r for r in good.collect()}
    assert sorted(got) == ["/a", "/b", "/c", "/d", "/e"] and [r["value"] for r in bad.collect()] == ["nonsense"]
    assert (got["/a"]["bytes_sent"], got["/b"]["request_time"], got["/d"]["request_time"], got["/d"]["bytes_sent"], got["/e"]["remote_addr"], got["/e"]["request_time"], got["/e"]["bytes_sent"]) == (0, 0.5, 0.0, 0, "4.4.4.4", 0.25, 77)


def test_link_graph(spark):
    h = "https://example.com/"
    raw = spark.createDataFrame([(h, h + "about", "200"), (h, h + "old", "301"), (h, h + "products", "200"), (h + "products", h + "widget", "200"), (h + "products", h + "products", "200"), (h + "products", h + "gone", "404"), (h + "products", h + "timeout", "0"), (h + "landing", h, "200"), (h + "about", "", "200"), (None, h, "x")], "Source string, Destination string, `Status Code` string")
    edges = readers.read_edges(raw)
    known = spark.createDataFrame([(h + "forgotten",)], "url string")
    rows = {r["url"]: r for r in graph.link_report(edges, h, known).collect()}
    assert abs(sum(r["rank"] or 0 for r in rows.values()) - 1) < 1e-4
    assert (rows[h]["broken_links"], rows[h]["redirect_links"], rows[h]["orphan"], rows[h]["depth"]) == (0, 1, False, 0)
    assert (rows[h + "products"]["broken_links"], rows[h + "products"]["in_degree"], rows[h + "widget"]["depth"]) == (2, 1, 2)
    assert rows[h + "landing"]["orphan"] and rows[h + "landing"]["depth"] is None
    assert rows[h + "forgotten"]["orphan"] and rows[h + "forgotten"]["rank"] is None and rows[h + "forgotten"]["in_degree"] == 0
    vertices, links = graph.build_graph(edges.where("target_status_code = 404"), ok_only=True)
    assert vertices.count() == 0 and graph.pagerank(vertices, links).count() == 0
    assert graph.resolve_homepage(graph.build_graph(edges)[0], h[:-1]) == h


ROBOTS = [
    ("/lab*/raw", "/lab/2024/raw/1", True), ("/lab*/raw", "/labraw", False), ("/q$", "/q", True), ("/q$", "/q/", False), ("/*/*.zip$", "/d/e/f.zip", True), ("/*/*.zip$", "/f.zip", False),
    ("/a$b", "/a$b", False), ("/p+(1)", "/p+(1)/x", True), ("/n?x=", "/n?x=9", True), ("/%C3%BC", "/%C3%BC/a", True), ("*", "/anything", True),
]


def allowed(spark, body, url, agent="Testbot/1.0"):
    rules = sets.robots_rules(spark.createDataFrame([("r.example.net", body)], "host string, body string"))
    return sets.robots_allowed(spark.createDataFrame([(f"https://r.example.net{url}", agent)], "url string, user_agent string"), rules).first()["allowed"]


@pytest.mark.parametrize(("pattern", "path", "match"), ROBOTS)
def test_robots_pattern(spark, pattern, path, match):
    assert allowed(spark, f"User-agent: *\nDisallow: {pattern}", path) is not match


@pytest.mark.parametrize(("body", "url", "agent", "want"), [
    # a group without rules is still the agent's own
    ("User-agent: *\nDisallow: /\n\nUser-agent: testbot\nCrawl-delay: 9", "/x", "Testbot/1.0", True),
    ("User-agent: *\nDisallow: /\n\nUser-agent: testbot\nCrawl-delay: 9", "/x", "Other", False),
    # wildcards and the end mark don't count as length: a tie, which allow wins
    ("User-agent: *\nDisallow: /*.bin$\nAllow: /blob", "/blob.bin", "x", True),
    ("User-agent: *\nDisallow: /*blobs.bin$\nAllow: /blob", "/blobs.bin", "x", False),
    # a blank line, a comment of its own and a crawl-delay end a row of agents
    ("User-agent: a\n\nUser-agent: testbot\nDisallow: /t", "/t", "a", True), ("User-agent: a\nUser-agent: testbot\nDisallow: /t", "/t", "a", False),
    ("User-agent: a\nCrawl-delay: 1\nUser-agent: testbot\nDisallow: /t", "/t", "a", True), ("User-agent: a\n# next\nUser-agent: testbot\nDisallow: /t", "/t", "a", True),
    # the longest token; groups of one token are one
    ("User-agent: test\nDisallow: /\n\nUser-agent: testbot\nAllow: /\n\nUser-agent: TESTBOT\nDisallow: /z", "/z/1", "Testbot/1.0", False),
    ("Disallow: /before\nUser-agent: *\nDisallow:", "/before", "x", True), ("", "/x", "x", True),
])
def test_robots_groups(spark, body, url, agent, want):
    assert allowed(spark, body, url, agent) is want


def test_robots_paths_equal_their_patterns(spark):
    rng, rules, urls = random.Random(6), [], []
    for i in range(60):
        path = "/" + "".join(rng.choice(["a", "b", "/", "*", "*", "ab", "$" if rng.random() < 0.2 else "a"]) for _ in range(rng.randrange(1, 7)))
        rules.append((f"h{i % 5}.example.net", rng.choice(["allow", "disallow"]), path))
        urls += [(f"https://h{i % 5}.example.net/" + "".join(rng.choice(["a", "b", "/", "ab"]) for _ in range(rng.randrange(8))), "x") for _ in range(3)]
    table = spark.createDataFrame([(h, 0, "*", d, p, i) for i, (h, d, p) in enumerate(rules)], "host string, group_id int, agent string, directive string, path string, line int")
    got = {r["url"]: r["allowed"] for r in sets.robots_allowed(spark.createDataFrame(urls, "url string, user_agent string"), table).collect()}
    for url, _ in urls:
        host, path = url.split("/")[2], "/" + url.split("/", 3)[3]
        hits = [(len(re.sub("[*$]", "", p)), d == "allow") for h, d, p in rules if h == host and re.match("^" + re.sub(r"([.+?^{}()|\[\]])", r"\\\1", p).replace("*", ".*"), path)]
        assert got[url] == (max(hits)[1] if hits else True), url


def test_many_robots_rules_on_one_host(spark):
    n = 100_000
    rules = spark.range(n).selectExpr("'h.example.net' host", "0 group_id", "'*' agent", "if(id % 2 = 0, 'disallow', 'allow') directive", "concat('/d', id, '/*a*a*a*b$') path", "cast(id as int) line")
    urls = spark.range(0, n, 100).selectExpr("concat('https://h.example.net/d', id, '/', repeat('a', 2000), if(id % 300 = 0, 'b', 'c')) url", "'x' user_agent")
    began = time.time()
    shut = sets.robots_allowed(urls, rules).where("not allowed").count()
    assert shut == len([i for i in range(0, n, 100) if i % 300 == 0]) and time.time() - began < 60


def test_walk_of_ten_thousand_pages(spark):
    n = 10_000
    pairs = spark.range(n).selectExpr("concat('p', id) url", "concat('p', if(id = 9999, 9000, id + 1)) next")
    began = time.time()
    out = pages.pagination_walk(pairs, spark.createDataFrame([("p0",), ("p9500",)], "start string"))
    rows = {(r["start"], r["url"]): r["step"] for r in out.collect()}
    assert time.time() - began < 60
    want = {("p0", f"p{i}"): i for i in range(n)}
    at, step = 9500, 0
    while ("p9500", f"p{at}") not in want:
        want["p9500", f"p{at}"] = step
        at, step = 9000 if at == 9999 else at + 1, step + 1
    assert rows == want


def test_chain_ends_equal_the_steps(spark):
    rng = random.Random(3)
    to = {i: rng.choice([None, rng.randrange(60)]) for i in range(60)}
    got = {r["url"]: (r["final"], r["hops"], r["loop"]) for r in chains.chain_ends(spark.createDataFrame([(f"{a:02d}", None if b is None else f"{b:02d}") for a, b in to.items()], "at string, to string")).collect()}
    for a, b in to.items():
        seen, at = [a], b
        while at is not None and at not in seen and to[at] is not None:
            seen.append(at)
            at = to[at]
        if b is not None:
            want = (f"{min(seen[seen.index(at):]):02d}", None, True) if at in seen else (f"{at:02d}", len(seen), False)
            assert got[f"{a:02d}"] == want, a
    assert len(got) == sum(b is not None for b in to.values())


def test_json_of_depth_two_hundred(spark):
    deep = "[" * 200 + '{"@type":"A","@graph":{"@type":["B"],"x":[{"y":"a <script> b"}],"n":1.50}}' + "]" * 200
    blocks = jsonld.jsonld_blocks(spark.createDataFrame([("u", 0, deep), ("u", 1, "[1, {"), ("u", 2, '{"a]":"}","@graph":[1,{"@type":"C"},[{"q\\"":2}]]}'), ("u", 3, '"text"')], "url string, block int, raw string"))
    rows = {(r["block"], tuple(r["at"])): r["node"] for r in blocks.select("block", "at", F.to_json("node").alias("node")).collect()}
    assert rows == {(0, (0,) * 201): '{"@type":["B"],"n":1.5,"x":[{"y":"a <script> b"}]}', (1, ()): None, (2, (1,)): '{"@type":"C"}', (2, (2, 0)): '{"q\\"":2}'}
    assert [r["path"] for r in jsonld.script_texts(blocks.where("node is not null")).collect()] == ["x[0].y"]


def test_alert_episodes(spark):
    # errors from 10:00 to 10:30 and from 14:00 on: two spells, however many windows each is in
    rows = [(f"2024-01-05 {h:02d}:{m:02d}:00", 500 if (h == 10 and m < 30) or (h == 14 and m < 10) else 200, 10) for h in range(8, 18) for m in range(0, 60, 5)]
    logs_ = spark.createDataFrame(rows, "timestamp string, status int, bytes_sent int")
    found = jobs.alert_episodes(logs_, spark.createDataFrame([("error_share", 0.2), ("server_error_share", 0.9), ("nothing", 0.0)], "metric string, most double")).collect()
    assert sorted((r["metric"], str(r["start"]), str(r["end"]), r["windows"], round(r["worst"], 3)) for r in found) == [("error_share", "2024-01-05 09:20:00", "2024-01-05 11:10:00", 6, 0.5)]


def test_days_are_written_once(spark, tmp_path):
    day = lambda d, n: spark.range(n).selectExpr(f"timestamp'2024-01-{d:02d} 10:00:00' timestamp", "id x")
    path = str(tmp_path / "days")
    writers.write_enriched(day(5, 3).union(day(6, 4)), path)
    writers.write_enriched(day(6, 2), path)
    assert {str(r["log_date"]): r["n"] for r in spark.read.parquet(path).groupBy("log_date").agg(F.count("*").alias("n")).collect()} == {"2024-01-05": 3, "2024-01-06": 2}


def test_robots_lint_by_group(spark):
    body = "\ufeffUser-agent: Googlebot-Image\nUser-agent: b\nCrawl-delay: 3\nDisallow: /assets/\n\nUser-agent: c\nCrawl-delay: 4\nDisallow: /x.css\nSitemap: map.xml # no\nSitemap: https://r.example.net/m.xml"
    found = sets.robots_lint(spark.createDataFrame([("r.example.net", body)], "host string, body string")).collect()
    assert sorted((r["rule"], r["detail"]) for r in found) == [("asset_blocked", "/assets/"), ("bom", ""), ("crawl_delay_for_googlebot", "3"), ("sitemap_not_absolute", "map.xml")]


def test_slugs(spark):
    titles = ["Crème Brûlée & Co.", "日本", "Admin", "", "a" * 10 + " " + "b" * 10, "Straße"]
    got = [one(spark, lambda c: urls.slugify(c, 15), t) for t in titles]
    assert got == ["creme-brulee-co", "untitled", "admin-2", "untitled", "a" * 10, "strasse"]
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-2"), (4, "x"), (5, "y")], "id long, base string")
    out = {r["id"]: r["slug"] for r in urls.assign_slugs(rows, spark.createDataFrame([("y",)], "slug string")).collect()}
    assert out == {1: "x", 2: "x-4", 3: "x-2", 4: "x-3", 5: "y-2"}
    taken = spark.createDataFrame([(x,) for x in ("z", "z-2", "z-4", "z-05")], "slug string")
    out = {r["id"]: r["slug"] for r in urls.assign_slugs(spark.createDataFrame([(i, "z") for i in range(4)], "id long, base string"), taken).collect()}
    assert out == {0: "z-3", 1: "z-5", 2: "z-6", 3: "z-7"}


def elements(spark, html):
    return pages.page_elements(spark.createDataFrame([("https://s.example.org/p", html)], "url string, html string"))


def test_elements_and_canonical_outside_head(spark):
    html = "<html lang=en><head><title>t</title><div></div><link rel='canonical' href='/x'></head><body><p>one<br>two<b>three</p></body></html>"
    e = pages.page_elements(spark.createDataFrame([("u", html), ("v", None)], "url string, html string"))
    rows = {r["tag"]: r for r in e.collect()}
    assert not rows["link"]["in_head"] and rows["title"]["in_head"] and [r["text"] for r in e.where("tag = '#text'").orderBy("seq").collect()] == ["t", "one", "two", "three"]
    fetches = spark.createDataFrame([("u", 200, None)], "url string, status int, link string")
    assert {r["rule"] for r in pages.canonical_audit(fetches, e).collect()} == {"outside_head", "missing"}


def test_text_inside_and_in_order(spark):
    e = elements(spark, "<body><h1><span>Big</span> <i>old</i> title</h1><a href=/n><span>Next</span> page<img alt=' arrow '></a><p>Hello <b>bold</b> world<nav>skip <a>x</a></nav>end")
    rows = {r["tag"]: r for r in e.collect()}
    assert (rows["h1"]["text"], rows["a"]["text"] or "x") == ("Big old title", "x") and [r["text"] for r in e.where("tag = 'a'").orderBy("seq").collect()] == ["Next page", "x"]
    assert e.where("tag = 'a' and alts = 'arrow'").count() == 1
    assert pages.visible_text(e).first()["text"] == "Big old title Next page Hello bold world end"


def test_end_tags_left_out(spark):
    e = elements(spark, "<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>e<p>f<div>g</div><table><tr><td>h<td>i<tr><td>j</table><dl><dt>k<dd>l<dt>m</dl><a href=1>n<a href=2>o</a><select><option>q<option>r</select>")
    rows = e.collect()
    tag, parent = {r["seq"]: r["tag"] for r in rows}, {r["seq"]: r["parent"] for r in rows}
    text = {r["text"]: r["parent"] for r in rows if r["tag"] == "#text"}
    up = lambda x: "/".join(reversed([tag[n] for n in iter_up(text[x], parent)]))
    assert [up(x) for x in "abcdefghijklmnoqr"] == [
        "ul/li", "ul/li/ul/li", "ul/li/ul/li", "ul/li", "p", "p", "div", "table/tr/td", "table/tr/td", "table/tr/td", "dl/dt", "dl/dd", "dl/dt", "a", "a", "select/option", "select/option",
    ]


def iter_up(n, parent):
    while n is not None:
        yield n
        n = parent[n]


def test_pages_stay_in_proportion(spark):
    n = 3000
    e = elements(spark, "<li>x" * n + "<a>y" * n + "<h2>z" * n + "<p>w" * n)
    assert e.agg(F.sum(F.length("text"))).first()[0] <= 10 * n and e.count() == 8 * n and "ancestors" not in e.columns


@pytest.mark.parametrize("html", ["<div class=a>", "<nav>", "<label>x", "<button><div><p>", "<a><table><td>", "</p><span>"])
def test_deep_pages_are_linear(spark, html):
    began = time.time()
    n = 100_000 // html.count("<")
    e = materialize(elements(spark, html * n), "test")
    assert e.agg(F.sum(F.length("text"))).first()[0] <= 4 * n and e.count() >= n
    assert pages.within(e, inside=pages.tagged("div", "nav", "label", "td", "span")).where("inside").count() >= n - 1
    assert time.time() - began < 60


def test_intervals_hold_descendants(spark):
    rng = random.Random(1)
    html = "".join(rng.choice(["<div class='card'>", "<nav>", "<main>", "<p>", "<aside>", "x", "</div>", "</nav>", "</main>", "<h2>", "</h2>", "<img>", "<table><tr><td>", "</table>"]) for _ in range(600))
    rows = pages.within(elements(spark, html), in_nav=pages.tagged("nav"), in_card=pages.attr("class") == "card").collect()
    by = {r["seq"]: r for r in rows}
    last = {r["seq"]: r["seq"] for r in rows}
    for r in rows:
        up = [by[n] for n in iter_up(r["parent"], {k: x["parent"] for k, x in by.items()})]
        assert r["in_nav"] == any(x["tag"] == "nav" for x in up) and r["in_card"] == any(x["attrs"].get("class") == "card" for x in up)
        for x in up:
            last[x["seq"]] = max(last[x["seq"]], r["seq"])
    assert all(r["last"] == last[r["seq"]] for r in rows) and sum(r["in_nav"] for r in rows) > 50


# RFC 3986, 5.4: references and what they are as seen from http://a/b/c/d;p?q.
RFC_EXAMPLES = """g:h g:h|g http://a/b/c/g|./g http://a/b/c/g|g/ http://a/b/c/g/|/g http://a/g|//g http://g|?y http://a/b/c/d;p?y|g?y http://a/b/c/g?y|#s http://a/b/c/d;p?q#s
g#s http://a/b/c/g#s|g?y#s http://a/b/c/g?y#s|;x http://a/b/c/;x|g;x http://a/b/c/g;x|g;x?y#s http://a/b/c/g;x?y#s| http://a/b/c/d;p?q|. http://a/b/c/|./ http://a/b/c/|.. http://a/b/|../ http://a/b/
../g http://a/b/g|../.. http://a/|../../ http://a/|../../g http://a/g|../../../g http://a/g|../../../../g http://a/g|/./g http://a/g|/../g http://a/g|g. http://a/b/c/g.|.g http://a/b/c/.g
g.. http://a/b/c/g..|..g http://a/b/c/..g|./../g http://a/b/g|./g/. http://a/b/c/g/|g/./h http://a/b/c/g/h|g/../h http://a/b/c/h|g;x=1/./y http://a/b/c/g;x=1/y|g;x=1/../y http://a/b/c/y
g?y/./x http://a/b/c/g?y/./x|g?y/../x http://a/b/c/g?y/../x|g#s/./x http://a/b/c/g#s/./x|g#s/../x http://a/b/c/g#s/../x|http:g http:g""".replace("\n", "|").split("|")


def test_references_resolve_as_the_rfc_says(spark):
    pairs = [tuple(x.split(" ")) for x in RFC_EXAMPLES]
    rows = spark.createDataFrame(pairs, "href string, want string").withColumn("got", u.resolve(F.lit("http://a/b/c/d;p?q"), F.col("href")))
    assert len(pairs) == 42 and rows.where("got is distinct from want").collect() == []
    more = [("http://a", "b", "http://a/b"), ("http://a/x/../y", "", "http://a/x/../y"), ("http://a/b?x", "//c/./d/../e?f", "http://c/e?f"), ("http://a/", "http://b/x/../y#z", "http://b/y#z"), ("http://a", None, None)]
    rows = spark.createDataFrame(more, "base string, href string, want string").withColumn("got", u.resolve(F.col("base"), F.col("href")))
    assert rows.where("got is distinct from want").collect() == []


def test_canonical_rules(spark):
    host = "https://s.example.org"
    head = lambda *hrefs, before="": "<html><head>" + before + "".join(f'<link rel=canonical href="{h}">' for h in hrefs) + "</head><body></body></html>"
    cases = [
        ("/self", None, 200, None, head(host + "/self"), []), ("/root", host, 200, None, head(host + "/"), []), ("/none", None, 200, None, head(), ["missing"]),
        ("/slash", None, 200, None, head(host + "/slash/#top"), []), ("/é", None, 200, None, head(host + "/%C3%A9"), []),
        ("/p/1", None, 200, None, head("/p/1", host + "/p/1"), ["multiple_same", "relative"]), ("/p/2", None, 200, None, head(host + "/P/2", host + "/p/2"), ["conflicting", "not_self"]),
        ("/r", None, 200, None, head("../other"), ["not_self", "relative"]), ("/b", None, 200, None, head("b", before='<base href="https://c.example.net/">'), ["cross_host", "not_self", "relative"]),
        ("/bb", None, 200, None, '<body><base href="https://c.example.net/"><p>', ["missing"]), ("/t", host + "/t?utm_source=a&b=1", 200, None, head(host + "/t?b=1"), []),
        ("/u", None, 200, None, head(host + "/u?utm_source=a"), ["tracking_in_canonical"]), ("/h", None, 200, f'<{host}/h>; rel="canonical"', head(), []),
        ("/i", None, 200, f'<{host}/j>; rel="canonical"', head(host + "/i"), ["conflicting"]), ("/e", None, 200, None, head(""), ["empty"]), ("/m", None, 200, None, head("mailto:x@y.z"), ["non_http", "relative"]),
        ("/o", None, 200, None, "<head></head><body><link rel=canonical href=/o>", ["missing", "outside_head"]), ("/gone", None, 410, None, head("mailto:x"), ["non_success"]), ("/failed", None, None, None, None, []),
        ("/moved", None, 301, None, head(host + "/moved"), []), ("/from", host + "/to", 200, None, head(host + "/from"), ["not_self"]),
    ]
    rows = spark.createDataFrame([(host + p, f, s, link, html) for p, f, s, link, html, _ in cases], "url string, final_url string, status int, link string, html string")
    found = pages.canonical_audit(rows, pages.page_elements(rows)).collect()
    got = {host + p: sorted(r["rule"] for r in found if r["url"] == host + p) for p, *_ in cases}
    assert got == {host + p: want for p, *_, want in cases}


def test_words_count_scripts_without_blanks(spark):
    assert [one(spark, pages.count_words, x) for x in ("two words 日本語", None, "안녕하세요 세계", "ｶﾅ x", "かな漢字")] == [5, 0, 2, 3, 4]
    debt = pages.rendering_debt(spark.createDataFrame([("a", "x y 漢"), ("b", "")], "url string, text string"), spark.createDataFrame([("a", "X y y 漢字"), ("b", "")], "url string, text string"))
    assert {r["url"]: r["debt"] for r in debt.collect()} == {"a": 0.4, "b": 0.0}


def rules_of(found, *columns):
    return sorted(tuple(r[c] for c in ("rule", *columns)) for r in found.collect())


def test_head_rules_on_html(spark):
    html = """<html><head><title>Home</title><title>b</title><link rel=canonical href="https://b.example.org/q"><meta name=viewport content="maximum-scale=1.0"><meta charset="latin1">
        <meta name=description content=a><meta name=description content=b><meta property="og:title" content=t></head><body></body></html>"""
    url = "https://s.example.org/p"
    fetches = spark.createDataFrame([(url, 200, True, "googlebot: none"), ("https://s.example.org/bare", 200, True, None)], "url string, status int, should_index boolean, x_robots_tag string")
    e = pages.page_elements(spark.createDataFrame([(url, html), ("https://s.example.org/bare", "<head><title> </title></head>")], "url string, html string"))
    found = pages.head_audit(pages.head_facts(e), fetches)
    assert rules_of(found.where(F.col("url") == url)) == [(x,) for x in sorted(["multiple_titles", "generic_title", "canonical_host_mismatch", "canonical_unreachable", "noindex_on_indexable_page", "noindex_with_external_canonical", "multiple_descriptions", "viewport_blocks_zoom", "non_utf8_charset", "missing_og_image", "missing_og_url", "missing_twitter_card"])]
    assert rules_of(found.where(F.col("url") != url)) == [(x,) for x in sorted(["empty_title", "missing_canonical", "missing_description", "missing_og_title", "missing_og_image", "missing_og_url", "missing_twitter_card", "missing_viewport", "missing_charset"])]


def test_http_rules_on_html(spark):
    schema = "url string, final_url string, status int, hops int, content_type string, cache_control string, x_robots_tag string, etag string, last_modified string, link string, conditional_status int, in_sitemap boolean, html string"
    html = '<head><meta name="robots" content="index"><meta name="robots" content="x, NOINDEX"><link rel="canonical" href="../c"><link rel=stylesheet href="http://c.example.net/s.css"></head><video src="http://c.example.net/v"></video>'
    rows = [
        ("https://s.example.org/a/b", "", 200, 4, "Text/HTML", "private, NO-STORE, max-age=604801", "NOINDEX", None, "yesterday", '<https://s.example.org/z>; rel="canonical"', 200, True, html),
        ("https://s.example.org/m.xml", "", 200, 0, "text/html", "", "", "e", "", "", 304, True, ""), ("https://s.example.org/robots.txt", "", 200, 0, "text/html", "", "", "e", "", "", None, True, ""),
        ("https://s.example.org/gone", "", 404, 0, "text/html; charset=utf-8", "", "noindex", "", "", "", None, True, "page not found"), ("https://s.example.org/none", "", 0, 0, None, None, None, None, None, None, None, True, None),
        ("https://s.example.org/soft", "", 200, 0, "text/html; charset=utf-8", "max-age=604800", "", "", "", "", None, False, "Sorry: PAGE NOT FOUND"), ("http://s.example.org/plain", "", 500, 3, "text/html; charset=utf-8", "", "", "", "", "", None, False, html),
    ]
    fetches = spark.createDataFrame(rows, schema)
    found = {}
    for r in pages.http_audit(fetches, pages.page_elements(fetches)).collect():
        found.setdefault(r["url"].rsplit("/", 1)[1], set()).add((r["rule"], r["detail"]))
    assert found == {
        "b": {("redirect_chain_too_long", "4"), ("no_store_on_html_disables_bfcache", ""), ("long_max_age_on_html", "604801"), ("noindex_in_response_header", "NOINDEX"), ("noindex_in_meta_tag", "x, NOINDEX"), ("mixed_content_on_https", "2"), ("canonical_signal_conflict", "https://s.example.org/z"), ("html_missing_charset", "Text/HTML"), ("conditional_request_not_honored", "200")},
        "m.xml": {("sitemap_wrong_content_type", "text/html")}, "robots.txt": {("robots_wrong_content_type", "text/html")}, "gone": {("sitemap_url_returns_404", "404")}, "none": {("final_response_unreachable", "")},
        "soft": {("possible_soft_404", ""), ("no_conditional_request_headers", "")}, "plain": {("server_error", "500")},
    }


def test_semantic_rules_on_html(spark):
    e = elements(spark, '<html><body><div class="modal-box"><h2>m</h2></div><main hidden></main><main></main><h1>a</h1><h1>b</h1><h4>deep</h4><nav><h2>n</h2></nav><a>c</a><a href="javascript:x()">d</a><a href="/ok" aria-label="l"></a><button title="t"></button><img alt="">')
    got = rules_of(pages.semantic_audit(e), "detail")
    assert got == [("anchor_non_crawlable_href", "javascript:x()"), ("anchor_without_href", ""), ("heading_inside_nav", "n"), ("heading_inside_ui_component", "m"), ("missing_footer", ""), ("missing_header", ""), ("missing_html_lang", ""), ("multiple_h1", "2"), ("skipped_heading_level", "deep")]


def test_pagination_rules_on_html(spark):
    start, html = "https://s.example.org/l", {
        "": '<link rel=canonical href="https://S.example.org:443/l"><a rel=next href="l?page=2"><b>more</b></a>',
        "?page=2": '<link rel=canonical href="/l"><nav aria-label="Pagination"><a href="/l">1</a><a href="?page=3" aria-label="next page">&gt;</a></nav>',
        "?page=3": '<link rel=canonical href="/other"><div class="my-pagination"><span role=link>4</span></div>', "?page=4": "<a href=/x>text</a>", "?page=5#f": "x", "?page=6": "x",
    }
    e = pages.page_elements(spark.createDataFrame([(start + k, v) for k, v in html.items()], "url string, html string"))
    listed = spark.createDataFrame([(start + k, start, {"?page=5#f": 404, "?page=6": None}.get(k, 200)) for k in html], "url string, start string, status int")
    found = {}
    for r in pages.pagination_audit(listed, e).collect():
        found.setdefault(r["url"].removeprefix(start), set()).add(r["rule"])
    assert found == {"?page=2": {"canonical_points_to_page_one"}, "?page=3": {"canonical_not_self", "js_only_pagination", "no_page_one_backlink"}, "?page=4": {"no_canonical", "no_pagination_links", "no_page_one_backlink"}, "?page=5#f": {"fragment_in_url", "non_200_status"}, "?page=6": {"page_load_failed"}}
    walk = pages.pagination_walk(pages.pagination_links(e).select("url", "next"), listed.select("start").distinct())
    assert sorted((r["step"], r["url"].removeprefix(start)) for r in walk.collect()) == [(0, ""), (1, "?page=2"), (2, "?page=3")]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "url string, next string")
    with pytest.raises(RuntimeError):
        pages.pagination_walk(chain, spark.createDataFrame([("a",)], "start string"), most=2)


def test_locale_probe_rules(spark):
    schema = "url string, locale string, probe int, status int, final_url string, lang string, title string, h1 string, canonical string, hreflangs array<string>"
    p = "https://s.example.org/de/"
    rows = [(p, "de", 0, None, None, None, None, None, None, None), (p, "de", 1, 200, p, "de-AT", "T", "H", "", None), (p, "de", 2, 200, "https://s.example.org/ja/", "ja", "T2", "H", "", None), (p + "x", "de", 0, 200, p + "x#f", "en", "T", "H", "/de/y", ["/fr/x"]), (p + "x", "de", 1, 503, p + "x", "", "", "", "", None)]
    found = pages.locale_probe_audit(spark.createDataFrame(rows, schema))
    assert rules_of(found.where(F.col("url") == p), "detail") == [("locale_adaptive_content", "ja"), ("locale_url_redirects", "https://s.example.org/ja/"), ("no_canonical", ""), ("no_hreflang_annotations", ""), ("probe_failed", "0"), ("title_varies_by_accept_language", "T2")]
    assert rules_of(found.where(F.col("url") != p), "detail") == [("canonical_not_self", "/de/y"), ("html_lang_mismatch", "en"), ("no_self_hreflang", ""), ("non_200_status", "503")]


def jsonld_findings(spark, raw):
    blocks = jsonld.jsonld_blocks(spark.createDataFrame([("u", 0, raw)], "url string, block int, raw string"))
    return rules_of(jsonld.validate_jsonld(blocks), "detail")


@pytest.mark.parametrize(("raw", "want"), [
    ('{"@type":"Restaurant","name":"r","address":{},"url":"/"}', [("localbusiness_missing_address", "Restaurant")]), ('{"@type":"TechArticle","headline":"h","image":"i","datePublished":"d"}', [("article_missing_author", "TechArticle")]),
    ('{"@type":"Product","name":"","image":["i"],"sku":"s","review":{"a":1},"offers":[{"price":null,"priceCurrency":"EURO"},{"price":0,"priceCurrency":"EUR","availability":"http://schema.org/SoldOut"}],"aggregateRating":{"ratingCount":3}}',
        [("offer_invalid_currency", "EURO"), ("offer_missing_availability", "Offer"), ("product_missing_name", "Product"), ("rating_missing_value", "AggregateRating")]),
    ('{"@type":"Question"}', []), ('{"name":"no type <script>"}', []), ('[[[[[[{"@graph":{"@type":"Quiz"}}]]]]]]', [("deprecated_type", "Quiz")]), ("{", [("invalid_json", "")]),
    ('{"@type":"BreadcrumbList","itemListElement":[{"position":1,"name":"a"},{"position":1,"name":""},{"name":"c"},{"position":1,"name":"d"}]}', [("breadcrumb_duplicate_position", "1"), ("breadcrumb_duplicate_position", "1"), ("breadcrumb_item_missing_name", "1"), ("breadcrumb_item_missing_position", "2")]),
    ('{"@type":"BreadcrumbList","itemListElement":[]}', [("breadcrumb_missing_items", "")]), ('{"@type":"Event","name":"e","startDate":"d","location":[{"x":["< /SCRIPT>"]}]}', [("unsanitized_user_content", "location[0].x[0]")]),
])
def test_jsonld_rules(spark, raw, want):
    assert jsonld_findings(spark, raw) == want


def test_schema_consistency_rules(spark):
    html = '<script type="application/ld+json">{}</script><nav>Home / Shoes</nav>{}<p>{}</p>'
    made = {
        "a": ('[{"@type":"Product","name":"Red  Shoe","offers":{"price":"1234.5","priceCurrency":"EUR","availability":"https://schema.org/SoldOut"}},{"@type":"BreadcrumbList","itemListElement":[{"name":"Home"},{"name":"Hats"}]}]', "<h1>red shoe XL</h1>", "1.234,50 sold out"),
        "b": ('[{"@type":"Product","name":"Hat"},{"@type":"Offer","price":"7","priceCurrency":"EUR","availability":"https://schema.org/OutOfStock"}]', "", "8 only, add to bag"),
    }
    e = pages.page_elements(spark.createDataFrame([(k, html.format(*v)) for k, v in made.items()], "url string, html string"))
    from siteloom.plans.audits import page_texts

    found = jsonld.schema_consistency(jsonld.jsonld_blocks(jsonld.jsonld_scripts(e)), page_texts(e))
    assert rules_of(found.where("url = 'a'"), "detail") == [("breadcrumb_item_not_visible", "hats")]
    assert rules_of(found.where("url = 'b'"), "detail") == [("name_no_h1", "hat"), ("price_mismatch", "7"), ("stock_conflict", "https://schema.org/OutOfStock"), ("stock_mismatch", "https://schema.org/OutOfStock")]


def test_speculation_rules(spark):
    rules = ['{"prerender":[{"where":{"or":[{"and":[{"not":{"href_matches":["/logout","/x/*"]}}]},{"selector_matches":".go"}]},"eagerness":"immediate"}]}', '{"prerender":[{"urls":["/a","https://o.example.net/b"]}],"prefetch":[{"where":{"href_matches":"/*"}}]}', "{"]
    found = jsonld.speculation_audit(elements(spark, "".join(f'<script type="speculationrules">{r}</script>' for r in rules)))
    assert rules_of(found, "severity", "detail") == [
        ("cross_origin", "medium", "prerender 1 https://o.example.net/b"), ("default_immediate", "medium", "prerender 1"), ("immediate_broad_pattern", "high", "prerender 0 /x/*"), ("immediate_selector", "high", "prerender 0 selector:.go"), ("invalid_json", "high", ""), ("one_time_action", "high", "prerender 0 /logout"),
    ]


def test_page_assertions_on_html(spark):
    html = "<head><title> T </title><link rel=canonical href=/c><meta property=og:image content=i><script type='application/ld+json'>{}</script><script type='application/ld+json'>{</script></head>" + "x" * 500
    rows = [("https://s.example.org/a", 200, 200, None, "", "", html), ("https://s.example.org/b", 302, 301, "https://s.example.org/t", "t/", "", ""), ("https://s.example.org/c", 200, 410, None, "", "", html), ("https://s.example.org/d", 200, 200, None, "", "NoIndex", "short")]
    fetches = spark.createDataFrame(rows, "url string, status int, expect_status int, expect_redirect_to string, location string, x_robots_tag string, html string")
    e = pages.page_elements(fetches)
    got = {}
    for r in pages.page_assertions(fetches, pages.head_facts(e), jsonld.jsonld_scripts(e)).collect():
        got.setdefault(r["url"][-1], {})[r["name"]] = r["passed"]
    assert got["a"] == {"status_code": True, "x_robots_tag_not_noindex": True, "non_empty_body": True, "title_tag": True, "meta_description": False, "canonical_tag": False, "jsonld_present": True, "jsonld_parses": False, "meta_og_title": False, "meta_og_description": False, "meta_og_image": True}
    assert got["b"] == {"status_code": False, "redirect_target": True} and got["c"] == {"status_code": False} and got["d"] == {"status_code": True, "x_robots_tag_not_noindex": False, "non_empty_body": False}


def test_facet_tiers(spark):
    registry = urls.register_facets(spark.createDataFrame([("boots", {"Size": "42 "})], "category_slug string, facets map<string,string>"))
    rows = [(1, {}), (2, {"gclid": "x"}), (3, {"view": "grid", "sid": "1"}), (4, {"size": "42", "sort": "new", "utm_term": "t"}), (5, {"size": "43"}), (6, {"size": "42", "page": "2"})]
    out = {r["id"]: (r["tier"], r["canonical"], r["robots"]) for r in urls.classify_facets(spark.createDataFrame([(i, "boots", p) for i, p in rows], "id int, category_slug string, params map<string,string>"), registry).collect()}
    base = "https://example.com/category/boots"
    assert out == {1: (1, base, "index, follow"), 2: (2, base, "index, follow"), 3: (2, base, "index, follow"), 4: (1, f"{base}?size=42", "index, follow"), 5: (3, None, "noindex, follow"), 6: (3, None, "noindex, follow")}


def test_product_jsonld_cannot_end_its_script(spark):
    row = spark.sql("SELECT 1 AS id, 'a </script><b>&' AS name, null AS description, 's' AS sku, 'i' AS image, 2.5 AS price, 'EUR' AS currency, true AS in_stock, null AS brand, 4.0 AS rating, 0 AS reviews")
    text = records.build_product_jsonld(row).first()["jsonld"]
    assert not set("<>&") & set(text) and r"a \u003c/script\u003e\u003cb\u003e\u0026" in text and json.loads(text)["name"] == "a </script><b>&"
    assert "</script>" in records.build_product_jsonld(row, strict=False).first()["jsonld"]


def test_many_ranges_are_looked_up_by_address(spark, sf_dir, monkeypatch):
    from siteloom.plans.views import view

    rows, ranges = view(spark, sf_dir, "v_logs"), view(spark, sf_dir, "v_ranges")
    want = sorted(tuple(r) for r in logs.verify_crawler(rows, ranges).select("event_id", "verified_crawler").collect())
    monkeypatch.setattr(logs, "FEW_RANGES", 0)
    assert sorted(tuple(r) for r in logs.verify_crawler(rows, ranges).select("event_id", "verified_crawler").collect()) == want


def test_loops_do_not_end_silently(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1), "") for i in range(6)], "src string, dst string, anchor string")
    assert sorted((r["url"], r["depth"]) for r in graph.click_depth(chain, "0").collect()) == [(str(i), i) for i in range(7)]
    with pytest.raises(RuntimeError):
        graph.click_depth(chain, "0", max_depth=4)
    with pytest.raises(RuntimeError):
        graph.pagerank(spark.createDataFrame([(str(i),) for i in range(7)], "url string"), chain, max_iter=1)
    with pytest.raises(RuntimeError):
        readers.expand_sitemaps(spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "c")], "sitemap string, child string"), spark.createDataFrame([("c", "u")], "sitemap string, loc string"), "r", depth=2)


def test_jsonld_graph(spark):
    blocks = jsonld.jsonld_blocks(spark.createDataFrame([("u", 0, '[{"@graph":[{"@type":"A"},{"@type":["B","C"]}]}]'), ("u", 1, "{")], "url string, block int, raw string"))
    assert sorted(tuple(r["types"]) for r in blocks.collect()) == [(), ("A",), ("B", "C")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml"><url><loc> https://e.com/a </loc><lastmod>2024-01-01</lastmod><xhtml:link rel="alternate" hreflang="EN" href="https://e.com/en"/><xhtml:link rel="alternate" hreflang="en" href="https://e.com/en2"/></url></urlset>')
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>s1</loc></sitemap><sitemap><loc>s2</loc></sitemap></sitemapindex>")
    (tmp_path / "r.json").write_text('{"prefixes":[{"ipv4Prefix":"1.0.0.0/8"},{"ipv6Prefix":"2001::/16"},{"ipv4Prefix":"bad"}]}')
    (tmp_path / "l.txt").write_text("# c\n\n https://e.com/ \n")
    assert [tuple(r)[2:] for r in readers.read_sitemaps(spark, str(tmp_path / "s.xml")).collect()] == [("https://e.com/a", "2024-01-01")]
    assert [tuple(r) for r in readers.read_hreflang(spark, str(tmp_path / "s.xml")).collect()] == [("https://e.com/a", "en", "https://e.com/en2")]
    assert sorted(r["child"] for r in readers.read_sitemap_index(spark, str(tmp_path / "i.xml")).collect()) == ["s1", "s2"]
    index = spark.createDataFrame([("root", "s1"), ("s1", "root"), ("s1", "s2")], "sitemap string, child string")
    entries = spark.createDataFrame([("s2", "u"), ("other", "v")], "sitemap string, loc string")
    assert [r["loc"] for r in readers.expand_sitemaps(index, entries, "root").collect()] == ["u"]
    assert sorted(r["cidr"] for r in readers.read_ip_ranges(spark, str(tmp_path / "r.json"), "x").collect()) == ["1.0.0.0/8", "2001::/16"]
    assert [r["url"] for r in readers.read_url_list(spark, str(tmp_path / "l.txt")).collect()] == ["https://e.com/"]
    report = spark.createDataFrame([("u", ["a", "b"])], "url string, issues array<string>")
    writers.write_report(report, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()["issues"] == "a; b"
    writers.write_report(report, str(tmp_path / "json"), "json")
    assert tuple(spark.read.json(str(tmp_path / "json")).select("url", "issues").first()) in (("u", ["a", "b"]), ("u", "a; b"))
    writers.write_enriched(spark.sql("SELECT timestamp'2024-01-05 10:00:00' AS timestamp, 1 AS x"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).where("log_date = '2024-01-05'").count() == 1
    rows = spark.sql("SELECT 'u' AS url, named_struct('indexStatusResult', named_struct('verdict', 'PASS', 'coverageState', 'ok', 'googleCanonical', 'a', 'userCanonical', 'b', 'lastCrawlTime', 't')) AS inspectionResult")
    assert readers.flatten_inspections(rows).first()["canonical_differs"]


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    """Enrichment of a stream gives the rows of the batch; the freshness state is kept by batch."""
    from siteloom.plans.logs import raw_lines
    from siteloom.plans.views import view

    raw_lines(spark, sf_dir).write.text(str(tmp_path / "in"))
    ranges = view(spark, sf_dir, "v_ranges")
    jobs.enrich_stream(jobs.stream_lines(spark, str(tmp_path / "in")), ranges, str(tmp_path / "out"), str(tmp_path / "mark"), None).awaitTermination()
    good, _ = logs.parse_logs(readers.read_log_lines(spark, str(tmp_path / "in")))
    batch = logs.enrich_logs(good, ranges)
    out = spark.read.parquet(str(tmp_path / "out")).select(batch.columns)
    assert out.count() == batch.count() > 0 and out.exceptAll(batch).count() == 0
    schema, found, mark = "url string, lastmod string, content_hash string, last_seen string", str(tmp_path / "found"), str(tmp_path / "fmark")
    seen = [
        [("u", "2024-01-01", "a", "1"), ("u", "2023-01-01", "old", "0"), ("u", "2024-01-01", "a", "1"), ("w", "", "x", "1")], [("v", "2024-01-09", "b", "2"), ("w", "", "y", "2")],
        [("u", "2024-02-01", None, "3"), ("u", "2024-02-01", None, "3"), ("v", "2024-02-09", "b", "3")], [("u", "2024-02-01", "c", "4"), ("w", "bad", "y", "4")],
    ]
    state, want = spark.createDataFrame([], schema), []
    for rows in seen:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "fresh"))
        jobs.freshness_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "fresh")), found, mark).awaitTermination()
        last = {r[0]: r for r in sorted(rows, key=lambda r: r[3])}
        met, state = sets.freshness(spark.createDataFrame(list(last.values()), schema), state)
        state = materialize(state, "test")
        want += [tuple(r) for r in met.collect()]
    assert sorted(tuple(r) for r in spark.read.parquet(found).select("url", "severity", "rule", "detail").collect()) == sorted(want)
    assert {r[2] for r in want} == {"overactive_lastmod", "stale_lastmod", "lastmod_missing", "lastmod_format"}
    kept = sorted(tuple(r) for r in jobs.freshness_state(spark, mark).collect())
    assert kept == sorted(tuple(r) for r in state.collect()) == [("u", "2024-02-01", "c", "4"), ("v", "2024-02-09", "b", "3"), ("w", "bad", "y", "4")]


def test_all_links_are_in_the_graph(spark, sf_dir):
    from siteloom.plans.views import table, view

    found: dict = {}
    for order, line, part in table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").collect():
        found.setdefault((order, line), []).append(part)
    want = {(f"/p/{p + (p % 17 == 0)}", f"/p/{q + (q % 20 == 0)}") for (o, n), ps in found.items() for p in ps for q in found.get((o, n + 1), [])}
    assert {tuple(r) for r in view(spark, sf_dir, "v_links").select("source_url", "target_url").collect()} == want
    assert not any(int(a[3:]) % 17 == 0 or int(b[3:]) % 20 == 0 for a, b in want)


def test_pagerank_converges_like_a_power_iteration(spark, sf_dir):
    from siteloom.plans import graph as plan
    from siteloom.plans.views import view

    vertices, links = graph.build_graph(view(spark, sf_dir, "v_links"), ok_only=True, drop_self=True)
    urls_, pairs = sorted(r[0] for r in vertices.collect()), [(r["src"], r["dst"]) for r in links.collect()]
    out = {a: 0 for a in urls_}
    for a, _ in pairs:
        out[a] += 1
    n, rank, change = len(urls_), dict.fromkeys(urls_, 1 / len(urls_)), 1.0
    while change >= 1e-6:
        new = dict.fromkeys(urls_, 0.15 / n + 0.85 * sum(rank[u] for u in urls_ if not out[u]) / n)
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / out[a]
        change, rank = sum(abs(new[u] - rank[u]) for u in urls_), new
    got = {r["url"]: r["rank"] for r in plan.ENTRIES["pagerank_converged"][0](spark, sf_dir).collect()}
    assert set(got) == set(rank) and max(abs(got[u] - rank[u]) for u in urls_) < 1e-9


def test_header_canonicals_keep_their_digits(spark):
    """F1, F8: blanks alone are cut off the targets of Link headers, not the place in the list."""
    rows = spark.createDataFrame([("https://s.example.org/c/100", 200, "< https://o.example.org/c/100 >; rel=canonical, <0/10>; rel=canonical", "")], "url string, status int, link string, html string")
    found = {(r["rule"], r["detail"]) for r in pages.canonical_audit(rows, pages.page_elements(rows)).collect()}
    assert found == {("conflicting", ""), ("cross_host", "https://o.example.org/c/100"), ("not_self", "https://o.example.org/c/100")}


def _small(spark, tmp_path, table, rows, schema):
    """A folder of tables with just this one."""
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    return str(tmp_path)


def _like_sql(spark, sf_dir, table, *names):
    import duckdb

    import __spark_entry__ as entry

    from .compare import same

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet/*.parquet'")
    for name in names:
        same(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir)


PAGES = "page_id bigint, url string, html string"


def test_references_without_semicolon(spark, tmp_path):
    """HTML reads `&amp` as `&amp;`; the queries take the references of their SQL, if they end in a semicolon."""
    html = '<html><head><meta charset="utf-8"><title>a &amp;&amp; b&amp&lt;&amp</title><script>x && y &amp; z</script></head><body><p>R&D &amp;amp c&amp</p><article>d&ampe; &quot&quot; &#39&#39;</article></body></html>'
    _like_sql(spark, _small(spark, tmp_path, "pages", [(1, "u", html)], PAGES), "pages", "head_facts", "visible_text", "content_hash")
    page = spark.createDataFrame([("u", "<script>a && b &amp;</script><a href='?a=1&lt=2&amp;b&amp'>x&ltz&amp;</a>")], "url string, html string")
    got = lambda **how: {r["tag"]: (r["attrs"], r["text"]) for r in pages.page_elements(page, ("a", "script"), **how).collect()}
    assert got(references=("amp",)) == {"script": ({}, "a && b &amp;"), "a": ({"href": "?a=1&lt=2&b&amp"}, "x&ltz&")}
    assert got()["script"] == ({}, "a && b &amp;") and got()["a"][1] == "x<z&"


def test_walks_stay_on_stored_pages(spark, tmp_path):
    """the last list is not whole; its last page has no next one."""
    _like_sql(spark, _small(spark, tmp_path, "pages", [(i, f"u{i}", "") for i in range(13)], PAGES), "pages", "pagination_walk")


def test_pages_of_one_url_have_their_own_state(spark, tmp_path):
    """each has its row; F7: where a URL is there once, the findings are those of the SQL."""
    rows = [(i, f"u{min(i, 20)}", "") for i in range(23)]
    sf_dir = _small(spark, tmp_path, "pages", rows, PAGES)
    _like_sql(spark, sf_dir, "pages", "stream_freshness")
    import __spark_entry__ as entry

    met = entry.queries()["stream_freshness_findings"](spark, sf_dir).where("url = 'u20'")
    got = sorted((r["rule"], r["detail"]) for r in met.collect())
    assert got == sorted([("lastmod_missing", "")] * 3 + [("lastmod_format", f"0{k}/01/2024") for k in (1, 2, 3)] + [("stale_lastmod", f"0{k}/01/2024") for k in (2, 3)])


def test_words_are_counted_fast_and_alike(spark):
    """Texts without Chinese or Japanese characters don't pay for these."""
    rng = random.Random(5)
    signs = ["a", "Zz", "9", "_", "é", "ß", "한", "국", "漢", "字", "か", "ー", "・", "゛", "ｱ", "-", ".", "\U0001F600", " ", "  ", "\t", "\n", " ", "　", "\x0b"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(400)] + ["", None]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "url string, text string")
    plain = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"[{pages.UNSPACED}]|[^\s{pages.UNSPACED}]+"), F.lit(0)))
    assert rows.where(pages.count_words(F.col("text")) != plain).count() == 0
    word = rf"[{pages.UNSPACED}]|[\p{{L}}\p{{N}}_&&[^{pages.UNSPACED}]]+"
    half = rows.selectExpr("url", "substr(text, 1, length(text) div 2) text")
    lists = rows.join(half.withColumnRenamed("text", "half"), "url").select("url", *(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(word), F.lit(0)).alias(c) for c in ("half", "text")))
    debts = {r["url"]: r["debt"] for r in pages.rendering_debt(half, rows).collect()}
    for r in lists.collect():
        lacking = sum(max(r["text"].count(w) - r["half"].count(w), 0) for w in set(r["text"]))
        assert debts[r["url"]] == (round(lacking / len(r["text"]), 6) if r["text"] else 0)
    long = spark.range(8).select(F.repeat(F.concat(F.lit("some words of "), "id", F.lit(" text, ")), F.lit(100_000)).alias("text"))

    def seconds(column):
        began = time.time()
        long.select(F.sum(column)).collect()
        return time.time() - began

    assert min(seconds(pages.count_words(F.col("text"))) for _ in range(2)) < 0.5 * seconds(plain)


def test_graph_is_made_once(spark, sf_dir):
    """Reports read the written graph, not the line items again; links are lists of bounded length."""
    from siteloom.plans import graph as plan

    for name in ("at_risk", "link_report", "graph_verdict", "all_links_report", "unreachable", "depth_buckets"):
        assert not [f for f in plan.ENTRIES[name][0](spark, sf_dir).inputFiles() if "lineitem" in f]
    hub = spark.range(10_000).selectExpr("'hub' src", "concat('p', id) dst").union(spark.createDataFrame([("p1", "hub"), ("p2", "p1")], "src string, dst string"))
    numbered, lists = graph.numbered_graph(hub.select(F.col("src").alias("url")).union(hub.select("dst")).distinct(), hub)
    id_of = {r["url"]: r["id"] for r in numbered.collect()}
    got = lists.collect()
    assert sorted((r["src"], d) for r in got for d in r["targets"]) == sorted((id_of[a], id_of[b]) for a, b in hub.collect())
    assert len(got) == 5 and max(len(r["targets"]) for r in got) < graph.LISTED
    assert {r["url"]: r["links"] for r in numbered.where("links is not null").collect()} == {"hub": 10_000, "p1": 1, "p2": 1}


def test_link_report_is_made_of_the_numbered_graph(spark):
    """one numbered graph serves all parts of the report, no part writes or joins addresses of links again."""
    edges = spark.createDataFrame(
        [("h", "a", 200, "x"), ("a", "b", 200, "x"), ("b", "b", 200, "x"), ("c", "a", 200, "x"), ("a", "h", 404, "x"), (None, "b", 200, "x")],
        "source_url string, target_url string, target_status_code int, anchor string",
    )
    known = spark.createDataFrame([("a",), ("z",), ("n",)], "url string")
    made, write = [], graph.materialize
    graph.materialize = lambda df, tag: made.append(tag) or write(df, tag)
    try:
        report = {r["url"]: r for r in graph.link_report(edges, "h", known, rounds=3).collect()}
        away = {r["url"]: r for r in graph.link_report(edges, "n", known, rounds=3).collect()}
    finally:
        graph.materialize = write
    assert made.count("links") == 2 and made.count("lists") == 2
    got = {u: tuple(r[c] for c in ("depth", "in_degree", "out_degree", "broken_links", "orphan")) for u, r in report.items()}
    assert got == {
        "h": (0, 0, 1, 0, False), "a": (1, 2, 1, 1, False), "b": (2, 1, 0, 0, False), "c": (None, 0, 1, 0, True), None: (None, 0, 0, 0, False),
        "z": (None, 0, 0, 0, True), "n": (None, 0, 0, 0, True),
    }
    assert away["n"]["depth"] == 0 and away["n"]["rank"] is None and away["n"]["orphan"] and away["h"]["depth"] is None


def test_small_fronts_do_not_sort_the_links(spark, sf_dir):
    """the homepage and the pages seen are known to be few, so links are not shuffled or sorted for them; they are written once."""
    from siteloom.plans import graph as plan

    made, write = [], graph.materialize
    graph.materialize = lambda df, tag: made.append((tag, df._jdf.queryExecution().executedPlan().toString())) or write(df, tag)
    try:
        plan.ENTRIES["at_risk"][0](spark, sf_dir)
    finally:
        graph.materialize = write
    fronts = [p for tag, p in made if tag == "front"]
    assert len(fronts) > 2 and not [p for p in fronts if "SortMergeJoin" in p] and [tag for tag, _ in made].count("links") == 1
