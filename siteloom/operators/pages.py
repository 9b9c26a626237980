"""Page audits. HTML is parsed once, into a table of elements; facts are aggregates of it
and rules are projections of the facts and the stored fetches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u
from .chains import walk
from .findings import findings

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_TAGS = frozenset("base link meta noscript script style template title head html".split())
ELEMENTS = "url string, seq int, last int, parent int, tag string, attrs map<string,string>, text string, alts string, in_head boolean"
TEXT = "#text"

# What a start tag ends, and what it doesn't reach out of (as HTML's tree construction has it).
_BLOCKS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
ENDS: dict[str, tuple[frozenset, frozenset]] = {
    tag: (frozenset({"p"}) | (_HEADINGS if tag in _HEADINGS else frozenset()), frozenset({"button", "table", "td", "th", "caption"})) for tag in _BLOCKS
}
ENDS |= {
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu", "table"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    **{t: (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    "a": (frozenset({"a"}), frozenset({"table", "td", "th"})),
    "button": (frozenset({"button"}), frozenset({"table", "td", "th"})),
}
#: Elements whose inner text is kept; of those of one kind inside each other, the innermost has it.
WITH_TEXT = _HEADINGS | frozenset("title a button script style label option summary caption figcaption".split())

# Titles, texts and names that say nothing, and component classes.
GENERIC_TITLES = ["untitled", "home", "homepage", "page", "default", "welcome", "index", "title"]
SOFT_404 = [
    "no results found", "no products found", "no posts found", "no items found", "page not found", "page cannot be found", "page could not be found",
    "page doesn't exist", "page does not exist", "currently unavailable", "no longer available", "out of stock", "this product is unavailable",
    "this product has been discontinued", "there are no results", "there are no posts", "there are no items", "we couldn't find", "we could not find",
    "error 404", "404 error", "404 not found",
]
SOFT_404_SHORT = [
    "page not found", "page cannot be found", "404 not found", "the requested url was not found", "this page doesn't exist",
    "this page does not exist", "sorry, we could not find", "the page you are looking for", "no results found", "out of stock", "no products match",
    "this product is no longer available",
]
GENERIC_ALT = r"(?i)^(images?|photos?|pictures?|product image|product photo|thumbnail|icon|logo|banner|photo \d+|image \d+|img_\d+|dsc_\d+|untitled)$"
COMPONENTS = ["card", "modal", "dialog", "popover", "tooltip", "dropdown", "menu", "sidebar", "widget", "banner", "tile"]


class _Elements(HTMLParser):
    """Elements and texts in document order. An element that can't stand in the head closes
    it; end tags that HTML lets be left out are put in. The places of open elements are
    kept by tag, so that time is linear in the page, however deep it is nested."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.places, self.head = [], [], defaultdict(list), None

    def _add(self, tag, attrs, text):
        parent = self.open[-1][0] if self.open else None
        row = [len(self.rows), len(self.rows), parent, tag, attrs, text, [], bool(self.head) and tag not in ("head", "html")]
        self.rows.append(row)
        return row

    def _cut(self, i):
        while len(self.open) > i:
            row = self.open.pop()
            row[1] = len(self.rows) - 1
            self.places[row[3]].pop()

    def _innermost(self, tags):
        """The place of the last open element of these tags; -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def handle_starttag(self, tag, attrs):
        if tag == "head" and self.head is None:
            self.head = True
        elif self.head and tag not in HEAD_TAGS:
            self.head = False
            if self.places["head"]:
                self._cut(self.places["head"][0])
        if tag in ENDS:
            closed, barrier = ENDS[tag]
            wall = self._innermost(barrier)
            above = [p[bisect_right(p, wall)] for p in map(self.places.__getitem__, closed) if p and p[-1] > wall]
            if above:
                self._cut(min(above))
        kept = {k: v or "" for k, v in reversed(attrs)}
        row = self._add(tag, kept, [])
        if tag == "img" and kept.get("alt", "").strip():
            for kind in ("a", "button"):
                if self.places[kind]:
                    self.open[self.places[kind][-1]][6].append(kept["alt"].strip())
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        own = self._innermost((tag,))
        free = tag in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "body", "html")
        if own >= 0 and (free or own > self._innermost(("table", "td", "th"))):
            self._cut(own)

    def handle_data(self, data):
        for tag in WITH_TEXT:
            if self.places[tag]:
                self.open[self.places[tag][-1]][5].append(data)
        if data.strip():
            self._add(TEXT, {}, [data])

    def close(self):
        super().close()
        self._cut(0)


#: Stands for an ampersand that begins no reference; no string of a table holds a lone surrogate.
_AMPERSAND = "\ud800"


def _restored(row: list) -> list:
    back = lambda x: x.replace(_AMPERSAND, "&")
    seq, last, parent, tag, attrs, text, alts, head = row
    return [seq, last, parent, back(tag), {back(k): back(v) for k, v in attrs.items()}, [back(x) for x in text], [back(x) for x in alts], head]


def page_elements(pages: DataFrame, tags: tuple = (), references: tuple | None = None) -> DataFrame:
    """The element table of pages (url, html); null html has no elements.

    Elements and texts (tag `#text`) are rows in document order (seq), each with its
    parent's seq and the seq of its last descendant (last; its own if it has none): an
    element holds those after it up to `last`. `text` is the text itself, and of headings,
    links, buttons, titles, scripts and the like the text inside; blanks are made one.
    `alts` has the alternative texts of images in a link or button. With `tags`, only these
    come out of the parser. The table is linear in the page.

    References are read as in HTML, where old ones count without their semicolon too (`&amp`).
    With `references` (names: amp, #39), only these count, if they end in one; others are text.
    """
    schema = pa.schema(
        [
            ("url", pa.string()), ("seq", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()),
            ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("alts", pa.string()), ("in_head", pa.bool_()),
        ]
    )
    wanted = frozenset(tags)
    other = re.compile("&" if not references else rf"&(?!(?:{'|'.join(map(re.escape, references))});)")

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(it):
        for batch in it:
            out = []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Elements()
                parser.feed((html or "") if references is None else other.sub(_AMPERSAND, html or ""))
                parser.close()
                for seq, last, parent, tag, attrs, text, alts, head in parser.rows if references is None else map(_restored, parser.rows):
                    if wanted and tag not in wanted:
                        continue
                    out.append((url, seq, last, parent, tag, list(attrs.items()), " ".join("".join(text).split()), " ".join(alts), head))
                    if len(out) > 20_000:
                        yield made(out)
                        out = []
            if out:
                yield made(out)

    return pages.select("url", "html").mapInArrow(run, ELEMENTS)


def within(elements: DataFrame, **holders: Column) -> DataFrame:
    """`elements` with a boolean column for each of `holders` (a condition on elements): whether
    an element that holds this one meets it. Elements nest, so it does if the farthest end of
    those that meet it before is not before this one: one pass over a page in order."""
    before = Window.partitionBy("url").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    ends = {name: F.coalesce(F.max(F.when(c, F.col("last"))).over(before) >= F.col("seq"), F.lit(False)) for name, c in holders.items()}
    return elements.select("*", *(c.alias(name) for name, c in ends.items()))


def tagged(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


def attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def head_facts(elements: DataFrame) -> DataFrame:
    """Counts and first values of the head's parts, one row a page."""
    e = elements.select(
        "url", "seq", "tag", "text", F.lower(attr("name")).alias("name"), F.lower(attr("property")).alias("property"),
        F.lower(attr("rel")).alias("rel"), attr("content").alias("content"), attr("href").alias("href"), attr("charset").alias("charset"), "in_head",
    ).where("tag in ('html', 'title', 'link', 'meta')")
    meta = lambda n: (F.col("tag") == "meta") & (F.col("name") == n)
    prop = lambda p: (F.col("tag") == "meta") & ((F.col("property") == p) | (F.col("name") == p))
    canonical = (F.col("tag") == "link") & F.array_contains(F.split("rel", r"\s+"), "canonical") & F.col("in_head")
    title = (F.col("tag") == "title") & F.col("in_head")
    n = lambda cond, name: F.count_if(cond).cast("int").alias(name)
    first = lambda cond, value, name: F.coalesce(F.min_by(F.when(cond, F.col(value)), F.when(cond, F.col("seq"))), F.lit("")).alias(name)
    return e.groupBy("url").agg(
        n(title, "n_title"),
        first(title, "text", "title"),
        n(canonical, "n_canonical"),
        first(canonical, "href", "canonical"),
        n(meta("description"), "n_description"),
        first(meta("description"), "content", "description"),
        first(meta("robots"), "content", "robots"),
        first(meta("googlebot"), "content", "googlebot"),
        first(meta("viewport"), "content", "viewport"),
        first((F.col("tag") == "meta") & (F.col("charset") != ""), "charset", "charset"),
        *((F.count_if(prop(p)) > 0).alias(name) for p, name in (("og:title", "has_og_title"), ("og:image", "has_og_image"), ("og:url", "has_og_url"), ("twitter:card", "has_twitter_card"))),
        *(first(prop(p), "content", p.replace(":", "_")) for p in ("og:title", "og:description", "og:image")),
    )


def has_noindex(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)(^|[\s,;:])(noindex|none)([\s,;]|$)")


def head_audit(facts: DataFrame, fetches: DataFrame) -> DataFrame:
    """Findings of the heads (facts by url) of stored fetches (url, status, should_index,
    x_robots_tag); the canonical's own stored fetch tells whether it answers. A page says
    noindex in its head or in the X-Robots-Tag header."""
    targets = fetches.select(F.col("url").alias("_target"), F.col("status").alias("_target_status"))
    rows = facts.join(fetches.select("url", "should_index", "x_robots_tag"), "url").join(targets, F.col("canonical") == F.col("_target"), "left")
    c = F.col
    one = c("n_canonical") == 1
    host = lambda x: u.url_parts(x)["host"]
    absolute = one & u.is_abs_http(c("canonical"))
    noindex = has_noindex(c("robots")) | has_noindex(c("googlebot")) | has_noindex(c("x_robots_tag"))
    outside = absolute & (host(c("canonical")) != host(c("url")))
    return findings(rows, [
        ("missing_title", "high", c("n_title") == 0, None),
        ("multiple_titles", "high", c("n_title") > 1, c("n_title")),
        ("empty_title", "high", (c("n_title") > 0) & (F.trim("title") == ""), None),
        ("generic_title", "medium", (c("n_title") > 0) & F.lower(F.trim("title")).isin(*GENERIC_TITLES), c("title")),
        ("missing_canonical", "high", c("n_canonical") == 0, None),
        ("multiple_canonicals", "high", c("n_canonical") > 1, c("n_canonical")),
        ("relative_canonical", "high", one & ~absolute, c("canonical")),
        ("canonical_host_mismatch", "medium", outside, c("canonical")),
        ("canonical_not_200", "high", absolute & ~outside & (c("_target_status") != 200), c("_target_status")),
        ("canonical_unreachable", "medium", absolute & c("_target").isNull(), c("canonical")),
        ("noindex_on_indexable_page", "high", noindex & c("should_index"), None),
        ("noindex_with_external_canonical", "medium", noindex & absolute & (c("canonical") != c("url")), None),
        ("missing_description", "medium", c("n_description") == 0, None), ("multiple_descriptions", "medium", c("n_description") > 1, c("n_description")),
        ("missing_og_title", "low", ~c("has_og_title"), None),
        ("missing_og_image", "low", ~c("has_og_image"), None),
        ("missing_og_url", "low", ~c("has_og_url"), None),
        ("missing_twitter_card", "low", ~c("has_twitter_card"), None),
        ("missing_viewport", "medium", c("viewport") == "", None),
        ("viewport_blocks_zoom", "medium", c("viewport").rlike(r"(?i)user-scalable\s*=\s*(no|0)|maximum-scale\s*=\s*1(\.0*)?\b"), c("viewport")),
        ("missing_charset", "medium", c("charset") == "", None),
        ("non_utf8_charset", "medium", (c("charset") != "") & ~F.lower("charset").isin("utf-8", "utf8"), c("charset")),
    ])


def noindex_gate(facts: DataFrame, fetches: DataFrame) -> DataFrame:
    """(url, source) of pages meant for the index that say noindex, in header, robots or googlebot."""
    rows = fetches.where("should_index").select("url", "x_robots_tag").join(facts.select("url", "robots", "googlebot"), "url", "left")
    made = F.array_compact(
        F.array(*[F.when(has_noindex(F.col(c)), F.lit(name)) for c, name in (("x_robots_tag", "header"), ("robots", "meta_robots"), ("googlebot", "meta_googlebot"))])
    )
    return rows.select("url", F.explode(made).alias("source"))


def canonical_status(facts: DataFrame, statuses: DataFrame) -> DataFrame:
    """(url, canonical, status, problem) of canonicals that are missing, several, or not 200."""
    rows = facts.select("url", "n_canonical", "canonical").join(statuses.select(F.col("url").alias("canonical"), "status"), "canonical", "left")
    problem = F.when(F.col("n_canonical") == 0, "missing").when(F.col("n_canonical") > 1, "multiple").when(F.coalesce("status", F.lit(0)) != 200, "not_200")
    return rows.withColumn("problem", problem).where("problem is not null").select("url", "canonical", "status", "problem")


def head_contract(facts: DataFrame, expectations: DataFrame) -> DataFrame:
    """(url, rule) of heads that break what their page type asks for: expectations
    (url, page_type, indexable, needs_og)."""
    rows = facts.join(expectations, "url")
    c = F.col
    return findings(
        rows,
        [
            ("one_title", "error", c("n_title") != 1, None),
            ("absolute_canonical", "error", ~u.is_abs_http(c("canonical")) | c("canonical").rlike("[?#]"), c("canonical")),
            ("one_description", "error", c("n_description") > 1, None),
            ("index_state", "error", has_noindex(c("robots")) == c("indexable"), c("robots")), ("viewport", "error", c("viewport") == "", None),
            ("og_set", "error", c("needs_og") & ~(c("has_og_title") & c("has_og_image") & c("has_og_url")), None),
        ],
    )


def header_canonicals(link: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(link, F.lit("")), F.lit(r"""(?i)<([^>]+)>[^,<]*rel="?canonical"""), F.lit(1))


def canonical_audit(fetches: DataFrame, elements: DataFrame) -> DataFrame:
    """Findings on canonicals in the head and the Link header of fetches (url, status, link, and
    final_url where it differs from url).

    Head links are resolved against the first `base` of the page, if it is in the head, header
    ones against the final URL. Targets are compared in their normal form, page and canonical
    without tracking parameters. A page that answers 400 or more has no other finding than that; an
    empty first canonical, or one that is no web address, no further ones.
    """
    c = F.col
    canonical = (c("tag") == "link") & F.array_contains(F.split(F.lower(attr("rel")), r"\s+"), "canonical")
    base = (c("tag") == "base") & F.map_contains_key("attrs", "href")
    links = elements.where(c("tag").isin("link", "base")).groupBy("url").agg(
        F.array_sort(F.collect_list(F.when(canonical & c("in_head"), F.struct("seq", F.trim(attr("href")).alias("href"))))).alias("heads"),
        F.count_if(canonical & ~c("in_head")).alias("outside"),
        F.min(F.when(base, F.struct("seq", "in_head", F.trim(attr("href")).alias("href")))).alias("base"),
    )
    final = F.coalesce(c("final_url"), c("url")) if "final_url" in fetches.columns else c("url")
    rows = fetches.where("status is not null").select("url", "status", "link", final.alias("page")).join(links, "url", "left")
    rows = rows.withColumn("from", F.when(c("base.in_head"), u.resolve(c("page"), c("base.href"))).otherwise(c("page")))
    found = lambda hrefs, start: F.transform(hrefs, lambda x: F.struct(x.alias("href"), u.resolve(start, x).alias("to")))
    heads = F.transform(F.coalesce("heads", F.array().cast("array<struct<seq:int,href:string>>")), lambda x: x["href"])
    rows = rows.withColumn("all", F.concat(found(heads, c("from")), found(F.transform(header_canonicals(c("link")), lambda x: F.trim(x)), c("page"))))
    kinds = F.array_distinct(F.transform(F.filter("all", lambda x: x["href"] != ""), lambda x: u.normalize_url_compare(x["to"])))
    rows = rows.select("url", "page", "status", "outside", F.size("all").alias("n"), F.size(kinds).alias("kinds"), F.get("all", F.lit(0)).alias("one"))
    rows = rows.select("*", F.coalesce("one.href", F.lit("")).alias("first"), F.coalesce("one.to", F.lit("")).alias("to")).drop("one")
    # One step a column, so that no step's expression is repeated in the next.
    rows = rows.select("*", u.strip_tracking(c("to")).alias("to_bare"), u.strip_tracking(c("page")).alias("page_bare"))
    rows = rows.select("*", *(u.normalize_url_compare(c(f"{x}_bare")).alias(f"{x}_form") for x in ("to", "page")))
    some, http = (c("n") > 0) & (c("first") != ""), c("to").rlike("(?i)^https?:")
    host = lambda x: F.split(c(f"{x}_form"), "/")[2]
    ok = c("status") < 400
    return findings(rows, [
        ("non_success", "error", ~ok, c("status")), ("outside_head", "error", ok & (c("outside") > 0), None), ("missing", "error", ok & (c("n") == 0), None),
        ("conflicting", "error", ok & (c("kinds") > 1), None), ("multiple_same", "warning", ok & (c("n") > 1) & (c("kinds") <= 1), None),
        ("empty", "error", ok & (c("n") > 0) & (c("first") == ""), None),
        ("relative", "warning", ok & some & ~c("first").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]"), c("first")),
        ("non_http", "error", ok & some & ~http, c("first")),
        ("tracking_in_canonical", "error", ok & some & http & (F.size(u.tracking_params(c("to"))) > 0), c("first")),
        ("cross_host", "warning", ok & some & http & (host("to") != host("page")), c("first")),
        ("not_self", "notice", ok & some & http & (c("to_form") != c("page_form")), c("first")),
    ])


def visible_text(elements: DataFrame, drop: tuple = ("script", "style", "noscript", "template", "nav", "header", "footer")) -> DataFrame:
    """(url, text) of the body: texts that no dropped element holds, in document order."""
    rows = within(elements, dropped=tagged(*drop)).where((F.col("tag") == TEXT) & ~F.col("dropped") & ~F.col("in_head"))
    return rows.groupBy("url").agg(_in_order().alias("text"))


def _in_order() -> Column:
    """The texts of a group (one page) joined by seq."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")


#: Chinese characters and Japanese kana, which are written without blanks.
UNSPACED = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}"


def _maybe_unspaced(text: Column) -> Column:
    """Whether a text has a character from the first to the last of these: one range is tested
    much faster than all of them, and most texts have none."""
    return text.rlike(r"[\x{3040}-\x{FF9F}]")


def count_words(text: Column) -> Column:
    """Words; characters of scripts without blanks count one each. Korean is written with blanks."""
    text = F.coalesce(text, F.lit(""))
    apart = F.when(_maybe_unspaced(text), F.regexp_replace(text, f"[{UNSPACED}]", " x ")).otherwise(text)
    return F.size(F.regexp_extract_all(apart, F.lit(r"\S+"), F.lit(0)))


def soft_404(fetches: DataFrame, texts: DataFrame, min_words: int = 50) -> DataFrame:
    """(url, signals) of answers 200 that look like errors: thin, saying so, or sent to the root."""
    rows = fetches.where("status = 200").join(texts.select("url", "text"), "url", "left")
    says = F.exists(F.array(*[F.lit(p) for p in SOFT_404]), lambda p: F.lower(F.coalesce("text", F.lit(""))).contains(p))
    path = lambda c: u.url_parts(F.col(c))["path"]
    root = path("final_url").isin("", "/") & ~path("url").isin("", "/")
    signals = F.array_compact(F.array(F.when(count_words(F.col("text")) < min_words, "thin_content"), F.when(says, "error_phrase"), F.when(root, "redirected_to_root")))
    return rows.select("url", F.array_join(signals, ",").alias("signals")).where("signals <> ''")


def rendering_debt(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """(url, debt): the share of the rendered words, with multiplicity, that the raw text
    lacks; 0 where nothing is rendered. Characters of scripts without blanks are words."""
    word, simple = rf"[{UNSPACED}]|[\p{{L}}\p{{N}}_&&[^{UNSPACED}]]+", r"[\p{L}\p{N}_]+"
    text = F.lower(F.coalesce("text", F.lit("")))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tokens = lambda df, a, b: df.select(
        "url", F.explode(F.when(_maybe_unspaced(text), found(word)).otherwise(found(simple))).alias("w"), F.lit(a).alias("a"), F.lit(b).alias("b"),
    )
    both = tokens(raw, 1, 0).union(tokens(rendered, 0, 1)).groupBy("url", "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = both.groupBy("url").agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("more"), F.sum("b").alias("all"))
    pages = raw.select("url").union(rendered.select("url")).distinct().join(sums, "url", "left")
    return pages.select("url", F.round(F.when(F.col("all") > 0, F.col("more") / F.col("all")).otherwise(0.0), 6).alias("debt"))


def compare_fetches(a: DataFrame, b: DataFrame) -> DataFrame:
    """How two fetches (url, status, final_url, html) of a page differ, and their sizes."""
    rows = a.select("url", *(F.col(c).alias(f"{c}_a") for c in ("status", "final_url", "html"))).join(
        b.select("url", *(F.col(c).alias(f"{c}_b") for c in ("status", "final_url", "html"))), "url",
    )
    kind = F.when(F.col("status_a") != F.col("status_b"), "status").when(F.col("final_url_a") != F.col("final_url_b"), "redirect").when(
        F.sha2(F.col("html_a").cast("binary"), 256) == F.sha2(F.col("html_b").cast("binary"), 256), "identical",
    ).otherwise("body")
    return rows.select("url", kind.alias("difference"), F.octet_length("html_a").alias("bytes_a"), F.octet_length("html_b").alias("bytes_b"))


def byte_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    size = lambda df, n: df.select("url", F.octet_length("html").alias(n))
    return size(before, "bytes_before").join(size(after, "bytes_after"), "url").withColumn("delta", F.col("bytes_after") - F.col("bytes_before"))


def heading_outline(elements: DataFrame) -> DataFrame:
    """(url, seq, level, text, before): headings in order with the level before them."""
    w = Window.partitionBy("url").orderBy("seq")
    named = F.arrays_overlap(F.split(F.lower(attr("class")), r"[\s_-]+"), F.array(*[F.lit(x) for x in COMPONENTS]))
    rows = within(elements, in_aside=tagged("aside"), in_nav=tagged("nav"), in_component=attr("role").isin("dialog", "tooltip", "menu") | named)
    rows = rows.where(F.col("tag").rlike("^h[1-6]$")).withColumn("level", F.substring("tag", 2, 1).cast("int"))
    return rows.select("url", "seq", "level", "text", F.lag("level").over(w).alias("before"), "in_aside", "in_nav", "in_component")


def semantic_audit(elements: DataFrame) -> DataFrame:
    """Findings (url, severity, rule, detail) on structure, links, buttons and images."""
    c = F.col
    tag = lambda *t: c("tag").isin(*t)
    n = lambda cond, name: F.count_if(cond).alias(name)
    per = elements.groupBy("url").agg(
        n(tag("h1"), "h1"), n(tag("main") & ~F.map_contains_key("attrs", "hidden"), "main"), n(tag("header"), "header"), n(tag("footer"), "footer"),
        n(tag("nav"), "nav"), n(tag("html") & (attr("lang") != ""), "lang"),
    )
    pages = findings(
        per,
        [
            ("missing_h1", "high", c("h1") == 0, None), ("multiple_h1", "medium", c("h1") > 1, c("h1")),
            ("missing_main", "high", c("main") == 0, None), ("multiple_main", "medium", c("main") > 1, c("main")),
            ("missing_header", "low", c("header") == 0, None), ("missing_footer", "low", c("footer") == 0, None),
            ("missing_nav", "low", c("nav") == 0, None), ("missing_html_lang", "high", c("lang") == 0, None),
        ],
    )
    heads = findings(
        heading_outline(elements),
        [
            ("skipped_heading_level", "medium", c("level") > c("before") + 1, c("text")), ("heading_inside_aside", "low", c("in_aside"), c("text")),
            ("heading_inside_nav", "low", c("in_nav"), c("text")), ("heading_inside_ui_component", "low", c("in_component"), c("text")),
        ],
    )
    href = F.lower(F.trim(attr("href")))
    rows = elements.where(tag("a", "button"))
    nameless = (c("text") == "") & (c("alts") == "") & (attr("aria-label") == "") & (attr("title") == "") & (attr("aria-labelledby") == "")
    links = findings(
        rows,
        [
            ("anchor_without_href", "medium", tag("a") & ~F.map_contains_key("attrs", "href"), None),
            (
                "anchor_non_crawlable_href", "medium",
                tag("a") & F.map_contains_key("attrs", "href") & ((href == "") | (href == "#") | href.startswith("javascript:")), attr("href"),
            ),
            ("anchor_without_accessible_name", "high", tag("a") & nameless, None),
            ("button_without_accessible_name", "high", tag("button") & nameless, None),
        ],
    )
    images = findings(
        elements.where(tag("img")),
        [
            ("image_missing_alt", "high", ~F.map_contains_key("attrs", "alt"), attr("src")),
            ("image_generic_alt", "low", F.trim(attr("alt")).rlike(GENERIC_ALT), attr("alt")),
        ],
    )
    return pages.union(heads).union(links).union(images)


#: Elements that http_audit looks at.
HTTP_TAGS = ("img", "script", "iframe", "audio", "video", "source", "link", "meta")


def http_audit(fetches: DataFrame, elements: DataFrame, most_hops: int = 3) -> DataFrame:
    """Findings on stored answers and their elements. Fetches: url, final_url, status (0: no
    answer), hops, content_type, cache_control, x_robots_tag, etag, last_modified, link,
    conditional_status (of a second, conditional request; null: not asked), in_sitemap,
    html. A noindex in the page is one finding for each meta element."""
    c = F.col
    tag = lambda *t: c("tag").isin(*t)
    plain = lambda name: attr(name).startswith("http://")
    loads = (tag("img", "script", "iframe", "audio", "video", "source") & plain("src")) | (tag("link") & plain("href"))
    canonical = tag("link") & (attr("rel") == "canonical") & (attr("href") != "")
    robots = tag("meta") & (attr("name") == "robots") & F.lower(attr("content")).contains("noindex")
    facts = elements.where(tag(*HTTP_TAGS)).groupBy("url").agg(
        F.count_if(loads).alias("plain_loads"), F.min_by(F.when(canonical, attr("href")), F.when(canonical, c("seq"))).alias("said"),
        F.array_sort(F.collect_list(F.when(robots, F.struct("seq", attr("content").alias("content"))))).alias("noindex"),
    )
    rows = fetches.join(facts, "url", "left").withColumn("type", F.lower(F.coalesce("content_type", F.lit(""))))
    html, ok, path = c("type").contains("text/html"), c("status") == 200, F.lower(u.url_parts(c("url"))["path"])
    has = lambda name: F.coalesce(c(name), F.lit("")) != ""
    age = F.coalesce(F.nullif(F.regexp_extract(F.lower("cache_control"), r"max-age=(\d+)", 1), F.lit("")).try_cast("long"), F.lit(0))
    body = F.lower(F.coalesce("html", F.lit("")))
    header = F.get(header_canonicals(c("link")), F.lit(0))
    answered = rows.where("status <> 0")
    first = findings(rows, [("redirect_chain_too_long", "error", c("hops") > most_hops, c("hops")), ("final_response_unreachable", "error", c("status") == 0, None)])
    more = findings(answered, [
        ("sitemap_url_returns_404", "error", (c("status") == 404) & c("in_sitemap"), c("status")), ("server_error", "error", c("status").between(500, 599), c("status")),
        ("possible_soft_404", "warning", ok & (F.length(body) < 8000) & F.exists(F.array(*[F.lit(p) for p in SOFT_404_SHORT]), lambda p: body.contains(p)), None),
        ("no_store_on_html_disables_bfcache", "warning", html & F.lower("cache_control").contains("no-store"), None),
        ("long_max_age_on_html", "warning", html & (age > 7 * 86400), age),
        ("noindex_in_response_header", "error", ok & F.lower("x_robots_tag").contains("noindex"), c("x_robots_tag")),
        ("mixed_content_on_https", "error", c("url").startswith("https://") & html & (c("plain_loads") > 0), c("plain_loads")),
        ("canonical_signal_conflict", "error", html & (u.resolve(c("url"), header) != u.resolve(c("url"), c("said"))), header),
        ("sitemap_wrong_content_type", "warning", path.endswith(".xml") & ~c("type").contains("xml"), c("content_type")),
        ("robots_wrong_content_type", "warning", path.endswith("/robots.txt") & ~c("type").contains("text/plain"), c("content_type")),
        ("html_missing_charset", "warning", ~path.endswith(".xml") & ~path.endswith("/robots.txt") & html & ~c("type").contains("charset"), c("content_type")),
        ("no_conditional_request_headers", "warning", ok & ~has("etag") & ~has("last_modified"), None),
        ("conditional_request_not_honored", "warning", ok & (has("etag") | has("last_modified")) & (c("conditional_status") != 304), c("conditional_status")),
    ])
    tags = answered.where(ok & html).select("url", F.explode("noindex").alias("m")).select(
        "url", F.lit("error").alias("severity"), F.lit("noindex_in_meta_tag").alias("rule"), c("m.content").alias("detail"),
    )
    return first.unionByName(more).unionByName(tags)


def redirect_types(chains: DataFrame) -> DataFrame:
    """Findings on hops of chains (url, chain array<struct<url,status,location>>): temporary
    redirects where a permanent one is meant."""
    hop = chains.select("url", F.explode("chain").alias("h")).where("h.status = 302").select("url", F.col("h.url").alias("a"), F.col("h.location").alias("b"))
    a, b = u.url_parts(F.col("a")), u.url_parts(F.col("b"))
    return findings(
        hop,
        [
            ("wrong_redirect_type_http_to_https", "error", (a["scheme"] == "http") & (b["scheme"] == "https"), F.col("b")),
            (
                "wrong_redirect_type_www_normalization", "error",
                F.regexp_replace(a["host"], r"^www\.", "") .eqNullSafe(F.regexp_replace(b["host"], r"^www\.", "")) & (a["host"] != b["host"]),
                F.col("b"),
            ),
            ("wrong_redirect_type_trailing_slash", "error", (F.rtrim(a["path"], F.lit("/")) == F.rtrim(b["path"], F.lit("/"))) & (a["path"] != b["path"]), F.col("b")),
        ],
    )


def page_assertions(fetches: DataFrame, facts: DataFrame, scripts: DataFrame) -> DataFrame:
    """(url, name, expected, observed, passed) of each page. Fetches: url, status, expect_status,
    expect_redirect_to (null: none), location, x_robots_tag, html; facts are those of the heads,
    scripts (url, block, raw) the JSON-LD ones.

    Where a redirect is expected, only status and target are tested; where another status
    than 200 is, only the status; bodies of under 100 characters are not looked into.
    """
    c = F.col
    broken = F.try_parse_json("raw").isNull()
    blocks = scripts.groupBy("url").agg(F.count("*").alias("blocks"), F.count_if(broken).alias("broken"))
    rows = fetches.join(facts.select("url", "title", "description", "canonical", "og_title", "og_description", "og_image"), "url", "left").join(blocks, "url", "left")
    rows = rows.fillna(0, ["blocks", "broken"]).withColumn("length", F.length(F.coalesce("html", F.lit(""))))
    text = lambda name: F.trim(F.coalesce(c(name), F.lit("")))
    item = lambda name, when, expected, observed, passed: F.when(
        when,
        F.struct(
            F.lit(name).alias("name"), (expected if isinstance(expected, Column) else F.lit(expected)).cast("string").alias("expected"),
            F.coalesce(observed.cast("string"), F.lit("")).alias("observed"), F.coalesce(passed, F.lit(False)).alias("passed"),
        ),
    )
    filled = lambda name, when, column, expected: item(name, when, expected, F.left(text(column), F.lit(60)), text(column) != "")
    moved = c("expect_redirect_to").isNotNull()
    target = u.resolve(c("url"), F.coalesce("location", F.lit("")))
    page = ~moved & (c("expect_status") == 200)
    read = page & (c("length") >= 100)
    made = F.array_compact(F.array(
        item("status_code", F.lit(True), c("expect_status"), c("status"), c("status") == c("expect_status")),
        item("redirect_target", moved, c("expect_redirect_to"), target, F.rtrim(target, F.lit("/")) == F.rtrim(c("expect_redirect_to"), F.lit("/"))),
        item("x_robots_tag_not_noindex", page, "no noindex", c("x_robots_tag"), ~F.lower(F.coalesce("x_robots_tag", F.lit(""))).contains("noindex")),
        item("non_empty_body", page, "over 500 characters", c("length"), c("length") > 500),
        filled("title_tag", read, "title", "a title"), filled("meta_description", read, "description", "a description"),
        item("canonical_tag", read, "an absolute URL", text("canonical"), u.is_abs_http(text("canonical"))),
        item("jsonld_present", read, "a block or more", c("blocks"), c("blocks") > 0),
        item("jsonld_parses", read & (c("blocks") > 0), "no broken block", c("broken"), c("broken") == 0),
        *(filled(f"meta_{x}", read, x, f"an {x.replace('_', ':')}") for x in ("og_title", "og_description", "og_image")),
    ))
    return rows.select("url", F.explode(made).alias("a")).select("url", "a.*")


def locale_probe_audit(probes: DataFrame) -> DataFrame:
    """Findings (url, severity, rule, detail) on probes of pages under several languages:
    url, locale (declared, or null), probe (order), status (null: the probe failed), final_url,
    lang, title, h1, canonical, hreflangs (array of targets). The first probe that answered
    is what the others are compared with, and stands for the page."""
    c = F.col
    by = Window.partitionBy("url").orderBy("probe")
    rows = probes.withColumn("answered", c("status").isNotNull())
    order = F.when(c("answered"), c("probe"))
    rows = rows.withColumn("one", F.min(order).over(Window.partitionBy("url")) == c("probe"))
    rows = rows.select(
        "*",
        *(F.first(F.when(c("one"), c(x)), True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(f"one_{x}") for x in ("lang", "title", "h1")),
    )
    differs = lambda x: c("answered") & ~c("one") & (F.coalesce(c(x), F.lit("")) != "") & (F.coalesce(c(f"one_{x}"), F.lit("")) != "") & (c(x) != c(f"one_{x}"))
    each = findings(rows, [
        ("probe_failed", "high", ~c("answered"), c("probe")),
        ("locale_url_redirects", "high", c("answered") & ~u.same_url(c("final_url"), c("url")), c("final_url")),
        ("non_200_status", "high", c("status") != 200, c("status")),
        ("locale_adaptive_content", "high", differs("lang"), c("lang")),
        ("title_varies_by_accept_language", "high", differs("title"), c("title")),
        ("h1_varies_by_accept_language", "medium", differs("h1"), c("h1")),
    ])
    said, page = F.lower(F.coalesce("locale", F.lit(""))), F.lower(F.coalesce("lang", F.lit("")))
    fits = (page == said) | F.startswith(page, F.concat(said, F.lit("-"))) | F.startswith(said, F.concat(page, F.lit("-")))
    links = F.coalesce("hreflangs", F.array().cast("array<string>"))
    canonical = F.coalesce("canonical", F.lit(""))
    whole = findings(rows.where("one"), [
        ("html_lang_mismatch", "medium", (said != "") & (page != "") & ~fits, c("lang")), ("no_canonical", "medium", canonical == "", None),
        ("canonical_not_self", "high", (canonical != "") & ~u.same_url(u.resolve(c("url"), canonical), c("url")), canonical),
        ("no_hreflang_annotations", "medium", F.size(links) == 0, None),
        ("no_self_hreflang", "high", (F.size(links) > 0) & ~F.exists(links, lambda x: u.same_url(u.resolve(c("url"), x), c("url"))), None),
    ])
    return each.unionByName(whole)


def pagination_links(elements: DataFrame) -> DataFrame:
    """(url, next, targets, scripted) of pages: the address of the next page, those of all
    pagination links, and whether there is pagination that only scripts can follow."""
    c = F.col
    label, rel, text = F.lower(attr("aria-label")), F.lower(attr("rel")), F.lower(F.trim("text"))
    listed = rel.contains("next") | rel.contains("prev") | label.rlike("page|next|prev") | text.rlike(r"^\d+$") | text.isin("next", "prev", "previous", "»", "‹", "›", "«")
    further = rel.contains("next") | label.contains("next") | text.isin("next", "›", "»")
    links = elements.where((c("tag") == "a") & (attr("href") != "") & listed).select(
        "url", "seq", u.resolve(c("url"), attr("href")).alias("target"), further.alias("further"),
    )
    per = links.groupBy("url").agg(F.min_by(F.when(c("further"), c("target")), F.when(c("further"), c("seq"))).alias("next"), F.collect_set("target").alias("targets"))
    box = ((c("tag") == "nav") & label.contains("agination")) | attr("class").contains("pagination")
    button = (c("tag") == "button") | (c("tag").isin("span", "div") & (attr("role") == "link"))
    # What a box holds is the difference of two running counts: at its last descendant and at itself.
    until = Window.partitionBy("url").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    count = lambda cond: F.sum(cond.cast("int")).over(until)
    counts = elements.select("url", "seq", "last", box.alias("box"), count(button).alias("buttons"), count((c("tag") == "a") & (attr("href") != "")).alias("anchors"))
    ends = counts.select("url", c("seq").alias("last"), c("buttons").alias("b"), c("anchors").alias("a")).distinct()
    boxes = counts.where("box").join(ends, ["url", "last"])
    scripted = boxes.groupBy("url").agg(F.max((c("b") > c("buttons")) & (c("a") == c("anchors"))).alias("scripted"))
    return per.join(scripted, "url", "full").select("url", "next", "targets", F.coalesce("scripted", F.lit(False)).alias("scripted"))


def pagination_walk(nexts: DataFrame, starts: DataFrame, most: int = 10_000) -> DataFrame:
    """(start, url, step): pages reached by next links (url, next) from each start (start);
    a page met again ends its walk. A walk of more than `most` steps raises."""
    found = walk(nexts.select(F.col("url").alias("at"), F.col("next").alias("to")), starts, most)
    return found.select("start", "url", F.col("step").cast("int").alias("step"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pagination_audit(pages: DataFrame, elements: DataFrame, require_backlink: bool = True) -> DataFrame:
    """Findings (url, severity, rule, detail) on the pages of lists: url, start (page one), status
    (null: not loaded). A page that did not answer has no other finding than that and its fragment."""
    c = F.col
    heads = elements.where((c("tag") == "link") & (attr("rel") == "canonical")).groupBy("url").agg(F.min_by(attr("href"), "seq").alias("canonical"))
    rows = pages.join(heads, "url", "left").join(pagination_links(elements), "url", "left")
    rows = rows.withColumn("targets", F.coalesce("targets", F.array().cast("array<string>"))).withColumn(
        "said", u.resolve(c("url"), F.nullif(F.coalesce("canonical", F.lit("")), F.lit(""))),
    )
    first = findings(
        rows,
        [
            ("fragment_in_url", "high", c("url").contains("#"), None), ("page_load_failed", "high", c("status").isNull(), None),
            ("non_200_status", "high", c("status") >= 400, c("status")),
        ],
    )
    is_start, to_start, to_self = u.same_url(c("url"), c("start")), u.same_url(c("said"), c("start")), u.same_url(c("said"), c("url"))
    more = findings(rows.where("status < 400"), [
        ("no_canonical", "medium", c("said").isNull(), None),
        ("canonical_points_to_page_one", "high", to_start & ~is_start, c("said")),
        ("canonical_not_self", "medium", ~to_self & ~(to_start & ~is_start), c("said")),
        ("js_only_pagination", "high", (F.size("targets") == 0) & c("scripted"), None),
        ("no_pagination_links", "high", (F.size("targets") == 0) & ~F.coalesce("scripted", F.lit(False)), None),
        ("no_page_one_backlink", "medium", F.lit(require_backlink) & ~is_start & ~F.exists("targets", lambda x: u.same_url(x, c("start"))), None),
    ])
    return first.unionByName(more)
