"""URLs as columns: split by one pattern (RFC 3986, appendix B), since Spark's parser
gives null for blanks and non-ASCII letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Parameters that only track, as three sites' rules have them.
TRACKING = {
    "audit": ["fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "ref", "session_id", "sessionid", "sid", "_ga", "_gl", "yclid", "scid"],
    "normalize": [
        "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "sessionid", "sid", "source",
        "mc_cid", "mc_eid", "_ga", "_gl", "yclid", "scid",
    ],
    "edge": [
        "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format",
        "utm_marketing_tactic", "gclid", "gclsrc", "dclid", "wbraid", "gbraid", "fbclid", "fb_ref", "fb_source", "msclkid", "mc_cid", "mc_eid",
        "twclid", "li_fat_id", "igshid", "yclid", "_openstat", "ref", "source", "_ga", "_gl", "mkt_tok", "oly_anon_id", "hsCtaTracking", "_hsenc",
        "_hsmi", "ck_subscriber_id", "vero_id", "sb_referer_host",
    ],
}


def url_parts(url: Column) -> Column:
    """scheme, authority, host, port, path, query, fragment; '' where absent."""
    g = lambda i: F.regexp_extract(url, _RFC, i)
    host = F.lower(F.regexp_extract(g(2), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    return F.struct(
        F.lower(g(1)).alias("scheme"), g(2).alias("authority"), host.alias("host"), F.regexp_extract(g(2), r":(\d+)$", 1).alias("port"),
        g(3).alias("path"), g(4).alias("query"), g(5).alias("fragment"),
    )


def joined(scheme: Column, authority: Column, path: Column, query: Column) -> Column:
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def query_pairs(query: Column) -> Column:
    """Raw parameters (name, value, text, at) in order, blank ones left out."""
    return F.filter(
        F.transform(
            F.split(query, "&"),
            lambda x, i: F.struct(
                F.substring_index(x, "=", 1).alias("name"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("value"),
                x.alias("text"), i.alias("at"),
            ),
        ),
        lambda p: p["text"] != "",
    )


def _trimmed(path: Column) -> Column:
    return F.when(F.rtrim(path, F.lit("/")) == "", "/").otherwise(F.rtrim(path, F.lit("/")))


#: Characters of a path that are not percent-encoded, besides letters, digits and those that no URL encodes.
PATH_SAFE = "/:@!$&'()+,;=~"


def _ascii_host(host: Column) -> Column:
    """Hosts that are not ASCII in their IDNA form; what IDNA rejects stays."""
    idna = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.when(host.rlike(r"^[\x00-\x7F]*$"), host).otherwise(F.coalesce(F.lower(idna), host))


def _encoded_path(path: Column) -> Column:
    """A path percent-encoded one way, whichever of its characters were encoded before."""
    whole = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    encoded = F.replace(F.url_encode(F.try_url_decode(whole)), F.lit("+"), F.lit("%20"))
    for c in PATH_SAFE:
        encoded = F.replace(encoded, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(path.rlike(r"^[A-Za-z0-9_.~/:@!$&'()*+,;=-]*$"), path).otherwise(F.coalesce(encoded, path))


def normalize_url_compare(url: Column) -> Column:
    """The form in which URLs are compared: scheme and host lowered, IDNA, no default
    port, path encoded one way without its last slash, no fragment."""
    u = url_parts(url)
    host, path = _ascii_host(F.rtrim(u["host"], F.lit("."))), _encoded_path(u["path"])
    port = F.when(
        (u["port"] == "") | ((u["scheme"] == "https") & (u["port"] == "443")) | ((u["scheme"] == "http") & (u["port"] == "80")), "",
    ).otherwise(F.concat(F.lit(":"), u["port"]))
    return joined(u["scheme"], F.concat(host, port), _trimmed(path), u["query"])


def normalize_url_sorted(url: Column) -> Column:
    """Scheme and authority lowered, parameters sorted by name, then value; no fragment."""
    u = url_parts(url)
    query = F.array_join(
        F.transform(F.array_sort(F.transform(query_pairs(u["query"]), lambda p: F.struct(p["name"], p["value"]))), lambda p: F.concat(p["name"], F.lit("="), p["value"])),
        "&",
    )
    return joined(u["scheme"], F.lower(u["authority"]), _trimmed(u["path"]), query)


def normalize_url_slash(url: Column, form: str = "forbid") -> Column:
    """`require` or `forbid` a slash at the end of paths but the root."""
    u = url_parts(url)
    path = _trimmed(u["path"])
    if form == "require":
        path = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return joined(u["scheme"], F.lower(u["authority"]), path, u["query"])


def remove_dot_segments(path: Column) -> Column:
    """A path without its `.` and `..` segments (RFC 3986, 5.2.4): a fold with a stack."""
    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")
    up = lambda stack: F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
    step = lambda stack, x: F.when(x == ".", stack).when(x == "..", up(stack)).otherwise(F.concat(stack, F.array(x)))
    stack = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), empty, step)
    folder = F.element_at(segments, -1).isin(".", "..") & (F.size(stack) > 0)
    folded = F.concat(F.lit("/"), F.array_join(stack, "/"), F.when(folder, "/").otherwise(""))
    return F.when(path.rlike(r"^/(.*/)?\.\.?(/|$)"), folded).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """The reference `href` as seen from the URL `base` (RFC 3986, 5.2)."""
    g = lambda x, pattern: F.regexp_extract(x, pattern, 1)
    scheme, authority = r"(?s)^([^:/?#]+:)", r"(?s)^(?:[^:/?#]+:)?(//[^/?#]*)"
    path, query, fragment = r"(?s)^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", r"(?s)^[^?#]*(\?[^#]*)", r"(?s)^[^#]*(#.*)"
    own = href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    # Without a scheme, a colon in the first segment is the path's.
    rest = F.when(own, F.regexp_replace(href, scheme, "")).otherwise(href)
    bare = r"(?s)^(?://[^/?#]*)?([^?#]*)"
    to, of = g(rest, bare), g(base, path)
    merged = F.when((g(base, authority) != "") & (of == ""), F.concat(F.lit("/"), to)).otherwise(F.concat(F.regexp_replace(of, "[^/]*$", ""), to))
    placed = F.when(to.startswith("/"), remove_dot_segments(to)).otherwise(remove_dot_segments(merged))
    tail = F.concat(g(rest, query), g(rest, fragment))
    root = F.concat(g(base, scheme), g(base, authority))
    return (
        F.when(own, F.concat(g(href, scheme), g(rest, r"(?s)^(//[^/?#]*)"), remove_dot_segments(to), tail))
        .when(rest.startswith("//"), F.concat(g(base, scheme), g(rest, r"(?s)^(//[^/?#]*)"), remove_dot_segments(to), tail))
        .when((to == "") & rest.startswith("?"), F.concat(root, of, tail))
        .when(to == "", F.concat(root, of, g(base, query), g(rest, fragment)))
        .otherwise(F.concat(root, placed, tail))
    )


def same_url(a: Column, b: Column) -> Column:
    """Whether two absolute URLs name one page: scheme and host in any case, no fragment, an
    empty path is the root, no default port."""
    def form(x: Column) -> Column:
        u = url_parts(x)
        port = F.when((u["port"] == "") | F.concat(u["scheme"], F.lit(":"), u["port"]).isin("http:80", "https:443"), "").otherwise(F.concat(F.lit(":"), u["port"]))
        return joined(u["scheme"], F.concat(u["host"], port), F.when(u["path"] == "", "/").otherwise(u["path"]), u["query"])

    return form(a) == form(b)


def is_tracking(name: Column, rules: str = "audit") -> Column:
    if rules == "edge":
        return name.isin(*TRACKING["edge"])
    hit = F.lower(name).isin(*TRACKING[rules])
    return hit | F.lower(name).startswith("utm_") if rules == "audit" else hit


def strip_tracking(url: Column, rules: str = "audit") -> Column:
    u = url_parts(url)
    kept = F.array_join(F.transform(F.filter(query_pairs(u["query"]), lambda p: ~is_tracking(p["name"], rules)), lambda p: p["text"]), "&")
    return joined(u["scheme"], u["authority"], u["path"], kept)


def tracking_params(url: Column, rules: str = "audit") -> Column:
    return F.array_distinct(F.transform(F.filter(query_pairs(url_parts(url)["query"]), lambda p: is_tracking(p["name"], rules)), lambda p: p["name"]))


def canonical_query(query: Column) -> Column:
    """Blank values dropped, values lowered and trimmed, sorted by name; equal names keep their order."""
    clean = F.filter(
        F.transform(
            query_pairs(query),
            lambda p: F.struct(p["name"].alias("name"), p["at"].alias("at"), F.trim(F.lower(F.coalesce(F.try_url_decode(p["value"]), p["value"]))).alias("value")),
        ),
        lambda p: p["value"] != "",
    )
    return F.array_join(F.transform(F.array_sort(clean), lambda p: F.concat(p["name"], F.lit("="), F.url_encode(p["value"]))), "&")


def is_abs_http(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(r"(?i)^https?://[^/?#]+")


# What a link must not prerender.
ONE_TIME = [
    "checkout", "confirm", "confirmation", "order/[^/]+/complete", "order/[^/]+/confirmation", "payment", "pay", "cart", "add-to-cart", "unsubscribe",
    "opt-out", "logout", "signout", "sign-out", "delete", "cancel", "verify", "reset-password", "password-reset", "api",
]


def is_one_time_action(url: Column) -> Column:
    return url.rlike(rf"(?i)/({'|'.join(ONE_TIME)})(/|\?|$)|[?&]add[-_]to[-_]cart=")
