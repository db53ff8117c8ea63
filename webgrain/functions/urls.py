"""URL identity as native columns. Each purpose has its own normal form; all take absolute http(s) URLs, else null.

The parts come from one regular expression, so a plan reads the URL once and pushes no Python. `resolve` is the Python
counterpart for references that must be resolved against a base (dot segments, relative paths) in the HTML pass.
"""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, HOST, PORT, PATH, QUERY = 1, 2, 3, 4, 5

# Query keys that each normal form drops, paths of archives, and patterns of sign-in flows and redirects
# that content systems make.
LINK_TRACKING = r"(?i)^(utm_|gclid|fbclid)"
CRAWL_TRACKING = r"(?i)^(utm_.+|gclid|fbclid|msclkid|dclid|mc_cid|mc_eid|share|replytocom)$"
HISTORY_TRACKING = r"(?i)^(utm_.+|gclid|fbclid|msclkid)$"
ARCHIVE_PATHS = (r"(?i)^/(tag|category|author)(/|$)", r"(?i)/page/\d+/?$", r"(?i)/feed/?$")
MEMBERSHIP_HOST, MEMBERSHIP_LOGIN = r"(?i)(^|\.)patreon\.com$", r"(?i)/(login|oauth2)(/|$)"
UNLOCK_PATH, UNLOCK_KEY = r"(?i)(^|/)patreon-flow/?$", r"(?i)^patreon-(unlock|login|final)"
GATE_SOURCE_PATH = r"(?i)/(login|sign-?in|oauth|authorize|checkout|subscribe|membership|members|unlock)(/|$)"
GATE_SOURCE_KEY = r"(?i)(login|auth|oauth|unlock|return|redirect)"
GATE_PATH = r"(?i)/(login|sign-?in|oauth2?|authorize|checkout|subscribe|membership)(/|$)"
MADE_PATH, MADE_KEY = r"(?i)/(attachment|author|feed|wp-admin|wp-login)(/|$)", r"(?i)^(attachment_id|p|page_id|redirect_to)$"


def is_url(url: Column) -> Column:
    return url.rlike(URL)


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, URL, n)


def host(url: Column) -> Column:
    return F.lower(part(url, HOST))


def port_suffix(url: Column) -> Column:
    """':port' unless it is the scheme's own."""
    scheme, port = F.lower(part(url, SCHEME)), part(url, PORT)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(default, "").otherwise(F.concat(F.lit(":"), port))


def origin(url: Column) -> Column:
    return F.concat(F.lower(part(url, SCHEME)), F.lit("://"), host(url), port_suffix(url))


def path(url: Column) -> Column:
    p = part(url, PATH)
    return F.when(p == "", "/").otherwise(p)


def bare_path(url: Column) -> Column:
    """The path without trailing slashes, but for the root."""
    p = path(url)
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))


def query(url: Column, drop: str | None = None, sort: bool = False) -> Column:
    """'?query' with keys that match `drop` left out and, where `sort`, ordered by key and then as they stood."""
    pairs = F.filter(F.split(part(url, QUERY), "&"), lambda p: p != "")
    if drop:
        pairs = F.filter(pairs, lambda p: ~F.regexp_extract(p, "^([^=]*)", 1).rlike(drop))
    if sort:
        keyed = F.transform(pairs, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), p.alias("p")))
        pairs = F.transform(F.array_sort(keyed), lambda x: x["p"])
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")


def has_key(url: Column, pattern: str) -> Column:
    return F.exists(F.split(part(url, QUERY), "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1).rlike(pattern))


def _if_url(url: Column, value: Column) -> Column:
    return F.when(is_url(url), value)


def link_form(url: Column) -> Column:
    """Form of links, canonicals, images and sitemap entries."""
    return _if_url(url, F.concat(origin(url), bare_path(url), query(url, LINK_TRACKING)))


def crawl_form(url: Column, strip_tracking: bool = True) -> Column:
    """Form of the frontier: sorted query, the path as it is."""
    return _if_url(url, F.concat(origin(url), path(url), query(url, CRAWL_TRACKING if strip_tracking else None, sort=True)))


def graph_form(url: Column) -> Column:
    """Form of nodes in the link graph."""
    return _if_url(url, F.concat(origin(url), bare_path(url), query(url)))


def history_form(url: Column) -> Column:
    """Form in stored runs: neither scheme nor www."""
    return _if_url(
        url, F.concat(F.regexp_replace(host(url), r"^www\.", ""), port_suffix(url), bare_path(url), query(url, HISTORY_TRACKING, sort=True))
    )


def domain_form(value: Column) -> Column:
    """Domain of a URL or a bare host: lower case, without www and a trailing dot, with a port of its own."""
    url = F.when(value.contains("://"), value).otherwise(F.concat(F.lit("https://"), value))
    return _if_url(url, F.concat(F.regexp_replace(F.regexp_replace(host(url), r"\.$", ""), r"^www\.", ""), port_suffix(url)))


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def bucket(url: Column) -> Column:
    return F.coalesce(F.get(segments(url), 0), F.lit("/"))


def is_archive(url: Column) -> Column:
    p = path(url)
    return p.rlike(ARCHIVE_PATHS[0]) | p.rlike(ARCHIVE_PATHS[1]) | p.rlike(ARCHIVE_PATHS[2]) | has_key(url, "^s$")


def page_type(url: Column, has_article: Column) -> Column:
    """First of: home, feed, archives, article, landing."""
    p = path(url)
    return (
        F.when((p == "/") & (part(url, QUERY) == ""), "home")
        .when(p.rlike(r"(?i)/feed(/|$)"), "feed")
        .when(has_key(url, "^s$") | p.rlike(r"(?i)/search(/|$)"), "search_archive")
        .when(p.rlike(r"(?i)/category(/|$)"), "category_archive")
        .when(p.rlike(r"(?i)/tag(/|$)"), "tag_archive")
        .when(p.rlike(r"(?i)/author(/|$)"), "author_archive")
        .when(p.rlike(r"(?i)/page/\d+(/|$)"), "pagination_archive")
        .when(has_article | p.rlike(r"/\d{4}/\d{1,2}/"), "article")
        .otherwise("landing")
    )


ARCHIVE_TYPES = ("category_archive", "tag_archive", "author_archive", "search_archive", "pagination_archive", "feed")


def excluded(url: Column, prefixes: list[str]) -> Column:
    """Whether the path equals a prefix or lies below one; prefixes may be paths or URLs, trailing * and / don't count."""
    own, hit = bare_path(url), F.lit(False)
    for raw in prefixes:
        p = raw.strip()
        if not p:
            continue
        p = urlsplit(p).path if "://" in p else p
        p = "/" + p.lstrip("/")
        p = p.rstrip("*")
        p = p[:-1] if p.endswith("/") and p != "/" else p
        hit = hit | (own == p)
        if p != "/":
            hit = hit | own.startswith(p + "/")
    return hit


def private_host(url: Column) -> Column:
    h = host(url)
    return h.isin("localhost", "0.0.0.0", "::1") | h.rlike(r"^(127|10)\.") | h.rlike(r"^192\.168\.") | h.rlike(r"^169\.254\.") | h.rlike(r"^172\.(1[6-9]|2\d|3[01])\.")


def slash_redirect(source: Column, final: Column) -> Column:
    """Whether a redirect only adds or drops trailing slashes."""
    return (origin(source) == origin(final)) & (query(source) == query(final)) & (
        bare_path(source) == bare_path(final)
    ) & (path(source) != path(final))


def gated_flow(source: Column, final: Column, chain: Column) -> Column:
    """Whether a redirect leads into another host's sign-in, payment or membership flow."""
    unlock = path(source).rlike(UNLOCK_PATH) | has_key(source, UNLOCK_KEY)
    login = F.exists(
        F.concat(F.array(final), F.coalesce(chain, F.array().cast("array<string>"))),
        lambda u: host(u).rlike(MEMBERSHIP_HOST) & path(u).rlike(MEMBERSHIP_LOGIN)
    )
    asks = path(source).rlike(GATE_SOURCE_PATH) | has_key(source, GATE_SOURCE_KEY)
    gate = path(final).rlike(GATE_PATH)
    return (unlock & login) | ((host(source) != host(final)) & asks & gate)


def redirect_class(source: Column, final: Column, chain: Column) -> Column:
    """automatic (made by a content system), deliberate (same host, short) or unknown."""
    every = F.concat(F.array(source, final), F.coalesce(chain, F.array().cast("array<string>")))
    made = F.exists(every, lambda u: path(u).rlike(MADE_PATH) | has_key(u, MADE_KEY))
    return F.when(made, "automatic").when(
        same_host(source, final) & (F.size(F.coalesce(chain, F.array().cast("array<string>"))) <= 3), "deliberate"
    ).otherwise("unknown")


def resolve(reference: str | None, base: str) -> str | None:
    """Link form of a reference seen on a page, None if it isn't an http(s) URL."""
    try:
        u = urlsplit(urljoin(base, (reference or "").strip()))
        if u.scheme not in ("http", "https") or not u.hostname:
            return None
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return None
    p = quote(u.path or "/", safe="/%:@!$&'()*+,;=~-._")
    if p != "/":
        p = p.rstrip("/")
    pairs = [x for x in u.query.split("&") if x and not x.split("=")[0].lower().startswith(("utm_", "gclid", "fbclid"))]
    return urlunsplit((u.scheme, u.hostname + port, p, quote("&".join(pairs), safe="=&%:@!$'()*+,;/?~-._"), ""))
