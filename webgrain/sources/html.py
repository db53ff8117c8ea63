"""The one Python pass over HTML: a tolerant tree from the standard library's tokenizer, then a row of extracted values.

Everything after it is native. Rows stream through Arrow batches; raw HTML doesn't leave the pass.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from webgrain.functions.urls import resolve

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript svg template".split())
#: Open elements that a start tag closes, and the ancestors beyond which that doesn't reach.
CLOSES = {
    "p": {"p"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"}
}
SCOPES = frozenset("ul ol dl table select body html div section article main".split())
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)

# Core properties of structured-data types.
CORE_PROPERTIES = {
    "Article": ["headline", "author", "datePublished"],
    "BlogPosting": ["headline", "author", "datePublished"],
    "Product": ["name"],
    "Review": ["itemReviewed", "reviewRating", "author"],
    "AggregateRating": ["ratingValue", "reviewCount"],
    "FAQPage": ["mainEntity"],
    "Organization": ["name", "url"],
    "BreadcrumbList": ["itemListElement"],
}
# Wordings of calls to action, questions, cited claims and follow-up topics.
ACTION = re.compile(r"\b(get|start|try|buy|shop|book|schedule|contact|request|download|subscribe|sign up|learn more|demo|quote)\b", re.I)
QUESTION = re.compile(r"\?|^(what|why|how|when|where|who|which|can|does|is|are|should)\b", re.I)
CLAIM = re.compile(r"\b\d+(?:\.\d+)?%?\b[^.]{0,160}(?:according to|source:|study|report|research|data from)", re.I)
FOLLOW_UP = re.compile(r"price|cost|compare|alternative|benefit|process|how|why|who|when|requirement|limitation|next step", re.I)
STYLED = re.compile(r"(btn|button|cta|primary)", re.I)
# File names of images that say nothing, and extensions.
EXTENSION = re.compile(r"\.[a-z0-9]{2,5}$", re.I)
OPAQUE_NAME = re.compile(r"[a-f0-9_-]{20,}", re.I)
CAMERA_NAME = re.compile(r"(img|image|photo|pic|dsc|untitled|screenshot)[-_ ]?\d*|[a-f0-9_-]{12,}", re.I)
#: A title as a page writes it.
TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S | re.A)
HIDDEN = re.compile(r"\b(sr-only|visually-hidden|screen-reader)")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n is self or n.tag not in DROPPED:
                stack.extend(reversed(n.children))
        return " ".join("".join(out).split())

    def up(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def within(self, *tags: str) -> bool:
        return any(n.tag in tags for n in self.up())


class Tree(HTMLParser):
    """A document tree; end tags without a start are ignored, open elements end with their ancestors."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        closing = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        n = self.at
        while n.parent is not None and n.tag not in SCOPES:
            if n.tag in closing:
                self.at = n.parent
                break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def json_types(value) -> list[str]:
    """Types of a block's top level and graph, in order, once each."""
    out: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop(0)
        if isinstance(v, list):
            stack = v + stack
        elif isinstance(v, dict):
            own = v.get("@type")
            out += [own] if isinstance(own, str) else [t for t in own if isinstance(t, str)] if isinstance(own, list) else []
            if "@graph" in v:
                stack.insert(0, v["@graph"])
    return list(dict.fromkeys(out))


def missing_properties(value) -> list[str]:
    out, stack = [], [value]
    while stack:
        v = stack.pop(0)
        if isinstance(v, list):
            stack = v + stack
        elif isinstance(v, dict):
            kinds = v.get("@type")
            for t in [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []:
                out += [f"{t}: {p}" for p in CORE_PROPERTIES.get(t, []) if isinstance(t, str) and (p not in v or v[p] == "")]
            if v.get("@graph"):
                stack.insert(0, v["@graph"])
    return out


def structured_block(raw: str) -> dict:
    raw = raw.strip()
    try:
        value = json.loads(raw)
    except json.JSONDecodeError as e:
        return {"raw": raw, "types": [], "valid": False, "error": f"line {e.lineno}, column {e.colno}: {e.msg}", "issues": []}
    return {"raw": raw, "types": json_types(value), "valid": True, "error": None, "issues": missing_properties(value)}


def main_action(nodes: list[Node], base: str) -> dict | None:
    """The likeliest call to action: wording 4, styling 3, hero 3, header 1, footer -2; the first of the best, from 2."""
    best = None
    for n in nodes:
        if n.tag not in ("a", "button") or not n.attrs.get("href") or n.attrs.get("aria-hidden") == "true":
            continue
        text, url = n.text() or " ".join(n.attrs.get("aria-label", "").split()), resolve(n.attrs["href"], base)
        if not text or not url:
            continue
        hero = any("hero" in a.attrs.get("class", "") or "hero" in a.attrs.get("id", "") for a in [n, *n.up()])
        header, footer = n.within("header", "nav"), n.within("footer")
        styled = STYLED.search(f"{n.attrs.get('class', '')} {n.attrs.get('role', '')}")
        score = 4 * bool(ACTION.search(text)) + 3 * bool(styled) + 3 * hero + header - 2 * footer
        place = "hero" if hero else "header" if header else "footer" if footer else "main" if n.within("main") else "unknown"
        if score >= 2 and (best is None or score > best["score"]):
            best = {"text": text, "url": url, "location": place, "score": score, "confidence": min(0.98, 0.35 + 0.075 * score)}
    return best


def image_row(n: Node, base: str) -> dict | None:
    src = resolve(n.attrs.get("src", ""), base)
    if not src:
        return None
    name = unquote(urlsplit(src).path.split("/")[-1]) or "image"
    opaque = not EXTENSION.search(name) and bool(OPAQUE_NAME.fullmatch(name))
    stem = re.sub(r"\.[^.]+$", "", name)
    poor = not opaque and (not stem or bool(CAMERA_NAME.fullmatch(stem) or re.search(r"[\s_]", stem)))
    figure = next((a for a in n.up() if a.tag == "figure"), None)
    caption = next((c.text() for c in figure.walk() if c.tag == "figcaption"), "") if figure else ""
    context = (caption or (n.parent.text() if n.parent else "") or " ".join(n.attrs.get("title", "").split()))[:180]
    return {
        "src": src,
        "alt": " ".join(n.attrs.get("alt", "").split()),
        "filename": name,
        "opaque": opaque,
        "poor_name": poor,
        "context": context
    }


def extract(url: str, html: str | None, headers: dict[str, str] | None = None) -> dict:
    """Values of one page. A null or empty document has empty values."""
    html, headers = html or "", {k.lower(): v for k, v in (headers or {}).items()}
    root = Tree(html).root
    nodes = list(root.walk())
    first = lambda *tags: next((n for n in nodes if n.tag in tags), None)
    meta: dict[str, str] = {}
    for n in nodes:
        if n.tag == "meta":
            meta.setdefault(
                (n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("itemprop") or "").lower(),
                " ".join(n.attrs.get("content", "").split())
            )
    prop = {n.attrs["itemprop"] for n in nodes if "itemprop" in n.attrs}
    times = [n.attrs["datetime"] for n in nodes if n.tag == "time" and n.attrs.get("datetime")]
    robots = ",".join(
        [headers.get("x-robots-tag", "")] + [
            n.attrs.get("content", "") for n in nodes if n.tag == "meta" and n.attrs.get("name", "").lower() in ("robots", "googlebot")
        ]
    )
    headings = [{"text": t, "level": int(n.tag[1])} for n in nodes if re.fullmatch("h[1-6]", n.tag) and (t := n.text())]
    jump = next(
        (f"H{a['level']} to H{b['level']}" for a, b in zip(headings, headings[1:], strict=False) if b["level"] > a["level"] + 1), None
    )
    main, body = first("main"), first("body")
    text = (main.text() if main else "") or (body.text() if body else " ".join(root.text().split()) if not first("html") else "")
    by_id = {n.attrs["id"]: n for n in nodes if n.attrs.get("id")}
    links, host = [], urlsplit(url).hostname
    for n in nodes:
        if n.tag == "a" and "href" in n.attrs and (target := resolve(n.attrs["href"], url)):
            labelled = " ".join(t for i in n.attrs.get("aria-labelledby", "").split() if i in by_id and (t := by_id[i].text()))
            hidden = " ".join(c.text() for c in n.walk() if HIDDEN.search(c.attrs.get("class", "")))
            name = " ".join((n.text() or n.attrs.get("aria-label", "") or labelled or n.attrs.get("title", "") or hidden).split())
            if not re.fullmatch(r"skip (to )?(main )?content", name, re.I):
                links.append({"text": name, "url": target, "internal": urlsplit(target).hostname == host})
    images = [x for n in nodes if n.tag == "img" and n.attrs.get("src") and (x := image_row(n, url))]
    active = ("img", "script", "iframe", "source", "video", "audio")
    loads = [n.attrs.get("src", "") for n in nodes if n.tag in active] + [
        n.attrs.get("href", "") for n in nodes if n.tag == "link" and n.attrs.get("rel", "").lower() == "stylesheet"
    ]
    blocks = [
        structured_block(
            "".join(c for c in n.children if isinstance(c, str))
        ) for n in nodes if n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json"
    ]
    canonical = next(
        (n.attrs["href"] for n in nodes if n.tag == "link" and n.attrs.get("rel", "").lower() == "canonical" and n.attrs.get("href")), None
    )
    published = meta.get("article:published_time") or meta.get("datepublished") or (times[0] if times else None)
    modified = meta.get("article:modified_time") or meta.get("datemodified") or headers.get("last-modified")
    questions = [h["text"] for h in headings if QUESTION.search(h["text"])]
    title = first("title")
    return {
        "title": title.text() if title else "",
        "title_markup": written[1] if (written := TITLE.search(html)) else "",
        "description": meta.get("description", ""),
        "lang": " ".join((first("html").attrs.get("lang", "") if first("html") else "").split()) or None,
        "has_viewport": "viewport" in meta,
        "has_main": main is not None,
        "has_article": bool(first("article")) or meta.get("og:type", "").lower() == "article" or any(
            "Article" in n.attrs.get("itemtype", "") for n in nodes
        ),
        "has_author": "author" in meta or "author" in prop or any(
            n.attrs.get("rel", "").lower() == "author" or "author" in n.attrs.get("class", "").split() for n in nodes
        ),
        "published": published,
        "modified": modified,
        "last_modified": headers.get("last-modified"),
        "canonical": resolve(canonical, url) if canonical else None,
        "robots": [x for x in re.split(r"[,\s]+", robots.lower()) if x],
        "headings": headings,
        "heading_skip": jump,
        "schemas": blocks,
        "text": text,
        "paragraphs": sum(1 for n in nodes if n.tag == "p" and n.within("main", "article") and n.text()),
        "links": links,
        "question_headings": len(questions),
        "cited_claims": len(CLAIM.findall(text)),
        "follow_up": bool(FOLLOW_UP.search(" ".join(h["text"] for h in headings if h["level"] == 2))),
        "list_count": sum(1 for n in nodes if n.tag in ("ul", "ol") and n.within("main", "article")),
        "table_count": sum(1 for n in nodes if n.tag == "table" and n.within("main", "article")),
        "image_count": sum(1 for n in nodes if n.tag == "img"),
        "images_without_alt": sum(1 for n in nodes if n.tag == "img" and not n.attrs.get("alt", "").strip()),
        "images": images,
        "insecure": [x for x in loads if x.lower().startswith("http://")] if url.startswith("https:") else [],
        "action": main_action(nodes, url),
        "html_chars": len(html),
    }


SCHEMA = """title string, title_markup string, description string, lang string, has_viewport boolean, has_main boolean, has_article boolean, has_author boolean,
published string, modified string, last_modified string, canonical string, robots array<string>,
headings array<struct<text:string,level:int>>, heading_skip string,
schemas array<struct<raw:string,types:array<string>,valid:boolean,error:string,issues:array<string>>>, text string, paragraphs int,
links array<struct<text:string,url:string,internal:boolean>>, question_headings int, cited_claims int, follow_up boolean,
list_count int, table_count int, image_count int, images_without_alt int,
images array<struct<src:string,alt:string,filename:string,opaque:boolean,poor_name:boolean,context:string>>, insecure array<string>,
action struct<text:string,url:string,location:string,score:int,confidence:double>, html_chars int"""


def extract_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages (key, url, html, and headers, a map, if there) with the extracted columns in html's place; other columns are
    left out. Batches go through Arrow; key and url are passed on as they are."""
    kind = pages.select(key).dtypes[0][1]
    headers = F.col("headers") if "headers" in pages.columns else F.lit(None).cast("map<string,string>")
    shape = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls, htmls, given = (b.column(i).to_pylist() for i in (1, 2, 3))
            rows = [extract(u or "", h, dict(x) if x else None) for u, h, x in zip(urls, htmls, given, strict=True)]
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in shape]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=[key, "url", *shape.names])

    return pages.select(key, "url", "html", headers.alias("headers")).mapInArrow(run, f"{key} {kind}, url string, {SCHEMA}")
