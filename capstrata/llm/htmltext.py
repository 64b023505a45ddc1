"""Main text of web pages: site templates found by counting element subtrees per host, then the article's blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.llm.common import columns_of, fresh, numbered
from capstrata.session import stage, unstage

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
# Fixed lists of the HTML vocabulary.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "iframe", "noframes", "noembed", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
#: An opening tag ends the open element of the second set, unless one of the third set lies in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that never hold an article's text.
APART = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "math", "canvas", "object", "embed", "applet", "dialog", "menu", "datalist", "audio", "video", "map", "noframes", "noembed", "search"}
#: Words in class, id or role that name the surroundings of an article.
SURROUNDINGS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "breadcrumb", "breadcrumbs", "byline-ad", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disclaimer", "disqus", "footer", "footnav", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets"}
#: These name a page's head, but also an article's own.
HEADS = {"header", "topbar", "site-header"}
#: Blocks of running text: inside an article they are its content, however many pages share them.
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "tr", "caption", "figcaption"}


@dataclass
class Page:
    """Elements in page order; an element's subtree is the range up to its end. Items are texts and child numbers."""

    tags: list[str]
    attrs: list[dict[str, str]]
    ends: list[int]
    parents: list[int]
    items: list[list]


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return out


def parse(html: str) -> Page:
    """A forgiving element tree: end tags may be missing or stray, and the page may break off anywhere."""
    page = Page(["#page"], [{}], [0], [-1], [[]])
    open_: list[int] = [0]

    depths: dict[str, list[int]] = {}  # places in open_ by tag, so that a stray end tag costs nothing

    def innermost(tags: set[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def close(tags: set[str], within: set[str]) -> None:
        depth = innermost(tags)
        if not depth or depth < innermost(within):
            return
        for i in open_[depth:]:
            page.ends[i] = len(page.tags)
            depths[page.tags[i]].pop()
        del open_[depth:]

    at = 0
    while m := TAG.search(html, at):
        if m.start() > at:
            page.items[open_[-1]].append(unescape(html[at:m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close({tag}, {"table"} if tag in INLINE else set())
            continue
        if tag in CLOSES_P:
            close({"p"}, {"article", "section", "div", "table", "td", "th", "li", "button", "object"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag == "body":
            close({"head"}, set())
        i = len(page.tags)
        page.items[open_[-1]].append(i)
        for values, value in ((page.tags, tag), (page.attrs, attributes(m[3]) if m[3] else {}), (page.ends, i + 1), (page.parents, open_[-1]), (page.items, [])):
            values.append(value)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>?", re.I).search(html, at)
            page.items[i].append(unescape(html[at:end.start() if end else len(html)]) if tag in ("title", "textarea") else "")
            at = end.end() if end else len(html)
        elif tag not in VOID:
            depths.setdefault(tag, []).append(len(open_))
            open_.append(i)
    if at < len(html):
        page.items[open_[-1]].append(unescape(html[at:]))
    for i in open_:
        page.ends[i] = len(page.tags)
    return page


def named(attrs: dict[str, str]) -> set[str]:
    if not attrs:
        return set()
    text = " ".join(attrs.get(a, "") for a in ("class", "id", "role")).lower()
    return {*text.split(), *re.split(r"[^a-z0-9]+", text)} - {""}


def apart(page: Page) -> list[bool]:
    """Which elements, with all they hold, belong to an article's surroundings by their tag, name or state.

    A name does not count on an element that holds the page's main part or headline: it describes the layout there
    ("no-sidebar", "ad-free").
    """
    heads = [0]
    for tag in page.tags:
        heads.append(heads[-1] + (tag in ("h1", "main")))
    out, inside = [False] * len(page.tags), [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        tag, attrs, parent = page.tags[i], page.attrs[i], page.parents[i]
        inside[i] = inside[parent] or tag in ("article", "main")
        if out[parent] or tag in APART:
            out[i] = True
        elif tag == "header" and not inside[i]:
            out[i] = True
        elif attrs and tag not in ("html", "body", "main"):
            names = named(attrs)
            out[i] = (
                bool(names & SURROUNDINGS) and heads[page.ends[i]] == heads[i + 1] and (tag != "article" or bool(names & {"comment", "comments", "related", "promo", "sponsored", "ad", "teaser"}))
                or bool(names & HEADS) and not inside[i]
                or "hidden" in attrs or attrs.get("aria-hidden") == "true"
                or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            )
    return out


def text_sizes(page: Page, out: list[bool]) -> list[int]:
    """Characters of text in every subtree, without surroundings."""
    n = [0] * len(page.tags)
    for i in range(len(page.tags) - 1, -1, -1):
        if not out[i]:
            n[i] = sum(len(x.strip()) if isinstance(x, str) else n[x] for x in page.items[i])
    return n


def regions(page: Page, out: list[bool]) -> list[int]:
    """The outermost articles; without one the main part, the marked body of an article, or the whole page.

    Articles and named elements count only if one of them holds the headline or most of the text of the main part or
    page around it, or if together they hold most of a page without a headline: else they are cards beside the text.
    """
    n = text_sizes(page, out)
    headlines = [0]  # how many come before an element
    for i in range(len(page.tags)):
        headlines.append(headlines[-1] + (page.tags[i] == "h1" and not out[i] and n[i] > 0))
    is_main = lambda i: page.tags[i] == "main" or page.attrs[i].get("role") == "main"
    is_body = lambda i: "articlebody" in page.attrs[i].get("itemprop", "").lower()

    around = [n[0]]  # the text of the main part or page around an element
    for i in range(1, len(page.tags)):
        around.append(n[i] if is_main(i) else around[page.parents[i]])

    def holds_text(found: list[int]) -> bool:
        if any(headlines[page.ends[i]] > headlines[i] or 2 * n[i] >= around[i] for i in found):
            return True
        return not headlines[-1] and 2 * sum(n[i] for i in found) >= around[found[0]]

    for fits, sure in (
        (lambda i: page.tags[i] == "article", lambda found: False),
        (is_main, lambda found: True),
        (lambda i: is_body(i) or bool(named(page.attrs[i]) & {"article", "post", "entry", "story"}), lambda found: any(map(is_body, found))),
    ):
        found, end = [], 0
        for i in range(1, len(page.tags)):
            if i >= end and not out[i] and fits(i):
                found.append(i)
                end = page.ends[i]
        if found and (sure(found) or holds_text(found)):
            return found
    return [0]


def subtree_hashes(page: Page) -> list[int]:
    """A 64-bit hash of every subtree: tags, names and texts, white space aside."""
    h = [0] * len(page.tags)
    for i in range(len(page.tags) - 1, -1, -1):
        parts = [page.tags[i], page.attrs[i].get("class", ""), page.attrs[i].get("id", "")]
        parts += [" ".join(x.split()) if isinstance(x, str) else f"\x00{h[x]}" for x in page.items[i]]
        h[i] = int.from_bytes(blake2b("\x01".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return h


def candidates(page: Page, out: list[bool], small: bool = True) -> list[int]:
    """Subtrees that may be a template: blocks with text that hold less than half of the page's main text.

    That bound is for counting; a block already known as a template goes from short pages too (small=False). Not among them are an article's own running text, whose passages may recur on other pages, and inline elements.
    """
    main = regions(page, out)
    n = text_sizes(page, out)
    total = sum(n[i] for i in main)
    own = [False] * len(page.tags)
    if main != [0]:
        for i in main:
            own[i:page.ends[i]] = [True] * (page.ends[i] - i)
    return [
        i for i in range(1, len(page.tags))
        if n[i] and (not small or 2 * n[i] < total) and page.tags[i] not in INLINE and page.tags[i] not in ("html", "body", "br") and i not in main
        and not (own[i] and page.tags[i] in RUNNING)
    ]


def main_text(page: Page, templates: set[int]) -> str:
    """Blocks of the main regions in page order, joined by one space."""
    out = apart(page)
    if templates:
        h = subtree_hashes(page)
        drop = {i for i in candidates(page, out, small=False) if h[i] in templates}
    else:
        drop = set()
    blocks: list[str] = []
    for region in regions(page, out):
        todo: list = [region]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                blocks.append(x)
            elif not out[x] and x not in drop:
                inline = page.tags[x] in INLINE
                if not inline:
                    blocks.append(" ")
                    todo.append(" ")
                todo += reversed(page.items[x])
        blocks.append(" ")
    return " ".join("".join(blocks).split())


def host_of(url: Column) -> Column:
    """The host in lower case, without user or port; an empty string where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(host, F.lit(""))


@dataclass(frozen=True)
class TemplateRule:
    """A subtree is a template of its host when at least `min_pages` pages and `share` of the host's pages have it.

    From `many_pages` pages on no share is asked of a block that is no running text, however large the host is.
    """

    min_pages: int = 5
    share: float = 0.2
    many_pages: int = 50


def page_key(html: Column) -> list[Column]:
    """128 bits that stand for a page's html."""
    return [F.xxhash64(html).alias("v1"), F.xxhash64(F.lit("second"), html).alias("v2")]


def page_blocks(df: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(host, page, v1, v2, hash, running, counts): the blocks of every page; those that count are less than half of it."""
    pages = df.where(F.col(html).isNotNull()).select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(page_id).cast("string"), F.col(url), F.lit("")).alias("page"), *page_key(F.col(html)), F.col(html).alias("html"))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, key, v1, v2, text in batch.itertuples(index=False):
                page = parse(text)
                h, out = subtree_hashes(page), apart(page)
                counted = {h[i] for i in candidates(page, out)}
                blocks = {h[i]: page.tags[i] in RUNNING for i in candidates(page, out, small=False)}
                rows += [(host, key, v1, v2, x, running, x in counted) for x, running in blocks.items()]
            yield pd.DataFrame(rows, columns=["host", "page", "v1", "v2", "hash", "running", "counts"])

    return pages.mapInPandas(hashes, "host string, page string, v1 long, v2 long, hash long, running boolean, counts boolean")


def site_templates(blocks: DataFrame, n_pages: DataFrame, rule: TemplateRule) -> DataFrame:
    """(host, hash): the template subtrees of every host, counted by Spark over distinct pages."""
    counts = blocks.where("counts").select("host", "page", "hash", "running").distinct().groupBy("host", "hash", "running").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rule.min_pages)
    often = (F.col("n") >= rule.share * F.col("n_pages")) | ~F.col("running") & (F.col("n") >= rule.many_pages)
    return counts.join(n_pages, "host").where(often).select("host", "hash").distinct()


def extract_text(df: DataFrame, page_id: str, url: str, html: str, rule: TemplateRule = TemplateRule(), out: str = "text") -> DataFrame:
    """All columns and the main text of every row's whole html; an existing column of that name is replaced.

    Null or empty html gives an empty text. Pages without a host share the host "". Repeated rows of a page count once
    for the templates and are all returned. A row gets the template hashes of its own blocks, at most as many as it has.
    """
    blocks = stage(page_blocks(df, page_id, url, html))
    n_pages = df.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(page_id).cast("string"), F.col(url), F.lit("")).alias("page")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    mark, host, first, second = fresh([*df.columns, out], "hashes_of_page", "host_of_page", "v1_of_page", "v2_of_page")
    of_page = blocks.join(site_templates(blocks, n_pages, rule), ["host", "hash"]).groupBy("host", "v1", "v2").agg(F.collect_set("hash").alias(mark))
    of_page = stage(of_page).select(F.col("host").alias(host), F.col("v1").alias(first), F.col("v2").alias(second), mark)
    unstage(blocks)
    names = [c for c in df.columns if c.lower() != out.lower()]
    at = names.index(html)
    v1, v2 = page_key(F.col(html))
    keyed = df.select(*columns_of(names), host_of(F.col(url)).alias(host), v1.alias(first), v2.alias(second))
    joined = keyed.join(of_page, [host, first, second], "left").select(*columns_of(names), mark)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(parse(h), set(t) if t is not None else set()) if h else "" for h, t in zip(batch.iloc[:, at], batch.iloc[:, -1])]
            made = batch.iloc[:, :-1].copy()
            made["text"] = texts
            yield made

    plain = numbered(joined)
    schema = plain.drop(plain.columns[-1]).schema.add("text", "string")
    return plain.mapInPandas(extract, schema).toDF(*names, out)
