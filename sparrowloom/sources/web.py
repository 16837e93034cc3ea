"""Feeds, sitemaps and pages, from texts that were fetched before."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts

#: What a page is stripped of, and where its content is looked for. Fixed values.
DROPPED = {"tags": ("script", "style", "nav", "header", "footer"), "classes": ("sidebar", "navigation", "menu", "comments"), "roles": ("navigation", "banner")}
CONTENT = {"tags": ("article", "main"), "classes": ("content", "post-content"), "ids": ("content",), "roles": ("main",)}


def xml_value(xml: Column, tag: str) -> Column:
    """First value of a tag: of a CDATA section if one directly fills a tag of this name, else of plain text; null if absent."""
    cdata, plain = rf"(?is)<{tag}[^>]*><!\[CDATA\[(.*?)\]\]></{tag}>", rf"(?i)<{tag}[^>]*>([^<]*)</{tag}>"
    first = lambda p: F.get(F.regexp_extract_all(xml, F.lit(p), 1), F.lit(0))
    return texts.trim(F.coalesce(first(cdata), first(plain)))


def xml_values(xml: Column, tag: str, attribute: str | None = None) -> Column:
    """All values of a tag, or of an attribute of it."""
    if attribute:
        return F.regexp_extract_all(xml, F.lit(rf'(?i)<{tag}[^>]*{attribute}="([^"]*)"[^>]*/?>'), 1)
    return F.transform(F.regexp_extract_all(xml, F.lit(rf"(?i)<{tag}[^>]*>([^<]*)</{tag}>"), 1), lambda v: texts.trim(v))


def atom_link(entry: Column) -> Column:
    first = lambda p: F.get(F.regexp_extract_all(entry, F.lit(p), 1), F.lit(0))
    return F.coalesce(first(r'(?i)<link[^>]*rel="alternate"[^>]*href="([^"]+)"'), first(r'(?i)<link[^>]*href="([^"]+)"'))


def feed_items(df: DataFrame, xml: str, keep: list[str] = ()) -> DataFrame:
    """``pos, title, link, guid, description, content, published, author, categories`` of the items of RSS and Atom feeds."""
    x = F.col(xml)
    atom = x.contains("<feed") & x.contains('xmlns="http://www.w3.org/2005/Atom"')
    inner = lambda tag: F.regexp_extract_all(x, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), 1)
    rows = df.select(*keep, atom.alias("_atom"), F.posexplode(F.when(atom, inner("entry")).otherwise(inner("item"))).alias("pos", "_e"))
    e, filled = F.col("_e"), lambda c: F.nullif(c, F.lit(""))
    either = lambda a, b: F.when(F.col("_atom"), a).otherwise(b)
    return rows.select(
        *keep, "pos", xml_value(e, "title").alias("title"), either(atom_link(e), xml_value(e, "link")).alias("link"), either(xml_value(e, "id"), xml_value(e, "guid")).alias("guid"),
        either(F.lit(None), xml_value(e, "description")).alias("description"),
        either(F.coalesce(filled(xml_value(e, "content")), xml_value(e, "summary")), F.coalesce(filled(xml_value(e, "content:encoded")), xml_value(e, "content"))).alias("content"),
        either(F.coalesce(filled(xml_value(e, "published")), xml_value(e, "updated")), xml_value(e, "pubDate")).alias("published"),
        either(xml_value(e, "name"), F.coalesce(filled(xml_value(e, "author")), xml_value(e, "dc:creator"))).alias("author"),
        either(xml_values(e, "category", "term"), xml_values(e, "category")).alias("categories"),
    )


def feed_documents(items: DataFrame, keep: list[str] = (), shortest: int = 50, kind: str = "post") -> DataFrame:
    """Documents of feed items: content, or else description, without tags; shorter ones are left out."""
    text = texts.strip_html(F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("description")))
    made = items.select(*keep, F.coalesce(F.nullif(F.col("guid"), F.lit("")), texts.url_to_id(F.col("link"))).alias("id"), text.alias("content"), F.lit(kind).alias("type"), "title", F.col("link").alias("url"))
    return made.where(F.length("content") >= shortest)


def sitemap_urls(xml: Column, parent: str = "url") -> Column:
    """The first address within each ``parent``, trimmed; only those that begin with http."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?is)<{parent}[^>]*>.*?<loc>([^<]+)</loc>.*?</{parent}>"), 1)
    return F.filter(F.transform(found, lambda u: texts.trim(u)), lambda u: u.startswith("http"))


def wanted(url: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether an address holds any of ``include`` (if there are any) and none of ``exclude``."""
    some = lambda parts: F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(url, p))
    return (some(include) if include else F.lit(True)) & (~some(exclude) if exclude else F.lit(True))


def page_type(url: Column, by_part: dict[str, str], default: str = "page") -> Column:
    """The type of the first part that an address holds."""
    out = F.lit(default)
    for part, kind in reversed(by_part.items()):
        out = F.when(F.contains(url, F.lit(part)), F.lit(kind)).otherwise(out)
    return out


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int | None]] = []  # tag, dropped, number of the content it opens
        self.body: list[str] = []
        self.found: list[list[str]] = []
        self.heads: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes, role = set(a.get("class", "").split()), a.get("role")
        dropped = tag in DROPPED["tags"] or bool(classes & set(DROPPED["classes"])) or role in DROPPED["roles"]
        if tag in _VOID:
            return
        opens = None
        if not dropped and not any(d for _, d, _ in self.open):
            if tag in CONTENT["tags"] or classes & set(CONTENT["classes"]) or a.get("id") in CONTENT["ids"] or role in CONTENT["roles"]:
                opens = len(self.found)
                self.found.append([])
            if tag in ("h1", "title"):
                self.heads.append([])
        self.open.append((tag, dropped, opens))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(d for _, d, _ in self.open):
            return
        tags = {t for t, _, _ in self.open}
        if tags & {"h1", "title"} and self.heads:
            self.heads[-1].append(data)
        if "head" not in tags and "title" not in tags:
            self.body.append(data)
        for _, _, n in self.open:
            if n is not None:
                self.found[n].append(data)


def page_text(html: str) -> tuple[str, str]:
    """Title and content of a page: without furniture, the first content element or else the body, white space collapsed."""
    page = _Page()
    page.feed(html)
    page.close()
    title = next((t for t in ("".join(h).strip() for h in page.heads) if t), "")
    content = "".join(page.found[0] if page.found else page.body)
    return title, re.sub(r"\s+", " ", content).strip()


def pages(df: DataFrame, url: str, html: str, shortest: int = 50) -> DataFrame:
    """``url, title, content`` of every page; null for pages without text or with less than ``shortest`` characters of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [page_text(t) if t else ("", "") for t in batch["html"]]
            kept = [(t, c) if len(c) >= shortest else (None, None) for t, c in made]
            yield pd.DataFrame({"url": batch["url"], "title": [t for t, _ in kept], "content": [c for _, c in kept]})

    return df.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, "url string, title string, content string")
