"""The two Python helpers: article text and links of HTML pages (vectorised, standard library parser)."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose text is never shown, and elements that end an open paragraph.
HIDDEN = {"script", "style", "template", "noscript"}
BLOCKS = {"p", "div", "article", "main", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "aside", "form", "blockquote", "pre"}


class _Page(HTMLParser):
    """Paragraphs by container, and links in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.paragraphs: dict[str, list[str]] = {"article": [], "main": [], "page": []}
        self.seen: set[str] = set()
        self.text: list[str] | None = None
        self.hidden = 0
        self.links: list[dict] = []
        self.label: list[str] | None = None

    def end_paragraph(self) -> None:
        if self.text is not None:
            t = " ".join("".join(self.text).split())
            if t:
                for place in ("article", "main"):
                    if place in self.open:
                        self.paragraphs[place].append(t)
                self.paragraphs["page"].append(t)
            self.text = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.end_paragraph()
        if tag in ("article", "main"):
            self.open.append(tag)
            self.seen.add(tag)
        if tag == "p":
            self.text = []
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.links.append({"pos": len(self.links), "href": a["href"].strip(), "text": "", "rel": a.get("rel") or "", "type": ""})
            self.label = []
        if tag == "link" and a.get("href"):
            self.links.append({"pos": len(self.links), "href": a["href"].strip(), "text": "", "rel": a.get("rel") or "", "type": (a.get("type") or "").lower()})

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self.end_paragraph()
        if tag in ("article", "main") and tag in self.open:
            self.open.remove(tag)
        if tag == "a" and self.label is not None:
            last = next(x for x in reversed(self.links) if not x["rel"] == "alternate" or x["type"] == "")
            last["text"] = " ".join("".join(self.label).split())
            self.label = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.text is not None:
            self.text.append(data)
        if self.label is not None:
            self.label.append(data)


def _parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.end_paragraph()
    return page


def article_text_of(html: str | None, most: int = 5000) -> str:
    """Text of each closed or implicitly closed paragraph once: those in an article, else in main, else of the page."""
    page = _parse(html)
    place = "article" if "article" in page.seen else "main" if "main" in page.seen else "page"
    return " ".join(page.paragraphs[place])[:most]


def links_of(url: str | None, html: str | None) -> list[dict]:
    """Links with absolute addresses, in page order."""
    return [x | {"href": urljoin(url or "", x["href"])} for x in _parse(html).links]


LINK = "array<struct<pos: int, href: string, text: string, rel: string, type: string>>"


def extract_article_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(article_text_of)

    return run(html)


def extract_links(url: Column, html: Column) -> Column:
    @F.pandas_udf(LINK)
    def run(urls: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([links_of(u, h) for u, h in zip(urls, pages, strict=True)])

    return run(url, html)
