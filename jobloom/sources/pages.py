"""Text and links of HTML pages, parsed with the standard library in batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import JOB_PATHS, JUNK_URL_PARTS, NON_JOB_URL_PARTS

DROPPED = {"script", "style", "nav", "footer", "header", "aside", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
JOB_PATH = re.compile("|".join(f"(?:{p})" for p in JOB_PATHS), re.I)


class _Page(HTMLParser):
    """Text by container and links of a page; furniture elements and classes are skipped with all they hold."""

    def __init__(self, dropped: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.dropped, self.stack, self.text, self.links = dropped, [], {"article": [], "main": [], "body": []}, []
        self.done: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag not in VOID:
            classes = set((a.get("class") or "").split())
            self.stack.append((tag, tag in self.dropped or bool(classes & {"sidebar", "menu"})))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in self.text and not any(t == tag for t, _ in self.stack[:i]):
                    self.done.add(tag)
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        if any(skip for _, skip in self.stack):
            return
        inside = {t for t, _ in self.stack}
        for box in ("article", "main"):
            if box in inside and box not in self.done:
                self.text[box].append(data)
        if "head" not in inside:
            self.text["body"].append(data)


def page_text(html: str | None, tight: bool = True, least: int = 100) -> str | None:
    """Text of the first article, else the first main, else the body (tight), or always of the body; null if shorter than least."""
    if not html:
        return None
    page = _Page(DROPPED if tight else DROPPED - {"noscript"})
    page.feed(html)
    boxes = ("article", "main", "body") if tight else ("body",)
    for box in boxes:
        found = re.sub(r"\s+", " ", "".join(page.text[box])).strip()
        if page.text[box] or box == "body":
            return found if len(found) >= (least if tight else 1) else None
    return None


def page_links(html: str | None, url: str, strict: bool = True, most: int = 30) -> list[str]:
    """Links of a page, absolute and distinct in order. strict: same host, without fragment, job-like, at most `most`."""
    page = _Page(set())
    page.feed(html or "")
    out: dict[str, None] = {}
    for href in page.links:
        if href.startswith(("#", "javascript:")) or (strict and href.startswith("mailto:")):
            continue
        try:
            full = urljoin(url, href)
            host = urlsplit(full).hostname
        except ValueError:
            continue
        if any(p in full for p in NON_JOB_URL_PARTS):
            continue
        if strict:
            full = urldefrag(full)[0]
            if host is None or host != urlsplit(url).hostname or any(p in full.lower() for p in JUNK_URL_PARTS) or not JOB_PATH.search(full):
                continue
        out[full] = None
    return list(out)[:most] if strict else list(out)


def read_pages(pages: DataFrame, tight: bool = True) -> DataFrame:
    """(url, text, links) of pages (url, html). Only these two columns leave the JVM."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"url": pdf.url, "text": pd.Series([page_text(h, tight) for h in pdf.html], dtype=object, index=pdf.index), "links": pd.Series([page_links(h, u, tight) for h, u in zip(pdf.html, pdf.url, strict=True)], dtype=object, index=pdf.index)})

    return pages.select("url", "html").where(F.col("url").isNotNull()).mapInPandas(parse, "url string, text string, links array<string>")


def allowed(rules: str | None, path: str, agent: str = "jobloom") -> bool:
    """Whether robots rules allow a path; missing rules allow all."""
    from urllib.robotparser import RobotFileParser

    if not rules:
        return True
    parser = RobotFileParser()
    parser.parse(rules.splitlines())
    return parser.can_fetch(agent, path)
