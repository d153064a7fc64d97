"""Readable text of HTML pages."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Tags that are no content of a page, tags whose text never counts, and the lengths of a text.
NOISE = ("script", "style", "nav", "header", "footer", "noscript", "iframe")
SILENT = ("script", "style", "template", "rt", "rp")
LEAST, MOST = 50, 15_000
#: Where a page's description stands, for addresses that hold a site's name and for all.
SITES = {
    "linkedin.com": (
        ".description__text",
        ".show-more-less-html__markup",
        "[data-testid='job-details-about-the-job-container']",
    ),
}
SELECTORS = (
    ".job-description",
    "#job-details",
    "article.job-description",
    "section.description",
    "[class*='jobDescription']",
    "[id*='jobDescription']",
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELECTOR = re.compile(r"(?P<tag>[a-z][a-z0-9]*)?(?P<tests>(?:[.#][\w-]+|\[[\w-]+\*?='[^']*'\])*)")
_TEST = re.compile(r"\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?P<part>\*?)='(?P<value>[^']*)'\]")


def strip_tags(c: Column) -> Column:
    """Short HTML snippets as text, within the JVM: entities of mark-up read first, tags out, spaces tidied."""
    out = c
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/li|/h[1-6])[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", ""), F.lit(""))


@lru_cache(maxsize=256)
def _selector(text: str) -> tuple[str | None, tuple[dict[str, str | None], ...]]:
    """Tag and attribute tests of a selector of one element: a tag, ``.class``, ``#id``, ``[name='value']`` and ``[name*='part']``."""
    found = _SELECTOR.fullmatch(text)
    if not text or not found:
        raise ValueError(f"selector is not of one element: {text!r}")
    return found["tag"], tuple(m.groupdict() for m in _TEST.finditer(found["tests"]))


def _selects(selector: str, tag: str, attrs: dict[str, str | None]) -> bool:
    wanted, tests = _selector(selector)

    def holds(test: dict[str, str | None]) -> bool:
        if test["cls"]:
            return test["cls"] in (attrs.get("class") or "").split()
        if test["id"]:
            return test["id"] == attrs.get("id")
        value = attrs.get(test["name"])
        return value is not None and (test["value"] in value if test["part"] else test["value"] == value)

    return wanted in (None, tag) and all(holds(test) for test in tests)


class _Page(HTMLParser):
    """One pass over a page: its text without noise, the text of each selector's first element, and its structured data."""

    def __init__(self, selectors: Sequence[str] = ()):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.page: list[str] = []
        self.first: dict[str, list[str]] = {}
        self.data: list[str] = []
        self._open: list[tuple[str, list[str]]] = []  # open elements and the selectors that each is the first of
        self._names: Counter[str] = Counter()  # of open elements
        self._within: list[str] = []  # selectors whose first element is open
        self._noise = self._silent = 0
        self._structured = False
        self._held: list[str] = []

    def read(self, html: str) -> _Page:
        self.feed(html)
        self.close()
        self._end_text()
        return self

    def _end_text(self) -> None:
        held, self._held = "".join(self._held), []
        if self._structured:
            self.data.append(held)
        text = held.strip()
        if text and not self._silent:
            if not self._noise:
                self.page.append(text)
            for selector in self._within:
                self.first[selector].append(text)

    def handle_data(self, data):
        self._held.append(data)

    def handle_comment(self, data):
        self._end_text()

    def handle_starttag(self, tag, attrs):
        self._end_text()
        named = dict(attrs)
        fresh = [s for s in self.selectors if s not in self.first and _selects(s, tag, named)]
        self.first |= {s: [] for s in fresh}
        if tag not in _VOID:
            self._open.append((tag, fresh))
            self._names[tag] += 1
            self._within += fresh
            self._noise += tag in NOISE
            self._silent += tag in SILENT
            self._structured = tag == "script" and named.get("type") == "application/ld+json"

    def handle_endtag(self, tag):
        self._end_text()
        if tag == "script":
            self._structured = False
        if self._names[tag]:
            name = None
            while name != tag:
                name, first = self._open.pop()
                self._names[name] -= 1
                if first:
                    self._within = [s for s in self._within if s not in first]
                self._noise -= name in NOISE
                self._silent -= name in SILENT


def _structured(data: str) -> str | None:
    """The description of a page's structured data as text, if there is one."""
    try:
        read = json.loads(data)
    except (ValueError, RecursionError):
        return None
    shown = read.get("description") if isinstance(read, dict) else None
    return _enough(_snippet(shown)) if isinstance(shown, str) and len(shown) >= LEAST else None


def _snippet(html: str) -> list[str]:
    """All texts of a piece of HTML; navigation and the like count here, scripts don't."""
    page = _Page(("root",))
    page.first["root"] = []
    page._within.append("root")
    return page.read(html).first["root"]


def _enough(parts: list[str]) -> str | None:
    text = "\n".join(parts)
    return text[:MOST] if len(text) >= LEAST else None


def page_text(html: str | None, selectors: Sequence[str] = SELECTORS, url: str | None = None, sites: Mapping[str, Sequence[str]] = SITES) -> str | None:
    """A page's description, texts between tags on a line each: see ``html_to_text``."""
    if not html or not html.strip():
        return None
    own = [s for site, those in sites.items() if site in (url or "") for s in those]
    page = _Page([*own, *selectors]).read(html)
    for data in page.data:
        if (text := _structured(data)) is not None:
            return text
    for selector in (*own, *selectors):
        if (text := _enough(page.first.get(selector, []))) is not None:
            return text
    return _enough(page.page)


def html_to_text(
    pages: DataFrame,
    id_col: str = "page_id",
    html_col: str = "html",
    url_col: str | None = "url",
    selectors: Sequence[str] = SELECTORS,
    sites: Mapping[str, Sequence[str]] = SITES,
) -> DataFrame:
    """(id, text) of whole pages, a row for each of ``pages``.

    The first of these that has 50 characters: the description in structured data; the first element of each selector of a site whose name the
    address holds; the first element of each of ``selectors``; the page without noise.  Else, and for a null or blank page, null.  A
    null address is no site's.  A text is cut to 15,000 characters.  Other columns are not read.
    """
    names, bound = tuple(selectors), {site: tuple(those) for site, those in sites.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [page_text(html, names, url, bound) for html, url in zip(batch["html"], batch["url"], strict=True)]
            yield pd.DataFrame({id_col: batch["id"], "text": pd.Series(texts, batch.index, dtype=object)})

    read = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"))
    schema = StructType([StructField(id_col, read.schema["id"].dataType), StructField("text", StringType())])
    return read.mapInPandas(run, schema)
