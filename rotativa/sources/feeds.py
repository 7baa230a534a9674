"""Feeds, site maps and pages: documents in a column become rows of items.

The parsers see one document each and run on Arrow batches; a broken document
gives no items.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = pa.struct([(n, pa.string()) for n in ("url", "titulo", "resumen", "autor", "fecha", "seccion")])
_NAMES = tuple(f.name for f in ITEM)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2].lower()


def _root(xml: str | None) -> ElementTree.Element | None:
    if not xml or "<!DOCTYPE" in xml or "<!ENTITY" in xml:
        return None
    try:
        return ElementTree.fromstring(xml.strip().encode())
    except ElementTree.ParseError:
        return None


def _texts(node: ElementTree.Element) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in node.iter():
        if x is not node and x.text and x.text.strip():
            out.setdefault(_local(x.tag), x.text.strip())
    return out


def feed_items(xml: str | None) -> list[dict[str, str | None]]:
    """Items of an RSS or Atom feed."""
    root = _root(xml)
    out = []
    for x in root.iter() if root is not None else ():
        if _local(x.tag) in ("item", "entry"):
            t = _texts(x)
            link = t.get("link") or next((y.get("href") for y in x if _local(y.tag) == "link" and y.get("href") and y.get("rel", "alternate") == "alternate"), None)
            out.append({
                "url": link or t.get("guid"), "titulo": t.get("title"), "resumen": t.get("description") or t.get("summary") or t.get("encoded") or t.get("content"),
                "autor": t.get("creator") or t.get("name") or t.get("author"), "fecha": t.get("pubdate") or t.get("published") or t.get("updated") or t.get("date"), "seccion": t.get("category"),
            })
    return out


def sitemap_items(xml: str | None) -> list[dict[str, str | None]]:
    """Addresses of a site map, a news site map, or an index of site maps (``seccion`` is ``sitemap`` then)."""
    root = _root(xml)
    out = []
    for x in root if root is not None else ():
        kind = _local(x.tag)
        if kind in ("url", "sitemap"):
            t = _texts(x)
            if t.get("loc"):
                out.append({"url": t["loc"], "titulo": t.get("title"), "resumen": None, "autor": None, "fecha": t.get("publication_date") or t.get("lastmod"), "seccion": "sitemap" if kind == "sitemap" else None})
    return out


def explode_items(df: DataFrame, key: str, xml: str, parse: Callable[[str | None], list[dict[str, str | None]]]) -> DataFrame:
    """(key, posicion, url, titulo, ...): one row for each item of each document."""
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parent, pos, rows = [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                items = parse(x)
                parent += [i] * len(items)
                pos += range(1, len(items) + 1)
                rows += items
            cols = [b.column(0).take(pa.array(parent, pa.int64())), pa.array(pos, pa.int32()), *(pa.array([r[n] for r in rows], pa.string()) for n in _NAMES)]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "posicion", *_NAMES])

    schema = f"k {kind}, posicion int, " + ", ".join(f"{n} string" for n in _NAMES)
    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{xml}`").cast("string")).mapInArrow(scan, schema).withColumnRenamed("k", key)


def newest_first(items: DataFrame, date: str, limit: int) -> DataFrame:
    """The newest items; undated ones come last and never displace dated ones."""
    return items.orderBy(F.desc_nulls_last(date), "url").limit(limit)


class _Page(HTMLParser):
    """Collects titles, meta data and paragraphs of a page."""

    _SKIP = {"script", "style", "nav", "footer", "aside", "form", "noscript", "header"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title = self.h1 = ""
        self.canonical: str | None = None
        self.blocks: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self._open: list[str] = []
        self._text: list[str] | None = None
        self._link = 0
        self._linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "meta":
            name = a.get("property") or a.get("name")
            if name and a.get("content"):
                self.meta.setdefault(name.lower(), a["content"] or "")
            return
        if tag == "link":
            if (a.get("rel") or "").lower() == "canonical":
                self.canonical = self.canonical or a.get("href")
            return
        if tag in ("br", "img", "input", "hr", "source"):
            return
        self._open.append(tag)
        if tag in ("p", "h1", "title"):
            self._text, self._linked = [], 0
        if tag == "a":
            self._link += 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in self._open:
            return
        while self._open.pop() != tag:
            pass
        if tag == "a":
            self._link = max(0, self._link - 1)
        if tag in ("p", "h1", "title") and self._text is not None:
            t = " ".join("".join(self._text).split())
            if tag == "title":
                self.title = self.title or t
            elif tag == "h1":
                self.h1 = self.h1 or t
            elif t and not self._SKIP & set(self._open) and self._linked < 0.8 * len(t):
                # paragraphs that are only links lead elsewhere
                for place in ("article", "main"):
                    if place in self._open:
                        self.blocks[place].append(t)
                self.blocks["body"].append(t)
            self._text = None

    def handle_data(self, data: str) -> None:
        if self._text is not None and not {"script", "style"} & set(self._open):
            self._text.append(data)
            if self._link:
                self._linked += len(data.strip())


def page_fields(html: str | None, least: int = 200) -> dict[str, str | None]:
    """Title, summary, author, section, image, canonical address and body text of a page."""
    p = _Page()
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):
        pass
    m = p.meta
    body = next(("\n".join(p.blocks[k]) for k in ("article", "main", "body") if len("\n".join(p.blocks[k])) >= least), "\n".join(p.blocks["body"]))
    title = m.get("og:title") or m.get("twitter:title") or p.title or p.h1
    return {
        "titulo": title or None, "resumen": m.get("og:description") or m.get("description"), "autor": m.get("author") or m.get("article:author"), "seccion": m.get("article:section"),
        "imagen": m.get("og:image"), "canonica": p.canonical or m.get("og:url"), "texto": body or None,
    }


_PAGE = "titulo string, resumen string, autor string, seccion string, imagen string, canonica string, texto string"


def read_pages(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, titulo, resumen, autor, seccion, imagen, canonica, texto) of the pages in a column."""
    kind = df.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in _PAGE.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [page_fields(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], pa.string()) for n in names)], names=["k", *names])

    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{html}`").cast("string")).mapInArrow(scan, f"k {kind}, {_PAGE}").withColumnRenamed("k", key)


def listing_links(html: Column, host: Column) -> Column:
    """Distinct addresses of one host that a page links to."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"'#]+)"""), F.lit(1))
    return F.array_distinct(F.filter(hrefs, lambda u: F.regexp_extract(u, r"^https?://(?:www\.)?([^/:?]+)", 1) == host))


def log_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of JSON log lines, with or without a prefix; lines without JSON, or with broken JSON, are dropped."""
    text = F.regexp_extract(F.col(column), r"(\{.*\})\s*$", 1)
    return lines.select(F.from_json(F.when(text != "", text), schema, {"mode": "PERMISSIVE"}).alias("j")).where("j IS NOT NULL").select("j.*").dropna(how="all")


def with_headers(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns by what their heading means: the first heading of each group that is there, else null."""
    def norm(h: str) -> str:
        return re.sub(r"[^a-z0-9]+", "_", h.lower().translate(str.maketrans("áéíóúüñ", "aeiouun"))).strip("_")

    have = {norm(c): c for c in df.columns}
    return df.select(*(next((F.col(f"`{have[a]}`") for a in (name, *group) if a in have), F.lit(None).cast("string")).alias(name) for name, group in aliases.items()))
