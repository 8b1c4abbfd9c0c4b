"""Documents of a filing from its index page: the rows of the page's tables, in Arrow batches or as a table function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Endings and types of documents that hold text or do not, and words of names that speak for an earnings release.
TEXT_ENDINGS = (".htm", ".html", ".txt", ".xml", ".xhtml")
BINARY_ENDINGS = (".bmp", ".gif", ".jpeg", ".jpg", ".pdf", ".png", ".tif", ".tiff", ".xls", ".xlsx", ".zip")
BINARY_TYPES = ("GRAPHIC", "PDF", "ZIP", "EXCEL", "XML GRAPHIC")
RELEASE_WORDS = "earnings|results|release|guidance|outlook|financial"

#: Pages of a batch that are parsed before their rows are handed on.
BATCH = 1_000

#: What may stand between < and > so that the parser reads it in one way only: tags whose attributes are bare or quoted,
#: document types, comments without a dash.
_PLAIN = re.compile(
    r"""(/?)(?!script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext)([a-z][a-z0-9]*)"""
    r"""((?:[ \t\r\n]+[a-z][a-z0-9-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[a-z0-9_.#%-]+))?)*)[ \t\r\n]*|!(?:--[^<>-]*--|doctype[^<>\[\]]*)""",
    re.ASCII | re.IGNORECASE,
)
#: A closed cell of text and at most one link, or any other tag and the text after it, or a < that begins neither.
_PIECE = re.compile(r"""<(?:t[dh](?: [a-z-]+="[^"<>]*")*+>([^<]*+)(?:<a href="([^"<>]*+)">([^<]*+)</a>([^<]*+))?+</t[dh]>|([^<>]++)>([^<]*+))|(<)""", re.ASCII)
_READ = ("tr", "td", "th", "a", "table")
_KNOWN = {end + case(tag): (tag, bool(end), "") for tag in _READ for end in ("", "/") for case in (str.lower, str.upper)}
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9-]*)(?:=("[^"]*"|'[^']*'|[^ \t\r\n]+))?""", re.ASCII | re.IGNORECASE)
_PLAIN_LINK = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*", re.ASCII)
_PLAIN_ADDRESS = re.compile(r"https?://[A-Za-z0-9.-]+/(?:[A-Za-z0-9_-]+/)*[A-Za-z0-9_.-]*", re.ASCII)

Row = tuple[list[str], list[str]]


class _Rows(HTMLParser):
    """Finished rows of all tables in `done`. Rows that stand within a cell of another row are rows of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[Row] = []

    def _end_cell(self) -> None:
        if self.open and (cell := self.open[-1].pop("cell", None)) is not None:
            self.open[-1]["cells"].append(" ".join(" ".join(cell).split()))

    def _end_row(self) -> None:
        if self.open:
            self._end_cell()
            row = self.open.pop()
            if row["cells"]:
                self.done.append((row["cells"], row["links"]))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            if self.open and "cell" not in self.open[-1]:
                self._end_row()
            self.open.append({"cells": [], "links": []})
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            self.open[-1]["cell"] = []
        elif self.open and tag == "a" and (link := dict(attrs).get("href")):
            self.open[-1]["links"].append(link.strip())

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table" and self.open and "cell" not in self.open[-1]:
            self._end_row()

    def handle_data(self, data: str) -> None:
        if self.open and "cell" in self.open[-1]:
            self.open[-1]["cell"].append(data)


def _attributes(text: str) -> list[tuple[str, str | None]]:
    return [(name.lower(), unescape(value[1:-1] if value[:1] in ('"', "'") else value) if value else None) for name, value in _ATTRIBUTE.findall(text)]


def _tag(text: str) -> tuple[str, bool, str] | None:
    """(name, whether it ends, attributes) of what stands between < and >; no name if it ends no row or cell, None if not plain."""
    if not (found := _PLAIN.fullmatch(text)):
        return None
    end, name, attributes = found.groups("")
    if end and attributes:
        return None
    return (name.lower() if name.lower() in _READ else ""), bool(end), attributes


def _words(text: str) -> str:
    return " ".join((unescape(text) if "&" in text else text).split())


def _plain_rows(html: str) -> _Rows | None:
    """The parser after a page of plain tags and text, with as few steps as can be; None if the page holds other markup."""
    parser = _Rows()
    rows, start, end, data = parser.open, parser.handle_starttag, parser.handle_endtag, parser.handle_data
    for before, link, shown, behind, inner, text, odd in _PIECE.findall(html):
        if inner:
            if (tag := _KNOWN.get(inner) or _tag(inner)) is None:
                return None
            name, ends, attributes = tag
            if ends:
                if name:
                    end(name)
            elif name:
                start(name, _attributes(attributes) if name == "a" else [])
            if text:
                data(unescape(text))
        elif odd:
            return None
        elif rows:
            row = rows[-1]
            if "cell" in row:
                parser._end_cell()
            if link:
                row["links"].append(unescape(link).strip())
            row["cells"].append(_words(f"{before} {shown} {behind}" if shown or behind else before))
    return parser


def table_rows(html: str | None) -> list[Row]:
    """(cells, links) of each table row of a page, in order of their ends; a broken page ends all open rows."""
    parser = _plain_rows(html or "")
    if parser is None:
        parser = _Rows()
        parser.feed(html or "")
        parser.close()
    while parser.open:
        parser._end_row()
    return parser.done


def _resolver(address: str | None) -> Callable[[str], str]:
    """`urljoin` with the address; names of files in its folder are put behind the folder, which gives the same."""
    address = address or ""
    folder = address[: address.rindex("/") + 1] if _PLAIN_ADDRESS.fullmatch(address) else None
    return lambda link: folder + link if folder and _PLAIN_LINK.fullmatch(link) else urljoin(address, link)


@udtf(returnType="nth: int, cells: array<string>, links: array<string>")
class TableRows:
    """A row for each table row of the page given: `page_rows` for SQL, where it joins laterally, a page a call."""

    def eval(self, html: str | None, address: str | None) -> Iterator[tuple[int, list[str], list[str]]]:
        resolve = _resolver(address)
        for nth, (cells, links) in enumerate(table_rows(html)):
            yield nth, cells, [resolve(link) for link in links]


def _lists(values: list[str], sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.array(values, pa.string()))


def page_rows(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `pages` (all) once for each table row of their html, with nth, cells and links (resolved
    against the page's address).

    Pages are parsed where they lie, in Arrow batches; nothing is shuffled.
    """
    keep = pages.columns if keep is None else keep
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("_html"), F.col(f"`{url}`").alias("_url"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, BATCH) for k in range(0, batch.num_rows, BATCH)):
                page, nth, cells, n_cells, links, n_links = [], [], [], [], [], []
                for k, (text, address) in enumerate(zip(part.column("_html").to_pylist(), part.column("_url").to_pylist(), strict=True)):
                    resolve = _resolver(address)
                    for n, (c, l) in enumerate(table_rows(text)):
                        page.append(k)
                        nth.append(n)
                        cells += c
                        n_cells.append(len(c))
                        links += map(resolve, l)
                        n_links.append(len(l))
                kept = part.select(range(len(keep))).take(pa.array(page, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(nth, pa.int32()), _lists(cells, n_cells), _lists(links, n_links)], [*keep, "nth", "cells", "links"])

    schema = rows.drop("_html", "_url").schema.add("nth", IntegerType()).add("cells", ArrayType(StringType())).add("links", ArrayType(StringType()))
    return rows.mapInArrow(parse, schema)


def filing_documents(pages: DataFrame, base: str = "https://www.sec.gov/Archives/edgar/data") -> DataFrame:
    """The documents that index pages(cik, accession, primary_document, url, html) list, one row each.

    A table row names a document if it has four cells or more and the third is neither empty nor the heading. Its
    address is the row's first link that ends in the name, else the one of the archive.
    """
    rows = page_rows(pages, keep=["cik", "accession", "primary_document"]).where(F.size("cells") >= 4)
    name = F.trim(F.get("cells", F.lit(2)))
    rows = rows.select("cik", "accession", "primary_document", "nth", name.alias("document_name"), F.upper(F.trim(F.get("cells", F.lit(3)))).alias("document_type"), F.trim(F.get("cells", F.lit(1))).alias("description"), "links")
    rows = rows.where((F.col("document_name") != "") & (F.lower("document_name") != "document"))
    own = F.get(F.filter("links", lambda x: x.endswith(F.col("document_name"))), F.lit(0))
    home = F.concat_ws("/", F.lit(base), F.col("cik").cast("long").cast("string"), F.replace("accession", F.lit("-"), F.lit("")), F.col("document_name"))
    primary = F.coalesce(F.col("document_name") == F.col("primary_document"), F.lit(False))
    return rows.select("cik", "accession", "nth", "document_name", "document_type", "description", F.coalesce(own, home).alias("source_uri"), primary.alias("is_primary"))


def is_textual(name=None, kind=None):
    """Whether a document holds text, by its name and type."""
    name, kind = F.lower(name if name is not None else F.col("document_name")), kind if kind is not None else F.col("document_type")
    ending = F.regexp_extract(name, r"\.[^./]*$", 0)
    return ~kind.isin(*BINARY_TYPES) & ~ending.isin(*BINARY_ENDINGS) & (ending.isin(*TEXT_ENDINGS) | kind.startswith("EX-99"))


def is_release():
    """Whether a document is an exhibit that may hold an earnings release."""
    words = F.lower(F.concat_ws(" ", "document_name", "description")).rlike(RELEASE_WORDS)
    return ~F.col("is_primary") & is_textual() & (F.col("document_type").startswith("EX-99") | words)
