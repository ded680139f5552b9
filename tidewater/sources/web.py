"""What web pages and file outlines hold: tables, a summary block, outline entries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd

from tidewater.operators.documents import column_udf


class _Tables(HTMLParser):
    """Cells of every table, row by row; with links, a cell is its text and its first link."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = {"text": "", "href": None}
            self.tables[-1][-1].append(self.cell)
        elif tag == "a" and self.cell is not None:
            self.cell["href"] = self.cell["href"] or dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data


def tables(html: str | None) -> list[list[list[dict]]]:
    """Tables of rows of cells (text, href); none for null."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    for row in (r for t in parser.tables for r in t):
        for cell in row:
            cell["text"] = " ".join(cell["text"].split())
    return parser.tables


@column_udf("array<struct<table:int,row:int,column:string,text:string,href:string>>")
def table_cells(htmls: pd.Series) -> pd.Series:
    """Every cell of every table under the name in its table's first row."""
    out = []
    for html in htmls:
        cells = []
        for t, rows in enumerate(tables(html)):
            names = [c["text"] for c in rows[0]] if rows else []
            for r, row in enumerate(rows[1:]):
                cells += [{"table": t, "row": r, "column": n, **c} for n, c in zip(names, row, strict=False)]
        out.append(cells)
    return pd.Series(out, dtype=object)


class _Summary(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.heading, self.on, self.all, self.found = [], None, False, [], False

    def handle_starttag(self, tag, attrs):
        if tag == "h2":
            self.heading, self.on = "", False

    def handle_endtag(self, tag):
        if tag == "h2" and self.heading is not None:
            self.on = "summary" in self.heading.lower()
            self.found = self.found or self.on
            self.heading = None

    def handle_data(self, data):
        if self.heading is not None:
            self.heading += data
            return
        self.all.append(data)
        if self.on:
            self.parts.append(data)


def summary_block(html: str | None) -> str | None:
    """The text between the summary heading and the next, or else of the whole block; null if empty.
    White space is that of HTML: spaces of other kinds are part of the text."""
    parser = _Summary()
    parser.feed(html or "")
    parser.close()
    return re.sub(r"[ \t\n\f\r]+", " ", "".join(parser.parts if parser.found else parser.all)).strip(" ") or None


def flatten_outline(items: list, level: int = 1) -> Iterator[tuple[str, int, str]]:
    """(title, level, page) of an outline in which a list holds the entries below the one before
    it. Entries without a place in the document's structure are left out."""
    for item in items:
        if isinstance(item, list):
            yield from flatten_outline(item, level + 1)
        elif item.get("structured"):
            yield item["title"], level, str(item.get("page", ""))
