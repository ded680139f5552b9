"""What report files hold: PDF pages, tables of workbooks and word documents, configuration."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.replies import read_yaml
from tidewater.operators.documents import column_udf


class PageReader(Protocol):
    """Reads a file's pages; a page that can't be read is an exception in its place."""

    def pages(self, content: bytes) -> list[str | Exception]: ...


class PlainPdf:
    """Pages of PDF files whose texts are literal strings in plain or deflated content streams, one
    stream a page, as simple writers make them. Other files need another reader."""

    STREAM = re.compile(rb"<<(?:(?!stream|endobj)[\s\S])*?>>\s*stream\r?\n([\s\S]*?)\r?\nendstream")
    SHOWN = re.compile(rb"\(((?:\\.|[^()\\])*)\)\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^()\\])*\)|[^\]])*)\]\s*TJ|(T\*|Td|TD|ET)")
    STRING = re.compile(rb"\(((?:\\.|[^()\\])*)\)")
    #: Escapes within literal strings.
    ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def literal(self, raw: bytes) -> str:
        plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else self.ESCAPES.get(m[1], m[1]), raw)
        return plain.decode("latin-1")

    def page(self, stream: bytes) -> str:
        out = []
        for m in self.SHOWN.finditer(stream):
            if m[1] is not None:
                out.append(self.literal(m[1]))
            elif m[2] is not None:
                out.extend(self.literal(x) for x in self.STRING.findall(m[2]))
            elif out and not out[-1].endswith("\n"):
                out.append("\n")
        return "".join(out).strip()

    def pages(self, content: bytes) -> list[str | Exception]:
        out: list[str | Exception] = []
        for m in self.STREAM.finditer(content):
            try:
                raw = zlib.decompress(m[1]) if b"FlateDecode" in m[0][: m.start(1) - m.start()] else m[1]
            except zlib.error as broken:
                out.append(broken)
                continue
            if b"BT" in raw:
                out.append(self.page(raw))
        return out


def with_page_starts(pages: Column) -> Column:
    """One text of an array of page texts, each after a line that tells where it starts; a page that
    couldn't be read is null and keeps its line."""
    marked = F.transform(pages, lambda x, i: F.concat(F.lit("\n\n--- Page "), (i + 1).cast("string"), F.lit(" start ---\n"), F.coalesce(x, F.lit(""))))
    return F.array_join(marked, "")


def pdf_texts(spark: SparkSession, path: str, reader: PageReader | None = None) -> DataFrame:
    """(report_id, text, n_pages) of every *.pdf file below a path; the report's id is the file's name.
    A file that can't be opened has a null text."""
    reader = reader or PlainPdf()

    @F.pandas_udf("array<string>")
    def read(contents: pd.Series) -> pd.Series:
        def one(content: bytes) -> list[str | None] | None:
            try:
                return [None if isinstance(p, Exception) else p for p in reader.pages(bytes(content))]
            except Exception:  # noqa: BLE001  whatever a reader raises, the other files go on
                return None

        return pd.Series([one(c) for c in contents], dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.pdf$", "")
    got = files.select(name.alias("report_id"), read("content").alias("pages"))
    return got.select("report_id", F.when(F.col("pages").isNotNull(), with_page_starts("pages")).alias("text"), F.size("pages").alias("n_pages"))


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _sheet_rows(book: zipfile.ZipFile) -> Iterator[list[list[str]]]:
    """The rows of each sheet of a workbook, cells as text in their columns."""
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _plain(t.tag) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        rows = []
        for row in (r for r in ElementTree.fromstring(book.read(name)).iter() if _plain(r.tag) == "row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(c for c in row if _plain(c.tag) == "c"):
                at = re.match(r"[A-Z]+", c.get("r") or "")
                place = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(at[0]))) - 1 if at else k
                value = "".join(t.text or "" for t in c.iter() if _plain(t.tag) in ("v", "t"))
                cells[place] = shared[int(value)] if c.get("t") == "s" and value else value
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        yield rows


def _word_rows(book: zipfile.ZipFile) -> Iterator[list[list[str]]]:
    """The rows of each table of a word document."""
    for table in (t for t in ElementTree.fromstring(book.read("word/document.xml")).iter() if _plain(t.tag) == "tbl"):
        text = lambda cell: "\n".join("".join(t.text or "" for t in p.iter() if _plain(t.tag) == "t") for p in cell if _plain(p.tag) == "p")
        yield [[text(c) for c in row if _plain(c.tag) == "tc"] for row in table if _plain(row.tag) == "tr"]


@column_udf("array<struct<table:int,row:int,column:string,text:string>>")
def office_cells(contents: pd.Series) -> pd.Series:
    """Every cell of every table of a workbook or word document, under the name in its table's first
    row; null for a file that is neither."""

    def one(content):
        try:
            book = zipfile.ZipFile(io.BytesIO(bytes(content)))
            tables = _word_rows(book) if "word/document.xml" in book.namelist() else _sheet_rows(book)
            return [{"table": t, "row": r, "column": n, "text": x} for t, rows in enumerate(tables) for r, row in enumerate(rows[1:]) for n, x in zip(rows[0], row, strict=False)]
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, TypeError):
            return None

    return pd.Series([one(c) for c in contents], dtype=object)


def office_tables(spark: SparkSession, path: str, chosen: list[int] | None = None) -> DataFrame:
    """(file, table, row, column, text) of the *.xlsx and *.docx files below a path, of the chosen
    tables of each file (all, if None), one below the other."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,docx}").option("recursiveFileLookup", "true").load(path)
    cells = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.inline(office_cells("content")))
    return cells if chosen is None else cells.filter(F.col("table").isin(chosen))


#: What a YAML list of evaluation searches gives.
SEARCHES = "array<struct<query:string,expected_reports:array<string>,min_year:int,max_year:int,modes:array<int>,agencies:array<string>,document_types:array<string>,cutoff:double>>"


@column_udf(SEARCHES)
def searches_from_yaml(texts: pd.Series) -> pd.Series:
    """The searches that a YAML text lists, with what each is expected to find; null if it can't be read."""
    import yaml

    def one(text):
        try:
            rows = read_yaml(text) if text else None
        except yaml.YAMLError:
            return None
        if not isinstance(rows, list):
            return None
        out = []
        for r in rows:
            s = r.get("settings") or {}
            out.append({
                "query": r.get("query"), "expected_reports": [str(x) for x in r.get("expected_reports") or []], "min_year": s.get("min_year"), "max_year": s.get("max_year"), "modes": s.get("modes"),
                "agencies": s.get("agencies"), "document_types": s.get("document_types"), "cutoff": float(s.get("relevanceCutoff") or 0),
            })
        return out

    return pd.Series([one(t) for t in texts], dtype=object)


def evaluation_searches(spark: SparkSession, path: str) -> DataFrame:
    """A row for each search of the YAML files at a path."""
    return spark.read.text(path, wholetext=True).select(F.inline(searches_from_yaml("value")))


def configuration(spark: SparkSession, path: str) -> dict:
    """The settings of a YAML file; a file that isn't there raises, an empty one has none."""
    import yaml

    rows = spark.read.text(path, wholetext=True).collect()
    return (yaml.safe_load(rows[0]["value"]) or {}) if rows else {}
