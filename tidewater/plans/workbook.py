"""Results as a workbook with a summary, and stage folders published under a time."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime
from xml.sax.saxutils import escape
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession

#: The parts that every workbook has.
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="' + _MAIN + '" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{}</sheets></workbook>'
#: Characters that XML can't hold.
_BAD = dict.fromkeys([*range(9), 11, 12, *range(14, 32)])


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An xlsx file of named sheets, given as rows of cells; numbers stay numbers, None is empty."""

    def cell(x) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"<c><v>{x}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x).translate(_BAD))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", _TYPES.format("".join(map(_SHEET_TYPE.format, n))))
        z.writestr("_rels/.rels", _RELS.format(_REL.format(1, "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format("".join(_REL.format(k, "worksheet", f"worksheets/sheet{k}.xml") for k in n)))
        z.writestr(
            "xl/workbook.xml",
            _BOOK.format("".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(n, sheets, strict=True))),
        )
        for k, rows in zip(n, sheets.values(), strict=True):
            body = "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows)
            z.writestr(
                f"xl/worksheets/sheet{k}.xml",
                f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>',
            )
    return out.getvalue()


def result_workbook(results: DataFrame, summary: dict, most: int = 5000) -> bytes:
    """The results of one search (which are limited to `most` rows) with a sheet that sums them up."""
    rows = results.limit(most).collect()
    table = [results.columns, *[list(r) for r in rows]]
    return workbook({"Summary": [[k, v] for k, v in summary.items()] + [["Results", len(rows)]], "Results": table})


def publish(spark: SparkSession, folder: str, to: str, now: datetime | None = None, attempts: int = 3) -> str:
    """Copies a folder below `to` under the time in New Zealand, as 2024-01-31_12:00:00 with dashes for
    colons; returns the new path. A copy that fails is tried again and leaves nothing behind."""
    at = (now or datetime.now(ZoneInfo("UTC"))).astimezone(ZoneInfo("Pacific/Auckland")).strftime("%Y-%m-%d_%H-%M-%S")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(f"{to.rstrip('/')}/{at}")
    part = jvm.org.apache.hadoop.fs.Path(f"{to.rstrip('/')}/_{at}")
    fs = target.getFileSystem(conf)
    for attempt in range(attempts):
        try:
            fs.delete(part, True)
            jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, part, False, conf)
            break
        except Exception:
            fs.delete(part, True)
            if attempt == attempts - 1:
                raise
    fs.rename(part, target)
    return target.toString()
