"""Table functions for SQL: a text becomes rows within a query, by LATERAL. Texts go to Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import sections
from tidewater.operators import documents


class Sections:
    """(section, section_text) of a text's numbered sections, or else of its paragraphs; none for null."""

    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        yield from sections.sections(text)


class Pages:
    """(page, page_text) of a text from one `<< Page n >>` marker to the next; page 0 is what stands before."""

    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        if text is not None:
            head, *pages = text.split("<< Page ")
            yield "0", head
            for page in pages:
                label, _, body = page.partition(" >>")
                yield label, body


def register(spark: SparkSession) -> None:
    """Makes `extract_sections(text)` and `split_pages(text)` known to the session's SQL."""
    for name, rows, shape in (("extract_sections", Sections, "section string, section_text string"), ("split_pages", Pages, "page string, page_text string")):
        spark.udtf.register(name, F.udtf(rows, returnType=shape, useArrow=True))


def q_sections_lateral(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT report_id, s.section, s.section_text FROM {told} t, LATERAL extract_sections(t.told) s", told=documents.numbered_texts(spark, d))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLES = {"sections_lateral": documents.ORACLES["extract_sections"]}
