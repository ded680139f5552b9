"""Report ids, section ids, titles and urls as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Transport modes by number.
MODE_CHARS = ("a", "r", "m")
MODE_LABELS = ("Aviation", "Rail", "Marine")


def key_parts(report_id: Column) -> dict[str, Column]:
    """agency, mode and year of `agency_mode_year_id`; a year that isn't a number is null."""
    return {"agency": F.split_part(report_id, F.lit("_"), F.lit(1)), "mode_char": F.split_part(report_id, F.lit("_"), F.lit(2)), "year": F.split_part(report_id, F.lit("_"), F.lit(3)).try_cast("int")}


def is_valid_id(report_id: Column) -> Column:
    """Four parts; null isn't valid."""
    return F.coalesce(F.size(F.split(report_id, "_")) == 4, F.lit(False))


def mode_of(report_id: Column) -> Column:
    """The mode's number from `_a_`, `_r_`, `_m_`, else from the first digit of a legacy
    `yyyy_ddd`, else null."""
    char = F.nullif(F.regexp_extract(report_id, "_([amr])_", 1), F.lit(""))
    legacy = F.nullif(F.regexp_extract(report_id, r"\d{4}_(\d)\d{2}", 1), F.lit("")).cast("int")
    return F.coalesce(F.when(char == "a", 0).when(char == "r", 1).when(char == "m", 2), F.when(legacy.isin(0, 1, 2), legacy))


def mode_label(mode: Column) -> Column:
    return F.when(mode == "0", MODE_LABELS[0]).when(mode == "1", MODE_LABELS[1]).when(mode == "2", MODE_LABELS[2])


def id_prefix(agency_id: Column) -> Column:
    """The first three parts between hyphens."""
    return F.substring_index(agency_id, "-", 3)


def compose_id(mode: Column, year: Column, number: Column) -> Column:
    """Mode, two-digit year and the number in four digits."""
    return F.concat(mode, F.lpad((year % 100).cast("string"), 2, "0"), F.lpad(number.cast("string"), 4, "0"))


def report_url(agency: Column, agency_id: Column) -> Column:
    """The page of a report; one agency's are lower-cased."""
    url = F.concat_ws("/", F.lit("https://reports.example"), agency, F.lit("report"), agency_id)
    return F.when(agency == "TSB", F.lower(url)).otherwise(url)


def previous_section(section: Column) -> Column:
    """The section before: the last number less one; a last number of 1 gives way to the part in
    front of it, and section 1 is its own predecessor."""
    part = lambda k: F.split_part(section, F.lit("."), F.lit(k)).try_cast("int")
    a, b, c = part(1), part(2), part(3)
    text = lambda *cols: F.concat_ws(".", *[x.cast("string") for x in cols])
    return F.when(c > 1, text(a, b, c - 1)).when(b > 1, text(a, b - 1)).otherwise(text(F.greatest(a - 1, F.lit(1))))


def investigation_type(kind: Column, klass: Column) -> Column:
    """Defined and Systemic investigations and classes 1 to 3 are full; without a kind unknown."""
    return F.when(kind.isin("Defined", "Systemic") | klass.between(1, 3), "full").when(kind.isNull(), "unknown").otherwise("short")


def infer_type(known: Column, pages_read: Column, length: Column) -> Column:
    """A known type stays (null too); an unknown one is full where pages were read or the text has
    40,000 characters, else short."""
    return F.when(~known.eqNullSafe("unknown"), known).when(pages_read, "full").when(length < 40_000, "short").otherwise("full")
