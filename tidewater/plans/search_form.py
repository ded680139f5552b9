"""A search form's fields and urls to settings and back, and what a result page shows."""

from __future__ import annotations

from urllib.parse import parse_qs, urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.retrieval import SearchSettings

_FIELDS = ("document_types", "modes", "agencies")


def from_params(params: dict[str, list[str]]) -> tuple[str, SearchSettings]:
    """(query, settings) of a form or a parsed url; missing fields take the defaults, years that
    aren't numbers raise ValueError."""
    base = SearchSettings()
    one = lambda name, default: params.get(name, [default])[0]
    years = int(one("from", base.years[0])), int(one("to", base.years[1]))
    lists = {f: tuple(params[f]) for f in _FIELDS if params.get(f)}
    return one("q", "").strip(), SearchSettings(years, cutoff=float(one("cutoff", base.cutoff)), **lists)


def to_url(base: str, query: str, settings: SearchSettings) -> str:
    """The url that leads to this search."""
    fields = {"q": query, "from": settings.years[0], "to": settings.years[1], "cutoff": settings.cutoff} | {f: getattr(settings, f) for f in _FIELDS}
    return f"{base}?{urlencode(fields, doseq=True)}"


def from_url(url: str) -> tuple[str, SearchSettings]:
    return from_params(parse_qs(url.partition("?")[2]))


def with_links(results: DataFrame, base: str) -> DataFrame:
    """Adds `link`, an anchor to the report, and `search_link`, a url that searches for its text."""
    return results.withColumns({
        "link": F.format_string('<a href="%s/%s">%s</a>', F.lit(base), F.url_encode("report_id"), "report_id"),
        "search_link": F.concat(F.lit(f"{base}?q="), F.url_encode(F.substring("document", 1, 100))),
    })


def export(results: DataFrame, path: str) -> None:
    """The results as CSV with quoted texts, below `path`."""
    results.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
