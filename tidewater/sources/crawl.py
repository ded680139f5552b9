"""Listings and pages of web sites, behind a fetcher that tests replace."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Fetcher(Protocol):
    """Gives (status, body) of a url, or raises OSError."""

    def get(self, url: str) -> tuple[int, str]: ...


def fetch(fetcher: Fetcher, url: str, pause: float = 1.0) -> tuple[str, str | None]:
    """(outcome, body): `ok` with the body for status 200, `missing` for 404, `failed` else. What
    fails is tried once more after a pause of random length."""
    for attempt in range(2):
        try:
            status, body = fetcher.get(url)
        except OSError:
            status, body = 0, ""
        if status == 200:
            return "ok", body
        if status == 404:
            return "missing", None
        if attempt == 0:
            time.sleep(pause * (0.5 + random.random()))  # noqa: S311  jitter, no secret
    return "failed", None


def crawl(listings: DataFrame, fetcher: Fetcher, ids: Callable[[str], list[str]], pause: float = 1.0) -> DataFrame:
    """(listing, page, report_id) of rows (listing, url with {page}): the pages of each listing from 1
    on, until one is empty, has no new id or fails. Listings are dealt out over the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for listing, url in zip(b["listing"], b["url"], strict=True):
                seen: set[str] = set()
                page = 1
                while True:
                    outcome, body = fetch(fetcher, url.format(page=page), pause)
                    new = [i for i in dict.fromkeys(ids(body)) if i not in seen] if outcome == "ok" and body else []
                    if not new:
                        break
                    seen.update(new)
                    yield pd.DataFrame({"listing": listing, "page": page, "report_id": new})
                    page += 1

    return listings.select("listing", "url").repartition("listing").mapInPandas(run, "listing string, page int, report_id string")


def fetched(urls: DataFrame, fetcher: Fetcher, url: str = "url", pause: float = 1.0) -> DataFrame:
    """Adds outcome and body to every row, one request a row and a second try where it fails."""
    columns = ", ".join(f"`{n}` {t}" for n, t in urls.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [fetch(fetcher, u, pause) for u in b[url]]
            yield b.assign(outcome=[o for o, _ in got], body=[x for _, x in got])

    return urls.mapInPandas(run, f"{columns}, outcome string, body string")
