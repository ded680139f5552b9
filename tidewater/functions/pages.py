"""Printed page numbers of a document and their match with the pages of its file."""

from __future__ import annotations

import re
from bisect import bisect_right

#: How agencies print page numbers, the usual form first, then others.
ATSB_USUAL = r"(?im)^ ?[->][ ]{0,2}((\d{1,3})|([XVI]{1,4}))[ ]{0,2}[-<]"
ATSB_BARE = r"(?im)^ ?(\d{1,3}|[XVI]{1,4}) ?$"
ATSB_ROMAN = r"(?im)^ ?([XVI]{1,8}) ?$"
ATSB_LOOSE_ROMAN = r"(?m)^ ?([xvi]{2,8}) ?[\w\W]{0,10}$"
TSB_DASHED = r"(?im)^ ?- ?(\d+) ?- ?$"
TSB_BARRED = r"(?im)[\|■] {0,2}(\d+) ?$"
TAIC_PAGE = r"(?im)\|? ?Page {1,3}(\d+|[ivx]+) \|?(?!start)"
PAGE_START = r"(?m)^--- Page (\d+) start ---$"

_NUMERALS = ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def to_roman(n: int) -> str:
    """Lower-case numeral of 1 to 399."""
    out = ""
    for value, letters in _NUMERALS:
        out, n = out + letters * (n // value), n % value
    return out


ROMANS = {to_roman(n): n for n in range(1, 400)}


def from_roman(letters: str) -> int | None:
    return ROMANS.get(letters.lower())


def printed_numbers(text: str, agency: str) -> list[tuple[int, str]]:
    """(place, number as printed) in order; an unknown agency raises ValueError."""
    find = lambda pattern: [(m.start(), m[1]) for m in re.finditer(pattern, text)]
    if agency == "TAIC":
        found = find(TAIC_PAGE)
    elif agency == "TSB":
        found = find(TSB_DASHED) or find(TSB_BARRED)
    elif agency == "ATSB":
        if found := find(ATSB_USUAL):
            found += find(ATSB_ROMAN)
        else:
            found = find(ATSB_BARE)
            if all(number.isnumeric() for _, number in found):
                found += find(ATSB_LOOSE_ROMAN)
    else:
        raise ValueError(f"unknown agency {agency!r}")
    return sorted(found)


def _plausible(found: list[tuple[int, str]], top: int) -> list[tuple[int, str]]:
    """Without numbers far beyond the file's pages, numerals after two successive numbers, and
    numbers before the last numeral."""
    kept, running, before = [], False, None
    for place, number in found:
        if number.isdecimal():
            if int(number) > top + 10:
                continue
            running = running or before == int(number) - 1
            before = int(number)
            kept.append((place, number))
        else:
            before = None
            if not running and from_roman(number):
                kept.append((place, number))
    last = max((i for i, (_, number) in enumerate(kept) if not number.isdecimal()), default=-1)
    return [x for i, x in enumerate(kept) if i > last or not x[1].isdecimal()]


def sync_pages(found: list[tuple[int, str]], starts: list[int]) -> list[str]:
    """A label for each page of the file (whose pages start at `starts`): printed numbers anchor
    the first and last numeral and number, and the pages between and before follow. Pages before
    all that are blank; without printed numbers the pages count from 1."""
    found = _plausible(found, len(starts))
    by_page: dict[int, str] = {}
    for place, number in found:
        if (page := bisect_right(starts, place) - 1) >= 0:
            by_page.setdefault(page, number)
    if not by_page:
        return [str(k + 1) for k in range(len(starts))]
    kinds = {False: [], True: []}
    for page, number in sorted(by_page.items()):
        kinds[number.isdecimal()].append(page)
    anchors = {p: by_page[p] for pages in kinds.values() if pages for p in (pages[0], pages[-1])}
    labels: list[tuple[bool, int] | None] = [None] * len(starts)
    current: tuple[bool, int] | None = None
    for page in range(len(starts)):
        if page in anchors:
            decimal = anchors[page].isdecimal()
            current = (decimal, int(anchors[page]) if decimal else from_roman(anchors[page]))
            # Pages before an anchor count back from it, unless numbers lead up to it already.
            led = page > 0 and labels[page - 1] is not None and labels[page - 1][0]
            for back, value in zip(range(page - 1, -1, -1), range(current[1] - 1, 0, -1), strict=False):
                if led or back in anchors:
                    break
                labels[back] = (decimal, value)
        elif current:
            current = (current[0], current[1] + 1)
        labels[page] = current
    return ["" if x is None else str(x[1]) if x[0] else to_roman(x[1]) for x in labels]


def label_pages(text: str, agency: str) -> tuple[str, list[str]]:
    """The text with page starts replaced by `<< Page label >>` (blank labels leave nothing), and
    the labels. The printed numbers stay."""
    marks = list(re.finditer(PAGE_START, text))
    labels = sync_pages(printed_numbers(text, agency), [m.start() for m in marks])
    at = iter(labels)
    return re.sub(PAGE_START, lambda m: f"<< Page {x} >>" if (x := next(at)) else "", text), labels
