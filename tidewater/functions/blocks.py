"""The share of matching blocks of two texts, in time that grows as their length with its logarithms.

The longest block that two ranges share is taken, of equally long ones the first in the one text and
then in the other; then the same is done before it and behind it. Whether ranges share a block of some
length is seen by comparing numbers: every substring whose length is a power of two has the number of
its kind, made by pairing those of its halves, and a block of any length is known by two that overlap.
"""

from __future__ import annotations

import numpy as np

#: Product of two lengths up to which blocks are sought place by place.
SMALL = 2_000_000


class Kinds:
    """Numbers of the substrings of a text by length: equal ones have one number."""

    def __init__(self, text: str):
        self.levels = [np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)]

    def of(self, start: int, end: int, length: int) -> np.ndarray:
        """The numbers of the substrings of that length that begin in text[start:end] and end within it."""
        k = length.bit_length() - 1
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = last[: len(last) - half] * (int(last.max(initial=0)) + 1) + last[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        own, many = self.levels[k], end - start - length + 1
        first, second = own[start : start + many], own[start + length - (1 << k) : start + length - (1 << k) + many]
        return first * (int(own.max(initial=0)) + 1) + second


def _by_places(a: str, b: str, own: tuple[int, int], other: tuple[int, int], most: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the first longest block of two ranges: at each place of the one
    a block longer than the longest so far is looked for in the other. Its end alone is looked for first: where
    that is missing no block that holds it is there. No block is longer than `most`."""
    (i, high), (low, top), find = own, other, b.find
    start = at = length = 0
    while length < most and i + length < high:
        end = i + length + 1
        skip = length // 3
        if skip and find(a[i + skip : end], low, top) < 0:
            i += skip + 1
            continue
        while end <= high and (j := find(a[i:end], low, top)) >= 0:
            start, at, length, end = i, j, end - i, end + 1
        i += 1
    return start, at, length


def _longest(kinds: Kinds, a: tuple[int, int], b: tuple[int, int], most: int) -> tuple[int, int, int]:
    """The same for large ranges of one joined text; no block is longer than `most`."""
    shared = lambda n: np.isin(kinds.of(*a, n), kinds.of(*b, n))
    low, high = 0, min(most, a[1] - a[0], b[1] - b[0])
    while low < high:  # ranges that share a block share all shorter ones
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shared(middle).any() else (low, middle - 1)
    if not low:
        return 0, 0, 0
    i = int(shared(low).argmax())
    j = int((kinds.of(*b, low) == kinds.of(*a, low)[i]).argmax())
    return a[0] + i, b[0] + j, low


def matching_letters(a: str, b: str) -> int:
    """The letters in matching blocks."""
    if a == b:
        return len(a)
    kinds, total = None, 0
    todo = [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        if (ahi - alo) * (bhi - blo) <= SMALL:
            i, j, n = _by_places(a, b, (alo, ahi), (blo, bhi), most)
        else:
            kinds = kinds or Kinds(a + b)
            i, j, n = _longest(kinds, (alo, ahi), (len(a) + blo, len(a) + bhi), most)
            j -= len(a)
        if n:
            total += n
            todo += [(alo, i, blo, j, n), (i + n, ahi, j + n, bhi, n)]
    return total


def matching_ratio(a: str | None, b: str | None) -> float:
    """Twice the letters in matching blocks over all letters, 0 to 1; null counts as empty, two empty texts have 1."""
    a, b = a or "", b or ""
    return 2.0 * matching_letters(a, b) / (len(a) + len(b)) if a or b else 1.0
