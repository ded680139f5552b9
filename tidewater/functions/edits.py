"""The edit distance of two texts, with a column of its table in the bits of whole numbers.

A column differs from place to place by -1, 0 or 1; where it grows and where it falls are two numbers, and the next
column's follow from them by a few operations on all places at once.
"""

from __future__ import annotations


def edit_distance(a: str | None, b: str | None) -> int | None:
    """The fewest letters to put in, take out or replace that make one text of the other; null if one is null."""
    if a is None or b is None:
        return None
    if a == b:
        return 0
    if len(a) < len(b):  # numbers as long as the longer text, one for each letter of the shorter
        a, b = b, a
    size = len(a)
    if not b:
        return size
    at: dict[str, int] = dict.fromkeys(b, 0)
    for letter in at:
        k = a.find(letter)
        places = 0
        while k >= 0:
            places |= 1 << k
            k = a.find(letter, k + 1)
        at[letter] = places
    every, last = (1 << size) - 1, 1 << (size - 1)
    grows, falls, distance = every, 0, size
    for letter in b:
        same = at[letter]
        across = (((same & grows) + grows) ^ grows) | same | falls
        up = falls | (every & ~(across | grows))
        down = grows & across
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        up = (up << 1) | 1
        grows = ((down << 1) & every) | (every & ~(same | falls | up))
        falls = up & (same | falls) & every
    return distance
