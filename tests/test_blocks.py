"""Matching blocks against the standard library, and their time on long texts."""

import difflib
import random
import time

import pytest

from tidewater.functions import blocks


def pairs():
    rng = random.Random(7)
    for letters, most in (("ab", 60), ("abc ", 300), ("abcdefghij \n", 700), ("é漢😀x", 200)):
        for _ in range(60):
            a = "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
            cut = sorted(rng.randint(0, len(a)) for _ in range(4))
            yield a, "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
            yield a, a[cut[0] : cut[2]] + "".join(rng.choice(letters) for _ in range(9)) + a[cut[1] : cut[3]]


@pytest.mark.parametrize("small", [0, 40, blocks.SMALL])
def test_against_the_standard_library(monkeypatch, small):
    monkeypatch.setattr(blocks, "SMALL", small)
    for a, b in pairs():
        assert blocks.matching_ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), (a, b)
    assert blocks.matching_ratio(None, "") == 1.0 and blocks.matching_ratio("a", None) == 0.0 and blocks.matching_ratio("abc", "abc") == 1.0


def test_long_texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]

    def seconds(n):
        a = " ".join(rng.choice(words) for _ in range(n))
        b = " ".join(rng.choice(words) for _ in range(n)) + a[: len(a) // 3] + " ".join(rng.choice(words) for _ in range(n // 3))
        start = time.process_time()
        assert 0.2 < blocks.matching_ratio(a, b) < 1
        return len(a) + len(b), time.process_time() - start

    (short, fast), (long, slow) = seconds(2_000), seconds(16_000)
    assert long > 200_000 and slow / fast < 3 * long / short


def test_equal_texts_need_no_search(monkeypatch):
    monkeypatch.setattr(blocks, "_by_places", lambda *a: pytest.fail("searched"))
    monkeypatch.setattr(blocks, "Kinds", lambda *a: pytest.fail("numbered"))
    assert blocks.matching_ratio("some text " * 500, "some text " * 500) == 1.0


def test_lines_take_less_time_than_by_pairs_of_places():
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    lines = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    took = []
    for ratio in (blocks.matching_ratio, lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()):
        start = time.process_time()
        got = [ratio(a, b) for a, b in zip(lines, lines[1:])]
        took.append((time.process_time() - start, got))
    assert took[0][1] == took[1][1] and took[0][0] < 0.6 * took[1][0]
