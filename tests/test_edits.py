"""The edit distance against the plain table, and in a query."""

import random

from pyspark.sql import functions as F

from tidewater.functions.edits import edit_distance
from tidewater.operators import documents


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_against_the_plain_table():
    rng = random.Random(4)
    for letters, most in (("ab", 12), ("abc ", 70), ("aé漢😀", 40), ("abcdefghij", 130)):
        for _ in range(150):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(2))
            assert edit_distance(a, b) == plain(a, b) == edit_distance(b, a), (a, b)
            assert edit_distance(a + b, a) == plain(a + b, a)
    assert edit_distance("", "abc") == 3 and edit_distance("x", "x") == 0 and edit_distance(None, "a") is None is edit_distance("a", None)


def test_column(spark):
    rows = [("kitten", "sitting"), ("", ""), (None, "a"), ("a", None), ("a" * 3000, "a" * 2999 + "b")]
    got = spark.createDataFrame(rows, "a string, b string").coalesce(1).select(documents.edits(F.col("a"), F.col("b")).alias("n"))
    assert got.dtypes == [("n", "int")] and [r["n"] for r in got.collect()] == [3, 0, None, None, 1]
