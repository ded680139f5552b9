"""Benchmark decontamination: a prefix-filtered set join with exact windows.

A document holds a benchmark window only if it holds the window's rarest word, so that one word is
the prefix that containment of a whole window needs. Words are ordered by how many documents hold
them, counted over all documents. Where a document has a prefix word, the length and position of
its windows bound the candidates, and the words on both sides are compared exactly.

The benchmark is read in blocks of bounded size; each block is one broadcast index that all
documents pass by, so nothing is shuffled and no text leaves its task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import small_batches, table, tidy

WINDOW = 13
#: Characters of benchmark text in one block, about.
BLOCK_CHARS = 8_000_000
#: A document is contaminated from this share of hit words on: one in `SHARE`.
SHARE = 20
#: In UTF-8 the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ are runs of these bytes.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
STATE = "n_words long, n_hit long, runs array<int>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """The words of a whole text, A-Z lower-cased; null has none."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Index:
    """The windows of one block of items, filed under their prefix words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], held_by: dict[bytes, int], window: int = WINDOW):
        self.window, self.items = window, items
        #: prefix word -> (item, place of the word, first and last start of the windows it stands for)
        self.places: dict[bytes, list[tuple[int, int, int, int]]] = {}
        rank = {w: k for k, w in enumerate(sorted({w for _, own in items for w in own}, key=lambda w: (held_by.get(w, 0), w)))}
        for k, (_, own) in enumerate(items):
            span, last = min(window, len(own)), None
            for start in range(len(own) - span + 1 if own else 0):
                at = min(range(start, start + span), key=lambda q: (rank[own[q]], q))
                if last is not None and last[0] == at:
                    last[2] = start
                else:
                    if last is not None:
                        self.places.setdefault(own[last[0]], []).append((k, *last))
                    last = [at, start, start]
            if last is not None:
                self.places.setdefault(own[last[0]], []).append((k, *last))

    def hits(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(intervals of hit words, ends exclusive; ids of the items with windows that occur)."""
        runs, found = [], set()
        for word in self.places.keys() & set(doc):
            places, p = self.places[word], -1
            for _ in range(doc.count(word)):
                p = doc.index(word, p + 1)
                for k, q, low, high in places:
                    item_id, own = self.items[k]
                    span = min(self.window, len(own))
                    # Places: a window that starts at s in the item starts at p - q + s here.
                    low_s, high_s = max(low, q - p), min(high, len(doc) - p + q - span)
                    if low_s > high_s:
                        continue
                    left = q
                    while left > low_s and doc[p - q + left - 1] == own[left - 1]:
                        left -= 1
                    right, end = q + 1, high_s + span
                    while right < end and doc[p - q + right] == own[right]:
                        right += 1
                    if left + span <= right and left <= high_s:
                        runs.append((p - q + left, p - q + right))
                        found.add(item_id)
        return runs, found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _held_by(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How many documents hold each word of a block; as many rows as the block has words at most."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in tidy("decontam", batches):
            for text in b["text"]:
                counts.update(shared.value.intersection(words(text)))
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    rows = docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def _pass(index):
    """The function that adds one block's hits to what earlier blocks found."""

    @F.pandas_udf(STATE)
    def step(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, state in tidy("decontam", batches):
            got = []
            for text, runs, ids in zip(texts, state["runs"], state["items"], strict=True):
                doc = words(text)
                new, found = index.value.hits(doc)
                earlier = [] if runs is None else list(zip(runs[::2], runs[1::2], strict=True))
                if ids is not None:
                    found.update(ids)
                own = merged(new + earlier)
                got.append((len(doc), sum(b - a for a, b in own), [int(x) for r in own for x in r], sorted(found)))
            yield pd.DataFrame(got, columns=["n_words", "n_hit", "runs", "items"])

    return step


#: The columns that `find` adds.
MADE = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated and items (the sorted ids).

    Columns of those names are replaced. Null or empty texts have no words and aren't contaminated;
    items without words have no window; items repeated or of one id count once; a null item id
    counts as the empty string. An empty benchmark hits nothing. One row in, one row out.
    """
    spark = docs.sparkSession
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*MADE, "_state")]
    given = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = given.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    out = docs.withColumn("_state", F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ': ', 1) for x in STATE.split(', '))}>"))
    for block in range(blocks):
        rows = given.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        items = sorted({(r["item_id"], r["text"]) for r in rows})
        cut = [(i, words(t)) for i, t in items]
        held_by = _held_by(docs, frozenset(w for _, own in cut for w in own)) if cut else {}
        index = spark.sparkContext.broadcast(Index(cut, held_by, window))

        out = out.withColumn("_state", _pass(index)("text", "_state"))
    s = F.col("_state")
    return out.select(
        *kept,
        s["n_words"].alias("n_words"),
        s["n_hit"].alias("n_hit"),
        F.size(s["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(s["items"]), ","), 256).alias("items_sha256"),
        ((s["n_hit"] > 0) & (share * s["n_hit"] >= s["n_words"])).alias("contaminated"),
        F.array_sort(s["items"]).alias("items"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the contaminated documents. The others keep their columns, such as are named like the
    operator's own too; null and empty texts stay, as does every row with an empty benchmark, and an
    empty table gives none."""
    small_batches(spark)
    clash = {c: f"_own_{c}" for c in (*MADE, "_state") if c in docs.columns}
    out = find(docs.withColumnsRenamed(clash), table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).drop(*MADE)
    return out.withColumnsRenamed({own: c for c, own in clash.items()}).select(*docs.columns)


#: Every window against every run of as many words.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT item_id, w, least(13, len(w)) AS span, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, span, array_to_string(w[i:i + span - 1], ' ') AS s FROM v
), spans AS (SELECT DISTINCT span FROM wins), p AS (
  SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span
), hit AS (
  SELECT p.doc_id, p.i, p.span, wins.item_id FROM p JOIN wins ON wins.span = p.span AND wins.s = array_to_string(p.w[p.i:p.i + p.span - 1], ' ')
), c AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS pos FROM hit) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
