"""Line dedup with a log-template tree of fixed depth.

A line goes down the tree by its token count, then by its leading tokens, and ends in templates
that generalise variable fields: tokens with a digit, an @ or a :// stand for any such token, and
in lines of some length one third of the remaining tokens may vary. A node of the tree is known by
the hash of the way to it. Templates that recur across documents are boilerplate; their lines are
dropped, whatever their length and whatever else the document holds.

Copies of a document don't make its lines boilerplate. A text counts once, however many documents
have it. Of the lines of a text those are its own that are of some length, have no template that many
texts have (else they would be common), and are no variant of such a line: their first, last and least
shingles are not those of lines of many texts. The least hash of the shingles of its own lines is the
rest of a text; without own lines, as in copies and near copies, it is that of all its lines but the
one in question, which near copies mostly share. A common template recurs if many different rests have
it, and so many that near copies (shingles alike to 0.75 or more) don't reach that share of its texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import drop_written, materialise, small_batches, table, tidy

#: A template is common from so many texts on; it recurs from so many different rests on, and this share of its texts.
MIN_DOCS = 5
MIN_SHARE = 0.3
#: Lines of fewer tokens keep all of them and are nobody's own; leading tokens of a way down the tree.
GENERAL_TOKENS = 6
LEADING = 2
#: So many recurring templates at most are broadcast; beyond, they are joined.
BROADCAST_KEYS = 4_000_000
_VARIABLE = re.compile(rb"[0-9@]|://")
#: Fixed values of the min-hash: words of a shingle with their coefficients, and the modulus; a letter at place i of
#: a word counts by i * i * FACTOR modulo PLACES, a word's sum modulo WORD.
COEFFICIENTS = (104729, 15485863, 32452843, 49979687, 67867967)
MODULUS = 1099511627689
FACTOR, PLACES, WORD = 40503, 65521, 4294967291
#: Characters of texts whose shingles are hashed in one go, about.
CHUNK = 100_000


def templates(line: bytes) -> tuple[int, list[int]]:
    """(tokens of a line, keys of the templates at the end of its way down the tree)."""
    return _ways(line, line.split())


def _ways(line: bytes, tokens: list[bytes]) -> tuple[int, list[int]]:
    n = len(tokens)
    if not n:
        return 0, []
    if len(line.translate(None, b"0123456789@:")) < len(line):
        tokens = [b"\x00" if _VARIABLE.search(t) else t for t in tokens]
    if n < GENERAL_TOKENS:
        return n, [xxhash.xxh64_intdigest(b"%d " % n + b" ".join(tokens)) - (1 << 63)]
    head = b"%d " % n + b" ".join(tokens[:LEADING])
    b1, b2 = LEADING + (n - LEADING) // 3, LEADING + (n - LEADING) * 2 // 3
    first, second, third = b" ".join(tokens[LEADING:b1]), b" ".join(tokens[b1:b2]), b" ".join(tokens[b2:])
    return n, [xxhash.xxh64_intdigest(b"\x01".join(x)) - (1 << 63) for x in ((head, b"0", second, third), (head, b"1", first, third), (head, b"2", first, second))]


def lines_of(text: str | None) -> list[str]:
    """The lines of a whole text; null and empty texts have none."""
    return text.split("\n") if text else []


_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def least_shingles(text: str) -> np.ndarray:
    """For each line of a text the least hash of its shingles: runs of as many words as there are
    coefficients, or the whole of a shorter line; MODULUS for a line without words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(points, 127)] & (points < 128)
    turns = np.flatnonzero(np.diff(~space, prepend=False, append=False))
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    lines = np.flatnonzero(points == 10)
    out = np.full(len(lines) + 1, MODULUS, np.int64)
    if not len(starts):
        return out
    first = np.cumsum(lengths) - lengths
    place = np.arange(1, first[-1] + lengths[-1] + 1) - np.repeat(first, lengths)
    place = place * place % PLACES * FACTOR % PLACES
    numbers = np.add.reduceat(points[~space] * place, first) % WORD
    line = np.searchsorted(lines, starts)
    sums, alike = numbers * COEFFICIENTS[0], np.ones(len(line), bool)
    for k, c in enumerate(COEFFICIENTS[1:], 1):
        alike[-k:] = False
        alike[:-k] &= line[k:] == line[:-k]
        sums[:-k] += np.where(line[k:] == line[:-k], numbers[k:] * c, 0)
    sums %= MODULUS
    opens = np.concatenate(([True], line[1:] != line[:-1]))
    counts = np.flatnonzero(opens)
    # The first window of a line counts always, the others where they lie within it.
    sums[~(opens | alike)] = MODULUS
    out[line[counts]] = np.minimum.reduceat(sums, counts)
    return out


def anchors(tokens: list[bytes], least: int) -> list[int]:
    """Keys of a line's first, last and least shingle, of which a variant of the line has some still."""
    k = len(COEFFICIENTS)
    told = (b"f\x01" + b" ".join(tokens[:k]), b"l\x01" + b" ".join(tokens[-k:]), b"m\x01%d" % least)
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in told]


class Lines:
    """The distinct lines with words of a text: the least hash of their shingles, keys of their templates,
    and keys of their anchors (none of short lines)."""

    def __init__(self, text: str, least: np.ndarray):
        self.least = {x: n for x, n in zip(lines_of(text), least.tolist(), strict=True) if n < MODULUS}
        self.templates, self.anchors = {}, {}
        for x, n in self.least.items():
            coded = x.encode("utf-8", "surrogatepass")
            tokens = coded.split()
            size, self.templates[x] = _ways(coded, tokens)
            self.anchors[x] = anchors(tokens, n) if size >= GENERAL_TOKENS else []

    def keys(self) -> set[int]:
        return {k for own in (*self.templates.values(), *self.anchors.values()) for k in own}

    def rests(self, known) -> dict[int, int]:
        """Common template key -> rest of the text; `known(key)` tells whether many texts have a key. Of
        several lines with a template the least rest is taken."""
        common = {x: [k for k in self.templates[x] if known(k)] for x in self.least}
        own = min((n for x, n in self.least.items() if self.anchors[x] and not common[x] and not any(map(known, self.anchors[x]))), default=None)
        if own is None:
            (second, _), (one, first) = (sorted((n, x) for x, n in self.least.items())[1::-1] if len(self.least) > 1 else ((-1, ""), (0, next(iter(self.least), ""))))
        out: dict[int, int] = {}
        for x, keys in common.items():
            rest = own if own is not None else second if x == first else one
            for k in keys:
                out[k] = min(rest, out.get(k, rest))
        return out


def lines_in(texts: list[str]) -> Iterator[tuple[str, Lines]]:
    """Each text with its `Lines`; several short texts are hashed in one go."""
    waiting, size = [], 0
    for at, text in enumerate(texts, 1):
        waiting.append(text)
        size += len(text)
        if size >= CHUNK or at == len(texts):
            least, line = least_shingles("\n".join(waiting)), 0
            for own in waiting:
                n = own.count("\n") + 1
                yield own, Lines(own, least[line : line + n])
                line += n
            waiting, size = [], 0


def template_keys(text: str) -> set[int]:
    """Keys of all templates of a text's lines."""
    return {k for x in set(lines_of(text)) for k in templates(x.encode("utf-8", "surrogatepass"))[1]}


def text_number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Known:
    """Sorted keys; tells of one key or of an array of keys whether they are among them."""

    def __init__(self, keys):
        self.keys = np.sort(np.asarray(keys, np.int64))
        self.set = frozenset(self.keys.tolist()) if len(self.keys) < 1000 else None

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def among(self, keys: set[int]) -> frozenset[int]:
        """Those of some keys that are known."""
        if self.set is not None:
            return self.set & keys
        array = np.fromiter(keys, np.int64, len(keys))
        return frozenset(array[self.of(array)].tolist())


def common_keys(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Column k: the keys of templates and anchors that `min_docs` different texts have, of all texts."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tidy("lines", batches):
            keys, texts = [], []
            for text, own in lines_in([t for t in set(b["text"].dropna()) if t]):
                keys.extend(found := own.keys())
                texts.extend([text_number(text)] * len(found))
            yield pd.DataFrame({"k": np.array(keys, np.int64), "t": np.array(texts, np.int64)})

    once = docs.select("text").mapInPandas(emit, "k long, t long").groupBy("k", "t").agg(F.lit(1).alias("one"))
    return once.groupBy("k").agg(F.count("one").alias("n")).filter(F.col("n") >= min_docs).select("k")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, most: int = BROADCAST_KEYS) -> DataFrame:
    """Column k: the keys of templates that recur, of all texts: see the module's description."""
    common = materialise(common_keys(docs, min_docs), "line-common")
    if common.count() <= most:
        held = docs.sparkSession.sparkContext.broadcast(Known(common.toArrow().column("k").to_numpy()))

        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in tidy("lines", batches):
                keys, texts, others = [], [], []
                # Most texts have no common template, and need no more than that to be known.
                some = [t for t in set(b["text"].dropna()) if t and held.value.among(template_keys(t))]
                for text, own in lines_in(some):
                    found = own.rests(held.value.among(own.keys()).__contains__)
                    keys.extend(found)
                    others.extend(found.values())
                    texts.extend([text_number(text)] * len(found))
                yield pd.DataFrame({"k": np.array(keys, np.int64), "t": np.array(texts, np.int64), "rest": np.array(others, np.int64)})

        told = docs.select("text").mapInPandas(emit, "k long, t long, rest long")
    else:
        # A text with all its common keys is one row, whose size the text's own length bounds.
        found = _known_of_texts(docs, common, lambda text: Lines(text, least_shingles(text)).keys())

        @F.pandas_udf("array<struct<k: long, t: long, rest: long>>")
        def rests(texts: pd.Series, sets: pd.Series) -> pd.Series:
            out = []
            for text, keys in zip(texts, sets, strict=True):
                own = Lines(text, least_shingles(text)).rests(frozenset(() if keys is None else keys).__contains__) if text else {}
                out.append([{"k": k, "t": text_number(text), "rest": r} for k, r in own.items()])
            return pd.Series(out)

        told = docs.select("text", _text_key("text").alias("_t")).join(found, "_t").select(F.explode(rests("text", "_keys")).alias("_r")).select("_r.*")
    once = told.groupBy("k", "rest", "t").agg(F.lit(1).alias("one"))
    by_rest = once.groupBy("k", "rest").agg(F.count("one").alias("n"))
    counted = by_rest.groupBy("k").agg(F.count("*").alias("rests"), F.sum("n").alias("texts"))
    return counted.filter((F.col("rests") >= min_docs) & (F.col("rests") >= min_share * F.col("texts"))).select("k")


def without(text: str | None, known) -> tuple[str | None, int, int]:
    """(the text without its recurring lines, lines, dropped lines); `known(keys)` tells of an
    array of keys which recur."""
    lines = lines_of(text)
    if not lines:
        return text, 0, 0
    cut = [templates(x.encode("utf-8", "surrogatepass"))[1] for x in lines]
    owner = [i for i, keys in enumerate(cut) for _ in keys]
    gone = {owner[i] for i in np.flatnonzero(known(np.array([k for keys in cut for k in keys], np.int64)))} if owner else set()
    return "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text, len(lines), len(gone)


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, most: int = BROADCAST_KEYS) -> DataFrame:
    """The documents with text, n_lines and n_dropped; columns of those names are replaced.

    Null texts stay null and empty ones empty, without lines. A line repeated in one document
    counts once but is dropped everywhere. A document of recurring lines only has an empty text.
    One row in, one row out; repeated rows, like other documents with the same text, count once.
    """
    keys = materialise(recurring(docs, min_docs, min_share, most), "line-templates")
    shape = "text string, n_lines long, n_dropped long"
    if keys.count() <= most:
        held = docs.sparkSession.sparkContext.broadcast(Known(keys.toArrow().column("k").to_numpy()))
        drop_written(keys)

        @F.pandas_udf(shape)
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in tidy("lines", batches):
                yield pd.DataFrame([without(t, held.value.of) for t in texts], columns=["text", "n_lines", "n_dropped"])

        out = docs.withColumn("_cut", cut("text"))
    else:
        out = _joined(docs, keys, shape)
    order = [F.col(f"_cut.{c}").alias(c) if c in ("text", "n_lines", "n_dropped") else F.col(f"`{c}`") for c in (*docs.columns, *(x for x in ("n_lines", "n_dropped") if x not in docs.columns))]
    return out.select(*order)


def _text_key(text: str) -> Column:
    """128 bits of a text as text; null for null and empty texts."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh128_hexdigest(t) if t else None for t in texts], dtype=object)

    return digest(text)


def _known_of_texts(docs: DataFrame, keys: DataFrame, keys_of) -> DataFrame:
    """(_t, _keys): for many keys, each distinct text meets its own in a shuffled join."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(xxhash.xxh128_hexdigest(t), k) for t in b["text"] if t for k in keys_of(t)]
            if rows:
                yield pd.DataFrame({"_t": [t for t, _ in rows], "k": np.array([k for _, k in rows], np.int64)})

    pairs = docs.select("text").mapInPandas(emit, "_t string, k long").distinct()
    return materialise(pairs.join(keys, "k", "left_semi").groupBy("_t").agg(F.collect_set("k").alias("_keys")), "text-templates")


def _joined(docs: DataFrame, keys: DataFrame, shape: str) -> DataFrame:
    """For many recurring templates."""

    @F.pandas_udf(shape)
    def cut(texts: pd.Series, sets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [without(t, lambda k, s=s: np.isin(k, np.array([] if s is None else s, np.int64))) for t, s in zip(texts, sets, strict=True)],
            columns=["text", "n_lines", "n_dropped"],
        )

    found = _known_of_texts(docs, keys, template_keys)
    return docs.withColumn("_t", _text_key("text")).join(found, "_t", "left").withColumn("_cut", cut("text", "_keys"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their recurring lines; n_chars follows the text (0 for a null text). One row
    in, one row out, with the columns it came with, such as are named like the operator's own unchanged;
    an empty table gives none."""
    small_batches(spark)
    clash = {c: f"_own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = dedup(docs.withColumnsRenamed(clash)).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in clash.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


#: The same by strings instead of keys.
ORACLE = r"""
WITH texts AS (
  SELECT text, row_number() OVER () AS t FROM (SELECT DISTINCT text FROM documents WHERE text <> '')
), l AS (
  SELECT t, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM (SELECT t, string_split(text, chr(10)) AS lines FROM texts)
), w AS (
  SELECT *, regexp_extract_all(line, '[^	

 ]+') AS raw FROM l
), k AS (
  SELECT t, pos, line, raw, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN chr(0) ELSE x END) AS w,
    len(raw) AS n, 2 + (len(raw) - 2) // 3 AS b1, 2 + (len(raw) - 2) * 2 // 3 AS b2 FROM w
), keys AS (
  SELECT t, pos, line, n, unnest(CASE WHEN n = 0 THEN [] WHEN n < 6 THEN [[w]] ELSE [[w[1:2], ['0'], w[b1 + 1:b2], w[b2 + 1:n]], [w[1:2], ['1'], w[3:b1], w[b2 + 1:n]], [w[1:2], ['2'], w[3:b1], w[b1 + 1:b2]]] END) AS key FROM k
), common AS (
  SELECT n, key FROM keys GROUP BY n, key HAVING count(DISTINCT t) >= 5
), numbers AS (
  SELECT DISTINCT t, line, n, raw, list_transform(raw, lambda x: CAST(list_sum(list_transform(range(1, length(x) + 1), lambda i: unicode(x[i]) * (((i * i) % 65521) * 40503 % 65521))) % 4294967291 AS BIGINT)) AS h FROM k WHERE n > 0
), least AS (
  SELECT t, line, n, raw, list_min(list_transform(range(1, greatest(n - 4, 1) + 1), lambda i: (h[i] * 104729 + coalesce(h[i + 1], 0) * 15485863 + coalesce(h[i + 2], 0) * 32452843
    + coalesce(h[i + 3], 0) * 49979687 + coalesce(h[i + 4], 0) * 67867967) % 1099511627689)) AS least FROM numbers
), anchors AS (
  SELECT t, line, unnest([['f'] || raw[1:5], ['l'] || raw[n - 4:n], ['m', CAST(least AS VARCHAR)]]) AS anchor FROM least WHERE n >= 6
), often_anchors AS (
  SELECT anchor FROM anchors GROUP BY anchor HAVING count(DISTINCT t) >= 5
), alike AS (
  SELECT DISTINCT t, line FROM keys JOIN common USING (n, key) UNION SELECT t, line FROM anchors JOIN often_anchors USING (anchor)
), own AS (
  SELECT t, min(least) AS own FROM least ANTI JOIN alike USING (t, line) WHERE n >= 6 GROUP BY t
), two AS (
  SELECT t, min(least) AS one, CASE WHEN count(*) > 1 THEN list_sort(list(least))[2] ELSE -1 END AS other, arg_min(line, least) AS lowest, count(*) AS lines FROM least GROUP BY t
), rests AS (
  SELECT n, key, t, min(CASE WHEN own IS NOT NULL THEN own WHEN lines = 1 THEN -1 WHEN line = lowest THEN other ELSE one END) AS rest
  FROM keys JOIN common USING (n, key) JOIN two USING (t) LEFT JOIN own USING (t) GROUP BY n, key, t
), often AS (
  SELECT n, key FROM rests GROUP BY n, key HAVING count(DISTINCT rest) >= 5 AND count(DISTINCT rest) >= 0.3 * count(*)
), gone AS (
  SELECT DISTINCT t, pos FROM keys JOIN often USING (n, key)
), d AS (
  SELECT l.t, count(*) AS n_lines, count(gone.pos) AS n_gone, string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS rest
  FROM l LEFT JOIN gone USING (t, pos) GROUP BY l.t
)
SELECT doc_id, CASE WHEN n_gone > 0 THEN coalesce(rest, '') ELSE documents.text END AS text, CAST(coalesce(n_lines,
0) AS BIGINT) AS n_lines, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_dropped
FROM documents LEFT JOIN texts ON documents.text = texts.text LEFT JOIN d USING (t)
"""
