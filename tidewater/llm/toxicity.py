"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, scored in context.

The lexicon is learned from labelled documents. A word is looked up in the trie; a word that isn't
in it becomes a Levenshtein automaton that walks the trie beside it, so that misspelled terms are
found; letters that have changed places are one edit. A word near a term weighs as the labelled
documents that hold it say: as much less than the term as its own lift is less, nothing if clean
documents hold it as often, and a fixed share if none holds it. Each hit counts by its window:
within quotation marks or after a verb of report it counts as quoted, else as abuse. A logistic
score over these counts is fitted to the labels.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_sample, drop_written, fold, materialise, table, worker_state

#: Labelled rows of each class that the fit reads, about.
SAMPLE_PER_CLASS = 5000
THRESHOLD = 0.7
#: Least lift (log odds) of a term; shortest word that may be a misspelling; edits allowed.
LEAST_LIFT = 2.5
FUZZY_LENGTH = 4
EDITS = 1
#: The statistic of a word's counts that chance exceeds in 5 % of cases.
CHANCE = 3.84
#: Words before and after a hit that make its window.
WINDOW = 6
#: Words of one worker's memory of looked-up words.
MEMORY = 120_000

_WORD = re.compile(r"\w+")
OPENING, CLOSING = "\"“„«‹‘'", "\"”“»›’'"
#: Verbs that report someone else's words; a parameter of the fit.
REPORTING = frozenset("said says called calls quoted wrote writes reported term word dit écrit nannte sagte schrieb dijo llamó escribió".split())
FEATURES = ("best", "abuse", "terms", "density", "near", "quoted")
#: Weight of a misspelling that no labelled document holds, of the term's own, and of one with fewer than five letters.
MISSPELT, MISSPELT_SHORT = 0.8, 0.4


class LevenshteinAutomaton:
    """Accepts the words within `edits` of `word`; two neighbouring letters that have changed places
    are one edit. A state is the row of edit distances to the word's prefixes, cut off above
    `edits`, with the row before it and the letter between them; equal ones are one state."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits, self.next = word, edits, {}

    def start(self) -> tuple:
        return tuple(min(i, self.edits + 1) for i in range(len(self.word) + 1)), None, ""

    def step(self, state: tuple, char: str) -> tuple:
        if (found := self.next.get((state, char))) is None:
            last, before, letter = state
            word, cap = self.word, self.edits + 1
            row = [min(last[0] + 1, cap)]
            for i, own in enumerate(word):
                least = min(row[i] + 1, last[i] + (own != char), last[i + 1] + 1, cap)
                if before is not None and i and own == letter and word[i - 1] == char:
                    least = min(least, before[i - 1] + 1)
                row.append(least)
            # The letter and the row before it matter only where the next letter may swap with it.
            found = self.next[state, char] = (tuple(row), last, char) if char in word else (tuple(row), None, "")
        return found

    def distance(self, state: tuple) -> int:
        return state[0][-1]

    def alive(self, state: tuple) -> bool:
        return min(state[0]) <= self.edits or (state[1] is not None and min(state[1]) < self.edits)


class Trie:
    """The lexicon; a node is a dict of characters, with the term's weight under the empty key."""

    def __init__(self, weights: dict[str, float]):
        self.root: dict = {}
        for term, weight in weights.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (weight, term)

    def within(self, word: str, edits: int) -> tuple[float, int, str] | None:
        """The weight, distance and letters of the nearest term within `edits`, the heavier of equals."""
        automaton = LevenshteinAutomaton(word, edits)
        best, todo = None, [(self.root, automaton.start())]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    if (d := automaton.distance(state)) <= edits and (best is None or (d, -child[0], child[1]) < (best[1], -best[0], best[2])):
                        best = (child[0], d, child[1])
                elif automaton.alive(after := automaton.step(state, c)):
                    todo.append((child, after))
        return best


def _shortened(word: str) -> list[str]:
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Lexicon(dict):
    """word -> (weight, distance, term) or None, remembered; a bounded memory that starts anew when
    full. `forms` has the share of a term's weight for words that labelled documents hold."""

    def __init__(self, weights: dict[str, float], forms: dict[str, float] | None = None, edits: int = EDITS, reporting: frozenset[str] = REPORTING):
        super().__init__()
        self.weights, self.edits, self.forms, self.reporting = weights, edits, forms or {}, reporting
        self.trie = Trie(weights)
        # Two words one edit apart share a form with at most one character left out.
        self.near = {f for t in weights if len(t) >= FUZZY_LENGTH for f in _shortened(t)} if edits == 1 else None

    def __missing__(self, word: str):
        if len(self) >= MEMORY:
            self.clear()
        key = word.lower()
        if (weight := self.weights.get(key)) is not None:
            found = (weight, 0, key)
        elif len(key) < FUZZY_LENGTH or not self.edits or (self.near is not None and self.near.isdisjoint(_shortened(key))):
            found = None
        elif (found := self.trie.within(key, self.edits)) is not None:
            share = self.forms.get(key, MISSPELT if min(len(key), len(found[2])) > FUZZY_LENGTH else MISSPELT_SHORT)
            found = (found[0] * share, found[1], found[2]) if share > 0 and len(found[2]) >= FUZZY_LENGTH else None
        self[word] = found
        return found


def held_lexicon(name: str, *made_of) -> Lexicon:
    """This worker's lexicon of a name: tasks of one job share it."""
    return worker_state(("lexicon", name), lambda: Lexicon(*made_of))


def is_quoted(text: str, words: list[str], spans: list[tuple[int, int]], i: int, reporting: frozenset[str] = REPORTING) -> bool:
    """Whether word i stands within quotation marks or after a verb of report."""
    first, last = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
    before, after = text[spans[first][0] : spans[i][0]], text[spans[i][1] : spans[last][1] + 1]
    opened = max((before.rfind(q) for q in OPENING), default=-1)
    inside = opened >= 0 and (opened == 0 or not before[opened - 1].isalnum()) and any(q in after for q in CLOSING)
    return inside or any(w.lower() in reporting for w in words[max(0, i - 3) : i])


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """What the hits in a whole text say; a null text counts as empty."""
    words = _WORD.findall(text or "")
    hits = [i for i, w in enumerate(words) if lexicon[w]]
    if not hits:
        return [0.0] * len(FEATURES)
    found = [lexicon[w] for w in map(words.__getitem__, hits)]
    spans = [m.span() for m in _WORD.finditer(text)]
    abuse, quoted, best, near, terms = 0.0, 0.0, 0.0, 0, set()
    for k, (i, (weight, _, term)) in enumerate(zip(hits, found, strict=True)):
        if is_quoted(text, words, spans, i, lexicon.reporting):
            quoted += weight
            continue
        abuse += weight
        best = max(best, weight)
        terms.add(term)
        near += k > 0 and i - hits[k - 1] <= WINDOW
    return [best, math.log1p(abuse), math.log1p(len(terms)), math.log1p(100 * abuse / len(words)), math.log1p(near), math.log1p(quoted)]


@dataclass(frozen=True)
class Toxicity:
    weights: dict[str, float]
    forms: dict[str, float]
    coefficients: np.ndarray
    intercept: float
    reporting: frozenset[str] = REPORTING
    edits: int = EDITS

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients + self.intercept, -30, 30)))


def lift(toxic: int, clean: int, n_toxic: int, n_clean: int) -> tuple[float, float]:
    """(log odds of a word among toxic documents, the log-likelihood statistic of its counts)."""
    up = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    n, base = toxic + clean, n_toxic / max(1, n_toxic + n_clean)
    g = sum(2 * k * math.log(k / (n * p)) for k, p in ((toxic, base), (clean, 1 - base)) if k and p)
    return up, g


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 80) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by Newton steps; one class alone gives its own constant."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1]), (4.0 if len(y) and y[0] == 1 else -4.0)
    v = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(v.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(v @ w, -30, 30)))
        w = w - np.linalg.solve((v.T * (p * (1 - p) + 1e-6)) @ v + keep, v.T @ (p - y) + keep @ w)
    return w[:-1], float(w[-1])


def _tested(counted: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """Rows of (word, toxic, clean) with `lift` and its statistic `g`, as the function lift has them."""
    t, c, base = F.col("toxic"), F.col("clean"), n_toxic / max(1, n_toxic + n_clean)
    up = F.log((t + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    part = lambda k, p: F.when((k > 0) & F.lit(p > 0), 2 * k * F.log(k / ((t + c) * (p or 1)))).otherwise(0.0)
    return counted.withColumns({"lift": up, "g": part(t, base) + part(c, 1 - base)})


def _lexicon(counted: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms from rows of (word, toxic, clean): the counts' statistic must beat twice the log of
    the number of words, so that chance alone adds hardly one. All words are tested; those that
    pass are few, as the sample's documents are bounded."""
    total = counted.count()
    rows = _tested(counted.filter("toxic >= 2"), n_toxic, n_clean).filter((F.col("lift") >= LEAST_LIFT) & (F.col("g") >= 2 * math.log(max(2, total))))
    return {r["word"]: r["lift"] for r in rows.select("word", "lift").collect()}


def _forms(sample: DataFrame, counted: DataFrame, weights: dict[str, float], n_toxic: int, n_clean: int) -> dict[str, float]:
    """The words near a term that clean documents use unquoted, with the share of the term's weight
    that their own lift makes: nothing where clean documents hold them as often, or where chance
    explains the difference. From rows of (text, _y) and their words' counts (word, toxic, clean)."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(weights)
        for b in batches:
            some = [(w, n, h[2]) for w, n in zip(b["word"], b["toxic"], strict=True) if (h := lexicon.__missing__(w)) and h[1]]
            if some:
                yield pd.DataFrame(some, columns=["word", "toxic", "term"])

    toxic = {r["word"]: (r["toxic"], r["term"]) for r in counted.filter("clean > 0").select("word", "toxic").mapInPandas(near, "word string, toxic long, term string").collect()}
    if not toxic:
        return {}
    held = sample.sparkSession.sparkContext.broadcast(frozenset(toxic))

    def unquoted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                words = _WORD.findall(text or "")
                at = [i for i, w in enumerate(words) if w.lower() in held.value]
                if at:
                    spans = [m.span() for m in _WORD.finditer(text)]
                    counts.update({words[i].lower() for i in at if not is_quoted(text, words, spans, i)})
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    rows = sample.filter("_y = 0").select("text").mapInPandas(unquoted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = {}
    for r in rows:
        own, term = toxic[r["word"]]
        up, g = lift(own, r["n"], n_toxic, n_clean)
        out[r["word"]] = min(1.0, max(0.0, up / weights[term])) if g >= CHANCE else 0.0
    return out


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, reporting: frozenset[str] = REPORTING, edits: int = EDITS) -> Toxicity:
    """Fits the lexicon and the score on about `per_class` labelled rows of each class.

    One half of the sample gives a first lexicon, the other half the score's coefficients over
    it; the final lexicon uses both. A document labelled twice takes its larger label.
    """
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    chosen = bounded_sample(known, "doc_id", ["_y"], per_class)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = materialise(picked.withColumn("_half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")), "toxic-sample")
    sizes = Counter({(r["_half"], r["_y"]): r["n"] for r in sample.groupBy("_half", "_y").agg(F.count("*").alias("n")).collect()})

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[tuple[int, int], Counter] = {}
            for text, half, y in zip(b["text"], b["_half"], b["_y"], strict=True):
                counts.setdefault((half, y), Counter()).update({w.lower() for w in _WORD.findall(text or "")})
            for (half, y), own in ((k, c) for k, c in counts.items() if c):
                yield pd.DataFrame({"word": list(own), "half": half, "y": y, "n": list(own.values())})

    one = lambda h, y: F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0))
    counted = materialise(
        sample.mapInPandas(words, "word string, half int, y int, n long").groupBy("word").agg(
            one(0, 1).alias("t0"),
            one(0, 0).alias("c0"),
            one(1, 1).alias("t1"),
            one(1, 0).alias("c1"),
        ),
        "toxic-words",
    )
    half = counted.select("word", F.col("t0").alias("toxic"), F.col("c0").alias("clean")), sizes[0, 1], sizes[0, 0]
    whole = counted.select(
        "word",
        (F.col("t0") + F.col("t1")).alias("toxic"),
        (F.col("c0") + F.col("c1")).alias("clean"),
    ), sizes[0, 1] + sizes[1, 1], sizes[0, 0] + sizes[1, 0]
    first, both = _lexicon(*half), _lexicon(*whole)
    name, first_forms = uuid.uuid4().hex, _forms(sample.filter("_half = 0"), half[0], first, *half[1:])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = held_lexicon(f"{name}-half", first, first_forms, edits, reporting)
        for b in batches:
            yield pd.DataFrame({"y": b["_y"].astype("int32"), "x": [features(t, lexicon) for t in b["text"]]})

    got = sorted((tuple(r["x"]), r["y"]) for r in sample.filter("_half = 1").mapInPandas(measure, "y int, x array<double>").collect())
    x, y = np.array([r[0] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], dtype=int)
    coefficients, intercept = logistic(x, y)
    forms = _forms(sample, whole[0], both, *whole[1:])
    drop_written(sample)
    drop_written(counted)
    return Toxicity(both, forms, coefficients, intercept, reporting, edits)


def score(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted; columns of those names are replaced.

    Texts are read whole; null and empty texts, and those without hits, take the base score. One
    row in, one row out, repeated rows alike."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    name, weights = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((model.weights, model.forms, model.edits, model.reporting))
    scorer = Toxicity({}, {}, model.coefficients, model.intercept)

    @F.pandas_udf("double")
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = held_lexicon(name, *weights.value)
        for texts in batches:
            yield pd.Series(scorer.score(np.array([features(t, lexicon) for t in texts]).reshape(-1, len(FEATURES))))

    return docs.select(*kept, own(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(fold("doc_id", 3) != 1))
    return score(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
