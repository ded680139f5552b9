"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of
its letters, each permuted by its place; a text's vector bundles (adds) those of its n-grams, each
by the square root of its count, so that a repeated word doesn't drown the rest. A language's
prototype bundles the unit vectors of its sample texts; a document takes the language whose
prototype has the greatest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_sample, fold, small_batches, table, tidy

#: Symbols: 0 is the gap between words, 1-26 are a-z, other letters share the rest by code point.
SYMBOLS = 64
DIMENSIONS = 512
SEED = 20_11
#: Sample texts a language, about.
SAMPLE_PER_LANG = 1500
#: Least cosine with the nearest prototype: chance alone gives unlike texts less than 0.1 in so many dimensions.
LEAST_SCORE = 0.1


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    """The symbol of each code point of the basic plane."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % (SYMBOLS - 27)
    return out


@lru_cache(4)
def _letters(dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))


@lru_cache(4)
def _pairs(dimensions: int) -> np.ndarray:
    """The bound vectors of first (twice permuted) and second (once permuted) letters."""
    one = _letters(dimensions)
    return (np.roll(one, 2, axis=1)[:, None, :] * np.roll(one, 1, axis=1)[None, :, :]).reshape(-1, dimensions)


def trigram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The bound vector of each trigram: its first two letters' with its third's."""
    return _pairs(dimensions)[grams // SYMBOLS] * _letters(dimensions)[grams % SYMBOLS]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigrams of the whole text and their counts; None where there is no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _symbol_table()[np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        symbols = symbols.copy()
        for at in np.flatnonzero(high):
            symbols[at] = 27 + points[at] % (SYMBOLS - 27) if chr(points[at]).isalpha() else 0
    symbols = np.concatenate(([0], symbols, [0])).astype(np.int32)
    symbols = symbols[np.concatenate(([True], (symbols[1:] != 0) | (symbols[:-1] != 0)))]
    if len(symbols) < 3:
        return None
    return np.unique((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], return_counts=True)


def encode(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """The unit vector of a text; None where it has no letter."""
    grams = trigrams(text)
    if grams is None:
        return None
    vector = np.zeros(dimensions, np.float32)
    for k in range(0, len(grams[0]), 4096):
        vector += np.sqrt(grams[1][k : k + 4096], dtype=np.float32) @ trigram_vectors(grams[0][k : k + 4096], dimensions).astype(np.float32)
    norm = float(np.linalg.norm(vector))
    return vector / norm if norm else vector


def learn(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes as unit rows) from rows of doc_id, text, lang with a known language.

    Counting covers all rows; the prototypes use about `per_lang` rows of each language. Null
    languages and texts without letters teach nothing; no rows give no language.
    """
    known = docs.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sample = bounded_sample(known, "doc_id", ["lang"], per_lang).repartition(8, "doc_id")

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in tidy("langid", batches):
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if (vector := encode(text, dimensions)) is not None:
                    sums[lang] = sums[lang] + vector if lang in sums else vector.astype(np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    sums: dict[str, np.ndarray] = {}
    for row in sample.mapInPandas(bundle, "lang string, vector array<double>").collect():
        sums[row["lang"]] = sums.get(row["lang"], 0) + np.array(row["vector"])
    langs = sorted(sums)
    if not langs:
        return [], np.zeros((0, dimensions))
    rows = np.array([sums[k] for k in langs])
    return langs, rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (the best cosine, 0 to 1); columns of those names are replaced.

    Null texts, texts without a letter, and all texts where no language was learned: `und` and 0.
    Ties go to the first language by name. Every row gives one row; the text is read whole.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    weights = prototypes.astype(np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in tidy("langid", batches):
            names, scores = [], []
            for t in texts:
                vector = encode(t, weights.shape[1]) if langs else None
                if vector is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                cosines = weights @ vector
                at = int(cosines.argmax())
                names.append(langs[at])
                scores.append(float(min(1.0, max(0.0, cosines[at]))))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.select(*kept, best(F.col(text)).alias("_p")).select(*kept, "_p.lang_pred", "_p.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, prototypes = learn(docs.filter(fold("doc_id", 5) != 0))
    out = predict(docs.select("doc_id", "text"), langs, prototypes)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def select(docs: DataFrame, langs: list[str], prototypes: np.ndarray, wanted: list[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The documents in one of the `wanted` languages (all that were learned, if None), with
    lang_pred and score. Those of other languages, those whose score is less than `least` (texts in
    a language that wasn't learned, and junk) and those judged `und` go."""
    judged = predict(docs, langs, prototypes)
    return judged.filter(F.col("lang_pred").isin(langs if wanted is None else wanted) & (F.col("lang_pred") != "und") & (F.col("score") >= least))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is one of the learned ones; `lang` becomes the language
    that was found, so that later stages and the output carry it.

    Null texts and texts without a letter go, as do all where no row has a language. Repeated rows
    are judged alike; an empty table gives none. The columns are those of `docs`.
    """
    small_batches(spark)
    langs, prototypes = learn(docs.filter(fold("doc_id", 5) != 0))
    own = docs.select(*(F.col(c).alias(f"_own_{c}") if c in ("lang_pred", "score") else F.col(c) for c in docs.columns))
    out = select(own, langs, prototypes).withColumn("lang", F.col("lang_pred"))
    return out.select(*(F.col(f"_own_{c}").alias(c) if c in ("lang_pred", "score") else F.col(c) for c in docs.columns))
