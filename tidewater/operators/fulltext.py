"""Full-text search over a stored index: English stems and folded accents, phrases by positions."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.analysis import stem_sql, words, words_sql
from tidewater.plans.index import SearchIndex, opened
from tidewater.plans.shared import shared_path
from tidewater.sources.fixtures import table

#: What the queries ask for: inflected words, single ones, and phrases.
ASKED = "Licensing reserves versioned été"
INFLECTED = ("licensing", "licenses", "reserving", "versions", "conditions", "righted", "used")
#: Words that say nothing about what is asked for: of questions, of requests, and of every document here.
IDLE = tuple(
    "a about all an and any are as at be been by can common could did do does find for from give had has have how i in into is it list "
    "me of on or please report reports safety issue issues shall should show some tell that the their them there these this those to was "
    "were what when where which who whose why will with would you".split()
)
PHRASES = ("All rights reserved", "licensed under the", "of the", "the the", "à la")


def documents_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The stored index of the documents, in the shared folder; the first search of a session builds it."""
    return opened(spark, table(spark, sf_dir, "documents"), os.path.dirname(shared_path(spark, "x")), "documents-index", F.col("doc_id"), F.col("text"))


def phrases(index: SearchIndex, asked: tuple[str, ...], stemmed: bool = False) -> DataFrame:
    """(phrase, vec_id, n) of several phrases."""
    cut = index.analysed(list(asked))
    stem_of = {w: s for words, stems in cut for w, s in zip(words, stems, strict=True)}
    return index.phrases({p: words for p, (words, _) in zip(asked, cut, strict=True)}, stemmed, stem_of)


def word_recall(index: SearchIndex, asked: tuple[str, ...]) -> DataFrame:
    """(word, plain, stemmed): how many documents hold a word itself, and how many a word of its stem."""
    stem_of = index.stems_of(list(asked))
    words = index.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(s).alias("stem")) for w, s in stem_of.items()])).alias("a")).select("a.*")
    held = index.postings(list(asked), True, stem_of).drop("term")  # the postings of every word of a stem
    own = index.postings(list(asked), False, stem_of).groupBy(F.col("term").alias("word")).agg(F.countDistinct("vec_id").alias("plain"))
    all_ = held.groupBy("stem").agg(F.countDistinct("vec_id").alias("stemmed"))
    found = words.join(F.broadcast(own), "word", "left").join(F.broadcast(all_), "stem", "left")  # a row for each asked word
    return found.select("word", F.coalesce("plain", F.lit(0)).alias("plain"), F.coalesce("stemmed", F.lit(0)).alias("stemmed"))


def rewritten(question: Column) -> Column:
    """A question's words without idle ones, in order and each once, as a search asks for them: what a
    model is asked to do with it (`providers.rewritten`), without a model. All words of a question of
    idle ones alone stay; null has none."""
    own = F.array_distinct(words(question))
    kept = F.filter(own, lambda w: ~w.isin(*IDLE))
    return F.coalesce(F.when(F.size(kept) > 0, kept).otherwise(own), F.array().cast("array<string>"))


def q_bm25_stemmed(spark, d):
    index = documents_index(spark, d)
    return index.bm25(index.words(ASKED), stemmed=True).select(F.col("vec_id").alias("doc_id"), "score")


def q_phrase_search(spark, d):
    return phrases(documents_index(spark, d), PHRASES).select("phrase", F.col("vec_id").alias("doc_id"), "n")


def q_phrase_search_stemmed(spark, d):
    return phrases(documents_index(spark, d), ("all right reserve", "license under the"), stemmed=True).select("phrase", F.col("vec_id").alias("doc_id"), "n")


def q_inflected_recall(spark, d):
    return word_recall(documents_index(spark, d), INFLECTED)


def q_rewritten_search(spark, d):
    """The ten best documents for what the user says first in every fiftieth conversation."""
    said = table(spark, d, "conversations").filter("conv_id % 50 = 0 AND turn = 0 AND role = 'user'").select(F.col("conv_id").alias("query_id"), rewritten(F.col("text")).alias("w"))
    return documents_index(spark, d).bm25_many(said, 10).withColumnRenamed("vec_id", "doc_id")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

#: Every word of the documents with its place, and the stems of the distinct ones.
_TOKENS = f"""cut AS MATERIALIZED (SELECT doc_id, {words_sql("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
tokens AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM cut)"""
_TEXT = lambda s: "'" + s.replace("'", "''") + "'"


def _phrases_sql(asked: tuple[str, ...], stemmed: bool) -> str:
    parts, heads = [], []
    for k, phrase in enumerate(asked):
        words = words_sql(_TEXT(phrase))
        heads.append(f"asked_{k} AS (SELECT {words} AS a)" if not stemmed else f"asked_{k} AS (SELECT list(stem ORDER BY i) AS a FROM (SELECT unnest({words}) AS term, unnest(range(len({words}))) AS i) JOIN stems USING (term))")
        parts.append(f"""SELECT {_TEXT(phrase)} AS phrase, doc_id, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT doc_id, pos - i AS start FROM placed JOIN (SELECT unnest(range(len(a))) AS i, unnest(a) AS term FROM asked_{k}) USING (term)
  GROUP BY doc_id, pos - i HAVING count(DISTINCT i) = (SELECT len(a) FROM asked_{k})) GROUP BY doc_id""")
    if stemmed:
        every = " UNION ALL ".join(f"SELECT unnest({words_sql(_TEXT(p))}) AS term" for p in asked)
        head = f"{_TOKENS}, every AS (SELECT term FROM tokens UNION ALL {every}), {stem_sql('every')}, placed AS MATERIALIZED (SELECT doc_id, pos, stem AS term FROM tokens JOIN stems USING (term))"
    else:
        head = f"{_TOKENS}, placed AS MATERIALIZED (SELECT doc_id, pos, term FROM tokens)"
    return f"WITH {head}, {', '.join(heads)} {' UNION ALL '.join(parts)}"


_ASKED_TERMS = f"every AS (SELECT term FROM tokens UNION ALL SELECT unnest({words_sql(_TEXT(ASKED))}) AS term)"
_INFLECTED = ", ".join(f"({_TEXT(w)})" for w in INFLECTED)
_IDLE = "(" + ", ".join(f"'{w}'" for w in IDLE) + ")"
ORACLES = {
    "rewritten_search": f"""WITH {_TOKENS}, said AS (SELECT conv_id AS query_id, {words_sql("text")} AS w FROM conversations WHERE conv_id % 50 = 0 AND turn = 0 AND role = 'user'),
own AS (SELECT DISTINCT query_id, unnest(w) AS term FROM said), kept AS (SELECT * FROM own WHERE term NOT IN {_IDLE}),
ask AS (SELECT * FROM kept UNION ALL SELECT * FROM own WHERE query_id NOT IN (SELECT query_id FROM kept)),
every AS (SELECT term FROM tokens UNION ALL SELECT term FROM ask), {stem_sql("every")}, len AS (SELECT doc_id, len(w) AS len FROM cut WHERE len(w) > 0),
size AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM len), wanted AS (SELECT DISTINCT query_id, stem FROM ask JOIN stems USING (term)),
post AS (SELECT stem, doc_id, count(*) AS tf FROM tokens JOIN stems USING (term) WHERE stem IN (SELECT stem FROM wanted) GROUP BY ALL), df AS (SELECT stem, count(*) AS df FROM post GROUP BY stem),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
FROM wanted JOIN post USING (stem) JOIN df USING (stem) JOIN len USING (doc_id), size GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored) WHERE rank <= 10""",
    "bm25_stemmed": f"""WITH {_TOKENS}, {_ASKED_TERMS}, {stem_sql("every")}, len AS (SELECT doc_id, len(w) AS len FROM cut WHERE len(w) > 0),
size AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM len), wanted AS (SELECT DISTINCT stem FROM stems WHERE list_contains({words_sql(_TEXT(ASKED))}, term)),
post AS (SELECT stem, doc_id, count(*) AS tf FROM tokens JOIN stems USING (term) WHERE stem IN (SELECT stem FROM wanted) GROUP BY ALL), df AS (SELECT stem, count(*) AS df FROM post GROUP BY stem)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
FROM post JOIN df USING (stem) JOIN len USING (doc_id), size GROUP BY doc_id""",
    "phrase_search": _phrases_sql(PHRASES, False),
    "phrase_search_stemmed": _phrases_sql(("all right reserve", "license under the"), True),
    "inflected_recall": f"""WITH {_TOKENS}, asked AS (SELECT * FROM (VALUES {_INFLECTED}) v(word)), every AS (SELECT term FROM tokens UNION ALL SELECT word FROM asked), {stem_sql("every")},
held AS (SELECT DISTINCT doc_id, term, stem FROM tokens JOIN stems USING (term)), q AS (SELECT word, stem FROM asked JOIN stems ON word = term)
SELECT word, CAST(count(DISTINCT CASE WHEN held.term = word THEN doc_id END) AS BIGINT) AS plain, CAST(count(DISTINCT doc_id) AS BIGINT) AS stemmed
FROM q LEFT JOIN held USING (stem) GROUP BY word""",
}
