"""Search: vectors, full text, fusion, and what a search form asks for."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.plans.shared import shared_path, small_batches
from tidewater.sources.fixtures import table, view, with_views

#: Result limits, by kind of search.
SEARCH_LIMIT, EVERYTHING_LIMIT = 5000, 1_000_000
#: Our choice of scoring parameters.
K1, B, RRF_K = 1.2, 0.75, 60
#: Every so manyth row is a query of the search queries.
QUERY_STEP = 50
#: Values of the queries that are broadcast for one pass; rows that are compared with them at once.
QUERY_VALUES, ROWS_AT_ONCE = 1_000_000, 64
#: From so many values of the queries on, rows are dealt over all cores before they are compared.
DEALT_VALUES = 10_000
DOCUMENT_TYPES = ("safety_issue", "recommendation", "section", "summary")
#: Names of document types on the form that differ from the stored ones.
FORM_TYPES = {"report_section": "section", "report_text": "summary"}


@dataclass(frozen=True)
class SearchSettings:
    """What the form asks for; unknown modes, agencies or types raise ValueError."""

    years: tuple[int, int] = (2000, 2030)
    document_types: tuple[str, ...] = DOCUMENT_TYPES
    modes: tuple[str, ...] = ("0", "1", "2")
    agencies: tuple[str, ...] = ("TAIC", "ATSB", "TSB")
    cutoff: float = 0.0
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "document_types", tuple(FORM_TYPES.get(t, t) for t in self.document_types))
        if self.years[0] > self.years[1]:
            raise ValueError("the first year is after the last")
        for given, known in ((self.document_types, DOCUMENT_TYPES), (self.modes, ("0", "1", "2")), (self.agencies, ("TAIC", "ATSB", "TSB"))):
            if odd := set(given) - set(known):
                raise ValueError(f"unknown: {sorted(odd)}")

    def predicate(self) -> Column:
        return F.col("year").between(*self.years) & F.col("document_type").isin(*self.document_types) & F.col("mode").isin(*self.modes) & F.col("agency").isin(*self.agencies)


def search_type(query: str) -> str:
    """none for an empty query, fts for one in quotation marks, else vector."""
    q = query.strip()
    return "none" if not q else "fts" if len(q) > 1 and q[0] == q[-1] == '"' else "vector"


def search_type_column(query: Column) -> Column:
    q = F.trim(query)
    return F.when(q == "", "none").when(F.startswith(q, F.lit('"')) & F.endswith(q, F.lit('"')) & (F.length(q) > 1), "fts").otherwise("vector")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that have a direction, those scaled to length one in double precision)."""
    at = [i for i, v in enumerate(vectors) if v is not None and len(v)]
    rows = np.array([vectors[i] for i in at], np.float64).reshape(len(at), -1) if at else np.zeros((0, 1))
    norms = np.sqrt((rows * rows).sum(1))
    fine = norms > 0
    return np.array(at, int)[fine], rows[fine] / norms[fine, None]


class Nearest:
    """The k best rows of each of some queries so far: by relevance to six digits, then the smaller
    key. A row that doesn't reach a query's k-th relevance is gone after one comparison."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int):
        self.ids, self.unit, self.k = ids, unit, k
        self.least = np.full(len(ids), -np.iinfo(np.int64).max)
        self.held = [np.zeros(0, np.int64)] * 3  # query, relevance in millionths, key
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        for s in range(0, len(keys), ROWS_AT_ONCE):
            scores = np.rint(rows[s : s + ROWS_AT_ONCE] @ self.unit.T * 1e6).astype(np.int64)
            i, q = np.nonzero((scores >= self.least) & (keys[s : s + ROWS_AT_ONCE, None] != self.ids))
            if len(i):
                self.waiting.append((q, scores[i, q], keys[s + i]))
            if sum(len(w[0]) for w in self.waiting) > len(self.held[0]) // 2:
                self.settle()

    def settle(self) -> None:
        """Takes in the rows that wait: as many as half of those that are held, so sorting costs little a row."""
        query, score, key = (np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True))
        order = np.lexsort((key, -score, query))
        query, score, key = query[order], score[order], key[order]
        starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        best = rank < self.k
        self.least[query[rank == self.k - 1]] = score[rank == self.k - 1]
        self.held, self.waiting = [query[best], score[best], key[best]], []

    def rows(self, key: str) -> pd.DataFrame:
        if self.waiting:
            self.settle()
        query, score, best = self.held
        return pd.DataFrame({"query_id": self.ids[query], key: best, "millionths": score})


def knn(docs: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", block_values: int = QUERY_VALUES) -> DataFrame:
    """(query_id, key, relevance, rank): the k nearest rows of every query, itself left out. Queries
    are rows of (query_id, q), docs of (key, embedding); ids are whole numbers, vectors of one length.

    The queries go past all rows in blocks of `block_values` values, each broadcast for one pass; a
    task keeps k rows a query, and only those are shuffled. Several blocks are written one after the
    other to the shared folder and read as one table, so neither the plan nor the driver's memory
    grows with the queries. Vectors that are null, empty or zero are nobody's neighbours."""
    spark = docs.sparkSession
    values = queries.agg(F.sum(F.size("q").cast("long"))).first()[0] or 0
    blocks = max(1, -(-values // block_values))
    w = Window.partitionBy("query_id").orderBy(F.desc("millionths"), key)
    shape = f"query_id long, {key} long, millionths long"
    folder = shared_path(spark, "nearest") if blocks > 1 else None
    rows = docs.select(F.col(key).cast("long").alias(key), "embedding")
    if values >= DEALT_VALUES:  # a row is few bytes but long to compare with many queries
        rows = rows.repartition(2 * spark.sparkContext.defaultParallelism)
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "q").collect()
        at, unit = unit_rows([r["q"] for r in own])
        held = spark.sparkContext.broadcast((np.array([own[i]["query_id"] for i in at], np.int64), unit))

        def search(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            best = Nearest(*held.value, k)
            for b in batches:
                at, rows = unit_rows(b["embedding"].tolist())
                if len(at) and len(best.ids):
                    best.add(b[key].to_numpy(np.int64)[at], rows)
            yield best.rows(key)

        near = rows.mapInPandas(search, shape)
        top = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        top = top.select("query_id", key, F.round(F.col("millionths") / 1e6, 6).alias("relevance"), "rank")
        if folder is None:
            return top
        top.write.mode("append").parquet(folder)
        held.destroy()
    return spark.read.parquet(folder)


def words_of(text: Column) -> Column:
    """The words a-z of a text, in order, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def bm25(docs: DataFrame, wanted: list[str], key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, score) of documents with any of the terms; documents of one key count as one. A document's
    length and its counts of the terms are summed where it is read: one row a document is shuffled."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).filter(F.lit(False))
    # Words are cut once: a document's rows follow each other, so a task sums them before the shuffle.
    words = docs.select(key, F.explode(words_of(F.col(body))).alias("term"))
    count = lambda term: F.sum((F.col("term") == F.lit(term)).cast("long"))
    counted = words.groupBy(key).agg(F.count("*").alias("len"), *[count(t).alias(f"tf{i}") for i, t in enumerate(wanted)])
    totals = counted.agg(
        F.count("*").alias("docs"),
        F.avg("len").alias("avg_len"),
        *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))],
    )
    joined = counted.filter(F.greatest(*[F.col(f"tf{i}") for i in range(len(wanted))], F.lit(0)) > 0).join(F.broadcast(totals), F.lit(True))
    part = lambda i: F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return joined.select(key, F.round(reduce(lambda x, y: x + y, [part(i) for i in range(len(wanted))]), 6).alias("score"))


def postings(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(term, key, tf) of every word of the documents."""
    return docs.select(key, F.explode(words_of(F.col(body))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def fuse(ranked: list[DataFrame], key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """(key, score) by reciprocal ranks of lists with (key, rank)."""
    votes = ranked[0].select(key, "rank")
    for r in ranked[1:]:
        votes = votes.unionByName(r.select(key, "rank"))
    return votes.groupBy(key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))


def tfidf(docs: DataFrame, stop: list[str], most_terms: int = 2_000_000) -> DataFrame:
    """(doc_id, term, tfidf) without stop-words; the number of documents is counted over all. Texts are
    cut once, into postings that are written; each term's documents are counted from them and, up to
    `most_terms` terms, broadcast, so that the postings of common words stay where they are."""
    path = shared_path(docs.sparkSession, "postings")
    cut = postings(docs)
    cut.write.parquet(path)
    every = docs.sparkSession.read.schema(cut.schema).parquet(path)
    n = every.select("doc_id").distinct().count()
    kept = every.filter(~F.col("term").isin(stop))
    df = kept.groupBy("term").agg(F.count("*").alias("df"))
    if df.count() <= most_terms:
        df = F.broadcast(df)
    return kept.join(df, "term").select("doc_id", "term", (F.col("tf") * F.log(F.lit(n) / F.col("df"))).alias("tfidf"))


#: Terms that a task counts before it hands the counts on; a text's bytes with all but a-z made spaces.
TERMS_AT_ONCE = 200_000
_SPACED = bytes(i if 97 <= i <= 122 else 32 for i in range(256))


def _document_counts(texts: DataFrame, stop: list[str]) -> DataFrame:
    """(term, df): the number of rows with each term, added up in the tasks before the shuffle."""
    idle = [t.encode() for t in stop]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "df"])
        for b in batches:
            for body in b.column("body").to_pylist():
                seen.update(set((body or b"").translate(_SPACED).split()).difference(idle))
                if len(seen) > TERMS_AT_ONCE:
                    yield told()
                    seen.clear()
        yield told()

    return texts.select("body").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _leading(counts: Counter, weights: dict[bytes, float], low: float, high: float, k: int) -> list[tuple[bytes, int]]:
    """The (term, tf) that can be among the k of most weight after rounding to six digits. Terms without a
    weight have one from `low` to `high`. Of terms with one count and weight only the k first by name."""
    if len(counts) <= k:
        return list(counts.items())
    least = heapq.nlargest(k, (tf * weights.get(t, low) for t, tf in counts.items()))[-1] - 3e-6
    alike: Counter = Counter()
    out = []
    for t, tf in sorted(x for x in counts.items() if x[1] * weights.get(x[0], high) >= least):
        weight = weights.get(t, high)
        alike[tf, weight] += 1
        if alike[tf, weight] <= k or (weight == high > low and t not in weights):
            out.append((t, tf))
    return out


def top_terms(docs: DataFrame, stop: list[str], k: int, most_terms: int = 500_000) -> DataFrame:
    """(doc_id, term, tfidf, rank): each document's k terms of most weight, rounded to six digits, then by
    name. Texts are cut twice, for the terms' documents and for the weights. The weights of the up to
    `most_terms` terms of most documents are broadcast; the others' lie in known bounds, so a task drops the
    terms that can't be among the k, and only what is left is joined or shuffled, rare terms alone by term.
    Rows that share an id count as one document, by their postings."""
    small_batches()
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    shared = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id"))
    n_shared = shared.count()
    once, several = docs, None
    if n_shared:
        shared = F.broadcast(shared) if n_shared <= most_terms else shared
        same = F.col("doc_id").eqNullSafe(F.col("_id"))
        once = docs.join(shared, same, "left_anti")
        several = postings(docs.join(shared, same, "left_semi")).filter(~F.col("term").isin(stop)).select("doc_id", "term", "tf")
    texts = once.select("doc_id", F.lower("text").cast("binary").alias("body"))
    counted = _document_counts(texts, stop)
    if several is not None:
        counted = counted.unionByName(several.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    path = shared_path(spark, "terms")
    counted.write.parquet(path)
    df = spark.read.schema("term string, df long").parquet(path)
    n = docs.filter(F.lower("text").rlike("[a-z]")).agg(F.countDistinct("doc_id")).first()[0]
    # The rare terms: those of fewer documents than a power of two, the least that leaves few enough others.
    classes = {r["digits"]: r["n"] for r in df.groupBy(F.length(F.bin("df")).alias("digits")).agg(F.count("*").alias("n")).collect()}
    digits = next(x for x in range(1, 65) if sum(c for y, c in classes.items() if y > x) <= most_terms)
    common, rare = df.filter(F.col("df") >= 1 << digits), df.filter(F.col("df") < 1 << digits)
    told = common.toArrow()
    held = spark.sparkContext.broadcast((told.column("term").combine_chunks(), told.column("df").to_numpy()))
    bounds = log(max(1, n) / ((1 << digits) - 1)), log(max(1, n))
    idle = [t.encode() for t in stop]

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, dfs = held.value
        weights = dict(zip(terms.cast(pa.binary()).to_pylist(), np.log(max(1, n) / dfs).tolist(), strict=True))
        for b in batches:
            at, found = [], []
            for i, body in enumerate(b.column("body").to_pylist()):
                counts = Counter((body or b"").translate(_SPACED).split())
                for t in idle:
                    counts.pop(t, None)
                own = _leading(counts, weights, *bounds, k)
                at.extend([i] * len(own))
                found.extend(own)
            words, tf = pa.array([t for t, _ in found], pa.binary()).cast(pa.string()), pa.array([c for _, c in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), words, tf], ["doc_id", "term", "tf"])

    found = texts.mapInArrow(lead, f"doc_id {kind}, term string, tf long")
    if several is not None:
        found = found.unionByName(several)
    found = found.join(F.broadcast(common), "term", "left")
    if digits == 1:  # the rare terms are those of one document
        found = found.withColumn("df", F.coalesce("df", F.lit(1)))
    else:
        path = shared_path(spark, "leading")
        found.write.parquet(path)
        found = spark.read.schema(found.schema).parquet(path)
        found = found.filter("df IS NOT NULL").unionByName(found.filter("df IS NULL").drop("df").join(rare, "term"))
    scored = found.select("doc_id", "term", F.round(F.col("tf") * F.log(F.lit(n) / F.col("df")), 6).alias("tfidf"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), "term"))).filter(F.col("rank") <= k)


def plan(spark: SparkSession, sf_dir: str, query: str, settings: SearchSettings, vector: list[float] | None = None) -> DataFrame:
    """The rows a search returns, most relevant first; the filter comes before the scores."""
    docs = view(spark, sf_dir, "vectors").filter(settings.predicate())
    kind = search_type(query)
    if kind == "none":
        return docs.withColumn("relevance", F.lit(0.0)).orderBy("vec_id").limit(EVERYTHING_LIMIT)
    if kind == "fts":
        hits = bm25(docs, query.lower().strip('" ').split(), "vec_id", "document").withColumnRenamed("score", "relevance")
        return docs.join(hits, "vec_id").orderBy(F.desc("relevance"), "vec_id").limit(SEARCH_LIMIT)
    q = F.array(*[F.lit(float(x)) for x in vector])
    return docs.withColumn("relevance", cosine(F.col("embedding"), q)).orderBy(F.desc("relevance"), "vec_id").limit(SEARCH_LIMIT)


def nearest_cells(docs: DataFrame, cells: int = 16, seed: int = 3, sample_rows: int = 20_000):
    """(rows with their cell, centres) of a coarse index: the centres are fitted on a bounded
    sample of `sample_rows` rows by hash, and every row is assigned."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = docs.count()
    rows = docs.withColumn("features", array_to_vector("embedding"))
    part = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_rows / max(1, total))))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(part)
    return model.transform(rows).withColumnRenamed("prediction", "cell").drop("features"), [list(map(float, c)) for c in model.clusterCenters()]


def probe_order(vector: Column, centres: list[list[float]]) -> Column:
    """The cells by the cosine of their centres with a vector, the nearest first."""
    far = F.array(*[F.struct((-cosine(vector, F.array(*map(F.lit, c)))).alias("far"), F.lit(i).alias("cell")) for i, c in enumerate(centres)])
    return F.transform(F.array_sort(far), lambda x: x["cell"])


def _queries(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


#: Words to search for in the fixtures, and stop-words.
SEARCH_TERMS = ["licensed", "version", "reserved", "license"]
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "it", "for", "la", "de", "le", "et", "que", "el", "y", "der", "die", "und", "das"]


def q_vector_topk(spark, d):
    docs = view(spark, d, "vectors").filter(SearchSettings((2002, 2020), ("safety_issue", "section", "summary")).predicate())
    hits = knn(docs.select("vec_id", "embedding"), _queries(spark, d), 10)
    return hits.join(docs.select("vec_id", "report_id", "document_type", text.shorten(F.col("document")).alias("document")), "vec_id").select(
        "query_id",
        "rank",
        "vec_id",
        "report_id",
        "document_type",
        "relevance",
        F.length("document").cast("long").alias("n_chars"),
    )


def q_knn_join(spark, d):
    return knn(table(spark, d, "embeddings").select("vec_id", "embedding"), _queries(spark, d), 20)


def q_bm25_search(spark, d):
    return bm25(table(spark, d, "documents"), SEARCH_TERMS)


def q_fts_phrase_terms(spark, d):
    phrase = F.rlike(F.lower("text"), F.lit(r"(^|[^a-z])all rights reserved([^a-z]|$)"))
    return view(spark, d, "reports").filter(phrase).select("report_id")


def q_hybrid_rrf(spark, d):
    words = bm25(table(spark, d, "documents"), SEARCH_TERMS).orderBy(F.desc("score"), "doc_id").limit(100)
    mean = table(spark, d, "embeddings").agg(F.array(*[F.avg(F.element_at("embedding", k + 1).cast("double")) for k in range(64)]).alias("q"))
    near = table(spark, d, "embeddings").join(F.broadcast(mean), F.lit(True)).select(
        F.col("vec_id").alias("doc_id"),
        F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"),
    ).orderBy(F.desc("score"), "doc_id").limit(100)
    ranked = [x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))) for x in (words, near)]
    return fuse(ranked)


def q_search_all(spark, d):
    return plan(spark, d, "", SearchSettings((2005, 2015))).select("vec_id", "report_id", "relevance")


def q_search_type(spark, d):
    q = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", search_type_column(q).alias("search_type"))


def q_rerank(spark, d):
    first = knn(table(spark, d, "embeddings").select("vec_id", "embedding"), _queries(spark, d), 20)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.size(F.split("text", "\n")).alias("n_lines"))
    second = first.join(texts, "vec_id", "left").withColumn("second", F.col("relevance") + F.coalesce("n_lines", F.lit(0)) / 1000)
    return second.select("query_id", "vec_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("second"), "vec_id")).alias("rank"))


def q_report_weighted(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("score"))
    relevance = v.filter("score > 0.15").groupBy("label").agg(F.avg("score").alias("rel"))
    return v.join(F.broadcast(relevance), "label", "left").select("vec_id", F.round(F.col("score") * F.coalesce("rel", F.lit(10.0)), 6).alias("weighted"))


def q_tfidf_top_terms(spark, d):
    return top_terms(table(spark, d, "documents"), STOP_WORDS, 5)


def q_ivf_recall(spark, d):
    """Recall of the ten nearest by the number of probed cells. Within the probed cells the search is
    exact, so a neighbour is found if its cell is among the first probes of its query."""
    docs = table(spark, d, "embeddings").select("vec_id", "embedding")
    cells, centres = nearest_cells(docs)
    asked = _queries(spark, d).select("query_id", probe_order(F.col("q"), centres).alias("order"))
    near = knn(docs, _queries(spark, d), 10).select("query_id", "vec_id").join(cells.select("vec_id", "cell"), "vec_id").join(asked, "query_id")
    place = near.select(F.array_position("order", F.col("cell")).alias("place"))
    probes = F.explode(F.sequence(F.lit(1), F.lit(len(centres))))
    return place.select("place", probes.alias("probes")).groupBy("probes").agg(
        F.round(F.avg((F.col("place") <= F.col("probes")).cast("int")), 4).alias("recall"),
        F.count("*").alias("n"),
    )


def q_kmeans_clusters(spark, d):
    rows, _ = nearest_cells(table(spark, d, "embeddings").select("vec_id", "embedding"), 3)
    return rows.groupBy("cell").agg(F.count("*").alias("n"))


def q_rag_context(spark, d):
    hits = knn(table(spark, d, "embeddings").select("vec_id", "embedding"), _queries(spark, d), 5)
    told = hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    line = F.concat(F.lit("["), F.col("vec_id").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    return told.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("context"),
    )


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_COS = "CAST(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) AS DOUBLE)"
_KNN = f"""near AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS relevance FROM {{docs}} e
JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
ORDER BY relevance DESC, vec_id) AS INT) AS rank FROM near)"""
_LIST = "(" + ", ".join(f"'{t}'" for t in SEARCH_TERMS) + ")"
_BM25 = f"""len AS (SELECT doc_id, count(*) AS len FROM terms GROUP BY doc_id), size AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM len), post
AS (SELECT term, doc_id, count(*) AS tf FROM terms WHERE term IN {_LIST} GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post
GROUP BY term), bm AS (SELECT doc_id,
round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM post
JOIN df USING (term) JOIN len USING (doc_id), size GROUP BY doc_id)"""
_STOP = "(" + ", ".join(f"'{t}'" for t in STOP_WORDS) + ")"
ORACLES = {
    "vector_topk": with_views("WITH docs AS (SELECT * FROM vectors WHERE year BETWEEN 2002 AND 2020 AND document_type IN ('safety_issue', 'section', 'summary')), " + _KNN.format(docs="docs") + " SELECT query_id, rank, k.vec_id, report_id, document_type, relevance, CAST(CASE WHEN length(document) < 1200 THEN length(document) ELSE 1203 END AS BIGINT) AS n_chars FROM k JOIN docs ON docs.vec_id = k.vec_id WHERE rank <= 10", "vectors"),
    "knn_join": "WITH " + _KNN.format(docs="embeddings") + " SELECT query_id, vec_id, relevance, rank FROM k WHERE rank <= 20",
    "bm25_search": with_views(f"WITH {_BM25} SELECT doc_id, score FROM bm", "terms"),
    "fts_phrase_terms": with_views("SELECT report_id FROM reports WHERE regexp_matches(lower(text), '(^|[^a-z])all rights reserved([^a-z]|$)')", "reports"),
    "hybrid_rrf": with_views(f"""WITH {_BM25}, x AS (SELECT unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT list(a
ORDER BY i) AS q FROM (SELECT i, avg(v) AS a FROM x GROUP BY i)),
n AS (SELECT vec_id AS doc_id, round({_COS.format(a='embedding', b='q')}, 6) AS score FROM embeddings, m), r AS (SELECT doc_id,
row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)
FROM n)
SELECT doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM r WHERE rank <= 100 GROUP BY doc_id""", "terms"),
    "search_all": with_views("SELECT vec_id, report_id, CAST(0 AS DOUBLE) AS relevance FROM vectors WHERE year BETWEEN 2005 AND 2015 ORDER BY vec_id LIMIT 1000000", "vectors"),
    "search_type": """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'none' WHEN turn % 3 = 1 THEN 'fts' WHEN trim(text, ' ') = '' THEN 'none'
WHEN starts_with(trim(text, ' '), '\"') AND ends_with(trim(text, ' '), '\"') THEN 'fts' ELSE 'vector' END AS search_type FROM conversations""",
    "rerank": "WITH " + _KNN.format(docs="embeddings") + """, s AS (SELECT query_id, vec_id, relevance + coalesce(len(string_split(text, chr(10))), 0) / 1000 AS second FROM k LEFT
JOIN documents ON doc_id = vec_id WHERE rank <= 20) SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id
ORDER BY second DESC, vec_id) AS INT) AS rank FROM s""",
    "report_weighted": """WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings), r AS (SELECT label, avg(score) AS rel FROM v
WHERE score > 0.15 GROUP BY label) SELECT vec_id, round(score * coalesce(rel, 10), 6) AS weighted FROM v LEFT JOIN r USING (label)""",
    "tfidf_top_terms": with_views(f"""WITH p AS (SELECT term, doc_id, count(*) AS tf FROM terms WHERE term NOT IN {_STOP} GROUP BY ALL), n
AS (SELECT count(DISTINCT doc_id) AS docs FROM terms), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT doc_id, term,
round(tf * ln(docs / df), 6) AS tfidf FROM p JOIN df USING (term), n) SELECT doc_id, term, tfidf, CAST(rank AS INT) AS rank FROM (SELECT *,
row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank FROM s) WHERE rank <= 5""", "terms"),
    "rag_context": "WITH " + _KNN.format(docs="embeddings") + """ SELECT query_id, string_agg('[' || vec_id || '] ' || coalesce(text, ''), chr(10) ORDER BY rank) AS context FROM k
JOIN documents ON doc_id = vec_id WHERE rank <= 5 GROUP BY query_id""",
}
