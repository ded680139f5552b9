"""Joins, set operations and incremental merges of report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.fixtures import table, view, with_views


def combine_reports(parts: list[DataFrame], titles: DataFrame, key: str = "report_id") -> DataFrame:
    """Full outer join of all parts on the report, then the titles' columns."""
    return reduce(lambda a, b: a.join(b, key, "full"), parts).join(titles, key, "left")


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which null keys meet null keys; the keys come once."""
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    rest = [F.col(f"{side}.{c}") for side, df in (("a", a), ("b", b)) for c in df.columns if c not in keys]
    return a.alias("a").join(b.alias("b"), on, how).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *rest)


def only_new(rows: DataFrame, done: DataFrame, key: str = "report_id", refresh: bool = False) -> DataFrame:
    """Rows whose key isn't among the finished ones; all rows on refresh."""
    return rows if refresh else rows.join(done.select(key), key, "left_anti")


def link_candidates(recommendations: DataFrame, issues: DataFrame) -> DataFrame:
    """Every recommendation with every issue of its own report."""
    return recommendations.join(issues, "report_id")


def upgrade_links(links: DataFrame) -> DataFrame:
    """Possible links become confirmed where the recommendation has no confirmed one in its report."""
    sure = F.max((F.col("link") == "Confirmed").cast("int")).over(Window.partitionBy("report_id", "recommendation_id"))
    new = F.when((sure == 0) & (F.col("link") == "Possible"), "Confirmed").otherwise(F.col("link"))
    return links.withColumn("link", new).dropDuplicates(["report_id", "recommendation_id", "safety_issue_id"])


def lookup_last(rows: DataFrame, key: str, names: DataFrame, order: str, missing: Column) -> DataFrame:
    """Adds `name` from (key, name), of which the last by `order` counts; a miss gives `missing`."""
    last = names.groupBy(key).agg(F.max_by("name", order).alias("name"))
    return rows.join(last, key, "left").withColumn("name", F.coalesce("name", missing))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows take the place of old rows of their key; both have the same columns."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`, which is unique within a key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by `order`, which is unique within a key."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def origin(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full join with where each key was found."""
    out = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full")
    return out.withColumn("origin", F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")).drop("_a", "_b")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All rows by column name; what a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """All rows whose key occurs more than once; counts are summed before the join."""
    often = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(often, key)


def word_set(text: Column) -> Column:
    """The different words a-z of a text, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over all items of two arrays of different items; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 0.0).otherwise(both.cast("double") / either)


def worded_pairs(recommendations: DataFrame, issues: DataFrame) -> DataFrame:
    """The pairs of link_candidates with `score`, the Jaccard similarity of their words; each text is
    cut into words once, before the join, and isn't carried through it."""
    r = recommendations.select("report_id", "recommendation_id", word_set(F.col("recommendation")).alias("_r"))
    i = issues.select("report_id", "safety_issue_id", word_set(F.col("safety_issue")).alias("_i"))
    return link_candidates(r, i).select("report_id", "recommendation_id", "safety_issue_id", set_jaccard(F.col("_r"), F.col("_i")).alias("score"))


def link_label(score: Column) -> Column:
    """The offline label of a recommendation and an issue by their shared words."""
    return F.when(score >= 0.5, "Confirmed").when(score >= 0.15, "Possible").otherwise("None")


def _links(spark, d) -> DataFrame:
    pairs = worded_pairs(view(spark, d, "recommendations"), view(spark, d, "issues"))
    return pairs.select("report_id", "recommendation_id", "safety_issue_id", link_label(F.col("score")).alias("link"))


def q_extracted_reports(spark, d):
    r = view(spark, d, "reports")
    parts = [
        r.filter("year <> 2007").select("report_id", F.length("text").alias("n_chars")),
        r.filter("lang <> 'es'").select("report_id", "event_type"),
        view(spark, d, "issues").groupBy("report_id").agg(F.count("*").alias("n_issues")),
        view(spark, d, "recommendations").groupBy("report_id").agg(F.count("*").alias("n_recommendations")),
        view(spark, d, "bounds").filter("last_pos > 3").select("report_id", "last_pos"),
        r.filter("agency <> 'TSB'").select("report_id", "source"),
    ]
    return combine_reports(parts, r.select("report_id", "agency_id", "investigation_type"))


def q_unassigned_types(spark, d):
    r = view(spark, d, "reports")
    typed = r.filter("agency <> 'ATSB'").select("report_id", "event_type", F.lit("x").alias("assigned"))
    return null_safe_join(
        r.select("report_id", "event_type"),
        typed,
        ["report_id", "event_type"],
        "full",
    ).filter(F.col("assigned").isNull()).select("report_id", "event_type")


def q_safety_issue_inputs(spark, d):
    r = view(spark, d, "reports")
    toc = r.filter("lang = 'en'").select("report_id", "lang")
    return r.filter("agency <> 'TAIC'").select("report_id", "year").join(toc, "report_id", "full").join(
        r.select("report_id", "investigation_type"),
        "report_id",
        "left",
    )


def q_missing_recommendations(spark, d):
    r = view(spark, d, "reports")
    own = view(spark, d, "recommendations").filter(F.length("recommendation") > 200).select("report_id").distinct()
    return r.filter("agency = 'ATSB'").select("report_id", "agency_id").join(own, "report_id", "left_anti")


def q_anti_join_new(spark, d):
    return only_new(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


def q_semi_join_known(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_semi")


def q_link_candidates(spark, d):
    return link_candidates(view(spark, d, "recommendations"), view(spark, d, "issues")).select("report_id", "recommendation_id", "safety_issue_id")


def q_link_score(spark, d):
    return _links(spark, d)


def q_link_upgrade(spark, d):
    return upgrade_links(_links(spark, d))


def q_id_lookup(spark, d):
    r = view(spark, d, "reports").select(F.concat(F.lit("k"), (F.col("doc_id") % 300).cast("string")).alias("agency_id"), "report_id", "doc_id")
    rows = r.select("doc_id", F.when(F.col("doc_id") % 6 == 0, "k999").otherwise(F.col("agency_id")).alias("agency_id"))
    names = r.select("agency_id", F.col("report_id").alias("name"), "doc_id")
    return lookup_last(rows, "agency_id", names, "doc_id", F.concat(F.lit("Unmatched ("), F.col("agency_id"), F.lit(")"))).select("doc_id", "agency_id", "name")


def q_status_upsert(spark, d):
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    now = o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 == 0, "C").when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderstatus")).alias("status"),
    )
    changed = now.alias("n").join(old.alias("o"), "o_orderkey").filter(~F.col("n.status").eqNullSafe(F.col("o.status"))).select("o_orderkey", "n.status")
    return upsert(old, changed, "o_orderkey")


def q_reuse_classification(spark, d):
    rec = view(spark, d, "recommendations").select("report_id", "recommendation_id", "made")
    known = rec.filter(~F.endswith("recommendation_id", F.lit("3"))).select("report_id", "recommendation_id", "made", F.lit("accepted").alias("category"))
    return null_safe_join(rec, known, ["report_id", "recommendation_id", "made"], "full").distinct()


def q_label_agreement(spark, d):
    labels = table(spark, d, "labels")
    other = labels.select("doc_id", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality_b"))
    return labels.select("doc_id", "quality").join(other, "doc_id").filter("quality <> quality_b").select("doc_id", "quality", "quality_b")


def q_join_logs(spark, d):
    e = table(spark, d, "events")
    keys = ["user_id", "event_id"]
    results = e.filter("value > 50").select(*keys, F.col("value").alias("num_results"))
    errors = e.filter("value > 90").select(*keys, F.lit("failed").alias("error"))
    return e.select(*keys, "event_type").join(results, keys, "left").join(errors, keys, "left")


def q_merge_indicator(spark, d):
    r = view(spark, d, "reports")
    return origin(r.filter("agency <> 'TAIC'").select("report_id"), r.filter("lang = 'en'").select("report_id"), "report_id")


def q_match_coverage(spark, d):
    pairs = worded_pairs(view(spark, d, "recommendations"), view(spark, d, "issues"))
    best = pairs.groupBy("report_id", "safety_issue_id").agg(F.max((F.col("score") > 0.1).cast("int")).alias("matched"))
    per = best.groupBy("report_id").agg(F.avg("matched").alias("coverage"))
    return per.agg(
        F.round(F.avg("coverage"), 6).alias("mean_coverage"),
        F.round(F.avg((F.col("coverage") == 1).cast("int")), 6).alias("fully_matched"),
        F.count("*").alias("n_reports"),
    )


def q_union_sources(spark, d):
    r = view(spark, d, "reports")
    return union_sources(
        [
            r.filter("agency = 'TAIC'").select("report_id", "year"),
            r.filter("agency = 'ATSB'").select("report_id", "agency_id"),
            r.filter("agency = 'TSB'").select("agency_id", "report_id", "year"),
        ],
    )


def q_distinct_rows(spark, d):
    return table(spark, d, "documents").select("text", "lang").dropDuplicates().groupBy("lang").agg(F.count("*").alias("n"))


def q_duplicate_report(spark, d):
    return duplicates(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "n")


def q_dedupe_keep_first(spark, d):
    return keep_first(table(spark, d, "documents").select("text", "doc_id", "source"), "text", "doc_id").select("doc_id", "source")


def q_array_distinct(spark, d):
    return view(spark, d, "reports").select(
        "report_id",
        F.array_join(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))), " ").alias("words"),
    )


def q_incremental_new(spark, d):
    r = view(spark, d, "reports")
    ledger = r.filter("investigation_type = 'short'").select("report_id").unionAll(r.filter("investigation_type = 'short' AND lang = 'en'").select("report_id"))
    return only_new(r.select("report_id", "year"), ledger)


def q_upsert_latest(spark, d):
    e = table(spark, d, "events")
    return latest(e.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value")), "user_id", "event_id")


def q_fill_missing(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("x"))
    have = v.filter("label > 3").drop("label")
    filled = table(spark, d, "documents").select(
        F.col("doc_id").alias("vec_id"),
        F.length("text").cast("double").alias("x"),
    ).join(v.select("vec_id"), "vec_id", "left_semi").join(have.select("vec_id"), "vec_id", "left_anti")
    return have.unionByName(filled).select("vec_id", F.round("x", 6).alias("x"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z]+'), lambda w: w <> ''))"
_A, _B = _WORDS.format(c="recommendation"), _WORDS.format(c="safety_issue")
_SCORE = f"""CASE WHEN len(list_distinct(list_concat({_A}, {_B}))) = 0 THEN 0.0 ELSE CAST(len(list_intersect({_A},
{_B})) AS DOUBLE) / len(list_distinct(list_concat({_A}, {_B}))) END"""
_LINKS = f"""links AS (SELECT report_id, recommendation_id, safety_issue_id, CASE WHEN s >= 0.5 THEN 'Confirmed' WHEN s >= 0.15 THEN 'Possible'
ELSE 'None' END AS link FROM (SELECT report_id, recommendation_id, safety_issue_id, {_SCORE} AS s FROM recommendations
JOIN issues USING (report_id)))"""
_R = "reports"
ORACLES = {
    "extracted_reports": with_views("""WITH a AS (SELECT report_id, CAST(length(text) AS INT) AS n_chars FROM reports WHERE year <> 2007), b AS (SELECT report_id, event_type
FROM reports WHERE lang <> 'es'),
c AS (SELECT report_id, count(*) AS n_issues FROM issues GROUP BY report_id), e AS (SELECT report_id, count(*) AS n_recommendations
FROM recommendations GROUP BY report_id),
f AS (SELECT report_id, last_pos FROM bounds WHERE last_pos > 3), g AS (SELECT report_id, source FROM reports WHERE agency <> 'TSB')
SELECT report_id, n_chars, b.event_type, n_issues, n_recommendations, f.last_pos, g.source, t.agency_id, t.investigation_type FROM a FULL
JOIN b USING (report_id) FULL JOIN c USING (report_id) FULL JOIN e USING (report_id) FULL JOIN f USING (report_id) FULL
JOIN g USING (report_id) LEFT JOIN reports t USING (report_id)""", _R, "issues", "recommendations", "bounds"),
    "unassigned_types": with_views("SELECT report_id, event_type FROM reports WHERE agency = 'ATSB'", _R),
    "safety_issue_inputs": with_views("""WITH a AS (SELECT report_id, year FROM reports WHERE agency <> 'TAIC'), b AS (SELECT report_id, lang FROM reports WHERE lang = 'en')
SELECT report_id, a.year, b.lang, t.investigation_type FROM a FULL JOIN b USING (report_id) LEFT JOIN reports t USING (report_id)""", _R),
    "missing_recommendations": with_views("""SELECT report_id, agency_id FROM reports WHERE agency = 'ATSB' AND NOT EXISTS (SELECT 1 FROM recommendations c
WHERE c.report_id = reports.report_id AND length(c.recommendation) > 200)""", _R, "recommendations"),
    "anti_join_new": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "semi_join_known": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "link_candidates": with_views("SELECT report_id, recommendation_id, safety_issue_id FROM recommendations JOIN issues USING (report_id)", "recommendations", "issues"),
    "link_score": with_views(f"WITH {_LINKS} SELECT * FROM links", "recommendations", "issues"),
    "link_upgrade": with_views(f"""WITH {_LINKS} SELECT report_id, recommendation_id, safety_issue_id, CASE WHEN link = 'Possible'
AND NOT bool_or(link = 'Confirmed') OVER (PARTITION BY report_id, recommendation_id) THEN 'Confirmed' ELSE link END AS link FROM links""", "recommendations", "issues"),
    "id_lookup": with_views("""WITH r AS (SELECT doc_id, report_id, 'k' || CAST(doc_id % 300 AS VARCHAR) AS k FROM reports), n AS (SELECT k, arg_max(report_id,
doc_id) AS name FROM r GROUP BY k), x AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'k999' ELSE k END AS agency_id FROM r) SELECT doc_id,
agency_id, coalesce(name, 'Unmatched (' || agency_id || ')') AS name FROM x LEFT JOIN n ON n.k = x.agency_id""", _R),
    "status_upsert": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'C' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders",
    "reuse_classification": with_views("""SELECT DISTINCT report_id, recommendation_id, made, CASE WHEN NOT ends_with(recommendation_id, '3') THEN 'accepted' END AS category
FROM recommendations""", "recommendations"),
    "label_agreement": "SELECT doc_id, quality, 1 - quality AS quality_b FROM labels WHERE doc_id % 9 = 0",
    "join_logs": """SELECT user_id, event_id, event_type, CASE WHEN value > 50 THEN value END AS num_results, CASE WHEN value > 90 THEN 'failed' END AS error
FROM events""",
    "merge_indicator": with_views("""SELECT report_id, CASE WHEN agency = 'TAIC' THEN 'right_only' WHEN lang = 'en' THEN 'both' ELSE 'left_only' END AS origin FROM reports
WHERE agency <> 'TAIC' OR lang = 'en'""", _R),
    "match_coverage": with_views(f"""WITH m AS (SELECT report_id, safety_issue_id, max(CASE WHEN {_SCORE} > 0.1 THEN 1 ELSE 0 END) AS k FROM recommendations
JOIN issues USING (report_id) GROUP BY ALL), p AS (SELECT report_id, avg(k) AS c FROM m GROUP BY report_id) SELECT round(avg(c),
6) AS mean_coverage, round(avg(CASE WHEN c = 1 THEN 1 ELSE 0 END), 6) AS fully_matched, count(*) AS n_reports FROM p""", "recommendations", "issues"),
    "union_sources": with_views("SELECT report_id, CASE WHEN agency <> 'ATSB' THEN year END AS year, CASE WHEN agency <> 'TAIC' THEN agency_id END AS agency_id FROM reports", _R),
    "distinct_rows": "SELECT lang, count(*) AS n FROM (SELECT DISTINCT text, lang FROM documents) GROUP BY lang",
    "duplicate_report": "SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1",
    "dedupe_keep_first": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
    "array_distinct": with_views("""WITH w AS (SELECT report_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, unnest(range(len(regexp_extract_all(lower(text),
'[a-z]+')))) AS i FROM reports), f AS (SELECT report_id, w, min(i) AS i FROM w GROUP BY ALL), j AS (SELECT report_id, string_agg(w, ' '
ORDER BY i) AS words FROM f GROUP BY report_id) SELECT report_id, coalesce(words, '') AS words FROM reports LEFT JOIN j USING (report_id)""", _R),
    "incremental_new": with_views("SELECT report_id, year FROM reports WHERE investigation_type IS DISTINCT FROM 'short'", _R),
    "upsert_latest": """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""",
    "fill_missing": """SELECT vec_id, round(CASE WHEN label > 3 THEN CAST(embedding[1] AS DOUBLE) ELSE length(text) END, 6) AS x FROM embeddings LEFT
JOIN documents ON doc_id = vec_id WHERE label > 3 OR doc_id IS NOT NULL""",
}
