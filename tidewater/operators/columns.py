"""Projections and filters on report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import ids, text
from tidewater.sources.fixtures import table, view, with_views

VECTOR_TEXT = ("document", "document_id", "report_id", "document_type")


def document_union(issues: DataFrame, recommendations: DataFrame, sections: DataFrame, summaries: DataFrame) -> DataFrame:
    """The four kinds of documents under one schema, each with an id of its own."""
    kinds = (
        (issues, "safety_issue", "safety_issue_id", "si", "safety_issue"),
        (recommendations, "recommendation", "recommendation_id", "rec", "recommendation"),
        (sections, "section_text", "section", "sec", "section"),
        (summaries, "summary", None, "sum", "summary"),
    )
    parts = [
        df.select(
            F.col(body).alias("document"),
            F.concat_ws("_", *([F.col(key)] if key else []), F.lit(tag), "report_id").alias("document_id"),
            "report_id",
            F.lit(kind).alias("document_type"),
        )
        for df, body, key, tag, kind in kinds
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_documents(docs: DataFrame, body: str = "document", key: str = "document_id") -> DataFrame:
    """Drops unmatched ids, null and blank documents, rows with any null, and repeated rows."""
    out = docs.filter(~F.contains(F.col(key), F.lit("nmatched"))).filter(F.col(body).isNotNull()).filter(~text.is_blank(F.col(body)))
    return out.dropna().dropDuplicates()


def search_predicate(years: tuple[int, int], document_types: list[str], modes: list[str], agencies: list[str]) -> Column:
    """The search form's filter."""
    return F.col("year").between(*years) & F.col("document_type").isin(document_types) & F.col("mode").isin(modes) & F.col("agency").isin(agencies)


def hierarchy(titles: Column) -> Column:
    """An indented outline from an array of struct(title, level, page); an empty page is 0."""
    line = lambda h: F.concat(F.repeat(F.lit("- - "), h["level"] - 1), h["title"], F.lit(" "), F.when(h["page"] == "", F.lit("0")).otherwise(h["page"]))
    return F.array_join(F.transform(titles, line), "\n")


def eligibility(important: Column, agency: Column, kind: Column, whole: Column) -> Column:
    """Why a report's text isn't read for issues, or `extract`."""
    n = F.length(important)
    return (
        F.when(important.isNull() | (n < 100), "no text")
        .when(agency == "ATSB", "from website")
        .when(agency == "TAIC", "extract")
        .when(kind.eqNullSafe("unknown") & whole & (n < 40_000), "short unknown")
        .otherwise("extract")
    )


def recommendation_id_rule(rows: DataFrame, key: str = "recommendation_id") -> DataFrame:
    """Where a report is later than 2010 or has any id at all, rows without an id (null or empty) go."""
    any_id = F.max(F.col(key).isNotNull().cast("int")).over(Window.partitionBy("report_id")) == 1
    must = (F.col("year") > 2010) | any_id
    return rows.withColumn("_must", must).filter(~F.col("_must") | (F.coalesce(F.col(key), F.lit("")) != "")).drop("_must")


def drop_repeated(rows: DataFrame, column: str, most: int = 3) -> DataFrame:
    """Drops values that occur more than `most` times. Counts are summed before they are joined
    back, so that a common value isn't gathered in one task."""
    often = rows.groupBy(column).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(column)
    return rows.join(often, column, "left_anti")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "reports")


def q_derive_report_keys(spark, d):
    return _reports(spark, d).select("report_id", *[c.alias(k) for k, c in ids.key_parts(F.col("report_id")).items()])


def q_mode_from_id(spark, d):
    shown = _reports(spark, d).select(
        "doc_id",
        F.when(
            F.col("doc_id") % 3 == 0,
            F.concat(F.lit("2010_"), F.lpad((F.col("doc_id") % 400).cast("string"), 3, "0")),
        ).otherwise(F.col("report_id")).alias("report_id"),
    )
    return shown.select("doc_id", "report_id", ids.mode_of(F.col("report_id")).alias("mode"))


def q_mode_label(spark, d):
    return _reports(spark, d).select("report_id", ids.mode_label(F.col("mode")).alias("mode_label"))


def q_document_schema_union(spark, d):
    sections = view(spark, d, "lines").select("report_id", F.col("pos").cast("string").alias("section"), F.col("line").alias("section_text"))
    summaries = _reports(spark, d).select("report_id", F.col("text").alias("summary"))
    return document_union(view(spark, d, "issues"), view(spark, d, "recommendations"), sections, summaries)


def q_concat_text(spark, d):
    return _reports(spark, d).select("report_id", F.concat_ws("\n", "event_type", "agency_id").alias("title_text"))


def q_id_prefix(spark, d):
    return _reports(spark, d).select("report_id", ids.id_prefix(F.col("agency_id")).alias("prefix"))


def q_result_clean(spark, d):
    v = view(spark, d, "vectors")
    return v.select(
        "report_id",
        "document_type",
        ids.mode_label(F.col("mode")).alias("mode_label"),
        F.format_string("%.4f", F.element_at("embedding", 1).cast("double") / 2 + 0.5).alias("relevance"),
        text.shorten(F.col("document")).alias("document"),
    )


def q_investigation_type(spark, d):
    kind = F.when(F.col("doc_id") % 5 == 0, "Defined").when(F.col("doc_id") % 5 == 1, "Systemic").when(F.col("doc_id") % 5 == 2, "Occurrence")
    return _reports(spark, d).select("report_id", ids.investigation_type(kind, (F.col("doc_id") % 6).cast("int")).alias("type"))


def q_toc_hierarchy(spark, d):
    heads = view(spark, d, "lines").groupBy("report_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos",
                    F.col("line").alias("title"),
                    (F.col("pos") % 3 + 1).alias("level"),
                    F.when(F.col("pos") % 4 == 0, "").otherwise(F.col("pos").cast("string")).alias("page"),
                ),
            ),
        ).alias("h"),
    )
    return heads.select("report_id", hierarchy(F.col("h")).alias("toc"))


def q_summary_nullify(spark, d):
    summary = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), "text")).otherwise(F.col("text"))
    return _reports(spark, d).select("report_id", F.coalesce(F.length(text.nullify_summary(summary)), F.lit(-1)).cast("long").alias("summary_length"))


def q_explode_nested(spark, d):
    nested = view(spark, d, "issues").groupBy("report_id").agg(F.collect_list(F.struct("safety_issue_id", "safety_issue", "quality")).alias("safety_issues"))
    return nested.select("report_id", F.inline("safety_issues"))


def q_infer_type(spark, d):
    return _reports(spark, d).select("report_id", ids.infer_type(F.col("investigation_type"), F.col("doc_id") % 3 == 0, F.length("text") * 10).alias("type"))


def q_build_url(spark, d):
    return _reports(spark, d).select("report_id", ids.report_url(F.col("agency"), F.col("agency_id")).alias("url"))


def q_search_filter(spark, d):
    v = view(spark, d, "vectors").filter(search_predicate((2003, 2018), ["safety_issue", "section"], ["0", "2"], ["TAIC", "TSB"]))
    return v.select("vec_id", "report_id", "year", "document_type", "mode", "agency")


def q_relevance_cutoff(spark, d):
    return view(spark, d, "vectors").select("vec_id", F.element_at("embedding", 1).cast("double").alias("score")).filter(F.col("score") > 0.1)


def q_valid_ids(spark, d):
    odd = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, F.concat("report_id", F.lit("_x"))).otherwise(F.col("report_id"))
    return _reports(spark, d).select("doc_id", odd.alias("report_id")).filter(ids.is_valid_id(F.col("report_id")))


def q_not_short_nullsafe(spark, d):
    return _reports(spark, d).filter(~F.col("investigation_type").eqNullSafe("short")).select("report_id", "investigation_type")


def q_clean_documents(spark, d):
    lines = view(spark, d, "lines")
    key = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Unmatched ("), "report_id", F.lit(")"))).otherwise(F.col("report_id"))
    body = F.when(F.col("pos") % 8 == 7, None).when(F.col("pos") % 8 == 6, F.lit(" \t ")).otherwise(F.col("line"))
    return clean_documents(lines.select(key.alias("document_id"), body.alias("document")))


def q_token_gate(spark, d):
    return _reports(spark, d).select("report_id", text.word_count(F.col("text")).alias("n_tokens")).filter(F.col("n_tokens") < 2 * 200)


def q_drop_noise_sections(spark, d):
    lines = view(spark, d, "lines")
    body = F.when(
        F.col("pos") % 9 == 0,
        F.concat(F.lit("Source: page "), F.col("pos").cast("string")),
    ).when(F.col("pos") % 9 == 1, F.concat(F.lit("<< Page 3 >> "), "line")).when(F.col("pos") % 9 == 2, F.concat(F.lit("ANNEX A\n"), "line")).otherwise(F.col("line"))
    return lines.select("report_id", "pos", body.alias("section")).filter(~text.is_noise_section(F.col("section"))).select(
        "report_id",
        "pos",
        F.length("section").cast("long").alias("n_chars"),
    )


def q_status_filter(spark, d):
    o = table(spark, d, "orders")
    return o.filter((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") >= 1995)).select(
        "o_orderkey",
        "o_orderstatus",
        F.year("o_orderdate").alias("year"),
    )


def q_embedded_year(spark, d):
    r = _reports(spark, d).select("report_id", F.nullif(F.regexp_extract("agency_id", r"-\d\d(\d\d)-", 1), F.lit("")).cast("int").alias("yy"))
    return r.filter(F.col("yy").between(0, 15))


def q_recommendation_id_rule(spark, d):
    r = view(spark, d, "recommendations").withColumn("year", F.split_part("report_id", F.lit("_"), F.lit(3)).cast("int"))
    at = F.regexp_extract("recommendation_id", r"(\d+)$", 1).cast("int")
    key = F.when(F.col("year") % 3 == 0, None).when(at % 3 == 0, F.lit("")).otherwise(F.col("recommendation_id"))
    return recommendation_id_rule(r.select("report_id", "year", "recommendation", key.alias("recommendation_id")))


def q_eligibility(spark, d):
    return _reports(spark, d).select(
        "report_id",
        eligibility(
            F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("text")),
            F.col("agency"),
            F.col("investigation_type"),
            F.col("doc_id") % 2 == 0,
        ).alias("reason"),
    )


def q_regex_filter(spark, d):
    return _reports(spark, d).filter(F.rlike("agency_id", F.lit(r"^R-\d{4}-\d{1,3}$"))).select("report_id", "agency_id")


def q_drop_repeated_text(spark, d):
    return drop_repeated(view(spark, d, "lines").select("report_id", "pos", "line"), "line").select("report_id", "pos", "line")


def q_log_range(spark, d):
    e = table(spark, d, "events")
    low, high = F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return e.filter(F.col("ts").between(low, high) & ~F.col("user_id").isin(1, 2, 3)).select("event_id", "user_id", "event_type")


def q_dropna_subset(spark, d):
    return _reports(spark, d).select("report_id", "investigation_type", "event_type", "year").dropna(subset=["investigation_type", "event_type"])


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_R = "reports"
ORACLES = {
    "derive_report_keys": with_views("""SELECT report_id, split_part(report_id, '_', 1) AS agency, split_part(report_id, '_', 2) AS mode_char, TRY_CAST(split_part(report_id, '_',
3) AS INT) AS year FROM reports""", _R),
    "mode_from_id": with_views("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2010_' || lpad(CAST(doc_id % 400 AS VARCHAR), 3, '0')
ELSE report_id END AS report_id FROM reports)
SELECT doc_id, report_id, CAST(CASE regexp_extract(report_id, '_([amr])_', 1) WHEN 'a' THEN 0 WHEN 'r' THEN 1 WHEN 'm' THEN 2 ELSE CASE
WHEN regexp_extract(report_id, '[0-9]{4}_([0-9])[0-9]{2}', 1) IN ('0', '1', '2') THEN CAST(regexp_extract(report_id,
'[0-9]{4}_([0-9])[0-9]{2}', 1) AS INT) END END AS INT) AS mode FROM s""", _R),
    "mode_label": with_views("SELECT report_id, CASE mode WHEN '0' THEN 'Aviation' WHEN '1' THEN 'Rail' WHEN '2' THEN 'Marine' END AS mode_label FROM reports", _R),
    "document_schema_union": with_views("""SELECT safety_issue AS document, concat_ws('_', safety_issue_id, 'si', report_id) AS document_id, report_id, 'safety_issue' AS document_type
FROM issues
UNION ALL SELECT recommendation, concat_ws('_', recommendation_id, 'rec', report_id), report_id, 'recommendation' FROM recommendations
UNION ALL SELECT line, concat_ws('_', CAST(pos AS VARCHAR), 'sec', report_id), report_id, 'section' FROM lines
UNION ALL SELECT text, concat_ws('_', 'sum', report_id), report_id, 'summary' FROM reports""", "issues", "recommendations", _R),
    "concat_text": with_views("SELECT report_id, concat_ws(chr(10), event_type, agency_id) AS title_text FROM reports", _R),
    "id_prefix": with_views("SELECT report_id, array_to_string(string_split(agency_id, '-')[1:3], '-') AS prefix FROM reports", _R),
    "result_clean": with_views("""SELECT report_id, document_type, CASE mode WHEN '0' THEN 'Aviation' WHEN '1' THEN 'Rail' WHEN '2' THEN 'Marine' END AS mode_label,
printf('%.4f', CAST(embedding[1] AS DOUBLE) / 2 + 0.5) AS relevance, CASE WHEN length(document) < 1200 THEN document ELSE substr(document,
1, 1200) || '...' END AS document FROM vectors""", "vectors"),
    "investigation_type": with_views("""SELECT report_id, CASE WHEN doc_id % 5 IN (0, 1) OR doc_id % 6 BETWEEN 1 AND 3 THEN 'full' WHEN doc_id % 5 > 2 THEN 'unknown'
ELSE 'short' END AS type FROM reports""", _R),
    "toc_hierarchy": with_views("""SELECT report_id, string_agg(repeat('- - ', CAST(pos % 3 AS INT)) || line || ' ' || CASE WHEN pos % 4 = 0 THEN '0'
ELSE CAST(pos AS VARCHAR) END, chr(10) ORDER BY pos) AS toc FROM lines GROUP BY report_id""", "lines"),
    "summary_nullify": with_views("""WITH s AS (SELECT report_id, CASE WHEN doc_id % 3 = 0 THEN '[' || text ELSE text END AS t FROM reports) SELECT report_id, CAST(CASE
WHEN length(t) < 200 OR (starts_with(t, '[') AND length(t) < 500) THEN -1 ELSE length(t) END AS BIGINT) AS summary_length FROM s""", _R),
    "explode_nested": with_views("""WITH n AS (SELECT report_id, list({'safety_issue_id': safety_issue_id, 'safety_issue': safety_issue, 'quality': quality}) AS s FROM issues
GROUP BY report_id) SELECT report_id, x.safety_issue_id, x.safety_issue, x.quality FROM (SELECT report_id, unnest(s) AS x FROM n)""", "issues"),
    "infer_type": with_views("""SELECT report_id, CASE WHEN investigation_type IS DISTINCT FROM 'unknown' THEN investigation_type WHEN doc_id % 3 = 0 THEN 'full'
WHEN length(text) * 10 < 40000 THEN 'short' ELSE 'full' END AS type FROM reports""", _R),
    "build_url": with_views("""SELECT report_id, CASE WHEN agency = 'TSB' THEN lower('https://reports.example/' || agency || '/report/' || agency_id)
ELSE 'https://reports.example/' || agency || '/report/' || agency_id END AS url FROM reports""", _R),
    "search_filter": with_views("""SELECT vec_id, report_id, year, document_type, mode, agency FROM vectors WHERE year BETWEEN 2003 AND 2018
AND document_type IN ('safety_issue', 'section') AND mode IN ('0', '2') AND agency IN ('TAIC', 'TSB')""", "vectors"),
    "relevance_cutoff": with_views("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS score FROM vectors WHERE CAST(embedding[1] AS DOUBLE) > 0.1", "vectors"),
    "valid_ids": with_views("SELECT doc_id, report_id FROM reports WHERE doc_id % 7 > 1", _R),
    "not_short_nullsafe": with_views("SELECT report_id, investigation_type FROM reports WHERE investigation_type IS DISTINCT FROM 'short'", _R),
    "clean_documents": with_views("""SELECT DISTINCT report_id AS document_id, line AS document FROM lines WHERE doc_id % 9 <> 0 AND pos % 8 < 6 AND regexp_replace(line,
'^\\s+|\\s+$', '', 'g') <> ''""", "lines"),
    "token_gate": with_views("""WITH t AS (SELECT report_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS n_tokens
FROM reports) SELECT * FROM t WHERE n_tokens < 400""", _R),
    "drop_noise_sections": with_views("""WITH s AS (SELECT report_id, pos, CASE pos % 9 WHEN 0 THEN 'Source: page ' || pos WHEN 1 THEN '<< Page 3 >> ' || line
WHEN 2 THEN 'ANNEX A' || chr(10) || line ELSE line END AS s FROM lines) SELECT report_id, pos, CAST(length(s) AS BIGINT) AS n_chars FROM s
WHERE NOT (regexp_matches(s, '\\A(Source:|©) [A-Za-z0-9_\\s]+\\z') OR (regexp_matches(s, '\\A(<< Page [0-9]+ >>|[A-Z ]+(\\n|\\z))')
AND length(s) < 250))""", "lines"),
    "status_filter": "SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 1995",
    "embedded_year": with_views("SELECT report_id, CAST(year % 100 AS INT) AS yy FROM reports WHERE year % 100 BETWEEN 0 AND 15", _R),
    "recommendation_id_rule": with_views("""WITH r AS (SELECT report_id, CAST(split_part(report_id, '_', 3) AS INT) AS year, recommendation, recommendation_id AS k
FROM recommendations),
s AS (SELECT report_id, year, recommendation, CASE WHEN year % 3 = 0 THEN NULL WHEN CAST(regexp_extract(k, '([0-9]+)$',
1) AS INT) % 3 = 0 THEN '' ELSE k END AS recommendation_id FROM r),
m AS (SELECT *, year > 2010 OR count(recommendation_id) OVER (PARTITION BY report_id) > 0 AS must FROM s)
SELECT report_id, year, recommendation, recommendation_id FROM m WHERE NOT must OR coalesce(recommendation_id, '') <> ''""", "recommendations"),
    "eligibility": with_views("""SELECT report_id, CASE WHEN doc_id % 10 = 0 OR length(text) < 100 THEN 'no text' WHEN agency = 'ATSB' THEN 'from website'
WHEN agency = 'TAIC' THEN 'extract' WHEN investigation_type IS NOT DISTINCT FROM 'unknown' AND doc_id % 2 = 0
AND length(text) < 40000 THEN 'short unknown' ELSE 'extract' END AS reason FROM reports""", _R),
    "regex_filter": with_views("SELECT report_id, agency_id FROM reports WHERE regexp_matches(agency_id, '^R-[0-9]{4}-[0-9]{1,3}$')", _R),
    "drop_repeated_text": with_views("SELECT report_id, pos, line FROM (SELECT *, count(*) OVER (PARTITION BY line) AS n FROM lines) WHERE n <= 3", "lines"),
    "log_range": """SELECT event_id, user_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' AND user_id NOT IN (1,
2, 3)""",
    "dropna_subset": with_views("SELECT report_id, investigation_type, event_type, year FROM reports WHERE investigation_type IS NOT NULL AND event_type IS NOT NULL", _R),
}
