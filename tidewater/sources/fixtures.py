"""Report-shaped views over the plain tables, each in Spark and in SQL.

The report collections that this engine is for aren't public tables, so queries run on views that
give the generic tables the shape of reports, sections, issues, recommendations, replies and logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AGENCIES = ("TAIC", "ATSB", "TSB")
MODES = ("a", "r", "m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: view -> (Spark SQL select, DuckDB select); `{x}` names another view.
_VIEWS: dict[str, tuple[str, str]] = {}


def _same(name: str, sql: str) -> None:
    _VIEWS[name] = (sql, sql)


_same(
    "reports",
    """SELECT doc_id, text, source, lang,
  concat_ws('_', CASE doc_id % 3 WHEN 0 THEN 'TAIC' WHEN 1 THEN 'ATSB' ELSE 'TSB' END, CASE CAST(floor(doc_id / 3) AS BIGINT) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'r' ELSE 'm' END, CAST(2000 + doc_id % 25 AS VARCHAR(4)), lpad(CAST(doc_id AS VARCHAR(20)), 6, '0')) AS report_id,
  CASE doc_id % 3 WHEN 0 THEN 'TAIC' WHEN 1 THEN 'ATSB' ELSE 'TSB' END AS agency,
  CAST(CAST(floor(doc_id / 3) AS BIGINT) % 3 AS VARCHAR(1)) AS mode,
  CAST(2000 + doc_id % 25 AS INT) AS year,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'short' WHEN 2 THEN 'full' ELSE 'unknown' END AS investigation_type,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('type ', CAST(doc_id % 11 AS VARCHAR(2))) END AS event_type,
  concat('R-', CAST(2000 + doc_id % 25 AS VARCHAR(4)), '-', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 5 = 0 THEN '-rev' ELSE '' END) AS agency_id
FROM documents""",
)
_VIEWS["lines"] = (
    "SELECT doc_id, report_id, CAST(pos AS INT) AS pos, line FROM (SELECT doc_id, report_id, posexplode(split(text, '\\n')) AS (pos, line) FROM {reports})",
    "SELECT doc_id, report_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS pos, unnest(string_split(text, chr(10))) AS line FROM {reports}",
)
#: Paragraphs with a page marker before every fifth.
_same(
    "paragraphs",
    "SELECT doc_id, report_id, pos, line, CASE WHEN pos % 5 = 2 THEN CAST(CAST(floor(pos / 5) AS BIGINT) + 1 AS VARCHAR(10)) END AS page FROM {lines}",
)
_same("bounds", "SELECT doc_id, report_id, max(pos) AS last_pos FROM {lines} GROUP BY doc_id, report_id")
_same(
    "issues",
    "SELECT report_id, CAST(pos AS VARCHAR(10)) AS safety_issue_id, line AS safety_issue, CASE WHEN pos = 0 THEN 'exact' ELSE 'inferred' END AS quality FROM {lines} WHERE pos <= 1",
)
_same(
    "recommendations",
    """SELECT l.report_id, concat(l.report_id, '_rec_', CAST(l.pos AS VARCHAR(10))) AS recommendation_id, l.line AS recommendation, concat('agency ', CAST(l.pos % 4 AS VARCHAR(2))) AS recipient,
  CASE WHEN l.pos % 3 = 0 THEN NULL ELSE concat('20', lpad(CAST(l.pos % 25 AS VARCHAR(2)), 2, '0'), '-01-15') END AS made
FROM {lines} l JOIN {bounds} b ON l.report_id = b.report_id WHERE l.pos >= b.last_pos - 1""",
)
_same(
    "vectors",
    "SELECT e.vec_id, e.embedding, r.report_id, r.agency, r.mode, r.year, r.event_type, CASE e.label % 4 WHEN 0 THEN 'safety_issue' WHEN 1 THEN 'recommendation' WHEN 2 THEN 'section' ELSE 'summary' END AS document_type, r.text AS document FROM embeddings e JOIN {reports} r ON e.vec_id = r.doc_id",
)
#: Every report's words, once per place.
_VIEWS["terms"] = (
    "SELECT doc_id, explode(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS term FROM documents",
    "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents",
)
_same(
    "replies",
    "SELECT u.conv_id, u.turn, u.text AS recommendation, a.text AS reply_text FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'",
)


def _closure(names: list[str], dialect: int, done: dict[str, str]) -> None:
    import re

    for name in names:
        if name not in done:
            sql = _VIEWS[name][dialect]
            _closure(re.findall(r"\{(\w+)\}", sql), dialect, done)
            done[name] = re.sub(r"\{(\w+)\}", r"\1", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A report-shaped view as a DataFrame; only the tables that it names are read. The session's own
    tables and views are left alone: the plain tables go by names of the library's."""
    import re

    views: dict[str, str] = {}
    _closure([name], 0, views)
    for plain in ("documents", "embeddings", "conversations"):
        if any(re.search(rf"\b{plain}\b", sql) for sql in views.values()):
            table(spark, sf_dir, plain).createOrReplaceTempView(f"_tidewater_{plain}")
            views = {k: re.sub(rf"\b{plain}\b", f"_tidewater_{plain}", sql) for k, sql in views.items()}
    with_ = ", ".join(f"{k} AS ({v})" for k, v in views.items())
    return spark.sql(f"WITH {with_} SELECT * FROM {name}")


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views in front of a query that starts with SELECT or more CTEs."""
    views: dict[str, str] = {}
    _closure(list(names), 1, views)
    head = "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in views.items())
    body = sql.strip()
    return f"{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"{head} {body}"
