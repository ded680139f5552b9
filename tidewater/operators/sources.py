"""Scans, listings, logs and exports."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.documents import column_udf
from tidewater.sources.fixtures import table, view, with_views


def stage_table(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """A stage's table, or an empty one of its schema where it isn't there; a required one raises."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], schema)


def event_types(spark: SparkSession, path: str) -> DataFrame:
    """The reference list of event types, from CSV with quoted commas."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("Value string, mode string").csv(path)


def latest_version(listing: DataFrame, path: str = "path") -> DataFrame:
    """The path whose top folder, a time like 2024-01-31_12:00:00, is the latest; others are ignored."""
    at = F.try_to_timestamp(F.split_part(path, F.lit("/"), F.lit(1)), F.lit("yyyy-MM-dd_HH:mm:ss"))
    return listing.withColumn("_at", at).filter(F.col("_at").isNotNull()).agg(F.max_by(F.split_part(path, F.lit("/"), F.lit(1)), "_at").alias("version"))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = [dict(attrs).get("href"), ""]

    def handle_data(self, data):
        if self.open:
            self.open[1] += data

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.links.append({"href": self.open[0], "text": self.open[1].strip()})
            self.open = None


@column_udf("array<struct<href:string,text:string>>")
def html_links(htmls: pd.Series) -> pd.Series:
    """The links of each page, in order."""
    out = []
    for h in htmls:
        parser = _Links()
        parser.feed(h or "")
        parser.close()
        out.append(parser.links)
    return pd.Series(out, dtype=object)


def q_scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


def q_scan_event_types(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("Value"), (F.col("p_size") % 3).cast("string").alias("mode")).distinct()


def q_html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.inline(html_links("html")))


def q_page_metadata(spark, d):
    get = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return table(spark, d, "pages").select(
        "page_id",
        get("(?s)<title>(.*?)</title>").alias("title"),
        get('<html lang="([a-z]+)"').alias("lang"),
        get("(?s)<h1>(.*?)</h1>").alias("h1"),
    )


def q_latest_version(spark, d):
    listing = table(spark, d, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd_HH:mm:ss"), F.lit("/table.parquet")).alias("path"))
    return latest_version(listing)


def q_result_log_json(spark, d):
    v = view(spark, d, "vectors").select(
        "agency",
        "vec_id",
        "report_id",
        F.round(F.element_at("embedding", 1).cast("double"), 6).cast("decimal(10,6)").alias("relevance"),
    )
    top = v.withColumn("rank", F.row_number().over(Window.partitionBy("agency").orderBy(F.desc("relevance"), "vec_id"))).filter("rank <= 100")
    return top.groupBy("agency").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "report_id", "relevance")))).alias("results"))


def q_chat_jsonl(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return c.select(
        "conv_id",
        F.to_json(
            F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")),
        ).alias("line"),
    )


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "scan_documents": "SELECT doc_id, lang, source, n_chars FROM documents",
    "scan_event_types": "SELECT DISTINCT p_type AS \"Value\", CAST(p_size % 3 AS VARCHAR) AS mode FROM part",
    "page_metadata": """SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html,
'<html lang=\"([a-z]+)\"', 1), '') AS lang, nullif(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '') AS h1 FROM pages""",
    "latest_version": "SELECT strftime(max(o_orderdate), '%Y-%m-%d_%H:%M:%S') AS version FROM orders",
    "result_log_json": with_views("""WITH v AS (SELECT agency, vec_id, report_id, CAST(round(CAST(embedding[1] AS DOUBLE), 6) AS DECIMAL(10, 6)) AS relevance FROM vectors), r
AS (SELECT *, row_number() OVER (PARTITION BY agency ORDER BY relevance DESC, vec_id) AS rank FROM v) SELECT agency,
'[' || string_agg('{\"rank\":' || rank || ',\"vec_id\":' || vec_id || ',\"report_id\":\"' || report_id || '\",\"relevance\":' || relevance || '}',
',' ORDER BY rank) || ']' AS results FROM r WHERE rank <= 100 GROUP BY agency""", "vectors"),
    "chat_jsonl": """SELECT conv_id,
'{\"messages\":[' || string_agg('{\"role\":\"' || role || '\",\"content\":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY turn) || ']}' AS line
FROM conversations GROUP BY conv_id""",
    "html_links": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href, unnest(regexp_extract_all(html,
'<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS text FROM pages) SELECT * FROM l""",
}
