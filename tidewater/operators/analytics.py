"""Aggregations, ordered-sequence operators and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators.joins import link_label, worded_pairs
from tidewater.plans.shared import shared_path
from tidewater.sources.fixtures import table, view, with_views


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of each known value, most first."""
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def top_with_others(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n commonest values (ties by name) and the sum of the rest as `Others`, which is always there."""
    counts = rows.dropna(subset=[key]).groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(n)
    rest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).join(top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top")), F.lit(True))
    return top.unionByName(rest.select(F.lit("Others").alias(key), (F.col("all") - F.col("top")).alias("n")))


#: Slices of a group's range of values in which quantiles are sought.
SLICES = 4096


def quantiles_by(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column for each name of `shares`): exact quantiles, linear between neighbours.

    Values are counted; a group's range is cut into slices, whose sums tell in which ones the wanted
    places lie; only their values are put in order. So no task holds or sorts a whole group."""
    return _quantiles(_counted(rows, key, value), key, shares)


def _counted(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, _v, _n): how often each value occurs, null too; written once, since several passes go over it."""
    counted = rows.groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    path = shared_path(rows.sparkSession, "counted")
    counted.write.parquet(path)
    return rows.sparkSession.read.schema(counted.schema).parquet(path)


def _quantiles(counted: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    counted = counted.filter(F.col("_v").isNotNull())
    ends = counted.groupBy(key).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("_all"))
    at = F.when(
        F.col("_high") > F.col("_low"),
        F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (SLICES - 1)),
    ).otherwise(0).cast("int")
    sliced = counted.join(ends, key).withColumn("_slice", at)
    sums = sliced.groupBy(key, "_slice", "_all").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("share")) for n, p in shares.items()])
    place = sums.select(key, "_slice", "_n", "_before", F.explode(names).alias("q"), "_all").withColumn("_at", F.col("q.share") * (F.col("_all") - 1))
    sides = place.select(
        key,
        "_slice",
        "_n",
        "_before",
        F.col("q.name").alias("name"),
        "_at",
        F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"),
    )
    wanted = sides.filter(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")),
    ).select(key, "_slice", "_before", "name", "_at", "_rank")
    inner = Window.partitionBy(key, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    some = sliced.join(wanted.select(key, "_slice").distinct(), [key, "_slice"], "left_semi")
    placed = some.withColumn("_inside", F.coalesce(F.sum("_n").over(inner), F.lit(0))).select(key, "_slice", "_v", "_inside", F.col("_n").alias("_many"))
    hit = wanted.join(placed, [key, "_slice"]).filter(
        (F.col("_rank") - F.col("_before") >= F.col("_inside")) & (F.col("_rank") - F.col("_before") < F.col("_inside") + F.col("_many")),
    )
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    found = hit.groupBy(key, "name").agg((low + (high - low) * (F.first("_at") - F.floor(F.first("_at")))).alias("_q"))
    return found.groupBy(key).pivot("name", list(shares)).agg(F.first("_q"))


def describe_by(rows: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    """count, mean, std, min, quartiles and max of each group. The rows are read once, to count their values."""
    counted = _counted(rows, key, value)
    n = F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0))
    mean = F.when(n > 0, F.sum(F.col("_v") * F.col("_n")) / n)
    plain = counted.groupBy(key).agg(n.alias("n"), mean.alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    off = F.col("_v") - F.col("mean")
    spread = counted.join(plain, key).groupBy(key).agg(F.sum(F.col("_n") * off * off).alias("_squares"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_squares") / (F.col("n") - 1)))
    q = _quantiles(counted, key, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    rounded = [F.round(x, digits).alias(n) for n, x in (("mean", F.col("mean")), ("std", std))]
    return plain.join(spread, key, "left").join(q, key, "left").select(key, "n", *rounded, "min", *[F.round(p, digits).alias(p) for p in ("p25", "p50", "p75")], "max")


def fill_pages(paragraphs: DataFrame, key: str = "report_id", page: str = "page", order: str = "pos") -> DataFrame:
    """Each paragraph takes the last page label up to it; before the first label it is 0."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn(page, F.coalesce(F.last(page, ignorenulls=True).over(w), F.lit("0")))


def number_paragraphs(paragraphs: DataFrame, key: str = "report_id", order: str = "pos") -> DataFrame:
    """Paragraph ids `p<page>.<n>` with n counted from 0 on each page label."""
    w = Window.partitionBy(key, "page").orderBy(order)
    return paragraphs.withColumn("section", F.concat(F.lit("p"), "page", F.lit("."), (F.row_number().over(w) - 1).cast("string")))


def merge_small(sections: DataFrame, key: str = "report_id", order: str = "pos", body: str = "line", least: int = 1000) -> DataFrame:
    """Neighbouring sections joined by a line break until they hold `least` characters; the id is
    `first-last`. The fold runs within one report's array."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("pos"), F.col(body).alias("body"))))
    empty = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(None).cast("string").alias("text"))
    start = F.struct(F.array().cast("array<struct<first:int,last:int,text:string>>").alias("done"), empty.alias("open"))

    def step(acc: Column, x: Column) -> Column:
        o = acc["open"]
        add = F.struct(
            F.coalesce(o["first"], x["pos"]).alias("first"),
            x["pos"].alias("last"),
            F.when(o["text"].isNull(), x["body"]).otherwise(F.concat(o["text"], F.lit("\n"), x["body"])).alias("text"),
        )
        new = F.struct(x["pos"].alias("first"), x["pos"].alias("last"), x["body"].alias("text"))
        full = o["text"].isNotNull() & (F.length(o["text"]) >= least)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(o))).otherwise(acc["done"]).alias("done"), F.when(full, new).otherwise(add).alias("open"))

    end = lambda acc: F.when(acc["open"]["text"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
    chunks = sections.groupBy(key).agg(ordered.alias("_s")).select(key, F.explode(F.aggregate("_s", start, step, end)).alias("_c"))
    return chunks.select(
        key,
        F.concat_ws("-", F.col("_c.first").cast("string"), F.col("_c.last").cast("string")).alias("section"),
        F.col("_c.text").alias("section_text"),
    )


def top_per_group(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; groups are limited before and after the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)


def minmax(rows: DataFrame, value: str) -> DataFrame:
    """Adds `scaled`: the value between the least (0) and the greatest (1); 0 where all are equal."""
    ends = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.col("_high") - F.col("_low")
    return rows.join(F.broadcast(ends), F.lit(True)).withColumn(
        "scaled",
        F.when(span == 0, 0.0).otherwise((F.col(value) - F.col("_low")) / span),
    ).drop("_low", "_high")


def missing_sections(sections: DataFrame, key: str = "report_id") -> DataFrame:
    """Section numbers (major, minor) absent between two neighbours that are present, and each
    report's share of them. Minors run on within a major."""
    w = Window.partitionBy(key, "major").orderBy("minor")
    gaps = sections.withColumn("next", F.lead("minor").over(w)).withColumn("gap", F.coalesce(F.col("next") - F.col("minor") - 1, F.lit(0)))
    return gaps.groupBy(key).agg(F.sum("gap").alias("n_missing"), F.round(F.sum("gap") / (F.sum("gap") + F.count("*")), 6).alias("share"))


def ndcg(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """Discounted gain of relevant ranks over that of all ranks: (query, rank, relevant)."""
    gain = 1 / F.log2(F.col("rank") + 1)
    return ranked.groupBy(key).agg(F.round(F.sum(F.when(F.col("relevant"), gain).otherwise(0.0)) / F.sum(gain), 6).alias("ndcg"))


def _lengths(spark, d) -> DataFrame:
    return view(spark, d, "reports").withColumn("n_chars", F.length("text"))


def q_count_by_document_type(spark, d):
    return count_by(view(spark, d, "vectors"), "document_type")


def q_count_by_mode(spark, d):
    return count_by(view(spark, d, "reports"), "mode")


def q_count_by_agency(spark, d):
    return count_by(view(spark, d, "reports"), "agency")


def q_year_histogram(spark, d):
    return count_by(view(spark, d, "reports"), "year")


def q_top5_others(spark, d):
    return top_with_others(view(spark, d, "reports"), "event_type")


def q_result_summary(spark, d):
    return view(spark, d, "vectors").agg(F.count("*").alias("n_rows"), F.countDistinct("report_id").alias("n_reports"))


def q_nest_by_report(spark, d):
    nested = F.array_sort(F.collect_list(F.struct("safety_issue_id", "quality")))
    return view(spark, d, "issues").groupBy("report_id").agg(nested.alias("n")).select(
        "report_id",
        F.size("n").cast("long").alias("n_issues"),
        F.array_join(F.transform("n", lambda x: F.concat_ws(":", x["safety_issue_id"], x["quality"])), ",").alias("issues"),
    )


def q_section_length_stats(spark, d):
    n = F.length("line")
    return view(spark, d, "lines").groupBy("report_id").agg(
        F.count("*").alias("n_sections"),
        F.sum(n).alias("total"),
        F.round(F.sum(n) / F.count("*"), 6).alias("mean"),
    )


def q_token_totals(spark, d):
    return view(spark, d, "reports").groupBy("agency").agg(F.sum(text.word_count(F.col("text"))).alias("n_tokens"))


def q_describe_by_group(spark, d):
    return describe_by(_lengths(spark, d), "agency", "n_chars")


def q_pipeline_funnel(spark, d):
    r = view(spark, d, "reports")
    issues = view(spark, d, "issues").filter(F.length("safety_issue") > 100).select("report_id").distinct().withColumn("i", F.lit(1))
    recs = view(spark, d, "recommendations").filter(F.length("recommendation") > 100).select("report_id").distinct().withColumn("r", F.lit(1))
    flags = r.join(issues, "report_id", "left").join(recs, "report_id", "left").agg(
        F.count("*").alias("a"),
        F.sum(F.col("event_type").isNotNull().cast("int")).alias("b"),
        F.count("i").alias("c"),
        F.count("r").alias("e"),
    )
    return flags.select(F.expr("stack(4, 'reports', a, 0L, 'typed', b, a - b, 'issues', c, b - c, 'recommendations', e, c - e) AS (stage, n, dropped)"))


def q_count_year_agency_mode(spark, d):
    return count_by(view(spark, d, "reports"), "year", "agency", "mode")


def q_accuracy(spark, d):
    guess = F.when(F.rlike("text", F.lit(r"[|#$%&*!]{1}[|#$%&*!]")) | F.contains("text", F.lit(" | ")), 0).otherwise(1)
    both = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", guess.alias("guess"))
    return both.agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("guess")).cast("int")), 6).alias("accuracy"))


def q_change_counts(spark, d):
    low = lambda c: F.lower(F.when(F.col(c) == 1, "High").otherwise("low"))
    labels = table(spark, d, "labels")
    return labels.groupBy(F.concat_ws(" -> ", low("quality"), low("toxic")).alias("change")).agg(F.count("*").alias("n"))


def _links(spark, d) -> DataFrame:
    pairs = worded_pairs(view(spark, d, "recommendations"), view(spark, d, "issues"))
    return pairs.select("report_id", "recommendation_id", "safety_issue_id", link_label(F.col("score")).alias("link"))


def q_link_summary(spark, d):
    is_ = lambda x: F.round(F.avg((F.col("link") == x).cast("int")), 6)
    return _links(spark, d).agg(
        F.countDistinct("recommendation_id").alias("n_recommendations"),
        F.countDistinct("report_id", "safety_issue_id").alias("n_issues"),
        F.countDistinct("report_id").alias("n_reports"),
        F.round(F.countDistinct("recommendation_id") / F.countDistinct("report_id"), 6).alias("per_report"),
        is_("Confirmed").alias("confirmed"),
        is_("Possible").alias("possible"),
        is_("None").alias("none"),
    )


def q_ratio_by_year(spark, d):
    year = F.split_part("report_id", F.lit("_"), F.lit(3)).cast("int")
    recs = view(spark, d, "recommendations").groupBy(year.alias("year")).agg(F.count("*").alias("n_recommendations"))
    reps = view(spark, d, "reports").groupBy("year").agg(F.count("*").alias("n_reports"))
    return reps.join(recs, "year").select("year", "n_reports", "n_recommendations", F.round(F.col("n_recommendations") / F.col("n_reports"), 6).alias("ratio"))


def _scored(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("score"))


def q_report_relevance(spark, d):
    top = top_per_group(_scored(spark, d), "label", 50, F.desc("score"), F.col("vec_id"))
    return top.groupBy("label").agg(F.round(F.avg("score"), 6).alias("relevance"))


def q_collapse_expand(spark, d):
    lists = view(spark, d, "lines").groupBy("report_id").agg(F.collect_set("line").alias("lines"))
    return lists.select("report_id", F.explode("lines").alias("line"))


def q_split_balance(spark, d):
    split = F.when(F.col("doc_id") % 5 < 3, "train").when(F.col("doc_id") % 5 == 3, "validation").otherwise("test")
    return view(spark, d, "reports").groupBy(split.alias("split"), "mode").agg(F.count("*").alias("n"))


def q_split_60_20_20(spark, d):
    split = F.when(F.col("doc_id") % 5 < 3, "train").when(F.col("doc_id") % 5 == 3, "validation").otherwise("test")
    return view(spark, d, "reports").select("report_id", split.alias("split"))


def q_valid_rate(spark, d):
    return view(spark, d, "paragraphs").groupBy("report_id").agg(F.round(F.avg(F.col("page").isNotNull().cast("int")), 6).alias("valid_rate"))


def q_searches_per_user(spark, d):
    return count_by(table(spark, d, "events"), "user_id")


def q_share_under_limit(spark, d):
    n = text.word_count(F.col("text"))
    return view(spark, d, "reports").agg(F.round(F.avg((n < 300).cast("int")), 6).alias("share"), F.sum(n).alias("total"))


def q_token_cost(spark, d):
    return view(spark, d, "reports").groupBy("agency").agg(F.round(F.sum(text.word_count(F.col("text"))) * 2.5 / 1e6, 8).alias("cost"))


def q_page_ffill(spark, d):
    return fill_pages(view(spark, d, "paragraphs")).select("report_id", "pos", "page")


def q_paragraph_number(spark, d):
    return number_paragraphs(fill_pages(view(spark, d, "paragraphs"))).select("report_id", "pos", "section")


def q_merge_small_sections(spark, d):
    return merge_small(view(spark, d, "lines"))


def first_ranks(rows: DataFrame, key: str, member: str, *order: Column) -> DataFrame:
    """(key, member, first_rank): the place of each member's first row among the rows of its key.

    The rows are dealt out by ranges of key and order and numbered where they lie. A key's rows in the
    ranges before, a count for each key and range, are added. So a key of any size is spread over tasks,
    and what is written is one row for each member and range."""
    names = [f"_o{k}" for k in range(len(order))]
    dealt = rows.select(key, member, *[o.alias(n) for o, n in zip(order, names, strict=True)]).repartitionByRange(key, *names).sortWithinPartitions(key, *names)
    # The number's upper bits are the range, its lower 33 the place within.
    placed = dealt.select(key, member, F.monotonically_increasing_id().alias("_at"))
    met = placed.groupBy(key, member, F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    path = shared_path(rows.sparkSession, "first-places")
    met.write.parquet(path)
    met = rows.sparkSession.read.schema(met.schema).parquet(path)
    ranges = met.groupBy(key, "_range").agg(F.min("_first").alias("_start"), F.sum("_n").alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    firsts = met.groupBy(key, member).agg(F.min("_first").alias("_first")).withColumn("_range", F.shiftright("_first", 33))
    found = firsts.join(ranges, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return found.select(key, member, (F.col("_before") + F.col("_first") - F.col("_start") + 1).cast("int").alias("first_rank"))


def q_first_rank(spark, d):
    rows = _scored(spark, d).select(F.col("label").alias("query_id"), (F.col("vec_id") % 40).alias("report"), "score", "vec_id")
    return first_ranks(rows, "query_id", "report", -F.col("score"), F.col("vec_id"))


def q_topn_per_group(spark, d):
    return top_per_group(_scored(spark, d), "label", 10, F.desc("score"), F.col("vec_id")).select("label", "vec_id", "rank")


def q_minmax_score(spark, d):
    return minmax(_scored(spark, d), "score").select("vec_id", F.round("scaled", 6).alias("scaled"))


def q_missing_sections(spark, d):
    s = view(spark, d, "lines").filter(F.length("line") > 80).select(
        "report_id",
        F.floor(F.col("pos") / 6).cast("int").alias("major"),
        (F.col("pos") % 6).alias("minor"),
    )
    return missing_sections(s)


def q_cap_per_year(spark, d):
    r = view(spark, d, "reports").withColumn("g", F.concat_ws("/", "mode", F.col("year").cast("string")))
    return top_per_group(r, "g", 5, F.col("report_id")).select("report_id", "mode", "year")


def q_sort_relevance(spark, d):
    return _scored(spark, d).orderBy(F.desc("score"), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def q_ndcg(spark, d):
    ranked = top_per_group(_scored(spark, d), "label", 100, F.desc("score"), F.col("vec_id"))
    return ndcg(ranked.select(F.col("label").alias("query_id"), "rank", (F.col("vec_id") % 3 == 0).alias("relevant")))


def recall(ranked: DataFrame, expected: DataFrame, key: str, item: str) -> DataFrame:
    """(key, recall): the share of expected rows (key, item) that are among the ranked ones."""
    hits = expected.join(ranked.select(key, item).distinct(), [key, item], "left_semi").groupBy(key).agg(F.count("*").alias("_hits"))
    return expected.groupBy(key).agg(F.count("*").alias("_all")).join(hits, key, "left").select(
        key,
        F.round(F.coalesce("_hits", F.lit(0)) / F.col("_all"), 6).alias("recall"),
    )


def q_recall_at_k(spark, d):
    top = top_per_group(_scored(spark, d), "label", 20, F.desc("score"), F.col("vec_id"))
    return recall(top, _scored(spark, d).filter("score > 0.2").select("label", "vec_id"), "label", "vec_id")


def ndcg_standard(ranked: DataFrame, relevant: DataFrame, most: int, key: str = "query_id") -> DataFrame:
    """Discounted gain of relevant ranks over the best that (query, n) relevant rows allow in `most` ranks."""
    got = ranked.groupBy(key).agg(F.sum(F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_got"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(most)).cast("int")), F.lit(0.0), lambda a, k: a + 1 / F.log2(k + 1))
    best = relevant.filter("n > 0").select(key, ideal.alias("_best"))
    return got.join(best, key).select(key, F.round(F.col("_got") / F.col("_best"), 6).alias("ndcg"))


def q_ndcg_standard(spark, d):
    ranked = top_per_group(_scored(spark, d), "label", 100, F.desc("score"), F.col("vec_id"))
    relevant = _scored(spark, d).filter("vec_id % 3 = 0").groupBy(F.col("label").alias("query_id")).agg(F.count("*").alias("n"))
    return ndcg_standard(ranked.select(F.col("label").alias("query_id"), "rank", (F.col("vec_id") % 3 == 0).alias("relevant")), relevant, 100)


def q_search_leaderboard(spark, d):
    scored = table(spark, d, "embeddings").select(
        "label",
        F.explode(
            F.arrays_zip(
                F.array(F.lit("first"), F.lit("second"), F.lit("third")).alias("f"),
                F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("x"),
            ),
        ).alias("z"),
    ).select("label", "z.f", "z.x")
    means = scored.groupBy("label", "f").agg(F.round(F.avg("x"), 6).alias("mean"))
    return means.groupBy("label").agg(F.max_by("f", F.struct("mean", "f")).alias("best"), F.max("mean").alias("mean"))


def q_jaccard(spark, d):
    pairs = worded_pairs(view(spark, d, "recommendations"), view(spark, d, "issues"))
    return pairs.select("recommendation_id", "safety_issue_id", F.round("score", 6).alias("jaccard"))


def q_manhattan(spark, d):
    e = table(spark, d, "embeddings")
    centre = e.groupBy("label").agg(F.array(*[F.avg(F.element_at("embedding", k + 1).cast("double")) for k in range(64)]).alias("c"))
    far = F.aggregate(F.zip_with("embedding", "c", lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    return e.join(F.broadcast(centre), "label").select("vec_id", F.round(far, 5).alias("distance"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_TOK = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z]+'), lambda w: w <> ''))"
_A, _B = _WORDS.format(c="recommendation"), _WORDS.format(c="safety_issue")
_SCORE = f"""CASE WHEN len(list_distinct(list_concat({_A}, {_B}))) = 0 THEN 0.0 ELSE CAST(len(list_intersect({_A},
{_B})) AS DOUBLE) / len(list_distinct(list_concat({_A}, {_B}))) END"""
_SC = "s AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings)"
_RK = f"{_SC}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)"
_R = "reports"
ORACLES = {
    "count_by_document_type": with_views("SELECT document_type, count(*) AS n FROM vectors GROUP BY ALL", "vectors"),
    "count_by_mode": with_views("SELECT mode, count(*) AS n FROM reports GROUP BY ALL", _R),
    "count_by_agency": with_views("SELECT agency, count(*) AS n FROM reports GROUP BY ALL", _R),
    "year_histogram": with_views("SELECT year, count(*) AS n FROM reports GROUP BY ALL", _R),
    "top5_others": with_views("""WITH c AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS k FROM reports
WHERE event_type IS NOT NULL GROUP BY event_type) SELECT event_type, n FROM c WHERE k <= 5 UNION ALL SELECT 'Others', CAST(coalesce(sum(n),
0) AS BIGINT) FROM c WHERE k > 5""", _R),
    "result_summary": with_views("SELECT count(*) AS n_rows, count(DISTINCT report_id) AS n_reports FROM vectors", "vectors"),
    "nest_by_report": with_views("""SELECT report_id, count(*) AS n_issues, string_agg(safety_issue_id || ':' || quality, ',' ORDER BY safety_issue_id, quality) AS issues
FROM issues GROUP BY report_id""", "issues"),
    "section_length_stats": with_views("""SELECT report_id, count(*) AS n_sections, CAST(sum(length(line)) AS BIGINT) AS total, round(CAST(sum(length(line)) AS DOUBLE) / count(*),
6) AS mean FROM lines GROUP BY report_id""", "lines"),
    "token_totals": with_views(f"SELECT agency, CAST(sum({_TOK}) AS BIGINT) AS n_tokens FROM reports GROUP BY agency", _R),
    "describe_by_group": with_views("""SELECT agency, count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 6) AS std,
CAST(min(length(text)) AS DOUBLE) AS min, round(quantile_cont(length(text), 0.25), 6) AS p25, round(quantile_cont(length(text), 0.5),
6) AS p50, round(quantile_cont(length(text), 0.75), 6) AS p75, CAST(max(length(text)) AS DOUBLE) AS max FROM reports GROUP BY agency""", _R),
    "pipeline_funnel": with_views("""WITH i AS (SELECT DISTINCT report_id FROM issues WHERE length(safety_issue) > 100), r AS (SELECT DISTINCT report_id FROM recommendations
WHERE length(recommendation) > 100), f AS (SELECT count(*) AS a, count(event_type) AS b, count(i.report_id) AS c, count(r.report_id) AS e
FROM reports LEFT JOIN i USING (report_id) LEFT JOIN r ON r.report_id = reports.report_id)
SELECT 'reports' AS stage, a AS n, 0 AS dropped FROM f UNION ALL SELECT 'typed', b, a - b FROM f UNION ALL SELECT 'issues', c, b - c FROM f
UNION ALL SELECT 'recommendations', e, c - e FROM f""", _R, "issues", "recommendations"),
    "count_year_agency_mode": with_views("SELECT year, agency, mode, count(*) AS n FROM reports GROUP BY ALL", _R),
    "accuracy": """SELECT count(*) AS n, round(avg(CASE WHEN quality = CASE WHEN regexp_matches(text, '[|#$%&*!][|#$%&*!]') OR contains(text, ' | ') THEN 0
ELSE 1 END THEN 1 ELSE 0 END), 6) AS accuracy FROM labels JOIN documents USING (doc_id)""",
    "change_counts": """SELECT CASE quality WHEN 1 THEN 'high' ELSE 'low' END || ' -> ' || CASE toxic WHEN 1 THEN 'high' ELSE 'low' END AS change, count(*) AS n
FROM labels GROUP BY ALL""",
    "link_summary": with_views(f"""WITH l AS (SELECT report_id, recommendation_id, safety_issue_id, CASE WHEN s >= 0.5 THEN 'Confirmed' WHEN s >= 0.15 THEN 'Possible'
ELSE 'None' END AS link FROM (SELECT report_id, recommendation_id, safety_issue_id, {_SCORE} AS s FROM recommendations
JOIN issues USING (report_id))) SELECT count(DISTINCT recommendation_id) AS n_recommendations, count(DISTINCT (report_id,
safety_issue_id)) AS n_issues, count(DISTINCT report_id) AS n_reports,
round(CAST(count(DISTINCT recommendation_id) AS DOUBLE) / count(DISTINCT report_id), 6) AS per_report, round(avg(CASE
WHEN link = 'Confirmed' THEN 1 ELSE 0 END), 6) AS confirmed, round(avg(CASE WHEN link = 'Possible' THEN 1 ELSE 0 END), 6) AS possible,
round(avg(CASE WHEN link = 'None' THEN 1 ELSE 0 END), 6) AS none FROM l""", "recommendations", "issues"),
    "ratio_by_year": with_views("""WITH r AS (SELECT CAST(split_part(report_id, '_', 3) AS INT) AS year, count(*) AS n FROM recommendations GROUP BY ALL), p AS (SELECT year,
count(*) AS m FROM reports GROUP BY year) SELECT year, m AS n_reports, n AS n_recommendations, round(CAST(n AS DOUBLE) / m, 6) AS ratio
FROM p JOIN r USING (year)""", _R, "recommendations"),
    "report_relevance": f"WITH {_RK} SELECT label, round(avg(score), 6) AS relevance FROM k WHERE rank <= 50 GROUP BY label",
    "collapse_expand": with_views("SELECT DISTINCT report_id, line FROM lines", "lines"),
    "split_balance": with_views("""SELECT CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'validation' ELSE 'test' END AS split, mode, count(*) AS n
FROM reports GROUP BY ALL""", _R),
    "split_60_20_20": with_views("SELECT report_id, CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM reports", _R),
    "valid_rate": with_views("SELECT report_id, round(avg(CASE WHEN page IS NOT NULL THEN 1 ELSE 0 END), 6) AS valid_rate FROM paragraphs GROUP BY report_id", "paragraphs"),
    "searches_per_user": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "share_under_limit": with_views(f"SELECT round(avg(CASE WHEN {_TOK} < 300 THEN 1 ELSE 0 END), 6) AS share, CAST(sum({_TOK}) AS BIGINT) AS total FROM reports", _R),
    "token_cost": with_views(f"SELECT agency, round(sum({_TOK}) * 2.5 / 1e6, 8) AS cost FROM reports GROUP BY agency", _R),
    "page_ffill": with_views("SELECT report_id, pos, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY pos), '0') AS page FROM paragraphs", "paragraphs"),
    "paragraph_number": with_views("""WITH f AS (SELECT report_id, pos, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY pos), '0') AS page
FROM paragraphs) SELECT report_id, pos, 'p' || page || '.' || CAST(row_number() OVER (PARTITION BY report_id, page
ORDER BY pos) - 1 AS VARCHAR) AS section FROM f""", "paragraphs"),
    "merge_small_sections": with_views("""WITH f AS (SELECT report_id, pos, pos AS first, line AS text FROM lines WHERE pos = 0
  UNION ALL SELECT l.report_id, l.pos, CASE WHEN length(f.text) >= 1000 THEN l.pos ELSE f.first END, CASE WHEN length(f.text) >= 1000 THEN l.line ELSE f.text || chr(10) || l.line END FROM f JOIN lines l ON l.report_id = f.report_id AND l.pos = f.pos + 1),
e AS (SELECT report_id, first, max(pos) AS last, arg_max(text, pos) AS text FROM f GROUP BY report_id, first)
SELECT report_id, CAST(first AS VARCHAR) || '-' || CAST(last AS VARCHAR) AS section, text AS section_text FROM e""", "lines"),
    "first_rank": f"WITH {_RK} SELECT label AS query_id, vec_id % 40 AS report, min(rank) AS first_rank FROM k GROUP BY ALL",
    "topn_per_group": f"WITH {_RK} SELECT label, vec_id, rank FROM k WHERE rank <= 10",
    "minmax_score": f"WITH {_SC} SELECT vec_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS scaled FROM s",
    "missing_sections": with_views("""WITH s AS (SELECT report_id, CAST(floor(pos / 6) AS INT) AS major, pos % 6 AS minor FROM lines WHERE length(line) > 80), g
AS (SELECT report_id, coalesce(lead(minor) OVER (PARTITION BY report_id, major ORDER BY minor) - minor - 1, 0) AS gap FROM s)
SELECT report_id, CAST(sum(gap) AS BIGINT) AS n_missing, round(CAST(sum(gap) AS DOUBLE) / (sum(gap) + count(*)), 6) AS share FROM g
GROUP BY report_id""", "lines"),
    "cap_per_year": with_views("SELECT report_id, mode, year FROM (SELECT *, row_number() OVER (PARTITION BY mode, year ORDER BY report_id) AS k FROM reports) WHERE k <= 5", _R),
    "sort_relevance": f"WITH {_SC} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id",
    "ndcg": f"""WITH {_RK} SELECT label AS query_id, round(sum(CASE WHEN vec_id % 3 = 0 THEN 1 / log2(rank + 1) ELSE 0 END) / sum(1 / log2(rank + 1)),
6) AS ndcg FROM k WHERE rank <= 100 GROUP BY label""",
    "recall_at_k": f"""WITH {_RK} SELECT label, round(CAST(count(*) FILTER (rank <= 20 AND score > 0.2) AS DOUBLE) / count(*) FILTER (score > 0.2), 6) AS recall
FROM k GROUP BY label HAVING count(*) FILTER (score > 0.2) > 0""",
    "search_leaderboard": """WITH m AS (SELECT label, f, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(['first', 'second', 'third']) AS f,
unnest(embedding[1:3]) AS x FROM embeddings) GROUP BY ALL) SELECT label, arg_max(f, (mean, f)) AS best, max(mean) AS mean FROM m
GROUP BY label""",
    "jaccard": with_views(f"SELECT recommendation_id, safety_issue_id, round({_SCORE}, 6) AS jaccard FROM recommendations JOIN issues USING (report_id)", "recommendations", "issues"),
    "manhattan": """WITH x AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT label, i,
avg(v) AS m FROM x GROUP BY ALL) SELECT vec_id, round(sum(abs(v - m)), 5) AS distance FROM x JOIN c USING (label, i) GROUP BY vec_id""",
    "ndcg_standard": f"""WITH {_RK}, n AS (SELECT label, least(count(*), 100) AS n FROM embeddings WHERE vec_id % 3 = 0 GROUP BY label), b AS (SELECT label,
sum(1 / log2(k + 1)) AS best FROM (SELECT label, unnest(range(1, n + 1)) AS k FROM n) GROUP BY label) SELECT k.label AS query_id,
round(sum(CASE WHEN vec_id % 3 = 0 THEN 1 / log2(rank + 1) ELSE 0 END) / any_value(best), 6) AS ndcg FROM k JOIN b ON b.label = k.label
WHERE rank <= 100 GROUP BY k.label""",
}
