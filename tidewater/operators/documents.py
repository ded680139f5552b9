"""Text and document-structure operators on report tables."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import blocks, ids, pages, sections, text
from tidewater.functions.edits import edit_distance
from tidewater.functions.replies import read_yaml
from tidewater.plans.shared import small_batches
from tidewater.sources.fixtures import table, view, with_views


def column_udf(ddl: str):
    """A pandas function of columns, made a UDF when it is first used in a session. Whole texts come
    in small batches, so that a task's memory doesn't grow with its rows."""

    def made(f):
        def use(*cols):
            small_batches()
            return F.pandas_udf(f, ddl)(*cols)

        return use

    return made


#: The numerals that page labels may have.
ROMAN_LIST = [pages.to_roman(k) for k in range(1, 400)]


def page_slices(docs: DataFrame, body: str = "text", key: str = "report_id") -> DataFrame:
    """(key, page, text) from one `<< Page n >>` marker to the next; page 0 is what stands before."""
    parts = F.split(F.col(body), "<< Page ")
    at = docs.select(key, F.posexplode(parts).alias("k", "part"))
    return at.select(
        key,
        F.when(F.col("k") == 0, "0").otherwise(F.substring_index("part", " >>", 1)).alias("page"),
        F.when(F.col("k") == 0, F.col("part")).otherwise(F.expr("substring(part, instr(part, ' >>') + 3)")).alias("page_text"),
    )


def range_text(body: Column, start: Column, end: Column) -> Column:
    """Text from the marker of page `start` up to and with the marker of page `end`; page 0 is the
    text's start. Null if a marker is missing."""
    a, b = F.concat(F.lit("<< Page "), start, F.lit(" >>")), F.concat(F.lit("<< Page "), end, F.lit(" >>"))
    from_ = F.when(start == "0", F.lit(1)).otherwise(F.instr(body, a))
    to = F.instr(body, b)
    return F.when((from_ > 0) & (to > 0), F.substring(body, from_, to + F.length(b) - from_))


def page_to_last_marker(body: Column, page: Column) -> Column:
    """From a page's marker to the last marker of the text; of the last page, to the end."""
    mark = F.concat(F.lit("<< Page "), page, F.lit(" >>"))
    at, marks = F.instr(body, mark), F.regexp_extract_all(body, F.lit("(<< Page (?:[0-9]+|[xvi]+) >>)"), F.lit(1))
    last = F.element_at(marks, -1)
    end = F.length(body) - F.instr(F.reverse(body), F.reverse(last)) + 2
    return F.when(at == 0, None).when(last == mark, F.substring(body, at, F.length(body))).otherwise(F.substring(body, at, end - at))


def important_text(docs: DataFrame, ranges: DataFrame, most: int = 384_000) -> DataFrame:
    """(report_id, important_text): the pages of a report's ranges (start, end), each once and in
    their order, joined; without ranges the whole text if it is under `most` characters."""
    slices = page_slices(docs).withColumn("n", F.col("page").try_cast("int"))
    read = slices.join(ranges, "report_id").filter(
        F.col("n").between(F.col("start"), F.col("end")),
    ).select("report_id", "n", "page_text").groupBy("report_id", "n").agg(F.first("page_text").alias("page_text"))
    joined = read.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("n", "page_text"))).alias("p")).select(
        "report_id",
        F.array_join(F.transform("p", lambda x: x["page_text"]), "\n").alias("read"),
    )
    return docs.join(joined, "report_id", "left").select(
        "report_id",
        F.coalesce("read", F.when(F.length("text") < most, F.col("text"))).alias("important_text"),
    )


def numeral_value(label: Column) -> Column:
    """The value of a numeral of 1 to 399 in small letters, by its hundreds, tens and ones; 0 of anything else."""
    pattern = "^(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
    digit = lambda group, ten, five, one: (
        F.when(group == one + ten, 9).when(group == one + five, 4).otherwise(F.when(F.startswith(group, F.lit(five)), F.length(group) + 4).otherwise(F.length(group)))
    )
    at = lambda k: F.regexp_extract(label, pattern, k)
    return F.when(F.rlike(label, F.lit(pattern)), F.length(at(1)) * 100 + digit(at(2), "c", "l", "x") * 10 + digit(at(3), "x", "v", "i")).otherwise(0).cast("int")


def validate_labels(labelled: DataFrame, key: str = "report_id") -> DataFrame:
    """(key, valid) from arrays `labels` of page labels: blanks only in front, then numerals, then
    numbers, each without gaps; numbers start at 1 or go on after the numerals; some number."""
    typed = F.transform(
        "labels",
        lambda x: F.struct(
            F.when(x == "", 0).when(F.rlike(x, F.lit("^[0-9]+$")), 2).otherwise(1).alias("kind"),
            F.coalesce(x.try_cast("int"), numeral_value(x)).alias("n"),
        ),
    )
    rows = labelled.withColumn("t", typed)
    pair = F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.size("t")), lambda a, b: ~(((b["kind"] == 0) & (a["kind"] != 0)) | ((a["kind"] == 2) & (b["kind"] != 2)) | ((a["kind"] == b["kind"]) & (a["kind"] != 0) & (b["n"] != a["n"] + 1)) | ((a["kind"] == 1) & (b["kind"] == 2) & ~b["n"].isin(1) & (b["n"] != a["n"] + 1))))
    return rows.select(key, (F.forall(pair, lambda x: x) & F.exists("t", lambda x: x["kind"] == 2)).alias("valid"))


def choose_link(links: Column, agency_id: Column) -> Column:
    """The report's link: not part of a longer one, of a file name of its own, not interim or
    preliminary, with the agency's id where some have it; null unless exactly one is left. A single
    link needs no choosing."""
    name = lambda x: F.substring_index(x, "/", -1)
    a = F.array_distinct(links)
    b = F.filter(a, lambda x: ~F.exists(a, lambda o: (o != x) & F.contains(o, x)))
    c = F.filter(b, lambda x: F.size(F.filter(b, lambda o: name(o) == name(x))) == 1)
    d = F.filter(c, lambda x: ~F.rlike(F.lower(x), F.lit("interim|prelim")))
    e = F.filter(d, lambda x: F.contains(x, agency_id))
    f = F.when(F.size(e) > 0, e).otherwise(d)
    return F.when(F.size(a) == 1, F.element_at(a, 1)).when(F.size(f) == 1, F.get(f, F.lit(0)))


def page_ranges(reply: Column) -> Column:
    """`1,2 7,17` as an array of struct(start, end); `None` and null give null."""
    parts = F.filter(F.split(F.trim(reply), r"\s+"), lambda x: x != "")
    return F.when(
        F.trim(reply) != "None",
        F.transform(
            parts,
            lambda x: F.struct(
                F.split_part(x, F.lit(","), F.lit(1)).alias("start"),
                F.when(F.contains(x, F.lit(",")), F.split_part(x, F.lit(","), F.lit(2))).alias("end"),
            ),
        ),
    )


def lpt_batches(rows: DataFrame, key: str, weight: str, batches: int, shard_rows: int = 10_000) -> DataFrame:
    """(key, batch): the heaviest row goes to the lightest batch so far, of min(batches, rows) ones.

    Shards of about `shard_rows` rows are packed each for itself into as many bins; then the bins,
    the heaviest first, go to the lightest batches, one of each shard to a batch. The driver holds
    the bins' loads only, and one shard gives the plain rule. Null weights count as 0."""
    n = rows.count()
    shards, bins = max(1, -(-n // shard_rows)), max(1, min(batches, n))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        load, out = [(0, b) for b in range(bins)], []
        for k, w, shard in pdf.sort_values(["w", "k"], ascending=[False, True]).itertuples(index=False):
            total, b = heapq.heappop(load)
            heapq.heappush(load, (total + w, b))
            out.append((k, w, shard, b))
        return pd.DataFrame(out, columns=["k", "w", "shard", "bin"])

    dealt = rows.select(
        F.col(key).cast("string").alias("k"),
        F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("w"),
        F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"),
    )
    packed = dealt.groupBy("shard").applyInPandas(pack, "k string, w long, shard int, bin int")
    if shards == 1:
        return packed.select(F.col("k").alias(key), F.col("bin").alias("batch"))
    load, where = [0] * bins, []
    loads: dict[int, list[tuple[int, int]]] = {}
    for r in packed.groupBy("shard", "bin").agg(F.sum("w").alias("w")).collect():
        loads.setdefault(r["shard"], []).append((-r["w"], r["bin"]))
    for shard, own in sorted(loads.items(), key=lambda x: min(x[1])):
        lightest = sorted(range(bins), key=lambda b: (load[b], b))
        for (w, b), batch in zip(sorted(own), lightest, strict=False):
            load[batch] -= w
            where.append((shard, b, batch))
    names = rows.sparkSession.createDataFrame(where, "shard int, bin int, batch int")
    return packed.join(names, ["shard", "bin"]).select(F.col("k").alias(key), "batch")


@column_udf("array<struct<section:string,section_text:string>>")
def section_list(texts: pd.Series) -> pd.Series:
    """Numbered sections or paragraphs of each text."""
    return pd.Series([[{"section": n, "section_text": t} for n, t in sections.sections(x)] for x in texts], dtype=object)


@column_udf("struct<start:int,end:int>")
def contents_of(texts: pd.Series) -> pd.DataFrame:
    """Where each text's contents list lies; nulls without one."""
    return pd.DataFrame([sections.contents_span(x) or (None, None) if x else (None, None) for x in texts], columns=["start", "end"]).astype("Int32")


@column_udf("struct<text:string,labels:array<string>>")
def labelled_pages(texts: pd.Series, agencies: pd.Series) -> pd.DataFrame:
    """Text with page markers, and its page labels."""
    return pd.DataFrame([pages.label_pages(t or "", a) for t, a in zip(texts, agencies, strict=True)], columns=["text", "labels"])


@column_udf("int")
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """The edit distance of two texts; null if one is null."""
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@column_udf("double")
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, 0 to 1."""
    return pd.Series([blocks.matching_ratio(x, y) for x, y in zip(a, b, strict=True)])


@column_udf("array<struct<safety_issue:string,quality:string>>")
def issues_from_yaml(replies: pd.Series) -> pd.Series:
    """The issues that a model's YAML reply lists, within or without code fences; null if it can't be read."""
    import yaml

    def one(reply):
        if reply is None:
            return None
        body = "\n".join(x for x in reply.strip().splitlines() if not x.strip().startswith("```"))
        try:
            rows = read_yaml(body)
        except yaml.YAMLError:
            return None
        return [{"safety_issue": str(r.get("safety_issue")), "quality": str(r.get("quality"))} for r in rows if isinstance(r, dict)] if isinstance(rows, list) else None

    return pd.Series([one(x) for x in replies], dtype=object)


def _reports(spark, d) -> DataFrame:
    return view(spark, d, "reports")


def _paged(spark, d) -> DataFrame:
    """Reports with a page marker before every fifth line from the third on."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("<< Page "), (F.floor(i / 5) + 1).cast("string"), F.lit(" >>\n"), x)).otherwise(x))
    return _reports(spark, d).select("report_id", "doc_id", F.array_join(marked, "\n").alias("text"))


def _starts(spark, d) -> DataFrame:
    """Reports as a file reader gives them: a page start before every fourth line, printed numbers."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("--- Page "), (F.floor(i / 4) + 1).cast("string"), F.lit(" start ---\n"), x, F.lit("\nPage "), (F.floor(i / 4) + 1).cast("string"), F.lit(" |"))).otherwise(x))
    return _reports(spark, d).select("report_id", "agency", F.array_join(lines, "\n").alias("text"))


def q_clean_text(spark, d):
    marked = F.translate("text", "'\"", "’“")
    return _reports(spark, d).select("report_id", text.clean_text(F.concat(marked, F.lit("–›‹"))).alias("text"))


def q_string_basics(spark, d):
    return _reports(spark, d).select(
        "report_id",
        F.right("report_id", F.lit(3)).alias("last3"),
        F.right("report_id", F.lit(5)).alias("last5"),
        F.lower(F.trim(F.concat(F.lit("  "), "agency", F.lit(" ")))).alias("agency"),
        F.replace("report_id", F.lit("_"), F.lit("-")).alias("dashed"),
        F.split_part("report_id", F.lit("_"), F.lit(4)).alias("number"),
    )


def q_regex_extract(spark, d):
    return _reports(spark, d).select(
        "report_id",
        F.nullif(F.regexp_extract("agency_id", r"-(\d{4})-(\d+)-rev", 2), F.lit("")).alias("revised"),
        F.nullif(F.regexp_extract("text", r"Version ([0-9.]+)", 1), F.lit("")).alias("version"),
    )


def q_safety_issue_regex(spark, d):
    mark = F.when(F.col("doc_id") % 3 == 0, " - ").otherwise(": ")
    said = lambda x, i: F.concat(F.when(i % 8 == 1, "S a f e t y issues").otherwise("Safety Issue"), mark, x, F.when(i % 3 == 0, "\n").otherwise(" 2.1 "))
    told = F.concat(F.lit("Intro.\n"), F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 1, said(x, i)).otherwise(x)), "\n"))
    return _reports(spark, d).select("report_id", F.posexplode(text.issue_statements(told)).alias("k", "safety_issue"))


def q_regex_replace(spark, d):
    title = F.concat(
        "report_id",
        F.when(F.col("mode") == "0", " Aviation").when(F.col("mode") == "1", " Rail Marine").otherwise(" Marineland"),
        F.when(F.col("doc_id") % 2 == 0, " Aviation"),
    )
    title = F.coalesce(title, F.concat(F.lit("Aviation "), "report_id"))
    return _reports(spark, d).select("report_id", F.regexp_replace(title, " (Aviation)|(Rail)|(Marine)", "").alias("title"))


def q_split_paragraphs(spark, d):
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _reports(spark, d).select("report_id", F.posexplode(parts).alias("k", "paragraph"))


def q_roman_numerals(spark, d):
    n = F.col("doc_id") % 40 + 1
    names = spark.createDataFrame([(k + 1, r) for k, r in enumerate(ROMAN_LIST)], "n int, roman string")
    return _reports(spark, d).select("report_id", n.cast("int").alias("n")).join(F.broadcast(names), "n")


def q_date_parse_year(spark, d):
    raw = F.when(F.col("doc_id") % 4 == 0, "unknown").when(
        F.col("doc_id") % 4 == 1,
        F.concat(F.col("year").cast("string"), F.lit("-03-15")),
    ).otherwise(F.concat(F.lit("15/03/"), F.col("year").cast("string")))
    parsed = F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")), F.try_to_timestamp(raw, F.lit("dd/MM/yyyy")))
    return _reports(spark, d).select("report_id", F.year(parsed).alias("year"))


def q_tz_convert(spark, d):
    local = F.from_utc_timestamp("ts", "Pacific/Auckland")
    return table(spark, d, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local"))


def q_format_duration(spark, d):
    return table(spark, d, "events").select("event_id", text.format_duration(F.col("event_id") * 7).alias("duration"))


def q_url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        F.parse_url(u, F.lit("PROTOCOL")).alias("scheme"),
        F.parse_url(u, F.lit("HOST")).alias("host"),
        F.parse_url(u, F.lit("PATH")).alias("path"),
        F.url_encode(F.parse_url(u, F.lit("PATH"))).alias("encoded"),
    )


def q_log_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].cast("long").alias("k"))


def q_parse_yaml(spark, d):
    body = F.concat(
        F.lit("```yaml\n"),
        F.concat_ws(
            "\n",
            F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- safety_issue: "), F.to_json(F.array(x)), F.lit("\n  quality: exact"))),
        ),
        F.lit("\n```"),
    )
    return _reports(spark, d).select("report_id", F.size(issues_from_yaml(body)).alias("n_issues"))


def q_token_count(spark, d):
    return _reports(spark, d).select(
        "report_id",
        text.word_count(F.col("text")).alias("n_tokens"),
        F.ceil(F.length("text") / 4).cast("long").alias("by_length"),
    )


def q_truncate_document(spark, d):
    return _reports(spark, d).select("report_id", text.truncate(F.col("text"), 512).alias("text"))


def spread(pairs: DataFrame) -> DataFrame:
    """Pairs of texts dealt over all cores: they are few bytes but long to compare, and adaptive execution,
    which goes by bytes, would leave them to a few tasks."""
    return pairs.repartition(8 * pairs.sparkSession.sparkContext.defaultParallelism)


def q_text_similarity(spark, d):
    both = spread(view(spark, d, "recommendations").join(view(spark, d, "issues"), "report_id"))
    a, b = (F.regexp_replace(c, "[^ -~]", "") for c in ("recommendation", "safety_issue"))
    return both.select("recommendation_id", "safety_issue_id", edits(a, b).alias("edits"))


def q_sequence_similarity(spark, d):
    both = spread(view(spark, d, "recommendations").join(view(spark, d, "issues"), "report_id"))
    return both.select("recommendation_id", "safety_issue_id", F.round(sequence_ratio("recommendation", "safety_issue"), 6).alias("ratio"))


def q_array_ops(spark, d):
    n = F.transform(F.split("text", "\n"), F.length)
    return _reports(spark, d).select(
        "report_id",
        F.size(n).cast("long").alias("n"),
        F.array_max(n).alias("longest"),
        F.array_min(n).alias("shortest"),
        F.size(F.filter(n, lambda x: x > 100)).cast("long").alias("long"),
        F.array_position(n, F.array_max(n)).alias("at"),
    )


def q_extra_context(spark, d):
    k = F.col("doc_id") % 4
    told = F.concat(
        F.lit("On review, "),
        "text",
        F.when(k == 0, "\nThe Commission recommends that it be done.").when(
            k == 1,
            " The commission recommended this, and THE COMMISSION RECOMMENDS that.",
        ).when(k == 2, "\nthe Commission noted it").otherwise(""),
    )
    return _reports(spark, d).select("report_id", F.nullif(F.regexp_extract(told, r"(?is)\A(.*)the commission recommend", 1), F.lit("")).alias("context"))


def q_compose_id(spark, d):
    return _reports(spark, d).select("report_id", ids.compose_id(F.col("mode"), F.col("year"), F.col("doc_id") % 10000).alias("composed"))


def q_page_sync(spark, d):
    out = _starts(spark, d).select("report_id", labelled_pages("text", F.lit("TAIC")).alias("p"))
    return out.select("report_id", F.array_join("p.labels", ",").alias("labels"), F.length("p.text").alias("n_chars"))


def q_page_validate(spark, d):
    k = F.col("doc_id").cast("int")
    romans = F.slice(F.array(*map(F.lit, ROMAN_LIST)), F.lit(1), F.when(k % 7 == 0, 41 + k % 30).otherwise(k % 4))
    romans = F.when((k % 11 == 0) & (F.size(romans) > 1), F.filter(romans, lambda x: x != "ii")).otherwise(romans)
    first = F.when(k % 13 == 0, 2).when(k % 9 == 0, F.size(romans) + 1).otherwise(1)
    number = F.transform(F.sequence(F.lit(0), k % 6), lambda x: F.when((k % 5 == 0) & (x > 1), first + x + 1).otherwise(first + x).cast("string"))
    behind = F.when(k % 17 == 0, F.array(F.lit(""))).when(k % 19 == 0, F.array(F.lit("v"))).otherwise(F.array().cast("array<string>"))
    labels = F.when(k % 23 == 0, romans).otherwise(F.concat(F.array_repeat(F.lit(""), k % 3), romans, number, behind))
    return validate_labels(_reports(spark, d).select("report_id", labels.alias("labels")))


def q_toc_span(spark, d):
    told = F.concat(
        F.lit("Contents of the report\nsection list ........ 1\n"),
        F.array_join(
            F.transform(F.split("text", "\n"), lambda x, i: F.concat(x, F.lit(" ...... "), (i + 1).cast("string"))),
            "\n",
        ),
        F.lit("\n"),
        F.repeat("text", F.lit(4)),
    )
    c = contents_of(told)
    return _reports(spark, d).select("report_id", c.alias("c")).select("report_id", "c.start", "c.end")


def q_pages_from_text(spark, d):
    return page_slices(_paged(spark, d))


def q_page_range_text(spark, d):
    return _paged(spark, d).select("report_id", range_text(F.col("text"), (F.col("doc_id") % 2).cast("string"), F.lit("2")).alias("read"))


def q_page_text(spark, d):
    return _paged(spark, d).select("report_id", page_to_last_marker(F.col("text"), F.lit("2")).alias("read"))


def q_important_text(spark, d):
    docs = _paged(spark, d)
    ranges = docs.filter("length(text) > 1500").select(
        "report_id",
        F.explode(
            F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")), F.struct(F.lit(1).alias("start"), F.lit(2).alias("end"))),
        ).alias("r"),
    ).select("report_id", "r.*")
    return important_text(docs, ranges)


def q_previous_section(spark, d):
    k = F.col("pos")
    number = F.when(k % 3 == 0, (k + 1).cast("string")).when(k % 3 == 1, F.concat_ws(".", (k % 7 + 1).cast("string"), (k % 4 + 1).cast("string"))).otherwise(
        F.concat_ws(".", (k % 7 + 1).cast("string"), (k % 4 + 1).cast("string"), (k % 5 + 1).cast("string")),
    )
    return view(spark, d, "lines").select("report_id", "pos", number.alias("section"), ids.previous_section(number).alias("previous"))


def numbered_texts(spark, d) -> DataFrame:
    """(report_id, told): reports with a number before each line, two deep or three."""
    # Not `F.trim` itself: of two parameters, it would take a line's place for the letters to trim.
    words = F.transform(F.split(F.regexp_replace("text", "[0-9.]", ""), "\n"), lambda x: F.trim(x))
    plain = lambda x, i: F.concat(F.floor(i / 6) + 1, F.lit("."), i % 6 + 1, F.lit(" "), x)
    deep = lambda x, i: F.concat(F.floor(i / 12) + 1, F.lit("."), F.floor(i % 12 / 4) + 1, F.lit("."), i % 4 + 1, F.lit("  "), x)
    lines = F.when(F.col("doc_id") % 2 == 0, F.transform(words, plain)).otherwise(F.transform(words, deep))
    return _reports(spark, d).select("report_id", F.array_join(lines, "\n").alias("told"))


def q_extract_sections(spark, d):
    return numbered_texts(spark, d).select("report_id", F.inline(section_list("told")))


def q_choose_link(spark, d):
    r, k = _reports(spark, d), F.col("doc_id") % 6
    at = lambda *x: F.concat(F.lit("https://files.example/"), *x)
    own, interim, annex = at("agency_id", F.lit(".pdf")), at("agency_id", F.lit("-Interim.pdf")), at(F.lit("annex.pdf"))
    links = (
        F.when(k == 0, F.array(own, interim, annex))
        .when(k == 1, F.array(own, at(F.lit("old/"), "agency_id", F.lit(".pdf")), annex))
        .when(k == 2, F.array(own, at("agency_id", F.lit("-part2.pdf"))))
        .when(k == 3, F.array(own, own, F.concat(own, F.lit("?download=1"))))
        .when(k == 4, F.array(at(F.lit("x.pdf")), at(F.lit("y.pdf")), at(F.lit("prelim.pdf"))))
        .otherwise(F.array(interim, interim))
    )
    return r.select("report_id", choose_link(links, F.col("agency_id")).alias("link"))


def q_lpt_batches(spark, d):
    return lpt_batches(_reports(spark, d).withColumn("n", F.length("text")), "report_id", "n", 8)


def q_synth_ids(spark, d):
    n = view(spark, d, "recommendations").groupBy("report_id").agg(F.array_sort(F.collect_list("recommendation_id")).alias("r"))
    return n.select("report_id", F.posexplode("r").alias("k", "old")).select(
        "report_id",
        "old",
        F.concat("report_id", F.lit("_rec_"), F.col("k").cast("string")).alias("recommendation_id"),
    )


def q_parse_page_ranges(spark, d):
    reply = F.when(F.col("doc_id") % 5 == 0, "None").when(F.col("doc_id") % 5 == 1, F.lit("i,2 10,12")).when(F.col("doc_id") % 5 == 2, F.lit("7,13 20")).otherwise(
        F.concat((F.col("doc_id") % 9).cast("string"), F.lit(",17")),
    )
    return _reports(spark, d).select("report_id", F.inline(page_ranges(reply)))


def q_event_type_exact(spark, d):
    known = table(spark, d, "events").select("event_type").distinct().select(
        F.concat(F.lit("type "), (F.length("event_type") % 11).cast("string")).alias("event_type"),
    ).distinct()
    return _reports(spark, d).select("report_id", "event_type").join(F.broadcast(known), "event_type", "left_semi").select("report_id", "event_type")


#: Endings that give the fixture's replies every category, and words that only look like key words.
REPLY_ENDINGS = (
    "The recommendation is accepted.",
    "It was ACCEPTED and implemented.",
    "We will implement it.",
    "This is under review.",
    "We consider it.",
    "It is rejected, though we considered it.",
    "Not acceptable, misunderstood.",
    "",
)


def q_classify_reply(spark, d):
    ending = F.get(F.array(*map(F.lit, REPLY_ENDINGS)), ((F.col("conv_id") + F.col("turn")) % len(REPLY_ENDINGS)).cast("int"))
    return view(spark, d, "replies").select("conv_id", "turn", text.reply_category(F.concat("reply_text", F.lit(" "), ending)).alias("response_category"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_R = "reports"
_PAGED = """paged AS (SELECT report_id, doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE
WHEN (i - 1) % 5 = 2 THEN '<< Page ' || CAST((i - 1) // 5 + 1 AS VARCHAR) || ' >>' || chr(10) || x ELSE x END), chr(10)) AS text
FROM reports)"""
_ENDINGS = ", ".join(f"'{x}'" for x in REPLY_ENDINGS)
_ROMANS = "[" + ", ".join(f"'{r}'" for r in ROMAN_LIST) + "]"
_SLICES = """sl AS (SELECT report_id, CASE WHEN k = 1 THEN '0' ELSE split_part(part, ' >>', 1) END AS page, CASE WHEN k = 1 THEN part ELSE substr(part,
strpos(part, ' >>') + 3) END AS page_text FROM (SELECT report_id, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS part
FROM (SELECT report_id, string_split(text, '<< Page ') AS p FROM paged)))"""
ORACLES = {
    "clean_text": with_views("SELECT report_id, translate(translate(text, '''\"', '’“') || '–›‹', '–’‘“”›‹', '-''''\"\"><') AS text FROM reports", _R),
    "string_basics": with_views("""SELECT report_id, right(report_id, 3) AS last3, right(report_id, 5) AS last5, lower(agency) AS agency, replace(report_id, '_',
'-') AS dashed, split_part(report_id, '_', 4) AS number FROM reports""", _R),
    "regex_extract": with_views("""SELECT report_id, nullif(regexp_extract(agency_id, '-([0-9]{4})-([0-9]+)-rev', 2), '') AS revised, nullif(regexp_extract(text,
'Version ([0-9.]+)', 1), '') AS version FROM reports""", _R),
    "regex_replace": with_views("""SELECT report_id, regexp_replace(coalesce(report_id || CASE mode WHEN '0' THEN ' Aviation' WHEN '1' THEN ' Rail Marine'
ELSE ' Marineland' END || CASE WHEN doc_id % 2 = 0 THEN ' Aviation' END, 'Aviation ' || report_id), ' (Aviation)|(Rail)|(Marine)', '',
'g') AS title FROM reports""", _R),
    "split_paragraphs": with_views("""WITH p AS (SELECT report_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p
FROM reports) SELECT report_id, CAST(unnest(range(len(p))) AS INT) AS k, unnest(p) AS paragraph FROM p""", _R),
    "roman_numerals": with_views(f"SELECT CAST(doc_id % 40 + 1 AS INT) AS n, report_id, {_ROMANS}[doc_id % 40 + 1] AS roman FROM reports", _R),
    "date_parse_year": with_views("SELECT report_id, CASE WHEN doc_id % 4 > 0 THEN year END AS year FROM reports", _R),
    "tz_convert": "SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Pacific/Auckland', '%Y-%m-%d %H:%M:%S') AS local FROM events",
    "format_duration": """WITH s AS (SELECT event_id, event_id * 7 AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN s || 's'
WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s % 3600 // 60 || 'm ' || s % 60 || 's' END AS duration FROM s""",
    "url_parts": """WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages) SELECT page_id, regexp_extract(url,
'^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, path, replace(path, '/', '%2F') AS encoded FROM p""",
    "log_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "token_count": with_views("""SELECT report_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS n_tokens,
CAST(ceil(length(text) / 4) AS BIGINT) AS by_length FROM reports""", _R),
    "truncate_document": with_views("SELECT report_id, substr(text, 1, 462) AS text FROM reports", _R),
    "array_ops": with_views("""WITH n AS (SELECT report_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS n FROM reports) SELECT report_id,
CAST(len(n) AS BIGINT) AS n, CAST(list_max(n) AS INT) AS longest, CAST(list_min(n) AS INT) AS shortest, CAST(len(list_filter(n,
lambda x: x > 100)) AS BIGINT) AS long, CAST(list_position(n, list_max(n)) AS BIGINT) AS at FROM n""", _R),
    "extra_context": with_views("""WITH t AS (SELECT report_id, 'On review, ' || text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'The Commission recommends that it be done.'
WHEN 1 THEN ' The commission recommended this, and THE COMMISSION RECOMMENDS that.' WHEN 2 THEN chr(10) || 'the Commission noted it'
ELSE '' END AS told FROM reports)
SELECT report_id, CASE WHEN pos > 0 THEN left(told, length(told) - pos - 23) END AS context FROM (SELECT *, strpos(reverse(lower(told)),
reverse('the commission recommend')) AS pos FROM t)""", _R),
    "compose_id": with_views("""SELECT report_id, mode || lpad(CAST(year % 100 AS VARCHAR), 2, '0') || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS composed
FROM reports""", _R),
    "page_validate": with_views(f"""WITH b AS (SELECT report_id, doc_id AS k, {_ROMANS}[1:CASE WHEN doc_id % 7 = 0 THEN 41 + doc_id % 30 ELSE doc_id % 4 END] AS r0
FROM reports),
r AS (SELECT report_id, k, CASE WHEN k % 11 = 0 AND len(r0) > 1 THEN list_filter(r0, lambda x: x <> 'ii') ELSE r0 END AS r FROM b),
n AS (SELECT *, CASE WHEN k % 13 = 0 THEN 2 WHEN k % 9 = 0 THEN len(r) + 1 ELSE 1 END AS first FROM r),
l AS (SELECT report_id, CASE WHEN k % 23 = 0 THEN r ELSE list_concat(list_transform(range(k % 3), lambda x: ''), r,
list_transform(range(k % 6 + 1), lambda x: CAST(first + x + CASE WHEN k % 5 = 0 AND x > 1 THEN 1 ELSE 0 END AS VARCHAR)), CASE
WHEN k % 17 = 0 THEN [''] WHEN k % 19 = 0 THEN ['v'] ELSE [] END) END AS l FROM n),
t AS (SELECT report_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM l),
y AS (SELECT report_id, pos, CASE WHEN x = '' THEN 0 WHEN regexp_full_match(x, '[0-9]+') THEN 2 ELSE 1 END AS kind,
coalesce(TRY_CAST(x AS INT), list_position({_ROMANS}, x)) AS n FROM t),
z AS (SELECT *, lag(kind) OVER w AS before, lag(n) OVER w AS last FROM y WINDOW w AS (PARTITION BY report_id ORDER BY pos))
SELECT reports.report_id, coalesce(valid, false) AS valid FROM reports LEFT JOIN (SELECT report_id, bool_and(before IS NULL
OR kind >= before AND (kind = 0 OR before = 0 OR n = last + 1 OR kind = 2 AND before = 1 AND n = 1)) AND bool_or(kind = 2) AS valid FROM z
GROUP BY report_id) USING (report_id)""", _R),
    "pages_from_text": with_views(f"WITH {_PAGED}, {_SLICES} SELECT report_id, page, page_text FROM sl", _R),
    "page_range_text": with_views(f"""WITH {_PAGED}, m AS (SELECT report_id, text, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE strpos(text, '<< Page 1 >>') END AS a, strpos(text,
'<< Page 2 >>') AS b FROM paged) SELECT report_id, CASE WHEN a > 0 AND b > 0 THEN substr(text, a, b + 12 - a) END AS read FROM m""", _R),
    "page_text": with_views(f"""WITH {_PAGED}, m AS (SELECT report_id, text, strpos(text, '<< Page 2 >>') AS a, regexp_extract_all(text, '<< Page [0-9]+ >>') AS marks
FROM paged) SELECT report_id, CASE WHEN a = 0 THEN NULL WHEN marks[-1] = '<< Page 2 >>' THEN substr(text, a) ELSE substr(text, a,
strpos(text, marks[-1]) + length(marks[-1]) - a) END AS read FROM m""", _R),
    "important_text": with_views(f"""WITH {_PAGED}, {_SLICES}, j AS (SELECT report_id, string_agg(page_text, chr(10) ORDER BY CAST(page AS INT)) AS t FROM sl
WHERE CAST(page AS INT) <= 2 GROUP BY report_id) SELECT report_id, CASE WHEN length(text) > 1500 THEN t
WHEN length(text) < 384000 THEN text END AS important_text FROM paged JOIN j USING (report_id)""", _R),
    "previous_section": with_views("""WITH s AS (SELECT report_id, pos, pos % 7 + 1 AS a, pos % 4 + 1 AS b, pos % 5 + 1 AS c FROM lines)
SELECT report_id, pos, CASE pos % 3 WHEN 0 THEN CAST(pos + 1 AS VARCHAR) WHEN 1 THEN a || '.' || b ELSE a || '.' || b || '.' || c END AS section,
CASE WHEN pos % 3 = 0 THEN CAST(greatest(pos, 1) AS VARCHAR) WHEN pos % 3 = 2 AND c > 1 THEN a || '.' || b || '.' || (c - 1)
WHEN b > 1 THEN a || '.' || (b - 1) ELSE CAST(greatest(a - 1, 1) AS VARCHAR) END AS previous FROM s""", "lines"),
    "choose_link": with_views("""SELECT report_id, CASE doc_id % 6 WHEN 0 THEN 'https://files.example/' || agency_id || '.pdf' WHEN 1 THEN 'https://files.example/annex.pdf'
WHEN 3 THEN 'https://files.example/' || agency_id || '.pdf?download=1'
WHEN 5 THEN 'https://files.example/' || agency_id || '-Interim.pdf' END AS link FROM reports""", _R),
    "synth_ids": with_views("""SELECT report_id, recommendation_id AS old, report_id || '_rec_' || CAST(row_number() OVER (PARTITION BY report_id
ORDER BY recommendation_id) - 1 AS VARCHAR) AS recommendation_id FROM recommendations""", "recommendations"),
    "parse_page_ranges": with_views("""SELECT report_id, 'i' AS start, '2' AS "end" FROM reports WHERE doc_id % 5 = 1 UNION ALL SELECT report_id, '10', '12' FROM reports
WHERE doc_id % 5 = 1 UNION ALL SELECT report_id, '7', '13' FROM reports WHERE doc_id % 5 = 2 UNION ALL SELECT report_id, '20', NULL
FROM reports WHERE doc_id % 5 = 2 UNION ALL SELECT report_id, CAST(doc_id % 9 AS VARCHAR), '17' FROM reports WHERE doc_id % 5 > 2""", _R),
    "event_type_exact": with_views("SELECT report_id, event_type FROM reports WHERE event_type IN (SELECT 'type ' || CAST(length(event_type) % 11 AS VARCHAR) FROM events)", _R),
    "text_similarity": with_views("""SELECT recommendation_id, safety_issue_id, CAST(levenshtein(regexp_replace(recommendation, '[^ -~]', '', 'g'), regexp_replace(safety_issue,
'[^ -~]', '', 'g')) AS INT) AS edits FROM recommendations JOIN issues USING (report_id)""", "recommendations", "issues"),
    "classify_reply": with_views(f"""WITH t AS (SELECT conv_id, turn, lower(reply_text || ' ' || [{_ENDINGS}][(conv_id + turn) % 8 + 1]) AS low FROM replies), w
AS (SELECT conv_id, turn, regexp_extract_all(low, '[a-z0-9_]+') AS w FROM t)
SELECT conv_id, turn, CASE WHEN list_contains(w, 'rejected') THEN 'rejected' WHEN list_has_any(w, ['under', 'consideration',
'consider']) THEN 'under consideration' WHEN list_has_any(w, ['implemented', 'implement']) THEN 'accepted and implemented'
WHEN list_has_any(w, ['accepted', 'accept']) THEN 'accepted' ELSE 'n/a' END AS response_category FROM w""", "replies"),
    "parse_yaml": with_views("SELECT report_id, CAST(len(string_split(text, chr(10))) AS INT) AS n_issues FROM reports", _R),
    "safety_issue_regex": with_views(r"""WITH t AS (SELECT report_id, 'Intro.' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE
WHEN (i - 1) % 4 = 1 THEN CASE WHEN (i - 1) % 8 = 1 THEN 'S a f e t y issues' ELSE 'Safety Issue' END || CASE WHEN doc_id % 3 = 0 THEN ' - '
ELSE ': ' END || x || CASE WHEN (i - 1) % 3 = 0 THEN chr(10) ELSE ' 2.1 ' END ELSE x END), chr(10)) AS told FROM reports),
p AS (SELECT report_id, regexp_split_to_array(told, '(?i)s ?a ?f ?e ?t ?y ? ?i ?s ?s ?u ?e ?s?') AS p FROM t),
r AS (SELECT report_id, unnest(range(2, len(p) + 1)) AS pos, unnest(p[2:]) AS part, len(p) AS last, unnest(['-', ':']) AS mark FROM p),
q AS (SELECT report_id, pos, last, part, mark FROM (SELECT report_id, pos, part, last FROM r WHERE part IS NOT NULL), (SELECT unnest(['-', ':']) AS mark)),
s AS (SELECT *, CASE WHEN mark = '-' THEN regexp_extract(part, '^ {0,3}- {0,3}([\\s\\S]+?)[0-9]+\\.', 1) ELSE regexp_extract(part,
'^ {0,3}: {0,3}([\\s\\S]+?)[0-9]+\\.', 1) END AS cut, CASE WHEN mark = '-' THEN regexp_extract(part, '^ {0,3}- {0,3}([\\s\\S]+)$', 1)
ELSE regexp_extract(part, '^ {0,3}: {0,3}([\\s\\S]+)$', 1) END AS whole FROM q),
f AS (SELECT report_id, pos, mark, CASE WHEN cut <> '' THEN cut WHEN pos < last THEN whole ELSE '' END AS said FROM s),
n AS (SELECT *, count(*) FILTER (mark = '-') OVER (PARTITION BY report_id) AS dashes,
count(*) FILTER (mark = ':') OVER (PARTITION BY report_id) AS colons FROM f WHERE said <> '')
SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY pos) - 1 AS INT) AS k, said AS safety_issue FROM n WHERE mark =
CASE WHEN colons > dashes THEN ':' ELSE '-' END""".replace("\\\\", "\\"), _R),
    "extract_sections": with_views(r"""WITH l AS (SELECT doc_id, report_id, list_transform(string_split(regexp_replace(text, '[0-9.]', '', 'g'), chr(10)), lambda x: trim(x, ' ')) AS w FROM reports),
r AS (SELECT doc_id, report_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS x FROM l),
h AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN (i // 6 + 1) || '.' || (i % 6 + 1)
ELSE (i // 12 + 1) || '.' || (i % 12 // 4 + 1) || '.' || (i % 4 + 1) END AS section FROM r),
t AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN section || ' ' || x ELSE section || '  ' || x END AS line FROM h),
f AS (SELECT * FROM t WHERE i < n - 1 AND CASE WHEN doc_id % 2 = 0 THEN i < 84 ELSE i < 168 AND i % 4 < 3 END),
g AS (SELECT report_id, count(*) > 4 AND avg(length(trim(line, ' '))) < 2000 AS fine FROM f GROUP BY report_id)
SELECT report_id, section, trim(line, ' ') AS section_text FROM f JOIN g USING (report_id) WHERE fine
UNION ALL SELECT report_id, 'p0.0', trim(string_agg(line, chr(10) ORDER BY i), ' ') FROM t WHERE report_id NOT IN (SELECT report_id FROM g
WHERE fine) GROUP BY report_id""", _R),
}
