"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens that any matching url must hold. The
tokens are counted over all urls; each rule is filed under the rarest of its own. A url's tokens
fetch candidate rules, and only those run their expressions. All of it is DataFrame functions.

Rules come as a table (`rules_from` makes one from written places and words) or as a few `Rule`s. Few
travel inside the plan as one constant, and nothing is shuffled; many are joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules travel inside the plan as one constant; more are joined as a table.
INLINE_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """`label` is what a result shows; `pattern` runs on host and path joined; `tokens` are runs
    of a-z0-9 that each match holds as whole tokens; the highest `rank` wins."""

    label: str | None
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def _quoted(text: str) -> str:
    """`text` as a literal of a regular expression."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def place_rule(action: str, place: str) -> Rule:
    """The rule for a host with its subdomains and a path prefix, written `host/prefix`. Hosts are
    lower-cased, paths aren't; the tokens are lower-cased as those of urls are."""
    host, _, path = place.partition("/")
    host = host.translate(str.maketrans(UPPER, LOWER))
    ended = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", "/" + path.translate(str.maketrans(UPPER, LOWER)))
    tokens = tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", host) + ended))
    return Rule(place, action, rf"^(?:[^/]*\.)?{_quoted(f'{host}/{path}')}", tokens, 1000 + len(place))


def word_rule(action: str, words: str) -> Rule:
    """The rule for hosts or paths that hold these words one after another, in either case."""
    parts = words.translate(str.maketrans(UPPER, LOWER)).split()
    inner = "[^a-z0-9]+".join(map(_quoted, parts))
    tokens = tuple(dict.fromkeys(t for x in parts for t in re.findall(r"[a-z0-9]+", x)))
    return Rule(None, action, rf"(?i)(?:^|[^a-z0-9]){inner}(?:[^a-z0-9]|$)", tokens, 1)


#: The site rules that the query is asked for.
SITE_RULES = (
    place_rule("allow", "org/"),
    place_rule("block", "example.org/es/"),
    place_rule("block", "example.org/en/1"),
    place_rule("allow", "com/fr/"),
    place_rule("block", "com/de/"),
)
#: Words of gambling, pharmacy and advert hosts.
SPAM_RULES = tuple(word_rule("block", w) for w in ("casino", "free bets", "cheap pills", "ads track", "poker", "viagra"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: the host is what follows the first `://` up to `/`, `?`, `#` or the
    end, A-Z lower-cased; the path follows up to `?`, `#` or the end. Null or no `://`: both empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


RULES = "label string, action string, pattern string, tokens array<string>, rank int"


def rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules as a table of RULES."""
    return spark.createDataFrame([(r.label, r.action, r.pattern, list(r.tokens), r.rank) for r in rules], RULES)


def rules_from(written: DataFrame) -> DataFrame:
    """A table of RULES from rows of (action, place, words): a row with a place (`host/prefix`) gives
    what `place_rule` does, one with words what `word_rule` does; a row without either gives none.
    Repeated rows are one rule."""
    quoted = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    low = lambda x: F.translate(x, UPPER, LOWER)
    place, words = F.col("place"), F.col("words")
    host = low(F.substring_index(place, "/", 1))
    path = F.when(F.contains(place, F.lit("/")), F.regexp_replace(place, "^[^/]*/", "")).otherwise("")
    found = lambda x, pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    by_place = written.filter(place.isNotNull()).select(
        place.alias("label"),
        "action",
        F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(F.concat(host, F.lit("/"), path))).alias("pattern"),
        F.array_distinct(F.concat(found(host, "[a-z0-9]+"), found(F.concat(F.lit("/"), low(path)), "[a-z0-9]+(?=[^a-z0-9])"))).alias("tokens"),
        (F.length(place) + 1000).cast("int").alias("rank"),
    )
    parts = F.filter(F.split(low(words), r"\s+"), lambda x: x != "")
    by_words = written.filter(place.isNull() & (F.trim(words) != "")).select(
        F.lit(None).cast("string").alias("label"),
        "action",
        F.concat(F.lit("(?i)(?:^|[^a-z0-9])"), F.array_join(F.transform(parts, quoted), "[^a-z0-9]+"), F.lit("(?:[^a-z0-9]|$)")).alias("pattern"),
        F.array_distinct(found(low(words), "[a-z0-9]+")).alias("tokens"),
        F.lit(1).alias("rank"),
    )
    return by_place.union(by_words).distinct()


def filed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with the token of their own that the fewest urls hold; ties go to the longer, then
    the first token. `urls` has the column `_tokens`; tokens are summed in each task before they are
    shuffled, and where the rules have few, only theirs."""
    if rules.filter((F.size("tokens") <= 0) | F.col("tokens").isNull()).limit(1).count():
        raise ValueError("a rule without a literal token can't be indexed")
    own = rules.select("*", F.explode("tokens").alias("token"))
    few = [r["token"] for r in own.select("token").distinct().limit(INLINE_RULES + 1).collect()]
    held = F.col("_tokens") if len(few) > INLINE_RULES else F.array_intersect(
        "_tokens",
        F.array(*map(F.lit, sorted(few))),
    ) if few else F.array().cast("array<string>")
    counts = urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token")
    best = own.join(counts, "token", "left").groupBy("label", "action", "pattern", "rank").agg(F.min_by("token", order).alias("token"))
    return best.select("token", (-F.col("rank")).alias("rank"), "label", "action", "pattern")


def judge_urls(urls: DataFrame, rules: DataFrame | tuple[Rule, ...] = SITE_RULES + SPAM_RULES, default: str = "allow", url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to every row of `urls`; columns of those names are replaced.

    Of the rules that match, the one of the highest rank decides; equal ranks go to the smaller
    label, then to the smaller action (allow before block). No match: `default` and a null rule. A
    null, empty or odd url has no token, so no rule. Repeated rows are judged alike; an empty table
    gives an empty result. Up to `inline` rules travel in the plan; more are joined.
    """
    at = F.col(url)
    host, path = split_url(at)
    own = urls.withColumns({"host": host, "path": path})
    own = own.withColumn("_tokens", F.array_distinct(F.split(F.translate(F.concat("host", "path"), UPPER, LOWER), "[^a-z0-9]+")))
    given = rules if isinstance(rules, DataFrame) else rules_table(own.sparkSession, rules)
    index = filed(own, given)
    if given.limit(inline + 1).count() > inline:
        return _joined(own, index, default, url)
    held: dict[str, list] = {}
    for r in index.collect():
        held.setdefault(r["token"], []).append(r)
    return _inline(own, held, default)


def _as_struct(r: Row) -> Column:
    return F.struct(
        F.lit(r["rank"]).alias("rank"),
        F.lit(r["label"]).cast("string").alias("label"),
        F.lit(r["action"]).alias("action"),
        F.lit(r["pattern"]).alias("pattern"),
    )


def _inline(own: DataFrame, index: dict[str, list[Row]], default: str) -> DataFrame:
    """No shuffle: the index is a constant map from token to rules."""
    if not index:
        return own.drop("_tokens").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    held = F.create_map(*[c for t, rules in sorted(index.items()) for c in (F.lit(t), F.array(*map(_as_struct, rules)))])
    some = F.array_intersect("_tokens", F.array(*map(F.lit, sorted(index))))
    fetched = F.flatten(F.transform(some, lambda t: F.element_at(held, t)))
    best = F.array_min(F.filter(fetched, lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"])))
    return own.withColumn("_best", best).withColumns(
        {"rule": F.col("_best.label"), "verdict": F.coalesce("_best.action", F.lit(default))},
    ).drop("_tokens", "_best")


def _joined(own: DataFrame, index: DataFrame, default: str, url: str) -> DataFrame:
    """For large rule sets: of the tokens of distinct urls those of the index stay, and meet the
    rules filed under them in a join whose plan doesn't grow with the rules."""
    index = materialise(index, "url-rules")
    pairs = own.select(url, "host", "path", "_tokens").dropDuplicates([url]).select(
        F.col(url).alias("_url"),
        F.concat("host", "path").alias("_place"),
        F.explode("_tokens").alias("token"),
    )
    pairs = pairs.join(index.select("token").distinct(), "token", "left_semi")
    hits = pairs.join(index, "token").filter(F.regexp_like("_place", F.col("pattern")))
    best = hits.groupBy("_url").agg(F.min(F.struct("rank", "label", "action")).alias("_best"))
    out = own.drop("_tokens").join(best, F.col(url) == F.col("_url"), "left")
    return out.withColumns({"rule": F.col("_best.label"), "verdict": F.coalesce("_best.action", F.lit(default))}).drop("_url", "_best")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


#: The same in SQL: every rule tried on every url.
ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), j AS (
  SELECT *, CASE
    WHEN regexp_matches(host || path, '^([^/]*\.)?example\.org/en/1') THEN 'example.org/en/1'
    WHEN regexp_matches(host || path, '^([^/]*\.)?example\.org/es/') THEN 'example.org/es/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?com/fr/') THEN 'com/fr/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?com/de/') THEN 'com/de/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?org/') THEN 'org/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])(casino|free[^a-z0-9]+bets|cheap[^a-z0-9]+pills|ads[^a-z0-9]+track|poker|viagra)([^a-z0-9]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM j
"""
