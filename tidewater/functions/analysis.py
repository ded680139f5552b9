"""English text analysis: words, accent folding, and stems of distinct terms.

Stemming follows the published English suffix-stripping rules (the second version of Porter's). It is
a chain of column expressions, each of which sees the word that the one before it left together with
the places where its two regions start, so it runs in the JVM; `stems` applies it to every distinct
term once. `stem_sql` writes the same rules for DuckDB.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that decomposition leaves alone, and how they are written without accents.
EXPANSIONS = {"æ": "ae", "œ": "oe", "ß": "ss", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i"}
#: A word: letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"
#: Combining marks that may stand apart from their letter.
MARKS = "[̀-ͯ]"

#: The published rules. Whole words with a stem of their own, and such that stay as step 1a leaves them.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings after which the first region starts.
BEGINNINGS = ("gener", "commun", "arsen")
#: Suffixes of steps 2 to 4 and what stands in their place; further conditions are in the steps.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)
_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


@cache
def accents() -> tuple[str, str]:
    """(letters of the Basic Multilingual Plane that decompose to one letter and marks, those letters)."""
    found = []
    for point in range(0x80, 0x10000):
        letter = chr(point)
        if not letter.isalpha():
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if len(base) == 1 and base != letter:
            found.append((letter, base))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def fold(text: Column) -> Column:
    """A text in lower case without accents. Texts in ASCII go past the tables."""
    low = F.lower(text)
    plain = F.translate(F.regexp_replace(low, MARKS, ""), *accents())
    for letter, written in EXPANSIONS.items():
        plain = F.replace(plain, F.lit(letter), F.lit(written))
    return F.when(F.rlike(low, F.lit(r"[^\x00-\x7F]")), plain).otherwise(low)


def words(text: Column) -> Column:
    """The words of a text, folded, in order; null for null."""
    return F.regexp_extract_all(fold(text), F.lit(f"({WORD})"), F.lit(1))


def _bind(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value), with `value` worked out once however often the function uses it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _cut(word: Column, n: Column | int, added: Column | str = "") -> Column:
    """The word without its last n letters and with something added."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.substring(word, F.lit(1), F.length(word) - n), F.lit(added) if isinstance(added, str) else added)


def _ending(word: Column, suffixes) -> Column:
    """The longest of some suffixes that a word ends in, else ''."""
    return F.regexp_extract(word, f"({'|'.join(suffixes)})$", 1)


def _vowel_marks(w: Column) -> Column:
    """A y that counts as a consonant becomes Y."""
    return F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y")


def _after_vowel(w: Column) -> Column:
    """How many letters there are up to the first consonant that follows a vowel, or all."""
    return F.length(w) - F.length(F.regexp_extract(w, "^[^aeiouy]*[aeiouy]+[^aeiouy](.*)$", 1))


def _regions(w: Column) -> Column:
    """The word with the places where its first and second region start, as a struct (w, p1, p2)."""
    has = lambda x: F.rlike(x, F.lit("[aeiouy][^aeiouy]"))
    beginning = F.regexp_extract(w, f"^({'|'.join(BEGINNINGS)})", 1)
    p1 = F.when(beginning != "", F.length(beginning)).when(has(w), _after_vowel(w)).otherwise(F.length(w))

    def second(s: Column) -> Column:
        rest = F.substring(s["w"], s["p1"] + 1, F.length(s["w"]))
        return F.struct(s["w"].alias("w"), s["p1"].alias("p1"), (s["p1"] + F.when(has(rest), _after_vowel(rest)).otherwise(F.length(rest))).alias("p2"))

    return _bind(F.struct(w.alias("w"), p1.alias("p1")), second)


def _step(state: Column, rewrite: Callable[[Column, Column, Column], Column]) -> Column:
    """The state with w rewritten by a function of (w, p1, p2)."""
    return _bind(state, lambda s: F.struct(rewrite(s["w"], s["p1"], s["p2"]).alias("w"), s["p1"].alias("p1"), s["p2"].alias("p2")))


def _plural(w: Column, p1: Column, p2: Column) -> Column:
    found = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    return (
        F.when(found == "sses", _cut(w, 2))
        .when(found.isin("ied", "ies"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
        .when((found == "s") & F.rlike(w, F.lit("[aeiouy].+s$")), _cut(w, 1))
        .otherwise(w)
    )


def _past(w: Column, p1: Column, p2: Column) -> Column:
    found = _ending(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    rest = _cut(w, F.length(found))
    mended = (
        F.when(F.rlike(rest, F.lit("(at|bl|iz)$")), F.concat(rest, F.lit("e")))
        .when(F.rlike(rest, F.lit("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")), _cut(rest, 1))
        .when((p1 >= F.length(rest)) & F.rlike(rest, F.lit(_SHORT)), F.concat(rest, F.lit("e")))
        .otherwise(rest)
    )
    return (
        F.when(found.isin("eed", "eedly"), F.when(F.length(rest) >= p1, F.concat(rest, F.lit("ee"))).otherwise(w))
        .when((found != "") & F.rlike(rest, F.lit("[aeiouy]")), mended)
        .otherwise(w)
    )


def _final_y(w: Column, p1: Column, p2: Column) -> Column:
    return F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i")


def _by_table(table: dict[str, str], special: dict[str, Callable[[Column, Column, Column], Column]]):
    """A step that replaces the longest suffix of a table where it lies in the first region; a special
    suffix has a condition on (what stands before it, p1, p2) besides."""
    replacement = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def rewrite(w: Column, p1: Column, p2: Column) -> Column:
        def known(found: Column) -> Column:
            rest = _cut(w, F.length(found))
            fits = F.length(rest) >= p1
            for suffix, condition in special.items():
                fits = fits & ((found != suffix) | condition(rest, p1, p2))
            return F.when((found != "") & fits, F.concat(rest, F.coalesce(F.try_element_at(replacement, found), F.lit("")))).otherwise(w)

        return _bind(_ending(w, sorted(table, key=len, reverse=True)), known)

    return rewrite


def _long_suffix(w: Column, p1: Column, p2: Column) -> Column:
    def known(found: Column) -> Column:
        rest = _cut(w, F.length(found))
        fits = (found != "") & (F.length(rest) >= p2) & ((found != "ion") | F.rlike(rest, F.lit("[st]$")))
        return F.when(fits, rest).otherwise(w)

    return _bind(_ending(w, sorted(STEP_4, key=len, reverse=True)), known)


def _last_letter(w: Column, p1: Column, p2: Column) -> Column:
    rest, last = _cut(w, 1), F.substring(w, -1, 1)
    place = F.length(rest)
    e = (last == "e") & ((place >= p2) | ((place >= p1) & ~F.rlike(rest, F.lit(_SHORT))))
    return F.when(e | ((last == "l") & (place >= p2) & F.endswith(rest, F.lit("l"))), rest).otherwise(w)


def stem(term: str) -> Column:
    """The stem of a column of words in lower case; words of one or two letters, and such with other
    letters than a to z, are their own. Meant for distinct terms (see `stems`). The expression is large
    and is put together once for a column's name."""
    return _stem(term, id(SparkContext._gateway))


@cache
def _stem(name: str, gateway: int) -> Column:
    term = F.col(name)

    def rest_of_steps(state: Column) -> Column:
        state = _step(state, _past)
        state = _step(state, _final_y)
        state = _step(state, _by_table(STEP_2, {"ogi": lambda rest, p1, p2: F.endswith(rest, F.lit("l")), "li": lambda rest, p1, p2: F.rlike(rest, F.lit("[cdeghkmnrt]$"))}))
        state = _step(state, _by_table(STEP_3, {"ative": lambda rest, p1, p2: F.length(rest) >= p2}))
        state = _step(state, _long_suffix)
        return _step(state, _last_letter)["w"]

    first = lambda w: _step(_regions(w), _plural)
    stripped = _bind(_vowel_marks(term), lambda w: _bind(first(w), lambda s: F.when(s["w"].isin(*FINAL), s["w"]).otherwise(rest_of_steps(s))))
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    regular = F.rlike(term, F.lit("^[a-z]{3,}$"))
    return F.when(~regular, term).otherwise(F.coalesce(F.try_element_at(irregular, term), F.lower(stripped)))


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms of a table; a null term has none."""
    return terms.select(term).distinct().select(term, stem(term).alias("stem"))


def fold_sql(text: str) -> str:
    """`fold` in DuckDB."""
    out = f"strip_accents(regexp_replace(lower({text}), '[\\x{{300}}-\\x{{36F}}]', '', 'g'))"
    for letter, written in EXPANSIONS.items():
        out = f"replace({out}, '{letter}', '{written}')"
    return out


def words_sql(text: str) -> str:
    """`words` in DuckDB."""
    return f"regexp_extract_all({fold_sql(text)}, '[\\p{{L}}\\p{{N}}]+')"


def stem_sql(terms: str) -> str:
    """CTEs that end in `stems` (term, stem), for the distinct terms of a table or query `terms`."""
    cut = lambda n: f"left(w, length(w) - {n})"
    after = lambda x: f"CASE WHEN regexp_matches({x}, '[aeiouy][^aeiouy]') THEN length({x}) - length(regexp_extract({x}, '^[^aeiouy]*[aeiouy]+[^aeiouy](.*)$', 1)) ELSE length({x}) END"
    listed = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    ending = lambda suffixes: f"regexp_extract(w, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$', 1)"
    chosen = lambda table: "CASE found " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " ELSE '' END"
    short = _SHORT
    begin = f"regexp_extract(w, '^({'|'.join(BEGINNINGS)})', 1)"
    return f"""
s0 AS (SELECT DISTINCT term FROM {terms}),
s1 AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM s0 WHERE regexp_matches(term, '^[a-z]{{3,}}$')),
s2 AS (SELECT term, w, CASE WHEN {begin} <> '' THEN length({begin}) ELSE {after("w")} END AS p1 FROM s1),
s3 AS (SELECT term, w, p1, p1 + {after("substr(w, p1 + 1)")} AS p2 FROM s2),
a1 AS (SELECT *, {ending(("sses", "ied", "ies", "us", "ss", "s"))} AS found FROM s3),
a2 AS (SELECT term, p1, p2, CASE WHEN found = 'sses' THEN {cut(2)} WHEN found IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN {cut(2)} ELSE {cut(1)} END
  WHEN found = 's' AND regexp_matches(w, '[aeiouy].+s$') THEN {cut(1)} ELSE w END AS w FROM a1),
b1 AS (SELECT *, {ending(("eedly", "ingly", "edly", "eed", "ing", "ed"))} AS found FROM a2),
b2 AS (SELECT *, left(w, length(w) - length(found)) AS rest FROM b1),
b3 AS (SELECT term, p1, p2, CASE WHEN w IN {listed(FINAL)} THEN w
  WHEN found IN ('eed', 'eedly') THEN CASE WHEN length(rest) >= p1 THEN rest || 'ee' ELSE w END
  WHEN found <> '' AND regexp_matches(rest, '[aeiouy]') THEN CASE WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e'
    WHEN regexp_matches(rest, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(rest, length(rest) - 1)
    WHEN p1 >= length(rest) AND regexp_matches(rest, '{short}') THEN rest || 'e' ELSE rest END
  ELSE w END AS w, w IN {listed(FINAL)} AS final FROM b2),
c1 AS (SELECT * REPLACE (CASE WHEN final THEN w ELSE regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') END AS w) FROM b3),
d1 AS (SELECT *, {ending(STEP_2)} AS found FROM c1),
d2 AS (SELECT *, left(w, length(w) - length(found)) AS rest FROM d1),
d3 AS (SELECT term, p1, p2, final, CASE WHEN NOT final AND found <> '' AND length(rest) >= p1 AND (found <> 'ogi' OR rest LIKE '%l')
  AND (found <> 'li' OR regexp_matches(rest, '[cdeghkmnrt]$')) THEN rest || {chosen(STEP_2)} ELSE w END AS w FROM d2),
e1 AS (SELECT *, {ending(STEP_3)} AS found FROM d3),
e2 AS (SELECT *, left(w, length(w) - length(found)) AS rest FROM e1),
e3 AS (SELECT term, p1, p2, final, CASE WHEN NOT final AND found <> '' AND length(rest) >= p1 AND (found <> 'ative' OR length(rest) >= p2)
  THEN rest || {chosen(STEP_3)} ELSE w END AS w FROM e2),
f1 AS (SELECT *, {ending(STEP_4)} AS found FROM e3),
f2 AS (SELECT *, left(w, length(w) - length(found)) AS rest FROM f1),
f3 AS (SELECT term, p1, p2, final, CASE WHEN NOT final AND found <> '' AND length(rest) >= p2 AND (found <> 'ion' OR regexp_matches(rest, '[st]$')) THEN rest ELSE w END AS w FROM f2),
g1 AS (SELECT *, left(w, length(w) - 1) AS rest FROM f3),
g2 AS (SELECT term, lower(CASE WHEN NOT final AND right(w, 1) = 'e' AND (length(rest) >= p2 OR (length(rest) >= p1 AND NOT regexp_matches(rest, '{short}'))) THEN rest
  WHEN NOT final AND right(w, 1) = 'l' AND length(rest) >= p2 AND rest LIKE '%l' THEN rest ELSE w END) AS w FROM g1),
stems AS (SELECT term, CASE term {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())} ELSE coalesce(w, term) END AS stem FROM s0 LEFT JOIN g2 USING (term))"""
