"""Fields of web pages by selectors: all rules of a page's site run in one pass over its tags.

A selector is a row of compounds (`div.field#id[attr=value]`), each inside the one before it, or with
`>` right below it. The rules of a site become one automaton: its state at an element is the set of
selector prefixes that the elements around it fulfil, and a start tag leads to the next state. States
and steps are made when they are first met and kept, so that pages of one build cost a lookup a tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are sent to the tasks at most, and steps that an automaton keeps.
MOST_RULES, MOST_STEPS = 100_000, 200_000
#: Fixed values of HTML: elements without content, and such whose start ends an open one of those listed.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"},
} | {b: {"p"} for b in _BLOCKS}
#: Elements beyond which such an end doesn't reach.
KEEPS = frozenset("ul ol dl table td th select html body article section div".split())
SILENT = frozenset(("script", "style", "template"))
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|[^\]\"']*))?\])*)")
_WORD = re.compile(r">|(?:[^\s>\[]|\[[^\]]*\])+")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|([^\]\"']*)))?\]")


@dataclass(frozen=True)
class Rule:
    """A field of the pages of `site` (a host with all below it; all hosts if empty). `take` is `text`, or
    the attribute whose value is wanted; of several elements the first counts, or all, line by line."""

    site: str
    field: str
    selector: str
    take: str = "text"
    every: bool = False


@dataclass(frozen=True)
class Compound:
    tag: str | None
    id: str | None
    classes: frozenset[str]
    attributes: tuple[tuple[str, str | None], ...]
    below: bool  # right below what the compound before it stands for

    def fits(self, tag: str, attributes: dict[str, str], classes: frozenset[str]) -> bool:
        return (
            (self.tag is None or self.tag == tag)
            and (self.id is None or self.id == attributes.get("id"))
            and self.classes <= classes
            and all(name in attributes and (value is None or attributes[name] == value) for name, value in self.attributes)
        )


def compounds(selector: str) -> list[Compound]:
    """ValueError for what isn't a selector."""
    out, below = [], False
    if _WORD.sub("", selector).strip():
        raise ValueError(f"not a selector: {selector}")
    for word in _WORD.findall(selector):
        if word == ">":
            if below or not out:
                raise ValueError(f"not a selector: {selector}")
            below = True
            continue
        m = _COMPOUND.fullmatch(word)
        if not m or not word:
            raise ValueError(f"not a selector: {selector}")
        ids, classes, attributes = [], set(), []
        for mark, name, attribute, *values in _PART.findall(m[2]):
            if mark:
                (ids.append if mark == "#" else classes.add)(name)
            else:
                attributes.append((attribute.lower(), next((v for v in values if v), "") if "=" in m[2] and re.search(rf"\[{re.escape(attribute)}=", m[2]) else None))
        tag = None if m[1] in (None, "", "*") else m[1].lower()
        out.append(Compound(tag, ids[-1] if ids else None, frozenset(classes), tuple(attributes), below))
        below = False
    if not out or below:
        raise ValueError(f"not a selector: {selector}")
    return out


class Automaton:
    """Of some rules: states are numbers, 0 that outside of all elements."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.paths = rules, [compounds(r.selector) for r in rules]
        every = [c for path in self.paths for c in path]
        self.tags, self.ids = {c.tag for c in every}, {c.id for c in every}
        self.classes = frozenset().union(*[c.classes for c in every]) if every else frozenset()
        self.attributes = {name: {v for c in every for n, v in c.attributes if n == name} for c in every for name, _ in c.attributes}
        # A state's prefixes: (rule, compounds fulfilled, whether the next must be right below).
        self.states = [frozenset((r, 0, False) for r in range(len(rules)))]
        self.numbers, self.steps = {self.states[0]: 0}, {}

    def step(self, state: int, tag: str, attributes: dict[str, str]) -> tuple[int, tuple[int, ...]]:
        """(state within the element, rules that the element fulfils)."""
        classes = self.classes.intersection((attributes.get("class") or "").split())
        told = tuple((n, v if None not in kept or v in kept else None) for n, kept in self.attributes.items() if (v := attributes.get(n)) is not None and (None in kept or v in kept))
        own = attributes.get("id")
        key = (state, tag if tag in self.tags else "", own if own in self.ids else None, classes, told)
        if key not in self.steps:
            if len(self.steps) >= MOST_STEPS:
                self.steps.clear()
            self.steps[key] = self._step(state, tag, attributes, classes)
        return self.steps[key]

    def _step(self, state: int, tag: str, attributes: dict[str, str], classes: frozenset[str]) -> tuple[int, tuple[int, ...]]:
        inside, met = set(), []
        for r, k, below in self.states[state]:
            if not below:
                inside.add((r, k, False))
            if self.paths[r][k].fits(tag, attributes, classes):
                if k + 1 == len(self.paths[r]):
                    met.append(r)
                else:
                    inside.add((r, k + 1, self.paths[r][k + 1].below))
        known = frozenset(inside)
        if known not in self.numbers:
            self.numbers[known] = len(self.states)
            self.states.append(known)
        return self.numbers[known], tuple(sorted(met))


@dataclass
class _Open:
    tag: str
    state: int
    takes: list[tuple[int, list[str]]] = field(default_factory=list)


class _Page(HTMLParser):
    """The values of the rules on one page. An end tag closes what is open inside its element; one
    without an element is passed over; what is never closed reaches to the page's end."""

    def __init__(self, automaton: Automaton):
        super().__init__(convert_charrefs=True)
        self.automaton, self.open, self.silent = automaton, [], 0
        self.values: list[list[tuple[int, str]]] = [[] for _ in automaton.rules]
        self.takes, self.order = [], 0

    def handle_starttag(self, tag, attrs):
        if ends := ENDS.get(tag):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag in ends:
                    self.close_to(k)
                    break
                if self.open[k].tag in KEEPS:
                    break
        attributes = {k: v or "" for k, v in reversed(attrs)}
        state, met = self.automaton.step(self.open[-1].state if self.open else 0, tag, attributes)
        here = _Open(tag, state)
        for r in met:
            rule = self.automaton.rules[r]
            self.order += 1
            if rule.take != "text":
                if (value := attributes.get(rule.take)) is not None:
                    self.values[r].append((self.order, value.strip()))
            elif rule.every or not any(x[0] == r for x in self.takes) and not self.values[r]:
                here.takes.append((r, [], self.order))
        if tag not in VOID:
            self.takes += here.takes
            self.open.append(here)
            self.silent += tag in SILENT

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self.close_to(k)
                break

    def handle_data(self, data):
        if not self.silent:
            for _, parts, _ in self.takes:
                parts.append(data)

    def close_to(self, k: int) -> None:
        for gone in reversed(self.open[k:]):
            self.silent -= gone.tag in SILENT
            for take in gone.takes:
                self.takes.remove(take)
                if text := " ".join("".join(take[1]).split()):
                    self.values[take[0]].append((take[2], text))
        del self.open[k:]


def read(automaton: Automaton, html: str | None) -> Iterator[tuple[str, str]]:
    """(field, value) of a page in the rules' order; fields without a value are left out."""
    page = _Page(automaton)
    page.feed(html or "")
    page.close()
    page.close_to(0)
    for rule, values in zip(automaton.rules, page.values, strict=True):
        found = [v for _, v in sorted(values) if v]
        if found:
            yield rule.field, "\n".join(found if rule.every else found[:1])


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, in small letters; '' without."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*(?::(?!//)[^:]*)*://([^/?#]*)", 1))


def rules_from(rows: DataFrame) -> list[Rule]:
    """Rules of a table (site, field, selector, take, every); nulls count as '', `text` and false. More
    than MOST_RULES raise ValueError: their number is that of sites and fields, not of pages."""
    found = rows.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted(
        (Rule((r["site"] or "").lower(), r["field"], r["selector"], r["take"] or "text", bool(r["every"])) for r in found),
        key=lambda r: (r.site, r.field, r.selector, r.take),
    )


def fields(pages: DataFrame, rules: Iterable[Rule], key: str = "page_id") -> DataFrame:
    """(key, field, value): for each page the fields of the rules of its site: of the hosts with rules that
    its host is or lies below the longest one, besides the rules for all. Null pages have none, empty
    values are left out, repeated rows give repeated fields; two rules of one field and site give a value
    each."""
    by_site: dict[str, list[Rule]] = {}
    for r in rules:
        compounds(r.selector)
        by_site.setdefault(r.site, []).append(r)
    held = pages.sparkSession.sparkContext.broadcast(by_site)

    @F.pandas_udf("array<struct<field: string, value: string>>")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, own = held.value, {}
        for hosts, htmls in batches:
            out = []
            for host, html in zip(hosts, htmls, strict=True):
                names = host.split(".")
                site = next((s for k in range(len(names)) if (s := ".".join(names[k:])) in known and s), "")
                if site not in own:
                    own[site] = Automaton([*known.get("", []), *(known[site] if site else [])])
                out.append([{"field": f, "value": v} for f, v in read(own[site], html)])
            yield pd.Series(out, dtype=object)

    return pages.select(key, F.inline(told(host_of(F.col("url")), "html")))
