"""HTML extraction: site templates go, the article's text stays.

Pages become trees. The subtrees of every page are hashed and counted per host in Spark, each once a
page. A subtree that stands on a large share of its host's pages belongs to the site's template and
is deleted from them; inside an article the share must be larger still. Elements whose tags say that
they aren't article text go too. What remains of the articles (or of the main parts, or of the body
where a page has neither) gives the text blocks, in page order.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import drop_written, materialise, table

#: A subtree outside articles is a template from this share of the host's distinct pages on, and so
#: many of them; running text inside an article from these.
SHARE, PAGES = 0.3, 3
SHARE_INSIDE, PAGES_INSIDE = 0.6, 5
#: So many recurring subtrees at most are broadcast; beyond, they are joined.
BROADCAST_KEYS = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no article text wherever they stand.
DROPPED = frozenset(
    "head script style noscript template svg math iframe object canvas audio video nav aside footer form button select textarea input dialog menu search"
    " title datalist".split()
)
#: An article within these isn't the page's article.
ASIDE = frozenset("nav aside footer dialog menu template noscript".split())
#: Running text: no class or id name drops these.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead pre blockquote figcaption caption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status toolbar".split())
#: Names of classes and ids: what they hold isn't article text, outside articles also as the last part of a name.
_NAMES = (
    "ads?|adverts?|advertisements?|adsense|sponsored|sponsors?|promos?|banners?|cookies?|consent|gdpr|notices?|sidebars?|menus?|nav|navbar|navigation"
    "|breadcrumbs?|footer|masthead|share|sharing|related|recommended|newsletters?|subscribe|signup|popups?|modals?|widgets?|toolbars?|pagination|pager"
    "|login|copyright|disclaimer|paywall|trending|teasers?"
)
_CLASS_INSIDE = re.compile(rf"(?i)(?:^|\s)(?:{_NAMES})(?:$|\s)")
_CLASS_OUTSIDE = re.compile(rf"(?i)(?:^|[\s_-])(?:{_NAMES}|header|topbar)(?:$|\s)|(?:^|\s)(?:ads?|advert|cookie)[_-]")
_COMMENTS = re.compile(
    r"(?i)(?:^|\s)(?:(?:user|reader|visitor)[_-]?)?(?:comments?|disqus)(?:[_-](?:area|list|section|thread|box|wrapper|container))?(?:$|\s)|(?:^|\s)respond(?:$|\s)",
)
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
#: What a tag's name and one attribute look like; elements whose content is no markup, and their end tags.
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?)?""")
_RAW = {t: re.compile(rf"(?i)</{t}(?=[\s/>])") for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
_UNCLOSED = re.compile(r"""\s*=\s*["']""")
#: Start tags that end an open paragraph, and those that may stand in the head.
ENDS_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "legend", "option", "optgroup"}
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: For a start tag: the open elements that it ends, and what keeps it from reaching them.
_ITEMS, _CELLS, _ROWS, _PARTS = ("li",), ("td", "th"), ("tr",), ("tbody", "thead", "tfoot")
ENDS = {
    "li": (_ITEMS, "list"), "dt": (("dt", "dd"), "list"), "dd": (("dt", "dd"), "list"), "option": (("option",), "text"), "optgroup": (("optgroup", "option"), "text"),
    "td": (_CELLS, "row"), "th": (_CELLS, "row"), "tr": (_ROWS, "table"), "tbody": (_PARTS, "table"), "thead": (_PARTS, "table"), "tfoot": (_PARTS, "table"),
}
BARRIERS = {
    "text": frozenset("table td th caption button object template".split()),
    "list": BLOCKS - {"address", "div", "p", "li", "dd", "dt", "html", "body"},
    "row": frozenset(("table", "tr")),
    "table": frozenset(("table",)),
    "end": frozenset("td th article main table body".split()),
}
#: End tags that reach through cells and sections.
STRUCTURAL = frozenset("body html article main section div table".split())


class Node:
    __slots__ = ("tag", "drop", "named", "named_inside", "comments", "parts", "core", "key", "letters", "linked", "links")

    def __init__(self, tag: str, attributes: list[tuple[str, str | None]]):
        self.tag, self.parts, self.core, self.key, self.letters, self.linked, self.links = tag, [], False, 0, 0, 0, 0
        self.drop, self.comments, self.named, self.named_inside = tag in DROPPED, False, False, False
        for name, value in attributes:
            if not value and name != "hidden":
                continue
            if name in ("class", "id"):
                if tag not in PROSE:
                    self.comments |= bool(_COMMENTS.search(value))
                    self.named |= bool(_CLASS_OUTSIDE.search(value))
                    self.named_inside |= bool(_CLASS_INSIDE.search(value))
            elif name == "role":
                self.drop |= value.lower() in ROLES
                self.core |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                self.drop = True
        if tag in ("html", "body"):
            self.drop = self.named = self.comments = False
        if tag in ("article", "main"):
            self.drop, self.core = self.comments, not self.comments


def feed(html: str, on_start, on_end, on_text) -> None:
    """Cuts a page into tags and texts as browsers do, going over it once: a comment, tag or script
    that is never closed reaches to the end of the page."""
    at, end = 0, len(html)
    while at < end:
        opening = html.find("<", at)
        if opening < 0 or opening + 1 == end:
            on_text(unescape(html[at:]))
            return
        if opening > at:
            on_text(unescape(html[at:opening]))
        c = html[opening + 1]
        if c.isascii() and c.isalpha():
            name = _NAME.match(html, opening + 1)
            tag, at, attributes = name[0].lower(), name.end(), []
            while found := _ATTRIBUTE.match(html, at):
                at = found.end()
                if found[1] is None:
                    break
                if _UNCLOSED.match(html, at):
                    return
                value = found[2] if found[2] is not None else found[3] if found[3] is not None else found[4]
                attributes.append((found[1].lower(), unescape(value) if value and "&" in value else value))
            if at >= end:
                return
            closed = html[at - 1] == "/"
            at += 1
            on_start(tag, attributes, closed)
            if tag in _RAW:
                if (last := _RAW[tag].search(html, at)) is None:
                    on_text(html[at:])
                    return
                on_text(html[at : last.start()])
                at = last.start()
            continue
        if c == "/" and opening + 2 < end and html[opening + 2].isascii() and html[opening + 2].isalpha():
            on_end(_NAME.match(html, opening + 2)[0].lower())
            close = html.find(">", opening)
        elif html.startswith("<!--", opening):
            close = html.find("-->", opening + 2)
            close = close if close < 0 else close + 2
        elif c in "!?/":
            close = html.find(">", opening)
        else:
            on_text("<")
            close = opening
        if close < 0:
            return
        at = close + 1


class Builder:
    """The tree of one page: open elements on a stack, missing end tags as browsers imply them.
    `open` has the depths of the open elements by tag and `walls` those of the barriers by kind, so
    that no tag has to look through the stack: the work is in proportion to the page."""

    def __init__(self):
        self.root = Node("html", [])
        self.stack = [self.root]
        self.open: dict[str, list[int]] = defaultdict(list)
        self.walls: dict[str, list[int]] = {kind: [0] for kind in BARRIERS}

    def push(self, node: Node) -> None:
        depth = len(self.stack)
        self.stack.append(node)
        self.open[node.tag].append(depth)
        for kind, tags in BARRIERS.items():
            if node.tag in tags:
                self.walls[kind].append(depth)

    def shut(self, depth: int) -> None:
        """Closes the elements from `depth` on; their keys cover names and texts below them."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.open[node.tag].pop()
            for kind, tags in BARRIERS.items():
                if node.tag in tags:
                    self.walls[kind].pop()
            self.sum_up(node)
            self.stack[-1].core |= node.core and not node.comments and self.stack[-1].tag not in ASIDE

    @staticmethod
    def sum_up(node: Node) -> None:
        said = [node.tag]
        for part in node.parts:
            if isinstance(part, str):
                flat = " ".join(part.split())
                if flat:
                    said.append(flat)
                    node.letters += len(flat)
            else:
                said.append(format(part.key, "x"))
                node.letters += part.letters
                node.linked += part.letters if part.tag == "a" else part.linked
                node.links += part.tag == "a" or part.links
        node.key = xxhash.xxh64_intdigest("\x00".join(said).encode("utf-8", "surrogatepass"))

    def end_open(self, tags: tuple[str, ...], kind: str) -> None:
        """Closes the outermost open element of `tags` that stands within the last barrier."""
        wall = self.walls[kind][-1]
        if inner := [depths for t in tags if (depths := self.open.get(t)) and depths[-1] > wall]:
            self.shut(min(depths[-1] for depths in inner))

    def start(self, tag: str, attributes: list, closed: bool) -> None:
        if tag in ("html", "body") and (tag == "html" or self.open["body"]):
            return
        if self.open["head"] and tag not in IN_HEAD:
            self.shut(self.open["head"][0])
        if tag in ENDS_P:
            self.end_open(("p",), "text")
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        node = Node(tag, attributes)
        self.stack[-1].parts.append(node)
        if tag not in VOID and not (closed and tag not in BLOCKS and tag not in _RAW):
            self.push(node)
        else:
            self.sum_up(node)

    def end(self, tag: str) -> None:
        if (depths := self.open.get(tag)) and (tag in STRUCTURAL or depths[-1] >= self.walls["end"][-1]):
            self.shut(depths[-1])

    def text(self, data: str) -> None:
        if self.stack[-1].tag == "head" and data.strip():
            self.shut(len(self.stack) - 1)
        self.stack[-1].parts.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; null and empty pages have an empty one."""
    builder = Builder()
    if html:
        feed(html, builder.start, builder.end, builder.text)
    builder.shut(1)
    builder.sum_up(builder.root)
    return builder.root


def host_of(url: str | None) -> str:
    """What follows the first `://` up to `/`, `?`, `#` or the end, lower-cased; else empty."""
    _, found, rest = (url or "").partition("://")
    return re.match(r"[^/?#]*", rest)[0].lower() if found else ""


def host_key(host: str, key: int, inside: bool = False) -> int:
    """One signed number for a subtree on a host, outside or inside articles."""
    return xxhash.xxh64_intdigest(f"{key:x}{'i' if inside else 'o'} {host}") - (1 << 63)


def goes(node: Node, inside: bool, whole: int) -> bool:
    """Whether tag, role or name drop an element. A name or a form around half of the page's `whole`
    letters or more is its frame and no part of it; nothing that holds the article is dropped."""
    if node.comments:
        return True
    if node.core:
        return False
    if node.drop and node.tag != "form":
        return True
    if node.tag == "header" and not inside:
        return True
    return (node.tag == "form" or (node.named_inside if inside else node.named)) and 2 * node.letters < whole


def candidate(node: Node, parent: Node, inside: bool) -> bool:
    """Whether an element may be part of a template: it has text but not the article, and isn't a
    phrase within a paragraph."""
    return node.letters > 0 and not node.core and (node.tag in BLOCKS or (not inside and parent.tag not in PROSE and parent.tag in BLOCKS))


def is_list_of_links(node: Node) -> bool:
    """Three links or more that hold most of the text: outside articles, a menu."""
    return node.tag in ("ul", "ol", "div", "table", "section") and node.links >= 3 and node.linked >= 0.8 * node.letters


def subtrees(root: Node) -> Iterator[tuple[Node, bool]]:
    """The elements that may belong to a template, each with whether it stands inside an article."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        for part in node.parts:
            if isinstance(part, str) or goes(part, inside, root.letters):
                continue
            if candidate(part, node, inside):
                yield part, inside
            todo.append((part, inside or part.tag in ("article", "main")))


def text_blocks(root: Node, is_template) -> list[str]:
    """The blocks of the article in page order; `is_template(key, inside)` tells which subtrees go."""
    gone = lambda node, parent, inside: goes(node, inside, root.letters) or (candidate(node, parent, inside) and is_template(node.key, inside))
    articles, mains, todo = [], [], [(root, False)]
    while todo:  # depth first, in page order
        node, in_main = todo.pop()
        if node.core and node.tag not in ("html", "body"):
            if node.tag == "article":
                articles.append(node)
                continue
            if not in_main and (node.tag == "main" or not any(isinstance(x, Node) and x.core for x in node.parts)):
                mains.append(node)
                in_main = True
        todo.extend((x, in_main) for x in reversed(node.parts) if isinstance(x, Node) and x.core and not gone(x, node, False))
    found = articles or mains
    whole = not found
    blocks: list[str] = []
    pieces: list[str] = []

    def end_block() -> None:
        flat = " ".join("".join(pieces).split())
        if flat:
            blocks.append(flat)
        pieces.clear()

    for top in found or [root]:
        work: list = [(top, None)]
        while work:
            part, parent = work.pop()
            if part is None:
                end_block()
            elif isinstance(part, str):
                pieces.append(part)
            elif part.tag in ("br", "img", "wbr"):
                pieces.append(" " if part.tag == "br" else "")
            elif part is not top and (gone(part, parent, not whole) or (whole and is_list_of_links(part))):
                if part.tag in BLOCKS:
                    end_block()
            else:
                if part.tag in BLOCKS:
                    end_block()
                    work.append((None, None))
                work.extend((x, part) for x in reversed(part.parts))
        end_block()
    return blocks


def recurring(pages: DataFrame, share: float = SHARE, at_least: int = PAGES, share_inside: float = SHARE_INSIDE, at_least_inside: int = PAGES_INSIDE) -> DataFrame:
    """Column k: the keys of the subtrees that stand on a `share` of the distinct pages of their host
    and on `at_least` of them; inside articles the other two count. Pages of one and the same html
    count once. A host's page is known by a row without a subtree."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple[int, int, int, int]] = []
            for url, html in zip(b["url"], b["html"], strict=True):
                host, root = host_of(url), parse(html)
                h, page = xxhash.xxh64_intdigest(host) - (1 << 63), root.key - (1 << 63)
                rows.append((h, 2, h, page))
                rows.extend((h, int(inside), k, page) for inside, k in {(inside, host_key(host, n.key, inside)) for n, inside in subtrees(root)})
            yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, 4), columns=["h", "kind", "k", "p"])

    each = pages.select("url", "html").mapInPandas(emit, "h long, kind long, k long, p long").groupBy("h", "kind", "k", "p").agg(F.lit(1).alias("one"))
    counted = materialise(
        each.groupBy("kind", "k").agg(F.any_value("h").alias("h"), F.count("one").alias("n")).filter(
            F.col("n") >= F.when(F.col("kind") == 2, 1).otherwise(min(at_least, at_least_inside)),
        ),
        "subtree-counts",
    )
    hosts = counted.filter("kind = 2").select(F.col("k").alias("h"), F.col("n").alias("pages"))
    inside = F.col("kind") == 1
    often = (F.col("n") >= F.when(inside, at_least_inside).otherwise(at_least)) & (F.col("n") >= F.when(inside, share_inside).otherwise(share) * F.col("pages"))
    found = materialise(counted.filter("kind < 2").join(hosts, "h").filter(often).select("k"), "templates")
    drop_written(counted)
    return found


def extract(pages: DataFrame, most: int = BROADCAST_KEYS, **limits) -> DataFrame:
    """Adds text and n_chars to pages of (page_id, url, html); columns of those names are replaced.
    `limits` are those of `recurring`.

    Null and empty pages, and pages without article text, give the empty string. Html is parsed
    whole, broken markup as browsers do in the common cases. Pages without a host in their url are
    one host together. One row in, one row out; repeated rows give the same text.
    """
    keys = recurring(pages, **limits)
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    if keys.count() <= most:
        held = pages.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column("k").to_numpy()))
        drop_written(keys)

        @F.pandas_udf("string")
        def own(urls: pd.Series, htmls: pd.Series) -> pd.Series:
            known, out = held.value, []

            def is_known(key: int) -> bool:
                return len(known) > 0 and bool(known[min(np.searchsorted(known, key), len(known) - 1)] == key)

            for url, html in zip(urls, htmls, strict=True):
                host = host_of(url)
                out.append("\n".join(text_blocks(parse(html), lambda key, inside, h=host: is_known(host_key(h, key, inside)))))
            return pd.Series(out, dtype=object)

        out = pages.select(*kept, own("url", "html").alias("text"))
    else:
        out = _extract_joined(pages, keys, kept)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _extract_joined(pages: DataFrame, keys: DataFrame, kept: list[str]) -> DataFrame:
    """For many recurring subtrees: each distinct page meets its own keys in a shuffled join."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, h, host_key(host_of(u), n.key, inside)) for u, h in zip(b["url"], b["html"], strict=True) for n, inside in subtrees(parse(h))]
            if rows:
                yield pd.DataFrame({"_page": [xxhash.xxh128_hexdigest(f"{u}\x00{h}") for u, h, _ in rows], "k": np.array([k for _, _, k in rows], np.int64)})

    pairs = pages.select("url", "html").distinct().mapInPandas(emit, "_page string, k long")
    found = materialise(pairs.join(keys, "k", "left_semi").groupBy("_page").agg(F.collect_set("k").alias("_keys")), "page-templates")

    @F.pandas_udf("string")
    def page_of(urls: pd.Series, htmls: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh128_hexdigest(f"{u}\x00{h}") for u, h in zip(urls, htmls, strict=True)])

    @F.pandas_udf("string")
    def own(urls: pd.Series, htmls: pd.Series, sets: pd.Series) -> pd.Series:
        out = []
        for url, html, held in zip(urls, htmls, sets, strict=True):
            host, known = host_of(url), frozenset() if held is None else frozenset(held.tolist())
            out.append("\n".join(text_blocks(parse(html), lambda key, inside, h=host, s=known: host_key(h, key, inside) in s)))
        return pd.Series(out, dtype=object)

    joined = pages.withColumn("_page", page_of("url", "html")).join(found, "_page", "left")
    return joined.select(*kept, own("url", "html", "_keys").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
