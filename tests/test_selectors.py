"""Selector rules on nested and broken markup, by site."""

import random

import pytest

from tidewater.sources import selectors
from tidewater.sources.selectors import Automaton, Rule, compounds, fields, read

PAGE = """<!DOCTYPE html><html lang=en><head><title> A &amp; B </title><style>p{x}</style></head><body>
<div class="field field--name-title x"><div class="field__item">First <b>item</b></div><div class=field__item>second</div></div>
<div id=main class="field"><p>one<p>two <i>deep<p>three</div>
<ul><li>a<li><a href="/x?a=1&amp;b=2">b</a><ul><li>inner</ul><li>c</ul>
<table><tr><td>1<td>2<tr><td class="n">3</table><img src=pic.png alt="">
<script>var t = "</p><h1>no</h1>";</script><h1 data-kind="big one">Head</h1></i></section><p>never closed <span>end"""


def got(*rules, html=PAGE):
    return list(read(Automaton([Rule("", *r) for r in rules]), html))


def test_selectors():
    one = lambda *r: [v for _, v in got(("f", *r))]
    assert one("title") == ["A & B"] and one("head > title") == ["A & B"] and one("body > title") == []
    assert one("html[lang]", "lang") == ["en"] and one("html[lang=en]", "lang") == ["en"] and one("html[lang=de]", "lang") == []
    assert one("div.field--name-title .field__item") == ["First item"] and one("div.field.x > div", "text", True) == ["First item\nsecond"]
    assert one("#main p", "text", True) == ["one\ntwo deep\nthree"] and one("div#main.field > p") == ["one"]
    assert one("ul > li", "text", True) == ["a\nbinner\ninner\nc"] and one("ul ul li") == ["inner"] and one("ul > ul") == []
    assert one("a[href]", "href") == ["/x?a=1&b=2"] and one("img[src]", "src") == ["pic.png"] and one("img[alt]", "alt") == []
    assert one("tr td", "text", True) == ["1\n2\n3"] and one("td.n") == ["3"]
    assert one('h1[data-kind="big one"]') == ["Head"] and one("script") == [] and one("h1", "text", True) == ["Head"]
    assert one("p > span") == ["end"] and one("*.n") == ["3"] and one("span", "title") == []


def test_all_rules_in_one_pass():
    assert got(("a", "td", "text", True), ("b", "title"), ("a", "h1"), ("none", "h9")) == [("a", "1\n2\n3"), ("b", "A & B"), ("a", "Head")]
    assert got(("a", "p"), html=None) == got(("a", "p"), html="") == got(html=PAGE) == []
    assert got(("a", "p"), ("b", "p b"), html="<p>x</b></i></p></p><p>y") == [("a", "x")]
    assert got(("a", "p"), html="<p>" * 3000 + "deep" + "</div>" * 3000) == [("a", "deep")]


def test_not_selectors():
    for bad in ("", " ", ">", "a >", "> a", "a > > b", "a..b", "a[", "a:hover", "1a"):
        with pytest.raises(ValueError):
            compounds(bad)


def plain(tree, path):
    """Texts of the elements of a tree that a selector fits, by trying all ways up."""

    def fits(ancestors, k):
        if k < 0:
            return True
        upper = ancestors[:-1]
        if not path[k].fits(ancestors[-1][0], {"class": ancestors[-1][1]}, frozenset(ancestors[-1][1].split())):
            return False
        if k == 0:
            return True
        ways = [upper] if path[k].below else [upper[:n] for n in range(len(upper), 0, -1)]
        return any(w and fits(w, k - 1) for w in ways)

    out = []

    def walk(node, above):
        here = [*above, node]
        if fits(here, len(path) - 1) and text(node):
            out.append(text(node))
        for child in node[2]:
            if not isinstance(child, str):
                walk(child, here)

    def text(node):
        return "".join(c if isinstance(c, str) else text(c) for c in node[2])

    walk(tree, [])
    return out


def test_against_a_plain_search():
    rng = random.Random(3)

    def grow(depth):
        inner = [f"t{rng.randrange(99)}" if depth > 5 or rng.random() < 0.3 else grow(depth + 1) for _ in range(rng.randint(0 if depth else 2, 3))]
        return (rng.choice(["b", "i", "u"]), rng.choice(["", "x", "y", "x y"]), inner)

    written = lambda n: n if isinstance(n, str) else f'<{n[0]} class="{n[1]}">{"".join(map(written, n[2]))}</{n[0]}>'
    simple = ["b", "i", "u", ".x", "b.y", "*", "i.x.y"]
    for _ in range(150):
        tree = grow(0)
        rules = ["".join(rng.choice(simple) + rng.choice([" ", " > "]) for _ in range(rng.randint(0, 3))) + rng.choice(simple) for _ in range(4)]
        found = got(*((str(k), r, "text", True) for k, r in enumerate(rules)), html=written(tree))
        assert found == [(str(k), "\n".join(w)) for k, r in enumerate(rules) if (w := plain(tree, compounds(r)))]


def test_rules_by_site(spark, monkeypatch):
    rows = [("", "t", "title", None, None), ("b.org", "h", "h1", None, None), ("a.b.org", "h", "p", "text", True), ("B.org", "c", "p", "class", False)]
    rules = selectors.rules_from(spark.createDataFrame(rows, "site string, field string, selector string, take string, every boolean"))
    html = "<title>T</title><h1>H</h1><p class=k>P<p>Q"
    urls = ["http://b.org/x", "HTTPS://x.A.B.org?p", "http://bb.org/", None, "no scheme", "http://b.org#://a.b.org/"]
    pages = spark.createDataFrame([(i, u, html, "clash", "clash") for i, u in enumerate(urls)] + [(9, "http://b.org", None, "x", "x"), (9, "http://b.org", "", "x", "x")], "page_id int, url string, html string, field string, value string")
    out = {}
    for r in fields(pages, rules).collect():
        out.setdefault(r["page_id"], []).append((r["field"], r["value"]))
    b = [("t", "T"), ("c", "k"), ("h", "H")]
    assert out == {0: b, 1: [("t", "T"), ("h", "P\nQ")], 2: [("t", "T")], 3: [("t", "T")], 4: [("t", "T")], 5: b}
    assert fields(pages.filter("1 = 0"), rules).count() == 0 and fields(pages, []).count() == 0
    monkeypatch.setattr(selectors, "MOST_RULES", 3)
    with pytest.raises(ValueError):
        selectors.rules_from(spark.createDataFrame(rows, "site string, field string, selector string, take string, every boolean"))
