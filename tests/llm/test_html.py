"""HTML extraction: constructed hosts against what they were made of, page order, broken and odd pages."""

import random
import re
import time
from collections import defaultdict
from html import unescape

import pytest

from tidewater.llm import html

SMALL = "/root/testdata/sf0.01"


def plain(page):
    return html.text_blocks(html.parse(page), lambda key, inside: False)


def site(host, n, rng, inside=False):
    """Pages of one host with boilerplate under neutral names, and the text each was made of."""
    words = [f"w{k}" for k in range(5000)]
    said = lambda: " ".join(rng.choices(words, k=rng.randrange(4, 30)))
    top, links, box, last, note = said(), said(), said(), said(), said()
    rows = []
    for i in range(n):
        own = [said() for _ in range(rng.randrange(1, 5))]
        text = "".join(f"<p>{x}</p>" for x in own)
        if inside:
            body = f"<div>{top}</div><article>{text}<p>{note}</p></article><div>{last}</div>"
        else:
            body = f"<div><span>{top}</span><div class=c1><p>{links}</div></div><div class=c2>{text}</div><section><p>{box}</p><p>{rng.random()}</p></section><div>{last}</div>"
            own.append("")
        rows.append((f"https://{host}/{i}", f"<html><body>{body}</body></html>", own))
    return rows


def test_templates_decide_on_constructed_hosts(spark):
    rng = random.Random(3)
    sites = {h: site(h, n, rng, inside) for h, n, inside in (("a.net", 40, False), ("b.net", 9, False), ("c.net", 4, False), ("d.net", 30, True), ("e.net", 2, False))}
    rows = [(k, url, page, "\n".join(own)) for k, (url, page, own) in enumerate(x for s in sites.values() for x in s)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    # By brute force: what each distinct page of a host holds, counted in plain sets.
    places, sizes = defaultdict(set), defaultdict(set)
    for _, url, page, _ in rows:
        root = html.parse(page)
        sizes[html.host_of(url)].add(root.key)
        for node, inside in html.subtrees(root):
            places[html.host_of(url), inside, node.key].add(root.key)

    def is_template(host):
        def known(key, inside):
            n, share, least = len(places[host, inside, key]), *((html.SHARE_INSIDE, html.PAGES_INSIDE) if inside else (html.SHARE, html.PAGES))
            return n >= least and n >= share * len(sizes[host])

        return known

    assert got == {k: "\n".join(html.text_blocks(html.parse(page), is_template(html.host_of(url)))) for k, url, page, _ in rows}
    for k, url, _, text in rows:
        lines = got[k].split("\n")
        if "e.net" in url:  # two pages tell nothing of a template
            assert set(text.split("\n")) - {""} <= set(lines) and len(lines) > len(text.split("\n"))
        else:
            assert [x for x in lines if x.startswith("w")] == [x for x in text.split("\n") if x]
    off = {r["page_id"]: r["text"] for r in html.extract(pages, share=2.0, share_inside=2.0).collect()}
    assert all(off[k] != got[k] for k, url, *_ in rows if "e.net" not in url)
    joined = {r["page_id"]: r["text"] for r in html.extract(pages, most=0).collect()}
    assert joined == got


def test_frequent_sentences_stay(spark):
    rows = [(i, f"http://big.org/{i}", f"<article><p>one {i}</p>" + "<p>often said</p>" * (i % 4 == 0) + "</article>") for i in range(80)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: f"one {i}" + "\noften said" * (i % 4 == 0) for i in range(80)}


def test_page_order():
    assert plain("<article><p>first</p></article>x<article><p>second</p></article><article>third</article>") == ["first", "second", "third"]
    assert plain("<main>one</main>x<main>two</main>") == ["one", "two"]
    assert plain("<main>a<div role=main>b</div></main>") == ["a", "b"]
    assert plain("<aside><article>teaser</article></aside><article>real<article>inner</article></article>") == ["real", "inner"]


def test_names_drop_no_running_text():
    assert plain('<article><div class="social-history"><p>Real text.</p></div></article>') == ["Real text."]
    assert plain('<article><p id="search">a</p><h2 class="section-header">b</h2><p class="ad">c</p></article>') == ["a", "b", "c"]
    assert plain('<article>a<div class="ad">x</div><section id="comments"><p>y</section><aside>z</aside><form>f</form></article>') == ["a"]
    assert plain('<div class="page-with-sidebar"><p>the whole page</p></div><p>b</p>') == ["the whole page", "b"]
    assert plain(
        '<p>a long enough page</p><div class="site-footer">x</div><div class="cookie-box">y</div><nav>z</nav><header>h</header>',
    ) == ["a long enough page"]
    assert plain("<form><div>a page within a form</div></form><p>b</p>") == ["a page within a form", "b"]


def test_markup():
    assert plain("<p>a &lt; b <3 &amp;lt; &copy &#8364;<br>c<b>d</b>\n e<p/>f<!-- x -->g<!y>h<?z?>i<img alt='>'>j") == ["a < b <3 &lt; © € cd e", "fghij"]
    assert plain("<ul><li>a<li>b<ul><li>c</ul></ul><dl><dt>d<dd>e</dl><table><tr><td>f<td>g<tr><th>h</table>") == list("abcdefgh")
    assert plain("<title>t</title><script>if (a</b>) '</p>'</script ><style>p{}</style>u") == ["u"]
    assert plain("<p>a<a href=\"x>y\" title='>'>b</a></p></p></div><p>c") == ["ab", "c"]


@pytest.mark.parametrize("piece", ["</i>", "<b>", "<b><td></b>", "<p><b><br>", "<!--", "<a ", "</", "<", '<a b="', "<li>", "<table><tr><td>", "<script>", "<div>"])
def test_broken_pages_take_time_in_proportion(piece):
    start = time.process_time()
    plain("<p>x" + piece * 10_000)
    assert time.process_time() - start < 2


def test_fixture_articles(spark):
    want = {}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in html.query(spark, SMALL).collect()} == want


def test_edges(spark):
    rows = [(1, None, None), (2, "http://h/x", ""), (3, "http://h/y", "<p>plain &amp; simple"), (4, "h", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    rows += [
        (5, "http://h/z", "<article><h1>T</h1><script>x</script><p>a<br>b</p><div class='comments'>no</div></article><nav>menu</nav>"),
        (6, None, "<p>long " + "word " * 300_000),
    ]
    pages = spark.createDataFrame([(*r, "clash", 0) for r in rows + rows[2:3]], "page_id int, url string, html string, text string, k int")
    out = html.extract(pages)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.columns == ["page_id", "url", "html", "k", "text", "n_chars"] and out.count() == 7
    assert got.pop(6)[1] == 1_500_004
    assert got == {1: ("", 0), 2: ("", 0), 3: ("plain & simple", 14), 4: ("deep", 4), 5: ("T\na b", 5)}
    assert html.extract(pages.filter("1 = 0")).count() == 0
    same = spark.createDataFrame([(i, "http://h/same", "<div>one page</div>") for i in range(20)], "page_id int, url string, html string")
    assert {r["text"] for r in html.extract(same).collect()} == {"one page"}
