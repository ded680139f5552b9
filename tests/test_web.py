"""Tables, summaries, outlines and search forms."""

import pytest

from tidewater.operators.retrieval import SearchSettings
from tidewater.plans import search_form
from tidewater.sources import web


def test_tables(spark):
    html = "<table><tr><th>Id<th>Title</tr><tr><td><a href='/1'>R&amp;1</a></td><td> a <b>b</b></td></tr></table><table></table>"
    assert web.tables(html)[0][1] == [{"text": "R&1", "href": "/1"}, {"text": "a b", "href": None}]
    cells = spark.createDataFrame([(html,), (None,)], "h string").select(web.table_cells("h")).collect()
    assert [(c["column"], c["text"], c["href"]) for c in cells[0][0]] == [("Id", "R&1", "/1"), ("Title", "a b", None)] and cells[1][0] == []


def test_summary_and_outline():
    assert web.summary_block("<h2>What</h2>x<h2>Executive summary</h2><p>a  b</p><h2>Next</h2>c") == "a b"
    assert web.summary_block("<p>only this</p>") == "only this" and web.summary_block(None) is None
    items = [
        {"title": "A", "structured": True, "page": 1},
        [{"title": "B", "structured": True, "page": "ii"}, {"title": "C"}],
        {"title": "D", "structured": True},
    ]
    assert list(web.flatten_outline(items)) == [("A", 1, "1"), ("B", 2, "ii"), ("D", 1, "")]


def test_search_form(spark, tmp_path):
    s = SearchSettings((2001, 2009), ("section",), ("1",), ("TSB",), 0.25)
    assert search_form.from_url(search_form.to_url("/s", "two words", s)) == ("two words", s)
    assert search_form.from_params({}) == ("", SearchSettings())
    with pytest.raises(ValueError):
        search_form.from_params({"from": ["x"]})
    rows = search_form.with_links(spark.createDataFrame([("r 1", 'a "quoted" text')], "report_id string, document string"), "/r")
    assert rows.first()["link"] == '<a href="/r/r+1">r 1</a>'
    search_form.export(rows, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/out").first()["document"] == 'a "quoted" text'
