"""Replies in YAML: both parsers agree, whole texts come in small batches."""

import pytest
import yaml

from tidewater.functions import replies
from tidewater.plans.shared import BATCH_ROWS

ODD = ['- a: "x\u2028y"\n', '- a: "\\ud83d\\ude00"\n', "- a: \ud800\n", "a\tb: c\n", "- a:\tb\n", "- {a: b, c: 'd\n", "- a: 1:20\n- b: 0x1F\n", "- <<: {x: 1}\n  y: 2\n", "- a: \x07\n", ""]


@pytest.mark.parametrize("text", ODD)
def test_as_the_plain_parser(text):
    def outcome(read):
        try:
            return read(text)
        except yaml.YAMLError:
            return "no YAML"

    assert outcome(replies.read_yaml) == outcome(yaml.safe_load)


def test_plain_texts_go_to_the_c_parser(monkeypatch):
    monkeypatch.setattr(yaml, "safe_load", None)
    assert replies.read_yaml('- a: ["\\u00e9 é"]\n  b:\n') == [{"a": ["é é"], "b": None}]


def test_whole_texts_in_small_batches(spark):
    from pyspark.sql import functions as F

    from tidewater.operators.gathering import summary_of

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.range(1).select(summary_of(F.lit("<h2>a</h2>b"))).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == BATCH_ROWS
