"""A corpus pipeline: documents in a known language, without boilerplate lines, near duplicates and
benchmark passages, as token ids. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, decontam, jaccard, langid, linededup
from tidewater.llm.common import drop_written, materialise, scratch, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", linededup.stage),
    ("ngram_jaccard", jaccard.stage),
    ("decontaminate", decontam.stage),
    ("bpe", bpe.stage),
]

#: SQL can express neither the language prototypes nor BPE; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again by the next.

    When a stage's result is written, its input and whatever it wrote on the way are deleted: only
    the last result stays. Null and empty texts go with the first stage, repeated rows with the
    third; what else a stage does with odd rows its function says. No documents give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        with scratch(spark):
            out = stage(spark, before, sf_dir)
            docs = materialise(out, name, keep=True)
        if k:
            drop_written(before)
    return docs
