"""The registered corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, codebook, decontam, embdedup, html, jaccard, langid, linededup, piece, quality, toxicity, urlfilter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.query,
        "op2_html": html.query,
        "op3_bpe": bpe.query,
        "op4_langid": langid.query,
        "op9_toxicity": toxicity.query,
        "op5_decontaminate": decontam.query,
        "op8_line_dedup": linededup.query,
        "op6_embedding_dedup": embdedup.query,
        "op10_ngram_jaccard": jaccard.query,
        "op7_url_filter": urlfilter.query,
        "op11_whitening": whitening.query,
        "op12_vector_codes": codebook.query,
        "op13_sentencepiece": piece.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": decontam.ORACLE, "op7_url_filter": urlfilter.ORACLE, "op8_line_dedup": linededup.ORACLE, "op12_vector_codes": codebook.ORACLE}
