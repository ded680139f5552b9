"""The pipeline's stages against brute force on the smallest documents."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_lines import cut as cut_lines
from tidewater.llm import bpe, common, langid

TINY = "/root/testdata/sf0.001"


def bundle(text):
    """A text's unit vector, gram by gram: bound letters, each rolled by its place, by the root of the count."""
    letters, grams, symbols = langid._letters(langid.DIMENSIONS).astype(float), {}, [0]
    for c in text.lower():
        s = 0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (langid.SYMBOLS - 27)
        if s or symbols[-1]:
            symbols.append(s)
    symbols += [0] * bool(symbols[-1])
    for g in zip(symbols, symbols[1:], symbols[2:], strict=False):
        grams[g] = grams.get(g, 0) + 1
    if not grams:
        return None
    vector = sum(np.sqrt(n) * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for (a, b, c), n in grams.items())
    return vector / np.linalg.norm(vector)


def profiles(rows):
    sums = {}
    for r in rows:
        if r["lang"] is not None and r["text"] and (v := bundle(r["text"])) is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + v
    langs = sorted(sums)
    return langs, np.array([sums[x] / np.linalg.norm(sums[x]) for x in langs])


def nearest(text, langs, prototypes):
    vector = bundle(text) if text else None
    if vector is None:
        return "und", 0.0
    cosines = prototypes @ vector
    return langs[int(cosines.argmax())], max(0.0, float(cosines.max()))


def test_langid_query_against_plain_profiles(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    langs, prototypes = profiles([r for i, r in docs.items() if zlib.crc32(str(i).encode()) % 5])
    for r in langid.query(spark, TINY).collect():
        lang, score = nearest(docs[r["doc_id"]]["text"], langs, prototypes)
        assert (r["lang_pred"], r["held_out"]) == (lang, zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and abs(r["score"] - score) < 1e-4


@pytest.fixture
def tables(spark, tmp_path):
    """Writes documents with odd rows and a benchmark to a folder."""

    def write(rows):
        shape = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, lang_pred string, k int, rest string"
        spark.createDataFrame([(i, t, lang, "src0", 0, 0.5, "x", "und", 1, "y") for i, t, lang in rows], shape).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(
            [(1, "the lazy dog runs home again and the quick brown fox jumps over it"), (2, None)],
            "item_id long, text string",
        ).write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_odd_rows_and_foreign_documents(spark, tables):
    english = [(100 + i, f"the quick brown fox number {'xyzvwuts'[i % 8] * (1 + i // 8)} jumps over the lazy dog and runs home again", "en") for i in range(20)]
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !?", None), (4, "Это русский текст, которого никто не учил, и он уходит из собрания", None)]
    rows += [(5, "a line about the lazy dog and the brown fox that stays here", None)] * 2 + [(None, "no id but the quick dog jumps over the fox", "en")]
    rows += [
        (6, "the lazy dog runs home again and the quick brown fox jumps over it", "en"),
        (7, "the dog said " + "and the fox over the home again " * 30_000, "en"),
    ]
    folder = tables(english + rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = langid.stage(spark, docs, folder)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {5, 6, 7, None} and not {r["doc_id"] for r in kept.collect()} & {1, 2, 3, 4}
    assert {r["lang"] for r in kept.collect()} == {"en"} and {r["score"] for r in kept.collect()} == {0.5}
    langs, prototypes = langid.learn(docs)
    assert langid.select(docs, langs, prototypes, wanted=["fr"]).count() == 0 and langid.select(docs, langs, prototypes, least=1.1).count() == 0
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()]
    assert got.count(5) == 1 and None in got and 7 in got and not set(got) & {1, 2, 3, 4, 6}


def test_no_documents(spark, tables):
    assert corpus_pipeline.run(spark, tables([])).count() == 0


def test_only_the_result_stays(spark):
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, TINY)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("bpe-") and out.count() > 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "bpe"]
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    # Languages by plain profiles of the same sample (all rows of the other folds, fewer than its bound).
    langs, prototypes = profiles([r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5])
    found = {i: nearest(t, langs, prototypes) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if found[i][1] >= langid.LEAST_SCORE}
    rows = dict(zip(rows, (x[0] for x in cut_lines(list(rows.values()))), strict=True))
    words = {i: t.split() for i, t in ((i, re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in rows.items())}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    kept, group = [], {}
    for i in sorted(sets):
        near = {group[j] for j in group if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
        group[i] = min(near, default=i)
        for j in group:
            if group[j] in near:
                group[j] = group[i]
    kept = [i for i in rows if group[i] == i]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect():
        w = cut(r["text"])
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()

    def contaminated(text):
        w, hit = cut(text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    left = {i: rows[i] for i in kept if not contaminated(rows[i])}
    got = corpus_pipeline.run(spark, TINY).collect()
    codec = bpe.codec(bpe.default_path())
    assert {r["doc_id"] for r in got} == set(left) and len(got) == len(left)
    for r in got:
        assert r["lang"] == found[r["doc_id"]][0]
        assert list(r["token_ids"]) == codec.encode_batch([left[r["doc_id"]]])[0]
        assert r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest()
