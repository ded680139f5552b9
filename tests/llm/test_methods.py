"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontam, jaccard, langid, quality, toxicity
from tidewater.llm.common import fold
from tidewater.llm.components import connected_components

SMALL = "/root/testdata/sf0.01"


def components(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_connected_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(3, 3)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = connected_components(spark.createDataFrame([*pairs, (None, 4)], "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in got} == components([p for p in pairs if p[0] != p[1]], nodes) and len(got) == len(nodes)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    codec, library = bpe.codec(bpe.default_path()), Tokenizer.from_file(bpe.default_path())

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60) | st.text("ab 1'\n<|endoftext|>é ", max_size=60))
    def same(text):
        text = text.encode("utf-8", "replace").decode()
        ids = codec.encode_batch([text])[0]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode_batch([ids]) == [library.decode(ids, skip_special_tokens=False)]

    same()
    for long in ("ab" * 3000, "a" * 5000, "thequick" * 700):
        assert codec.encode_batch([long])[0] == library.encode(long, add_special_tokens=False).ids == list(codec.merge_words([long.encode()])[0])


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in bpe.query(spark, SMALL).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decontamination_windows():
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4), st.lists(st.sampled_from("abcd"), max_size=40))
    def same(items, doc):
        window = 4
        words = [x.encode() for x in doc]
        cut = [(str(k), [x.encode() for x in own]) for k, own in enumerate(items)]
        hit, found = set(), set()
        for name, own in cut:
            span = min(window, len(own))
            for s in range(len(own) - span + 1 if own else 0):
                for p in range(len(words) - span + 1):
                    if words[p : p + span] == own[s : s + span]:
                        hit.update(range(p, p + span))
                        found.add(name)
        runs, names = decontam.Index(cut, {}, window).hits(words)
        assert {x for a, b in decontam.merged(runs) for x in range(a, b)} == hit and names == found

    same()


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_equals_brute_force(spark, monkeypatch, small):
    """With the module's limits, and with such that nothing is broadcast and all is cut into blocks."""
    if small:
        for name, value in {"BROADCAST_IDS": 0, "BLOCK": 8, "FAMILY_BLOCK": 4, "GROUP_PAIRS": 3, "BUCKET_KEYS": 500}.items():
            monkeypatch.setattr(jaccard, name, value)
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    common = r.choices(vocabulary, k=30)
    texts = []
    for _ in range(60):
        base = r.choices(vocabulary, k=r.choice([3, 6, 20, 60, 150]))
        if r.random() < 0.4:
            base = common + base
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 12)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(pairs, range(len(sets)))
    rows = jaccard.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows} == {i: (len(sets[i]), want[i]) for i in range(len(sets))}


def test_sets_of_one_key_are_told_apart(spark, monkeypatch):
    """Two texts that share the first hash: the second keeps the other from becoming a copy."""
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "u v w x y z"), (None, "only here without an id now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = jaccard.measure(docs)
    nodes = {r["doc_id"]: r["node"] for r in real.filter("kind = 0").collect()}
    clash = real.withColumn("node", F.when((F.col("kind") == 0) & (F.col("doc_id") == 3), nodes[1]).otherwise(F.col("node")))
    monkeypatch.setattr(jaccard, "measure", lambda _: clash)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, None: None}


def test_linked_sets_share_an_indexed_lane():
    r = np.random.default_rng(3)
    none = np.zeros(jaccard.COMMON_TABLE // 8, np.uint8)
    some = none.copy()
    for _ in range(400):
        n = int(r.integers(1, 120))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        k = int(r.integers(0, 1 + n // 4))
        b = np.unique(np.concatenate((a[k // 2 :], r.integers(0, 1 << 63, k - k // 2, dtype=np.uint64))))
        some[((a[: n // 2] & np.uint64(8 * len(some) - 1)) >> np.uint64(3)).astype(np.int64)] = 255
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            for table in (none, some):
                x, y = jaccard.lane_keys(a, table), jaccard.lane_keys(b, table)
                both = np.intersect1d(x >> np.uint64(1), y >> np.uint64(1))
                assert len(both)
            s = jaccard.Sketches([jaccard.bit_sketch(a), jaccard.bit_sketch(b)])
            assert s.differ(0, np.array([1]))[0] <= len(a) + len(b) - 2 * shared


def test_levenshtein_automaton():
    def distance(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    row[-1] = min(row[-1], rows[-2][j - 2] + 1)
            rows.append(row)
        return rows[-1][-1]

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=8), st.text("abcd", max_size=7), st.integers(0, 2))
    def same(terms, word, edits):
        best = min(distance(t, word) for t in terms)
        got = toxicity.Trie({t: 1.0 for t in terms}).within(word, edits)
        assert (got and got[1]) == (best if best <= edits else None)

    same()
    lexicon = toxicity.Lexicon({"horrid": 5.0, "scum": 4.0})
    assert lexicon["HORRID"] == (5.0, 0, "horrid") and lexicon["horid"] == lexicon["horrdi"] == (5.0 * toxicity.MISSPELT, 1, "horrid") and lexicon["hrid"] is None
    assert lexicon["scmu"] == (4.0 * toxicity.MISSPELT_SHORT, 1, "scum") and lexicon["scu"] is None
    graded = toxicity.Lexicon({"horrid": 5.0}, {"horid": 0.0, "torrid": 0.5})
    assert graded["horid"] is None and graded["torrid"] == (2.5, 1, "horrid") and toxicity.Lexicon({"horrid": 5.0}, edits=0)["horid"] is None
    plain, quoted = toxicity.features("you horrid thing", lexicon), toxicity.features('he wrote of "a horrid thing" once', lexicon)
    assert plain[1] > 0 == quoted[1] and quoted[5] > 0 == plain[5]


def test_near_clean_words_leave_other_misspellings(spark):
    r = random.Random(4)
    plain = ["".join(r.choices("abdefgimnpqvxz", k=7)) for _ in range(300)]
    fill = lambda *own: " ".join([*r.choices(plain, k=8), *own, *r.choices(plain, k=8)])
    rows = [(i, fill("clown") if i % 2 else fill("crown") if i < 40 else fill('"clowm"') if i < 60 else fill(), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert set(model.weights) == {"clown"}
    asked = ["clown", "cloown", "clowm", "crown", "plain"]
    said = spark.createDataFrame([(w, fill(w)) for w in asked], "word string, text string")
    got = {x["word"]: x["predicted"] for x in toxicity.score(said, model).collect()}
    assert got == {"clown": 1, "cloown": 1, "clowm": 1, "crown": 0, "plain": 0}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    right = lambda df, label: [r[0] for r in df.selectExpr(f"predicted = {label}").collect()]
    assert np.mean(right(quality.query(spark, d).filter("held_out").join(labels, "doc_id"), "quality")) > 0.97
    assert np.mean(right(toxicity.query(spark, d).filter("held_out").join(labels, "doc_id"), "toxic")) > 0.95
    spoken = langid.query(spark, d).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").selectExpr("lang = lang_pred").collect()
    assert np.mean([r[0] for r in spoken]) > 0.97


def test_misspelled_terms_are_caught_by_the_automata(spark):
    """Held-out toxic documents with an edit in each term: caught as the plain ones are, with the
    automata on, and hardly without them."""
    d, r = "/root/testdata/sf0.1", random.Random(3)
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.learn(docs, labels.filter(fold("doc_id", 3) != 1))
    texts = [x["text"] for x in docs.join(labels.filter("toxic = 1"), "doc_id").filter(fold("doc_id", 3) == 1).select("text").collect()]

    def typo(word):
        i = r.randrange(len(word) - 1)
        return r.choice(
            [
                word[:i] + word[i + 1] + word[i] + word[i + 2 :],
                word[:i] + word[i + 1 :],
                word[:i] + r.choice("abcdefgh") + word[i + 1 :],
                word[:i] + word[i] + word[i:],
            ],
        )

    def caught(texts, edits):
        lexicon = toxicity.Lexicon(model.weights, model.forms, edits)
        return model.score(np.array([toxicity.features(t, lexicon) for t in texts])) >= toxicity.THRESHOLD

    misspelt = [re.sub(r"\w+", lambda m: typo(m[0].lower()) if m[0].lower() in model.weights and len(m[0]) > 3 else m[0], t) for t in texts]
    plain = caught(texts, 1)
    assert plain.mean() > 0.85 and caught(misspelt, 1)[plain].mean() >= 0.95 and caught(misspelt, 0)[plain].mean() < 0.3
