"""Piece encoding against the sentencepiece library: ids, decoded texts, cuts and odd texts."""

import hashlib
import random

import pytest

from tidewater.llm import piece
from tidewater.llm.piece import Pieces, default_path

DIR = "/root/testdata/sf0.001"
LETTERS = " ▁\n\t,.-²½ªµabcXYZéß漢字かअिक्😀́  \x00\x7f01९٣<>s/_#*==||''"


@pytest.fixture(scope="module")
def own():
    return Pieces(default_path())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(8000)]
    return [*texts, "<s> a </s>", "<unk>", "<0x0A>", "   ", " ", "▁", "▁▁ a", "².x².", "a".join([" "] * 50), "=" * 500, " " * 333, "ab" * 3000, ""]


def test_ids_and_texts_of_odd_texts(own, odd):
    ids = own.encode_batch(odd)
    assert ids == own.library.encode(odd, num_threads=1)
    assert own.decode_batch(ids) == own.library.decode(ids, num_threads=1)
    assert own.encode_batch([None, ""]) == [[], []]


def test_any_cut_gives_the_same_ids(own, odd):
    """The cut is there for speed: whole texts and cuts at spaces give the same ids."""
    assert own.cut_latin is not None
    for coarse in ((lambda t: [t] if t else []), piece.re.compile(r"[ ▁]*[^ ▁]+|[ ▁]+").findall):
        other = Pieces(default_path())
        other.cut, other.cut_latin = coarse, None
        assert other.encode_batch(odd) == own.encode_batch(odd)


def test_memory_forgets_but_ids_stay(own, odd, monkeypatch):
    monkeypatch.setattr(piece, "MEMORY", 50)
    small = Pieces(default_path())
    assert [i for k in range(0, len(odd), 100) for i in small.encode_batch(odd[k : k + 100])] == own.encode_batch(odd)


def test_decoding_any_ids(own):
    rng = random.Random(6)
    some = [[rng.choice([0, 1, 2, 3, 100, 200, 259, 28705, rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 6))] for _ in range(8000)]
    assert own.decode_batch(some) == own.library.decode(some, num_threads=1)
    assert own.decode_batch([[-1, 40_000]]) == [""]


def test_other_vocabularies_are_refused(monkeypatch):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(SentencePieceProcessor(model_file=default_path()).serialized_model_proto())
    for change in (lambda: setattr(spec.trainer_spec, "model_type", 1), lambda: setattr(spec.trainer_spec, "model_type", 2) or setattr(spec.normalizer_spec, "remove_extra_whitespaces", True)):
        change()
        altered = type("Altered", (), {"serialized_model_proto": lambda self: spec.SerializeToString()})
        monkeypatch.setattr("sentencepiece.SentencePieceProcessor", lambda model_file: altered())
        with pytest.raises(ValueError):
            Pieces("x")


def test_round_trip_over_the_table(spark, own):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert piece.disagreements(docs).count() == 0
    got = {r["doc_id"]: r for r in piece.query(spark, DIR).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = own.library.encode(r["text"] or "", num_threads=1)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.library.decode(ids).encode()).hexdigest())
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"], got[r["doc_id"]]["decoded_sha256"]) == want


def test_odd_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    rows = [(1, None, "x"), (2, "", "x"), (3, "word another third " * 40_000, "x"), (3, "a\nb", "y"), (3, "a\nb", "y"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = piece.round_trip(docs).orderBy("doc_id", "n_tokens").collect()
    assert got[0]["doc_id"] is None and [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got[1:3]] == [(0, empty, empty)] * 2
    assert got[3] == got[4] and got[5]["n_tokens"] > 100_000 and piece.round_trip(docs).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert piece.disagreements(docs).count() == 0
    assert piece.round_trip(docs.filter("1 = 0")).count() == 0
    both = piece.decode(piece.encode(docs)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in both)


def test_a_wrong_result_shows(spark, monkeypatch):
    """`disagreements` compares: with another dummy prefix every text differs."""
    docs = spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")
    assert piece.disagreements(docs).count() == 0
    ids = piece.pieces(default_path()).merge("plain words")
    assert list(ids) != piece.pieces(default_path()).library.encode("plain words")
