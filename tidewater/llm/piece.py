"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols are its characters, with the space written as U+2581. An agenda holds the pairs of
adjacent symbols that together are a piece, best score first and then the leftmost; the pair on top
merges, and its symbol's new pairs go on the agenda, until it is empty. What no piece crosses is cut
beforehand, and words met before are remembered. `disagreements` holds the ids and texts against the
sentencepiece library, batch by batch.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import small_batches, table, trim, worker_state

#: Words that a worker remembers, besides as many that it met before those, and their most letters.
MEMORY = 200_000
KEPT_LETTERS = 64
#: Fixed value: how the library writes a space.
SPACE = "▁"
#: What the library writes for an unknown id.
UNKNOWN = " ⁇ "
_CLASSES = (("s", regex.compile(SPACE)), ("l", regex.compile(r"\p{L}")), ("d", regex.compile(r"\p{Nd}")))
#: Steps from class to class (s space, l letter, d digit, o other) that the finest cut allows within a piece.
_FINE = {"ss", "sl", "so", "ll", "oo"}
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_NOT_LATIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ]")

codecs.register_error("one_for_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _class_of(letter: str) -> str:
    return next((name for name, pattern in _CLASSES if pattern.match(letter)), "o")


class Pieces:
    """Encoder and decoder of one model file. The vocabulary must be of the merge type, with bytes for
    unknown characters and without user-defined or unused pieces; texts are taken as they are."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        kind = spec.SentencePiece
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError(f"{path} is no merge-type vocabulary with bytes for unknown characters")
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} changes texts before it encodes them")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in spec.pieces):
            raise ValueError(f"{path} holds user-defined or unused pieces")
        self.prefix = " " if rules.add_dummy_prefix else ""
        normal = {p.piece: (i, p.score) for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        self.id_of = {piece: i for piece, (i, _) in normal.items()}
        # Equal scores get equal places, so that among them the leftmost pair goes first.
        places = {score: k for k, score in enumerate(sorted({score for _, score in normal.values()}, reverse=True))}
        self.place_of = {piece: places[score] for piece, (_, score) in normal.items() if len(piece) > 1}
        self.id_of_byte = [0] * 256
        self.bytes_of = [b""] * len(spec.pieces)
        for i, p in enumerate(spec.pieces):
            if p.type == kind.BYTE:
                byte = int(p.piece[3:5], 16)
                self.id_of_byte[byte], self.bytes_of[i] = i, bytes([byte])
            elif p.type != kind.CONTROL:
                self.bytes_of[i] = (UNKNOWN if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ")).encode()
        self.opens = [p.type == kind.NORMAL and p.piece.startswith(SPACE) for p in spec.pieces]
        self.silent = [p.type == kind.CONTROL for p in spec.pieces]
        self.cut, self.cut_latin = self._cuts()
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _cuts(self):
        """Functions that cut a text, and one of ASCII and Latin letters alone, where no piece reaches across."""
        steps = {_class_of(a) + _class_of(b) for piece in self.place_of for a, b in zip(piece, piece[1:], strict=False)}
        if steps <= _FINE:
            fine = regex.compile(rf"[ {SPACE}]*(?:\p{{L}}+|[^\p{{L}}\p{{Nd}} {SPACE}]+)|[ {SPACE}]+|\p{{Nd}}").findall
            return fine, re.compile(rf" *(?:[{_LATIN}]+|[^{_LATIN}0-9 ]+)| +|[0-9]").findall
        if any(step[1] == "s" != step[0] for step in steps):
            return (lambda text: [text] if text else []), None
        return re.compile(rf"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+").findall, None

    def words(self, text: str | None) -> list[str]:
        """The text with its leading space in pieces that no merge crosses; joined they are that text."""
        if not text:
            return []
        return (self.cut_latin if self.cut_latin and not _NOT_LATIN.search(text) else self.cut)(self.prefix + text)

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of a word by the agenda; its time grows as n log n with the word's length."""
        symbols: list[str] = list(word.replace(" ", SPACE))
        n, places = len(symbols), self.place_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(places[pair], i, pair) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if pair in places]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue  # one of the two has merged with another meanwhile
            symbols[i], symbols[j], after[i] = pair, "", after[j]
            if after[j] < n:
                before[after[j]] = i
                if (right := pair + symbols[after[j]]) in places:
                    heapq.heappush(agenda, (places[right], i, right))
            if (h := before[i]) >= 0 and (left := symbols[h] + pair) in places:
                heapq.heappush(agenda, (places[left], h, left))
        ids: list[int] = []
        for s in filter(None, symbols):
            if (i := self.id_of.get(s)) is None:
                ids.extend(self.id_of_byte[b] for b in s.encode("utf-8", "surrogatepass"))
            else:
                ids.append(i)
        return tuple(ids)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each whole text; null and empty texts have none."""
        cut = [self.words(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        new = set(chain.from_iterable(cut)).difference(self.known)
        self.known.update((w, self.older[w] if w in self.older else self.merge(w)) for w in new)
        ids = self.known.__getitem__
        out = [list(chain.from_iterable(map(ids, ws))) for ws in cut]
        for word in [w for w in new if len(w) > KEPT_LETTERS]:
            del self.known[word]
        return out

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """The text of each list of ids, without the leading space that encoding adds. Bytes that aren't
        UTF-8 become U+FFFD each; control ids and ids outside the vocabulary add nothing."""
        known, top = self.bytes_of.__getitem__, len(self.bytes_of)
        out = []
        for own in ids:
            if own and (min(own) < 0 or max(own) >= top):
                own = [i for i in own if 0 <= i < top]
            if any(map(self.silent.__getitem__, own)):
                out.append(self._decode_apart(own))
                continue
            whole = b"".join(map(known, own))
            if self.prefix:
                whole = whole[1:] if own and self.opens[own[0]] else whole
            out.append(whole.decode("utf-8", "one_for_each_byte"))
        return out

    def _decode_apart(self, ids: list[int]) -> str:
        """The text of ids with control ids among them: bytes on both sides of one are no character."""
        runs: list[list[int]] = [[]]
        for i in ids:
            if self.silent[i]:
                runs.append([])
            else:
                runs[-1].append(i)
        runs = [r for r in runs if r] or [[]]
        parts = [b"".join(map(self.bytes_of.__getitem__, r)) for r in runs]
        if self.prefix and runs[0] and self.opens[runs[0][0]]:
            parts[0] = parts[0][1:]
        return "".join(p.decode("utf-8", "one_for_each_byte") for p in parts)


def pieces(path: str) -> Pieces:
    """This worker's encoder of a model file."""
    return worker_state(("piece", path), lambda: Pieces(path))


def default_path() -> str:
    """The public model file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "piece_ids") -> DataFrame:
    """Adds `into`: the ids of each row's whole text, empty for null. A column of that name is replaced."""
    where = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(pieces(where).encode_batch(texts.tolist()))

    return docs.withColumn(into, ids(F.col(text)))


def decode(rows: DataFrame, path: str | None = None, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """Adds `into`: the text of each row's ids, empty for null."""
    where = path or default_path()

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            yield pd.Series(pieces(where).decode_batch([[] if i is None else list(i) for i in own]))

    return rows.withColumn(into, texts(F.col(ids)))


def disagreements(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, ids, library_ids, decoded, library_decoded) of the rows whose ids or decoded text differ
    from the sentencepiece library's, compared in Arrow batches; none if the agenda is right."""
    where = path or default_path()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, texts = pieces(where), b.column("text").to_pylist()
            ids, theirs = own.encode_batch(texts), own.library.encode([t or "" for t in texts], num_threads=1)
            decoded, others = own.decode_batch(ids), own.library.decode(theirs, num_threads=1)
            odd = [i for i in range(len(texts)) if ids[i] != theirs[i] or decoded[i] != others[i]]
            pick = lambda values: [values[i] for i in odd]
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(odd, pa.int64())), pa.array(pick(ids), pa.list_(pa.int32())), pa.array(pick(theirs), pa.list_(pa.int32())), pa.array(pick(decoded), pa.string()), pa.array(pick(others), pa.string())],
                [key, "ids", "library_ids", "decoded", "library_decoded"],
            )

    small_batches(docs.sparkSession)
    shape = f"{key} {dict(docs.dtypes)[key]}, ids array<int>, library_ids array<int>, decoded string, library_decoded string"
    return docs.select(key, "text").mapInArrow(compare, shape)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens and the digests of ids and decoded text of every row, beside its other columns but
    text; columns of those names are replaced. One row in, one row out; null and empty texts have 0
    tokens and the digests of the empty text."""
    where = path or default_path()
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *made)]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decimal = list(map(str, range(len(pieces(where).bytes_of))))
        for texts in batches:
            ids = pieces(where).encode_batch(texts.tolist())
            decoded = pieces(where).decode_batch(ids)
            yield pd.DataFrame({
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(decimal.__getitem__, i)).encode()).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded],
            })
        trim()

    return docs.select(*kept, both(F.col("text")).alias("_both")).select(*kept, *(F.col(f"_both.{c}") for c in made))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
