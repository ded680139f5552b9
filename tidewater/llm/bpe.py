"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of many texts lie in one flat array of symbols. In each round every word's lowest-ranked
neighbouring pair is found by binary search over the sorted pair keys and merged wherever it stands
in that word; words without a pair that merges leave the array. Words met before are remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import small_batches, table, trim, worker_state

#: Words that a worker remembers, besides as many that it met before those, and their most letters; symbols of a word
#: from which merging goes by a heap, whose time grows as n log n.
MEMORY = 50_000
KEPT_LETTERS = 64
LONG_WORD = 2048
#: Symbols merged together at most, so that memory stays bounded.
FLAT_SYMBOLS = 200_000
_SHIFT = 20
_NONE = np.iinfo(np.int64).max
#: Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


#: The same pattern for texts in which no other character occurs than these.
_LATIN, _SPACES = "A-Za-zÀ-ÖØ-öø-ɏ", "\t\n\x0b\x0c\r "
_NOT_LATIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ]")
_LATIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^{_SPACES}{_LATIN}0-9]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file writes for each byte, to that byte: printable
    Latin-1 stands for itself, the others follow from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file. Texts that hold a special token's string get
    that token there."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max(max(vocab.values()), max(self.special.values(), default=0)))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.symbol_of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << _SHIFT | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        """The text in pieces that no merge crosses; joined they are the text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pieces(text)
        return [w for part in self.cut.split(text) if part for w in ([part] if part in self.special else self.pieces(part))]

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches; texts of plain and Latin letters alone go by a faster equal pattern."""
        return self.find(text) if _NOT_LATIN.search(text) else _LATIN_PATTERN.findall(text)

    def rank(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair key, or _NONE."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], _NONE)

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word, by rounds over all words together."""
        out: list[tuple[int, ...]] = [()] * len(words)
        symbols = self.symbol_of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ranks = np.full(len(symbols), _NONE)
        todo = np.flatnonzero(owner[1:] == owner[:-1])
        while len(symbols):
            # Only pairs with a symbol that has just come about are looked up.
            ranks[todo] = self.rank(symbols[todo] << _SHIFT | symbols[todo + 1])
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(ranks, starts)
            if (over := lowest == _NONE).any():
                stay = np.repeat(~over, sizes)
                done, ends = symbols[~stay].tolist(), np.cumsum(sizes[over]).tolist()
                for w, a, b in zip(owner[starts[over]].tolist(), [0, *ends], ends, strict=False):
                    out[w] = tuple(done[a:b])
                symbols, owner, ranks, lowest, sizes = symbols[stay], owner[stay], ranks[stay], lowest[~over], sizes[~over]
                if not len(symbols):
                    break
            sites = ranks == np.repeat(lowest, sizes)
            if (sites[1:] & sites[:-1]).any():
                # In a run of overlapping sites (one letter again and again) every other one merges.
                at = np.arange(len(sites))
                run = np.maximum.accumulate(np.where(sites & ~np.concatenate(([False], sites[:-1])), at, -1))
                sites &= (at - run) % 2 == 0
            here = np.flatnonzero(sites)
            symbols[here] = self.merged[ranks[here]]
            stay = np.ones(len(symbols), bool)
            stay[here + 1] = False
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            here = here - np.arange(len(here))
            ranks[here] = _NONE
            new = np.zeros(len(symbols), bool)
            new[here] = new[here[here > 0] - 1] = True
            todo = np.flatnonzero(new[:-1] & (owner[:-1] == owner[1:]))
        return out

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """The ids of one long word: a heap of (rank, place) over a linked list of symbols."""
        symbols = self.symbol_of_byte[np.frombuffer(word, np.uint8)]
        ranks = self.rank(symbols[:-1] << _SHIFT | symbols[1:])
        sym, n = symbols.tolist(), len(symbols)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), [(r, i) for i, r in enumerate(ranks.tolist()) if r != _NONE]
        heapq.heapify(heap)
        table_ = self.rank_of
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if j >= n or table_.get(sym[i] << _SHIFT | sym[j]) != r:
                continue
            sym[i], sym[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (up := table_.get(sym[i] << _SHIFT | sym[after[i]])) is not None:
                    heapq.heappush(heap, (up, i))
            if before[i] >= 0 and (up := table_.get(sym[before[i]] << _SHIFT | sym[i])) is not None:
                heapq.heappush(heap, (up, before[i]))
        return tuple(s for s in sym if s >= 0)

    @property
    def rank_of(self) -> dict[int, int]:
        if not hasattr(self, "_rank_of"):
            self._rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self._rank_of

    def learn_words(self, words: set[str]) -> None:
        """Encodes the words and remembers them."""
        flat, batch = 0, []
        for w in words:
            if w in self.special:
                self.known[w] = (self.special[w],)
                continue
            coded = w.encode("utf-8", "surrogatepass")
            if len(coded) > LONG_WORD:
                self.known[w] = self.merge_long(coded)
                continue
            batch.append((w, coded))
            flat += len(coded)
            if flat >= FLAT_SYMBOLS:
                self.known.update(zip((x for x, _ in batch), self.merge_words([c for _, c in batch]), strict=True))
                flat, batch = 0, []
        if batch:
            self.known.update(zip((x for x, _ in batch), self.merge_words([c for _, c in batch]), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each whole text; null and empty texts have none."""
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        new = set(chain.from_iterable(cut)).difference(self.known)
        again = {w: self.older[w] for w in new if w in self.older}
        self.known.update(again)
        self.learn_words(new.difference(again))
        ids = self.known.__getitem__
        out = [list(chain.from_iterable(map(ids, ws))) for ws in cut]
        for word in [w for w in new if len(w) > KEPT_LETTERS]:
            del self.known[word]
        return out

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """The text of each list of ids; bytes that aren't UTF-8 become U+FFFD. An id outside the
        vocabulary adds nothing."""
        known, top = self.bytes_of.__getitem__, len(self.bytes_of)
        return [b"".join(map(known, own if not own or (min(own) >= 0 and max(own) < top) else [i for i in own if 0 <= i < top])).decode("utf-8", "replace") for own in ids]


def codec(path: str) -> Codec:
    """This worker's codec of a vocabulary file."""
    return worker_state(("bpe", path), lambda: Codec(path))


def default_path() -> str:
    """The public vocabulary file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "token_ids") -> DataFrame:
    """Adds `into`: the ids of each row's whole text, empty for null. A column of that name is replaced."""
    where = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(codec(where).encode_batch(texts.tolist()))

    return docs.withColumn(into, ids(F.col(text)))


def decode(rows: DataFrame, path: str | None = None, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Adds `into`: the text of each row's ids, empty for null."""
    where = path or default_path()

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            yield pd.Series(codec(where).decode_batch([[] if i is None else list(i) for i in own]))

    return rows.withColumn(into, texts(F.col(ids)))


def round_trip(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """n_tokens and the digests of ids and decoded text of every row, beside its other columns."""
    where = path or default_path()
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")]
    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids

    @F.pandas_udf(shape)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decimal = list(map(str, range(len(codec(where).bytes_of))))
        for texts in batches:
            ids = codec(where).encode_batch(texts.tolist())
            decoded = codec(where).decode_batch(ids)
            yield pd.DataFrame({
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(decimal.__getitem__, i)).encode()).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded],
            } | ({"token_ids": ids} if keep_ids else {}))
        trim()

    columns = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * keep_ids
    return docs.select(*kept, both(F.col("text")).alias("_b")).select(*kept, *(f"_b.{c}" for c in columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, their number, and the digests of ids and decoded text."""
    small_batches(spark)
    return round_trip(docs.select("doc_id", "lang", "source", "text"), keep_ids=True)
