"""N-gram Jaccard join with parity sketches.

A document is the set of its five-word shingles, each a 64-bit hash. Sets are XOR-hashed into
sketches: a token changes one lane only, so the number of lanes (or bits) in which two sketches
differ is at most the size of the sets' symmetric difference, and a similarity bounds that.

Sets are joined per size band. Of the P lanes of a band, two linked sets differ in d at most, so
they share a lane among any d + 1 lanes that one order of lanes puts first for both. That order
puts lanes of corpus-wide shingles behind the others and empty lanes last. Sets that share such a
lane are candidates; a sketch of two to four bits a token rejects most wrong ones, and the sets
themselves decide.

Equal sets are compared once. Of many sets that share a lane, each is first compared with one;
those that end in different components are then compared with each other, in blocks, so no link
between components is lost and pairs within a group never become rows.

Shingles and sets are known by 64-bit hashes. A second hash of each set tells those apart that share
the first: only rows with both hashes of the compared set take its component, so that a chance hit
can't make a document a copy of another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import drop_written, materialise, release, small_batches, table, tidy
from tidewater.llm.components import connected_components

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Upper end of a size band over its lower end; lanes for each token of the largest set.
BAND = 4
LANES = 4
SKETCH_LEAST = 128
#: A shingle in so many documents is common; so many common ones order the lanes at most, held in
#: a table of so many bits.
COMMON_DOCS = 3
COMMON_MOST = 1_000_000
COMMON_TABLE = 1 << 26
#: Documents whose shingles are counted together; lane keys of one bucket and of one flush.
COUNT_DOCS = 2048
BUCKET_KEYS = 500_000
FLUSH_KEYS = 250_000
#: Sets of one side of a block of comparisons; pairs verified together; ids that are broadcast at most.
BLOCK = 1024
GROUP_PAIRS = 200
FAMILY_BLOCK = 128
BROADCAST_IDS = 500_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


#: Which bytes part words, a number for each byte, and a coefficient for each place within a word.
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTES = np.random.default_rng(6).integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACES = np.random.default_rng(5).integers(0, 1 << 64, 4096, dtype=np.uint64) | np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text: the sum of its bytes' numbers, each by its place's coefficient."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~_SPACE[raw]
    turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    lengths = turns[1::2] - turns[::2]
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    weight = _PLACES[place & 4095]
    if lengths.max() > 4096:
        weight = weight + (place >> 12).astype(np.uint64) * _M3
    sums = np.add.reduceat(_BYTES[raw[inside]] * weight, first)
    return mix(sums + lengths.astype(np.uint64) * _M1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles. Words are runs without ASCII white
    space, A-Z lower-cased; a text of fewer than five words has one shingle, one without any none."""
    own = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not (n := len(own)):
        return own
    span = min(n, WORDS)
    out = np.full(n - span + 1, np.uint64(span))
    for k in range(span):
        out = out * _M1 + own[k : n - span + 1 + k]
        out ^= out >> np.uint64(29)
    out = np.sort(mix(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_key(tokens: np.ndarray) -> int:
    """One signed number for a set."""
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def second_key(tokens: np.ndarray) -> int:
    """Another number for a set, to tell apart those of one key."""
    return xxhash.xxh64_intdigest(tokens.tobytes(), seed=1) - (1 << 63)


def bit_sketch(tokens: np.ndarray) -> bytes:
    """The parity of the tokens in each of m places; m is a power of two, twice the tokens or more."""
    m = max(SKETCH_LEAST, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else SKETCH_LEAST
    places = (tokens & np.uint64(m - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=m) & 1).astype(np.uint8)).tobytes()


class Sketches:
    """Bit sketches of several lengths. A longer one is folded (its halves XORed) to be compared
    with a shorter: the places of a token are its lowest bits."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.size = raw, np.fromiter(map(len, raw), np.int64, len(raw))
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def matrix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of each sketch or -1, rows of 64-bit numbers) of those of `size` bytes or twice that."""
        if size not in self.at:
            own = np.flatnonzero((self.size == size) | (self.size == 2 * size))
            rows = np.empty((len(own), size // 8), np.uint64)
            for k, i in enumerate(own.tolist()):
                x = np.frombuffer(self.raw[i], np.uint64)
                rows[k] = x if len(x) == size // 8 else x[: len(x) // 2] ^ x[len(x) // 2 :]
            where = np.full(len(self.raw), -1)
            where[own] = np.arange(len(own))
            self.at[size] = where, rows
        return self.at[size]

    def differ(self, k: int, others: np.ndarray) -> np.ndarray:
        """The places in which sketch k differs from others of half to twice its length."""
        out = np.zeros(len(others), np.int64)
        for size in {int(self.size[k]), int(self.size[k]) // 2}:
            here = (np.minimum(self.size[others], self.size[k]) == size) if size >= SKETCH_LEAST // 8 else np.zeros(len(others), bool)
            if here.any():
                where, rows = self.matrix(size)
                out[here] = np.bitwise_count(rows[where[others[here]]] ^ rows[where[k]]).sum(axis=1)
        return out


def most_apart(a, b):
    """The largest symmetric difference of linked sets of a and b tokens."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


@lru_cache(4096)
def roles(n: int) -> tuple[tuple[int, int, int, int], ...]:
    """(band, lanes, role, lanes to index) for a set of n tokens: role 0 in its own band, role 1
    as the smaller partner of sets of the next band."""
    low, band = 1, 0
    while n >= low * BAND:
        low, band = low * BAND, band + 1
    partner = n * 100 // PERCENT
    own = (band, LANES * low * BAND, 0, most_apart(n, min(partner, low * BAND - 1)) + 1)
    return (own, (band + 1, LANES * low * BAND * BAND, 1, most_apart(n, partner) + 1)) if partner >= low * BAND else (own,)


def lane_keys(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys that index a set, with the role in their lowest bit. `common` is a packed table of
    bits that tells (with few errors, alike for all sets) which tokens are common."""
    out = []
    place = (tokens & np.uint64(8 * len(common) - 1)).astype(np.int64)
    rare = (common[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 0
    high = tokens >> np.uint64(32)
    for band, lanes, role, wanted in roles(len(tokens)):
        salt = np.uint64((band + 1) * int(_M3) % (1 << 64))
        lane = (high * np.uint64(lanes)) >> np.uint64(32)  # ascending, as the tokens are
        starts = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1])))
        held = np.bitwise_xor.reduceat(tokens, starts)
        keys = mix(mix(held) + lane[starts] * _M1 + salt)
        if wanted < len(keys):
            order = (keys >> np.uint64(1)) | np.where(np.logical_or.reduceat(rare, starts), np.uint64(0), np.uint64(1 << 63))
            keys = keys[np.argpartition(order, wanted - 1)[:wanted]]
        elif wanted > len(keys):
            # Too few lanes hold a token: the first empty ones, in the order of their keys, join in.
            empty = np.setdiff1d(np.arange(lanes, dtype=np.uint64), lane[starts])
            blank = mix(empty * _M1 + salt)
            keys = np.concatenate((keys, np.sort(blank)[: wanted - len(keys)]))
        out.append(keys & ~np.uint64(1) | np.uint64(role))
    return np.concatenate(out)


def measure(docs: DataFrame) -> DataFrame:
    """Rows of kind 0 for every document (doc_id, n shingles, node: the set's key, its second key,
    sketch), and of kind 1 for shingles that recur within COUNT_DOCS documents (node: the shingle, n: how often)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[np.ndarray] = []

        def recurring() -> pd.DataFrame:
            tokens, counts = np.unique(np.concatenate(waiting), return_counts=True)
            often = counts > 1
            waiting.clear()
            return pd.DataFrame({"kind": 1, "doc_id": None, "n": counts[often], "node": tokens[often].view(np.int64), "second": 0, "sketch": None})

        for b in tidy("measure", batches):
            sets = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({
                "kind": 0,
                "doc_id": b["doc_id"],
                "n": [len(s) for s in sets],
                "node": [set_key(s) for s in sets],
                "second": [second_key(s) for s in sets],
                "sketch": [bit_sketch(s) for s in sets],
            })
            waiting.extend(sets)
            if len(waiting) >= COUNT_DOCS:
                yield recurring()
        if waiting:
            yield recurring()

    return docs.select("doc_id", "text").mapInPandas(run, "kind int, doc_id long, n long, node long, second long, sketch binary")


def common_table(counted: DataFrame) -> np.ndarray:
    """The packed table of common shingles: those that recur most, COMMON_MOST at most. Which they
    are decides how well lanes are ordered, not which links are found."""
    sums = counted.groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_DOCS)
    most = sums.orderBy(F.desc("n"), "node").limit(COMMON_MOST).select("node").toArrow().column("node").to_numpy()
    places = np.unique(most & (COMMON_TABLE - 1))
    out = np.zeros(COMMON_TABLE // 8, np.uint8)
    np.bitwise_or.at(out, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return out


def lane_groups(docs: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """Sets that share a lane: rows of kind 0 are pairs (a, b) of nodes to compare; rows of kind 1
    tell that node b stands with role `role` in the group a of three sets or more."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        seen: set[int] = set()
        waiting = 0

        def flush() -> pd.DataFrame:
            k, v = np.concatenate(keys), np.concatenate(nodes)
            keys.clear()
            nodes.clear()
            bucket = ((k >> np.uint64(33)) * np.uint64(buckets)) >> np.uint64(31)
            order = np.argsort(bucket, kind="stable")
            k, v, bucket = k[order], v[order], bucket[order]
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(starts[1:], len(k))
            return pd.DataFrame({"bucket": bucket[starts].astype(np.int64), "payload": [k[s:e].tobytes() + v[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]})

        for b in tidy("index", batches):
            for text in b["text"]:
                tokens = shingles(text)
                if not len(tokens) or (node := set_key(tokens)) in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(node)
                own = lane_keys(tokens, bits)
                keys.append(own)
                nodes.append(np.full(len(own), node, np.int64))
                waiting += len(own)
                if waiting >= FLUSH_KEYS:
                    yield flush()
                    waiting = 0
        if keys:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(p, np.uint64) for p in pdf["payload"]]
        keys = np.concatenate([p[: len(p) // 2] for p in parts])
        nodes = np.concatenate([p[len(p) // 2 :] for p in parts]).view(np.int64)
        return pd.DataFrame(pairs_of_groups(keys, nodes), columns=["kind", "a", "b", "role"])

    spread = docs.select("text").mapInPandas(index, "bucket long, payload binary")
    return spread.groupBy("bucket").applyInPandas(meet, "kind int, a long, b long, role int")


def pairs_of_groups(keys: np.ndarray, nodes: np.ndarray) -> dict[str, np.ndarray]:
    """What the entries (key with role, node) of one bucket say; see lane_groups."""
    lane = keys >> np.uint64(1)
    order = np.argsort(lane, kind="stable")
    lane, nodes, role = lane[order], nodes[order], (keys[order] & np.uint64(1)).astype(np.int64)
    same = np.concatenate((lane[1:] == lane[:-1], [False]))
    inside = same | np.concatenate(([False], same[:-1]))
    lane, nodes, role = lane[inside], nodes[inside], role[inside]
    pairs: set[tuple[int, int]] = set()
    groups: dict[tuple, int] = {}
    edges = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1], [True]))).tolist() if len(lane) else []
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        members = sorted(set(zip(role[s:e].tolist(), nodes[s:e].tolist(), strict=True)))
        owns = sum(r == 0 for r, _ in members)
        if not owns or len(members) < 2:
            continue
        hub = members[0][1]
        pairs.update((min(hub, other), max(hub, other)) for _, other in members[1:])
        if len(members) > 2 and owns > 1:
            groups.setdefault(tuple(members), int(lane[s]) - (1 << 62))
    rows = [(0, a, b, 0) for a, b in pairs if a != b] + [(1, g, node, r) for members, g in groups.items() for r, node in members]
    out = np.array(rows, np.int64).reshape(-1, 4)
    return {"kind": out[:, 0].astype(np.int32), "a": out[:, 1], "b": out[:, 2], "role": out[:, 3].astype(np.int32)}


def comparable(na, nb):
    """Whether sizes leave a link possible."""
    return 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bit sketches don't rule out; sets has node, n, sketch."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    @F.pandas_udf("boolean")
    def near(na: pd.Series, nb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        out = np.zeros(len(na), bool)
        both = Sketches([*sa, *sb])
        for i in np.flatnonzero(comparable(na.to_numpy(), nb.to_numpy())).tolist():
            out[i] = both.differ(i, np.array([i + len(na)]))[0] <= most_apart(int(na.iat[i]), int(nb.iat[i]))
        return pd.Series(out)

    fits = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(fits).filter(near("na", "nb", "sa", "sb")).select("a", "b")


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by their whole sets.

    The partners of each a are dealt into groups of about GROUP_PAIRS; a set is made from its text
    in one more scan and sent to each group that needs it. Where the list of what goes where is
    short it is broadcast, so that only those sets are shuffled."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_PAIRS).cast("int").alias("parts"))
    dealt = materialise(pairs.join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "part"), "dealt")
    ends = dealt.select(F.col("b").alias("node"), "a", "part").union(dealt.select("a", "a", "part")).distinct()
    orders = materialise(ends.join(sets.select("node", "rid"), "node"), "orders")
    n = orders.count()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // GROUP_PAIRS)
    texts = docs.select(F.col("doc_id").alias("rid"), "text")
    wanted = texts.join(F.broadcast(orders) if n <= BROADCAST_IDS else orders, "rid")
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("a", "part"), F.lit(buckets)).cast("int")).select("bucket", "a", "part", "node", "text")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, raw = None, b""
        for b in tidy("send", batches):
            out = []
            for bucket, a, part, node, text in b.itertuples(index=False):
                if last != (node, text):
                    own = shingles(text)
                    last, raw = (node, text), own.tobytes() if set_key(own) == node else None
                if raw is not None:
                    out.append((bucket, a, part, node, raw))
            yield pd.DataFrame(out, columns=["bucket", "a", "part", "node", "tokens"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        hubs, found = {}, []
        for a, part, node, raw in pdf[pdf["node"] == pdf["a"]][["a", "part", "node", "tokens"]].itertuples(index=False):
            hubs[a, part] = np.frombuffer(raw, np.uint64)
        for a, part, node, raw in pdf[["a", "part", "node", "tokens"]].itertuples(index=False):
            if node != a and (a, part) in hubs:
                x, y = hubs[a, part], np.frombuffer(raw, np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= PERCENT * (len(x) + len(y) - shared):
                    found.append((a, node))
        return pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype=np.int64)

    sent = wanted.mapInPandas(send, "bucket int, a long, part int, node long, tokens binary")
    found = materialise(sent.groupBy("bucket").applyInPandas(compare, "a long, b long").distinct(), "set-links")
    drop_written(dealt)
    drop_written(orders)
    return found


def cross_edges(groups: DataFrame, components: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): edges that join what the possible pairs of different components within the groups
    (a: the group, b: node, role) join; a task gives fewer edges than it has nodes. Many small
    groups are compared in one go; those of more than BLOCK sets are dealt out in pairs of blocks."""
    named = groups.select(F.col("a").alias("g"), F.col("b").alias("node"), "role").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialise(named, "group-members")
    sizes = named.groupBy("g").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("size"))
    split = sizes.filter("c1 <> c2").select("g", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    full = materialise(named.join(split, "g"), "mixed-groups").join(sets.select("node", "n", "sketch"), "node")
    buckets = max(1, named.count() // (4 * BLOCK))
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = full.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keep = ["g", "node", "role", "component", "n", "sketch"]
    one = full.filter("blocks = 1").select(F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), *keep)
    large = dealt.filter("blocks > 1")
    left = large.filter("role = 0").select(F.col("g").alias("bucket"), F.col("at").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), *keep)
    right = large.select(F.col("g").alias("bucket"), F.col("other").alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"), *keep)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", kind="stable")
        g, side, role, n, comp, node = (pdf[c].to_numpy() for c in ("g", "side", "role", "n", "component", "node"))
        bits, joined = Sketches(pdf["sketch"].tolist()), Union()
        edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True]))).tolist()
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            here = np.arange(s, e)
            owns, others = here[(side[s:e] != 1) & (role[s:e] == 0)], here[side[s:e] != 0]
            for k in owns.tolist():
                fine = others[(comp[others] != comp[k]) & comparable(n[k], n[others])]
                fine = fine[bits.differ(k, fine) <= most_apart(n[k], n[fine])] if len(fine) else fine
                for x in node[fine].tolist():
                    joined.add(int(node[k]), x)
        return pd.DataFrame(joined.edges(), columns=["a", "b"], dtype=np.int64)

    return one.union(left).union(right).groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


class Union:
    """Disjoint sets of numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        if x not in up:
            return x
        top = x
        while top in up:
            top = up[top]
        while x in up and up[x] != top:
            up[x], x = top, up[x]
        return top

    def add(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def edges(self) -> list[tuple[int, int]]:
        return [(self.find(x), x) for x in self.up]


def verify_families(families: DataFrame, components: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between different components within the families (node, component: the
    family), enough to join all that such links join. Each set is sent where its family is
    compared, large families in pairs of blocks, so pairs never become rows."""
    named = families.withColumnRenamed("component", "family")
    sizes = named.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("blocks"))
    members = named.join(sizes, "family").join(components, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sets.select("node", "rid"), "node")
    members = materialise(members, "family-members")
    n = members.count()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // FAMILY_BLOCK)
    texts = docs.select(F.col("doc_id").alias("rid"), "text")
    wanted = texts.join(F.broadcast(members) if n <= BROADCAST_IDS else members, "rid").withColumn("bucket", F.pmod(F.xxhash64("family"), F.lit(buckets)).cast("long"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tidy("send", batches):
            out = []
            for text, node, family, blocks, component, bucket in b[["text", "node", "family", "blocks", "component", "bucket"]].itertuples(index=False):
                own = shingles(text)
                if set_key(own) != node:
                    continue
                at = node % blocks
                for other in range(blocks):
                    side = 2 if other == at else int(other < at)
                    out.append((bucket if blocks == 1 else family, min(at, other), max(at, other), side, family, component, node, own.tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "i", "j", "side", "family", "component", "node", "tokens"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        joined, found = Union(), []
        for _, own in pdf.drop_duplicates(["family", "node", "side"]).groupby("family"):
            rows = [(int(node), int(c), int(side), np.frombuffer(t, np.uint64)) for node, c, side, t in own[["node", "component", "side", "tokens"]].sort_values("node").itertuples(index=False)]
            left, right = [r for r in rows if r[2] != 1], [r for r in rows if r[2] != 0]
            same = any(r[2] == 2 for r in rows)
            for a, ca, _, x in left:
                for b, cb, _, y in right:
                    if (same and b <= a) or not comparable(len(x), len(y)) or joined.find(ca) == joined.find(cb):
                        continue
                    both = np.sort(np.concatenate((x, y)), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= PERCENT * (len(x) + len(y) - shared):
                        joined.add(ca, cb)
                        found.append((min(a, b), max(a, b)))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    sent = wanted.mapInPandas(send, "bucket long, i int, j int, side int, family long, component long, node long, tokens binary")
    found = materialise(sent.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long"), "family-links")
    drop_written(members)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text).

    component_id is the smallest id that links reach, itself included. Null texts and texts without
    words have no shingle, link with nothing and keep their own id. Equal sets of any number are
    one node. Rows with a null id have the component of the rows with an id that hold their set; a
    set that only rows without an id hold links with nothing, and theirs is null. Ids must be whole
    numbers. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = materialise(measure(docs), "measured")
    rows = measured.filter("kind = 0")
    first = F.min("doc_id").alias("rid"), F.min_by("second", "doc_id").alias("second")
    sets = materialise(rows.filter("n > 0").groupBy("node").agg(*first, F.max("n").alias("n"), F.min("sketch").alias("sketch")), "nodes")
    total = sets.filter("rid is not null").agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), round(0.5 * total / BUCKET_KEYS))
    found = materialise(lane_groups(docs, common_table(measured.filter("kind = 1")), buckets), "lane-groups")
    release(spark)
    pairs = materialise(possible(found.filter("kind = 0").select("a", "b").distinct(), sets), "pairs")
    links = verify(pairs, docs, sets)
    release(spark)
    components = materialise(connected_components(links), "components")
    edges = materialise(cross_edges(found.filter("kind = 1"), components, sets), "cross-edges")
    if edges.limit(1).count():
        families = materialise(connected_components(edges), "families")
        links = links.union(verify_families(families, components, docs, sets))
        release(spark)
        components = materialise(connected_components(links), "components")
    named = sets.select("node", "rid", "second").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialise(named, "named")
    least = materialise(named.groupBy("component").agg(F.min("rid").alias("component_id")), "least")
    by_node = materialise(named.join(least, "component").select("node", "component_id", F.col("second").alias("held")), "by-node")
    for served in (sets, found, pairs, components, edges, named, least):
        drop_written(served)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "node", "second").join(by_node, "node", "left")
    linked = (F.col("n_shingles") > 0) & (F.col("second") == F.col("held"))
    return out.select("doc_id", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id, once.

    Rows with a null id can't be named, and stay, as do null and empty texts; of rows that repeat an
    id one stays. Where the ids that go are few they are broadcast, so that the texts aren't
    shuffled. The columns are those of `docs`; an empty table gives none."""
    small_batches(spark)
    judged = materialise(near_duplicates(docs), "judged")
    gone = judged.filter("doc_id <> component_id").select("doc_id").distinct()
    repeated = judged.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    kept = docs.join(few(gone), "doc_id", "left_anti")
    if repeated.limit(1).count():
        again = few(repeated)
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)
