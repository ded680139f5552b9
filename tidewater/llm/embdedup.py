"""Embedding near-dedup by sorted projection passes.

In each pass the signs of random projections are concatenated to one long number; vectors are
sorted by it, and each is compared with a bounded window of neighbours, across the ends of
partitions too. Pairs whose cosine reaches the threshold are united across passes. The projections
are of the vectors less their mean, so that a direction which all share doesn't decide the order.

A pair is met in a pass if it agrees in about the first log2(rows / neighbours) signs, so the number
of passes follows from the number of rows, the spread of the vectors and the wanted recall: it grows
with the table and the recall doesn't fall. Where vectors of one source lie close together inside a
spread-out table, signs that tell the table's vectors apart don't tell theirs apart. So all vectors are
filed under the nearest of some pivots, cells whose means point one way are a region, and a region that
by its own rows and spread needs more passes than the table gets them, around its own mean; or all its
pairs are compared, in blocks, where that is less work than the passes would be.

Within the components so found every link is counted exactly, so that a window never bounds how many
partners a vector has. An exact pass over all pairs of blocks (`exact`) is there for tables that must
not lose one link; its work grows with the square.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import drop_written, materialise, release, table, worker_state
from tidewater.llm.components import connected_components

THRESHOLD = 0.9
#: Share of the pairs just at the threshold that the passes are to meet, each pair for itself.
RECALL = 0.995
#: Passes of one job; neighbours after each vector; hashes of a key; least passes.
PASSES_AT_ONCE = 4
NEIGHBOURS = 256
HASHES = 63
LEAST_PASSES = 4
#: More passes than these make way for comparing all pairs in blocks, where that is less work.
MANY_PASSES = 64
#: A pivot for so many vectors, and the most of them; the cosine of their cells' means from which cells are one region.
PIVOT_ROWS, MOST_PIVOTS = 64, 1024
ALIKE = 0.5
SEED = 7
#: Rows of a block of comparisons; rows of a sorted partition, about.
BLOCK = 512
PARTITION_ROWS = 20_000
#: Exact pass: pivots that order the vectors; rows of a partition, about; values broadcast at once.
PIVOTS = 256
EXACT_ROWS = 2048
CHUNK_VALUES = 4_000_000
#: Members of small components that are compared in one group, about.
GROUP_ROWS = 4096
#: What single precision may err by in a cosine, on the safe side.
SLACK = 1e-4


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: list) -> list[np.ndarray]:
    """Unit vectors in double precision, safe for very large and very small components."""
    out = []
    for v in vectors:
        x = np.asarray(v, np.float64)
        x = x / np.abs(x).max()
        out.append(x / np.sqrt((x * x).sum()))
    return out


def passes_for(rows: int, spread: float, threshold: float, neighbours: int, recall: float) -> int:
    """The passes after which two vectors of cosine `threshold` have met with the chance `recall`.
    `spread` is the mean squared distance of unit vectors from their mean: less the mean, such a
    pair has the cosine 1 - (1 - threshold) / spread, and agrees in a sign with the chance of its angle.
    Where the mean cosine of all pairs is over the threshold nearly all link, and any window does."""
    if 1 - spread >= threshold:
        return LEAST_PASSES
    agree = 1 - math.acos(max(-1.0, 1 - (1 - threshold) / spread)) / math.pi
    met = max(agree ** math.log2(max(2.0, rows / neighbours)), 1e-12)
    return max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log1p(-met))) if met < 1 else LEAST_PASSES


def sort_keys(unit: np.ndarray, first: int, passes: int, mean: np.ndarray | float = 0.0) -> np.ndarray:
    """(rows, passes) keys: the signs of HASHES random projections of each pass, the first leading."""
    out = np.empty((len(unit), passes), np.int64)
    weights = 1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64)
    for p in range(passes):
        planes = np.random.default_rng((SEED, first + p, unit.shape[1])).standard_normal((HASHES, unit.shape[1]))
        out[:, p] = ((unit - mean) @ planes.T >= 0) @ weights
    return out


def centres(reps: DataFrame) -> dict[int, tuple[np.ndarray, float, int]]:
    """length -> (mean of the unit vectors of that length, their mean squared distance from it, their number)."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for b in batches:
            for u in units(b["embedding"].tolist()):
                held = sums.setdefault(len(u), [0, 0.0])
                held[0] += 1
                held[1] = held[1] + u
        yield pd.DataFrame([(d, n, total.tolist()) for d, (n, total) in sums.items()], columns=["dim", "n", "total"])

    found: dict[int, list] = {}
    for r in reps.select("embedding").mapInPandas(add, "dim long, n long, total array<double>").toLocalIterator():
        held = found.setdefault(r["dim"], [0, 0.0])
        held[0] += r["n"]
        held[1] = held[1] + np.array(r["total"])
    means = {d: (total / n, n) for d, (n, total) in found.items()}
    return {d: (m, 1 - float(m @ m), n) for d, (m, n) in means.items()}


def _spread(first: int, passes: int, means: dict[int, np.ndarray]):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = units(b["embedding"].tolist())
            for dim in sorted({len(u) for u in own}):
                at = [i for i, u in enumerate(own) if len(u) == dim]
                matrix = np.array([own[i] for i in at])
                keys, ids, raw = sort_keys(matrix, first, passes, means[dim]), b["rid"].to_numpy()[at], [u.tobytes() for u in matrix]
                for p in range(passes):
                    yield pd.DataFrame({"lane": np.int64(dim) * 100_000 + first + p, "key": keys[:, p], "rid": ids, "unit": raw})

    return emit


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same nodes as the pairs (a, b), fewer than there are nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root if find(x) != x]


def near_pairs(unit: np.ndarray, threshold: float, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows and those of their next `neighbours` rows that are within the threshold."""
    single, left, right = unit.astype(np.float32), [], []
    for at in range(0, len(unit), neighbours):
        i, j = np.nonzero(single[at : at + neighbours] @ single[at : at + 2 * neighbours].T >= threshold - SLACK)
        fine = (j > i) & (j - i <= neighbours)
        i, j = i[fine] + at, j[fine] + at
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        left.append(i[near])
        right.append(j[near])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _links(rows: pd.DataFrame, threshold: float, neighbours: int) -> list[tuple[int, int]]:
    """Links that unite what the windows over sorted rows (lane, rid, unit) meet."""
    out = []
    for _, own in rows.groupby("lane", sort=False):
        ids, unit = own["rid"].to_numpy(), np.frombuffer(b"".join(own["unit"])).reshape(len(own), -1)
        i, j = near_pairs(unit, threshold, neighbours)
        out += forest(ids[i], ids[j])
    return out


#: Rows of kind 0 are links (a, b); those of kind 1 the ends of partitions: a the border, b the id, and the place in order.
MET = "kind int, a long, b long, lane long, place long, unit binary"


def _windows(threshold: float, neighbours: int):
    """Compares each row of a sorted partition with the next ones; memory holds one window and batch.
    The first and last rows go to the borders with the partitions before and behind."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, waiting, size = TaskContext.get().partitionId(), 0, [], 0
        tail = pd.DataFrame({"lane": np.zeros(0, np.int64), "rid": np.zeros(0, np.int64), "unit": []})

        def ends(rows: pd.DataFrame, border: int, place: int) -> pd.DataFrame:
            return pd.DataFrame(
                {"kind": 1, "a": border, "b": rows["rid"], "lane": rows["lane"], "place": np.arange(place, place + len(rows)), "unit": rows["unit"]},
            )

        def met(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(0, x, y, 0, 0, None) for x, y in _links(rows, threshold, neighbours)], columns=["kind", "a", "b", "lane", "place", "unit"])

        for b in batches:
            own = b[["lane", "rid", "unit"]]
            if seen < neighbours:
                yield ends(own.iloc[: neighbours - seen], part, seen)
            seen += len(own)
            waiting.append(own)
            size += len(own)
            if size >= 8 * neighbours:
                rows = pd.concat([tail, *waiting], ignore_index=True)
                yield met(rows)
                tail, waiting, size = rows.iloc[-neighbours:], [], 0
        rows = pd.concat([tail, *waiting], ignore_index=True)
        yield met(rows)
        yield ends(rows.iloc[-neighbours:], part + 1, -min(neighbours, len(rows)))

    return compare


def find_links(reps: DataFrame, threshold: float, passes: int, neighbours: int, means: dict[int, np.ndarray]) -> DataFrame:
    """(a, b): verified links of distinct vectors (rid, embedding) that unite what the passes find."""
    n = reps.count()
    found = None

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place").rename(columns={"b": "rid"})
        return pd.DataFrame(_links(rows, threshold, neighbours), columns=["a", "b"], dtype=np.int64)

    # Small regions take more passes at once: a job then has as many rows as it may have anyway.
    at_once = max(PASSES_AT_ONCE, PASSES_AT_ONCE * PARTITION_ROWS // max(1, n))
    for first in range(0, passes, at_once):
        some = min(at_once, passes - first)
        parts = max(1, round(n * some / PARTITION_ROWS))
        spread = reps.select("rid", "embedding").mapInPandas(_spread(first, some, means), "lane long, key long, rid long, unit binary")
        ordered = spread.repartitionByRange(parts, "lane", "key", "rid").sortWithinPartitions("lane", "key", "rid")
        met = materialise(ordered.mapInPandas(_windows(threshold, neighbours), MET), "vector-windows")
        links = met.filter("kind = 0").select("a", "b")
        if parts > 1:
            links = links.union(met.filter("kind = 1").groupBy("a").applyInPandas(meet, "a long, b long"))
        links = materialise(links.distinct(), "vector-links")
        drop_written(met)
        found = links if found is None else found.union(links)
        release(reps.sparkSession)
    return found


@dataclass(frozen=True)
class Region:
    """Cells (by their pivots' numbers) of vectors of one length that lie close together, all their rows,
    and the mean of those that make it out."""

    dim: int
    pivots: list[int]
    rows: int
    mean: np.ndarray

    @property
    def spread(self) -> float:
        return 1 - float(self.mean @ self.mean)


def regions(reps: DataFrame) -> tuple[list[Region], DataFrame]:
    """The regions of distinct vectors (rid, embedding), and the vectors with their two nearest pivots
    (rid, embedding, p1, p2). Every vector is filed; the pivots are chosen by a hash of their ids, and
    the driver holds them and their cells' means: MOST_PIVOTS vectors, twice."""
    chosen = reps.orderBy(F.xxhash64(F.lit("region"), "rid")).limit(max(1, min(MOST_PIVOTS, reps.count() // PIVOT_ROWS))).select("embedding").collect()
    numbered: dict[int, list] = {}
    for k, u in enumerate(units([r["embedding"] for r in chosen])):
        numbered.setdefault(len(u), []).append((k, u))
    pivots = {dim: (np.array([k for k, _ in own], np.int64), np.array([u for _, u in own])) for dim, own in numbered.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = units(b["embedding"].tolist())
            near = np.full((len(own), 2), -1, np.int64)
            for dim in {len(u) for u in own} & pivots.keys():
                at = [i for i, u in enumerate(own) if len(u) == dim]
                numbers, matrix = pivots[dim]
                order = np.argsort(-(np.array([own[i] for i in at]) @ matrix.T), 1, kind="stable")
                near[at] = numbers[order[:, [0, min(1, len(numbers) - 1)]]]
            yield b.assign(p1=near[:, 0], p2=near[:, 1])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, u in zip(b["p1"].tolist(), units(b["embedding"].tolist()), strict=True):
                held = sums.setdefault(k, [0, 0.0])
                held[0] += 1
                held[1] = held[1] + u
        yield pd.DataFrame([(k, n, total.tolist()) for k, (n, total) in sums.items()], columns=["p1", "n", "total"])

    def pool(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p1": group["p1"].iloc[:1], "n": group["n"].sum(), "total": [np.sum(group["total"].tolist(), 0).tolist()]})

    shape = "p1 long, n long, total array<double>"
    placed = materialise(reps.select("rid", "embedding").mapInPandas(place, "rid long, embedding array<double>, p1 long, p2 long"), "vector-pivots")
    cells = placed.filter("p1 >= 0").select("p1", "embedding").mapInPandas(add, shape).groupBy("p1").applyInPandas(pool, shape).collect()
    by_dim: dict[int, list] = {}
    for r in sorted(cells, key=lambda r: r["p1"]):
        by_dim.setdefault(len(r["total"]), []).append((r["p1"], r["n"], np.array(r["total"])))
    grouped: list[tuple[int, list]] = []
    for dim, own in by_dim.items():
        directions = np.array([total / max(np.sqrt(total @ total), 1e-300) for *_, total in own])
        i, j = np.nonzero(directions @ directions.T >= ALIKE)
        root = dict(forest(i, j))
        groups: dict[int, list] = {}
        for k in range(len(own)):
            groups.setdefault(root.get(k, k), []).append(own[k])
        grouped += [(dim, g) for g in groups.values()]
    # Strangers that are filed with a source for want of a nearer pivot would make it seem wider than it is:
    # a region's mean is that of the vectors that lie at least half as far along its direction as its mean.
    means = [np.sum([x[2] for x in g], 0) / sum(x[1] for x in g) for _, g in grouped]
    region_of = {x[0]: k for k, (_, g) in enumerate(grouped) for x in g}

    def add_near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for b in batches:
            for p, u in zip(b["p1"].tolist(), units(b["embedding"].tolist()), strict=True):
                k = region_of[p]
                if u @ means[k] >= 0.5 * (means[k] @ means[k]):
                    held = sums.setdefault(k, [0, 0.0])
                    held[0] += 1
                    held[1] = held[1] + u
        yield pd.DataFrame([(k, n, total.tolist()) for k, (n, total) in sums.items()], columns=["p1", "n", "total"])

    near = placed.filter("p1 >= 0").select("p1", "embedding").mapInPandas(add_near, shape).groupBy("p1").applyInPandas(pool, shape).collect()
    means = {r["p1"]: np.array(r["total"]) / r["n"] for r in near}
    return [Region(dim, [x[0] for x in g], sum(x[1] for x in g), means[k]) for k, (dim, g) in enumerate(grouped) if k in means], placed


def links_of_regions(reps: DataFrame, threshold: float, passes: int, neighbours: int, recall: float) -> DataFrame | None:
    """Links (a, b) within the regions that by themselves need more than `passes`; None without such.
    A vector takes part in the regions of its two nearest pivots, so that a pair which a border parts
    is together on one of its sides."""
    found, placed = None, None
    told, placed = regions(reps)
    for r in told:
        needed = passes_for(r.rows, r.spread, threshold, neighbours, recall)
        if r.rows <= neighbours or needed <= passes:
            continue
        own = placed.filter((F.size("embedding") == r.dim) & (F.col("p1").isin(r.pivots) | F.col("p2").isin(r.pivots))).select("rid", "embedding")
        if needed > MANY_PASSES and 2 * needed * neighbours >= r.rows:
            links = exact_links(own, threshold)
        else:
            links = find_links(own, threshold, needed, neighbours, {r.dim: r.mean})
        found = links if found is None else found.union(links)
    drop_written(placed)
    return found


class Chunk:
    """Rows of (dim, pivot, rid, unit) in that order, cut into blocks with centre and radius."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        rows = sorted(rows, key=lambda r: r[:3])
        self.by_dim: dict[int, tuple] = {}
        for dim in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == dim]
            unit = np.array([np.frombuffer(r[3]) for r in own])
            blocks = []
            for at in range(0, len(own), BLOCK):
                part = unit[at : at + BLOCK]
                centre = part.sum(0)
                size = np.sqrt((centre * centre).sum())
                centre = centre / size if size > SLACK else part[0]
                radius = np.arccos(np.clip((part @ centre).min(), -1, 1))
                blocks.append((at, own[min(at + BLOCK, len(own)) - 1][1:3], centre, radius))
            self.by_dim[dim] = (np.array([r[2] for r in own], np.int64), unit, unit.astype(np.float32), blocks)

    def links(self, dim: int, first: tuple[int, int], ids: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[list, list]:
        """Ids of the pairs of rows and own rows within the threshold; blocks wholly before the key
        `first` are left to the rows that stand there."""
        left, right = [], []
        if dim not in self.by_dim:
            return left, right
        own, exact, single, blocks = self.by_dim[dim]
        blocks = [b for b in blocks if b[1] >= first]
        if not blocks:
            return left, right
        angles = np.arccos(np.clip(unit @ np.array([b[2] for b in blocks]).T, -1, 1))
        reach = np.arccos(np.clip(threshold, -1, 1)) + np.array([b[3] for b in blocks]) + SLACK
        rows32 = unit.astype(np.float32)
        for k, (at, *_) in enumerate(blocks):
            rows = np.flatnonzero(angles[:, k] <= reach[k])
            if not len(rows):
                continue
            i, j = np.nonzero(rows32[rows] @ single[at : at + BLOCK].T >= threshold - SLACK)
            i, j = rows[i], j + at
            other = ids[i] != own[j]
            i, j = i[other], j[other]
            near = np.einsum("ij,ij->i", unit[i], exact[j]) >= threshold
            left.append(ids[i[near]])
            right.append(own[j[near]])
        return left, right


def exact_links(reps: DataFrame, threshold: float, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """(a, b): verified links of distinct vectors (rid, embedding) that unite all pairs within the
    threshold. Chunks of bounded size are broadcast one after the other and met by all rows; the
    work grows with the square of the rows as far as the blocks' angles exclude nothing."""
    spark = reps.sparkSession
    size = F.size("embedding")
    n, values = reps.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    chosen = reps.orderBy(F.xxhash64(F.lit("pivot"), "rid")).limit(PIVOTS).select("embedding").collect()
    pivots: dict[int, list] = {}
    for u in units([r["embedding"] for r in chosen]):
        pivots.setdefault(len(u), []).append(u)
    matrices = {dim: np.array(own) for dim, own in pivots.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = units(b["embedding"].tolist())
            at = [int((matrices[len(u)] @ u).argmax()) if len(u) in matrices else 0 for u in own]
            yield pd.DataFrame({"dim": [len(u) for u in own], "pivot": at, "rid": b["rid"], "unit": [u.tobytes() for u in own]})

    placed = materialise(reps.select("rid", "embedding").mapInPandas(place, "dim long, pivot long, rid long, unit binary"), "vector-places")
    chunks = max(1, -(-values // chunk_values))
    found = None
    for c in range(chunks):
        mine = placed.filter(F.pmod(F.xxhash64(F.lit("chunk"), "rid"), F.lit(chunks)) == c)
        held, name = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()]), uuid.uuid4().hex

        def compare(batches: Iterator[pd.DataFrame], held=held, name=name) -> Iterator[pd.DataFrame]:
            chunk = worker_state(("vector-chunk", name), lambda: Chunk(held.value))
            for b in batches:
                left, right = [], []
                for dim, own in b.groupby("dim"):
                    first = min(zip(own["pivot"].tolist(), own["rid"].tolist(), strict=True))
                    some = chunk.links(dim, first, own["rid"].to_numpy(), np.array([np.frombuffer(u) for u in own["unit"]]), threshold)
                    left += some[0]
                    right += some[1]
                yield pd.DataFrame(forest(np.concatenate(left), np.concatenate(right)) if left else [], columns=["a", "b"], dtype=np.int64)

        ordered = placed.repartitionByRange(max(1, round(n / EXACT_ROWS)), "dim", "pivot", "rid").sortWithinPartitions("dim", "pivot", "rid")
        links = materialise(ordered.mapInPandas(compare, "a long, b long").distinct(), "vector-links")
        found = links if found is None else found.union(links)
        held.unpersist()
        release(spark)
    drop_written(placed)
    return found


def count_links(members: DataFrame, threshold: float, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """(rid, n): for members (component, rid, mult, embedding) the copies of all others of their
    component within the threshold. Small components are compared many at a time; of large ones a
    chunk of bounded size is broadcast and met by their members, so that no vector is sent twice."""
    spark = members.sparkSession
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.sum(F.size("embedding").cast("long")).alias("values"))
    sized = materialise(members.join(sizes, "component"), "vector-sized")
    small, large = sized.filter(F.col("size") <= BLOCK), sized.filter(F.col("size") > BLOCK)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("component"):
            unit = units(own["embedding"].tolist())
            for dim in {len(u) for u in unit}:
                at = [k for k, u in enumerate(unit) if len(u) == dim]
                matrix = np.array([unit[k] for k in at])
                near = matrix @ matrix.T >= threshold
                np.fill_diagonal(near, False)
                out.append(pd.DataFrame({"rid": own["rid"].to_numpy()[at], "n": near @ own["mult"].to_numpy()[at]}))
        return pd.concat(out) if out else pd.DataFrame({"rid": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})

    groups = max(1, small.count() // GROUP_ROWS)
    counted = small.withColumn("g", F.pmod(F.xxhash64("component"), F.lit(groups))).groupBy("g").applyInPandas(count, "rid long, n long")
    counted = materialise(counted, "vector-counts")
    values = large.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    chunks = -(-values // chunk_values)
    # A large component lies in one chunk; one of more values than a chunk is cut into several.
    cuts = F.ceil(F.col("values") / chunk_values)
    placed = large.withColumns(
        {"chunk": F.pmod(F.xxhash64("component"), F.lit(max(1, chunks))), "cut": F.pmod(F.xxhash64(F.lit("cut"), "rid"), cuts), "cuts": cuts},
    )
    for c in range(chunks):
        own = materialise(placed.filter(F.col("chunk") == c), "vector-chunk")
        for k in range(own.agg(F.max("cuts")).first()[0] or 0):
            some = own.filter(F.col("cut") == k).select("component", "rid", "mult", "embedding")
            chunk_rows = [(r["component"], r["rid"], r["mult"], units([r["embedding"]])[0].tobytes()) for r in some.toLocalIterator()]
            held, name = spark.sparkContext.broadcast(chunk_rows), uuid.uuid4().hex

            def compare(batches: Iterator[pd.DataFrame], held=held, name=name) -> Iterator[pd.DataFrame]:
                def arrange() -> dict:
                    out: dict[tuple[int, int], list] = {}
                    for component, rid, mult, raw in held.value:
                        out.setdefault((component, len(raw) // 8), []).append((rid, mult, raw))
                    matrix = lambda rows: np.frombuffer(b"".join(r[2] for r in rows)).reshape(len(rows), -1)
                    return {key: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), matrix(rows)) for key, rows in out.items()}

                chunk = worker_state(("vector-chunk", name), arrange)
                for b in batches:
                    out = []
                    for component, rows in b.groupby("component"):
                        unit = units(rows["embedding"].tolist())
                        for dim in {len(u) for u in unit}:
                            if (component, dim) not in chunk:
                                continue
                            at = [i for i, u in enumerate(unit) if len(u) == dim]
                            ids, mults, others = chunk[component, dim]
                            mine, n = rows["rid"].to_numpy()[at], np.zeros(len(at), np.int64)
                            matrix = np.array([unit[i] for i in at])
                            for s in range(0, len(ids), 8 * BLOCK):
                                near = matrix @ others[s : s + 8 * BLOCK].T >= threshold
                                near &= mine[:, None] != ids[None, s : s + 8 * BLOCK]
                                n += near @ mults[s : s + 8 * BLOCK]
                            out.append(pd.DataFrame({"rid": mine, "n": n}))
                    if out:
                        yield pd.concat(out)

            met = own.select("component", "rid", "embedding").repartition(max(1, round(own.count() / EXACT_ROWS)), "rid")
            counted = counted.union(materialise(met.mapInPandas(compare, "rid long, n long"), "vector-counts"))
            held.unpersist()
        drop_written(own)
    out = materialise(counted.groupBy("rid").agg(F.sum("n").alias("n")), "vector-counts")
    drop_written(sized)
    return out


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    neighbours: int = NEIGHBOURS,
    passes: int | None = None,
    exact: bool = False,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding).

    The passes follow from `recall` unless their number is given; `exact` adds the pass over all pairs.
    Equal vectors are one class that is compared once; a class of n copies has n - 1 links inside.
    Null, empty or all-zero vectors, those with a null or non-finite component, and rows with a
    null id link with nothing. Vectors of different lengths never link. Ids are taken as unique,
    except that repeated rows count as copies. An empty table gives no rows.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    keyed = own.withColumns({"h1": F.when(fine, F.xxhash64("embedding")), "h2": F.when(fine, F.xxhash64(F.lit("second"), "embedding"))})
    classes = keyed.filter(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rid"),
        F.count("*").alias("mult"),
        F.any_value("embedding").alias("embedding"),
    )
    classes = materialise(classes, "vector-classes")
    around = centres(classes)
    rows = sum(n for *_, n in around.values())
    given = passes is not None
    if not given:
        passes = max((passes_for(n, spread, threshold, neighbours, recall) for _, spread, n in around.values()), default=LEAST_PASSES)
    if not given and len(around) == 1 and passes > MANY_PASSES and 2 * passes * neighbours >= rows:
        links = exact_links(classes, threshold)  # all vectors lie close together
    else:
        links = find_links(classes, threshold, passes, neighbours, {d: m for d, (m, *_) in around.items()})
        if not given and rows > neighbours:
            more = links_of_regions(classes, threshold, passes, neighbours, recall)
            links = links if more is None else links.union(more)
    if exact:
        links = links.union(exact_links(classes, threshold))
    nodes = materialise(connected_components(links).select(F.col("node").alias("rid"), "component"), "vector-components")
    members = materialise(classes.join(nodes, "rid").select("component", "rid", "mult", "embedding"), "vector-members")
    counts = count_links(members, threshold)
    judged = classes.select("h1", "h2", "rid", "mult").join(nodes, "rid", "left").join(counts, "rid", "left")
    judged = judged.select(
        "h1",
        "h2",
        F.coalesce("component", "rid").alias("component"),
        (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n"),
    )
    judged = materialise(judged, "vector-results")
    for served in (classes, nodes, members, counts):
        drop_written(served)
    out = keyed.select("vec_id", "h1", "h2").join(judged, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
