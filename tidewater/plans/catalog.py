"""Versioned stage tables of parts: every write adds a part and a commit that names the table's parts.

A plain part adds rows; a keyed part replaces the rows of older parts that have its keys, which reading
sees to. So appending and upserting write in proportion to the new rows, `compact` makes one part of
all, and writers that run at once don't lose each other's rows (see `commits`).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.plans.commits import CommitLog, ConflictError

#: Parts from which an incremental run makes one of them; times that a writer starts over.
MOST_PARTS, ATTEMPTS = 16, 20


class Catalog:
    """Tables below `root`: root/<table>/parts/<id> and root/<table>/_commits."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self, table: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/{table}")

    def versions(self, table: str) -> list[int]:
        """The versions that can still be read, oldest first."""
        return self.log(table).versions()

    def read(self, table: str, schema: str | None = None, version: int | None = None) -> DataFrame:
        """A version, the current one unless told; without any an empty table of `schema`, or FileNotFoundError."""
        log = self.log(table)
        state = log.last()[1] if version is None else log.read(version)
        if state:
            return self._rows(table, state["parts"])
        if schema is None:
            raise FileNotFoundError(table)
        return self.spark.createDataFrame([], schema)

    def _rows(self, table: str, parts: list[dict]) -> DataFrame:
        """Parts from the oldest on; a keyed one takes the place of the rows with its keys."""
        rows: DataFrame | None = None
        waiting: list[dict] = []  # plain parts in a row are read as one

        def with_waiting() -> DataFrame | None:
            if not waiting:
                return rows
            more = [self._part(table, p) for p in waiting]
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), more if rows is None else [rows, *more])

        for p in parts:
            if p["key"] is None:
                waiting.append(p)
                continue
            own, rows, waiting = self._part(table, p), with_waiting(), []
            if rows is not None:
                keys = own.select(F.col(p["key"]).alias("_key")).distinct()
                rows = rows.join(keys, F.col(p["key"]).eqNullSafe(F.col("_key")), "left_anti").unionByName(own, allowMissingColumns=True)
            else:
                rows = own
        return with_waiting()

    def _part(self, table: str, part: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(part["schema"])).parquet(f"{self.root}/{table}/parts/{part['path']}")

    def _write_part(self, df: DataFrame, table: str, key: str | None = None) -> dict:
        """Writes rows to a folder of its own. Nothing refers to it until a commit does; one that failed is deleted."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.root}/{table}/parts/{name}"
        try:
            df.write.parquet(folder)
        except Exception:
            self.log(table).delete(folder)
            raise
        return {"path": name, "key": key, "schema": df.schema.jsonValue(), "holds": [name], "at": time.time_ns()}

    def write(self, df: DataFrame, table: str, keep: int = 2, based_on: int | None = None) -> int:
        """Replaces the table and drops all but the last `keep` versions; gives the new version. A failed
        write leaves the current one. With `based_on`, the version that the rows were made from, it
        raises ConflictError if there is a later one; without, the last writer's rows stand."""
        part = self._write_part(df, table)

        def replaced(version: int, state: dict) -> dict:
            if based_on is not None and version != based_on:
                self.log(table).delete(f"{self.root}/{table}/parts/{part['path']}")
                raise ConflictError(f"{table}: version {version} came after {based_on}")
            return {"parts": [part]}

        version = self._commit(table, replaced)
        self.drop_versions(table, keep)
        return version

    def append(self, df: DataFrame, table: str) -> int:
        """Adds rows; gives the new version. Whatever other writers do meanwhile, these rows come on top."""
        part = self._write_part(df, table)
        return self._commit(table, lambda version, state: {"parts": [*state.get("parts", []), part]})

    def upsert(self, rows: DataFrame | Callable[[DataFrame | None], DataFrame], table: str, key: str) -> int:
        """Puts rows in the place of those with the same keys; gives the new version.

        `rows` may be a function of the current table (None where there is none). If meanwhile another
        writer has put rows of the same keys, or has replaced the table, it is called again with the
        new state; other keys, and rows that don't depend on the table, come on top of what others
        wrote. Several rows of one key in one upsert all stay; null keys count as one key.
        """
        for _ in range(ATTEMPTS):
            version, state = self.log(table).last()
            based = state.get("parts", [])
            made = rows(self._rows(table, based) if based else None) if callable(rows) else rows
            part = self._write_part(made, table, key)

            def on_top(now: int, state: dict, based=based, part=part) -> dict | None:
                parts = state.get("parts", [])
                if callable(rows) and self._touched(table, based, parts, part):
                    return None
                return {"parts": [*parts, part]}

            done = self._commit(table, on_top)
            if done:
                return done
            self.log(table).delete(f"{self.root}/{table}/parts/{part['path']}")
        raise ConflictError(f"{table}: others were faster {ATTEMPTS} times")

    def _touched(self, table: str, based: list[dict], parts: list[dict], own: dict) -> bool:
        """Whether since `based` the table was replaced, or got rows with keys that the part `own` has."""
        before, after = ({i for p in ps for i in p["holds"]} for ps in (based, parts))
        if before - after:
            return True
        keys = self._part(table, own).select(F.col(own["key"]).alias("_key")).distinct()
        new = [p for p in parts if set(p["holds"]) - before]
        return any(not self._part(table, p).join(keys, F.col(own["key"]).eqNullSafe(F.col("_key")), "left_semi").isEmpty() for p in new)

    def _commit(self, table: str, change: Callable[[int, dict], dict | None]) -> int:
        """Publishes what `change` makes of the last state, again and again until no other writer was
        faster; 0 if it makes nothing of it."""
        log = self.log(table)
        while True:
            version, state = log.last()
            new = change(version, state)
            if new is None:
                return 0
            if log.publish(version + 1, new | {"at": time.time_ns()}):
                return version + 1

    def restore(self, table: str, version: int) -> int:
        """Makes an earlier version the current one again, as a new version."""
        parts = self.log(table).read(version)["parts"]
        return self._commit(table, lambda now, state: {"parts": parts})

    def drop_versions(self, table: str, keep: int = 1, older_than: int | None = None) -> None:
        """Drops versions but the last `keep` (and, if told, but those from `older_than` on, in
        nanoseconds), and the parts that only they name. A part that no version has named stays: it may
        be another writer's. Readers of a dropped version fail."""
        log = self.log(table)
        kept, gone = [], []
        found = log.versions()
        for k, v in enumerate(found):
            try:
                state = log.read(v)
            except FileNotFoundError:  # another writer drops versions too
                continue
            (kept if k >= len(found) - keep or (older_than is not None and state["at"] >= older_than) else gone).append((v, state))
        needed = {p["path"] for _, state in kept for p in state["parts"]}
        for v, state in gone:
            log.forget(v)
        for path in {p["path"] for _, state in gone for p in state["parts"]} - needed:
            log.delete(f"{self.root}/{table}/parts/{path}")

    def compact(self, table: str, file_bytes: int = 256 << 20, days: float = 14) -> int:
        """Makes one part of all, in files of about `file_bytes`, then drops the versions that are older
        than `days`; the current one always stays. What others append or upsert meanwhile stays on top
        of it; if they replace the table, theirs stands."""
        log = self.log(table)
        _, state = log.last()
        based = state["parts"]
        size = sum(log.fs.getContentSummary(log.path(f"{self.root}/{table}/parts/{p['path']}")).getLength() for p in based)
        part = self._write_part(self._rows(table, based).repartition(max(1, -(-size // file_bytes))), table)
        part["holds"] = [i for p in based for i in p["holds"]]

        def folded(version: int, state: dict) -> dict | None:
            return {"parts": [part, *state["parts"][len(based) :]]} if state["parts"][: len(based)] == based else None

        version = self._commit(table, folded)
        if not version:
            log.delete(f"{self.root}/{table}/parts/{part['path']}")
        self.drop_versions(table, 1, time.time_ns() - int(days * 86_400e9))
        return version


def run_incremental(catalog: Catalog, table: str, inputs: DataFrame, step, key: str, refresh: bool = False, every: int | None = None) -> DataFrame:
    """Applies `step` to the inputs whose key the table lacks, and appends the rows it gives; `refresh`
    does all anew. With `every` rows are appended after about so many inputs, and a run that breaks off
    goes on where it stopped: each part costs its own inputs and rows, not the table's. From MOST_PARTS
    parts on the table is made one part at the end."""
    known = None if refresh or not catalog.versions(table) else catalog.read(table).select(key)
    lacking = inputs if known is None else inputs.join(known, key, "left_anti")
    if every is None:
        new = step(lacking)
        catalog.write(new, table) if refresh else catalog.append(new, table)
        return _whole(catalog, table)
    parts = max(1, -(-lacking.count() // every))
    waiting = f"{catalog.root}/{table}/waiting-{uuid.uuid4().hex}"
    try:
        lacking.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).write.partitionBy("_part").parquet(waiting)
        for k in range(parts):
            own = catalog.spark.read.schema(lacking.schema).parquet(f"{waiting}/_part={k}") if _there(catalog, f"{waiting}/_part={k}") else lacking.limit(0)
            new = step(own)
            catalog.write(new, table) if refresh and k == 0 else catalog.append(new, table)
    finally:
        catalog.log(table).delete(waiting)
    return _whole(catalog, table)


def _there(catalog: Catalog, folder: str) -> bool:
    log = catalog.log("")
    return log.fs.exists(log.path(folder))


def _whole(catalog: Catalog, table: str) -> DataFrame:
    if len(catalog.log(table).last()[1]["parts"]) >= MOST_PARTS:
        catalog.compact(table)
    return catalog.read(table)


def ledger_rows(df: DataFrame, key: str = "document_id") -> DataFrame:
    """An append-only table's rows once for each key."""
    return df.groupBy(key).agg(F.any_value(F.struct(*[c for c in df.columns if c != key])).alias("_r")).select(key, "_r.*")
