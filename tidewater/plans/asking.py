"""Many calls of a model at once: each distinct prompt once, whatever fails and is repeated.

Prompts are known by a hash. Those that the table of answers lacks are dealt to a stated number of
tasks; a task keeps a bounded number of calls under way, stays within its share of the tokens a minute,
and writes each answer to the shared folder as it comes. A task that is repeated finds its earlier
answers there. When all are in, they go to the table in one commit.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans.catalog import Catalog
from tidewater.plans.providers import CONTEXT_TOKENS, ChatModel, Embedder, ask

#: Calls under way in a task, tasks, and texts of one call to an embedder, at most.
CALLS, TASKS, EMBEDDED = 8, 8, 96
MINUTE = 60.0


def tokens_of(text: str) -> int:
    """About four letters each."""
    return len(text) // 4 + 1


class Budget:
    """Lets at most `tokens` go in any minute; None is no limit. A call that is larger than the budget goes
    when nothing else went for a minute."""

    def __init__(self, tokens: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.tokens, self.clock, self.sleep = tokens, clock, sleep
        self.lock, self.gone, self.sum = threading.Lock(), deque(), 0

    def take(self, tokens: int) -> None:
        """Waits till that many may go; those who wait go one after the other."""
        if self.tokens is None:
            return
        with self.lock:
            while True:
                now = self.clock()
                while self.gone and self.gone[0][0] <= now - MINUTE:
                    self.sum -= self.gone.popleft()[1]
                if not self.gone or self.sum + tokens <= self.tokens:
                    break
                self.sleep(self.gone[0][0] + MINUTE - now)
            self.gone.append((now, tokens))
            self.sum += tokens


class Kept:
    """Answers by hash as small files below a folder of any file system that pyarrow knows."""

    def __init__(self, uri: str):
        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def _path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}.json"

    def get(self, key: str) -> str | None:
        """The answer as JSON; None if there is none yet."""
        try:
            with self.fs.open_input_stream(self._path(key)) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, key: str, answer: str) -> None:
        """Whole or not at all: it is written aside and then renamed."""
        self.fs.create_dir(f"{self.root}/{key[:2]}", recursive=True)
        aside = f"{self.root}/{key[:2]}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(answer.encode())
        self.fs.move(aside, self._path(key))

    def drop(self, keys: list[str]) -> None:
        for key in keys:
            try:
                self.fs.delete_file(self._path(key))
            except FileNotFoundError:
                continue


def answers(
    prompts: DataFrame, column: str, call: Callable[[list[str]], list], catalog: Catalog, about: str,
    table: str = "answers", batch: int = 1, calls: int = CALLS, tasks: int = TASKS, tokens_a_minute: float | None = None,
) -> DataFrame:
    """(hash, answer) of the distinct prompts in a column, answers as JSON. `call` takes up to `batch`
    prompts and gives as many answers that JSON can hold; `about` names the model and its settings, so
    that other settings are asked anew. Null prompts have no answer."""
    shape = "hash string, answer string"
    told = prompts.filter(F.col(column).isNotNull()).select(F.col(column).alias("prompt"), hash_of(column, about).alias("hash"))
    once = told.groupBy("hash").agg(F.any_value("prompt").alias("prompt"))
    todo = once.join(catalog.read(table, shape).select("hash"), "hash", "left_anti")
    waiting, share = f"{catalog.root}/{table}-waiting", None if tokens_a_minute is None else tokens_a_minute / tasks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, budget = Kept(waiting), Budget(share)

        def one(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
            found = {key: kept.get(key) for key, _ in rows}
            new = [(key, prompt) for key, prompt in rows if found[key] is None]
            if new:
                budget.take(sum(tokens_of(prompt) for _, prompt in new))
                for (key, _), got in zip(new, call([prompt for _, prompt in new]), strict=True):
                    found[key] = json.dumps(got)
                    kept.put(key, found[key])
            return list(found.items())

        with ThreadPoolExecutor(calls) as pool:
            for b in batches:
                rows = list(zip(b["hash"], b["prompt"], strict=True))
                lots = [rows[k : k + batch] for k in range(0, len(rows), batch)]
                # A lot is handed out when another is done, so that a failure stops what comes after it.
                under_way: deque = deque()
                for lot in lots:
                    if len(under_way) >= calls:
                        yield pd.DataFrame(under_way.popleft().result(), columns=["hash", "answer"])
                    under_way.append(pool.submit(one, lot))
                while under_way:
                    yield pd.DataFrame(under_way.popleft().result(), columns=["hash", "answer"])

    def forget(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            Kept(waiting).drop(b["hash"].tolist())
            yield b

    new = catalog.append(todo.repartition(tasks, "hash").mapInPandas(run, shape), table)
    parts = catalog.log(table).read(new)["parts"]
    if parts:  # what is in the table need not wait any more
        catalog._part(table, parts[-1]).select("hash").mapInPandas(forget, "hash string").write.format("noop").mode("overwrite").save()
    return catalog.read(table, shape).join(once.select("hash"), "hash", "left_semi")


def hash_of(column: str, about: str):
    return F.sha2(F.concat(F.lit(f"{about}\n"), F.col(column)).cast("binary"), 256)


def about_model(name: str, *settings) -> str:
    return hashlib.sha256(json.dumps([name, *settings]).encode()).hexdigest()


def ask_column(df: DataFrame, model: ChatModel, system: str, user: str, catalog: Catalog, name: str, into: str = "answers", n: int = 1, temperature: float = 0.0, max_tokens: int = 1024, tries: int = 3, pause: float = 60.0, **limits) -> DataFrame:
    """Adds `into`, an array of n answers to the prompt in the column `user`: rows of one prompt share
    them, and prompts that were answered before aren't asked. Null for null, for prompts of too many
    tokens and for refused ones. A column of that name is replaced."""
    about = about_model(name, system, n, temperature, max_tokens, CONTEXT_TOKENS)

    def call(prompts: list[str]) -> list:
        return [ask(model, system, p, n, temperature, max_tokens, tries, pause) for p in prompts]

    return _joined(df, user, into, "array<string>", answers(df, user, call, catalog, about, **limits), about)


def embed_texts(df: DataFrame, embedder: Embedder, text: str, catalog: Catalog, name: str, into: str = "vector", kind: str = "document", **limits) -> DataFrame:
    """Adds `into`, the vector of the text in a column, EMBEDDED texts a call; as `ask_column` otherwise."""
    about = about_model(name, kind, embedder.dimensions)
    got = answers(df, text, lambda texts: embedder.embed(texts, kind), catalog, about, **({"table": "vectors", "batch": EMBEDDED} | limits))
    return _joined(df, text, into, "array<double>", got, about)


def _joined(df: DataFrame, column: str, into: str, kind: str, got: DataFrame, about: str) -> DataFrame:
    kept = [c for c in df.columns if c != into]
    keyed = df.select(*(F.col(f"`{c}`") for c in kept), hash_of(column, about).alias("_hash"))
    # `null` in JSON is an answer too: there is none to be had.
    told = got.select(F.col("hash").alias("_hash"), F.from_json("answer", kind).alias(into))
    return keyed.join(told, "_hash", "left").select(*(F.col(f"`{c}`") for c in kept), into)
