"""What needs a model or another service, behind small interfaces with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewater.functions.replies import read_yaml

#: Longer prompts than this many tokens get no answer.
CONTEXT_TOKENS = 128_000
NO_ANSWER = "No answer was found in the reports."


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


class ChatModel(Protocol):
    """Answers in text; None where a prompt is too long or refused. A ConnectionError may be tried again."""

    def query(self, system: str, user: str, temperature: float = 0.0, max_tokens: int = 1024) -> str | None: ...


class HashEmbedder:
    """Words hashed to signed places, scaled to length one; an empty text is all zero."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, t in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % self.dimensions] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class ExtractiveModel:
    """Answers with the context lines that share most words with the question."""

    def __init__(self, lines: int = 3):
        self.lines = lines

    def query(self, system: str, user: str, temperature: float = 0.0, max_tokens: int = 1024) -> str | None:
        if len(system + user) / 4 > CONTEXT_TOKENS:
            return None
        question, _, context = user.partition("\n")
        asked = set(re.findall(r"\w+", question.lower()))
        scored = [(-len(asked & set(re.findall(r"\w+", x.lower()))), k, x) for k, x in enumerate(context.splitlines()) if x.strip()]
        best = [x for score, _, x in sorted(scored)[: self.lines] if score < 0]
        return "\n".join(best) or NO_ANSWER


def embed_column(df: DataFrame, embedder: Embedder, text: str = "document", into: str = "vector", batch: int = 96) -> DataFrame:
    """Adds `into`, asking the embedder for `batch` texts at a time."""
    columns = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                yield part.assign(**{into: embedder.embed(part[text].tolist(), "document")})

    return df.mapInPandas(run, f"{columns}, `{into}` array<float>")


def answer(question: str, hits: list[tuple[str, str]], model: ChatModel) -> str:
    """The model's answer from (id, text) hits; without hits or an answer a fixed message."""
    context = "\n".join(f"[{i}] {t}" for i, t in hits)
    return (model.query("Answer from the context only.", f"{question}\n{context}") if hits else None) or NO_ANSWER


def ask(model: ChatModel, system: str, user: str, n: int = 1, temperature: float = 0.0, max_tokens: int = 1024, tries: int = 3, pause: float = 60.0) -> list[str] | None:
    """`n` answers; None if the prompt has too many tokens (about four letters each) or any is refused.
    A lost connection is tried again after a pause, `tries` times in all."""
    if len(system + user) / 4 > CONTEXT_TOKENS:
        return None
    out = []
    for _ in range(n):
        for attempt in range(tries):
            try:
                got = model.query(system, user, temperature, max_tokens)
                break
            except ConnectionError:
                if attempt == tries - 1:
                    raise
                time.sleep(pause)
        if got is None:
            return None
        out.append(got)
    return out


#: What a model is told that puts a question into words for a search.
REWRITE = (
    "Put the question into the words of a search: leave out what doesn't say what is sought, and the words "
    "`report` and `safety issue`; change nothing else of its meaning."
)


def rewritten(question: str, model: ChatModel) -> str:
    """The question as a model puts it for a search; as it is where the model has no answer."""
    got = ask(model, REWRITE, question)
    return (got[0].strip() if got else "") or question


def answer_column(df: DataFrame, models: dict[str, ChatModel], model: str, system: str, user: str, into: str = "answers", **how) -> DataFrame:
    """Adds `into`, an array of the model's answers to the prompt in the column `user`; null for a
    null prompt and where there is none. An unknown model raises ValueError."""
    if model not in models:
        raise ValueError(f"unknown model {model}; known: {sorted(models)}")
    chosen, columns = models[model], ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != into)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns=into, errors="ignore").assign(**{into: [None if u is None else ask(chosen, system, u, **how) for u in b[user]]})

    return df.mapInPandas(run, f"{columns}, `{into}` array<string>")


def _fenceless(reply: str) -> str:
    return "\n".join(x for x in reply.strip().splitlines() if not x.strip().startswith(("```", '"""')))


def extract_issues(model: ChatModel, system: str, text: str, **how) -> list[dict] | None:
    """The safety issues (safety_issue, quality) of a model's YAML reply. A reply that isn't a list,
    or whose issues aren't all different, is asked for again, a hundredth warmer each time, up to a
    tenth. None without an answer or a usable reply."""
    import yaml

    for step in range(10):
        got = ask(model, system, text, temperature=step / 100, max_tokens=9096, **how)
        if got is None:
            return None
        try:
            rows = [{"safety_issue": r["safety_issue"].strip(), "quality": r["quality"]} for r in read_yaml(_fenceless(got[0]))]
        except (yaml.YAMLError, TypeError, KeyError, AttributeError):
            continue
        if len({r["safety_issue"] for r in rows}) == len(rows):
            return rows
    return None


#: Fields of a recommendation in a model's reply.
RECOMMENDATION = ("recommendation", "recommendation_id", "recommendation_context", "recipient", "made")


def recommendations_from(reply: str | None) -> list[dict] | None:
    """The recommendations of a YAML reply; null for null, `None` and what can't be read."""
    import yaml

    try:
        rows = read_yaml(_fenceless(reply)) if reply else None
    except yaml.YAMLError:
        return None
    if not isinstance(rows, list):
        return None
    return [{k: None if r.get(k) is None else str(r[k]).strip() for k in RECOMMENDATION} for r in rows if isinstance(r, dict)]


class IssueFinder:
    """Stands in for a model: lists the statements that follow the words `safety issue` as YAML."""

    def query(self, system: str, user: str, temperature: float = 0.0, max_tokens: int = 1024) -> str | None:
        found = dict.fromkeys(" ".join(x.split()) for x in re.findall(r"(?is)safety issues?\s{0,3}[-:]\s{0,3}(.+?)(?=\n|safety issue|$)", user))
        return json.dumps([{"safety_issue": x, "quality": "exact"} for x in found])


def tidy_contents(model: ChatModel | None, raw: str | None) -> str | None:
    """A contents list as a model writes it, without fences; without a model as it is."""
    if raw is None or model is None:
        return raw
    got = ask(model, "Format this table of contents: number, title and page of each entry.", raw)
    return None if got is None else got[0].replace("```", "").strip("\n")
