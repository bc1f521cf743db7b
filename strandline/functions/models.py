"""Places where models plug in: Arrow-batched column functions around a callable over lists, with deterministic stand-ins for tests.

A model is loaded once a Python worker, on first use, by the factory that is passed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def model(factory: Callable[[], Callable], returns: str, batch: int = 32) -> Callable[..., Column]:
    """A column function that calls ``factory()`` once a worker and the model it gives on lists of up to ``batch`` values for each argument.

    The model returns a list as long; if a batch fails, its values are null, for the caller to see.
    """

    @F.pandas_udf(returns)
    def call(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        run = None
        for columns in parts:
            run = run or factory()
            out: list = []
            for a in range(0, len(columns[0]), batch):
                chunk = [c.iloc[a : a + batch].tolist() for c in columns]
                try:
                    got = list(run(*chunk))
                    if len(got) != len(chunk[0]):
                        raise ValueError(f"{len(got)} results for {len(chunk[0])} values")
                except Exception:  # noqa: BLE001 - a failing service must not end the job
                    got = [None] * len(chunk[0])
                out += got
            yield pd.Series(out, dtype=object)

    return call


def embedder(factory: Callable[[], Callable], batch: int = 32, limit: int | None = None) -> Callable[[Column], Column]:
    """Whole texts to vectors; a null text has none. ``limit``: the most characters the encoder takes at once, where it has such a limit."""
    call = model(factory if limit is None else windowed(factory, limit, batch), "array<float>", batch)
    return lambda text: F.when(text.isNotNull(), call(text, F.lit(1)))


def windows(text: str, limit: int) -> list[str]:
    """A text in pieces of up to ``limit`` characters that together are the text, cut after white space where a piece has any."""
    out, a = [], 0
    while len(text) - a > limit:
        cut = next((i + 1 for i in range(a + limit - 1, a, -1) if text[i].isspace()), a + limit)
        out.append(text[a:cut])
        a = cut
    return [*out, text[a:]]


def windowed(factory: Callable[[], Callable], limit: int, batch: int = 32) -> Callable[[], Callable]:
    """The factory of an encoder of texts of any length from that of one with a limit.

    The vectors of a longer text's windows are added, weighted by their lengths, and scaled to length 1.
    """

    def load() -> Callable:
        run = factory()

        def whole(texts: list[str], *_: list) -> list:
            parts = [(i, w) for i, t in enumerate(texts) for w in windows(t or "", limit)]
            got: list = []
            for a in range(0, len(parts), batch):
                sent = [w for _, w in parts[a : a + batch]]
                vectors = list(run(sent, [1] * len(sent)))
                if len(vectors) != len(sent):
                    raise ValueError(f"{len(vectors)} results for {len(sent)} values")
                got += vectors
            each: list[list] = [[] for _ in texts]
            for (i, w), v in zip(parts, got):
                each[i].append((len(w), v))
            out = []
            for e in each:
                if len(e) == 1 or any(v is None for _, v in e):
                    out.append(e[0][1] if len(e) == 1 else None)
                    continue
                total = sum(n * np.asarray(v, np.float64) for n, v in e)
                size = np.linalg.norm(total)
                out.append((total / size if size else total).tolist())
            return out

        return whole

    return load


def scorer(factory: Callable[[], Callable], batch: int = 32) -> Callable[[Column, Column], Column]:
    """(query, passage) to a relevance."""
    return model(factory, "double", batch)


def judge(factory: Callable[[], Callable], batch: int = 32) -> Callable[[Column, Column], Column]:
    """(claim, answer) to the judge's reply, to be read with ``parse.verdict``."""
    return model(factory, "string", batch)


def generator(factory: Callable[[], Callable], batch: int = 8) -> Callable[[Column, Column], Column]:
    """(question, context) to an answer."""
    return model(factory, "string", batch)


def persistent(factory: Callable[[], Callable], attempts: int = 3, budgets: tuple[int, ...] = (256, 1_024)) -> Callable[[], Callable]:
    """The factory of a model that does not give up at once, from that of one that is called with its arguments and a budget of tokens and gives (reply, how it stopped).

    A call that fails is made again, up to ``attempts`` times in all; values whose reply stopped
    with 'length' are asked once more with the next larger budget. A reply that is still cut under
    the largest budget stays as it is.
    """

    def load() -> Callable:
        run = factory()

        def tried(values: list[list], budget: int) -> list:
            for left in range(attempts - 1, -1, -1):
                try:
                    return list(run(*values, budget))
                except Exception:  # noqa: BLE001 - a service may recover
                    if not left:
                        raise
            return []

        def ask(*columns: list) -> list:
            out: list = [None] * len(columns[0])
            open_ = list(range(len(out)))
            for budget in budgets:
                got = tried([[c[i] for i in open_] for c in columns], budget) if open_ else []
                for i, (reply, _) in zip(open_, got):
                    out[i] = reply
                open_ = [i for i, (_, stop) in zip(open_, got) if stop == "length"]
            return out

        return ask

    return load


@lru_cache(maxsize=100_000)
def _digest(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")


class HashEncoder:
    """A stand-in encoder: each word adds a signed unit to a place that its digest picks; the sum is scaled to length 1."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def __call__(self, texts: list[str], *_: list) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in (t or "").lower().split():
                h = _digest(w)
                v[h % self.size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def overlap_scorer() -> Callable:
    """A stand-in reranker: the share of the query's words that the passage has."""

    def run(queries: list[str], passages: list[str]) -> list[float]:
        sets = [(set((q or "").lower().split()), set((p or "").lower().split())) for q, p in zip(queries, passages)]
        return [len(q & p) / len(q) if q else 0.0 for q, p in sets]

    return run


def containing_judge() -> Callable:
    """A stand-in judge: YES if the answer holds every word of the claim."""

    def run(claims: list[str], answers: list[str]) -> list[str]:
        return ["YES" if set((c or "").lower().split()) <= set((a or "").lower().split()) else "NO" for c, a in zip(claims, answers)]

    return run


def wordy_judge() -> Callable:
    """A stand-in judge that thinks aloud: it repeats the claim before its verdict, is cut off where that exceeds the budget (in words), and fails on its first call."""
    state = {"calls": 0}

    def run(claims: list[str], answers: list[str], budget: int) -> list[tuple[str, str]]:
        state["calls"] += 1
        if state["calls"] == 1:
            raise ConnectionError("not ready")
        out = []
        for c, a in zip(claims, answers):
            words = ["<think>", *(c or "").lower().split(), "</think>", "YES" if set((c or "").lower().split()) <= set((a or "").lower().split()) else "NO"]
            out.append((" ".join(words[:budget]), "length" if len(words) > budget else "stop"))
        return out

    return run


def quoting_generator() -> Callable:
    """A stand-in generator: thoughts, and the first passage of the context."""

    def run(questions: list[str], contexts: list[str]) -> list[str]:
        return [f"<think>{q}</think> {(c or '').split(chr(10) + '---' + chr(10))[0]}" for q, c in zip(questions, contexts)]

    return run


def max_sim(query: Column, page: Column) -> Column:
    """Late interaction: for each vector of the query the largest dot product with a vector of the page, summed. Null or empty sides give null."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, v: s + v)
    best = F.transform(query, lambda q: F.array_max(F.transform(page, lambda p: dot(q, p))))
    return F.when((F.size(query) > 0) & (F.size(page) > 0), F.aggregate(best, F.lit(0.0), lambda s, v: s + v))
