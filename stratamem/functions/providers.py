"""Interfaces of the model services, with deterministic stand-ins that need no network.

Every service is a plain callable. An embedder maps texts to vectors, an extractor a text to
facts, a reranker a query and texts to ``(index, score)``, a rewriter a query to a query, a
relation classifier a text and others to ``(index, relation)``, an answerer a question and
context to an answer, a judge a question, a gold and a given answer to a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

T = TypeVar("T")

#: 64-bit FNV-1a, and the replies that are worth another try.
FNV_OFFSET, FNV_PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, 2**64 - 1
RETRYABLE = frozenset({408, 429, 500, 502, 503, 529})
ATTEMPTS, BACKOFF_S = 4, 0.5


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Unit-range vectors from a hash of the text: equal texts get equal vectors, others unrelated ones."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        h = FNV_OFFSET
        for b in text.encode():
            h = ((h ^ b) * FNV_PRIME) & MASK
        state = np.random.default_rng(h)
        return (state.random(self.dim, dtype=np.float32) * 2 - 1).tolist()


def embed(text: Column, embedder: Embedder) -> Column:
    """Vectors of a text column, batch by batch; null texts have none."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            known = s.dropna()
            vecs = embedder(known.tolist()) if len(known) else []
            if any(len(v) != embedder.dim for v in vecs):
                raise ValueError(f"the embedder must give {embedder.dim} components")
            by = dict(zip(known.index, vecs))
            yield pd.Series([by.get(i) for i in s.index], index=s.index, dtype=object)

    return run(text)


def echo_extractor(text: str) -> list[dict]:
    """One fact: the text itself."""
    return [{"content": text, "confidence": 0.5, "single_valued": False}] if text.strip() else []


def identity_reranker(query: str, texts: Sequence[str]) -> list[tuple[int, float]]:
    return [(i, 1.0 / (i + 1)) for i in range(len(texts))]


def identity_rewriter(query: str) -> str:
    return query


def first_extends(text: str, others: Sequence[str]) -> list[tuple[int, str]]:
    return [(0, "extends")] if others else []


def echo_answerer(question: str, context: Sequence[str]) -> str:
    return " | ".join(context)


def substring_judge(question: str, gold: str, given: str) -> bool:
    return gold.casefold() in given.casefold()


def retried(call: Callable[[], T], status_of: Callable[[Exception], int | None], sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of ``call``, tried again with growing pauses while its failures are worth it.

    ``status_of`` gives a failure's status, or None for a broken connection or a timeout.
    """
    for k in range(ATTEMPTS):
        try:
            return call()
        except Exception as e:
            status = status_of(e)
            if k == ATTEMPTS - 1 or (status is not None and status not in RETRYABLE):
                raise
            sleep(BACKOFF_S * 2**k)
    raise AssertionError


class TokenBucket:
    """Requests per minute for each key, refilled continuously; a rate of 0 admits everything."""

    def __init__(self, per_minute: int, clock: Callable[[], float] = time.monotonic):
        self.rate, self.clock, self.left = per_minute, clock, {}

    def admit(self, key: str) -> bool:
        if self.rate == 0:
            return True
        now = self.clock()
        tokens, at = self.left.get(key, (float(self.rate), now))
        tokens = min(float(self.rate), tokens + (now - at) * self.rate / 60)
        self.left[key] = (tokens - 1 if tokens >= 1 else tokens, now)
        return tokens >= 1
