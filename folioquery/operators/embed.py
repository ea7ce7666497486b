"""Embedding providers, and embedding as a column: the model is loaded once in each Python worker."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.sources.documents import ModelError


class EmbeddingProvider(Protocol):
    name: str
    model: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Offline vectors: signed counts of hashed words, with the same result everywhere."""

    name, model = "hashing", "words-1"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        return out.tolist()


class RemoteProvider:
    """Vectors from a function that calls a service; connection errors are tried again after 2 s and 4 s."""

    def __init__(self, name: str, model: str, dimension: int, call: Callable[[list[str]], list[list[float]]], waits: tuple[float, ...] = (2.0, 4.0), sleep: Callable[[float], None] = time.sleep):
        self.name, self.model, self.dimension, self.call, self.waits, self.sleep = name, model, dimension, call, waits, sleep

    def embed(self, texts: list[str]) -> list[list[float]]:
        for wait in (*self.waits, None):
            try:
                return self.call(texts)
            except ConnectionError as error:
                if wait is None:
                    raise ModelError(f"{self.name} does not answer") from error
                self.sleep(wait)
        raise AssertionError


def retried(call: Callable[[], str], retriable: Callable[[Exception], float | None], attempts: int = 3, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """A cloud call: retriable(error) gives the wait it asks for (0: double each time), or None to give up."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as error:
            wait = retriable(error)
            if wait is None or attempt + 1 == attempts:
                raise ModelError(str(error)) from error
            sleep(min(cap, wait or 2.0**attempt))
    raise AssertionError


PROVIDERS: dict[str, Callable[..., EmbeddingProvider]] = {"hashing": HashingProvider}


def provider(name: str, **options) -> EmbeddingProvider:
    if name.lower() not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name.lower()](**options)


_MODELS: dict[Callable, EmbeddingProvider] = {}


def worker_model(make: Callable[[], EmbeddingProvider]) -> EmbeddingProvider:
    """The model that `make` makes, made once in each Python worker."""
    if make not in _MODELS:
        _MODELS.clear()
        _MODELS[make] = make()
    return _MODELS[make]


def embedded(text: Column, make: Callable[[], EmbeddingProvider], batch: int = 32, prefix: str = "") -> Column:
    """Vectors of texts; a vector of another dimension than the provider's is an error. prefix: for queries only."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = [prefix + (t or "") for t in part]
            vectors = [v for i in range(0, len(texts), batch) for v in model.embed(texts[i : i + batch])]
            if any(len(v) != model.dimension for v in vectors) or len(vectors) != len(texts):
                raise ValueError(f"{model.model} did not return {len(texts)} vectors of {model.dimension}")
            yield pd.Series(vectors)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)
