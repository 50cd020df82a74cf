"""Interfaces of model-backed steps, deterministic stand-ins, and their use over DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Texts to unit vectors."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    """Query and text pairs to scores."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    """A prompt to an answer."""

    def __call__(self, prompt: str) -> str: ...


class HashEmbedder:
    """Words hashed to signed coordinates: equal on every machine, similar for texts that share words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)


class LetterEmbedder:
    """How often each of the letters a to z occurs, to length 1: a stand-in that SQL can follow."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        counts = np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in map(str.lower, texts)], float).reshape(-1, 26)
        length = np.linalg.norm(counts, axis=1, keepdims=True)
        return counts / np.where(length == 0, 1, length)


class DigestGenerator:
    """The MD5 of the prompt as its answer: a stand-in that shows which prompt came in."""

    def __call__(self, prompt: str) -> str:
        return hashlib.md5(prompt.encode()).hexdigest()


class OverlapReranker:
    """The share of the query's words that the text holds."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = [(set(q.lower().split()), set(t.lower().split())) for q, t in pairs]
        return [len(q & t) / len(q) if q else 0.0 for q, t in words]


@lru_cache(maxsize=8)
def _loaded(make: Callable[[], object]) -> object:
    return make()


def embed(text: Column, make: Callable[[], Embedder] = HashEmbedder, batch: int = 32) -> Column:
    """Vectors of texts, null for blank ones; a worker loads its model once and runs it in batches."""

    @F.pandas_udf("array<double>")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(make)
        for texts in parts:
            out: list[list[float] | None] = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if t and t.strip()]
            for at in (some[i : i + batch] for i in range(0, len(some), batch)):
                for i, vector in zip(at, model([texts.iloc[i] for i in at]), strict=True):
                    out[i] = list(map(float, vector))
            yield pd.Series(out)

    return each(text)


def token_count(text: Column, make: Callable[[], Callable[[str], int]] | None = None) -> Column:
    """A text's number of tokens by the counter that ``make`` loads on the workers; without one, or where it fails, its characters. Null counts 0.

    It is a cost for ``retrieval.build_context``.
    """
    plain = F.coalesce(F.length(text), F.lit(0)).cast("long")
    if make is None:
        return plain

    @F.pandas_udf("long")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _loaded(make)

        def tokens(t: str | None) -> int | None:
            try:
                return None if t is None else int(count(t))
            except Exception:  # the characters stand in
                return None

        for texts in parts:
            yield texts.map(tokens).astype("Int64")

    return F.coalesce(each(text), plain)


def pair_score(query: Column, text: Column, make: Callable[[], Reranker] = OverlapReranker) -> Column:
    """A cross encoder's score of each query and text."""

    @F.pandas_udf("double")
    def each(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _loaded(make)
        for queries, texts in parts:
            yield pd.Series(model([(q or "", t or "") for q, t in zip(queries, texts, strict=True)]), dtype=float)

    return each(query, text)


def generate(prompt: Column, make: Callable[[], Generator] = DigestGenerator) -> Column:
    """The generator's answer to each prompt; null for a null prompt, empty where the generator fails."""

    @F.pandas_udf("string")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(make)

        def answer(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return model(text) or ""
            except Exception:  # one failed answer doesn't end the batch
                return ""

        for prompts in parts:
            yield prompts.map(answer)

    return each(prompt)


def best_captions(captions: Column, probabilities: Column, k: int = 2, least: float = 0.2) -> Column:
    """The ``k`` likeliest captions of at least ``least``; the likeliest if none is. Distinct, best first."""
    pairs = F.sort_array(F.arrays_zip(probabilities.alias("p"), captions.alias("c")), asc=False)
    top = F.slice(pairs, 1, k)
    good = F.filter(top, lambda x: x["p"] >= least)
    return F.array_distinct(F.transform(F.when(F.size(good) > 0, good).otherwise(F.slice(top, 1, 1)), lambda x: x["c"]))
