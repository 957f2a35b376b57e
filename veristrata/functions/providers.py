"""Places for models: each is an Arrow iterator UDF that makes its model once a Python worker.

A provider is a zero-argument function that returns the model's function over a list of texts (or of
text pairs); it must be importable on the executors. Nothing here loads or names a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters of the texts that are answered together, at most about (one text at least).
PIECE = 1 << 18


def _pieces(texts: pd.Series) -> Iterator[pd.Series]:
    """The parts of a batch: what a worker holds follows from ``PIECE`` and not from the batch's length."""
    sizes = np.array([0 if t is None else len(t) for t in texts.where(texts.notna(), None)], np.int64)
    part = (np.cumsum(sizes) - sizes) // PIECE
    for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
        yield texts.iloc[own]


def embedder(provider: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """UDF text -> ``array<float>``; null for a null text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = provider()
        for texts in (own for batch in batches for own in _pieces(batch)):
            there = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if there.any():
                out[there] = pd.Series(list(embed(texts[there].tolist())), index=texts.index[there], dtype=object)
            yield out

    return run


def reranker(provider: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """UDF (question, passage) -> score."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = provider()
        for questions, passages in batches:
            yield pd.Series(score(list(zip(questions.fillna(""), passages.fillna("")))), index=questions.index, dtype=float)

    return run


def tokenizer(provider: Callable[[], Callable[[str], list[tuple[int, int]]]]):
    """UDF text -> token offsets ``array<struct<start, end>>``."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        offsets = provider()
        for texts in (own for batch in batches for own in _pieces(batch)):
            yield texts.map(lambda t: [] if t is None else [{"start": a, "end": z} for a, z in offsets(t)])

    return run


def word_offsets() -> Callable[[str], list[tuple[int, int]]]:
    """A tokenizer that needs no model: runs of characters that are not white space."""
    import re

    word = re.compile(r"\S+")
    return lambda text: [m.span() for m in word.finditer(text)]


def hashed_embeddings() -> Callable[[list[str]], list[list[float]]]:
    """An embedder that needs no model: unit vectors from digests, for tests."""
    from .keys import hashed_unit

    return lambda texts: [hashed_unit(t) for t in texts]
