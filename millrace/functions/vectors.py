"""Vectors: length, product, cosine, and an offline embedding of tokens by hash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS = 1024  # texts that are counted together


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def normalise(a: Column) -> Column:
    """Scaled to length 1; zero vectors stay."""

    def scaled(v: Column) -> Column:
        return bound(norm(v), lambda size: F.when(size == 0, v).otherwise(F.transform(v, lambda x: x / size)))

    return bound(a.cast("array<double>"), scaled)


def hashed_embedding(tokens: Column, dim: int = 64, tfs: Column | None = None) -> Column:
    """Token counts by hash bucket, scaled to length 1; no tokens or null give zeros. With ``tfs`` a token counts so many times.

    Whole Arrow batches are counted, ROWS texts at once; each distinct token of these is hashed once.
    """

    def unit(tokens: pa.Array, times: pa.Array | None) -> pa.Array:
        found = []
        for low in range(0, len(tokens), ROWS):
            own = tokens.slice(low, ROWS)
            row, coded = np.asarray(pc.list_parent_indices(own)).astype(np.int64), pc.list_flatten(own).dictionary_encode()
            names = coded.dictionary.to_pylist()
            buckets = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in names], np.int64)[coded.indices.to_numpy()]
            weights = None if times is None else pc.list_flatten(times.slice(low, ROWS)).to_numpy().astype(float)
            counts = np.bincount(row * dim + buckets, weights, minlength=len(own) * dim).astype(float).reshape(len(own), dim)
            size = np.sqrt((counts**2).sum(axis=1, keepdims=True))
            found.append(np.divide(counts, size, out=counts, where=size > 0).ravel())
        flat = np.concatenate([*found, np.empty(0)])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(tokens) * dim + 1, dim, dtype=np.int32)), pa.array(flat))

    @F.arrow_udf("array<double>")
    def once(tokens: pa.Array) -> pa.Array:
        return unit(tokens, None)

    @F.arrow_udf("array<double>")
    def weighted(tokens: pa.Array, times: pa.Array) -> pa.Array:
        return unit(tokens, times)

    tokens = F.coalesce(tokens, F.array().cast("array<string>"))
    return once(tokens) if tfs is None else weighted(tokens, tfs)


def provider_embedding(embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Callable[[Column], Column]:
    """A column function that sends texts to a provider in batches; blank texts go as one space, vectors come scaled to length 1."""

    @F.pandas_udf("array<double>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t if t and t.strip() else " " for t in s]
            found = [v for lo in range(0, len(texts), batch) for v in embed(texts[lo : lo + batch])]
            m = np.array(found, dtype=float).reshape(len(texts), -1)
            size = np.sqrt((m**2).sum(axis=1, keepdims=True))
            yield pd.Series(list(np.divide(m, size, out=np.zeros_like(m), where=size > 0)))

    return lambda text: embedded(text)
