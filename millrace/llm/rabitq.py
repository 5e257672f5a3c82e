"""Nearest neighbours from randomly rotated one-bit codes.

A vector x is centred, scaled to length 1 and rotated; the signs of its
coordinates are its code (one bit each, packed). With two correction scalars,
the length before scaling and the dot product between the unit vector and its
code, a code gives an unbiased estimate of <x, q> and a bound on the error that
shrinks with the number of bits. A search takes, for every query, the vectors
whose lower bound reaches the current k-th best distance, and ranks those by
the exact distance between the original vectors, in double precision.

The centre is the mean of a bounded sample; every row is indexed. Queries come
in blocks of about ``block`` vectors, fewer where they have many dimensions: one block at a time is sent to the tasks
(a bounded size), each task scans its part of the index and keeps k rows per
query, and a window over (tasks x k) rows per query gives the result. A query
meets every row, but no pairs are ever materialised.

Defined cases: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part, nor do null ids; equal
distances go to the smaller vec_id; candidates repeated under one vec_id are
listed each, and of a repeated query id the row with the smallest vector is the
query; fewer than k candidates give fewer rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, stash

RESULT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class RabitqParams:
    k: int = 10
    sample: int = 4096  # rows that the centre is fitted on
    block: int = 4096  # queries sent to the tasks at once, at most
    table_bytes: int = 64 << 20  # of a task's byte tables for one block
    spread: float = 3.0  # error bound in standard deviations of the estimate
    rows: int = 2048  # index rows compared at once
    seed: int = 7


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def valid(v: Column, dim: int) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class RabitqIndex:
    """rows: vec_id, embedding, code, length, dot."""

    rows: DataFrame
    centre: np.ndarray
    turn: np.ndarray


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths and dot products of the rows of ``x``."""
    moved = x - centre
    length = np.sqrt((moved**2).sum(axis=1))
    unit = moved @ turn.T / np.where(length > 0, length, 1)[:, None]
    code = np.packbits(unit > 0, axis=1)
    dot = np.where(length > 0, np.abs(unit).sum(axis=1) / math.sqrt(x.shape[1]), 1.0)
    return code, length, dot


def build(vectors: DataFrame, params: RabitqParams | None = None) -> RabitqIndex | None:
    """Index every valid row of ``vectors`` (vec_id, embedding); None if there is none."""
    p = params or RabitqParams()
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return None
    dim = sizes["n"]
    rows = rows.filter(valid(F.col("embedding"), dim))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).collect()
    if not sample:
        return None
    centre = np.array([r["embedding"] for r in sample], dtype=float).mean(axis=0)
    turn = rotation(dim, p.seed)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                code, length, dot = encode(np.stack(b["embedding"].to_numpy()).astype(float), centre, turn)
                yield b.assign(code=[c.tobytes() for c in code], length=length, dot=dot)

    kind = dict(rows.dtypes)["embedding"]
    schema = f"vec_id long, embedding {kind}, code binary, length double, dot double"
    return RabitqIndex(cut(rows.mapInPandas(coded, schema)), centre, turn)


def _distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows, components added in order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j] - q[:, j]
        total += d * d
    return np.sqrt(total)


def byte_sums(q: np.ndarray) -> np.ndarray:
    """For each byte of a code and each value of it, the signed sums of the queries' components that it stands for."""
    padded = np.pad(q, ((0, 0), (0, -q.shape[1] % 8)))
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1
    return np.stack([signs @ padded[:, at : at + 8].T for at in range(0, padded.shape[1], 8)])


def products(code: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Inner products of packed codes (as signs) and queries, a byte of the code at a time."""
    total = sums[0][code[:, 0]]
    for j in range(1, len(sums)):
        total += sums[j][code[:, j]]
    return total


def _search(index: RabitqIndex, ids: np.ndarray, queries: np.ndarray, p: RabitqParams) -> DataFrame:
    centre, turn, dim = index.centre, index.turn, queries.shape[1]
    moved = queries - centre
    q_len = np.sqrt((moved**2).sum(axis=1))
    q_unit = moved @ turn.T / np.where(q_len > 0, q_len, 1)[:, None]
    bound = p.spread / math.sqrt(max(dim - 1, 1))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = byte_sums(q_unit)  # made in the task: 32 times as large as what is sent
        best_q, best_id, best_d = np.empty(0, int), np.empty(0, int), np.empty(0)
        worst = np.full(len(ids), np.inf)
        slack = 1e-9 * (1 + float(q_len.max(initial=0)) ** 2)
        for b in batches:
            for lo in range(0, len(b), p.rows):
                part = b.iloc[lo : lo + p.rows]
                x = np.stack(part["embedding"].to_numpy()).astype(float)
                vec = part["vec_id"].to_numpy()
                code = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                length, dot = part["length"].to_numpy(), part["dot"].to_numpy()
                estimate = products(code, sums) / (math.sqrt(dim) * dot)[:, None]
                spread = np.sqrt(np.maximum(1 - dot**2, 0)) / dot * bound
                scale = 2 * length[:, None] * q_len
                middle = length[:, None] ** 2 + q_len**2 - scale * estimate
                reach = scale * spread[:, None] + slack + 1e-9 * length[:, None] ** 2
                own = vec[:, None] == ids
                middle[own] = np.inf
                if len(part) > p.k:  # k upper bounds below t: nothing with a lower bound above t can be among the k best
                    limit = np.partition(middle + reach, p.k - 1, axis=0)[p.k - 1]
                    limit = np.minimum(limit, worst**2 + slack)
                else:
                    limit = worst**2 + slack
                i, j = np.nonzero((middle - reach <= limit) & ~own)
                d = np.concatenate([_distance(x[i[s : s + 65536]], queries[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.empty(0)])
                best_q, best_id, best_d = _keep(np.append(best_q, j), np.append(best_id, vec[i]), np.append(best_d, d), p.k)
                full, last = np.unique(best_q, return_counts=True), np.flatnonzero(np.append(best_q[1:] != best_q[:-1], True))
                worst[full[0][full[1] == p.k]] = best_d[last[full[1] == p.k]]
        yield pd.DataFrame({"query_id": ids[best_q], "vec_id": best_id, "score": best_d})

    return index.rows.mapInPandas(nearest, RESULT)


def _keep(q: np.ndarray, vec: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query, by query, distance and id."""
    order = np.lexsort((vec, d, q))
    q, vec, d = q[order], vec[order], d[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[place < k], vec[place < k], d[place < k]


def search(index: RabitqIndex | None, is_query: Column, spark, params: RabitqParams | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each indexed row that ``is_query`` picks, itself apart."""
    p = params or RabitqParams()
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    most = max(1, min(p.block, p.table_bytes // (256 * 8 * -(-len(index.centre) // 8))))
    blocks = max(1, math.ceil(queries.count() / most))
    found = []
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").collect()
        if rows:
            ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
            # written at once: what a block needs on the driver is gone before the next one
            found.append(stash(_search(index, ids, np.array([r["embedding"] for r in rows], dtype=float), p), "nearest"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
