"""Reciprocal rank fusion and hybrid retrieval for batches of queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.functions.text import cache_key, tokenize
from millrace.functions.vectors import hashed_embedding
from millrace.operators import bm25, dense
from millrace.operators.rerank import Reranker
from millrace.plans.memo import Memo
from millrace.shared import stash


def rrf(vector_hits: DataFrame, bm25_hits: DataFrame, k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, vector_score, bm25_score, fused_rank (from 0).

    Equal scores: those on the vector list first, by their rank there, then the
    others by their BM25 rank.
    """
    sides = vector_hits.withColumn("side", F.lit(0)).unionByName(bm25_hits.withColumn("side", F.lit(1)))

    def of(side: int, column: str):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    fused = sides.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)).alias("score"),
        of(0, "rank").alias("vector_rank"), of(1, "rank").alias("bm25_rank"),
        F.round(F.coalesce(of(0, "score"), F.lit(0.0)), 4).alias("vector_score"),
        F.round(F.coalesce(of(1, "score"), F.lit(0.0)), 4).alias("bm25_score"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"))
    return fused.withColumn("fused_rank", (F.row_number().over(order) - 1).cast("long")).drop("vector_rank", "bm25_rank")


SMALL = 200_000  # hits that are broadcast
Embed = Callable[[Column], Column]


@dataclass
class HybridIndex:
    """chunks: chunk_id, source, text. vectors: chunk_id, embedding. lexical: BM25 statistics."""

    chunks: DataFrame
    vectors: DataFrame
    lexical: bm25.Bm25Index
    dim: int = 64
    embed: Embed | None = None


def index_chunks(chunks: DataFrame, dim: int = 64, embed: Embed | None = None, memo: Memo | None = None, model: str = "") -> HybridIndex:
    """Index chunks (chunk_id, source, text) with ``embed`` (text column to vector column), or with the offline embedding.

    With ``memo`` each distinct text is embedded once by ``model``, and never again. Texts are made into counts of terms once, which are
    written to the shared folder and serve both sides.
    """
    counts = stash(bm25.counts(chunks.select("chunk_id", tokenize(F.col("text")).alias("tokens"))), "counts")
    if embed is None:
        vectors = counts.select("chunk_id", hashed_embedding(F.col("terms"), dim, F.col("tfs")).alias("embedding"))
    elif memo is None:
        vectors = chunks.select("chunk_id", embed(F.col("text")).alias("embedding"))
    else:
        keyed = chunks.select("chunk_id", "text", cache_key(F.lit("embed"), F.lit(model), F.col("text")).alias("key"))
        found = memo.filled(keyed.select("key", "text"), lambda some: some.select("key", embed(F.col("text")).alias("value")))
        vectors = keyed.select("chunk_id", "key").join(found, "key").select("chunk_id", F.col("value").alias("embedding"))
    return HybridIndex(chunks.select("chunk_id", "source", "text"), vectors, bm25.of_counts(counts), dim, embed)


def embed_queries(queries: DataFrame, dim: int = 64, embed: Embed | None = None) -> DataFrame:
    """query_id, text, tokens, embedding of queries (query_id, text); with the index's ``dim`` and ``embed``."""
    tokens = queries.select("query_id", "text", tokenize(F.col("text")).alias("tokens"))
    return tokens.withColumn("embedding", hashed_embedding(F.col("tokens"), dim) if embed is None else embed(F.col("text")))


class Timings(dict):
    """Milliseconds of the steps of the last retrieval, by name. A step that is measured is written to the shared folder, so
    that its work ends with it."""

    def step(self, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        began = time.perf_counter()
        kept = stash(rows(), name)
        self[f"{name}_ms"] = round((time.perf_counter() - began) * 1000, 3)
        return kept


def _unmeasured(name: str, rows: Callable[[], DataFrame]) -> DataFrame:
    return rows()


def candidates(index: HybridIndex, queries: DataFrame, settings: Settings, top_k: int | None = None, timings: Timings | None = None) -> DataFrame:
    """Fused rows that reach the reranker, best first, for queries (query_id, tokens, embedding)."""
    step = _unmeasured if timings is None else timings.step
    near = step("vector", lambda: dense.search(index.vectors, queries, settings.top_k_vector))
    lexical = step("bm25", lambda: bm25.search(index.lexical, queries, settings.top_k_bm25))
    return step("rrf", lambda: rrf(near, lexical, settings.rrf_k).filter(F.col("fused_rank") < settings.candidates(top_k)))


def retrieve(
    index: HybridIndex, queries: DataFrame, settings: Settings | None = None, top_k: int | None = None, reranker: Reranker | None = None,
    timings: Timings | None = None,
) -> DataFrame:
    """query_id, rank (from 0), chunk_id, source, text, score, vector_score, bm25_score: the top hits of all queries, those of a query together and best first.

    With a reranker the score is the reranker's. ``timings`` gets vector_ms, bm25_ms, rrf_ms and rerank_ms (0 without a reranker).
    """
    s = settings or Settings()
    k = top_k or s.top_k_final
    if timings is not None:
        timings.update(rerank_ms=0.0)
    fused = candidates(index, queries, s, k, timings).withColumnRenamed("fused_rank", "rank")
    if reranker is not None:
        step = _unmeasured if timings is None else timings.step
        first = fused
        fused = step("rerank", lambda: reranker.rerank(first, index.chunks, queries))
    best = fused.filter(F.col("rank") < k)
    # texts stay where they are unless the hits are many
    best = F.broadcast(best) if queries.count() * k <= SMALL else best
    hits = best.join(index.chunks, "chunk_id").repartition("query_id").sortWithinPartitions("query_id", "rank")
    return hits.select("query_id", "rank", "chunk_id", "source", "text", "score", "vector_score", "bm25_score")


def merge_hits(hits: DataFrame, group: str = "group_id", top_k: int | None = None) -> DataFrame:
    """One row per group and chunk: the first hit's fields with the largest score; ``seen`` orders hits.

    With ``top_k`` the best rows of each group, equal scores by first sight.
    """
    first = F.min_by(F.struct("source", "text", "vector_score", "bm25_score"), "seen")
    merged = hits.groupBy(group, "chunk_id").agg(F.max("score").alias("score"), first.alias("h"), F.min("seen").alias("seen"))
    merged = merged.select(group, "chunk_id", "score", "h.*", "seen")
    order = Window.partitionBy(group).orderBy(F.desc("score"), "seen")
    merged = merged.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    return merged if top_k is None else merged.filter(F.col("rank") < top_k)
