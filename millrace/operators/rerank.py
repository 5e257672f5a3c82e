"""Second-stage scores for the few candidates of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import tokenize
from millrace.functions.vectors import cosine, hashed_embedding


@dataclass(frozen=True)
class Reranker:
    """Scores pairs by ``scorer`` (query text, chunk text), by a cross-encoder where one is installed, or by cosine of embeddings.

    ``provider`` turns whole batches of pairs into scores and is the seam for
    services; if it fails, the order before stands.
    """

    scorer: Callable[[str, str], float] | None = None
    provider: Callable[[list[str], list[str]], list[float]] | None = None
    backend: str = "embedding"
    model: str = ""
    dim: int = 64

    def scoring(self) -> Callable[[list[str], list[str]], list[float]] | None:
        """Scores for batches of pairs; None for the embedding's cosine."""
        if self.provider is not None:
            return self.provider
        if self.scorer is not None:
            scorer = self.scorer
            return lambda queries, docs: [float(scorer(q, d)) for q, d in zip(queries, docs, strict=True)]
        if self.backend == "cross-encoder":
            try:
                from sentence_transformers import CrossEncoder

                encoder = CrossEncoder(self.model)
            except Exception:  # not installed, or no model here: the embedding serves
                return None
            return lambda queries, docs: [float(x) for x in encoder.predict(list(zip(queries, docs, strict=True)))]
        return None

    def rerank(self, fused: DataFrame, chunks: DataFrame, queries: DataFrame, top_n: int | None = None) -> DataFrame:
        """``fused`` (query_id, chunk_id, rank, score, ...) with new scores and ranks; ties keep their order."""
        asked = queries.select("query_id", F.col("text").alias("query_text"))
        pairs = fused.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id").join(asked, "query_id")
        scoring = self.scoring()
        if scoring is None:
            a, b = (hashed_embedding(tokenize(F.col(c)), self.dim) for c in ("query_text", "chunk_text"))
            pairs = pairs.withColumns({"_a": a, "_b": b}).withColumn("_new", F.round(cosine(F.col("_a"), F.col("_b")), 6)).drop("_a", "_b")
        else:

            @F.pandas_udf("double")
            def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
                for q, d in batches:
                    try:
                        yield pd.Series(scoring(list(q), list(d)), dtype="float64")
                    except Exception:  # a failing service leaves the order as it was
                        yield pd.Series([None] * len(q), dtype="float64")

            pairs = pairs.withColumn("_new", scored("query_text", "chunk_text"))
        failed = F.max(F.col("_new").isNull() | F.isnan("_new")).over(Window.partitionBy("query_id"))
        pairs = pairs.withColumn("_failed", failed)
        pairs = pairs.withColumn("score", F.when(F.col("_failed"), F.col("score")).otherwise(F.col("_new")))
        order = Window.partitionBy("query_id").orderBy(F.when(F.col("_failed"), 0.0).otherwise(-F.col("score")), "rank")
        pairs = pairs.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).drop("_new", "_failed", "query_text", "chunk_text")
        return pairs if top_n is None else pairs.filter(F.col("rank") < top_n)
