"""Retrieval metrics and evaluation reports as column expressions and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clamp01, is_blank, json_object


def recall_at(relevant: Column, retrieved: Column, k: int) -> Column:
    wanted = F.array_distinct(relevant)
    found = F.size(F.array_intersect(wanted, F.slice(retrieved, 1, k)))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(found / F.size(wanted))


def hit_rate(relevant: Column, retrieved: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(relevant, F.slice(retrieved, 1, k)), F.lit(False)).cast("double")


def mrr(relevant: Column, retrieved: Column) -> Column:
    """One over the rank of the first relevant chunk, else 0."""
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(places) > 0, F.lit(1.0) / F.array_min(places)).otherwise(0.0)


def retrieval_metrics(rows: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """``rows`` (relevant, retrieved) with recall_<k>, mrr and hit_rate_5; nulls where nothing is relevant."""
    relevant, retrieved = F.col("relevant"), F.col("retrieved")
    out = {f"recall_{k}": recall_at(relevant, retrieved, k) for k in sorted(set(ks))}
    out |= {"mrr": mrr(relevant, retrieved), "hit_rate_5": hit_rate(relevant, retrieved, 5)}
    return rows.withColumns({name: F.when(F.size(relevant) > 0, F.bround(value, 3)) for name, value in out.items()})


def faithfulness(answer: Column, reply: Column) -> Column:
    """Share of supported claims in a judge's reply {"claims": [{"supported": ...}]}."""
    claims = F.from_json(json_object(reply), "struct<claims:array<struct<claim:string,supported:boolean>>>")["claims"]
    share = F.size(F.filter(claims, lambda c: F.coalesce(c["supported"], F.lit(False)))) / F.size(claims)
    return (
        F.when(is_blank(F.coalesce(answer, F.lit(""))), 0.0)
        .when(claims.isNull(), 0.0)
        .when(F.size(claims) == 0, 1.0)
        .otherwise(share)
    )


def relevancy(reply: Column) -> Column:
    """A judge's score of 0 to 5 as a number of 0 to 1; 0 where there is none."""
    score = F.from_json(json_object(reply), "struct<score:double>")["score"]
    return F.when(score.isNull(), 0.0).otherwise(clamp01(F.floor(score) / 5.0))


def report(rows: DataFrame) -> DataFrame:
    """Means over evaluated rows; retrieval metrics over rows with relevant sources only."""
    judged = [c for c in ("faithfulness", "answer_relevancy", "context_relevance") if c in rows.columns]
    flags = [(c, n) for c, n in (("critic_faithful", "critic_faithful_rate"), ("citation_valid", "citation_valid_rate"), ("abstained", "abstain_rate")) if c in rows.columns]
    found = [c for c in rows.columns if c.startswith("recall_") or c in ("mrr", "hit_rate_5")]
    means = [F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias(c) for c in judged]
    means += [F.bround(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 3).alias(n) for c, n in flags]
    means += [F.bround(F.avg(c), 3).alias(c) for c in found]
    return rows.agg(F.count("*").alias("n"), *means)
