"""Mixing sources to target weights (Efraimidis-Spirakis sampling).

Every document gets an exponential key ``-ln(u) / quality weight``. Within a
source, documents sorted by key form a weighted sample without replacement of
any length; prefix sums of their sizes cut it at the source's budget. A source
whose target exceeds its size is taken whole first (complete epochs), and only
what is left of the target is sampled.

Plan: DataFrame operators only. The key's distribution follows from the weights, so
keys are dealt into even ranges, as many as leave about ``bucket_rows`` rows in one
(``key_range``); a source's prefix sum is then a sum over its ranges (few rows) plus a sum inside
one range. Sources are numbered by ranges, and targets come from a few sums over
them, so neither a large source nor many sources meet in one task.

Defined cases: a null text has size 0; a null source is a source of its own and
comes last; a document without a label has weight 1; with several labels, their
mean counts; rows repeated under one doc_id are separate documents with one key
(a null doc_id's key comes from its text); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import numbered, settled, sized, stash, whole

LEVELS = 16  # quantiles of the weights that tell the keys' distribution
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (3, 1, 2)  # dealt to sources by code point, repeating
    share_num: int = 3  # all sources together get share_num / share_den of all sizes
    share_den: int = 2
    max_epochs: int = 2  # a target stops at this many times its source's size
    bucket_rows: int = 100_000  # rows of a source in a range of keys, about
    least_buckets: int = 128
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 0.5 for low and 1.5 for high quality, the mean of a document's labels."""
    return (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.lit(0.5) + F.avg(F.col("quality").cast("double"))).alias("weight"))
    )


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on seed and doc_id only, where that is null on the text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """One row per source (source_key, source, source_size) to the same with its target.

    Water filling: what all weights would get alike is computed from sums over
    the sources that aren't at their cap; those that it takes above their cap
    are set to it, until there are none. The test is in whole numbers, and each
    turn is one aggregate, of which at most a few are needed.
    """
    w = numbered(sizes, [F.col("source").asc_nulls_last()], "_i")
    w = w.withColumn("_w", F.element_at(F.array(*[F.lit(x).cast("long") for x in p.weights]), (F.col("_i") % len(p.weights) + 1).cast("int")))
    w = stash(w.withColumn("_cap", F.col("source_size") * p.max_epochs).drop("_i"), "sources")
    whole = "decimal(38,0)"
    total = int(w.agg(F.sum(F.col("source_size").cast(whole))).first()[0] or 0)
    capped, before = F.lit(False), None
    while True:
        sums = w.agg(F.sum(F.when(capped, F.col("_cap").cast(whole))).alias("a"), F.sum(F.when(~capped, F.col("_w"))).alias("b"), F.count(F.when(capped, 1)).alias("n")).first()
        free, weight = total * p.share_num - p.share_den * int(sums["a"] or 0), int(sums["b"] or 0)
        if sums["n"] == before:
            break
        before = sums["n"]
        capped = capped | (F.col("_cap").cast(whole) * F.lit(p.share_den * weight).cast(whole) <= F.col("_w").cast(whole) * F.lit(str(free)).cast(whole))
        if not weight:
            break
    shared = F.col("_w").cast("double") * F.lit(float(free)) / F.lit(float(max(weight, 1) * p.share_den))
    return w.select("source_key", "source", "source_size", F.when(capped, F.col("_cap").cast("double")).otherwise(shared).alias("target"))


def key_range(rows: DataFrame, buckets: int) -> Column:
    """The range that a row's ``_key`` falls into, rising with it; all ranges hold about as many of ``rows`` (_key, _weight).

    A key is exponential with its weight as rate, so the share of smaller keys is a mean
    over weights, of which LEVELS quantiles stand for all.
    """
    marks = [(i + 0.5) / LEVELS for i in range(LEVELS)]
    levels = rows.agg(F.percentile_approx("_weight", marks, 10_000)).first()[0] or [1.0]
    above = sum((F.exp(-F.col("_key") * F.lit(float(w))) for w in levels), F.lit(0.0)) / F.lit(float(len(levels)))
    return F.least(F.floor((F.lit(1.0) - above) * buckets), F.lit(buckets - 1)).cast("int")


def mix(docs: DataFrame, weights: DataFrame | None = None, params: MixParams | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, for every row of ``docs``; and the columns ``more`` of its own.

    ``weights``: doc_id, weight (> 0), unique by doc_id.
    """
    p, more = params or MixParams(), more or {}
    rows = docs.select(
        F.col("doc_id"), F.col("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"),
        word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), p.seed).alias("_u"),
        # joined with the label by both, so that null doc_ids are spread over all tasks
        F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("_label"), F.col("doc_id").isNull().alias("_nameless"),
        *[c.alias(f"_more_{k}") for k, c in more.items()],
    )
    if weights is not None:
        labels = weights.select(F.col("doc_id").alias("_label"), F.lit(False).alias("_nameless"), "weight")
        rows = rows.join(labels, ["_label", "_nameless"], "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    key = -F.log("_u") / F.coalesce(F.col("weight"), F.lit(1.0))
    rows = rows.withColumns({"_key": key, "_weight": F.coalesce(F.col("weight"), F.lit(1.0))}).drop("weight", "_u", "_label", "_nameless")
    rows = stash(rows, "sizes")
    buckets = max(p.least_buckets, math.ceil(rows.count() / p.bucket_rows))
    rows = rows.withColumn("_bucket", key_range(rows, buckets)).drop("_weight")

    sums = stash(rows.groupBy("source_key", "_bucket").agg(F.sum("size").alias("_in"), F.count("*").alias("_n"), F.max("source").alias("source")), "sums")
    goals = targets(sums.groupBy("source_key").agg(F.max("source").alias("source"), F.sum("_in").alias("source_size")), p)
    running = Window.partitionBy("source_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.select("source_key", "_bucket", F.coalesce(F.sum("_in").over(running), F.lit(0)).alias("_offset"))
        .join(goals.drop("source"), "source_key")
        .withColumn("_budget", F.floor("target").cast("long"))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0).cast("long")))
        .withColumn("_left", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
    )
    inside = Window.partitionBy("source_key", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - before))
    return rows.join(offsets, ["source_key", "_bucket"]).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"),
        *[F.col(f"_more_{k}").alias(k) for k in more],
    )


def copies(docs: DataFrame, weights: DataFrame | None = None, params: MixParams | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes from, with their columns, as often as it begins to take them.

    Equal rows share one count, so a row is found by its doc_id and a hash of all its columns.
    """
    with sized(docs.sparkSession, docs.count()):
        return settled(_copies(docs, weights, params))


def _copies(docs: DataFrame, weights: DataFrame | None, params: MixParams | None) -> DataFrame:
    own = F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    taken = mix(docs, weights, params, {"own": own})
    times = taken.select("doc_id", "own", F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).alias("times"))
    times = times.groupBy(F.col("doc_id").alias("_id"), F.col("own").alias("_own")).agg(F.sum("times").alias("_times"), F.count("*").alias("_n")).filter("_times > 0")
    keyed = docs.select(whole(docs).alias("row"), F.col("doc_id").alias("id"), own.alias("own"))
    if not times.filter("_n > 1").isEmpty():
        keyed = keyed.dropDuplicates(["id", "own"])
    met = keyed.join(times, F.col("id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own")))
    return met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("row.*")


MIX_SQL = r"""
WITH w AS (SELECT doc_id, 0.5::DOUBLE + avg(quality::DOUBLE) AS weight FROM labels
           WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT d.*, -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null:' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
                      / 4503599627370496::DOUBLE) / coalesce(w.weight, 1::DOUBLE) AS key FROM d LEFT JOIN w USING (doc_id)),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 2 AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
              sum(w) OVER (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest,
              (sum(source_size) OVER ())::BIGINT AS total FROM s1),
s3 AS (SELECT *, cap * rest * 2 <= w * (total * 3 - before * 2) AS capped FROM s2),
s4 AS (SELECT *, (total * 3 - 2 * sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS free,
              (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT AS fw FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE w::DOUBLE * free::DOUBLE / (fw * 2)::DOUBLE END AS target FROM s4),
s6 AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM s5),
p AS (SELECT k.*, s6.source_size, s6.target, s6.epochs, s6.budget - s6.epochs * s6.source_size AS left_,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN s6 ON k.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, left_ - before)))::BIGINT AS taken FROM p
"""
