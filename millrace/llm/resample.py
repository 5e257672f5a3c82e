"""Importance resampling of documents towards a target distribution, by hashed runs of words.

1. *Scan.* A streaming CRC ring reads every text once: it holds the running
   zlib states of the last ``words`` starts, and a new word extends each of them
   by a space and the word, and starts one of its own. Every state is a feature;
   its value modulo ``buckets`` is its bucket. A document keeps its distinct
   buckets and their counts, which are written once and read from there.
2. *Gains.* Counts by bucket of the corpus and of the target are summed by task
   and then over tasks; the gain of each bucket is its log ratio, smoothed by one.
   ``buckets`` gains (a parameter, no size of the data) go to the tasks.
3. *Draw.* A document's weight is the mean gain of its features; Gumbel noise by
   a hash of its doc_id makes the highest scores a sample without replacement.
   Scores are placed by ranges (``common.numbered``), never in one task.

Defined cases: null and empty texts have no features, weight 0 and no rank; a
null doc_id has the noise of an empty name and comes last among equal scores;
rows repeated under one doc_id are documents of their own, in any order among
themselves where their scores are equal; an empty table gives an empty result,
an empty target counts as no features; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import numbered, stash, text_or_empty

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8


@dataclass(frozen=True)
class ResampleParams:
    words: int = 1  # in the longest run
    buckets: int = 10_000
    least_words: int = 20  # of a document that may be drawn
    percent: int = 10  # of those that are
    seed: str = "2024"


def ring(text: bytes, words: int) -> tuple[list[int], int]:
    """crc32 of all runs of 1 to ``words`` words of a text, and its number of words."""
    out, states, n = [], [], 0
    for n, word in enumerate(WORD.findall(text.lower()), start=1):
        states = [crc32(word, crc32(b" ", s)) for s in states[max(0, len(states) - words + 1) :]] if words > 1 else []
        states.append(crc32(word))
        out += states
    return out, n


def _scan(p: ResampleParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, times, n, n_words = [], [], [], []
            for text in b["text"]:
                found, words = ring(text.encode("utf-8", "surrogatepass"), p.words)
                bucket, count = np.unique(np.array(found, np.int64) % p.buckets, return_counts=True)
                at.append(bucket.astype(np.int32))
                times.append(count)
                n.append(len(found))
                n_words.append(words)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": n_words, "n_features": n, "at": at, "times": times})

    return run


def features(docs: DataFrame, params: ResampleParams | None = None) -> DataFrame:
    """doc_id, n_words, n_features, at (distinct buckets), times (their counts) of rows (doc_id, text)."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInPandas(_scan(params or ResampleParams()), "doc_id long, n_words long, n_features long, at array<int>, times array<long>")


def bucket_counts(found: DataFrame, params: ResampleParams | None = None) -> DataFrame:
    """bucket, n over all rows of ``features``; a task sends one row per bucket at most."""
    p = params or ResampleParams()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(p.buckets, np.int64)
        for b in batches:
            if len(b):
                np.add.at(total, np.concatenate(b["at"].to_numpy()).astype(np.int64), np.concatenate(b["times"].to_numpy()).astype(np.int64))
        bucket = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": bucket, "n": total[bucket]})

    return found.select("at", "times").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, params: ResampleParams | None = None) -> np.ndarray:
    """The gain of every bucket, from two tables of ``bucket_counts``: as many numbers as there are buckets."""
    p = params or ResampleParams()
    all_ = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    every = all_.sparkSession.range(p.buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    by = stash(all_.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "gains")
    total = by.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1) * F.lit(total["s"] + p.buckets) / ((F.col("s") + 1) * F.lit(total["t"] + p.buckets))
    out = np.zeros(p.buckets, np.int64)
    for r in by.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of rows of ``features``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = np.array([gain[a] @ t for a, t in zip(b["at"], b["times"], strict=True)], np.int64)
            n = b["n_features"].to_numpy(np.int64)
            yield b[["doc_id", "n_words", "n_features"]].assign(weight=np.where(n > 0, sums // np.maximum(n, 1), 0))

    return found.mapInPandas(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams | None = None) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; ``target`` has texts (text). Undrawn rows have no rank."""
    p = params or ResampleParams()
    found = stash(features(docs, p), "features")
    aims = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), p)
    gain = gains(bucket_counts(found, p), bucket_counts(aims, p), p)
    able = F.col("n_words") >= p.least_words
    scored = weighted(found, gain).withColumns({"score": F.col("weight") + noise(F.col("doc_id"), p.seed), "able": able})
    scored = stash(scored.drop("n_words"), "scores")
    drawn = p.percent * scored.filter("able").count() // 100
    placed = numbered(scored, [F.desc("able"), F.desc("score"), F.col("doc_id").asc_nulls_last()], "place")
    rank = F.when(F.col("place") < drawn, F.col("place").cast("long") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


#: zlib's crc32 by its table, over distinct words; for tables of a few thousand documents.
RESAMPLE_SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT r, unnest(w) AS x FROM w),
e AS (SELECT unnest(w) AS x FROM b),
f AS (SELECT DISTINCT x, hex(encode(x)) AS y FROM (SELECT x FROM d UNION ALL SELECT x FROM e)),
g AS (SELECT x, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(y) // 2), lambda i: ('0x' || substr(y, (2 * i + 1)::INT, 2))::BIGINT)),
                             lambda c, v: xor(c >> 8, tab[xor(c & 255, v) + 1]))) % 10000 AS k FROM f, tab),
s AS (SELECT k, count(*)::DOUBLE AS s FROM d JOIN g USING (x) GROUP BY k),
t AS (SELECT k, count(*)::DOUBLE AS t FROM e JOIN g USING (x) GROUP BY k),
n AS (SELECT (SELECT count(*) FROM d)::DOUBLE AS s, (SELECT count(*) FROM e)::DOUBLE AS t),
h AS (SELECT k, floor(1000 * ln((coalesce(t.t, 0) + 1) * (n.s + 10000) / ((coalesce(s.s, 0) + 1) * (n.t + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (k), n),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN g USING (x) JOIN h USING (k) GROUP BY r),
o AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
      FROM w LEFT JOIN m USING (r)),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM p
"""
