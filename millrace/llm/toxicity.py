"""Toxicity scores from non-negative positive-unlabelled learning.

A logistic model over word and word-edge features is trained in numpy from
confirmed toxic texts (positives) and unlabelled texts, by the non-negative
risk estimator: with class prior ``pi``,

    risk = pi * E_pos[loss(f, +1)] + max(0, E_unl[loss(f, -1)] - pi * E_pos[loss(f, -1)])

and where the second term falls below zero, its gradient is reversed. ``pi`` is
the share of toxic among the labelled rows that may be learned from.

Training uses a bounded sample (``n_positive`` and ``n_unlabelled`` distinct
texts, chosen by a hash of doc_id) and at most ``n_features`` features; both
bounds are parameters. Scoring reads every whole text once, in Arrow batches,
with no shuffle; the model is a small dict.

Defined cases: null and empty texts get the model's bias as score; rows whose
doc_id is null are scored and never learned from; of several labels for one
document the largest counts; without any positive example every score is 0;
repeated rows are scored each; an empty table gives an empty result; other
columns stay as they are in ``score``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty


@dataclass(frozen=True)
class ToxicityParams:
    n_positive: int = 2000
    n_unlabelled: int = 6000
    n_features: int = 2048
    min_positive: int = 4  # positives that must hold a feature
    min_gain: float = 20.0  # log-likelihood ratio against the unlabelled texts
    steps: int = 400
    rate: float = 0.05
    l2: float = 1e-3
    threshold: float = 0.3
    seed: int = 11


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_features(raw: str) -> tuple[str, ...]:
    """Features of one lower-case chunk between spaces: its word, and the edges of longer words."""
    w = "".join(c for c in raw if c.isalpha())
    if len(w) < 2:
        return ()
    out = [w]
    out += ["^" + w[:n] for n in (3, 4, 5, 6) if len(w) > n]
    out += [w[-n:] + "$" for n in (4, 5) if len(w) > n]
    return tuple(out)


class _Reader:
    """Texts to feature sets; remembers chunks, up to a bound."""

    def __init__(self, wanted: set[str] | None = None, most: int = 100_000):
        self.wanted, self.most, self.known = wanted, most, {}

    def __call__(self, text: str | None) -> set[str]:
        found: set[str] = set()
        known, wanted = self.known, self.wanted
        for raw in set((text or "").lower().split()):
            hit = known.get(raw)
            if hit is None:
                if len(known) >= self.most:
                    known.clear()
                hit = word_features(raw)
                if wanted is not None:
                    hit = tuple(x for x in hit if x in wanted)
                known[raw] = hit
            if hit:
                found.update(hit)
        return found


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    read, pos, unl = _Reader(), Counter(), Counter()
    for b in batches:
        for text, is_pos in zip(b["text"], b["is_pos"], strict=True):
            (pos if is_pos else unl).update(read(text))
        if len(unl) + len(pos) > 2_000_000:
            yield _counted(pos, unl)
            pos, unl = Counter(), Counter()
    if unl or pos:  # an empty column of strings can't be returned
        yield _counted(pos, unl)


def _counted(pos: Counter, unl: Counter) -> pd.DataFrame:
    names = list(pos)  # a feature that no positive holds is never chosen, but other tasks may hold its positives
    names += [x for x in unl if x not in pos]
    return pd.DataFrame({"feature": names, "p": [pos[x] for x in names], "u": [unl[x] for x in names]})


def nonneg_fit(x: np.ndarray, is_pos: np.ndarray, prior: float, p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model under the non-negative risk; full-batch Adam."""
    xp, xu = x[is_pos], x[~is_pos]
    theta = np.zeros(x.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def sigmoid(f: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * f))

    def grad(rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(slope @ rows, slope.sum()) / max(len(rows), 1)

    for step in range(1, p.steps + 1):
        fp, fu = xp @ theta[:-1] + theta[-1], xu @ theta[:-1] + theta[-1]
        as_negative_p, as_negative_u = np.logaddexp(0, fp), np.logaddexp(0, fu)
        negative = as_negative_u.mean() - prior * as_negative_p.mean()
        g_neg = grad(xu, sigmoid(fu)) - prior * grad(xp, sigmoid(fp))
        g = prior * grad(xp, sigmoid(fp) - 1) + g_neg if negative >= 0 else -g_neg
        g[:-1] += p.l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def _gain(p: Column, u: Column, n_p: int, n_u: int) -> Column:
    """Log-likelihood ratio of a feature's rate among positives against that among unlabelled."""

    def part(k: Column, n: int, rate: Column) -> Column:
        rate = F.least(F.greatest(rate, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(rate) + (F.lit(n) - k) * F.log(F.lit(1.0) - rate)

    both = (p + u) / F.lit(float(n_p + n_u))
    return 2 * (part(p, n_p, p / F.lit(float(n_p))) + part(u, n_u, u / F.lit(float(n_u))) - part(p, n_p, both) - part(u, n_u, both))


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> ToxicityModel:
    """Learn from labelled rows that aren't held out, and unlabelled texts that aren't either."""
    p = params or ToxicityParams()
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("x")).first()["x"]
    if not share:
        return ToxicityModel({}, float("-inf"))
    prior = min(max(share, 1e-4), 0.9)
    by_hash = F.xxhash64(F.col("doc_id"), F.lit(p.seed))
    chosen = known.filter("toxic = 1").select("doc_id").orderBy(by_hash, "doc_id").limit(p.n_positive).withColumn("is_pos", F.lit(True))
    others = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id")
    others = others.orderBy(by_hash, "doc_id").limit(p.n_unlabelled).withColumn("is_pos", F.lit(False))
    # at most n_positive + n_unlabelled ids: a bounded broadcast
    ids = chosen.unionByName(others)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["is_pos", "text"]).select("text", "is_pos")
    sample = sample.persist()
    try:
        n = {r["is_pos"]: r["n"] for r in sample.groupBy("is_pos").agg(F.count("*").alias("n")).collect()}
        n_p, n_u = n.get(True, 0), n.get(False, 0)
        if not n_p or not n_u:
            return ToxicityModel({}, float("-inf"))
        rates = sample.mapInPandas(_counts, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        rates = rates.filter(F.col("p") >= p.min_positive).filter(F.col("p") * n_u > F.col("u") * n_p)
        gained = rates.withColumn("gain", _gain(F.col("p"), F.col("u"), n_p, n_u)).filter(F.col("gain") >= p.min_gain)
        names = [r["feature"] for r in gained.orderBy(F.desc("gain"), "feature").limit(p.n_features).collect()]
        if not names:
            return ToxicityModel({}, float("-inf"))
        place = {x: i for i, x in enumerate(names)}

        def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read = _Reader(set(place))
            for b in batches:
                rows = [np.array(sorted(place[x] for x in read(t)), dtype="<i4").tobytes() for t in b["text"]]
                yield pd.DataFrame({"is_pos": b["is_pos"], "hits": rows})

        got = sample.mapInPandas(hits, "is_pos boolean, hits binary").toPandas()
    finally:
        sample.unpersist()
    got = got.sort_values(["is_pos", "hits"])
    x = np.zeros((len(got), len(names)), dtype=np.float32)
    for i, h in enumerate(got["hits"]):
        x[i, np.frombuffer(h, dtype="<i4")] = 1
    weights, bias = nonneg_fit(x, got["is_pos"].to_numpy(bool), prior, p)
    return ToxicityModel({f: float(w) for f, w in zip(names, weights, strict=True) if w}, bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with a column ``score`` (in place of one of that name): the model's probability that the whole text is toxic."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = model.weights
        read = _Reader(set(weights))
        for s in texts:
            f = np.array([model.bias + sum(weights[x] for x in read(t)) for t in s], dtype=float)
            yield pd.Series(0.5 * (1 + np.tanh(0.5 * f)))

    return docs.withColumn("score", scored(text_or_empty()))
