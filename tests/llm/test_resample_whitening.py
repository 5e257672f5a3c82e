"""Resampling and whitening against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import resample, whitening  # noqa: E402

DOCS = "doc_id long, text string, rank long, score string, able int, place string"


def texts() -> list:
    rng = np.random.default_rng(5)
    words = ["Alpha", "beta", "été", "中文", "x1", "straße", "the", "of-course", "ÀB"]
    out = [None, "", " \t", "one word", "A" * 5000, "word " * 30_000]
    return out + [" ".join(words[i] for i in rng.integers(len(words), size=n)) for n in rng.integers(1, 90, size=120)] + ["same words here " * 9] * 4


def plain_resample(data: list, target: list, p: resample.ResampleParams) -> Counter:
    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i : i + n]) for n in range(1, p.words + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(x.encode()) % p.buckets for x in runs]

    all_, aims = [found(t) for _, t in data], [found(t) for t in target]
    s, t = Counter(b for _, x in all_ for b in x), Counter(b for _, x in aims for b in x)
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for (doc_id, _), (n, x) in zip(data, all_, strict=True):
        gains = [math.floor(1000 * math.log((t[b] + 1) * (ns + p.buckets) / ((s[b] + 1) * (nt + p.buckets)))) for b in x]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= p.least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: p.percent * len(able) // 100])}
    return Counter((*r[:4], drawn.get(id(r))) for r in out)


@pytest.mark.parametrize("p", [resample.ResampleParams(), resample.ResampleParams(words=3, buckets=50, percent=40, least_words=3)])
def test_resample(spark, p):
    data = [(i, t) for i, t in enumerate(texts())] + [(7, "an id that comes twice with another text, long enough to be drawn by anyone who draws texts of twenty words"), (None, "no id " * 15)]
    target = ["beta the été x1 " * 5, None, "", "ÀB of course"]
    docs = spark.createDataFrame([(i, t, 1, "s", 2, "p") for i, t in data], DOCS).repartition(3)
    got = resample.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, item_id int"), p)
    keys = ("doc_id", "n_features", "weight", "score", "rank")
    assert dict(got.dtypes) == dict.fromkeys(keys, "bigint")
    assert Counter(tuple(r[k] for k in keys) for r in got.collect()) == plain_resample(data, target, p)


def test_resample_of_copies_and_nothing(spark):
    same = spark.createDataFrame([(i, "twenty words " * 10) for i in range(50)] + [(3, "twenty words " * 10)], "doc_id long, text string")
    none = spark.createDataFrame([], DOCS)
    got = [r for r in resample.resample(same, none.select("text")).collect() if r["rank"]]
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
    assert [r["score"] for r in sorted(got, key=lambda r: r["rank"])] == sorted((r["score"] for r in got), reverse=True)
    assert resample.resample(none, same.select("text")).count() == 0


def vectors(n: int, dim: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dim)) @ np.diag(np.linspace(2, 0.5, dim)) + rng.standard_normal((5, dim))[rng.integers(5, size=n)]


KIND = "vec_id long, embedding array<float>, n long, whitened string, component int"


def rows_of(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], 1, "w", 2) for i, v in zip(ids or range(len(x)), x, strict=True)], KIND).repartition(5)


@pytest.mark.parametrize(("n", "dim"), [(400, 64), (300, 20), (50, 3), (6, 12)])
def test_whitening(spark, n, dim):
    given = vectors(n, dim).astype(np.float32)
    odd = [None, [], [None] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0] * (dim + 1)]
    got = whitening.whiten(rows_of(spark, [*given, *odd])).collect()
    x = np.floor(1024 * given.astype(float)).astype(np.int64) + 100_000
    total = x.sum(axis=0)
    centred = (n * x - total) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(8, int((e > 1e-10 * e[0]).sum()))
    assert k == min(8, dim, n - 1) and len(got) == n * k
    want = centred @ u[:, :k] / np.sqrt(e[:k])
    found = np.zeros((n, k))
    for r in got:
        c = r["component"] - 1
        found[r["vec_id"], c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], total, strict=True))
        assert r["explained"] == pytest.approx(e[c] / np.trace(cov), rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-8
    assert np.abs(np.abs(found) - np.abs(want)).max() < 1e-7
    assert np.abs(found.T @ found / n - np.eye(k)).max() < 1e-8


def test_close_eigenvalues_need_few_passes():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    matrix = q @ np.diag(np.concatenate([[5.0, 5.0], np.linspace(1.01, 1, 298)])) @ q.T
    e, u, passes = whitening.eigenpairs(lambda b: matrix @ b, 300, whitening.WhiteningParams())
    assert passes < 60
    assert np.abs(matrix @ u - u * e).max() < 1e-10
    assert e == pytest.approx(np.sort(np.concatenate([[5.0, 5.0], np.linspace(1.01, 1, 298)]))[::-1][:8], abs=1e-9)


def test_whitening_of_little(spark):
    assert whitening.whiten(spark.createDataFrame([], KIND)).count() == 0
    assert whitening.whiten(rows_of(spark, [[1.0, 2.0]] * 3)).count() == 0
    got = whitening.whiten(rows_of(spark, [[1.0, 2.0], [1.0, 4.0], [1.0, 2.0]], [5, 5, 6])).collect()
    assert sorted((r["vec_id"], round(r["whitened"], 9)) for r in got) == [(5, -round(0.5**0.5, 9)), (5, round(2**0.5, 9)), (6, -round(0.5**0.5, 9))]


def test_whole_numbers_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits|OVERFLOW|overflow"):
        whitening.whiten(rows_of(spark, [[1e15, 0.0], [-1e15, 1.0], [1e14, 1.0]])).collect()
