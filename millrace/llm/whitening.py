"""Whitening of embeddings by matrix-free block subspace iteration.

Entries become whole numbers (``floor(scale * c) + shift``), so counts and sums
are exact, and a row is centred as ``(n * x - S) / n`` from whole numbers before
anything is multiplied. The covariance V is never made: a pass of Spark computes
``X'(XQ) / n`` over the centred rows for a block Q, each task returning one small
matrix, and these are summed by cell. The driver holds ``dim`` rows of a few
dozen columns.

Each pass multiplies one block. Its products, less what is already spanned, are
orthonormalised by QR into the next block; Rayleigh-Ritz on the blocks kept gives
the components so far and their residuals ``V u - e u``. Blocks are kept (up to
``kept``, then the best Ritz vectors stand for them), which plain iteration does
not need but which brings close eigenvalues apart in a few passes, and which
finds all of them once the blocks span the space. Passes end when the residuals
of all components are at most ``tolerance`` times the largest eigenvalue.

Defined cases: rows whose vector is null, empty, of another length than most (of
equally many, the longer), or holds null or non-finite entries are dropped;
null, repeated and equal ids are rows like others; components with an eigenvalue
of at most 1e-10 times the largest have nothing to scale and are left out, so
that equal rows, a single row and an empty table give an empty result; entries or
deviations beyond whole numbers of 64 bits are an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stash

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
NOTHING = 1e-10  # share of the largest eigenvalue below which there is none


@dataclass(frozen=True)
class WhiteningParams:
    k: int = 8
    scale: int = 1024
    shift: int = 100_000
    extra: int = 8  # columns of a block beside k
    kept: int = 8  # blocks
    tolerance: float = 1e-12
    passes: int = 200
    seed: int = 11


def usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ok, F.lit(False))


@dataclass
class Centred:
    """rows: vec_id, x (whole numbers). n of them with the sums ``total`` by dimension."""

    rows: DataFrame
    n: int
    total: np.ndarray

    def of(self, x: pd.Series) -> np.ndarray:
        """n times the centred rows, exact."""
        whole = np.stack(x.to_numpy()).astype(np.int64)
        if float(np.abs(whole).max()) * self.n >= 2.0**62:
            raise OverflowError("n times an entry is beyond 64 bits")
        return self.n * whole - self.total


def fit_list(vectors: DataFrame, params: WhiteningParams | None = None) -> Centred | None:
    """The rows that take part, written once, with their number and sums; None if there are none."""
    p = params or WhiteningParams()
    rows = vectors.select("vec_id", "embedding").filter(usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return None
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(p.scale)) * c.cast("double")).cast("long") + F.lit(p.shift).cast("long"))
    rows = stash(rows.filter(F.size("embedding") == sizes["dim"]).select("vec_id", x.alias("x")), "whole")
    sums = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).collect()
    return Centred(rows, sizes["n"], np.array([r["s"] for r in sorted(sums, key=lambda r: r["i"])], np.int64))


def _summed(fit: Centred, each: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of what ``each`` makes of centred rows: ``size`` numbers, added by cell."""
    n, of = fit.n, Centred(None, fit.n, fit.total).of

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += each(of(b["x"]) / n).ravel()
        yield pd.DataFrame({"cell": np.arange(size), "v": total})

    cells = fit.rows.select("x").mapInPandas(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in cells:
        out[r["cell"]] = r["v"]
    return out


def multiply(fit: Centred, block: np.ndarray) -> np.ndarray:
    """V @ block, by one pass over the rows."""
    return _summed(fit, lambda c: c.T @ (c @ block), block.size).reshape(block.shape) / fit.n


def _fresh(found: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``found`` has beside ``basis``."""
    size = np.linalg.norm(found, axis=0)
    rest = found[:, size > 0] / size[size > 0]
    for _ in range(2):
        rest = rest - basis @ (basis.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        rest = rest[:, size > 1e-8] / size[size > 1e-8]
    q, r = np.linalg.qr(rest)
    q = q[:, np.abs(np.diag(r)) > 1e-8]
    return q - basis @ (basis.T @ q)


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], dim: int, p: WhiteningParams, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a symmetric matrix with their unit vectors (columns), and the passes it took.

    ``times`` multiplies the matrix with a block. ``slack``: error of its products
    beside rounding, as a share of the largest eigenvalue.
    """
    k, width = min(p.k, dim), min(dim, p.k + p.extra)
    basis = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((dim, width)))[0]
    products = times(basis)
    for done in range(1, p.passes + 1):
        small = basis.T @ products
        e, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-e)
        e, turn = e[order], turn[:, order]
        vectors, images = basis @ turn[:, :width], products @ turn[:, :width]
        residual = images - vectors * e[:width]
        if e[0] <= 0 or np.linalg.norm(residual[:, :k], axis=0).max() <= max(p.tolerance, slack) * e[0]:
            break
        if basis.shape[1] + width > p.kept * width:
            basis, products = vectors, images
        block = _fresh(residual, basis)
        if not block.shape[1]:
            break  # the blocks span all that the matrix reaches from them
        basis, products = np.hstack([basis, block]), np.hstack([products, times(block)])
    else:
        raise RuntimeError(f"components are not certified after {p.passes} passes")
    vectors = vectors[:, :k]
    return e[:k], vectors / np.linalg.norm(vectors, axis=0), done


def whiten(vectors: DataFrame, params: WhiteningParams | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that takes part and every component.

    A component's sign is such that its largest entry (the first of these) is positive.
    """
    p = params or WhiteningParams()
    fit = fit_list(vectors, p)
    none = vectors.sparkSession.createDataFrame([], RESULT)
    if fit is None:
        return none
    dim = len(fit.total)
    e, u, _ = eigenpairs(lambda q: multiply(fit, q), dim, p, 4e-16 * np.sqrt(fit.n))
    real = e > NOTHING * max(e[0], 0)
    if not real.any():
        return none
    e, u = e[real], u[:, real]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(len(e))])
    turn, k = u / np.sqrt(e), len(e)

    def moments(c: np.ndarray) -> np.ndarray:
        w = c @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0), [(c * c).sum()]])

    sums = _summed(fit, moments, k * k + k + 1) / fit.n
    mean = sums[k * k : -1]
    error = float(np.abs(sums[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    n, of = fit.n, Centred(None, fit.n, fit.total).of

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                moved = of(b["x"])
                if float((moved.astype(float) ** 2).sum(axis=1).max()) >= 2.0**63:
                    raise OverflowError("a deviation is beyond 64 bits")
                yield pd.DataFrame({"vec_id": b["vec_id"], "deviation": (moved * moved).sum(axis=1), "w": list(moved / n @ turn)})

    rows = fit.rows.mapInPandas(project, "vec_id long, deviation long, w array<double>")
    share = F.array(*[F.lit(float(x)) for x in e / sums[-1]])
    rows = rows.select("vec_id", F.posexplode("w").alias("i", "whitened"), "deviation")
    return rows.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
