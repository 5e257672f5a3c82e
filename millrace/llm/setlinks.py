"""Links between sets of word shingles on full sets, within clusters that are known to hold all of them.

A cluster's texts meet in one task, where links are decided on full sets and a
spanning forest of them is returned. A larger cluster is dealt into blocks, each
with the same few members beside its own (those with the fewest shingles that no
other has), so that a text is sent once and blocks are linked through what they
share. Where that leaves several components, the members outside the largest are
asked against all of their cluster in blocks. Their answers are derived from one
base's: near copies differ from it in few shingles, so members are sent as these
differences, and two sets that differ from the base in x and y differ from each
other in |x| + |y| - 2 |x and y|.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stash, tell
from millrace.llm.components import components
from millrace.llm.shingles import shingles


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions of edges that form a spanning forest."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for e, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            root[i] = j
            out.append(e)
    return out


def _linked(value: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets with 100 * intersection >= percent * union."""
    k = len(n)
    end = np.cumsum(n)
    if k <= 6:
        sets = [value[e - c : e] for e, c in zip(end, n, strict=True)]
        pairs = [(i, j) for i in range(k) for j in range(i)]
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
        i, j = np.array(pairs, np.int64).T if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
    else:
        owner = np.repeat(np.arange(k), n)
        _, code, times = np.unique(value, return_inverse=True, return_counts=True)
        shared = times[code] > 1  # shingles of one text only add to no intersection
        owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        both = np.zeros((k, k), np.float64)
        width = 4096
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            lo, hi = np.searchsorted(code, [at, at + width])
            dense = np.zeros((k, width), np.float32)
            dense[owner[lo:hi], code[lo:hi] - at] = 1
            both += dense @ dense.T
        i, j = np.tril_indices(k, -1)
        both = both[i, j].astype(np.int64)
    ok = (100 * both >= percent * (n[i] + n[j] - both)) & (n[i] > 0) & (n[j] > 0)
    return i[ok], j[ok]


def _verify(p):
    def linked(tasks: list[tuple], texts: list[bytes]) -> Iterator[tuple[int, int]]:
        value, n = shingles(texts, p.words)
        end, lo = np.cumsum(n), 0
        for size, reps in tasks:
            own = n[lo : lo + size]
            start = end[lo] - n[lo] if size else 0
            a, b = _linked(value[start : start + own.sum()], own, p.percent)
            for e in _forest(a, b, size):
                yield reps[a[e]], reps[b[e]]
            lo += size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tasks, texts, size = [], [], 0
        key, reps = None, []

        def close() -> None:
            if reps:
                tasks.append((len(reps), list(reps)))

        for b in batches:
            rows = zip(b["cluster"].tolist(), b["block"].tolist(), b["rep"].tolist(), b["text"], strict=True)
            for cluster, block, rep, text in rows:
                if key != (cluster, block):
                    close()
                    reps.clear()
                    if size > 4 << 20:
                        yield pd.DataFrame(list(linked(tasks, texts)), columns=["a", "b"], dtype="int64")
                        tasks, texts, size = [], [], 0
                    key = (cluster, block)
                reps.append(rep)
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
        close()
        yield pd.DataFrame(list(linked(tasks, texts)), columns=["a", "b"], dtype="int64")

    return run


def _confirmed(groups: DataFrame, texts: DataFrame, p) -> DataFrame:
    """Links a, b (a spanning forest of them) on full sets within each cluster and block of ``groups`` (cluster, block, rep)."""
    met = texts.select("rep", "text").join(groups.hint("merge"), "rep").select("cluster", "block", "rep", "text")
    met = met.repartition("cluster", "block").sortWithinPartitions("cluster", "block")
    return stash(met.mapInPandas(_verify(p), "a long, b long"), "links")


def _differences(p):
    """rep, n (its shingles), diff (those that it or the base of its cluster has, but not both); the base comes first in each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = np.empty(0, np.uint64)
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            rep, first, block = b["rep"].to_numpy(np.int64), b["first"].to_numpy(bool), b["block"].to_numpy(np.int64)
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and size < 2 << 20:
                    size += len(texts[hi])
                    hi += 1
                value, n = shingles(texts[lo:hi], p.words)
                end = np.cumsum(n)
                at, diffs = [], []
                for i in range(lo, hi):
                    own = value[end[i - lo] - n[i - lo] : end[i - lo]]
                    if first[i]:
                        base = own
                    if not first[i] or block[i] == 0:
                        at.append(i)
                        diffs.append(np.setxor1d(base, own, assume_unique=True).view(np.int64))
                yield pd.DataFrame({"rep": rep[at], "n": n[np.array(at, np.int64) - lo], "diff": diffs})
                lo = hi

    return run


def _met(rep: np.ndarray, n: np.ndarray, diffs: list[np.ndarray], asked: np.ndarray, percent: int) -> pd.DataFrame:
    """A spanning forest of the links between asked members and the others of one block.

    Sets that differ from a base in x and y differ from each other in |x| + |y| - 2 * |x and y| shingles.
    """
    size = np.array([len(d) for d in diffs], np.int64)
    owner = np.repeat(np.arange(len(rep)), size)
    _, code, times = np.unique(np.concatenate(diffs), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    y, x = np.flatnonzero(asked), np.flatnonzero(~asked)
    both = np.zeros((len(y), len(x)), np.float64)
    width = 4096
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [at, at + width])
        dense = np.zeros((len(rep), width), np.float32)
        dense[owner[lo:hi], code[lo:hi] - at] = 1
        both += dense[y] @ dense[x].T
    apart = size[y][:, None] + size[x][None] - 2 * both.astype(np.int64)
    total = n[y][:, None] + n[x][None]
    i, j = np.nonzero((100 * (total - apart) >= percent * (total + apart)) & (rep[y][:, None] != rep[x][None]))
    kept = _forest(y[i], x[j], len(rep))
    return pd.DataFrame({"a": rep[y[i[kept]]], "b": rep[x[j[kept]]]}, dtype="int64")


def _against(p):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def close() -> pd.DataFrame:
            rep, n, diffs, asked = zip(*held, strict=True)
            return _met(np.array(rep, np.int64), np.array(n, np.int64), [np.asarray(d, np.int64) for d in diffs], np.array(asked, bool), p.percent)

        for b in batches:
            for *at, rep, n, diff, asked in b.itertuples(index=False, name=None):
                if at != key and held:
                    yield close()
                    held.clear()
                key = at
                held.append((rep, n, diff, asked))
        if held:
            yield close()

    return run


def _rest(state: DataFrame, texts: DataFrame, p) -> DataFrame | None:
    """Links a, b that the blocks of large clusters have not found; None if there are none to look for. ``state``: rep, cluster, own, root.

    What is linked already is mostly one root. The members of other roots are asked
    against all of their cluster in blocks, each member being sent as its few
    differences from one base (with the fewest shingles of its own) and not as text.
    """
    by_root = state.groupBy("cluster", "root").agg(F.count("*").alias("c"), F.min(F.struct("own", "rep")).alias("base"))
    open_ = by_root.groupBy("cluster").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("m"), F.min("base").alias("base"))
    open_ = open_.select("cluster", "n", F.col("base.rep").alias("base"), F.col("m.root").alias("big"), (F.col("n") - F.col("m.c")).alias("rare")).filter("rare > 0")
    open_ = stash(open_, "unsettled")
    if open_.isEmpty():
        return None

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / (2 * p.block)).cast("int")

    met = tell(state, open_, ["cluster"], "n", state.count())
    met = stash(met.select("cluster", "rep", (F.col("rep") == F.col("base")).alias("first"), (F.col("root") != F.col("big")).alias("asked"), blocks("n").alias("xs"), blocks("rare").alias("ys")), "unsettled")

    def mine(n: str) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(9)), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    dealt = met.select("cluster", F.explode(F.when(F.col("first"), F.sequence(F.lit(0), F.col("xs") - 1)).otherwise(F.array(mine("xs")))).alias("block"), "rep", "first")
    rows = texts.select("rep", "text").join(dealt.hint("merge"), "rep").repartition("cluster", "block").sortWithinPartitions("cluster", "block", F.desc("first"))
    diffs = stash(rows.select("block", "rep", "first", "text").mapInPandas(_differences(p), "rep long, n long, diff array<long>"), "differences")
    both = met.join(diffs.hint("merge"), "rep")
    x = both.select("cluster", every("ys").alias("y"), mine("xs").alias("x"), "rep", "n", "diff", F.lit(False).alias("asked"))
    y = both.filter("asked").select("cluster", mine("ys").alias("y"), every("xs").alias("x"), "rep", "n", "diff", "asked")
    rows = x.unionByName(y).repartition("cluster", "y", "x").sortWithinPartitions("cluster", "y", "x")
    return stash(rows.mapInPandas(_against(p), "a long, b long"), "links")

def links(clusters: DataFrame, own: DataFrame, texts: DataFrame, p) -> DataFrame:
    """Links a, b on full sets that make each cluster's true components.

    ``clusters``: node, root, with every link inside a root. ``own``: rep, own (how
    rare a node's shingles are; its lowest share the blocks). ``texts``: rep, text.
    ``p`` has words, percent, block, shared.
    """
    sizes = stash(clusters.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    members = tell(clusters, sizes, ["root"], "size", clusters.count()).select(F.col("node").alias("rep"), F.col("root").alias("cluster"), F.ceil(F.col("size") / p.block).cast("int").alias("blocks"))
    members = stash(members, "members")
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return _confirmed(members.select("cluster", F.lit(0).alias("block"), "rep"), texts, p)
    ranked = stash(large.join(own.hint("merge"), "rep", "left").select("cluster", "rep", F.coalesce("own", F.lit(0)).alias("own")), "ranked")
    some = ranked.groupBy("cluster", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(p.shared))).agg(F.min(F.struct("own", "rep"))["rep"].alias("rep"))
    groups = members.join(stash(some.select("rep", F.lit(True).alias("everywhere")), "shared").hint("merge"), "rep", "left")
    mine = F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    block = F.when(F.col("everywhere"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(mine)
    found = _confirmed(groups.select("cluster", F.explode(block).alias("block"), "rep"), texts, p)
    roots = components(found).withColumnRenamed("node", "rep")
    state = stash(ranked.join(roots.hint("merge"), "rep", "left").select("rep", "cluster", "own", F.coalesce("root", "rep").alias("root")), "state")
    more = _rest(state, texts, p)
    return found if more is None else found.unionByName(more)
