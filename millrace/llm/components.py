"""Connected components of a large graph: contraction within blocks of edges, then small-star and large-star steps until all are stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stash, tell

BLOCK = 1 << 20  # edges that a task holds at once


def _stars(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Stars around the smallest node of each component of these edges; a loop for a node without others."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    centre = np.zeros(len(nodes), bool)
    centre[label[label != np.arange(len(nodes))]] = True
    return pd.DataFrame({"a": nodes[~centre], "b": nodes[label[~centre]]})


def _contract(block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            while size + len(batch) > block:
                held.append(batch.iloc[: block - size])
                batch = batch.iloc[block - size :]
                met, held, size = pd.concat(held), [], 0
                yield _stars(met["a"].to_numpy(np.int64), met["b"].to_numpy(np.int64))
            held.append(batch)
            size += len(batch)
        if size:
            met = pd.concat(held)
            yield _stars(met["a"].to_numpy(np.int64), met["b"].to_numpy(np.int64))

    return run


def _blocks(e: DataFrame, total: int, block: int) -> DataFrame:
    """Stars of the components of each block of edges; as few tasks as there are blocks, each holding one block at a time."""
    return stash(e.coalesce(max(1, -(-total // block))).mapInPandas(_contract(block), "a long, b long"), "stars")


def _done(e: DataFrame) -> bool:
    """Whether every node has one neighbour below it or is a centre; ``e`` may repeat edges."""
    ends = e.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(e.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("up")))
    ends = ends.groupBy("node").agg(F.min("up").alias("x"), F.max("up").alias("y"), (F.count("*") - F.count("up")).alias("below"))
    return ends.filter("x <> y OR x IS NOT NULL AND below > 0").isEmpty()


def components(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, root (smallest node of its component) of every node in ``edges`` (a, b); loops are allowed.

    Every round begins with blocks of up to ``block`` edges that become stars around
    their smallest node, without a shuffle; edges that fit one block are done with
    that, at any round. Else a small-star step sends a node and its smaller
    neighbours to the smallest of them, a large-star step its larger ones; components
    shrink to stars around their smallest node in a number of rounds that grows with
    the logarithm of the longest path at most. Minima are combined map-side, and they
    reach a node's edges through ``tell``: the centre of a large star is broadcast, so
    its edges stay where they are.
    """
    given = stash(edges.select("a", "b"), "edges")
    total = given.count()
    first = e = _blocks(given, total, block)
    loops = first.filter("a = b").select(F.col("a").alias("node")).distinct()
    while total > block:
        e = e.filter("a <> b")  # a > b
        total = e.count()
        if not total or _done(e):
            break
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        smaller = tell(e, low, ["a"], "n", total)
        smaller = stash(smaller.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")), "edges")
        both = smaller.unionByName(smaller.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        larger = tell(both.filter("b > a"), low, ["a"], "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = stash(larger, "edges")
        total = larger.count()
        e = _blocks(larger, total, block)
    star = e.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    found = star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.unionByName(alone)
