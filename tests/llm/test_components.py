"""Components against union by hand: paths, stars, repeated edges and loops dealt over several tasks."""

from __future__ import annotations

import random

import pytest

from millrace.llm.components import components


def plain(edges: list[tuple[int, int]]) -> set[tuple[int, int]]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(up)}


def shuffled_path(n: int) -> list[tuple[int, int]]:
    names = random.Random(2).sample(range(-n, n), n)
    return list(zip(names, names[1:]))


CASES = {
    "path": shuffled_path(200),
    "star": [(0, i) for i in range(1, 300)] + [(300, i) for i in range(301, 400)] + [(299, 399)],
    "random": [(random.Random(i).randrange(400), random.Random(-i).randrange(400)) for i in range(1, 260)],
    "repeats_and_loops": [(5, 5), (7, 7), (1, 7), (7, 1), (1, 7), (-3, -3), (9, 8)],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    edges = CASES[case]
    df = spark.createDataFrame(edges, "a long, b long").repartition(24)
    found = [tuple(r) for r in components(df, 8).select("node", "root").collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
