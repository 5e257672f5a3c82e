"""The Jaccard join against all pairs of plain sets."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import setindex, setjoin  # noqa: E402

DOCS = "doc_id long, text string, n int, row string, h string, own int"


def plain_sets(text, words: int) -> set:
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} or ({tuple(found)} if found else set())


def plain_components(data: list, words: int, percent: int) -> Counter:
    own, root = [(d, plain_sets(t, words)) for d, t in data], {d: d for d, _ in data if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return Counter((d, len(x), None if d is None else find(d) if x else d) for d, x in own)


def near_copies(rng, size: int, n: int, most: int, pool: int, first: int) -> list:
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(most)):
            own[rng.randrange(size)] = f"n{rng.randrange(pool)}"
        out.append((first + i, " ".join(own[rng.randrange(3) :])))
    return out


def data(seed: int) -> list:
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate([None, "", " \t", "a", "A", "a b", "a b c d", "a b c d e", "x" * 5000, "a b c d", "word " * 3000])]
    rows += near_copies(rng, 200, 120, 14, 10**6, 1000) + near_copies(rng, 60, 60, 5, 6, 2000) + near_copies(rng, 560, 30, 25, 10**6, 3000)
    rows += near_copies(rng, 500, 30, 25, 40, 4000) + near_copies(rng, 12, 30, 3, 3, 5000)
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(6000 + i, shared + " " + " ".join(f"q{rng.randrange(40)}" for _ in range(rng.randrange(20)))) for i in range(40)]
    rows += [(1000, rows[11][1]), (None, "no id"), (None, shared), (2000, "another text of an id that comes twice " + shared), (7000, shared + " an")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "percent", "block"), [(1, 85, 256), (2, 85, 40), (3, 60, 40), (4, 100, 256)])
def test_similar_sets(spark, seed, percent, block):
    rows = data(seed)
    docs = spark.createDataFrame([(i, t, 1, "r", "h", 2) for i, t in rows], DOCS).repartition(5)
    got = Counter(tuple(r) for r in setjoin.similar_sets(docs, setjoin.JoinParams(percent=percent, block=block)).collect())
    assert got == plain_components(rows, 4, percent)


def test_rows_of_one_id_with_unlike_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (9, "")]
    got = setjoin.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {3: 3, 5: 3, 7: 3, 9: 9}


def test_nothing(spark):
    assert setjoin.similar_sets(spark.createDataFrame([], DOCS)).count() == 0


def test_lists_make_no_pairs(spark):
    """Rows of all steps grow with a group and not with its square, though all of it is near the threshold."""
    sizes = {}
    for n in (200, 400):
        rng = random.Random(6)
        docs = spark.createDataFrame([(i, t) for i, t in near_copies(rng, 200, n, 12, 30, 0)], "doc_id long, text string")
        found = setindex.sets(docs, 4, 85)
        texts = setindex.texts_of(docs, found, setindex.classes_of(found), 85)
        prefix = setjoin.prefixes(setindex.entries(texts, 4, 85), 85).cache()
        sizes[n] = (prefix.count(), setjoin.candidates(prefix, 85).count())
    assert all(b <= 2.6 * a for a, b in zip(sizes[200], sizes[400], strict=True))
