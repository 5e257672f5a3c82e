"""Links from differences to a base, against whole sets."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import setlinks  # noqa: E402
from millrace.llm.minhash import NearParams  # noqa: E402
from millrace.llm.shingles import shingles  # noqa: E402


def near_copies(n: int) -> list[str]:
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    out = [" ".join(base), " ".join(base[:60]), "w1 w2", ""]
    while len(out) < n:
        own = list(base)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(120)] = f"n{rng.randrange(40)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("base", [0, 1, 2, 9])
def test_links_from_differences(base):
    texts, p = near_copies(90), NearParams()
    sets = [set(shingles([t.encode()], p.words)[0].tolist()) for t in texts]
    order = [base, *(i for i in range(len(texts)) if i != base)]
    batch = pd.DataFrame({"block": 0, "rep": order, "first": [i == base for i in order], "text": [texts[i] for i in order]})
    found = pd.concat(setlinks._differences(p)(iter([batch[:50], batch[50:]])))
    assert found["rep"].tolist() == order and found["n"].tolist() == [len(sets[i]) for i in order]
    asked = [i for i in range(len(texts)) if i % 3 == 0]
    both = pd.concat([found.assign(asked=False), found[found["rep"].isin(asked)].assign(asked=True)])
    links = setlinks._met(both["rep"].to_numpy(np.int64), both["n"].to_numpy(np.int64), list(both["diff"]), both["asked"].to_numpy(bool), p.percent)

    def linked(a: int, b: int) -> bool:
        x, y = sets[a], sets[b]
        return a != b and bool(x and y) and 100 * len(x & y) >= p.percent * len(x | y)

    def joined(edges: list[tuple[int, int]]) -> list[int]:
        root = list(range(len(texts)))
        for _ in texts:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    pairs = list(links[["a", "b"]].itertuples(index=False, name=None))
    assert all(linked(a, b) for a, b in pairs)
    assert joined(pairs) == joined([(a, b) for a in asked for b in range(len(texts)) if linked(a, b)])


def test_blocks_that_hold_one_kind_only():
    none = setlinks._met(np.array([1, 2]), np.array([3, 3]), [np.arange(3), np.arange(3)], np.array([True, True]), 80)
    assert none.empty
