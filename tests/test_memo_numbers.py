from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions.vectors import provider_embedding
from millrace.operators import fusion, numbers
from millrace.plans.memo import Memo


def test_each_text_is_embedded_once(spark, tmp_path):
    called, broken = tmp_path / "called", tmp_path / "broken"

    def embed(texts):
        with open(called, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if broken.exists() and "d" in texts:
            raise RuntimeError("the service is gone")
        return [[float(len(t)), 1.0] for t in texts]

    chunks = spark.createDataFrame([(i, "s", t) for i, t in enumerate("aa b aa c b d".split())], "chunk_id long, source string, text string")
    path = str(tmp_path / "memo")

    def index():
        return fusion.index_chunks(chunks, 2, provider_embedding(embed), Memo(spark, path, "array<double>", 3), "m")

    first = {r["chunk_id"]: r["embedding"] for r in index().vectors.collect()}
    assert Counter(called.read_text().split()) == Counter("aa b c d".split()) and set(first) == set(range(6))
    assert {r["chunk_id"]: r["embedding"] for r in index().vectors.collect()} == first
    assert Counter(called.read_text().split()) == Counter("aa b c d".split())


def test_a_run_that_died_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}",) for i in range(40)] + [("k1",)], "key string")
    memo, seen = Memo(spark, str(tmp_path / "memo"), buckets=3), []

    def compute(some):
        if len(seen) == 2:
            raise RuntimeError("killed")
        seen.append(sorted(r["key"] for r in some.collect()))
        return some.withColumn("value", F.when(F.col("key") != "k7", F.upper("key")))

    with pytest.raises(RuntimeError, match="killed"):
        memo.filled(rows, compute, 10)
    done = sum(seen, [])
    assert memo.known().count() == len([k for k in done if k != "k7"])
    again = []

    def rest(some):
        again.extend(r["key"] for r in some.collect())
        return some.withColumn("value", F.upper("key"))

    found = {tuple(r) for r in Memo(spark, str(tmp_path / "memo")).filled(rows, rest).collect()}
    assert found == {(f"k{i}", f"K{i}") for i in range(40)}
    assert sorted(again) == sorted({f"k{i}" for i in range(40)} - set(done) | ({"k7"} & set(done)))


def test_unsupported_numbers(spark):
    rng = random.Random(8)
    items = ["in 20", "24 it", "", "was -3 . 5 %", None, "1", "2", "3 000 or", "9.", "75٣"] + [" ".join(str(rng.randrange(300)) for _ in range(5)) for _ in range(20)]
    answers = ["2024 and 3.5%", "-3.5 then 123000", "12", "1230009.75", None, "no", "20 24 -20", "9.75 ٣ 75٣", "123000 9"] + [" ".join(f"{rng.randrange(-50, 999)}" for _ in range(8)) for _ in range(30)]
    context = " ".join(t for t in items if t is not None)
    want = Counter()
    for i, a in enumerate(answers):
        found = [x.rstrip("%") for x in re.findall(r"-?\d+(?:\.\d+)?%?", a or "")]
        want[(i, len(found), ",".join(x for x in found if x not in context.replace(" ", "") and x not in context))] += 1
    got = numbers.unsupported(
        spark.createDataFrame(list(enumerate(answers)), "id long, answer string"), spark.createDataFrame(list(enumerate(items)), "pos long, text string").repartition(4)
    )
    assert Counter((r["id"], r["n_numbers"], ",".join(r["unsupported"])) for r in got.collect()) == want
