"""Small tables in many partitions are computed in all of them and written in few files."""

from __future__ import annotations

from pathlib import Path

import pytest

pytest.importorskip("millrace.llm")

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import digestindex, minhash, mix  # noqa: E402
from millrace.llm.common import FEW, shared_dir, sized, stash  # noqa: E402

PARTS = 32
MANY = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture()
def many(spark):
    before = {k: spark.conf.get(k) for k in MANY}
    for k, v in MANY.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def texts(spark):
    """60 texts twice each, and each once more with another last word."""
    word = "concat('w', cast(id % 60 * 31 + x as string))"
    body = F.expr(f"concat_ws(' ', transform(sequence(1, 30), x -> {word}))")
    last = F.when(F.col("id") >= 120, F.concat(body, F.lit(" end"))).otherwise(body)
    return spark.range(180).select(F.col("id").alias("doc_id"), last.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))


STAGES = {
    "exact": lambda docs: digestindex.kept_rows(docs, digestindex.new_index(docs.sparkSession)),
    "near": lambda docs: minhash.kept_rows(docs, minhash.NearParams(words=5)),
    "mix": mix.copies,
}


@pytest.mark.parametrize("name", STAGES)
def test_small_tables_are_written_in_few_files(many, name):
    shared = shared_dir(many).removeprefix("file:")

    def per_table() -> dict:
        found = [p for p in Path(shared).rglob("*.parquet") if not p.name.startswith(".") and "batch=" not in str(p)]
        return {top: sum(p.parent == top for p in found) for top in {p.parent for p in found}}

    docs = texts(many)
    before = per_table()
    rows = sorted(r["doc_id"] for r in STAGES[name](docs).collect())
    assert {"exact": rows == list(range(60, 180)), "near": rows == list(range(60)), "mix": set(rows) == set(range(180))}[name]
    written = {k: n for k, n in per_table().items() if k not in before}
    assert written and max(written.values()) <= many.sparkContext.defaultParallelism


def test_larger_tables_are_written_as_they_are(many):
    rows = many.range(2000).repartition(PARTS)
    with sized(many, FEW * PARTS):
        assert len(stash(rows).inputFiles()) == PARTS
    with sized(many, FEW * PARTS - 1):
        few = stash(rows)
    assert len(few.inputFiles()) <= many.sparkContext.defaultParallelism and few.count() == 2000
    assert len(stash(rows).inputFiles()) == PARTS
