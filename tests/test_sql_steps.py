from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import sql
from millrace.operators import chunking, fusion
from millrace.operators.rerank import Reranker
from millrace.plans.agent import Agent
from millrace.plans.providers import ScriptedChat

BITS = ["word ", "x", "。", "；", ". ", "? ", "\n", "\n\n", "长", "! ", "yy", "\x1f", "　", " ", "\U0001f600"]


def test_table_function_cuts_as_the_column_does(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "x" * 900, *("".join(rng.choices(BITS, k=rng.randrange(300))) for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").cache()
    sql.register(spark)
    for most, overlap in ((2, 0), (10, 3), (40, 8)):
        want = rows.select("id", F.posexplode(chunking.chunk_text(F.col("text"), most, overlap)).alias("pos", "text"))
        got = spark.sql("SELECT id, c.pos, c.text FROM {rows} r, LATERAL chunk_text(r.text, {most}, {overlap}) c", rows=rows, most=most, overlap=overlap)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scores_in_sql(spark):
    sql.register(spark, Reranker(scorer=lambda q, d: float(q in d)))
    got = spark.sql("SELECT rerank_score('b', t) AS s, text_tokens(t) AS n FROM VALUES ('abc'), ('xyzxyzxyz') AS v(t)").collect()
    assert [(r["s"], r["n"]) for r in got] == [(1.0, 1), (0.0, 2)]

    def broken(queries, docs):
        raise OSError("no service")

    sql.register(spark, Reranker(provider=broken))
    assert spark.sql("SELECT rerank_score('b', 'c') AS s").first()["s"] is None


@pytest.fixture(scope="module")
def index(spark):
    texts = ["hybrid retrieval of passages", "dense vectors and cosine", "keywords and bm25", "chunks with overlap"]
    return fusion.index_chunks(spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "chunk_id long, source string, text string"))


def test_steps_of_a_retrieval_are_timed(spark, index):
    queries = fusion.embed_queries(spark.createDataFrame([(0, "keywords and vectors"), (1, "passages")], "query_id long, text string"))
    plain, timings = fusion.retrieve(index, queries), fusion.Timings()
    assert sorted(fusion.retrieve(index, queries, timings=timings).collect()) == sorted(plain.collect())
    assert set(timings) == {"vector_ms", "bm25_ms", "rrf_ms", "rerank_ms"}
    assert timings["rerank_ms"] == 0 and min(timings[x] for x in ("vector_ms", "bm25_ms", "rrf_ms")) > 0
    same = Reranker(scorer=lambda q, d: float(len(d)))
    measured = fusion.retrieve(index, queries, reranker=same, timings=timings).collect()
    assert sorted(measured) == sorted(fusion.retrieve(index, queries, reranker=same).collect())
    assert timings["rerank_ms"] > 0


def test_agent_reports_the_rerankers_share_of_a_retrieval(spark, index):
    enough = json.dumps({"sufficient": True, "confidence": 1.0, "gap": "", "next_query": ""})
    chat = ScriptedChat([json.dumps({"search_query": "keywords", "sub_queries": []}), enough])
    stats = Agent(spark, index, chat, reranker=Reranker(scorer=lambda q, d: 1.0)).run("keywords").stats
    assert 0 < stats["rerank_ms"] <= stats["retrieve_ms"] <= stats["total_ms"]
