"""Many questions at once against one question at a time."""

from __future__ import annotations

import json

import pytest

from millrace.config import Settings
from millrace.operators import bm25, dense, fusion
from millrace.plans import rounds
from millrace.plans.agent import Agent
from millrace.plans.providers import ScriptedChat

SETTINGS = Settings(top_k_vector=2, top_k_bm25=1, top_k_final=2)


def verdict(**x):
    return json.dumps({"sufficient": False, "confidence": 0.1, "gap": "g", "next_query": "keywords"} | x)


def plan(*queries):
    return json.dumps({"search_query": queries[0], "sub_queries": list(queries[1:])})


#: question, replies in order
SCRIPTS = [
    ("what is hybrid retrieval", [plan("hybrid", "dense", "a", "b", "c", "d"), verdict(confidence=0.95)]),
    ("which keywords", ["no json at all", verdict(next_query="judges"), "```json\n" + verdict(sufficient="yes", confidence="0.4") + "```"]),
    ("agents", [plan("", "agents"), "broken", "still broken", verdict(next_query="agents"), verdict(next_query="agents"), verdict()]),
    ("citations and passages", ['{"search_query": 0}', verdict(next_query="")]),
    ("overlap", [plan("overlap"), verdict(confidence="high", next_query="bm25"), verdict(next_query="numbers"), verdict(confidence=-3, next_query="cosine")]),
]


@pytest.fixture(scope="module")
def index(spark):
    texts = ["hybrid retrieval of passages", "dense vectors and cosine", "keywords and bm25", "passages about citations", "numbers and judges", "chunks with overlap", "agents that reflect " * 90]
    found = fusion.index_chunks(spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "chunk_id long, source string, text string"))
    return rounds.materialised(found)


def test_rounds_are_what_the_agent_does(spark, index):
    questions = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(SCRIPTS)], "question_id long, question string")
    replies = spark.createDataFrame([(i, c, r) for i, (_, said) in enumerate(SCRIPTS) for c, r in enumerate(said)], "question_id long, call long, reply string")
    found = rounds.run(index, questions, rounds.scripted(replies), SETTINGS)
    hits, steps = found.hits.orderBy("question_id", "rank").collect(), found.trace.orderBy("question_id", "step").collect()
    stats = {r["question_id"]: r for r in found.stats.collect()}
    assert len(stats) == len(SCRIPTS)
    for i, (question, said) in enumerate(SCRIPTS):
        want = Agent(spark, index, ScriptedChat(said), SETTINGS).run(question)
        own = [h for h in hits if h["question_id"] == i]
        assert [(h["chunk_id"], h["source"], round(h["score"], 12), h["bm25_score"]) for h in own] == [(h["chunk_id"], h["source"], round(h["score"], 12), h["bm25_score"]) for h in want.context]
        assert [(s["iteration"], s["query"], s["n_retrieved"], s["top_sources"], s["reflection"], s["next_query"], s["confidence"]) for s in steps if s["question_id"] == i] == [
            (t.iteration, t.query, t.n_retrieved, t.top_sources, t.reflection, t.next_query, t.confidence) for t in want.trace
        ]
        got = stats[i]
        assert (got["iterations"], got["empty_retrieval"], got["llm_calls"], got["retrieved_total"]) == (want.iterations, want.empty_retrieval, want.stats["llm_calls"], want.stats["retrieved_total"])
        assert (got["prompt_tokens"], got["completion_tokens"]) == (want.stats["prompt_tokens"], want.stats["completion_tokens"])


def test_a_provider_in_the_tasks_and_an_index_of_nothing(spark, index):
    enough, first = verdict(sufficient=True), plan("cosine")

    class Fixed:
        def chat(self, messages, temperature=0.0, max_tokens=None, json_mode=False):
            return enough if "Passages:" in messages[0]["content"] else first

    questions = spark.createDataFrame([(3, "q"), (8, "r")], "question_id long, question string")
    found = rounds.run(index, questions, rounds.provided(Fixed()), SETTINGS)
    assert sorted((r["question_id"], r["iterations"], r["llm_calls"]) for r in found.stats.collect()) == [(3, 1, 2), (8, 1, 2)]
    nothing = fusion.index_chunks(spark.createDataFrame([], "chunk_id long, source string, text string"))
    found = rounds.run(nothing, questions, rounds.provided(Fixed()), SETTINGS)
    assert sorted((r["question_id"], r["note"], r["empty_retrieval"]) for r in found.stats.collect()) == [(3, "no chunks retrieved", True), (8, "no chunks retrieved", True)]
    assert found.hits.count() == 0


def test_a_round_exchanges_no_chunks(spark, index):
    """Counts, vectors and texts stay in their splits, and materialised() writes no counts again."""
    queries = fusion.embed_queries(spark.createDataFrame([(0, "keywords"), (1, "passages")], "query_id long, text string"))
    for found in (bm25.search(index.lexical, queries), dense.search(index.vectors, queries)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" not in plan and "Sort [kind" not in plan
    again = rounds.materialised(index, texts=False)
    assert again.lexical.counts is index.lexical.counts and again.chunks is index.chunks
    plan = fusion.retrieve(index, queries, SETTINGS)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
