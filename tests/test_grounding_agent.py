from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.operators import figures, fusion, grounding, metrics
from millrace.plans.agent import Agent, parse_verdict
from millrace.plans.answer import answer_safely, evaluate, read_golden
from millrace.plans.cache import ResponseCache, compute_missing
from millrace.plans.providers import CachedChat, ScriptedChat


@pytest.mark.parametrize(
    ("answer", "n", "cited", "invalid", "abstain"),
    [
        ("根据[1]与[5]可知结论。", 3, [1, 5], [5], False),
        ("结论[9]。", 2, [9], [9], False),
        ("none", 3, [], [], True),
        ("[1]", 0, [1], [1], True),
        ("", 3, [], [], True),
        (None, 3, [], [], True),
        ("[1,2] [0] [２]", 3, [0, 2], [0], False),
        ("[3][1][3]", 3, [1, 3], [], False),
    ],
)
def test_citations(spark, answer, n, cited, invalid, abstain):
    row = spark.createDataFrame([(answer, n)], "a string, n long")
    got = row.select(grounding.validate_citations(F.col("a"), F.col("n")).alias("c"), grounding.needs_abstain(F.col("a"), F.col("n")).alias("x"), grounding.safe_answer(F.col("a"), F.col("n")).alias("s")).first()
    assert (got["c"]["citations"], got["c"]["invalid"], got["c"]["valid"], got["c"]["has_citation"]) == (cited, invalid, not invalid, bool(cited))
    assert got["x"] == abstain
    if abstain:
        assert got["s"] == grounding.ABSTAIN
    elif invalid:
        assert got["s"].startswith(answer.rstrip()) and f"[{invalid[0]}]" in got["s"][len(answer.rstrip()) :]
    else:
        assert got["s"] == answer


def test_critic(spark):
    said = json.dumps({"faithful": False, "hallucinated": ["x"], "missing": ["y"], "issues": ["z"]})
    rows = [(1, "99.5% of 1200", "87% of 1200", "garbage"), (2, "1200", "1200", said), (3, "5", "6", '{"hallucinated": []}'), (4, "ok", "ok", None)]
    data = spark.createDataFrame(rows, "i int, answer string, context string, reply string")
    got = {r["i"]: r for r in grounding.critique(data, reply="reply").collect()}
    assert (got[1]["faithful"], got[1]["hallucinated"]) == (False, ["99.5"]) and len(got[1]["issues"]) == 1
    assert (got[2]["faithful"], got[2]["hallucinated"], got[2]["missing"], got[2]["issues"]) == (False, ["x"], ["y"], ["z"])
    assert got[3]["hallucinated"] == ["5"]
    assert (got[4]["faithful"], got[4]["hallucinated"], got[4]["issues"]) == (True, [], [])


def test_metrics(spark):
    rows = [(1, ["A"], ["B", "A", "C"]), (2, [], ["A"]), (3, ["A", "A", "Z"], ["A"]), (4, ["Q"], [])]
    got = {r["i"]: r for r in metrics.retrieval_metrics(spark.createDataFrame(rows, "i int, relevant array<string>, retrieved array<string>")).collect()}
    assert (got[1]["recall_1"], got[1]["recall_3"], got[1]["mrr"], got[1]["hit_rate_5"]) == (0, 1, 0.5, 1)
    assert got[2]["mrr"] is None
    assert got[3]["recall_1"] == 0.5
    assert (got[4]["mrr"], got[4]["hit_rate_5"]) == (0, 0)


def test_judges(spark):
    rows = [
        ("a", '{"claims": [{"claim": "x", "supported": true}, {"claim": "y", "supported": false}]}', '{"score": 4}'),
        ("a", '{"claims": []}', '{"score": 9}'), ("", '{"claims": []}', "none"), ("a", "none", '{"score": 2.9}'),
    ]
    data = spark.createDataFrame(rows, "a string, f string, s string")
    got = data.select(metrics.faithfulness(F.col("a"), F.col("f")).alias("f"), metrics.relevancy(F.col("s")).alias("s")).collect()
    assert [r["f"] for r in got] == [0.5, 1.0, 0.0, 0.0]
    assert [r["s"] for r in got] == [0.8, 1.0, 0.0, 0.4]


def test_figures(spark):
    kind = "path string, page int, pos int, type int, bbox array<double>, lines array<struct<spans:array<struct<text:string>>>>"

    def lines(*texts):
        return [([(t,)],) for t in texts]

    rows = [
        ("x/a.pdf", 1, 0, 1, [10.04, 10.0, 100.0, 80.0], []),
        ("x/a.pdf", 1, 1, 0, [10.0, 200.0, 100.0, 210.0], lines("Table 2", "sizes")),
        ("x/a.pdf", 1, 2, 0, [10.0, 85.0, 100.0, 95.0], lines("图1 光路")),
        ("x/a.pdf", 2, 0, 1, [0.0, 0.0, 5.0, 5.0], []),
        ("x/a.pdf", 2, 1, 0, [0.0, 6.0, 5.0, 7.0], lines("no caption")),
    ]
    found = figures.nearest_captions(spark.createDataFrame(rows, kind))
    got = found.orderBy("page").collect()
    assert [(r["index"], r["kind"], r["caption"]) for r in got] == [(1, "figure", "图1 光路"), (2, "figure", "")]
    assert got[0]["bbox"] == [10.0, 10.0, 100.0, 80.0]
    docs = figures.figure_documents(found).orderBy("source").collect()
    assert [(d["source"], d["text"]) for d in docs] == [("a.pdf#fig1-1", "图1 光路"), ("a.pdf#fig2-2", "[figure on page 2]")]


def test_cache(tmp_path):
    cache, calls = ResponseCache(str(tmp_path)), []

    def compute():
        calls.append(1)
        return {"x": "值"}

    assert cache.cached("n", ["k", 1], compute) == cache.cached("n", ["k", 1], compute) == {"x": "值"}
    assert len(calls) == 1
    assert cache.get("n", ["k", 2]) is None and cache.get("other", ["k", 1]) is None
    cache.set("n", "none", None)
    assert cache.cached("n", "none", lambda: 5) == 5
    off = ResponseCache(str(tmp_path), enabled=False)
    assert off.get("n", ["k", 1]) is None
    cache.clear()
    assert cache.get("n", ["k", 1]) is None
    chat = CachedChat(ScriptedChat(["a", "b"]), cache)
    said = [chat.chat([{"role": "user", "content": "q"}], json_mode=m) for m in (False, False, True)]
    assert said == ["a", "a", "b"]


def test_compute_missing(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "key string")
    known = spark.createDataFrame([("a", "1"), ("c", None)], "key string, value string")
    seen = []

    def compute(missing):
        seen.extend(sorted(r["key"] for r in missing.collect()))
        return missing.withColumn("value", F.upper("key"))

    assert {tuple(r) for r in compute_missing(rows, known, "key", compute).collect()} == {("a", "1"), ("b", "B"), ("c", "C")}
    assert seen == ["b", "c"]


@pytest.fixture(scope="module")
def index(spark):
    texts = ["hybrid retrieval of passages", "dense vectors and cosine", "keywords and bm25", "passages about citations", "numbers and judges", "chunks with overlap", "agents that reflect"]
    rows = [(i, f"d{i}", t) for i, t in enumerate(texts)]
    found = fusion.index_chunks(spark.createDataFrame(rows, "chunk_id long, source string, text string").cache())
    found.vectors.cache()
    return found


def verdict(**x):
    return json.dumps({"sufficient": False, "confidence": 0.1, "gap": "g", "next_query": "keywords"} | x)


def test_agent_caps_sub_queries_and_stops_when_confident(spark, index):
    chat = ScriptedChat([json.dumps({"search_query": "hybrid", "sub_queries": list("abcde")}), verdict(confidence=0.9)])
    agent = Agent(spark, index, chat)
    events = list(agent.stream("question"))
    assert [e["type"] for e in events] == ["plan", "retrieve", "reflect", "done"]
    assert events[0]["sub_queries"] == list("abcd")
    result = events[-1]["result"]
    assert (result.iterations, len(result.trace), result.stats["llm_calls"]) == (1, 1, 2)
    assert len(result.context) <= Settings().top_k_final
    assert {"plan_ms", "retrieve_ms", "reflect_ms", "rerank_ms", "total_ms", "prompt_tokens", "completion_tokens", "retrieved_total"} <= set(result.stats)


def test_agent_survives_garbage(spark, index):
    chat = ScriptedChat(["no plan", "garbage", "more garbage", verdict(sufficient=True)])
    result = Agent(spark, index, chat).run("hybrid retrieval")
    assert result.iterations == 2
    assert result.trace[0].reflection == "insufficient(conf=0.00): (reflection parse failed)"
    assert result.trace[0].next_query == "hybrid retrieval"
    assert result.trace[1].reflection == "sufficient"


def test_agent_stops_without_new_chunks(spark, index):
    result = Agent(spark, index, ScriptedChat(["{}", *[verdict()] * 5]), Settings(max_iterations=5)).run("keywords")
    assert result.trace[-1].reflection == "no new chunks; stopping"


def test_agent_without_hits(spark, index):
    empty = fusion.index_chunks(index.chunks.limit(0))
    result = Agent(spark, empty, ScriptedChat(["{}"])).run("anything")
    assert (result.empty_retrieval, result.iterations, result.trace[0].reflection) == (True, 0, "no chunks retrieved")
    assert result.stats["llm_calls"] == 1
    assert answer_safely(spark, ScriptedChat([]), "q", []) == grounding.ABSTAIN


def test_verdicts():
    assert parse_verdict("[1]") is None
    assert parse_verdict('{"sufficient": "false"}') == {"sufficient": True, "confidence": 1.0, "gap": "", "next_query": ""}
    assert parse_verdict('{"confidence": 7, "next_query": null}')["confidence"] == 1.0


def test_evaluation(spark, index, tmp_path):
    golden = [{"question": "hybrid retrieval", "reference_answer": "r", "relevant_sources": ["d0"]}, {"question": "cosine", "reference_answer": "r", "relevant_sources": []}]
    (tmp_path / "golden.json").write_text(json.dumps(golden), encoding="utf-8")
    rows = [r.asDict() for r in read_golden(spark, str(tmp_path / "golden.json")).collect()]
    each = ["{}", verdict(sufficient=True), "It is hybrid [1].", '{"faithful": true}', '{"claims": []}', '{"score": 5}']
    data, report = evaluate(Agent(spark, index, ScriptedChat(each + ["{}"] + each[:3])), rows)
    first = data.filter("question = 'hybrid retrieval'").first()
    assert (first["recall_1"], first["mrr"], first["citation_valid"], first["critic_faithful"]) == (1.0, 1.0, True, True)
    summary = report.first()
    assert (summary["n"], summary["recall_1"], summary["citation_valid_rate"], summary["abstain_rate"]) == (2, 1.0, 1.0, 0.0)
