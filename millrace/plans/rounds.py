"""The plan, retrieve, reflect loop for many questions at once.

Questions are rows of a state table. A round asks the model about all open
questions, retrieves all their queries in one plan and merges the hits into what
each question holds; both tables are written to the shared folder after every
round, so the plan of a round never holds those before it, and a lost executor
costs one step. ``max_iterations`` bounds the rounds. Nothing but "is any question
open" passes the driver.

The model is a function from calls (question_id, call, prompt) to replies
(question_id, reply); ``provided`` wraps a chat provider and ``scripted`` a table.
For each question the result is what ``plans.agent.Agent`` returns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.functions.text import context_block
from millrace.operators.fusion import HybridIndex, embed_queries, merge_hits, retrieve
from millrace.operators.rerank import Reranker
from millrace.plans.agent import NOTHING, PLAN, REFLECT, STRICT, STUCK, UNREADABLE, parse_object, read_verdict
from millrace.plans.providers import ChatProvider
from millrace.shared import stash

Model = Callable[[DataFrame], DataFrame]
SLOTS = 64  # queries of a question in a round, at most; query_id is question_id * SLOTS + place
VERDICT = "struct<sufficient:boolean,confidence:double,gap:string,next_query:string,described:string>"


@dataclass
class Rounds:
    """hits: question_id, rank, chunk_id, source, text, score, vector_score, bm25_score. trace: one row per question and
    retrieval. stats: one row per question."""

    hits: DataFrame
    trace: DataFrame
    stats: DataFrame


def scripted(replies: DataFrame) -> Model:
    """Replies from a table (question_id, call, reply); empty where it has none."""
    return lambda calls: calls.select("question_id", "call").join(replies, ["question_id", "call"], "left").select("question_id", F.coalesce("reply", F.lit("")).alias("reply"))


def provided(chat: ChatProvider) -> Model:
    """Replies of a provider, which goes to the tasks with the plan."""

    @F.pandas_udf("string")
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series([chat.chat([{"role": "user", "content": p}], json_mode=True) or "" for p in prompts], dtype=object)

    return lambda calls: calls.select("question_id", asked("prompt").alias("reply"))


def materialised(index: HybridIndex, texts: bool = True) -> HybridIndex:
    """An index whose parts are computed once. Counts are files already; so are the texts, without ``texts``."""
    return HybridIndex(stash(index.chunks, "chunks") if texts else index.chunks, stash(index.vectors, "vectors"), index.lexical, index.dim, index.embed)


def _prompt(template: str, **columns: Column) -> Column:
    marked = template.format(**{name: f"\x00{name}\x00" for name in columns})
    return F.concat(*[columns[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split("\x00", marked))])


def _planned(reply: str) -> Column:
    """The main query (null for the question itself) and the others."""

    @F.pandas_udf("array<string>")
    def read(replies: pd.Series) -> pd.Series:
        said = [parse_object(r) or {} for r in replies]
        return pd.Series([[s.get("search_query") or None, *map(str, s.get("sub_queries") or ())] for s in said])

    return read(reply)


def _judged(reply: str) -> Column:
    """A reply's verdict; all null where it can't be read."""

    @F.pandas_udf(VERDICT)
    def read(replies: pd.Series) -> pd.DataFrame:
        found = [read_verdict(r) for r in replies]
        rows = [(v.sufficient, v.confidence, v.gap, v.next_query, v.described()) if v else (None,) * 5 for v in found]
        return pd.DataFrame(rows, columns=["sufficient", "confidence", "gap", "next_query", "described"])

    return read(reply)


def _tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def _asked(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (question_id, call, prompt, ...) with the reply, and with call and token counts moved on."""
    replies = stash(model(rows.select("question_id", "call", "prompt")), "replies")
    met = rows.join(replies, "question_id")
    moved = {"call": F.col("call") + 1, "prompt_tokens": F.col("prompt_tokens") + _tokens(F.col("prompt")), "completion_tokens": F.col("completion_tokens") + _tokens(F.col("reply"))}
    return met.withColumns(moved).drop("prompt")


def _verdicts(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with v, the model's verdict; asked once more where it can't be read, and then taken as an insufficient one that asks the question again."""
    first = stash(_asked(rows, model).withColumn("v", _judged("reply")), "verdicts")
    read, rest = (first.filter(c) for c in ("v.described IS NOT NULL", "v.described IS NULL"))
    if rest.isEmpty():
        return read.drop("reply")
    again = rest.drop("reply", "v").join(rows.select("question_id", F.concat("prompt", F.lit(STRICT)).alias("prompt")), "question_id")
    again = _asked(again, model).withColumn("v", _judged("reply"))
    text = F.concat(F.lit("insufficient(conf=0.00): "), F.lit(UNREADABLE))
    fallback = F.struct(F.lit(False).alias("sufficient"), F.lit(0.0).alias("confidence"), F.lit(UNREADABLE).alias("gap"), F.col("question").alias("next_query"), text.alias("described"))
    again = again.withColumn("v", F.when(F.col("v.described").isNull(), fallback).otherwise(F.col("v")))
    return stash(read.drop("reply").unionByName(again.drop("reply")), "verdicts")


def _looked(index: HybridIndex, queries: DataFrame, held: DataFrame | None, step: int, settings: Settings, reranker: Reranker | None) -> DataFrame:
    """What questions hold after the hits of ``queries`` (question_id, place, text): first-seen fields, largest score."""
    asked = queries.select((F.col("question_id") * SLOTS + F.col("place")).alias("query_id"), "text")
    hits = retrieve(index, embed_queries(asked, index.dim, index.embed), settings, reranker=reranker)
    seen = (F.lit(step * SLOTS) + F.pmod("query_id", F.lit(SLOTS))) * 1_000_000 + F.col("rank")
    hits = hits.withColumns({"question_id": F.floor(F.col("query_id") / SLOTS).cast("long"), "seen": seen}).drop("query_id", "rank")
    if held is not None:
        hits = held.unionByName(hits.select(held.columns))
    columns = ["question_id", "chunk_id", "source", "text", "score", "vector_score", "bm25_score", "seen"]
    return stash(merge_hits(hits, "question_id").select(columns), "held")


def run(index: HybridIndex, questions: DataFrame, model: Model, settings: Settings | None = None, reranker: Reranker | None = None) -> Rounds:
    """Answers' contexts for all ``questions`` (question_id >= 0 and unique, question).

    A question stops where it holds nothing, where two retrievals in a row brought
    nothing new, where the verdict suffices, is confident or asks nothing more, or
    after ``max_iterations`` verdicts and the retrieval that follows.
    """
    s = settings or Settings()
    if s.max_sub_queries + 1 > SLOTS:
        raise ValueError(f"at most {SLOTS - 1} sub-queries")
    zero = F.lit(0).cast("long")
    state = questions.select("question_id", "question", zero.alias("call"), zero.alias("judged"), zero.alias("size"), zero.alias("streak"), zero.alias("prompt_tokens"), zero.alias("completion_tokens"), F.lit(None).cast("string").alias("stop"))
    state = _asked(state.withColumn("prompt", _prompt(PLAN.replace("{most}", str(s.max_sub_queries)), question=F.col("question"))), model)
    state = stash(state.withColumn("queries", F.slice(_planned("reply"), 1, s.max_sub_queries + 1)).drop("reply"), "state")
    first = F.transform("queries", lambda q, i: F.when(i == 0, F.coalesce(q, F.col("question"))).otherwise(q))
    state = state.withColumn("queries", first)
    held, trace, over = None, [], []
    for step in range(s.max_iterations + 1):
        queries = state.select("question_id", F.posexplode("queries").alias("place", "text"))
        held = _looked(index, queries, held, step, s, reranker)
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("x"), "seen", "source", "text")))
        sums = held.groupBy("question_id").agg(F.count("*").alias("now"), ranked.alias("ranked"))
        state = stash(state.join(sums, "question_id", "left").withColumn("now", F.coalesce("now", zero)), "state")
        streak = F.when((F.col("now") == F.col("size")) & F.lit(step > 0), F.col("streak") + 1).otherwise(zero)
        note = F.when(F.col("now") == 0, F.lit(NOTHING)).when(streak >= 2, F.lit(STUCK)).when(F.lit(step == s.max_iterations), F.lit(""))
        state = state.withColumns({"stop": note, "streak": streak, "size": F.col("now")}).drop("now")
        top = F.transform(F.slice(F.coalesce("ranked", F.array().cast("array<struct<x:double,seen:bigint,source:string,text:string>>")), 1, 3), lambda h: h["source"])
        seen = state.select("question_id", F.lit(step).alias("step"), F.col("judged").alias("iteration"), F.array_join("queries", " | ").alias("query"), F.col("size").alias("n_retrieved"), top.alias("top_sources"), F.coalesce("stop", F.lit("")).alias("note"))
        over.append(state.filter(F.col("stop").isNotNull()).drop("ranked", "queries"))
        if step == s.max_iterations:
            trace.append(seen.withColumn("v", F.lit(None).cast(VERDICT)))
            break
        numbered = F.transform("ranked", lambda h, i: F.struct((i + 1).alias("rank"), h["source"].alias("source"), h["text"].alias("text")))
        going = state.filter(F.col("stop").isNull())
        going = going.withColumn("prompt", _prompt(REFLECT, question=F.col("question"), context=context_block(numbered, 1200))).drop("ranked", "queries")
        going = _verdicts(stash(going, "going"), model)
        trace.append(seen.join(going.select("question_id", "v"), "question_id", "left"))
        v = F.col("v")
        done = v["sufficient"] | (v["confidence"] >= s.confidence_threshold) | (v["next_query"] == "")
        going = going.withColumns({"judged": F.col("judged") + 1, "stop": F.when(done, F.lit("")), "queries": F.array(v["next_query"])}).drop("v")
        over.append(going.filter(F.col("stop").isNotNull()).drop("queries"))
        state = stash(going.filter(F.col("stop").isNull()), "state")
        if state.isEmpty():
            break
    columns = ["question_id", "judged", "call", "size", "stop", "prompt_tokens", "completion_tokens"]
    ended = reduce(DataFrame.unionByName, [x.select(columns) for x in over])
    stats = ended.select(
        "question_id", F.col("judged").alias("iterations"), F.col("call").alias("llm_calls"), F.col("size").alias("retrieved_total"),
        (F.col("size") == 0).alias("empty_retrieval"), F.col("stop").alias("note"), "prompt_tokens", "completion_tokens",
    )
    steps = reduce(DataFrame.unionByName, trace)
    said = F.when(F.col("note") != "", F.col("note")).otherwise(F.coalesce("v.described", F.lit("")))
    steps = steps.select("question_id", "step", "iteration", "query", "n_retrieved", "top_sources", said.alias("reflection"), F.coalesce("v.next_query", F.lit("")).alias("next_query"), F.col("v.confidence").alias("confidence"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "seen")
    hits = held.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter(F.col("rank") < s.top_k_final)
    return Rounds(hits.select("question_id", "rank", "chunk_id", "source", "text", "score", "vector_score", "bm25_score"), steps, stats)
