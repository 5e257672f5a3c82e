"""The retrieval queries; each runs over its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.functions import text as T
from millrace.functions.sql import register
from millrace.functions.vectors import hashed_embedding
from millrace.operators import bm25, chunking, dense, figures, fusion, grounding, metrics, numbers
from millrace.operators.containment import containing
from millrace.operators.rerank import Reranker
from millrace.plans import rounds
from millrace.registry import table
from millrace.shared import shared_dir, stash
from millrace.sources import index_store

SETTINGS = Settings()


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where a table is one small file; large tables come in more splits than that and stay as read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.coalesce("text", F.lit("")).alias("text"))
    return _spread(docs)


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.embed_queries(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def _index(spark: SparkSession, sf: str) -> fusion.HybridIndex:
    return fusion.index_chunks(_docs(spark, sf))


def _stored(spark: SparkSession, sf: str) -> fusion.HybridIndex:
    """The index with its vectors as files, so that a task runs one Python function at a time."""
    return rounds.materialised(_index(spark, sf), texts=False)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.retrieve(_stored(spark, sf), _queries(spark, sf), SETTINGS)


def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.count_tokens(F.coalesce("text", F.lit(" "))).alias("n_tokens"))


def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.tokenize(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_terms")
    )


def cjk_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "检索增强生成"), (2, "CODE V 光学设计 MicroLED 2024"), (3, "检X索"), (4, "！！！"), (5, ""), (6, "光")]
    return spark.createDataFrame(rows, "id int, text string").select("id", F.array_join(T.tokenize(F.col("text")), "|").alias("tokens"))


def hard_split_chunks(spark: SparkSession, sf: str) -> DataFrame:
    pieces = chunking.hard_split(F.col("text"), SETTINGS.max_tokens)
    rows = table(spark, sf, "documents").filter(F.length("text") > 0).select("doc_id", F.posexplode(pieces).alias("pos", "piece"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("piece").alias("digest"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc_ord"), "source", "text")
    return chunking.build_chunks(_spread(docs), SETTINGS.max_tokens, SETTINGS.overlap)


def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_id", F.col("doc_ord").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.md5("text").alias("digest"), "n_tokens")


def sql_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of all documents from SQL text with a table function."""
    register(spark)
    docs = _spread(table(spark, sf, "documents").select("doc_id", "text"))
    text = "SELECT doc_id, CAST(c.pos AS BIGINT) AS pos, md5(c.text) AS digest, text_tokens(c.text) AS n_tokens FROM {docs} d, LATERAL chunk_text(d.text, {most}, {overlap}) c"
    return spark.sql(text, docs=docs, most=SETTINGS.max_tokens, overlap=SETTINGS.overlap)


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = _spread(table(spark, sf, "documents").select("source", "text"))
    pieces = docs.select("source", F.explode(chunking.chunk_text(F.col("text"), SETTINGS.max_tokens, SETTINGS.overlap)).alias("text"))
    n = T.count_tokens(F.col("text"))
    return pieces.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(n).alias("n_tokens"), F.max(n).alias("largest"))


def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _docs(spark, sf).select("chunk_id", T.tokenize(F.col("text")).alias("tokens"))
    return bm25.of_counts(stash(bm25.counts(tokens), "counts")).terms.select("term", "df", F.round("idf", 4).alias("idf"))


def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(_index(spark, sf).lexical, _queries(spark, sf), SETTINGS.top_k_bm25)


def embed_hashed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("chunk_id", hashed_embedding(T.tokenize(F.col("text"))).alias("v"))
    rows = rows.select(F.col("chunk_id").alias("doc_id"), F.posexplode("v").alias("bucket", "weight")).filter("weight <> 0")
    return rows.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    return dense.search(_stored(spark, sf).vectors, _queries(spark, sf), SETTINGS.top_k_vector)


def label_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "y")).groupBy("label", "i").agg(F.avg(F.col("y").cast("double")).alias("y"))
    centres = means.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("p"))
    centres = centres.select("query_id", F.transform("p", lambda x: x["y"]).alias("embedding"))
    return dense.search(rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), centres, SETTINGS.top_k_vector)


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    index, queries = _stored(spark, sf), _queries(spark, sf)
    near = dense.search(index.vectors, queries, SETTINGS.top_k_vector)
    return fusion.rrf(near, bm25.search(index.lexical, queries, SETTINGS.top_k_bm25), SETTINGS.rrf_k)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("query_id", "chunk_id", "fused_rank", "score", "vector_score", "bm25_score")


def candidate_cut(spark: SparkSession, sf: str) -> DataFrame:
    kept = fusion.candidates(_stored(spark, sf), _queries(spark, sf), SETTINGS)
    return kept.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))


def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("query_id", "rank", "chunk_id", "source", "score", "vector_score", "bm25_score")


def cosine_rerank(spark: SparkSession, sf: str) -> DataFrame:
    hits = fusion.retrieve(_stored(spark, sf), _queries(spark, sf), SETTINGS, reranker=Reranker())
    return hits.select("query_id", "rank", "chunk_id", "score")


def multi_query_merge(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).withColumns({"group_id": F.col("query_id") % 10, "seen": F.col("query_id") * 1_000_000 + F.col("rank")})
    merged = fusion.merge_hits(hits, "group_id", SETTINGS.top_k_final)
    return merged.select("group_id", "rank", "chunk_id", "source", "score", "vector_score")


def context_block(spark: SparkSession, sf: str) -> DataFrame:
    ranked = F.collect_list(F.struct((F.col("rank") + 1).alias("rank"), "source", "text"))
    hits = _hits(spark, sf).groupBy("query_id").agg(ranked.alias("r"))
    return hits.select("query_id", F.md5(T.context_block(F.col("r"), 1200)).alias("digest"))


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("h"))
    got = hits.select("query_id", F.transform("h", lambda x: x["source"]).alias("retrieved"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, sf, "documents").filter(F.col("source").isNotNull())
    holds = containing(_spread(docs.select(F.col("doc_id").alias("text_id"), "text")), asked.withColumnRenamed("query_id", "passage_id"))
    named = holds.join(docs.select(F.col("doc_id").alias("text_id"), "source"), "text_id")
    relevant = named.groupBy(F.col("passage_id").alias("query_id")).agg(F.collect_set("source").alias("relevant"))
    got = asked.select("query_id").join(got, "query_id", "left").join(relevant, "query_id", "left")
    none = F.array().cast("array<string>")
    got = got.withColumns({"retrieved": F.coalesce("retrieved", none), "relevant": F.coalesce("relevant", none)})
    return metrics.retrieval_metrics(got, (1, 3, 5, SETTINGS.top_k_final)).drop("relevant", "retrieved")


def eval_means(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.report(_evaluated(spark, sf))


def index_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """All documents saved as an index, opened again, and what its manifest and its statistics say."""
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index_store.save(_index(spark, sf), _docs(spark, sf), folder, SETTINGS)
    opened = index_store.load(spark, folder, settings=SETTINGS)
    kept = index_store.versions(spark, folder).select("version", "chunk_count", "vector_count", "source_count", F.col("embed_dim").cast("long").alias("embed_dim"))
    counted = opened.lexical.terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return kept.join(F.broadcast(counted))  # one row each


def agent_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The agent over all questions of ``benchmark``; conversation n's turns make the replies to question n."""
    said = table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").cast("long").alias("call"), F.coalesce("text", F.lit("")).alias("t"))
    more = F.filter(F.array(F.substring("t", 61, 60)), lambda x: x != "")
    plan = F.to_json(F.struct(F.substring("t", 1, 60).alias("search_query"), more.alias("sub_queries")))
    n = F.length("t")
    ask = F.when(n % 7 == 3, "").otherwise(F.substring("t", 1, 50)).alias("next_query")
    judge = F.to_json(F.struct((n % 5 == 0).alias("sufficient"), ((n % 100) / 100).alias("confidence"), F.lit("more").alias("gap"), ask))
    replies = said.select("question_id", "call", F.when(F.col("call") == 0, plan).otherwise(judge).alias("reply"))
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    found = rounds.run(_stored(spark, sf), questions, rounds.scripted(replies), SETTINGS)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"].cast("string"))
    hits = found.hits.groupBy("question_id").agg(F.array_join(ids, ",").alias("chunks"))
    kept = found.stats.select("question_id", "iterations", "llm_calls", "retrieved_total", "note")
    return kept.join(hits, "question_id", "left")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("turn") % 5
    tail = F.when(k == 0, " [1][2].").when(k == 1, " [9].").when(k == 2, "").when(k == 3, " [3] and [0], [12] ").otherwise(" [１].")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), tail).alias("answer"))


def citation_validate(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf).withColumn("c", grounding.validate_citations(F.col("answer"), F.lit(6)))
    return rows.select(
        "conv_id", "turn", F.array_join(F.col("c.citations").cast("array<string>"), ",").alias("citations"),
        F.array_join(F.col("c.invalid").cast("array<string>"), ",").alias("invalid"), "c.valid", "c.has_citation",
    )


def citation_abstain(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("conv_id", "turn", grounding.needs_abstain(F.col("answer"), F.lit(6)).alias("abstain"))


def citation_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("conv_id", "turn", grounding.safe_answer(F.col("answer"), F.lit(6)).alias("answer"))


def unsupported_numbers(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    found = numbers.unsupported(answers, table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), "text"))
    return found.select(F.col("id").alias("doc_id"), "n_numbers", F.array_join("unsupported", ",").alias("unsupported"))


def parse_json_verdict(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json(T.json_object(F.col("props")), "struct<k:double>")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), T.clamp01(k / 100).alias("confidence"))


def nearest_caption(spark: SparkSession, sf: str) -> DataFrame:
    rows = [
        ("a.pdf", 1, 0, 1, [10.0, 10.0, 100.0, 80.0], ""), ("a.pdf", 1, 1, 0, [10.0, 85.0, 100.0, 95.0], "图1 光路"),
        ("a.pdf", 1, 2, 0, [10.0, 200.0, 100.0, 210.0], "Table 2 sizes"), ("a.pdf", 2, 0, 1, [0.0, 50.26, 10.0, 60.0], ""),
        ("a.pdf", 2, 1, 0, [0.0, 45.0, 10.0, 50.26], "公式（3）"), ("a.pdf", 2, 2, 0, [0.0, 60.0, 10.0, 70.0], "Figure 4 same gap"),
        ("b.pdf", 1, 0, 0, [0.0, 0.0, 1.0, 1.0], "plain text"), ("b.pdf", 1, 1, 1, [0.0, 5.0, 1.0, 9.0], ""),
    ]
    blocks = spark.createDataFrame(rows, "path string, page int, pos int, type int, bbox array<double>, text string")
    lines = F.array(F.struct(F.array(F.struct("text")).alias("spans")))
    return figures.nearest_captions(blocks.withColumn("lines", lines)).select("path", "page", "index", "caption", "kind")


def source_counter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct("lang").alias("n_langs"))


def dedup_sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def clamp_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.clamp01(F.col("value") / 100).alias("score"))


def sparse_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count_if(T.is_sparse(F.col("text"))).alias("n_sparse"))


def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.cache_key(F.lit("embed"), F.col("doc_id"), F.col("lang")).alias("key"))


QUERIES = {
    "token_count": token_count,
    "tokenize_terms": tokenize_terms,
    "cjk_bigrams": cjk_bigrams,
    "hard_split_chunks": hard_split_chunks,
    "recursive_chunks": recursive_chunks,
    "sql_chunks": sql_chunks,
    "chunk_stats": chunk_stats,
    "bm25_term_stats": bm25_term_stats,
    "bm25_search": bm25_search,
    "hashed_embedding": embed_hashed,
    "vector_search": vector_search,
    "label_neighbours": label_neighbours,
    "rrf_fusion": rrf_fusion,
    "candidate_cut": candidate_cut,
    "hybrid_retrieve": hybrid_retrieve,
    "cosine_rerank": cosine_rerank,
    "multi_query_merge": multi_query_merge,
    "context_block": context_block,
    "recall_mrr_hit": _evaluated,
    "eval_means": eval_means,
    "index_snapshot": index_snapshot,
    "agent_rounds": agent_rounds,
    "citation_validate": citation_validate,
    "citation_abstain": citation_abstain,
    "citation_answer": citation_answer,
    "unsupported_numbers": unsupported_numbers,
    "parse_json_verdict": parse_json_verdict,
    "nearest_caption": nearest_caption,
    "source_counter": source_counter,
    "dedup_sources": dedup_sources,
    "clamp_scores": clamp_scores,
    "sparse_texts": sparse_texts,
    "cache_keys": cache_keys,
}
