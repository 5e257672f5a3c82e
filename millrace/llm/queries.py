"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, digestindex, licenses, linetemplates, minhash, mix, rabitq, resample, setjoin, suffixdedup, tokencount, toxicity, whitening
from millrace.registry import table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mix.quality_weights(table(spark, sf_dir, "labels"))
    return mix.mix(table(spark, sf_dir, "documents"), weights)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linetemplates.drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return found.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digestindex.dedup(table(spark, sf_dir, "documents"), digestindex.new_index(spark))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digest=True)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = rabitq.build(table(spark, sf_dir, "embeddings"))
    return rabitq.search(index, F.col("vec_id") % 100 == 0, spark)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.ToxicityParams().threshold).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_sets(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_token_counts": op2_token_counts,
    "op3_line_templates": op3_line_templates,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_vector_neighbours": op9_vector_neighbours,
    "op10_toxicity": op10_toxicity,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_resample": op12_resample,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mix": mix.MIX_SQL,
    "op3_line_templates": linetemplates.TEMPLATES_SQL,
    "op4_exact_dedup": digestindex.DEDUP_SQL,
    "op7_suffix_dedup": suffixdedup.REPEATS_SQL,
    "op8_near_duplicates": minhash.NEAR_SQL,
    "op9_vector_neighbours": rabitq.NEAREST_SQL,
    "op11_jaccard_join": setjoin.JOIN_SQL,
    "op12_resample": resample.RESAMPLE_SQL,
}
