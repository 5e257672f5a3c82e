"""A corpus pipeline of five stages, each one operator of ``millrace.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``run`` writes every result as Parquet in the shared folder and reads it
again for the next stage. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, digestindex, minhash, mix, toxicity
from millrace.llm.common import stash, whole
from millrace.registry import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the threshold or above go.

    Null and empty texts have the model's bias as score; repeated rows, ties and null doc_ids are judged by their text alone.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(whole(docs).alias("row"), "text"), model)
    return scored.filter(F.col("score") < toxicity.ToxicityParams().threshold).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null counts as empty text; a null doc_id stays only where there is no other; of repeated rows one stays.
    """
    return digestindex.kept_rows(docs, digestindex.new_index(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by shingles of five words, the row with the smallest doc_id stays.

    Texts without words are linked with nothing and stay; null doc_ids come last; rows of one doc_id with unlike texts are
    documents of their own, and of repeated rows one stays.
    """
    return minhash.kept_rows(docs, minhash.NearParams(words=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes from stay; those it takes beyond one whole pass come twice.

    Texts without words have size 0, are never taken and go; a null source is one of its own; repeated rows and null doc_ids are
    mixed row by row.
    """
    return mix.copies(docs, mix.quality_weights(table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of ids and of the decoded bytes; null counts as empty, every row has its own."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The classifier and the encoder can't be expressed in SQL.
ORACLE_SQL = None
