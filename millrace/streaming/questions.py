"""Questions that arrive as a stream are retrieved micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.config import Settings
from millrace.operators.fusion import HybridIndex, embed_queries, retrieve


def answer_stream(spark: SparkSession, questions_dir: str, index: HybridIndex, out_dir: str, checkpoint_dir: str, settings: Settings | None = None):
    """Start a query that reads JSON questions (query_id, text) and appends their hits to Parquet, one folder per batch.

    A batch that is run again after a failure replaces its folder, so hits appear once.
    """
    questions = spark.readStream.schema("query_id long, text string").json(questions_dir)

    def write(batch: DataFrame, number: int) -> None:
        hits = retrieve(index, embed_queries(batch, index.dim, index.embed), settings)
        hits.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
