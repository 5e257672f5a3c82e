"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of a
text, one row per distinct text ever admitted: ``digest, keep_id, group_size``.
New rows are first collapsed to one row per digest (map-side combine, so a
group of copies of any size costs one row per task), then a sort-merge
anti-join against the buckets finds the digests not yet known, and those are
appended. The table lies at a path and can be opened again by later sessions;
its number of buckets is stored beside it.

A call may name its batch. Rows are kept by batch, a batch is judged against
the rows of all others, and appending it again replaces what it had appended:
after a failure the same batch can be run again and gets the same verdicts.

Copies are told their keeper by a join on the digest; the few groups that hold
a large share of all rows take a bounded broadcast (``common.tell``), all other
groups the sort-merge join.

Defined cases: null text counts as empty; of equal texts the largest doc_id
stays (a null doc_id only where there is no other); a text already in the index
keeps the index's row and the whole new group goes; rows repeated under one
doc_id with one text share the verdict, and ``kept_rows`` returns one of them;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh_path, n_parts, settled, sized, stash, tell, text_or_empty, whole


class DigestIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Open the index at ``path``, or make an empty one there (of ``buckets`` buckets)."""
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, known = self._stored(buckets or n_parts(spark))
        if buckets and buckets != self.buckets:
            raise ValueError(f"the index has {self.buckets} buckets, not {buckets}")
        self.name = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        place = f"{self.path}/rows".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        if known:
            spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _stored(self, buckets: int) -> tuple[int, bool]:
        """The index's number of buckets, stored now if it is new, and whether it was there."""
        try:
            return self.spark.read.schema("buckets int").json(f"{self.path}/spec").first()["buckets"], True
        except AnalysisException:
            self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.json(f"{self.path}/spec")
            return buckets, False

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def before(self, batch: str) -> DataFrame:
        """The rows of all other batches."""
        return self.table().filter(F.col("batch") != batch)

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Append ``fresh`` (digest, keep_id, group_size), in place of what the batch had."""
        view = f"fresh_{uuid.uuid4().hex}"
        fresh.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)
        self.spark.catalog.refreshTable(self.name)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest of every row."""
    return docs.select("doc_id", F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("digest"))


def dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for every row; appends new digests to ``index`` as ``batch``.

    ``group_size`` counts the rows of this call with that text. Without a name
    the batch is a new one each time.
    """
    batch = "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in batch) if batch else uuid.uuid4().hex
    rows = stash(digests(docs), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    known = index.before(batch).select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
    met = groups.join(known.hint("merge"), "digest", "left").select(
        "digest", F.when(F.col("known"), F.col("known_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size", F.col("known").isNull().alias("new"),
    )
    verdicts = stash(met, "verdicts")
    index.append(verdicts.filter("new"), batch)
    found = tell(rows, verdicts, ["digest"], "group_size", rows.count())
    return found.select(
        "doc_id", "digest", "keep_id", "group_size", (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")
    )


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, fresh_path(spark, "digests"))


def kept_rows(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    with sized(docs.sparkSession, docs.count()):
        return settled(_kept_rows(docs, index, batch))


def _kept_rows(docs: DataFrame, index: DigestIndex, batch: str | None) -> DataFrame:
    key = ["digest", "id", "nameless"]
    stay = dedup(docs, index, batch).filter("kept")
    stay = stay.select("digest", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("nameless")).distinct()
    keyed = docs.select(
        whole(docs).alias("row"), F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("digest"),
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("nameless"),
    )
    # repeated rows of one document meet in the join's partition, so one is chosen without another shuffle
    return keyed.join(stay, key, "left_semi").dropDuplicates(key).select("row.*")


DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
