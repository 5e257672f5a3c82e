"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local folder serves a session on one machine; on a cluster it is an error.
    """
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there is None:
        there = spark.conf.get("spark.checkpoint.dir", None)
        if there is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="millrace-"))
        there = sc.getCheckpointDir()
    return there.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stash(df: DataFrame, what: str = "stash") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of lineage that stays small."""
    path = fresh_path(df.sparkSession, what)
    if not _few.get():
        df.write.parquet(path)
    else:
        held = df.persist(StorageLevel.DISK_ONLY)
        try:
            files = max(df.sparkSession.sparkContext.defaultParallelism, -(-held.count() // FEW))
            held.coalesce(files).write.parquet(path)
        finally:
            held.unpersist()
    return df.sparkSession.read.schema(df.schema).parquet(path)


FEW = 2048
_few: ContextVar[bool] = ContextVar("few", default=False)


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it ``stash`` knows that its tables have about so many rows.

    Where that is less than FEW for a shuffle partition, a table is still computed in all
    partitions, but written in files of about FEW rows: each file costs a task and, on
    a local file system, half a dozen child processes of the executor.
    """
    before = _few.set(rows < FEW * n_parts(spark))
    try:
        yield
    finally:
        _few.reset(before)


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself, stashed where it has few rows (``sized``)."""
    return stash(df, "settled") if _few.get() else df


HOT = 1024


def tell(rows: DataFrame, table: DataFrame, key: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with one row per key in ``table`` (``how``: inner or left), safe against hot keys.

    ``table[size]`` is at least the number of ``rows`` with the key, and they add up to
    about ``total``. Keys that hold more than 1/HOT of them are at most HOT: a bounded
    broadcast.
    """
    is_hot = F.col(size) * HOT > total
    met = rows.join(F.broadcast(table.filter(is_hot)), key, "left")
    cold = met.filter(F.col(size).isNull()).select(*rows.columns)
    warm = met.filter(F.col(size).isNotNull())
    return warm.unionByName(cold.join(table.filter(~is_hot).hint("merge"), key, how))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 0 in ``order``; one row per order, sorted in ranges and never in one task.

    Only the ranges' counts (one row per partition) meet in one place.
    """
    ranges = n_parts(rows.sparkSession)
    dealt = stash(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(name, inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_offset")


def whole(docs: DataFrame) -> Column:
    """A row's columns as one struct, so that helper columns can't clash with any of them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
