"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local folder serves a session on one machine, and a cluster gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir().rstrip("/")


def stash(rows: DataFrame, what: str = "stash") -> DataFrame:
    """``rows`` written as Parquet and read back: computed once, and safe from lost executors."""
    path = f"{shared_dir(rows.sparkSession)}/{what}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def placed(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """``rows`` with their place from 0 in ``order``, sorted in ranges; only the ranges' counts meet in one task."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(rows.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn(name, inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_offset")
