"""Queries over the standard tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster it is shipped with --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def core_queries() -> dict[str, Query]:
    from millrace.registry_core import QUERIES

    return dict(QUERIES)


def core_sql() -> dict[str, str]:
    from millrace.registry_sql import SQL

    return dict(SQL)
