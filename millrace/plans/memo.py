"""A stored memo of model results: what has been computed once is looked up by a join."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shared import stash


class Memo:
    """Values by key in a table at ``path``, bucketed and sorted by key, one folder per batch.

    A batch appears whole or not at all; batches of a run that was killed stay, and
    the next run computes only what is missing. Null is never stored and never a hit.
    ``kind`` is the type of the values; the number of buckets is stored beside them.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        n, known = self._buckets(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.buckets, self.name = n, "memo_" + hashlib.md5(self.path.encode()).hexdigest()
        place = f"{self.path}/rows".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (key STRING, value {kind}, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (key) SORTED BY (key) INTO {n} BUCKETS LOCATION '{place}'"
        )
        if known:
            spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _buckets(self, wanted: int) -> tuple[int, bool]:
        """The stored number of buckets, and whether there was one; a spec without rows is of a run that died and is written again."""
        try:
            found = self.spark.read.schema("buckets int").json(f"{self.path}/spec").first()
        except AnalysisException:
            found = None
        if found is not None:
            return found["buckets"], True
        self.spark.range(1).select(F.lit(wanted).alias("buckets")).write.mode("overwrite").json(f"{self.path}/spec")
        return wanted, False

    def known(self) -> DataFrame:
        """key, value; one row per key, also where two runs stored the same."""
        return self.spark.table(self.name).filter(F.col("value").isNotNull()).select("key", "value").dropDuplicates(["key"])

    def store(self, values: DataFrame) -> None:
        """Append values (key, value) as one batch."""
        view, batch = f"values_{uuid.uuid4().hex}", uuid.uuid4().hex
        values.filter("value IS NOT NULL").select("key", "value").repartition(self.buckets, "key").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)
        self.spark.catalog.refreshTable(self.name)

    def filled(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], part_rows: int = 100_000) -> DataFrame:
        """key, value of all keys in ``rows`` that have one, after ``compute`` (rows to key, value) was called for those missing.

        Each missing key is computed once, in parts of about ``part_rows`` keys; a part is
        stored before the next begins, so a run that dies loses one part.
        """
        once = rows.dropDuplicates(["key"])
        missing = stash(once.join(self.known(), "key", "left_anti"), "missing")
        parts = math.ceil(missing.count() / part_rows)
        for part in range(parts):
            # written before nulls are filtered, or a function in Python would be called for the filter as well
            self.store(stash(compute(missing.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)).select("key", "value"), "values"))
        return once.select("key").join(self.known(), "key")
