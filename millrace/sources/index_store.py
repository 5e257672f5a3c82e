"""Indexes as folders of snapshots.

    folder/snapshots/<name>/{chunks,vectors,counts,terms,stats}
    folder/manifests/<version>/      one JSON line

A snapshot is written under a new name, read back and checked; then its manifest
appears, a single file that a job's commit moves into place. Readers take the
largest version that has a manifest, so a write that is killed leaves the index
as it was, and a reader keeps the snapshot it opened. A writer that finds its version
taken, by another or by one that died, takes the next. Should two pass that check in
the same moment, both lines stand under one version and every reader takes the same
one. Snapshots are never changed; ``expire`` deletes old ones.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.operators.bm25 import Bm25Index, of_postings
from millrace.operators.chunking import build_chunks
from millrace.operators.dense import DimensionError
from millrace.operators.fusion import Embed, HybridIndex, index_chunks
from millrace.sources.documents import load_documents

FORMAT = 3
LEXICAL = ("counts", "terms", "stats")
FORMER = ("postings", "terms", "doclen", "stats")  # of formats before 3
PARTS = ("chunks", "vectors", *LEXICAL)
MANIFEST = (
    "version long, snapshot string, format int, created_at string, embed_provider string, embed_model string, embed_dim int, metric string, "
    "index_type string, tokenizer string, chunk_count long, vector_count long, source_count long, bytes map<string,long>"
)


class NoIndexError(ValueError):
    """The folder has no index, or no such version of one."""


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """All manifests of an index; no rows where there is none."""
    try:
        return spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{folder}/manifests/*").filter(F.col("version").isNotNull())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> Row:
    """The newest manifest, or that of a version."""
    found = versions(spark, folder)
    found = found if version is None else found.filter(F.col("version") == version)
    row = found.orderBy(F.desc("version"), "snapshot").first()
    if row is None:
        raise NoIndexError(f"no index in {folder}" if version is None else f"no version {version} in {folder}")
    return row


def save(index: HybridIndex, chunks: DataFrame, folder: str, settings: Settings | None = None) -> dict:
    """Write an index as the next version. ``chunks``: all columns to keep. Without chunks, or with chunks that have no vector of
    the index's dimension, it is an error, and the version before stays the newest."""
    name = uuid.uuid4().hex
    chunks.write.parquet(f"{folder}/snapshots/{name}/chunks")
    return _publish(index, chunks.sparkSession, folder, name, settings or Settings())


def _publish(index: HybridIndex, spark: SparkSession, folder: str, name: str, s: Settings) -> dict:
    """The other parts and the manifest of a snapshot whose chunks are written."""
    place = f"{folder}/snapshots/{name}"
    kept = spark.read.parquet(f"{place}/chunks")
    n = kept.count()
    if not n:
        raise ValueError("no chunks to index")
    index.vectors.write.parquet(f"{place}/vectors")
    for part in LEXICAL:
        getattr(index.lexical, part).write.parquet(f"{place}/{part}")
    size = F.size("embedding")
    found = spark.read.parquet(f"{place}/vectors").agg(F.count("*").alias("n"), F.count_if(F.coalesce(size != index.dim, F.lit(True))).alias("odd")).first()
    if found["odd"]:
        raise DimensionError(f"{found['odd']} vectors don't have {index.dim} dimensions")
    if found["n"] != n:
        raise ValueError(f"{n} chunks, but {found['n']} vectors")
    files = [spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{place}/{part}").select(F.lit(part).alias("part"), "length") for part in PARTS]
    total = files[0]
    for more in files[1:]:
        total = total.unionByName(more)
    sizes = {r["part"]: r["bytes"] for r in total.groupBy("part").agg(F.sum("length").alias("bytes")).collect()}
    version = (versions(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    row = spark.range(1).select(
        F.lit(name).alias("snapshot"), F.lit(FORMAT).alias("format"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.lit(s.embed_provider).alias("embed_provider"), F.lit(s.embed_model).alias("embed_model"), F.lit(index.dim).alias("embed_dim"),
        F.lit("ip").alias("metric"), F.lit("flat").alias("index_type"), F.lit("latin+cjk-bigram").alias("tokenizer"),
        F.lit(n).alias("chunk_count"), F.lit(found["n"]).alias("vector_count"),
        F.lit(kept.select("source").distinct().count()).alias("source_count"),
        F.create_map(*[x for part in PARTS for x in (F.lit(part), F.lit(sizes.get(part, 0)).cast("long"))]).alias("bytes"),
    )
    while not _claimed(row.withColumn("version", F.lit(version).cast("long")), f"{folder}/manifests/{version:08d}"):
        version += 1
    return {"n_chunks": n, "dim": index.dim, "index_dir": folder, "version": version}


def _claimed(row: DataFrame, place: str) -> bool:
    """Whether the line was written; False where the place is taken."""
    try:
        row.coalesce(1).write.mode("error").json(place)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        return False
    return True


def drift(meta: Row, settings: Settings) -> list[str]:
    """What speaks against asking an index with these settings."""
    made = f"made with {meta['embed_provider']} ({meta['embed_model']}, {meta['embed_dim']} dimensions)"
    if settings.embed_provider != meta["embed_provider"]:
        return [f"index {made}, but the provider is now {settings.embed_provider}; index the documents again"]
    if settings.embed_dim != meta["embed_dim"]:
        return [f"index {made}, but vectors now have {settings.embed_dim} dimensions; index the documents again"]
    if settings.embed_model != meta["embed_model"]:
        return [f"index {made}, but the model is now {settings.embed_model}"]
    return []


def load(spark: SparkSession, folder: str, embed: Embed | None = None, settings: Settings | None = None, version: int | None = None) -> HybridIndex:
    """Open the newest version or another one. ``embed`` is what it was made with.

    Vectors of another length than the manifest says are an error; with ``settings``,
    drift is warned about. A folder that holds the parts themselves, without a manifest, is taken as it is; postings of
    former formats are gathered by chunk.
    """
    try:
        meta = manifest(spark, folder, version)
        place, dim = f"{folder}/snapshots/{meta['snapshot']}", meta["embed_dim"]
    except NoIndexError:
        if version is not None:
            raise
        meta, place, dim = None, folder, None
    try:
        parts = LEXICAL if meta is not None and meta["format"] >= 3 else FORMER
        read = {name: spark.read.parquet(f"{place}/{name}") for name in ("chunks", "vectors", *parts)}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise NoIndexError(f"no index in {folder}") from e
    one = read["vectors"].select(F.size("embedding").alias("n")).first()  # all were counted before the manifest was written
    if dim is None:
        dim = one["n"] if one else 0
    if one is not None and one["n"] != dim:
        raise DimensionError(f"the manifest says {dim} dimensions, vectors have {one['n']}")
    if meta is not None and settings is not None:
        for said in drift(meta, settings):
            warnings.warn(said, stacklevel=2)
    lexical = (Bm25Index if parts == LEXICAL else of_postings)(*(read[p] for p in parts))
    return HybridIndex(read["chunks"].select("chunk_id", "source", "text"), read["vectors"], lexical, dim, embed)


def inspect(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """source, chunks of an index, largest first."""
    place = f"{folder}/snapshots/{manifest(spark, folder, version)['snapshot']}"
    return spark.read.parquet(f"{place}/chunks").groupBy("source").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "source")


def figures(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """part, bytes, share of all parts, with the index's counts beside them; from the manifest alone."""
    meta = manifest(spark, folder, version)
    rows = versions(spark, folder).filter(F.col("version") == meta["version"])
    rows = rows.select("version", "chunk_count", "vector_count", "source_count", "embed_dim", F.aggregate(F.map_values("bytes"), F.lit(0).cast("long"), lambda a, x: a + x).alias("all"), F.explode("bytes").alias("part", "bytes"))
    return rows.withColumn("share", F.round(F.col("bytes") / F.col("all"), 4)).drop("all")


def expire(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions, a manifest before its snapshot; the versions deleted. Snapshots without a
    manifest stay, as another writer may be at work on them."""
    if keep < 1:
        raise ValueError("keep at least one version")
    old = versions(spark, folder).orderBy(F.desc("version")).select("version", "snapshot").offset(keep).collect()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in old:
        for place in (f"{folder}/manifests/{row['version']:08d}", f"{folder}/snapshots/{row['snapshot']}"):
            path = hadoop(place)
            path.getFileSystem(conf).delete(path, True)
    return [row["version"] for row in old]


def ingest(spark: SparkSession, docs_dir: str, index_dir: str, settings: Settings | None = None, embed: Embed | None = None) -> dict:
    """Files to the next version of an index."""
    s, name = settings or Settings(), uuid.uuid4().hex
    docs = load_documents(spark, docs_dir)
    if docs.isEmpty():
        raise RuntimeError(f"no documents in {docs_dir}")
    place = f"{index_dir}/snapshots/{name}/chunks"
    build_chunks(docs, s.max_tokens, s.overlap).write.parquet(place)
    return _publish(index_chunks(spark.read.parquet(place), s.embed_dim, embed), spark, index_dir, name, s)
