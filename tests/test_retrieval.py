from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.functions.text import tokenize
from millrace.operators import bm25, dense, fusion
from millrace.operators.rerank import Reranker
from millrace.sources import index_store

CORPUS = [
    (0, "a.md", "混合检索提升召回率，结合向量与关键词"),
    (1, "b.md", "光学设计软件 CODE V 与 MicroLED 检测"),
    (2, "c.md", "苹果 香蕉 水果 店"),
    (3, "d.md", "hybrid retrieval fuses dense vectors and keywords"),
    (4, "e.md", "keywords keywords keywords"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CORPUS, "chunk_id long, source string, text string").cache()


@pytest.fixture(scope="module")
def index(chunks):
    return fusion.index_chunks(chunks)


def asked(spark, *texts):
    return fusion.embed_queries(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))


def plain_bm25(docs: list[list[str]], query: list[str]) -> list[float]:
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else floor for t, x in raw.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in query))
    return out


def test_bm25_scores(spark, chunks, index):
    tokens = {r["chunk_id"]: r["t"] for r in chunks.select("chunk_id", tokenize(F.col("text")).alias("t")).collect()}
    for text in ("混合检索方法", "keywords keywords vectors", "nothing known", "!!"):
        query = asked(spark, text)
        want = plain_bm25([tokens[i] for i in range(5)], query.first()["tokens"])
        got = {r["chunk_id"]: r["score"] for r in bm25.search(index.lexical, query, 20).collect()}
        assert got == {i: pytest.approx(round(s, 4), abs=1e-4) for i, s in enumerate(want) if round(s, 4) > 0}
    top = bm25.search(index.lexical, asked(spark, "混合检索方法"), 20).filter("rank = 0").first()
    assert top["chunk_id"] == 0 and top["score"] > 0


def test_bm25_search_of_many_blocks(spark, monkeypatch):
    """Against brute force: many queries and blocks, copies that tie, terms that repeat, a null and an empty array of tokens."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(300)])
    docs = [list(words[np.minimum(rng.zipf(1.4, rng.integers(1, 60)) - 1, 299)]) for _ in range(400)]
    docs += [docs[i % 7] for i in range(40)] + [[], []]
    asked = [list(words[rng.integers(0, 300, 12)]) for _ in range(25)] + [["w3"] * 4 + ["w290"], ["none"], []]
    rows = [(i, d) for i, d in enumerate(docs)]
    rows[-1] = (len(docs) - 1, None)
    index = bm25.build(spark.createDataFrame(rows, "chunk_id long, tokens array<string>"))
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, tokens array<string>")
    want = {}
    for q, tokens in enumerate(asked):
        scores = [(-round(s, 4), i) for i, s in enumerate(plain_bm25(docs, tokens)) if round(s, 4) > 0]
        want |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(sorted(scores)[:5])}
    for block in (8192, 7):
        got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in bm25.search(index, queries, 5, block).collect()}
        assert {x: i for x, (i, _) in got.items()} == {x: i for x, (i, _) in want.items()}
        assert all(got[x][1] == pytest.approx(want[x][1], abs=1e-4) for x in want)


def test_bm25_skips_blocks(monkeypatch):
    """Blocks of chunks that only share weak terms with a query aren't scored once k good ones are known; the result is the same."""
    terms = pa.array([["rare", "common"]] * 3 + [["common"]] * 997)
    tfs, scale, chunk = pa.array([[2, 1]] * 3 + [[1]] * 997), np.full(1000, 1.5), np.arange(1000)
    found = []
    for rows in (10, 1000):
        monkeypatch.setattr(bm25, "ROWS", rows)
        cell = bm25.Cell(np.array([7, 8]), np.array([0, 0, 1]), pa.array(["rare", "common", "common"]), np.array([5.0, 0.1, 1.0]), 3)
        cell.add(chunk, terms, tfs, scale)
        found.append((cell.found().to_pydict(), cell.met))
    assert found[0][0] == found[1][0] and found[0][0]["chunk_id"] == [0, 1, 2, 0, 1, 2]
    assert found[0][1] == 10 + 3 + 1000 and found[1][1] == 2003  # query 8 meets equal scores everywhere, which can't be ruled out


def test_count_terms(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, ["x"])], "chunk_id long, tokens array<string>")
    got = {r["chunk_id"]: (r["dl"], r["terms"], r["tfs"]) for r in bm25.counts(rows).collect()}
    assert got == {1: (4, ["a", "b"], [1, 3]), 2: (0, [], []), 3: (0, [], []), 4: (1, ["x"], [1])}


def test_indexes_of_former_formats_open(spark, index, chunks, tmp_path):
    folder = str(tmp_path / "index")
    lexical = index.lexical
    parts = {"chunks": chunks, "vectors": index.vectors, "postings": lexical.postings, "terms": lexical.terms, "stats": lexical.stats}
    for name, rows in (parts | {"doclen": lexical.counts.select("chunk_id", "dl")}).items():
        rows.write.parquet(f"{folder}/{name}")
    old = index_store.load(spark, folder)
    assert sorted(old.lexical.counts.collect()) == sorted(lexical.counts.collect())
    queries = asked(spark, "keywords")
    assert bm25.search(old.lexical, queries).collect() == bm25.search(lexical, queries).collect()


def test_dense_search_is_exact(spark):
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((300, 16)), rng.standard_normal((7, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    sims = np.round((x / np.linalg.norm(x, axis=1)[:, None]) @ (q / np.linalg.norm(q, axis=1)[:, None]).T, 6)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in dense.search(vectors, queries, 5).collect()}
    assert got == {(j, k): int(i) for j in range(7) for k, i in enumerate(np.lexsort((np.arange(300), -sims[:, j]))[:5])}
    assert dense.search(vectors.limit(3), queries, 5).count() == 21
    with pytest.raises(Exception, match="dimensions"):
        dense.search(vectors, queries.withColumn("embedding", F.slice("embedding", 1, 8)), 5).collect()


def test_rrf(spark):
    kind = "query_id long, rank long, chunk_id long, score double"
    a = spark.createDataFrame([(0, 0, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 5, -0.1)], kind)
    b = spark.createDataFrame([(0, 0, 1, 7.0), (0, 1, 3, 6.0)], kind)
    got = fusion.rrf(a, b).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 2, 3, 5]
    assert got[0]["score"] == 2 / 61
    assert (got[3]["vector_score"], got[3]["bm25_score"]) == (-0.1, 0.0)
    assert fusion.rrf(a.limit(0), b.limit(0)).count() == 0


def test_retrieve_and_rerank(spark, index):
    queries = asked(spark, "hybrid retrieval keywords", "苹果")
    hits = fusion.retrieve(index, queries, Settings(), 2).collect()
    assert {(r["query_id"], r["rank"]) for r in hits} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert {r["chunk_id"] for r in hits if r["query_id"] == 0} == {3, 4}
    by_fruit = Reranker(scorer=lambda q, d: 1.0 if "苹果" in d else 0.0)
    top = fusion.retrieve(index, queries, Settings(), 3, by_fruit).filter("rank = 0").collect()
    assert {(r["chunk_id"], r["score"]) for r in top} == {(2, 1.0)}
    plain = fusion.retrieve(index, queries, Settings(), 3).select("query_id", "rank", "chunk_id", "score").collect()

    def broken(queries, docs):
        raise OSError("no service")

    failed = fusion.retrieve(index, queries, Settings(), 3, Reranker(provider=broken)).select("query_id", "rank", "chunk_id", "score").collect()
    assert sorted(failed) == sorted(plain)
    missing = fusion.retrieve(index, queries, Settings(), 3, Reranker(backend="cross-encoder", model="none")).count()
    assert missing == 6


def test_merge_keeps_first_sight_and_largest_score(spark):
    rows = [(0, 1, "a", "t", 0.5, 0.1, 0.0, 0), (0, 1, "b", "t", 0.9, 0.2, 0.0, 3), (0, 2, "c", "t", 0.9, 0.3, 0.0, 1), (0, 3, "d", "t", 0.1, 0.0, 0.0, 2)]
    kind = "group_id long, chunk_id long, source string, text string, score double, vector_score double, bm25_score double, seen long"
    got = fusion.merge_hits(spark.createDataFrame(rows, kind), top_k=2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["source"], r["score"]) for r in got] == [(1, "a", 0.9), (2, "c", 0.9)]


def test_index_store(spark, index, chunks, tmp_path):
    folder = str(tmp_path / "index")
    with pytest.raises(index_store.NoIndexError):
        index_store.load(spark, folder)
    assert index_store.save(index, chunks, folder)["n_chunks"] == 5
    again = index_store.load(spark, folder)
    queries = asked(spark, "keywords")
    columns = ("rank", "chunk_id", "score")
    assert fusion.retrieve(again, queries).select(*columns).collect() == fusion.retrieve(index, queries).select(*columns).collect()
    assert index_store.inspect(spark, folder).count() == 5
    with pytest.raises(ValueError, match="no chunks"):
        index_store.save(index, chunks.limit(0), folder)
    place = f"{folder}/snapshots/{index_store.manifest(spark, folder)['snapshot']}"
    spark.createDataFrame([(0, [1.0] * 8)], "chunk_id long, embedding array<double>").write.mode("overwrite").parquet(f"{place}/vectors")
    with pytest.raises(dense.DimensionError):
        index_store.load(spark, folder)


def test_index_versions(spark, index, chunks, tmp_path):
    folder = str(tmp_path / "index")
    assert index_store.save(index, chunks, folder)["version"] == 1
    first = index_store.load(spark, folder)
    few = chunks.filter("chunk_id < 2")
    assert index_store.save(fusion.index_chunks(few), few, folder)["version"] == 2
    assert index_store.load(spark, folder).chunks.count() == 2
    assert index_store.load(spark, folder, version=1).chunks.count() == first.chunks.count() == 5  # a reader keeps what it opened
    with pytest.raises(index_store.NoIndexError):
        index_store.load(spark, folder, version=7)


def test_failed_writes_leave_the_index_readable(spark, index, chunks, tmp_path):
    folder = str(tmp_path / "index")
    index_store.save(index, chunks, folder)
    died = F.udf(lambda x: 1 / 0, "array<double>")
    lost = fusion.HybridIndex(index.chunks, index.vectors.withColumn("embedding", died("chunk_id")), index.lexical, index.dim)
    with pytest.raises(Exception, match="division by zero"):
        index_store.save(lost, chunks, folder)
    mixed = fusion.HybridIndex(index.chunks, index.vectors.withColumn("embedding", F.slice("embedding", 1, 8)), index.lexical, index.dim)
    with pytest.raises(dense.DimensionError):
        index_store.save(mixed, chunks, folder)
    short = fusion.HybridIndex(index.chunks, index.vectors.filter("chunk_id > 0"), index.lexical, index.dim)
    with pytest.raises(ValueError, match="4 vectors"):
        index_store.save(short, chunks, folder)
    spark.createDataFrame([], "version long").write.json(f"{folder}/manifests/00000002")  # a writer that died before its commit
    assert index_store.manifest(spark, folder)["version"] == 1
    assert index_store.load(spark, folder).chunks.count() == 5
    assert index_store.save(index, chunks, folder)["version"] == 3


def test_index_drift_and_figures(spark, index, chunks, tmp_path):
    folder, made = str(tmp_path / "index"), Settings(embed_provider="hashed", embed_model="m", embed_dim=64)
    index_store.save(index, chunks, folder, made)
    meta = index_store.manifest(spark, folder)
    assert index_store.drift(meta, made) == []
    for other in (Settings(embed_provider="cloud", embed_model="m"), Settings(embed_model="m", embed_dim=8), Settings(embed_model="n")):
        assert len(index_store.drift(meta, other)) == 1
        with pytest.warns(UserWarning, match="index made with hashed"):
            index_store.load(spark, folder, settings=other)
    rows = index_store.figures(spark, folder).collect()
    assert {r["part"] for r in rows} == set(index_store.PARTS) and all(r["bytes"] > 0 for r in rows)
    assert {(r["chunk_count"], r["vector_count"], r["source_count"], r["embed_dim"]) for r in rows} == {(5, 5, 5, 64)}
    assert sum(r["share"] for r in rows) == pytest.approx(1, abs=1e-3)


def test_expire_keeps_the_newest_versions(spark, index, chunks, tmp_path):
    folder = str(tmp_path / "index")
    for _ in range(3):
        index_store.save(index, chunks, folder)
    assert sorted(index_store.expire(spark, folder, 1)) == [1, 2]
    assert [r["version"] for r in index_store.versions(spark, folder).collect()] == [3]
    assert len(list((tmp_path / "index" / "snapshots").iterdir())) == 1
    assert index_store.load(spark, folder).chunks.count() == 5
    with pytest.raises(ValueError, match="at least one"):
        index_store.expire(spark, folder, 0)


def test_ingest_files(spark, tmp_path):
    docs = tmp_path / "docs" / "sub"
    docs.mkdir(parents=True)
    (docs / "a.md").write_bytes("# Title\r\nhybrid retrieval \xe6".encode("latin-1"))
    (docs / "B.TXT").write_text("keywords and vectors", encoding="utf-8")
    (docs / "blank.txt").write_text(" \n")
    (docs / "broken.pdf").write_bytes(b"not a pdf")
    (docs / "c.csv").write_text("ignored")
    got = index_store.load_documents(spark, str(tmp_path / "docs")).orderBy("doc_ord").collect()
    assert [r["source"] for r in got] == ["B.TXT", "a.md"]
    assert got[1]["text"] == "# Title\nhybrid retrieval "
    done = index_store.ingest(spark, str(tmp_path / "docs"), str(tmp_path / "index"))
    assert done["n_chunks"] == 2
    assert fusion.retrieve(index_store.load(spark, str(tmp_path / "index")), asked(spark, "hybrid")).first()["source"] == "a.md"
    (tmp_path / "none").mkdir()
    with pytest.raises(RuntimeError, match="no documents"):
        index_store.ingest(spark, str(tmp_path / "none"), str(tmp_path / "other"))


def test_question_stream(spark, index, tmp_path):
    from millrace.streaming.questions import answer_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.json").write_text('{"query_id": 5, "text": "keywords"}\n')
    answer_stream(spark, str(tmp_path / "in"), index, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    hits = spark.read.parquet(str(tmp_path / "out"))
    assert {r["query_id"] for r in hits.collect()} == {5}
    assert hits.filter("rank = 0").first()["chunk_id"] == 4


def test_provider_embedding(spark, chunks):
    from millrace.functions.vectors import provider_embedding

    def lengths(texts):
        assert len(texts) <= 2
        return [[float(len(t)), 1.0] for t in texts]

    embed = provider_embedding(lengths, 2)
    index = fusion.index_chunks(chunks, 2, embed)
    queries = fusion.embed_queries(spark.createDataFrame([(0, "  "), (1, "x" * 26)], "query_id long, text string"), 2, embed)
    got = {r["query_id"]: r["chunk_id"] for r in dense.search(index.vectors, queries, 1).collect()}
    sizes = [len(t) for _, _, t in CORPUS]
    assert got[0] == int(np.argmin(sizes))
