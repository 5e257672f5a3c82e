from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import chunking


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("检索增强生成", ["检", "索", "增", "强", "生", "成", "检索", "索增", "增强", "强生", "生成"]),
        ("CODE V 光学设计 2024", ["code", "v", "2024", "光", "学", "设", "计", "光学", "学设", "设计"]),
        ("检X索", ["x", "检", "索", "检索"]),
        ("光", ["光"]),
        ("", []),
        (None, []),
        ("！！！ ...", []),
        ("café_au-lait", ["caf", "au", "lait"]),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize(F.col("t")), t=text) == tokens


def test_count_tokens_and_strip(spark):
    assert [one(spark, T.count_tokens(F.col("t")), t=t) for t in ("", "abc", "abcdefgh", "😀" * 9)] == [1, 1, 2, 2]
    assert one(spark, T.strip(F.col("t")), t="　 a b\n　") == "a b"
    assert one(spark, T.is_sparse(F.col("t")), t=None) and not one(spark, T.is_sparse(F.col("t")), t="x" * 30)


def plain_pieces(text: str, budget: int, seps=chunking.SEPARATORS) -> list[str]:
    def tok(x):
        return max(1, len(x) // 4)

    if tok(text) <= budget:
        return [text] if text.strip() else []
    if not seps:
        return [text[i : i + 3 * budget] for i in range(0, len(text), 3 * budget)]
    out, held = [], ""
    for part in text.split(seps[0]) if seps[0] else list(text):
        longer = held + seps[0] + part if held else part
        if tok(longer) <= budget:
            held = longer
            continue
        for x in (held, part):
            out += plain_pieces(x, budget, seps[1:]) if x else []
        held = ""
    return out + (plain_pieces(held, budget, seps[1:]) if held else [])


def test_pieces_match_the_recursive_definition(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "x", "。", "；", ". ", "? ", "\n", "\n\n", "长", "! ", "yy"]) for _ in range(rng.randrange(400))) for _ in range(40)]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for budget in (2, 10, 60):
        got = {r["i"]: r["p"] for r in data.select("i", chunking.recursive_pieces(F.col("t"), budget).alias("p")).collect()}
        assert [got[i] for i in range(len(texts))] == [plain_pieces(t, budget) for t in texts]


def test_chunks_bounds_and_overlap(spark):
    text = "\n\n".join("A sentence about lenses and light that is repeated. " * 3 for _ in range(12))
    assert one(spark, chunking.chunk_text(F.col("t"), 400, 80), t="short text") == ["short text"]
    assert one(spark, chunking.chunk_text(F.col("t"), 400, 80), t="  \n ") == []
    plain = one(spark, chunking.chunk_text(F.col("t"), 60, 0), t=text)
    lapped = one(spark, chunking.chunk_text(F.col("t"), 60, 20), t=text)
    assert len(plain) == len(lapped) > 1
    assert sum(map(len, lapped)) > sum(map(len, plain))
    assert all(max(1, len(p) // 4) <= 60 for p in plain)
    last = plain[0]
    for a, b in zip(plain[1:], lapped[1:], strict=True):
        last = last[-80:] + "\n" + a if max(1, len(last) // 4) > 20 else a
        assert b == last.strip()


def test_chunk_ids_are_dense_and_figures_are_one_chunk(spark):
    figure = "struct<page:int,index:int,kind:string,caption:string,bbox:array<double>>"
    rows = [(i * 7, f"s{i}", "word " * (i * 300), None) for i in range(9)] + [(100, "a.pdf#fig1-1", "Table 1 sizes", (1, 1, "table", "Table 1 sizes", [0.0, 1.0, 2.0, 3.0]))]
    docs = spark.createDataFrame(rows, f"doc_ord long, source string, text string, figure {figure}")
    got = sorted(chunking.build_chunks(docs, 100, 10).collect(), key=lambda r: r["chunk_id"])
    assert [r["chunk_id"] for r in got] == list(range(len(got)))
    assert [(r["doc_ord"], r["pos"]) for r in got] == sorted((r["doc_ord"], r["pos"]) for r in got)
    assert (got[-1]["chunk_type"], got[-1]["meta"]["page"], got[-1]["text"]) == ("table", 1, "Table 1 sizes")
    assert {r["chunk_type"] for r in got[:-1]} == {"text"}


@pytest.mark.parametrize(
    ("text", "numbers"), [("99.5% of 1200, -3", ["99.5", "1200", "-3"]), ("2020-2021", ["2020", "-2021"]), ("", []), ("5% 5%", ["5", "5"])]
)
def test_numbers(spark, text, numbers):
    assert one(spark, T.extract_numbers(F.col("t")), t=text) == numbers


def test_unsupported_numbers(spark):
    x = T.unsupported_numbers(F.col("a"), F.col("c"))
    assert one(spark, x, a="99.5% and 1200 and 87", c="about 87% of 1 200 cases") == ["99.5"]
    assert one(spark, x, a="1", c="2100") == []


def test_json_and_clamp(spark):
    assert one(spark, T.json_object(F.col("t")), t='```json\n{"a": {"b": 1}}\n``` done') == '{"a": {"b": 1}}'
    assert one(spark, T.json_object(F.col("t")), t="no object") == ""
    values = spark.createDataFrame([(x,) for x in (-1.0, 0.5, 2.0, float("nan"))], "x double").select(T.clamp01(F.col("x")).alias("y"))
    assert [r["y"] for r in values.collect()] == [0.0, 0.5, 1.0, 1.0]


@pytest.mark.parametrize(
    ("text", "kind"), [("图1 光路", "figure"), ("fig. 2", "figure"), (" Table 3", "table"), ("公式（3）", "equation"), ("式 2", "equation"), ("other", "figure")]
)
def test_caption_kind(spark, text, kind):
    assert one(spark, T.caption_kind(F.col("t")), t=text) == kind
    assert one(spark, T.is_caption(F.col("t")), t=text) == (text != "other")


def test_vectors(spark):
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 1.0], b=[-2.0, -2.0]) == pytest.approx(-1)
    assert one(spark, V.normalise(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.normalise(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    v = one(spark, V.hashed_embedding(F.split("t", " ")), t="rag and rag")
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1) and v[62] == max(v)
