"""Functions for SQL text: ``register(spark)`` makes them known to a session.

    SELECT doc_id, c.pos, c.text FROM documents, LATERAL chunk_text(text, 400, 80) c
    SELECT text_tokens(text) AS n, rerank_score(question, text) AS score FROM ...

``chunk_text`` is a table function over one text and yields what
``operators.chunking.chunk_text`` holds; DataFrame code does better with that one,
which stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.operators.chunking import SEPARATORS
from millrace.operators.rerank import Reranker

_BLANK = r"[^\S\x1c-\x1f]"  # what Java's Unicode white space holds
_ENDS = re.compile(rf"\A{_BLANK}+|{_BLANK}+\Z")


def _tokens(text: str) -> int:
    return max(1, len(text) // 4)


def _gathered(text: str, sep: str, budget: int) -> Iterator[str]:
    held = ""
    for part in text.split(sep) if sep else text:
        longer = f"{held}{sep}{part}" if held else part
        if _tokens(longer) <= budget:
            held = longer
        else:
            yield from filter(None, (held, part))
            held = ""
    if held:
        yield held


def _sliced(text: str, budget: int) -> Iterator[str]:
    step = max(1, 3 * budget)
    return (text[at : at + step] for at in range(0, len(text), step))


class ChunkText:
    """pos, text of a text's chunks; null and blank texts have none."""

    def eval(self, text: str, max_tokens: int, overlap: int) -> Iterator[tuple[int, str]]:
        pieces = [text or ""]
        cuts: list[Callable[[str], Iterator[str]]] = [lambda p, sep=sep: _gathered(p, sep, max_tokens) for sep in SEPARATORS]
        for cut in (*cuts, lambda p: _sliced(p, max_tokens)):
            pieces = [x for p in pieces for x in ([p] if _tokens(p) <= max_tokens else cut(p))]
        pieces = [p for p in pieces if _ENDS.sub("", p)]
        if overlap <= 0 or len(pieces) <= 1:
            yield from enumerate(pieces)
            return
        pos, last = 0, None
        for p in pieces:
            last = p if last is None or _tokens(last) <= overlap else f"{last[-4 * overlap :]}\n{p}"
            if shown := _ENDS.sub("", last):
                yield pos, shown
                pos += 1


def register(spark: SparkSession, reranker: Reranker | None = None) -> None:
    """``chunk_text``, ``text_tokens``, and with a reranker that has a scorer, provider or model ``rerank_score``.

    In SQL a pair that can't be scored is null; there is no order before it that could stand.
    """
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="pos int, text string"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION text_tokens(t STRING) RETURNS BIGINT RETURN greatest(1, length(t) div 4)")
    scoring = reranker.scoring() if reranker else None
    if scoring is None:
        return

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in batches:
            try:
                yield pd.Series(scoring(list(q), list(d)), dtype="float64")
            except Exception:  # as in a reranking, a failing service ends no query
                yield pd.Series([None] * len(q), dtype="float64")

    spark.udf.register("rerank_score", scored)
