"""Token-bounded chunks: recursive splitting, overlap, dense chunk ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import count_tokens, is_blank, strip

#: Separators from coarse to fine (one stands twice), the last splitting into characters.
SEPARATORS = ("\n\n", "\n", "。", "；", "；", ". ", "? ", "! ", " ", "")


def _pack(text: Column, sep: str, max_tokens: int) -> Column:
    """One level: parts are gathered up to the budget; a part that doesn't fit ends the gathering and stands alone."""
    quoted = f"\\Q{sep}\\E" if sep else ""
    parts = F.split(text, quoted, -1)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, part: Column) -> Column:
        longer = F.when(acc["buf"] == "", part).otherwise(F.concat(acc["buf"], F.lit(sep), part))
        flushed = F.concat(acc["out"], F.filter(F.array(acc["buf"], part), lambda x: x != ""))
        return F.when(count_tokens(longer) <= max_tokens, F.struct(acc["out"].alias("out"), longer.alias("buf"))).otherwise(
            F.struct(flushed.alias("out"), F.lit("").alias("buf"))
        )

    def close(acc: Column) -> Column:
        return F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"])))

    return F.aggregate(parts, start, step, close)


def recursive_pieces(text: Column, max_tokens: int = 400) -> Column:
    """Pieces within the budget; every separator is a pass over the pieces that are still too long."""

    def cut_long(pieces: Column, cut: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(pieces, lambda p: F.when(count_tokens(p) <= max_tokens, F.array(p)).otherwise(cut(p))))

    pieces = F.array(F.coalesce(text, F.lit("")))
    for sep in SEPARATORS:
        pieces = cut_long(pieces, partial(_pack, sep=sep, max_tokens=max_tokens))
    pieces = cut_long(pieces, partial(hard_split, max_tokens=max_tokens))
    return F.filter(pieces, lambda p: ~is_blank(p))


def hard_split(text: Column, max_tokens: int) -> Column:
    """Slices of three characters a token."""
    step = max(1, 3 * max_tokens)
    n = F.ceil(F.length(text) / step).cast("int")
    slices = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * step + 1, F.lit(step)))
    return F.when(n > 0, slices).otherwise(F.array().cast("array<string>"))


def with_overlap(pieces: Column, overlap: int = 80) -> Column:
    """Each piece after the end of the one before, which already holds the end of its own: a fold, not a lag."""
    if overlap <= 0:
        return pieces
    empty = F.array().cast("array<string>")

    def step(out: Column, piece: Column) -> Column:
        last = F.element_at(out, -1)
        tail = F.substring(last, F.greatest(F.length(last) - 4 * overlap + 1, F.lit(1)), F.lit(4 * overlap))
        carried = F.concat(tail, F.lit("\n"), piece)
        return F.when(F.size(out) == 0, F.array(piece)).otherwise(
            F.concat(out, F.array(F.when(count_tokens(last) > overlap, carried).otherwise(piece)))
        )

    folded = F.filter(F.transform(F.aggregate(pieces, empty, step), strip), lambda p: p != "")
    return F.when(F.size(pieces) <= 1, pieces).otherwise(folded)


def chunk_text(text: Column, max_tokens: int = 400, overlap: int = 80) -> Column:
    return with_overlap(recursive_pieces(text, max_tokens), overlap)


def dense_ids(rows: DataFrame, order: str, count: str, ranges: int = 1024) -> DataFrame:
    """``rows`` with ``first_id``: how many items all rows with a smaller ``order`` (a whole number) have.

    The order is dealt into ranges; a running sum over ranges and one within a
    range add up, so no task holds all rows.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.withColumn("first_id", F.lit(0).cast("long"))
    width = (high - low) // ranges + 1
    dealt = rows.withColumn("_range", F.floor((F.col(order) - low) / F.lit(width)))
    sums = dealt.groupBy("_range").agg(F.sum(count).alias("_sum"))
    running = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.join(starts, "_range").withColumn("first_id", (F.col("_start") + F.coalesce(F.sum(count).over(within), F.lit(0))).cast("long"))
    return met.drop("_range", "_start")


def build_chunks(docs: DataFrame, max_tokens: int = 400, overlap: int = 80) -> DataFrame:
    """Chunks of documents (doc_ord, source, text, and figure for captions of images).

    chunk_id is dense and follows doc_ord; a figure document is one chunk whose
    type is the figure's kind.
    """
    meta = "struct<page:int,bbox:array<double>,kind:string>"
    pieces = chunk_text(F.col("text"), max_tokens, overlap)
    none = F.lit(None).cast(meta)
    kind, details = F.lit("text"), none
    if "figure" in docs.columns:
        is_figure = F.col("figure").isNotNull()
        pieces = F.when(is_figure, F.array("text")).otherwise(pieces)
        kind = F.when(is_figure, F.col("figure.kind")).otherwise("text")
        details = F.when(is_figure, F.struct("figure.page", "figure.bbox", "figure.kind").cast(meta)).otherwise(none)
    cut = docs.select("doc_ord", "source", pieces.alias("pieces"), kind.alias("chunk_type"), details.alias("meta"))
    cut = dense_ids(cut.withColumn("n", F.size("pieces").cast("long")), "doc_ord", "n")
    rows = cut.select("doc_ord", "source", "first_id", "chunk_type", "meta", F.posexplode("pieces").alias("pos", "text"))
    return rows.select(
        (F.col("first_id") + F.col("pos")).alias("chunk_id"), "doc_ord", "pos", "text", "source",
        count_tokens(F.col("text")).alias("n_tokens"), "chunk_type", "meta",
    )
