"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The CJK ranges of the tokenizer, and the words that open a caption.
CJK = "[一-鿿㐀-䶿]"
FIGURE_WORDS = ("图", "Fig.?", "Figure")
TABLE_WORDS = ("表", "Table")
EQUATION_WORDS = ("公式", "式", "Equation")
FULL_WIDTH_DIGITS = "０１２３４５６７８９"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def count_tokens(c: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), (F.length(c) / 4).cast("int")).cast("long")


def is_sparse(c: Column, least: int = 30) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) < least


def tokenize(c: Column) -> Column:
    """Latin words and numbers, then CJK characters, then pairs of neighbouring CJK characters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    # other signs go first, so that the pairs, which overlap, are looked for in what is left; mostly nothing
    cjk = F.regexp_replace(low, f"[^{CJK[1:]}+", "")
    return F.concat(words, F.regexp_extract_all(cjk, F.lit("."), F.lit(0)), F.regexp_extract_all(cjk, F.lit("(?=(..))"), F.lit(1)))


def _opens_with(c: Column, words: tuple[str, ...]) -> Column:
    return strip(c).rlike(f"(?i)^({'|'.join(words)})")


def is_caption(c: Column) -> Column:
    return _opens_with(c, FIGURE_WORDS + TABLE_WORDS + EQUATION_WORDS)


def caption_kind(c: Column) -> Column:
    return (
        F.when(_opens_with(c, FIGURE_WORDS), "figure")
        .when(_opens_with(c, TABLE_WORDS), "table")
        .when(_opens_with(c, EQUATION_WORDS), "equation")
        .otherwise("figure")
    )


def block_text(lines: Column) -> Column:
    """Text of a page block: array<struct<spans: array<struct<text>>>>."""
    joined = F.transform(lines, lambda x: F.array_join(F.transform(x["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    return strip(F.array_join(joined, "\n"))


def extract_numbers(c: Column) -> Column:
    """Numbers as written, without a trailing per cent sign, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)-?\d+(?:\.\d+)?%?"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, "%$", ""))


def unsupported_numbers(answer: Column, context: Column) -> Column:
    """Numbers of the answer that the context doesn't hold, with or without its spaces."""
    plain = F.coalesce(context, F.lit(""))
    tight = F.replace(plain, F.lit(" "), F.lit(""))
    return F.filter(extract_numbers(answer), lambda n: ~F.contains(tight, n) & ~F.contains(plain, n))


def json_object(c: Column) -> Column:
    """The outermost {...} of a reply, without code fences."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def citations(answer: Column) -> Column:
    """Distinct cited numbers, in order; digits of any script of the full-width kind count."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(?U)\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.translate(x, FULL_WIDTH_DIGITS, "0123456789").try_cast("long"))))


def context_block(ranked: Column, limit: int | None = None) -> Column:
    """Numbered blocks of an array<struct<rank, source, text>>; texts cut at ``limit`` characters."""

    def shown(x: Column) -> Column:
        text = x["text"]
        if limit is not None:
            text = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
        return F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] (source: "), x["source"], F.lit(")\n"), text)

    return F.array_join(F.transform(F.array_sort(ranked), shown), "\n\n")


def cache_key(*parts: Column) -> Column:
    """40 hex digits of a digest of the parts as a JSON array."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256), 1, 40)
