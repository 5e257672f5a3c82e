"""Deterministic checks of answers against their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import citations, is_blank, json_object, rstrip, unsupported_numbers

#: The answer that stands for none, and the warning behind citations that lead nowhere.
ABSTAIN = "抱歉，当前知识库中没有足够信息支撑这个回答，无法给出可靠结论。"
WARNING = ("\n（注意：引用 ", " 超出上下文范围，可能为模型臆造，请谨慎采信。）")

CRITIC_TYPE = "struct<faithful:boolean,hallucinated:array<string>,missing:array<string>,issues:array<string>>"


def validate_citations(answer: Column, n_chunks: Column) -> Column:
    """struct<valid, citations, invalid, has_citation>."""
    cited = citations(answer)
    invalid = F.filter(cited, lambda c: (c < 1) | (c > n_chunks))
    return F.struct(
        (F.size(invalid) == 0).alias("valid"), cited.alias("citations"), invalid.alias("invalid"), (F.size(cited) > 0).alias("has_citation")
    )


def needs_abstain(answer: Column, n_chunks: Column) -> Column:
    """No context, no answer, or an answer that cites nothing; numbers out of range count as citations here."""
    blank = is_blank(F.coalesce(answer, F.lit("")))
    return (n_chunks == 0) | blank | (F.size(citations(answer)) == 0)


def annotate_invalid(answer: Column, n_chunks: Column) -> Column:
    invalid = validate_citations(answer, n_chunks)["invalid"]
    labels = F.array_join(F.transform(invalid, lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), ", ")
    return F.when(F.size(invalid) == 0, answer).otherwise(F.concat(rstrip(answer), F.lit(WARNING[0]), labels, F.lit(WARNING[1])))


def safe_answer(answer: Column, n_chunks: Column) -> Column:
    return F.when(needs_abstain(answer, n_chunks), F.lit(ABSTAIN)).otherwise(annotate_invalid(answer, n_chunks))


def critique(rows: DataFrame, answer: str = "answer", context: str = "context", reply: str | None = None) -> DataFrame:
    """``rows`` with faithful, hallucinated, missing, issues, from numbers and, where there is one, a judge's JSON reply."""
    none = F.array().cast("array<string>")
    unsupported = unsupported_numbers(F.col(answer), F.col(context))
    said = F.from_json(json_object(F.col(reply)), CRITIC_TYPE) if reply else F.lit(None).cast(CRITIC_TYPE)
    rows = rows.withColumn("_bad", unsupported).withColumn("_said", said)
    named = F.coalesce("_said.hallucinated", none)
    issues = F.coalesce("_said.issues", none)
    noted = F.array(F.concat(F.lit("numbers that the context does not hold: "), F.array_join("_bad", ", ")))
    return rows.withColumns(
        {
            "faithful": F.coalesce("_said.faithful", F.size("_bad") == 0),
            "hallucinated": F.when(F.size(named) > 0, named).otherwise(F.col("_bad")),
            "missing": F.coalesce("_said.missing", none),
            "issues": F.when((F.size(issues) == 0) & (F.size("_bad") > 0), noted).otherwise(issues),
        }
    ).drop("_bad", "_said")
