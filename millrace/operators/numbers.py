"""Numbers of many answers against a large context, without gathering the context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import extract_numbers
from millrace.shared import placed, stash

RUN = r"(?U)[-.\d]+"  # all that a number is made of


def held(numbers: DataFrame, context: DataFrame) -> DataFrame:
    """Those of ``numbers`` (number) that the context holds, spaces or not. ``context``: pos, text, joined by spaces in order of pos.

    Without its spaces a number may reach over several texts, so a text is seen with as
    many of the following characters as the longest number has. Of each, runs of
    digits, signs and points are cut into substrings of the lengths that numbers have,
    and these are joined; a number without spaces that stands in the context as it is
    stands there without spaces as well. Nulls are left out.
    """
    numbers = numbers.select("number").distinct()
    lengths = sorted(r["n"] for r in numbers.select(F.length("number").alias("n")).distinct().collect())  # a few
    if not lengths:
        return numbers
    reach = lengths[-1] - 1
    pieces = context.select("pos", F.replace("text", F.lit(" "), F.lit("")).alias("piece")).filter(F.length("piece") > 0)
    if reach:
        pieces = stash(placed(pieces, F.col("pos"), "place"), "pieces")
        heads = pieces.select("place", F.substring("piece", 1, reach).alias("head"))
        back = heads.select(F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("back"), "place", "head")
        tails = back.select((F.col("place") - F.col("back")).alias("place"), "back", "head").groupBy("place")
        tails = tails.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("back", "head"))), lambda x: x["head"]), "").alias("tail"))
        pieces = pieces.join(tails, "place", "left").select(F.concat("piece", F.substring(F.coalesce("tail", F.lit("")), 1, reach)).alias("piece"))
    runs = pieces.select(F.explode(F.regexp_extract_all("piece", F.lit(RUN), F.lit(0))).alias("run")).distinct()
    sized = runs.select("run", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("run"))).alias("n"))
    parts = sized.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("n") + 1), lambda i: F.substring("run", i, F.col("n")))).alias("number"))
    return numbers.join(parts.distinct(), "number", "left_semi")


def unsupported(answers: DataFrame, context: DataFrame) -> DataFrame:
    """id, n_numbers, unsupported (numbers of the answer, in order, that the context doesn't hold) of answers (id, answer), one row per row."""
    rows = stash(answers.select(F.monotonically_increasing_id().alias("row"), "id", extract_numbers(F.col("answer")).alias("numbers")), "answers")
    each = rows.select("row", F.posexplode("numbers").alias("at", "number"))
    known = stash(held(each.select("number"), context), "held")
    missing = each.join(known, "number", "left_anti").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("m"))
    found = rows.join(missing, "row", "left")
    none = F.array().cast("array<string>")
    return found.select("id", F.size("numbers").cast("long").alias("n_numbers"), F.coalesce(F.transform("m", lambda x: x["number"]), none).alias("unsupported"))
