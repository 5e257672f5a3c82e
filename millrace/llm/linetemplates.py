"""Line dedup by log templates: lines of a template that recurs across documents are dropped.

A fixed-depth tree deals lines by their number of tokens and their leading
tokens, tokens with digits being variable from the start. In a leaf, a token at
a position is constant if the leaf has it there ``least`` times, otherwise the
position is a variable field; what a line's tokens become is its template. A
template of at least ``share`` constants that at least ``least`` documents hold
recurs, and its lines are dropped. As ``TEMPLATES_SQL`` has it, ``least`` is a
fixed count, so the values of a field become constants once each stands often
enough; with ``constant_share`` a constant also needs that share of its leaf's
lines, which makes a field one at every size. With ``copies`` a line that so
many documents hold word for word goes as well, whatever its leaf.

Plan: DataFrame functions only. Leaves that are too small are found on hashes
before any line is moved; lines of the others meet their leaf in a sort-merge
join and are counted map-side before they are exchanged again. Verdicts reach
lines through ``tell``, so a line that a third of all documents hold is
broadcast and not shuffled. Documents are joined with their dropped line
numbers at the end.

Defined cases: null and empty texts have no lines; blank lines are kept and
belong to no template; rows repeated under one doc_id with one text count once
and get the same verdict; an empty table gives an empty result; other columns
stay as they are in ``drop_templates``, but for n_lines and n_dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stash, tell, text_or_empty, whole


@dataclass(frozen=True)
class TemplateParams:
    leading: int = 3  # tokens that the tree looks at, below the number of tokens
    least: int = 10
    share: float = 0.5
    constant_share: float = 0.0  # of a leaf's lines; 0: the rule of TEMPLATES_SQL
    copies: int = 0  # documents that hold a line word for word; 0: the rule of TEMPLATES_SQL


VARIABLE = "<*>"
_HAS_DIGIT = "[^ ]*[0-9][^ ]*"


def _masked(line: Column) -> Column:
    return F.regexp_replace(line, _HAS_DIGIT, VARIABLE)


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), text_or_empty())


def _lines(docs: DataFrame, p: TemplateParams) -> DataFrame:
    """_row, doc_id, line_no, line, leaf, and the line's own hash."""
    split = F.split(text_or_empty(), "\n")
    rows = docs.select(_row_key().alias("_row"), "doc_id", F.posexplode(split).alias("line_no", "line")).filter(F.trim("line") != "")
    n = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    return rows.withColumns(
        {
            "leaf": F.xxhash64(n, _masked(F.substring_index("line", " ", p.leading))),
            "own": F.xxhash64("line", F.lit(1)),
        }
    )


def line_templates(docs: DataFrame, params: TemplateParams | None = None) -> DataFrame:
    """_row, doc_id, line_no, template of every line whose template recurs."""
    p = params or TemplateParams()
    lines = _lines(docs, p)
    leaves = stash(lines.groupBy("leaf").agg(F.count("*").alias("_n")).filter(F.col("_n") >= p.least), "leaves")
    within = lines.select("leaf", "own", "line").join(leaves.select("leaf").hint("merge"), "leaf")
    distinct = stash(within.groupBy("leaf", "own", "line").agg(F.count("*").alias("n")), "lines")
    tokens = distinct.select("leaf", "own", "n", F.posexplode(F.split(_masked(F.col("line")), " ", -1)).alias("pos", "token"))
    common = tokens.filter(F.col("token") != VARIABLE).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("_n"))
    common = common.filter(F.col("_n") >= p.least)
    if p.constant_share:
        common = common.join(leaves.withColumnRenamed("_n", "_all"), "leaf").filter(F.col("_n") >= F.col("_all") * p.constant_share)
    common = common.select("leaf", "pos", "token", F.lit(1).alias("constant"))
    parsed = tokens.join(common, ["leaf", "pos", "token"], "left")
    field = F.when(F.col("constant") == 1, F.col("token")).otherwise(VARIABLE)
    parsed = parsed.groupBy("leaf", "own").agg(
        F.max("n").alias("n"), F.sum(F.coalesce("constant", F.lit(0))).alias("fixed"), F.count("*").alias("tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", field.alias("x")))), lambda x: x["x"]), " ").alias("template"),
    )
    parsed = stash(parsed.filter(F.col("fixed") >= F.col("tokens") * p.share).select("leaf", "own", "n", "template"), "templates")
    total = int(parsed.agg(F.sum("n")).first()[0] or 0)
    met = tell(lines.select("_row", "doc_id", "line_no", "leaf", "own"), parsed, ["leaf", "own"], "n", total)
    met = stash(met.select("_row", "doc_id", "line_no", "template"), "met")
    held = met.groupBy("template").agg(F.count("*").alias("n"), F.countDistinct("_row").alias("docs")).filter(F.col("docs") >= p.least)
    held = stash(held.select("template", "n"), "recurring")
    found = tell(met, held, ["template"], "n", met.count()).select("_row", "doc_id", "line_no", "template")
    return found.unionByName(_copied(lines, p)).dropDuplicates(["_row", "doc_id", "line_no"]) if p.copies else found


def _copied(lines: DataFrame, p: TemplateParams) -> DataFrame:
    """_row, doc_id, line_no, template (the line) of every line that enough documents hold word for word."""
    key = ["leaf", "own"]
    held = lines.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("_row").alias("docs")).filter(F.col("docs") >= p.copies)
    held = stash(held.select(*key, "n"), "copied")
    met = tell(lines.select("_row", "doc_id", "line_no", F.col("line").alias("template"), *key), held, key, "n", lines.count())
    return met.select("_row", "doc_id", "line_no", "template")


def drop_templates(docs: DataFrame, params: TemplateParams | None = None) -> DataFrame:
    """``docs`` with the recurring lines gone from ``text``, and n_lines, n_dropped."""
    gone = line_templates(docs, params).groupBy("_row", "doc_id").agg(F.collect_set("line_no").alias("_gone"))
    gone = gone.select(F.col("_row").alias("_r"), F.col("doc_id").alias("_d"), "_gone")
    keyed = docs.select(whole(docs).alias("row"), _row_key().alias("_row"), "doc_id", "text")
    met = keyed.join(gone, (F.col("_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    split = F.split(text_or_empty(), "\n")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return met.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(text_or_empty() == "", 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


TEMPLATES_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, line_no, line, string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS tokens FROM l WHERE trim(line) <> ''),
k AS (SELECT *, len(tokens) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM m),
big AS (SELECT leaf FROM k GROUP BY leaf HAVING count(*) >= 10),
u AS (SELECT leaf, line, any_value(tokens) AS tokens, count(*) AS n FROM k WHERE leaf IN (SELECT leaf FROM big) GROUP BY leaf, line),
t AS (SELECT leaf, line, n, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM u),
c AS (SELECT leaf, pos, token FROM t WHERE token <> '<*>' GROUP BY leaf, pos, token HAVING sum(n) >= 10),
p AS (SELECT t.leaf, t.line, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY t.pos) AS template
      FROM t LEFT JOIN c USING (leaf, pos, token) GROUP BY t.leaf, t.line HAVING count(c.token) >= 0.5 * count(*)),
i AS (SELECT k.r, k.line_no, p.template FROM k JOIN p USING (leaf, line)),
h AS (SELECT template FROM i JOIN d USING (r) GROUP BY template HAVING count(DISTINCT (doc_id, text)) >= 10),
g AS (SELECT r, line_no FROM i JOIN h USING (template)),
o AS (SELECT l.r, count(*) FILTER (g.r IS NOT NULL) AS n_dropped, count(*) AS n_lines,
             coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (g.r IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.r = g.r AND l.line_no = g.line_no GROUP BY l.r)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE n_lines END AS n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM o JOIN d USING (r)
"""
