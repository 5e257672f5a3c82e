"""N-gram Jaccard join by set relations: skipping within the lists of an index, and answers derived from similar sets' answers.

1. *Index.* Documents with equal sets are one class. A class is indexed by its
   tokens (``setindex``, which first drops what is linked with nothing), rare ones first: a token is placed by the number of
   classes that have it, then by its hash. A linked set lacks at most e of its
   shingles in its partner, so the first token that both have stands among the
   first e + 1 of either; only these make lists.
2. *Skip.* A token's list is cut into blocks by the size of the sets, and a block
   is ordered by the token's position in them. All that stands before the first
   common token is in one of the two sets only, so positions i and j in linked sets
   of n and more shingles obey ``i + j <= (100 - percent) * n / percent``. A set is
   joined with the block's front, the set of the smallest position, and skipped
   where even that is too far: what it could be linked with stands further back.
   No pairs within a list are made, and components of these edges hold every link.
3. *Derive.* Links are decided on full sets within these components
   (``setlinks``). In a large one, members are compared with a few that have the
   rarest tokens no other has; who is linked with those is done. The others' answers
   are derived from one base's: sets near it are sent as their differences from
   it, which decide every link between them.

The result is exact; hashes of shingles have 64 bits.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; texts of fewer words than a shingle have one; rows repeated under one
doc_id are one document with all their links; a null doc_id is linked with nothing
and has no component; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import setlinks
from millrace.llm.common import stash
from millrace.llm.components import components
from millrace.llm.setindex import classes_of, entries, labelled, nameless, sets, texts_of


@dataclass(frozen=True)
class JoinParams:
    words: int = 4  # in a shingle
    percent: int = 85  # 100 * intersection >= percent * union
    block: int = 256  # texts in a task
    shared: int = 8  # members of a large cluster that all its blocks have


def prefixes(open_: DataFrame, percent: int) -> DataFrame:
    """row, n, own, h, i: tokens of each entry that another has, at positions (from 0) up to e; ``open_``: row, uni, n, tokens, own."""
    each = open_.select("row", "uni", "n", "own", F.explode("tokens").alias("h"))
    often = stash(each.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "often")
    order = Window.partitionBy("row", "uni").orderBy("c", "h")
    place = F.col("own") + F.row_number().over(order) - 1  # those of its own come first
    return each.join(often.hint("merge"), "h").withColumn("i", place).filter(F.col("i") * 100 <= (100 - percent) * F.col("n")).select("row", "n", "own", "h", "i")


def candidates(prefix: DataFrame, percent: int) -> DataFrame:
    """Edges a, b whose components hold every link."""
    step = max(math.log(100 / percent) * 1.0001, 1e-3)  # sets of linkable sizes are in one block or in neighbouring ones
    s = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    cells = prefix.select("row", "n", "h", "i", F.explode(F.array(s, s + 1)).alias("s"))
    front = cells.groupBy("h", "s").agg(F.min(F.struct("i", "row")).alias("front"), F.count("*").alias("c")).filter("c > 1")
    met = cells.join(stash(front.select("h", "s", F.col("front.i").alias("j"), F.col("front.row").alias("b")), "fronts").hint("merge"), ["h", "s"])
    near = (F.col("i") + F.col("j")) * percent <= (100 - percent) * F.col("n")
    return stash(met.filter(near & (F.col("row") != F.col("b"))).select(F.col("row").alias("a"), "b").distinct(), "candidates")


def similar_sets(docs: DataFrame, params: JoinParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    p = params or JoinParams()
    found = sets(docs, p.words, p.percent)
    classes = classes_of(found)
    texts = texts_of(docs, found, classes, p.percent)
    prefix = stash(prefixes(entries(texts, p.words, p.percent), p.percent), "prefixes")
    edges = candidates(prefix, p.percent)
    links = None
    if not edges.isEmpty():
        own = stash(prefix.groupBy(F.col("row").alias("rep")).agg(F.min("own").alias("own")), "own")
        links = setlinks.links(stash(components(edges), "clusters"), own, texts, p)
    return labelled(found, classes, links).unionByName(nameless(docs, p.words))


#: Components by reachability over links between distinct sets; for tables of a few thousand documents.
JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS c, s FROM s),
c AS (SELECT c, any_value(n) AS n, min(doc_id) AS least, any_value(s) AS s FROM k WHERE n > 0 GROUP BY c),
u AS (SELECT c, n, unnest(s) AS x FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM u a JOIN u b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n
      HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(c, t) AS (SELECT c, c FROM c UNION SELECT l.b, r.t FROM r JOIN l ON l.a = r.c),
m AS (SELECT r.t AS c, min(c.least) AS component FROM r JOIN c ON c.c = r.c GROUP BY r.t)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id FROM k LEFT JOIN m USING (c)
"""
