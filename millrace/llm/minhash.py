"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

1. *Prune.* Documents with equal sets of word shingles are one class. Classes of
   which more shingles than a link allows are in no other are linked with nothing
   and leave (``setindex``); only the others' texts go on.
2. *Sketch.* Each of these gets a fast similarity sketch of ``bands * rows``
   coordinates: rounds of hashed bin placement that fill every coordinate.
3. *Band.* Classes that agree on all rows of a band share a bucket. A pair at the
   threshold shares none with probability (1 - 0.8**7)**60 < 1e-6. A bucket is a
   star around its smallest row, never pairs; components of the stars are clusters
   that hold every link, whatever a bucket's size.
4. *Verify.* Within clusters links are decided on full sets, in blocks
   (``setlinks``). Components of these links are the answer.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; texts of fewer words than a shingle have one; rows repeated under one
doc_id are one document with all their links in ``near_duplicates``, also where
their texts are unlike, while ``kept_rows`` tells its rows apart by doc_id and text
and takes null doc_ids as the largest; a null doc_id is linked with nothing and
kept in ``near_duplicates``; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import setlinks
from millrace.llm.common import numbered, settled, sized, stash, text_or_empty, whole
from millrace.llm.components import components
from millrace.llm.setindex import classes_of, entries, labelled, nameless, sets, texts_of
from millrace.llm.shingles import mix, sketches


@dataclass(frozen=True)
class NearParams:
    words: int = 4  # in a shingle
    percent: int = 80  # 100 * intersection >= percent * union
    bands: int = 60
    rows: int = 7
    block: int = 256  # texts in a task
    shared: int = 8  # members of a large cluster that all its blocks have


def _bands(p: NearParams):
    def run(value: np.ndarray, n: np.ndarray) -> list:
        """A key for each band of each set's sketch."""
        rows = mix(sketches(value, n, p.bands * p.rows)).reshape(len(n), p.bands, p.rows)
        band = np.zeros((len(n), p.bands), np.uint64)
        for r in range(p.rows):
            band = mix(band + rows[:, :, r])
        return list(((band & ~np.uint64(63)) | np.arange(p.bands, dtype=np.uint64)).view(np.int64))

    return run


def buckets(open_: DataFrame) -> DataFrame:
    """Edges a, b from the members of each bucket to its smallest row; ``open_``: row, bands."""
    keys = open_.select("row", F.explode("bands").alias("key"))
    centre = keys.groupBy("key").agg(F.min("row").alias("b"), F.max("row").alias("most")).filter("b <> most").select("key", "b")
    # a plain join of two scans: adaptive execution splits it where one bucket is large
    met = keys.join(stash(centre, "centres").hint("merge"), "key").filter("row <> b")
    return stash(met.select(F.col("row").alias("a"), "b").distinct(), "buckets")


def near_duplicates(docs: DataFrame, params: NearParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    p = params or NearParams()
    found = sets(docs, p.words, p.percent)
    classes = classes_of(found)
    texts = texts_of(docs, found, classes, p.percent)
    open_ = entries(texts, p.words, p.percent, _bands(p))
    edges = buckets(open_)
    links = None
    if not edges.isEmpty():
        own = stash(open_.groupBy(F.col("row").alias("rep")).agg(F.min("own").alias("own")), "own")
        links = setlinks.links(stash(components(edges), "clusters"), own, texts, p)
    all_ = labelled(found, classes, links).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return all_.unionByName(nameless(docs, p.words).withColumn("kept", F.lit(True)))


def kept_rows(docs: DataFrame, params: NearParams | None = None) -> DataFrame:
    """One row of each group of near duplicates, with its columns: the one with the smallest doc_id (of these, the smallest text hash)."""
    with sized(docs.sparkSession, docs.count()):
        return settled(_kept_rows(docs, params))


def _kept_rows(docs: DataFrame, params: NearParams | None) -> DataFrame:
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    own = _own(docs).alias("_own")
    keyed = docs.select(whole(docs).alias("row"), F.col("doc_id").alias("id"), "text", own)
    if ids.isEmpty():
        keyed = keyed.drop("_own")
    else:  # rows are told apart by doc_id and text, and numbered in that order
        pairs = docs.select(F.col("doc_id").alias("id"), own).distinct()
        places = numbered(pairs, [F.col("id").asc_nulls_last(), F.col("_own")], "_place")
        places = stash(places.select(F.col("id").alias("_id"), F.col("_own").alias("_o"), "_place"), "places")
        once = keyed.dropDuplicates(["id", "_own"])
        keyed = once.join(places, once["id"].eqNullSafe(places["_id"]) & (once["_own"] == places["_o"])).select("row", F.col("_place").cast("long").alias("id"), "text")
        keyed = stash(keyed, "numbered")
    stay = near_duplicates(keyed.select(F.col("id").alias("doc_id"), "text"), params).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return keyed.join(stay, keyed["id"] == stay["_id"], "left_semi").select("row.*")


def _own(docs: DataFrame) -> Column:
    return F.xxhash64(text_or_empty(), docs["doc_id"])


#: Components by reachability over links between distinct sets; for tables of a few thousand documents.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS c, s FROM s),
c AS (SELECT c, any_value(n) AS n, min(doc_id) AS least, any_value(s) AS s FROM k WHERE n > 0 GROUP BY c),
u AS (SELECT c, n, unnest(s) AS x FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM u a JOIN u b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n
      HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(c, t) AS (SELECT c, c FROM c UNION SELECT l.b, r.t FROM r JOIN l ON l.a = r.c),
m AS (SELECT r.t AS c, min(c.least) AS component FROM r JOIN c ON c.c = r.c GROUP BY r.t)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept FROM k LEFT JOIN m USING (c)
"""
