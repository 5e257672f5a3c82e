"""Documents as sets of word shingles: classes of equal sets, what can be linked with nothing, and an index of tokens for the rest.

A token is a shingle's hash. A linked set lacks at most ``e = (100 - percent) * n / 100``
of its n shingles in its partner; this holds in any part of the hash space.

1. *Alone.* Of every document, tokens of a part of the hash space are counted by
   the classes that have them. Where more than e are in one class only, it is
   linked with nothing; most documents leave so, and only the others' texts go on.
2. *Entries.* Those that are left are indexed: sets of at most ``SMALL`` shingles by
   all of theirs, larger ones by a share of the hash space, the same for every set;
   sets near the border both ways, as entries of two universes (a token's lowest
   bit tells which), so that linked sets always have a universe in common. The
   count is repeated there, among themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stash, tell, text_or_empty
from millrace.llm.components import components
from millrace.llm.shingles import mix, shingles

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = 512  # shingles of a set that is indexed whole
Bands = Callable[[np.ndarray, np.ndarray], list]

def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about 2 MB."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and size < 2 << 20:
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _below(share: float) -> np.uint64:
    return np.uint64(min(int(share * 2**64), 2**64 - 1))


def sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """row, doc_id, th (a hash of the text), n, k1, k2 (digests of the set), few (tokens of a part of the hash space) of rows with a doc_id."""
    share = min(1.0, 1.6 * (1 - percent / 100) + 0.01)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            for lo, hi in _batches(texts):
                value, n = shingles(texts[lo:hi], words)
                end = np.cumsum(n)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value * np.uint64(2 * salt + 1) + np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[end] - total[end - n]).view(np.int64))
                few = [value[e - k : e] for e, k in zip(end.tolist(), n.tolist(), strict=True)]
                few = [v[: np.searchsorted(v, _below(share))].view(np.int64) for v in few]
                same = {c: b[c].iloc[lo:hi].astype("int64").to_numpy() for c in ("doc_id", "th")}
                yield pd.DataFrame({**same, "n": n, "k1": sums[0], "k2": sums[1], "few": few})

    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = rows.mapInPandas(run, "doc_id long, th long, n long, k1 long, k2 long, few array<long>")
    return stash(found.withColumn("row", F.monotonically_increasing_id()), "sets")


def classes_of(found: DataFrame) -> DataFrame:
    """k1, k2, row, doc_id, th, n (of one row of each class of equal sets), least (doc_id), size."""
    full = found.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("row", "doc_id", "th", "n")).alias("r"), F.min("doc_id").alias("least"), F.count("*").alias("size"))
    return stash(full.select("k1", "k2", "r.*", "least", "size"), "classes")


def _lonely(tokens: DataFrame, name: str) -> DataFrame:
    """x, h of the tokens h that only one ``name`` (x) has; ``tokens``: name, h."""
    return tokens.groupBy("h").agg(F.min(name).alias("x"), F.max(name).alias("y")).filter("x = y").select("x", "h")


def _few(percent: int) -> Column:
    return F.coalesce("own", F.lit(0)) * 100 <= (100 - percent) * F.col("n")


def texts_of(docs: DataFrame, found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """rep (a class's row), n, text of the classes that may be linked with anything."""
    own = _lonely(found.select("k1", F.explode("few").alias("h")), "k1").groupBy(F.col("x").alias("k1")).agg(F.count("*").alias("own"))
    able = classes.select(F.col("row").alias("rep"), "k1", "doc_id", "th", "n").join(own.hint("merge"), "k1", "left").filter(_few(percent))
    able = stash(able.select("rep", "doc_id", "th", "n"), "able")
    there = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    # both sides grow with the table: texts are exchanged, once; repeated rows meet in the join's partition
    return stash(there.join(able.hint("merge"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("rep", "n", "text"), "texts")


def _tokens(words: int, percent: int, share: float, bands: Bands | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            for lo, hi in _batches(texts):
                value, n = shingles(texts[lo:hi], words)
                code = (value & ~np.uint64(1)).view(np.int64)
                small, large, end = [], [], np.cumsum(n).tolist()
                for e, k in zip(end, n.tolist(), strict=True):
                    own = code[e - k : e]
                    small.append(own if k <= SMALL else None)
                    large.append(own[: k if share >= 1 else np.searchsorted(value[e - k : e], _below(share))] | 1 if 100 * k > percent * SMALL else None)
                out = {"row": b["rep"].iloc[lo:hi].to_numpy(np.int64), "n": n, "small": small, "large": large}
                if bands is not None:
                    out["bands"] = bands(value, n)
                yield pd.DataFrame(out)

    return run


def entries(texts: DataFrame, words: int, percent: int, bands: Bands | None = None) -> DataFrame:
    """row, uni, n, tokens, own (how many of the tokens no other has) of the classes that may be linked with anything; with ``bands`` also bands."""
    kinds = "row long, n long, small array<long>, large array<long>" + (", bands array<long>" if bands else "")
    more = ["bands"] if bands else []
    for share in (2 - percent / 50, 1.0):
        found = stash(texts.mapInPandas(_tokens(words, percent, share, bands), kinds), "tokens")
        # a set whose indexed tokens may all be missing elsewhere: never seen, as its share would be halved by chance
        if share >= 1 or found.filter(F.size("large") * 100 <= (100 - percent) * F.col("n")).isEmpty():
            break
    universes = F.array(F.struct(F.lit(0).alias("uni"), F.col("small").alias("tokens")), F.struct(F.lit(1).alias("uni"), F.col("large").alias("tokens")))
    flat = found.select("row", "n", F.explode(F.filter(universes, lambda x: x["tokens"].isNotNull())).alias("u"), *more).select("row", "n", "u.*", *more)
    alone = _lonely(flat.select("row", F.explode("tokens").alias("h")), "row")
    own = stash(alone.groupBy(F.col("x").alias("row"), F.col("h").bitwiseAND(F.lit(1)).cast("int").alias("uni")).agg(F.count("*").alias("own")), "own")
    found = flat.join(own.hint("merge"), ["row", "uni"], "left").filter(_few(percent)).withColumn("own", F.coalesce("own", F.lit(0)))
    return stash(found, "entries")


def _same_id(found: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links a, b between the classes of one doc_id; None if no doc_id has unlike sets."""
    full = found.filter("n > 0").select("doc_id", F.struct("k1", "k2").alias("k"))
    twice = full.groupBy("doc_id").agg(F.min("k").alias("x"), F.max("k").alias("y")).filter("x <> y")
    twice = stash(twice.select("doc_id", "x"), "twice")
    if twice.isEmpty():
        return None
    pairs = full.join(twice.hint("merge"), "doc_id").select("k", "x").distinct()
    names = classes.select(F.struct("k1", "k2").alias("k"), "row")
    met = pairs.join(names.withColumnRenamed("row", "a").hint("merge"), "k")
    return stash(met.join(names.select(F.col("k").alias("x"), F.col("row").alias("b")).hint("merge"), "x").select("a", "b"), "same")


def labelled(found: DataFrame, classes: DataFrame, edges: DataFrame | None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``found``; ``edges``: a, b between classes, None for none."""
    more = _same_id(found, classes)
    all_ = [x for x in (edges, more) if x is not None]
    if all_:
        roots = stash(components(all_[0] if len(all_) == 1 else all_[0].unionByName(all_[1])), "roots")
        named = stash(classes.join(roots.hint("merge"), classes["row"] == roots["node"]).select("k1", "k2", "least", "root"), "named")
        least = stash(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
        named = stash(tell(named.select("k1", "k2", "root"), least, ["root"], "n", named.count()).select("k1", "k2", "component_id"), "named")
        named = classes.join(named.hint("merge"), ["k1", "k2"], "left").select("k1", "k2", "size", F.coalesce("component_id", "least").alias("component_id"))
    else:
        named = classes.select("k1", "k2", "size", F.col("least").alias("component_id"))
    full = found.filter("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    out = tell(full, stash(named, "named"), ["k1", "k2"], "size", full.count()).select("doc_id", "n_shingles", "component_id")
    empty = found.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def nameless(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, component_id (null) of rows without a doc_id."""
    rows = docs.filter(F.col("doc_id").isNull()).select("doc_id", text_or_empty().alias("text"))
    count = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    lists = F.split(F.trim(F.regexp_replace(F.translate("text", UPPER, UPPER.lower()), r"[\x20\x09-\x0D]+", " ")), " ")
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), count - words + 1), lambda i: F.slice(lists, i, words)))
    n = F.when(count == 0, 0).when(count < words, 1).otherwise(F.size(own)).cast("long")
    return rows.select("doc_id", n.alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
