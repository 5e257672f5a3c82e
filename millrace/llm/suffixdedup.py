"""Suffix-array dedup: remove every byte covered by a long string that also starts earlier.

A sparse suffix array over the whole table, merged from sorted runs:

1. *Sample.* In every window of ``length`` bytes the k-gram with the smallest
   hash is the anchor; equal windows have equal anchors at equal places. An
   anchor stands for a range of window starts (about 35).
2. *Filter.* Anchors whose k-gram occurs once can have no equal window. Hashes
   are exchanged (packed), and anchors of repeated k-grams are flagged.
3. *Runs.* The flagged suffixes (text from the anchor on, as far as its windows
   reach, and the text before it) are sorted per chunk of documents and
   front-coded: a suffix is its common prefix with the one before, and the rest.
4. *Merge.* A loser tree merges the runs of one hash part. Streams carry the
   common prefix with the last output; the longer one wins without a look at
   the text, and only where they are equal is text compared, behind the known
   prefix. This gives suffixes in order with the array of common prefixes.
5. *Decide.* A window is o bytes before an anchor and ``length - o`` behind it.
   Suffixes that share ``length - o`` bytes are neighbours in the array; among
   them equal o bytes before make equal windows. All but the first in document
   order are marked, and each chunk removes the bytes that marked windows cover.

A k-gram with more than ``hot`` anchors is not brought together: its windows
are sorted as suffixes of their own and dealt by their whole text, so a hot
line spreads by its surroundings, and exact copies shrink to front-coded
entries. Texts are written once, packed, to a table bucketed by chunk, which
both the run and the removal stage read without another exchange.

Order: doc_id, null last; rows repeated under one doc_id by their place in the
input. Defined cases: null counts as empty text; texts below ``length`` bytes
lose nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.common import fresh_path, n_parts, text_or_empty
from millrace.llm.packing import joined, pack, pack_ids, parted, unpack, unpack_ids
from millrace.llm.shingles import mix

PACKED = "chunk long, part int, payload binary"
COLUMNS = ["chunk", "part", "payload"]
LAST = 2**63 - 1  # the place of a null doc_id


@dataclass(frozen=True)
class SuffixParams:
    length: int = 100
    kgram: int = 24
    hot: int = 65536
    chunk_bytes: int = 8 << 20


_VALUE = np.random.default_rng(5).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _kgrams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from every place, from hashes of powers of two."""
    total, done, power, h = None, 0, 1, _VALUE[data]
    n = len(data) - k + 1
    while power <= k:
        if k & power:
            part = h[done : done + n]
            total = part if total is None else total * np.uint64(pow(_BASE, power, 1 << 64)) + part
            done += power
        if power * 2 <= k:
            h = h[:-power] * np.uint64(pow(_BASE, power, 1 << 64)) + h[power:]
        power *= 2
    return mix(total)


def _kgrams_at(data: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The same hash at some places only."""
    total = np.zeros(len(places), np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASE) + _VALUE[data[places + j]]
    return mix(total)


def anchors(data: np.ndarray, lengths: np.ndarray, p: SuffixParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, place and k-gram hash of every anchor; ``data`` holds texts one after another."""
    out: list[tuple[np.ndarray, ...]] = []
    bounds = np.cumsum(lengths)
    w, piece = p.length - p.kgram + 1, 2 << 20
    low = np.uint64((1 << 24) - 1)
    for at in range(0, len(data) - p.length + 1, piece):
        part = data[at : at + piece + p.length - 1]
        h = _kgrams(part, p.kgram)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach * 2 <= w:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < w:
            least = np.minimum(least[: len(least) - (w - reach)], least[w - reach :])
        place = (least & low).astype(np.int64)
        start = np.arange(at, at + len(place))
        inside = start + p.length <= bounds[np.minimum(np.searchsorted(bounds, start, side="right"), len(bounds) - 1)]
        change = np.append(True, (place[1:] != place[:-1]) | ~inside[:-1])
        first = np.flatnonzero(change & inside)
        last = np.flatnonzero(np.append(change[1:] | ~inside[1:], True) & inside)
        out.append((first + at, last + at, place[first] + at, h[place[first]]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    s, e, a, f = (np.concatenate(x) for x in zip(*out, strict=True))
    return s, e, a, f


def _chunks(p: SuffixParams):
    """Documents to one packed row per chunk: ids, lengths, anchors, text."""

    def close(number: int, ids: list, texts: list[bytes]) -> pd.DataFrame:
        body = b"".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        s, e, a, _ = anchors(np.frombuffer(body, np.uint8), lengths, p)
        numbers = pack(lengths, np.diff(s, prepend=0), e - s, a - s)
        return pd.DataFrame([(number, 0, joined(pack_ids(ids), numbers, zstandard.compress(body, 3)))], columns=COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                ids.append(i)
                texts.append(t.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= p.chunk_bytes:
                    yield close(number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield close(number, ids, texts)

    return run


def _opened(payload: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths, first and last window starts, places of anchors, bytes."""
    ids, numbers, body = parted(payload)
    lengths, step, reach, ahead = unpack(numbers)
    s = np.cumsum(step)
    return unpack_ids(ids), lengths, s, s + reach, s + ahead, np.frombuffer(zstandard.decompress(body), np.uint8)


def _hashes(p: SuffixParams, parts: int):
    """Chunks to their anchors' k-gram hashes, sorted, by part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, payload in zip(b["chunk"], b["payload"], strict=True):
                _, _, _, _, a, data = _opened(payload)
                if not len(a):
                    continue
                f = _kgrams_at(data, a, p.kgram)
                order = np.argsort(f)
                f = f[order]
                part = (f >> np.uint64(40)).astype(np.int64) * parts >> 24
                cuts = np.flatnonzero(np.diff(part)) + 1
                rows = []
                for own, idx in zip(np.split(f, cuts), np.split(order, cuts), strict=True):
                    where = int((int(own[0]) >> 40) * parts >> 24)
                    rows.append((chunk, where, pack(np.diff(own, prepend=np.uint64(0)), idx)))
                yield pd.DataFrame(rows, columns=COLUMNS)

    return run


def _repeated(p: SuffixParams):
    """Hash parts to the anchors (by chunk) whose k-gram occurs again: their number, and whether it is hot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, f, idx = [], [], []
        for b in batches:
            for c, payload in zip(b["chunk"], b["payload"], strict=True):
                step, own = unpack(payload)
                chunk.append(c)
                f.append(np.cumsum(step.view(np.uint64), dtype=np.uint64))
                idx.append(own)
        if not chunk:
            return
        value = np.concatenate(f)
        _, code, times = np.unique(value, return_inverse=True, return_counts=True)
        times = times[code]
        rows, lo = [], 0
        for c, own in zip(chunk, idx, strict=True):
            n = times[lo : lo + len(own)]
            lo += len(own)
            if (n > 1).any():
                rows.append((c, 0, pack(own[n > 1], (n[n > 1] > p.hot).astype(np.int64))))
        yield pd.DataFrame(rows, columns=COLUMNS)

    return run


def _prefixes(m: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before (0 for the first)."""
    out = np.zeros(len(m), np.int64)
    for lo in range(1, len(m), 1 << 15):
        hi = min(len(m), lo + (1 << 15))
        differ = m[lo:hi] != m[lo - 1 : hi - 1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
        out[lo:hi] = np.minimum(first, np.minimum(length[lo:hi], length[lo - 1 : hi - 1]))
    return out


def _ragged(m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Columns lo..hi-1 of each row, one row after another."""
    at = np.arange(m.shape[1])
    return m[(at >= lo[:, None]) & (at < hi[:, None])].tobytes()


def _runs(p: SuffixParams, parts: int):
    """A chunk and its repeated anchors to sorted, front-coded suffix runs, one per part."""
    side = p.length - p.kgram  # most bytes before an anchor

    def run(texts: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(flags):
            return pd.DataFrame([], columns=COLUMNS)
        chunk = int(texts["chunk"].iloc[0])
        ids, lengths, s, e, a, data = _opened(texts["payload"].iloc[0])
        got = [unpack(x) for x in flags["payload"]]
        idx, hot = (np.concatenate(x) for x in zip(*got, strict=True))
        cold = idx[hot == 0]
        # an item: place of the suffix, bytes before it, bytes from it, number to report, bytes from the item's window to that anchor
        place, left, right, number, shift = a[cold], (a - s)[cold], p.length - (a - e)[cold], cold, np.zeros(len(cold), np.int64)
        dealt = _kgrams_at(data, place, p.kgram)
        if (hot == 1).any():
            warm = np.sort(idx[hot == 1])
            n = (e - s)[warm] + 1
            each = np.repeat(warm, n)
            start = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + s[each]
            place, left = np.append(place, start), np.append(left, np.zeros(len(each), np.int64))
            right, number = np.append(right, np.full(len(each), p.length)), np.append(number, each)
            shift = np.append(shift, a[each] - start)
            dealt = np.append(dealt, _kgrams_at(data, start, p.length))
        bounds = np.cumsum(lengths)
        doc = np.searchsorted(bounds, place, side="right")
        begin = bounds - lengths
        doc_id = np.array([LAST if i is None else i for i in ids], np.int64)
        doc_key = doc_id.view(np.uint64) ^ np.uint64(1 << 63)
        part = (mix(dealt) % np.uint64(parts)).astype(np.int64)
        padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(p.length, np.uint8)])
        rows, raw = [], data.tobytes()
        by_part = np.argsort(part, kind="stable")
        for own in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1):
            keys = [raw[x : x + n] for x, n in zip(place[own].tolist(), right[own].tolist(), strict=True)]
            own = own[sorted(range(len(own)), key=keys.__getitem__)]
            ahead = padded[side + place[own][:, None] + np.arange(p.length)]
            behind = padded[side + place[own][:, None] - 1 - np.arange(side)]
            lcp, back = _prefixes(ahead, right[own]), _prefixes(behind, left[own])
            numbers = pack(
                lcp, right[own], back, left[own], number[own], shift[own], place[own] - begin[doc[own]],
                (doc_key[doc[own]] >> np.uint64(32)).astype(np.int64), (doc_key[doc[own]] & np.uint64(2**32 - 1)).astype(np.int64), doc[own],
            )
            bodies = [zstandard.compress(x, 3) for x in (_ragged(ahead, lcp, right[own]), _ragged(behind, back, left[own]))]
            rows.append((chunk, int(part[own[0]]), joined(numbers, *bodies)))
        return pd.DataFrame(rows, columns=COLUMNS)

    return run


def _unfold(body: bytes, lcp: np.ndarray, length: np.ndarray) -> list[bytes]:
    """Front-coded strings in full."""
    out, at, last = [], 0, b""
    for h, n in zip(lcp.tolist(), length.tolist(), strict=True):
        last = last[:h] + body[at : at + n - h]
        at += n - h
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of strings of at most ``width`` bytes, each with its common prefixes.

    Returns run, place in the run and common prefix with the string before, in
    order. A loser tree: a node keeps the loser of its match and how much that
    one shares with the winner. A string is compared from there on only.
    """
    leaves = 1
    while leaves < max(len(runs), 1):
        leaves *= 2
    bits = 8 * width
    size = [len(r[0]) for r in runs] + [0] * (leaves - len(runs))
    at = [0] * leaves
    head: list[int] = [0] * leaves  # the current string, padded, as a number
    share = [0] * leaves  # its common prefix with the last output
    for i, (strings, _) in enumerate(runs):
        if strings:
            head[i] = int.from_bytes(strings[0].ljust(width, b"\0"), "big")

    def match(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's share becomes its common prefix with the winner."""
        if at[i] >= size[i]:
            return j, i
        if at[j] >= size[j]:
            return i, j
        x, y = share[i], share[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        differ = head[i] ^ head[j]
        a, b = runs[i][0][at[i]], runs[j][0][at[j]]
        common = min((bits - differ.bit_length()) >> 3, len(a), len(b))
        if common == len(a):
            win, lose = i, j
        elif common == len(b):
            win, lose = j, i
        else:
            win, lose = (i, j) if head[i] < head[j] else (j, i)
        share[lose] = common
        return win, lose

    loser = [0] * leaves
    winner = list(range(leaves)) * 2
    for node in range(leaves - 1, 0, -1):
        winner[node], loser[node] = match(winner[2 * node], winner[2 * node + 1]) if node * 2 < leaves else match(2 * node - leaves, 2 * node + 1 - leaves)
    top = winner[1] if leaves > 1 else 0
    out_run, out_at, out_lcp = [], [], []
    for _ in range(sum(size)):
        out_run.append(top)
        out_at.append(at[top])
        out_lcp.append(share[top])
        at[top] += 1
        if at[top] < size[top]:
            strings, lcps = runs[top]
            head[top] = int.from_bytes(strings[at[top]].ljust(width, b"\0"), "big")
            share[top] = lcps[at[top]]
        node = (top + leaves) >> 1
        while node:
            top, loser[node] = match(top, loser[node])
            node >>= 1
    return out_run, out_at, out_lcp


def _marks(lcp: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, rank: np.ndarray, p: SuffixParams) -> np.ndarray:
    """For suffixes in order: which windows (o bytes before the anchor) also start earlier."""
    n, side = len(lcp), p.length - p.kgram
    marks = np.zeros((n, side + 1), bool)
    low = p.length - right  # o goes from low to left
    h, own = np.zeros(n, np.uint64), np.zeros(n, np.uint64)  # own: hash of all bytes before that count
    for o in range(1, side + 1):
        h = h * np.uint64(_BASE) + _VALUE[before[:, o - 1]]
        own[left == o] = h[left == o]
    own = mix(own)

    def earlier(items: np.ndarray, run: np.ndarray, key: np.ndarray, o: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Of items with equal run and key all but the first, and that first; bytes before are compared in full."""
        order = np.lexsort((rank[items], key, run))
        items, run, key = items[order], run[order], key[order]
        new = np.append(True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])) if len(items) else np.empty(0, bool)
        first = items[np.maximum.accumulate(np.where(new, np.arange(len(items)), 0))]
        items, first = items[~new], first[~new]
        reach = np.broadcast_to(o, (n,))[items]
        same = np.ones(len(items), bool)
        for x in range(0, len(items), 1 << 15):
            y = slice(x, x + (1 << 15))
            equal = (before[items[y]] == before[first[y]]) | (np.arange(side) >= reach[y][:, None])
            same[y] = equal.all(axis=1)
        return items[same], first[same]

    # whole ranges first: the same windows around the same anchor
    full = np.zeros(n, bool)
    for r in np.unique(right):
        items = np.flatnonzero(right == r)
        run = np.cumsum(lcp < r)[items]
        again, _ = earlier(items, run, own[items] ^ mix(left[items].astype(np.uint64) + np.uint64(1)), left)
        full[again] = True
    at = np.arange(side + 1)
    marks[full] = (at >= low[full][:, None]) & (at <= left[full][:, None])
    rest = ~full
    # an anchor that stands alone now has no equal window elsewhere
    group = np.cumsum(lcp < p.kgram)
    alone = np.bincount(group, weights=rest, minlength=int(group[-1]) + 1 if n else 1) < 2
    rest &= ~alone[group]
    rest = np.flatnonzero(rest)
    h = np.zeros(len(rest), np.uint64)
    for o in range(side + 1):
        if o:
            h = h * np.uint64(_BASE) + _VALUE[before[rest, o - 1]]
        here = (low[rest] <= o) & (o <= left[rest])
        items = rest[here]
        if len(items) > 1:
            again, _ = earlier(items, np.cumsum(lcp < p.length - o)[items], h[here], o)
            marks[again, o] = True
    return marks


def _merged(p: SuffixParams):
    """Runs of a part to marked windows by chunk."""
    side = p.length - p.kgram

    def one(chunks: list[int], payloads: list[bytes]) -> Iterator[tuple]:
        runs, befores, columns, owner = [], [], [], []
        for c, payload in zip(chunks, payloads, strict=True):
            numbers, ahead, behind = parted(payload)
            lcp, right, back, left, *others = unpack(numbers)
            runs.append((_unfold(zstandard.decompress(ahead), lcp, right), lcp.tolist()))
            strings = _unfold(zstandard.decompress(behind), back, left)
            befores.append(np.frombuffer(b"".join(x.ljust(side, b"\0") for x in strings), np.uint8).reshape(-1, side))
            columns.append([right, left, *others])
            owner.append(np.full(len(right), c, np.int64))
        run, at, lcp = merge_runs(runs, p.length)
        base = np.cumsum([0, *(len(r[0]) for r in runs)])
        del runs
        order = base[np.array(run, np.int64)] + np.array(at, np.int64)
        right, left, number, shift, place, high, low, doc = (np.concatenate(x)[order] for x in zip(*columns, strict=True))
        owner, before = np.concatenate(owner)[order], np.concatenate(befores)[order]
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((place, doc, owner, low, high))] = np.arange(len(order))
        marks = _marks(np.array(lcp, np.int64), left, right, before, rank, p)
        some = marks.any(axis=1)
        marks, owner, number, shift = marks[some], owner[some], number[some], shift[some]
        by_chunk = np.argsort(owner, kind="stable")
        for own in np.split(by_chunk, np.flatnonzero(np.diff(owner[by_chunk])) + 1) if len(by_chunk) else ():
            bits = zstandard.compress(np.packbits(marks[own], axis=1).tobytes(), 3)
            yield int(owner[own[0]]), 0, joined(pack(number[own], shift[own]), bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunks, payloads = None, [], []
        for b in batches:
            for c, part, payload in zip(b["chunk"].tolist(), b["part"].tolist(), b["payload"], strict=True):
                if part != key:
                    if chunks:
                        yield pd.DataFrame(one(chunks, payloads), columns=COLUMNS)
                    key, chunks, payloads = part, [], []
                chunks.append(c)
                payloads.append(payload)
        if chunks:
            yield pd.DataFrame(one(chunks, payloads), columns=COLUMNS)

    return run


def _removed(p: SuffixParams, digest: bool):
    """A chunk and its marked windows to its documents without the covered bytes."""
    side = p.length - p.kgram

    def run(texts: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for payload in texts["payload"]:
            ids, lengths, _, _, a, data = _opened(payload)
            starts = [np.empty(0, np.int64)]
            for x in marks["payload"]:
                numbers, bits = parted(x)
                number, shift = unpack(numbers)
                got = np.unpackbits(np.frombuffer(zstandard.decompress(bits), np.uint8).reshape(len(number), -1), axis=1, count=side + 1)
                i, o = np.nonzero(got)
                starts.append((a[number[i]] - shift[i] - o).astype(np.uint32 if len(data) < 1 << 32 else np.int64))
            cover = np.zeros(len(data) + p.length, np.int8)
            cover[np.concatenate(starts).astype(np.int64)] = 1  # a window start, once
            cover[p.length :] -= cover[: len(data)].copy()
            del starts
            gone = np.cumsum(cover[: len(data)], dtype=np.int32) > 0
            lo = 0
            for i, n in zip(ids, lengths.tolist(), strict=True):
                own, mine = data[lo : lo + n], gone[lo : lo + n]
                lo += n
                spans = int(np.count_nonzero(mine[1:] & ~mine[:-1]) + mine[:1].sum())
                kept = own[~mine].tobytes()
                rows.append((i, n, int(mine.sum()), spans, hashlib.sha256(kept).hexdigest() if digest else kept))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return run


def remove_repeats(docs: DataFrame, params: SuffixParams | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary; with ``digest`` kept_sha256) of every row."""
    p = params or SuffixParams()
    spark = docs.sparkSession
    buckets = n_parts(spark)
    parts = 4 * buckets
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    packed = rows.mapInPandas(_chunks(p), PACKED)
    packed.write.bucketBy(buckets, "chunk").option("path", fresh_path(spark, "texts")).format("parquet").saveAsTable(name)
    texts = spark.table(name)
    hashes = texts.select("chunk", "payload").mapInPandas(_hashes(p, parts), PACKED).repartition(buckets, "part")
    flags = hashes.mapInPandas(_repeated(p), PACKED)
    runs = texts.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(_runs(p, parts), PACKED)
    runs = runs.repartition(buckets, "part").sortWithinPartitions("part")
    marks = runs.mapInPandas(_merged(p), PACKED)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")
    return texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInPandas(_removed(p, digest), schema)


#: Every 100-byte window by its hash, in hexadecimal; for tables of a few MB.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, p, substr(h, 2000 * p + 1, 2200) AS h FROM (SELECT r, h, unnest(range(0, (length(h) + 1999) // 2000)) AS p FROM d)),
w AS (SELECT r, 1000 * p + i AS i, hash(substr(h, 2 * i + 1, 200)) AS k
      FROM (SELECT r, p, h, unnest(range(0, greatest(0, least(1000, length(h) // 2 - 99)))) AS i FROM p)),
m AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS x FROM w) WHERE x > 1),
g AS (SELECT r, i, sum(CASE WHEN i > before + 100 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g
      FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM m)),
s AS (SELECT r, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY r, g),
t AS (SELECT s.r, lo, hi, substr(h, 2 * coalesce(lag(hi) OVER (PARTITION BY s.r ORDER BY lo), 0) + 1,
                                 2 * (lo - coalesce(lag(hi) OVER (PARTITION BY s.r ORDER BY lo), 0))) AS kept FROM s JOIN d ON d.r = s.r),
o AS (SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY lo) AS kept, max(hi) AS hi FROM t GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(hi, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN o USING (r)
"""
