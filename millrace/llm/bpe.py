"""Byte-level BPE by a global shuffle of distinct words.

1. *Explode.* Each task cuts its texts into pre-tokens, in chunks of documents.
   A chunk keeps, per position, the number of the pre-token in the chunk's own
   list of distinct words; this is the exploded (word, position) relation,
   stored by column and packed. Lists and positions are written once, to a table
   bucketed by chunk; only the lists are exchanged, by a hash of the word.
2. *Encode.* A word's hash brings all its lists to one place, where each
   distinct word is encoded once, however many documents hold it.
3. *Join back.* Lists of ids return to their chunks, whose positions are read in
   place; documents are reassembled by position.
4. *Decode.* Ids are looked up in the token-byte table, whose size is fixed.

A frequent word costs one list entry per chunk, so no key is hot; a task holds
one chunk (``CHUNK_CHARS``, or one longer text) and its share of the words.

Defined cases: null counts as empty text and has no tokens; special strings are
ordinary text; repeated rows are encoded each; null doc_ids stay; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh_path, n_parts, text_or_empty
from millrace.llm.packing import joined, pack, pack_ids, parted, unpack, unpack_ids
from millrace.llm.textbytes import pretokens

CHUNK_CHARS = 8 << 20
POSITIONS, WORDS = 0, 1
PACKED = "chunk long, part int, kind int, payload binary"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return out


def _chunk(number: int, ids: list, texts: list[str], pattern: str, parts: int) -> Iterator[tuple]:
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__
    lengths, positions = [], []
    for text in texts:
        found = pretokens(text, pattern)
        lengths.append(len(found))
        positions.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
    words, at = list(index), np.concatenate(positions) if positions else np.empty(0, np.int64)
    order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")  # frequent words get small numbers
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    coded = [words[i].encode("utf-8", "surrogatepass") for i in order]
    part = np.fromiter((zlib.crc32(w) % parts for w in coded), np.int64, len(coded))
    yield number, 0, POSITIONS, joined(pack_ids(ids), pack(np.array(lengths, np.int64), part, rank[at] if len(at) else at))
    by_part = np.argsort(part, kind="stable")
    for group in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1) if len(by_part) else ():
        own = [coded[i] for i in group]
        sizes = pack(np.array([len(w) for w in own], np.int64))
        yield number, int(part[group[0]]), WORDS, joined(sizes, zstandard.compress(b"".join(own), 3))


def _explode(pattern: str, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK_CHARS:
                    yield pd.DataFrame(_chunk(number, ids, texts, pattern, parts), columns=["chunk", "part", "kind", "payload"])
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield pd.DataFrame(_chunk(number, ids, texts, pattern, parts), columns=["chunk", "part", "kind", "payload"])

    return run


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path, pattern)
        known: dict[bytes, list[int]] = {}
        for b in batches:
            out = []
            for chunk, part, payload in zip(b["chunk"], b["part"], b["payload"], strict=True):
                sizes, packed = parted(payload)
                (sizes,) = unpack(sizes)
                body, at, found = zstandard.decompress(packed), 0, []
                for n in sizes.tolist():
                    word = body[at : at + n]
                    at += n
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = enc.encode_ordinary(word.decode("utf-8", "surrogatepass"))
                    found.append(ids)
                flat = np.array([i for ids in found for i in ids], np.int64)
                out.append((chunk, part, pack(np.array([len(ids) for ids in found], np.int64), flat)))
            yield pd.DataFrame(out, columns=["chunk", "part", "payload"])

    return run


def _reassemble(path: str, digest: bool):
    def run(places: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        table = token_bytes(path)
        ids, numbers = parted(places["payload"].iloc[0])
        doc_ids = unpack_ids(ids)
        lengths, part, at = unpack(numbers)
        words: list[list[int]] = [[]] * len(part)
        for p, payload in zip(coded["part"], coded["payload"], strict=True):
            sizes, flat = unpack(payload)
            ids, end = flat.tolist(), np.cumsum(sizes).tolist()
            for i, lo, hi in zip(np.flatnonzero(part == p).tolist(), [0, *end], end, strict=False):
                words[i] = ids[lo:hi]
        size = np.array([len(w) for w in words], np.int64)
        shown = [" ".join(map(str, w)) for w in words] if digest else []
        raw = [b"".join([table[i] for i in w]) for w in words]
        rows, lo = [], 0
        for doc, n in zip(doc_ids, lengths.tolist(), strict=True):
            mine = at[lo : lo + n].tolist()
            lo += n
            decoded = b"".join(map(raw.__getitem__, mine))
            row = [doc, int(size[mine].sum()) if mine else 0]
            if digest:
                ids = hashlib.sha256(" ".join(map(shown.__getitem__, mine)).encode()).hexdigest()
                rows.append((*row, ids, hashlib.sha256(decoded).hexdigest()))
            else:
                rows.append((*row, [i for w in mine for i in words[w]], decoded))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
        out = pd.DataFrame(rows, columns=names)
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return run


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded (binary) of every text.

    With ``digest``, ids_sha256 (of the decimal ids with one space between) and
    decoded_sha256 in place of the last two.
    """
    parts = n_parts(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    name = f"positions_{uuid.uuid4().hex}"
    packed = rows.mapInPandas(_explode(pattern, 4 * parts), PACKED)
    table = packed.write.partitionBy("kind").bucketBy(parts, "chunk").option("path", fresh_path(docs.sparkSession, "positions"))
    table.format("parquet").saveAsTable(name)
    packed = docs.sparkSession.table(name)
    words = packed.filter(F.col("kind") == WORDS).select("chunk", "part", "payload").repartition(parts, "part")
    coded = words.mapInPandas(_encode(vocabulary, pattern), "chunk long, part int, payload binary")
    places = packed.filter(F.col("kind") == POSITIONS).select("chunk", "payload")
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary")
    return places.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInPandas(_reassemble(vocabulary, digest), schema)
