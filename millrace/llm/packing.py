"""Arrays of whole numbers as compressed bytes, for columns that cross an exchange."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers (>= 0) by byte plane, alike bytes together, compressed."""
    out = []
    for a in arrays:
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
        body = zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)
        out.append(len(a).to_bytes(8, "little") + bytes([width]) + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays in ``data``, as int64."""
    out, at = [], 0
    while at < len(data):
        n, width, size = int.from_bytes(data[at : at + 8], "little"), data[at + 8], int.from_bytes(data[at + 9 : at + 17], "little")
        planes = np.frombuffer(zstandard.decompress(data[at + 17 : at + 17 + size]), np.uint8).reshape(width, n)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = planes.T
        out.append(full.view("<i8").reshape(n))
        at += 17 + size
    return out


def joined(*parts: bytes) -> bytes:
    """Several byte strings in one."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def pack_ids(ids: list) -> bytes:
    """Integers of either sign, with nulls."""
    there = np.array([i is not None and i == i for i in ids], np.int64)
    signed = np.array([int(i) if t else 0 for i, t in zip(ids, there, strict=True)], np.int64)
    return pack(there, (signed < 0).astype(np.int64), np.abs(signed))


def unpack_ids(data: bytes) -> list:
    there, negative, size = unpack(data)
    return [(-i if n else i) if t else None for t, n, i in zip(there.tolist(), negative.tolist(), size.tolist(), strict=True)]
