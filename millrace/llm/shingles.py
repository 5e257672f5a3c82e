"""Word shingles of a batch of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(3).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (A-Z lower-cased, white space between), and the number of words of each text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.append(True, space[:-1]))
    ends = np.flatnonzero(inside & np.append(space[1:], True)) + 1
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    # a sum over the bytes of (value by byte) * odd**place, a place being counted from the word's start
    place = np.arange(len(data), dtype=np.int64)[inside] - np.repeat(starts, ends - starts)
    top = int(place.max()) + 1
    powers = np.cumprod(np.append(np.uint64(1), np.full(top - 1, 0x9E3779B97F4A7C15, np.uint64)), dtype=np.uint64)
    terms = mix(_BYTES[_LOWER[data[inside]]] * powers[place])
    hashes = np.add.reduceat(terms, np.append(0, np.cumsum(ends - starts)[:-1]))
    return mix(hashes + (ends - starts).astype(np.uint64)), counts


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, by text and value, and how many each text has.

    A text with fewer words than a shingle has one, of all its words; without
    words it has none.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    total = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        step = np.uint64(2 * k + 3)
        total[: max(len(hashes) - k, 0)] += mix(hashes[k:] * step) if k else hashes * step
    n = np.maximum(counts - words + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    value = mix(total[at])
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        each = []
        for i in short:
            own = hashes[starts[i] : ends[i]]
            salt = 0xD6E8FEB86659FD93 * len(own)
            each.append(mix(np.array([sum((int(mix(own[j : j + 1] + np.uint64(j + 1))[0]) for j in range(len(own))), salt) & (2**64 - 1)], np.uint64))[0])
        owner, value = np.append(owner, short), np.append(value, np.array(each, np.uint64))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])) if len(owner) else np.empty(0, bool)
    owner, value = owner[first], value[first]
    return value, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def sketches(value: np.ndarray, counts: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Fast similarity sketches: ``size`` coordinates per text (0 for texts without shingles).

    In round i every element is thrown into a bin and offers the value (i, its
    hash); a bin keeps its smallest offer. The first ``size`` rounds throw by
    hash, and the next ``size`` rounds throw everything into bin i - size, so
    every bin fills. A text is done when all its bins are full, after about
    size * log(size) / (its number of elements) rounds.
    """
    n = len(counts)
    out = np.full(n * size, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), counts)
    left = np.where(counts > 0, size, 0)
    for i in range(2 * size):
        if not len(owner):
            break
        h = mix(value + np.uint64((0x9E3779B97F4A7C15 * (2 * i + seed)) & (2**64 - 1)))
        into = (h % np.uint64(size)).astype(np.int64) if i < size else i - size
        slot = owner * size + into
        offer = (np.uint64(i) << np.uint64(53)) | (h >> np.uint64(11))
        open_ = out[slot] >= np.uint64(i) << np.uint64(53)
        if not open_.all():
            slot, offer = slot[open_], offer[open_]
        fresh = np.unique(slot[out[slot] == np.iinfo(np.uint64).max])
        np.minimum.at(out, slot, offer)
        left -= np.bincount(fresh // size, minlength=n)
        going = left[owner] > 0
        if not going.all():
            owner, value = owner[going], value[going]
    out = out.reshape(n, size)
    out[counts == 0] = 0
    return out
