"""Word shingles of whole texts as sorted hashes, with numpy over Arrow's text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words per text); words between ASCII blanks, A-Z in lower case if ``fold``."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    if fold:
        data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < size]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    up, down = _powers(size)
    value = (data.astype(np.uint64) + np.uint64(1)) * solid * up
    hashes = mix(np.add.reduceat(value, starts) * down[starts])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` of text each, one row at least."""
    texts = batch.column(column)
    size = np.array(pc.coalesce(pc.binary_length(texts), 0), np.int64)
    group = (np.cumsum(size) - size) // most_bytes
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(size)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of every text's k-word shingles.

    A text of fewer than k words, but not none, is one shingle; one without words, or null, has none.
    """
    hashes, counts = word_hashes(pc.fill_null(texts, ""))
    ends = np.cumsum(counts)
    n = len(hashes)
    rolled = hashes[:max(n - k + 1, 0)].copy()
    for j in range(1, k):
        rolled = rolled * np.uint64(BASE) + hashes[j:j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        start = end - count
        if count >= k:
            out.append(np.unique(rolled[start:end - k + 1]))
        elif count:
            short = np.array([count], np.uint64)
            for h in hashes[start:end]:
                short = short * np.uint64(BASE) + h
            out.append(mix(short ^ np.uint64(BASE)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
