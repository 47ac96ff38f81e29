"""Hashed word and character n-gram features of whole texts, with numpy over Arrow's text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fleetlens.llm.shingles import BASE, mix, pieces, word_hashes

BITS = 18
BUCKETS = 1 << BITS


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(row, texts) of a column in parts of a few megabytes; nulls are empty."""
    row = 0
    for piece in pieces(pa.RecordBatch.from_arrays([pc.fill_null(texts, "")], ["text"]), 0):
        yield row, piece.column(0)
        row += piece.num_rows


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def char_grams(texts: pa.Array, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every n-gram of bytes that has no blank inside; a blank at its end marks a word's end."""
    data, offsets = text_bytes(texts)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    wide = np.where(blank, np.uint64(32), data.astype(np.uint64))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    owners, hashes = [], []
    for n in sizes:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code, inner = wide[:m].copy(), np.zeros(m, bool)
        for j in range(1, n):
            code = code << np.uint64(8) | wide[j:j + m]
            if j < n - 1:
                inner |= blank[j:j + m]
        ok = ~inner & (owner[:m] == owner[n - 1:])
        owners.append(owner[:m][ok])
        hashes.append(mix(code[ok] + np.uint64(n << 56)))
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)


def word_grams(texts: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash of each word, hash of each pair with the word before; 0 at a text's first word)."""
    words, counts = word_hashes(texts, fold)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    pairs = np.zeros(len(words), np.uint64)
    if len(words):
        same = owner[1:] == owner[:-1]
        pairs[1:] = np.where(same, mix(words[1:] * np.uint64(BASE) + words[:-1]), 0)
        # A word that repeats the one before makes one and the same pair, whatever the word.
        pairs[1:][same & (words[1:] == words[:-1])] = mix(np.array([BASE], np.uint64))[0]
    return owner, words, pairs
