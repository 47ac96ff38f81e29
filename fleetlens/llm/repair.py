"""Re-Pair grammar compression of token ids with numpy, one shard at a time.

Frequent pairs of neighbouring symbols are replaced by new symbols, again and again, until no pair that pays for a rule
is left. A shard keeps its rules, so it can be decoded alone, and the packed length of every document, so one document can
be decoded alone.
"""

from __future__ import annotations

import numpy as np

#: The least count of a pair that pays for a rule: a rule takes 8 bytes, a replacement saves 2 at least.
LEAST = 5
#: Pairs that occur this fraction of the most frequent one's count, and of the threshold before, are replaced in one round.
STEP = 64
#: Most bits of the table in which the pairs of a round are looked up.
TABLE_BITS = 20


def _every_other(at: np.ndarray) -> np.ndarray:
    """Of ascending positions, every other one of each run of neighbours, from the left."""
    start = np.r_[True, np.diff(at) > 1][:len(at)]
    nth = np.arange(len(at))
    return (nth - np.maximum.accumulate(np.where(start, nth, 0))) % 2 == 0


def _slots(pairs: np.ndarray, bits: int) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _apart(at: np.ndarray, which: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Matches that may be replaced together: of two that overlap the more frequent pair, else every other one."""
    near = np.diff(at) == 1
    c = count[which]
    stay = np.ones(len(at), bool)
    stay[:-1] &= ~(near & (c[:-1] < c[1:]))
    stay[1:] &= ~(near & (c[1:] < c[:-1]))
    kept = np.flatnonzero(stay)
    return kept[_every_other(at[kept])]


def compress(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(packed symbols, packed length of every document, rules as rows (left, right), first symbol of a rule).

    No rule spans two documents. In the packed symbols no pair occurs ``LEAST`` times within documents, not counting
    overlaps: counts are exact, and pairs that lose their places to others are counted again in the next round.
    """
    seq = ids.astype(np.uint32)
    first = int(seq.max()) + 1 if len(seq) else 0
    ends = np.zeros(len(seq), bool)
    used = lengths[lengths > 0]
    ends[np.cumsum(used) - 1] = True
    rules: list[np.ndarray] = []
    made, least, live = 0, None, None
    while len(seq) > 1:
        # A document's last symbol starts no pair.
        places = np.flatnonzero(~ends[:-1] if live is None else live[:-1] & ~ends[:-1])
        left, right = seq[places], seq[places + 1]
        twins = places[left == right]
        if len(twins):
            counted = np.ones(len(seq), bool)
            counted[twins[~_every_other(twins)]] = False
            counted = counted[places]
            places, left, right = places[counted], left[counted], right[counted]
        if first + made <= 1 << 16:
            here = (left << np.uint32(16)) | right
        else:
            here = (left.astype(np.uint64) << np.uint64(32)) | right
        del left, right
        ordered = np.sort(here)
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][:len(ordered)])
        count = np.diff(np.r_[start, len(ordered)])
        top = int(count.max()) if len(count) else 0
        if top < LEAST:
            break
        least = max(LEAST, min(top, (least or top) // STEP))
        pick = count >= least
        found, count = ordered[start[pick]], count[pick]
        del ordered, start, pick
        rank = np.argsort(count, kind="stable")
        bits = min(TABLE_BITS, len(found).bit_length() + 5)
        slots = _slots(here, bits)
        whole = True
        while True:
            table = np.full(1 << bits, -1, np.int32)
            table[_slots(found[rank], bits)] = rank  # of pairs in one slot the most frequent
            which = table[slots]
            hit = np.flatnonzero(which >= 0)
            tried, which = places[hit], which[hit]
            same = found[which] == here[hit]
            at, which = tried[same], which[same]
            kept = _apart(at, which, count)
            at, which = at[kept], which[kept]
            del table, hit, same, kept
            good = np.bincount(which, minlength=len(found)) >= LEAST
            if good.any():
                break
            # They take each other's places: the more frequent half first, in the end one pair alone.
            rank, whole = rank[len(rank) // 2:], False
        del here, slots, places
        pays = good[which]
        at, which = at[pays], (np.cumsum(good) - 1)[which[pays]]
        seq[at] = first + made + which
        ends[at] |= ends[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        if least == LEAST and whole:
            # From here on only pairs with a new symbol, and those that lost their places, can occur often enough. Pairs of
            # one symbol stay, as those that overlap are not counted.
            live = np.zeros(len(seq), bool)
            live[tried] = live[twins] = True
            live = live[stay]
        else:
            live = None
        seq, ends = seq[stay], ends[stay]
        if live is not None:
            new = seq >= first + made
            live |= new
            live[:-1] |= new[1:]
        found = found[good]
        half = found.dtype.type(found.dtype.itemsize * 4)
        rules.append(np.stack([found >> half, found & found.dtype.type((1 << int(half)) - 1)], 1).astype(np.uint32))
        made += len(found)
    packed = np.zeros(len(lengths), np.int64)
    packed[lengths > 0] = np.diff(np.r_[-1, np.flatnonzero(ends)])
    return seq, packed, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), first


class Grammar:
    """Expands packed symbols."""

    def __init__(self, rules: np.ndarray, first: int):
        # Rules that refer only to symbols before the first of them are expanded together.
        rules = rules.astype(np.int64)
        reach = np.maximum.accumulate(rules.max(axis=1)) if len(rules) else np.zeros(0, np.int64)
        steps = [0]
        while steps[-1] < len(rules):
            steps.append(int(np.searchsorted(reach, first + steps[-1])))
        size = np.ones(first + len(rules), np.int64)
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            size[first + a:first + b] = size[rules[a:b]].sum(axis=1)
        self.size = size
        self.start = np.cumsum(size) - size
        self.flat = np.arange(int(size.sum()), dtype=np.uint32)
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            s = int(self.start[first + a])
            made = self.expand(rules[a:b].reshape(-1))
            self.flat[s:s + len(made)] = made

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        shift = self.start[symbols] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(int(size.sum()))]
