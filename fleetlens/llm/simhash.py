"""SimHash near duplicates found by fuzzy keys from the Golay code.

A 64-bit fingerprint has three segments: ``a`` of 22 bits, ``b`` and ``c`` of 21. The binary Golay code has 4,096 words of
23 bits, and each 23-bit number lies within 3 bits of just one. A segment, filled up with zeros, has as its *fuzzy keys*
the numbers of all codewords within 4 bits: one, or six if the nearest is 3 bits off. Two segments that differ in at most
2 bits have a fuzzy key in common: let ``w`` be nearest to the first. If both differing bits lie outside the 3 error bits,
then the five other codewords cut the remaining 20 bits into five sets of 4, and those of the sets that hold the differing
bits are within 4 bits of both; in every other case ``w`` is within 4 bits of both.

Fingerprints that differ in at most 3 bits then meet under one of seven keys, whose form depends on where the errors are:

* some segment is free of errors: ``a`` whole with ``b`` fuzzy, ``b`` whole with ``c`` fuzzy, ``c`` whole with ``a`` fuzzy.
  If ``a`` is free, ``b`` has at most 2 errors or all 3; then ``c`` is free as well, and ``a`` has none. Likewise round about.
* each segment has one error: ``a`` fuzzy with a half of ``b`` and a half of ``c``, as each has a half without errors.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import saved
from fleetlens.llm.components import components
from fleetlens.llm.shingles import mix, pieces

WORDS, SEED, MOST_BITS = 3, 42, 3
#: Bytes of a text that are hashed at once.
STEP = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

#: Fixed value: the generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101
#: (first bit, bits) of each segment, and of the halves of ``b`` and ``c``.
SEGMENTS = {"a": (0, 22), "b": (22, 21), "c": (43, 21)}
HALVES = {"b": ((22, 11), (33, 10)), "c": ((43, 11), (54, 10))}
#: Keys as (parts that must agree, segment that is fuzzy).
FAMILIES = ([((SEGMENTS[x],), SEGMENTS[y]) for x, y in ("ab", "bc", "ca")]
            + [((p, q), SEGMENTS["a"]) for p, q in itertools.product(HALVES["b"], HALVES["c"])])
#: Keys are counted in so many buckets. A bucket with more than this many rows, and more than this many times its share,
#: has its keys refined.
BUCKETS, LARGE, TIMES = 1 << 16, 4_096, 4


# Fingerprints

def _sums(norm: bytes, lengths: list[int], width: int) -> tuple[np.ndarray, int]:
    """(how many hashes have each bit, hashes) of runs of ``width`` words of a text with single blanks."""
    ends = np.cumsum(np.array(lengths) + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(norm[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(0, dtype=np.int64), len(hashes)


def fingerprint(text: bytes | None) -> int:
    """Bit k is set if more than half of the shingles' XXH64 have it; zero without words."""
    text = (text or b"").lower()  # of bytes, so A-Z only
    total, count, carry, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        cut = _BLANK.search(text, min(at + STEP, len(text)))
        end = cut.start() if cut else len(text)
        carry += text[at:end].split()
        at = end
        if len(carry) >= WORDS:
            sums, n = _sums(b" ".join(carry), list(map(len, carry)), WORDS)
            total, count, carry = total + sums, count + n, carry[1 - WORDS:]
    if not count and carry:
        total, count = _sums(b" ".join(carry), list(map(len, carry)), len(carry))
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1):
            found = map(fingerprint, part.column(1).cast(pa.binary()).to_pylist())
            bits = np.fromiter(found, np.uint64, len(part)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits)], ["id", "bits"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits) of every row's whole text; ``bits`` is the fingerprint as a signed number. Null is a text without words."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_fingerprints, T.StructType([source.schema["id"]]).add("bits", "long"))


# Golay keys

def _remainder(x: int) -> int:
    for shift in range(11, -1, -1):
        if x >> (shift + 11) & 1:
            x ^= GENERATOR << shift
    return x


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error patterns of up to 4 bits for each remainder.

    A remainder with fewer than six patterns repeats its only one.
    """
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for where in itertools.combinations(range(23), weight):
            x = sum(1 << k for k in where)
            found[low[x & 0xFFF] ^ high[x >> 12]].append(x)
    return low, high, np.array([(f * 6)[:6] for f in found], np.int64)


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``words``, number of a codeword within 4 bits) for all such codewords of 23-bit numbers."""
    low, high, patterns = _tables()
    near = words[:, None] ^ patterns[low[words & 0xFFF] ^ high[words >> 12]]
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :1]
    at, which = np.nonzero(fresh)
    return at, near[at, which] >> 11


def _part(bits: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    return (bits >> np.uint64(part[0])) & np.uint64((1 << part[1]) - 1)


@functools.cache
def _rest(family: int) -> list[int]:
    """Masks of four parts of the bits that need not agree in a family; with 3 errors at most, one part agrees."""
    exact = {k for first, n in FAMILIES[family][0] for k in range(first, first + n)}
    free = [k for k in range(64) if k not in exact]
    return [sum(1 << k for k in free[i * len(free) // 4:(i + 1) * len(free) // 4]) for i in range(4)]


def _keys(bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(family, key hashes, positions in ``bits``)."""
    for family, (exact, fuzzy) in enumerate(FAMILIES):
        value = np.full(len(bits), family, np.uint64)
        for part in exact:
            value = value << np.uint64(part[1]) | _part(bits, part)
        at, word = fuzzy_keys(_part(bits, fuzzy).astype(np.int64))
        yield family, mix(value[at] << np.uint64(12) | word.astype(np.uint64)), at


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(48)).astype(np.int64)


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, keys, _ in _keys(batch.column(0).to_numpy().view(np.uint64)):
            counts += np.bincount(_bucket(keys), minlength=BUCKETS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])


def _emit_keys(large: list[int]):
    """Rows (key, bits). A key of a large bucket is joined with one of four parts of the other bits, so it becomes four."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = np.zeros(BUCKETS, bool)
        split[large] = True
        for batch in batches:
            bits = batch.column(0).to_numpy().view(np.uint64)
            for family, keys, at in _keys(bits):
                hot = split[_bucket(keys)]
                rows = [(keys[~hot], at[~hot])]
                for i, mask in enumerate(_rest(family)):
                    finer = mix(keys[hot] ^ mix((bits[at[hot]] & np.uint64(mask)) + np.uint64(i + 1)))
                    rows.append((finer, at[hot]))
                for key, row in rows:
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bits[row].view(np.int64))], ["key", "bits"])
    return run


# Links

def _links(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints joined by pairs of equal keys within ``MOST_BITS``, each with one that stands for all it is joined to.

    Rows are sorted by key. Row i meets row i + 1, then i + 2 and so on while keys agree, all groups at once, so memory
    is a few numbers per row and n rows give fewer than n links.
    """
    root = np.arange(len(key))
    alive = root[:-1]
    for step in range(1, len(key)):
        alive = alive[alive + step < len(key)]
        alive = alive[key[alive] == key[alive + step]]
        if not len(alive):
            break
        near = np.bitwise_count(bits[alive] ^ bits[alive + step]) <= MOST_BITS
        a, b = alive[near], alive[near] + step
        while True:
            new = root[a] != root[b]
            a, b = a[new], b[new]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(key)))
    return bits[moved], bits[root[moved]]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within groups of equal keys; batches come sorted by key, and the last group of one may go on in the next."""
    def done(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = _links(*map(np.concatenate, zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        key, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if held and held[0][0][0] != key[0]:
            yield done(held)
            held = []
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield done([*held, (key[:last], bits[:last])])
            held = []
        held.append((key[last:], bits[last:]))
    if held:
        yield done(held)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the fingerprints ``bits`` of a written table of distinct ones.

    The links join just those that are joined by pairs within ``MOST_BITS``; the pairs of a group are not all given. A first pass counts keys per bucket; a bucket with more than its share is
    refined with four parts of the remaining bits, of which one must agree, so groups stay short. At most ``BUCKETS / TIMES``
    bucket numbers reach the driver.
    """
    counts = distinct.select("bits").mapInArrow(_count_keys, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = saved(counts, "keys")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = [r.bucket for r in counts.where(F.col("n") > max(LARGE, TIMES * total // BUCKETS)).collect()]
    return (distinct.select("bits").mapInArrow(_emit_keys(large), "key long, bits long")
            .repartition("key").sortWithinPartitions("key").mapInArrow(_match, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits, fingerprint, component_id) for every row of ``docs``; ``fingerprint`` is ``bits`` as 16 hex digits.

    Rows link if their fingerprints differ in at most 3 bits; ``component_id`` is the least id that links reach. Rows
    without words (null and empty texts too) have fingerprint zero and link like any other. Repeated rows and equal ids
    give a row each. A null id is no candidate for ``component_id``, which is null if none is left. An empty table gives
    an empty table. Other columns are ignored, whatever their names.

    Copies share a fingerprint, so they are counted before anything is joined. Fingerprints that more than a thousandth
    of all rows share are at most a thousand and are broadcast to their rows; the others are joined by a shuffle.
    """
    rows = saved(fingerprints(docs, id_col, text_col), "simhash")
    facts = saved(rows.groupBy("bits").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    labels = components(near_links(facts))
    placed = facts.join(labels.withColumnRenamed("node", "bits"), "bits", "left").withColumn("label", F.coalesce("label", "bits"))
    names = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    found = saved(placed.join(names, "label").select("bits", "component_id", "n"), "named")
    share = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / 1000
    often, seldom = found.where(F.col("n") > share), found.where(F.col("n") <= share)
    marked = rows.join(F.broadcast(often), "bits", "left")
    out = (marked.where("n IS NOT NULL").select("id", "bits", "component_id")
           .unionAll(marked.where("n IS NULL").select("id", "bits").join(seldom, "bits").select("id", "bits", "component_id")))
    return out.select("id", "bits", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
