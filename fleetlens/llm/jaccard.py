"""N-gram Jaccard join with prefix trees.

Texts are sets of word n-grams in one global order, rarest first. Two sets that are alike enough must share an n-gram in
their prefixes; sets that meet there are put into a prefix tree, and a set walks the tree, sharing the overlap found so
far with all sets under a node and leaving subtrees whose remaining lengths can no longer reach the threshold.

Steps, each written once:

1. Every text's set, in one pass. Its n-grams go, packed by ranges of their hash, to the tasks that count in how many
   different sets each occurs. Equal sets are one from here on.
2. Only a set most of whose n-grams occur elsewhere can have a partner; of the others the prefix has nothing to share.
3. The remaining sets are ordered by (frequency, hash).
4. Groups of near copies: every set is compared with one leader per group of equal minimum hashes, not with all others,
   which joins nearly all of a group in a number of comparisons in proportion to its size.
5. The prefix join: n-grams whose prefixes meet in more than one component so far give the remaining pairs.
6. Components of all links.

Step 4 only saves work: step 5 alone covers every link, and skips only pairs that are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import saved, small
from fleetlens.llm.components import components
from fleetlens.llm.shingles import mix, pieces, shingle_sets
from fleetlens.session import shuffle_partitions

#: Words of a shingle, and the threshold NUM / DEN of intersection to union.
WORDS, NUM, DEN = 5, 75, 100
#: Minimum hashes by which groups of near copies are found, and the most sets in one tree.
HASHES, TREE = 4, 64
#: Set elements are the upper 48 bits of a shingle's hash, under 16 bits of frequency.
ELEMENT_BITS = 48
BATCH_SETS = 512

PACKED = "bucket int, ids array<bigint>, sigs binary, sizes binary, counts binary, elements binary"
#: A text's facts (bucket null), or of many sets the number of their elements that other sets have too.
COUNTED = "bucket int, id bigint, sig bigint, n bigint, sigs binary, counts binary"
PARTS = "bucket int, sigs binary, sizes binary, counts binary, keys binary"
KEYED = "sig bigint, n bigint, keys binary"
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
#: Elements that a task holds before it packs them.
HELD = 1_000_000


def least_overlap(n):
    """The least overlap of a set of n with any set alike enough: NUM / DEN of n, rounded up."""
    return -(-NUM * n // DEN)


def least_common(a, b):
    """The least overlap of two linked sets of a and b: DEN * i >= NUM * (a + b - i)."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _signature(s: np.ndarray) -> int:
    return int(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in schema.split(", ")])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _ranges(buckets: int, value: np.ndarray, bits: int) -> np.ndarray:
    """The range, of so many, in which each number of so many bits lies."""
    return ((value >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(x)) + 1
    return (np.r_[0, cuts], np.r_[cuts, len(x)]) if len(x) else (cuts, cuts)


def _pack(buckets: int, wanted: bool):
    """Texts to packed elements by hash range, and (unless wanted) to one row of the texts' own facts."""
    def flush(ids, sigs, sets, number):
        sig, size = np.array(sigs, np.int64), np.array([len(s) for s in sets], np.uint32)
        rows = [] if wanted else [(number % buckets, ids, sig.tobytes(), size.tobytes(), None, None)]
        _, once = np.unique(sig, return_index=True)
        once = once[size[once] > 0]
        if len(once):
            elements = np.concatenate([sets[i] for i in once]) >> np.uint64(64 - ELEMENT_BITS)
            owner = np.repeat(np.arange(len(once), dtype=np.int32), size[once])
            bucket = _ranges(buckets, elements, ELEMENT_BITS)
            order = np.argsort(bucket, kind="stable")
            elements, owner, bucket = elements[order], owner[order], bucket[order]
            raw = elements.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            for a, b in zip(*_runs(bucket), strict=True):
                count = np.bincount(owner[a:b], minlength=len(once))
                there = np.flatnonzero(count)
                rows.append((int(bucket[a]), None, sig[once[there]].tobytes(), size[once[there]].tobytes() if wanted else b"",
                             count[there].astype(np.uint32).tobytes(), raw[a:b].tobytes()))
        return _batch(PACKED, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        ids, sigs, sets, held = [], [], [], 0
        for batch in batches:
            for part in pieces(batch, 1):
                found = shingle_sets(part.column(1), WORDS)
                asked = part.column(2).to_pylist() if wanted else [None] * len(found)
                for i, s, w in zip(part.column(0).to_pylist(), found, asked, strict=True):
                    sig = _signature(s) if len(s) else 0
                    if not wanted or sig == w:
                        ids.append(i)
                        sigs.append(sig)
                        sets.append(s)
                        held += len(s)
                if held > HELD:
                    yield flush(ids, sigs, sets, number)
                    ids, sigs, sets, held, number = [], [], [], 0, number + 1
        if ids:
            yield flush(ids, sigs, sets, number)
    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: those of packed tables are large, so a batch is not turned into Python values at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class _Bucket:
    """The elements of one hash range, every different set once."""

    def __init__(self):
        self.seen: set[int] = set()
        self.sigs, self.sizes, self.owner, self.elements = [], [], [], []

    def add(self, row: dict) -> None:
        sigs, counts = np.frombuffer(row["sigs"], np.int64), np.frombuffer(row["counts"], np.uint32)
        raw = np.frombuffer(row["elements"], np.uint8).reshape(-1, 6)
        new = np.array([s not in self.seen for s in sigs.tolist()])
        base = len(self.seen)
        self.seen.update(sigs.tolist())
        raw = raw[np.repeat(new, counts)]
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        self.elements.append(wide.reshape(-1).view("<u8"))
        self.owner.append(np.repeat(np.arange(base, base + int(new.sum()), dtype=np.int32), counts[new]))
        self.sigs.append(sigs[new])
        if row["sizes"]:
            self.sizes.append(np.frombuffer(row["sizes"], np.uint32)[new])

    def counted(self):
        """(sigs, sizes, owner, element, frequency) sorted by element."""
        elements, self.elements = np.concatenate(self.elements), []
        order = np.argsort(elements)
        elements = elements[order]
        owner, self.owner = np.concatenate(self.owner), []
        owner = owner[order]
        del order
        a, b = _runs(elements)
        sizes = np.concatenate(self.sizes) if self.sizes else None
        return np.concatenate(self.sigs), sizes, owner, elements, np.repeat((b - a).astype(np.int32), b - a)


def _buckets(batches: Iterator[pa.RecordBatch]):
    """Facts of texts as (None, row), and every bucket of a partition sorted by bucket as (bucket, None)."""
    at, held = None, _Bucket()
    for row in _each(batches):
        if row["counts"] is None:
            yield None, row
            continue
        if row["bucket"] != at and held.sigs:
            yield held, None
            held = _Bucket()
        at = row["bucket"]
        held.add(row)
    if held.sigs:
        yield held, None


def _count(buckets: int):
    """Facts of texts, and in how many of its elements here a set meets others, packed by ranges of the signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, row in _buckets(batches):
            if row is not None:
                n, sig = np.frombuffer(row["sizes"], np.uint32), np.frombuffer(row["sigs"], np.int64)
                none, no_data = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [none, pa.array(row["ids"], pa.int64()), pa.array(sig), pa.array(n.astype(np.int64)),
                     no_data, no_data], ["bucket", "id", "sig", "n", "sigs", "counts"])
                continue
            sigs, _, owner, _, number = bucket.counted()
            shared = np.bincount(owner[number > 1], minlength=len(sigs)).astype(np.uint32)
            group = _ranges(buckets, sigs.view(np.uint64), 64)
            order = np.argsort(group, kind="stable")
            order = order[shared[order] > 0]
            yield _batch(COUNTED, [(int(group[order[a]]), None, None, None, sigs[order[a:b]].tobytes(), shared[order[a:b]].tobytes())
                                   for a, b in zip(*_runs(group[order]), strict=True)])
    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of each range of signatures; the rows of a range come one after another."""
    def out(rows):
        sig, place = np.unique(np.concatenate([np.frombuffer(r["sigs"], np.int64) for r in rows]), return_inverse=True)
        count = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.bincount(place, count).astype(np.int64))], ["sig", "shared"])
    rows = []
    for row in _each(batches):
        if rows and rows[-1]["bucket"] != row["bucket"]:
            yield out(rows)
            rows = []
        rows.append(row)
    if rows:
        yield out(rows)


def _key(buckets: int):
    """Of every set the elements here that other sets have too, as frequency and hash in one number, packed as before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _ in _buckets(batches):
            sigs, sizes, owner, elements, number = bucket.counted()
            keep = number > 1
            keys = (np.minimum(number[keep], 65535).astype(np.uint64) << np.uint64(ELEMENT_BITS)) | elements[keep]
            owner = owner[keep]
            group = _ranges(buckets, sigs.view(np.uint64), 64)[owner]
            order = np.lexsort((owner, group))
            keys, owner, group = keys[order], owner[order], group[order]
            rows = []
            for a, b in zip(*_runs(group), strict=True):
                start, end = _runs(owner[a:b])
                there = owner[a:b][start]
                rows.append((int(group[a]), sigs[there].tobytes(), sizes[there].tobytes(),
                             (end - start).astype(np.uint32).tobytes(), keys[a:b].tobytes()))
            yield _batch(PARTS, rows)
    return run


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the parts of every set of a range of signatures and sorts them; sets that can have no partner go."""
    def out(rows):
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        sigs, sizes, counts, keys = read("sigs", np.int64), read("sizes", np.uint32), read("counts", np.uint32), read("keys", np.uint64)
        each = np.repeat(sigs, counts)
        order = np.lexsort((keys, each))
        keys, each = keys[order], each[order]
        n_of = dict(zip(sigs.tolist(), sizes.tolist(), strict=True))
        found = []
        for a, b in zip(*_runs(each), strict=True):
            sig = int(each[a])
            if b - a >= least_overlap(n_of[sig]):
                found.append((sig, n_of[sig], keys[a:b].tobytes()))
        return _batch(KEYED, found)
    rows = []
    for row in _each(batches):
        if rows and rows[-1]["bucket"] != row["bucket"]:
            yield out(rows)
            rows = []
        rows.append(row)
    if rows:
        yield out(rows)


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimum hashes of every set. rate: the part of a set that others have, highest for what copies were made from."""
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.frombuffer(row["keys"], np.uint64)
            element = keys & np.uint64((1 << ELEMENT_BITS) - 1)
            least = [int(mix(element * np.uint64(2 * j + 1) + np.uint64(j)).min().view(np.int64)) for j in range(HASHES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(HASHES), pa.int32()), pa.array(least), pa.array([row["sig"]] * HASHES),
                 pa.array([row["n"]] * HASHES), pa.array([len(keys) / row["n"]] * HASHES)], ["j", "least", "sig", "n", "rate"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix of every set without the elements that no other set has, which come first."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, n = np.frombuffer(row["keys"], np.uint64), row["n"]
            own = n - len(keys)
            found = keys[:max(n - least_overlap(n) + 1 - own, 0)].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.full(len(found), row["sig"])), pa.array(np.full(len(found), n)),
                 pa.array(np.arange(len(found)) + own)], ["key", "sig", "n", "pos"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets of different components that share a prefix element, within the length and position bounds.

    The rows of an element come one after another; the sets of one element are held at once as short numbers.
    """
    def pairs(rows):
        key, sig, n, pos, label = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        for i in range(1, len(sig)):
            need = least_common(n[:i], n[i])
            ok = (label[:i] != label[i]) & (np.minimum(n[:i] - pos[:i], n[i] - pos[i]) >= need) & (np.minimum(n[:i], n[i]) >= need)
            for j in np.flatnonzero(ok):
                yield max(sig[i], sig[j]), min(sig[i], sig[j])

    def out(found):
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["probe", "cand"])
    rows, found = [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "sig", "n", "pos", "label")), strict=True):
            if rows and row[0] != rows[-1][0]:
                found += pairs(rows)
                rows = []
            rows.append(row)
            if len(found) >= 50_000:
                yield out(found)
                found = []
    if rows:
        found += pairs(rows)
    yield out(found)


class PrefixTree:
    """Ordered sets as a tree: sorted, each with the length of the path that it shares with the one before."""

    STEP = 64

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.order, self.sets, self.sizes = order, [sets[i] for i in order], [sizes[i] for i in order]
        self.shared = [0]
        for a, b in zip(self.sets[:-1], self.sets[1:], strict=True):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)

    def walk(self, probe: np.ndarray, size: int) -> Iterator[int]:
        """Indexes of the sets linked with the probe of so many elements in all."""
        path = np.zeros(1, np.int64)  # overlap after 0, 1, 2, ... elements of the path walked last
        for i, (s, n, shared) in enumerate(zip(self.sets, self.sizes, self.shared, strict=True)):
            need = least_common(size, n)
            path = path[:min(shared, len(path) - 1) + 1]
            while path[-1] + len(s) - len(path) + 1 >= need and len(path) <= len(s):
                more = s[len(path) - 1:len(path) - 1 + self.STEP]
                at = np.minimum(np.searchsorted(probe, more), len(probe) - 1)
                path = np.r_[path, path[-1] + np.cumsum(probe[at] == more)]
            if len(path) == len(s) + 1 and path[-1] >= need:
                yield self.order[i]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (probe, part), the probe's own row first: links found in the tree of each group's sets."""
    def links(probe, group):
        if not group:
            return []
        tree = PrefixTree([np.frombuffer(r["keys"], np.uint64) for r in group], [r["n"] for r in group])
        return [(probe["sig"], group[i]["sig"]) for i in tree.walk(np.frombuffer(probe["keys"], np.uint64), probe["n"])]

    def out(found):
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
    probe, group, at = None, [], None
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if (row["probe"], row["part"]) != at:
                found += links(probe, group)
                probe, group, at = row, [], (row["probe"], row["part"])
            else:
                group.append(row)
                if len(group) == 4 * TREE:
                    found += links(probe, group)
                    group = []
        yield out(found)
    yield out(links(probe, group))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (probe, cand) that are linked, as (a, b). A probe with many candidates is cut into parts."""
    spark = sets.sparkSession
    parts = pairs.groupBy("probe").agg(F.ceil(F.count("*") / TREE).cast("int").alias("parts"))
    keyed = sets.select("sig", "n", "keys")
    cands = (pairs.join(parts, "probe").select("probe", F.expr("pmod(xxhash64(cand), parts)").alias("part"), "cand")
             .join(keyed, F.col("cand") == F.col("sig")).select("probe", "part", F.lit(1).alias("kind"), "sig", "n", "keys"))
    probes = (parts.join(keyed, F.col("probe") == F.col("sig"))
              .select("probe", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part"), F.lit(0).alias("kind"), "sig", "n", "keys"))
    return (probes.unionAll(cands).repartition(shuffle_partitions(spark), "probe", "part")
            .sortWithinPartitions("probe", "part", "kind").mapInArrow(_verify, "a bigint, b bigint"))


def _grouped(rows: DataFrame, then, schema: str) -> DataFrame:
    """``then`` over the rows of each bucket, which come one after another."""
    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(then, schema)


def join_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row per input row.

    component_id is the least id reachable by links, the row's own id included. A null or wordless text has an empty
    set, is linked with nothing and keeps its own id. Fewer words than a shingle are one shingle. Repeated rows are
    equal sets and so linked. Null ids count as no id: a group's id is the least id it has, null if it has none. An
    empty table gives an empty table; other columns are ignored. Texts of any length are taken whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = shuffle_partitions(docs.sparkSession)
    counted = saved(_grouped(rows.mapInArrow(_pack(buckets, False), PACKED), _count(buckets), COUNTED), "counted")
    texts = counted.where("bucket is null").select("id", "sig", "n")
    shared = _grouped(counted.where("bucket is not null"), _sum, "sig bigint, shared bigint")
    first = texts.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    chosen = saved(first.join(shared, "sig").where(f"{DEN} * shared >= {NUM} * n").select("rep", "sig"), "able")
    again = rows.join(small(chosen), F.col("id").eqNullSafe(F.col("rep"))).select("id", "text", "sig")
    parts = _grouped(again.mapInArrow(_pack(buckets, True), PACKED), _key(buckets), PARTS)
    sets = saved(_grouped(parts, _order, KEYED), "sets")

    leads = saved(sets.mapInArrow(_leads, "j int, least bigint, sig bigint, n bigint, rate double"), "leads")
    leader = saved(leads.groupBy("j", "least").agg(F.max_by(F.struct("sig", "n"), F.struct("rate", "sig")).alias("top"), F.count("*").alias("many"))
                   .where("many > 1"), "leaders")
    near = (leads.join(leader, ["j", "least"]).where("sig <> top.sig")
            .where(f"{DEN} * least(n, top.n) >= {NUM} * greatest(n, top.n)")
            .select(F.col("top.sig").alias("probe"), F.col("sig").alias("cand")).distinct())
    links = saved(verify(saved(near, "near"), sets), "links")
    labels = components(links)

    prefixes = saved(sets.mapInArrow(_prefixes, "key bigint, sig bigint, n bigint, pos bigint")
                     .join(labels.withColumnRenamed("node", "sig"), "sig", "left")
                     .withColumn("label", F.coalesce("label", "sig")), "prefixes")
    several = prefixes.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    apart = (prefixes.join(several, "key").repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key")
             .mapInArrow(_meet, "probe bigint, cand bigint").distinct())
    more = saved(verify(saved(apart, "apart"), sets), "links")
    if more.limit(1).count():
        labels = components(links.unionAll(more))

    owner = F.coalesce("label", "sig")
    group = texts.where("n > 0").groupBy("sig").agg(F.min("id").alias("first")).join(labels, F.col("sig") == F.col("node"), "left")
    least = group.groupBy(owner.alias("owner")).agg(F.min("first").alias("component"))
    named = group.select("sig", owner.alias("owner")).join(least, "owner").select("sig", "component")
    return (texts.alias("t").join(named.alias("g"), (F.col("t.sig") == F.col("g.sig")) & (F.col("t.n") > 0), "left")
            .select("t.id", F.col("t.n").alias("n_shingles"),
                    F.when(F.col("t.n") > 0, F.col("g.component")).otherwise(F.col("t.id")).alias("component_id")))
