"""Ranked lexical search on K2-treaps.

An index is a table of shards. A shard is a grid of terms (rows) and documents (columns, in id order) whose points are
impacts, the part of a score that does not depend on how rare the term is. Rows are in order of document frequency, so that
rare terms lie together, and in bands of 64. Each band is a quadtree: a cell splits in four while it is more than one row
high, then its columns in two. A cell stores the greatest impact in it, as the difference to that of the cell above, and a
mask of the quarters that are not empty; a cell with one point stores the point and has nothing below.

A query goes down all its terms' row paths at once, over one range of documents after the other: a range's bound is the sum
over the terms of weight times greatest impact in the cell that the term's path has reached. The ranges with the greatest
bounds are halved first; a range below the k-th score found so far is left out whole. At one document the bound is its score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import fresh_path, saved
from fleetlens.llm.shingles import mix, pieces

#: Fixed values of the score: thousandths of a weight, of an impact, and the two shares of a document's length.
WEIGHT, IMPACT, SATURATION, LENGTH_PERCENT = 1000, 1_000_000_000, 8, 90
#: Rows of a band, and their bits.
BAND, BAND_BITS = 64, 6
#: Points after which a shard is closed.
SHARD_POINTS = 500_000
#: Ranges that are halved in one step, and terms of the queries that are searched in one pass over the index.
STEP, PASS_TERMS = 128, 1_000_000
TOP = 10

_WORD = np.zeros(256, np.uint64)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORD[_c] = _c
for _c in range(0x41, 0x5B):
    _WORD[_c] = _c + 32
_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(0, np.uint64)}
_SPREAD = np.array([sum((x >> k & 1) << (2 * k) for k in range(BAND_BITS)) for x in range(BAND)], np.int64)
_ONES = np.array([x.bit_count() for x in range(16)], np.int32)


# Terms

def _starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, zero between terms; first byte of every term; terms before each text and at the end)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    data = _WORD[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    solid = data > 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    return data, starts, np.searchsorted(starts, offsets)


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every term of texts without nulls, terms before each text and at the end)."""
    data, starts, before = _starts(texts)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    if len(_powers["up"]) < len(data):
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(len(data), 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return mix(np.add.reduceat(data * _powers["up"][:len(data)], starts) * _powers["down"][starts]), before


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for part in pieces(batch, 0):
            n = np.diff(_starts(part.column(0).fill_null(""))[2])
            docs, terms = docs + int(np.count_nonzero(n)), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])


# Shards

class Shard:
    """A K2-treap for each band of rows. Cells are numbered level by level; level 0 has one cell per band."""

    def __init__(self, terms, rows, counts, depth, masks, drops, point_doc, point_row):
        self.terms, self.rows, self.counts, self.depth = terms, rows, counts, depth
        self.mask = masks
        children = _ONES[masks].astype(np.int64)
        bands = (len(terms) + BAND - 1) // BAND
        self.child = bands + np.cumsum(children) - children
        # Impacts come back from the differences, level by level.
        self.best = drops.astype(np.int64)
        low, high = 0, bands
        while high < len(masks):
            n = int(children[low:high].sum())
            self.best[high:high + n] = np.repeat(self.best[low:high], children[low:high]) - drops[high:high + n]
            low, high = high, high + n
        # Cells of one point: its document and row; -1 for all other cells.
        self.doc = np.full(len(masks), -1, np.int64)
        self.row = np.full(len(masks), -1, np.int64)
        single = masks == 0
        self.doc[single], self.row[single] = point_doc, point_row

    @staticmethod
    def build(terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> dict:
        """The stored arrays of a grid of points (term hash, document number, impact), no point twice."""
        names, row, counts = np.unique(terms, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rows = np.empty(len(names), np.int64)
        rows[order] = np.arange(len(names))
        row = rows[row]
        depth = max(BAND_BITS, (n_docs - 1).bit_length())
        tail = depth - BAND_BITS
        path = _SPREAD[row % BAND] << 1 | _SPREAD[docs >> tail]
        key = (row // BAND) << (2 * BAND_BITS) | path
        key = key << tail | docs & ((1 << tail) - 1)
        order = np.argsort(key)
        key, impacts, docs, row = key[order], impacts[order], docs[order], row[order]

        masks, drops, point_doc, point_row = [], [], [], []
        above = above_best = None
        for level in range(depth + 1):
            shift = depth - level if level >= BAND_BITS else tail + 2 * (BAND_BITS - level)
            cell = key >> shift
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            size = np.diff(np.r_[first, len(cell)])
            best = np.maximum.reduceat(impacts, first)
            masks.append(np.zeros(len(first), np.uint8))
            if level:
                step = 2 if level <= BAND_BITS else 1
                parent = np.searchsorted(above, cell[first] >> step)
                np.bitwise_or.at(masks[-2], parent, (1 << (cell[first] & (1 << step) - 1)).astype(np.uint8))
                drops.append(above_best[parent] - best)
            else:
                drops.append(best)
            single = size == 1
            point_doc.append(docs[first[single]])
            point_row.append(row[first[single]])
            # Only cells of several points go on.
            keep = np.repeat(~single, size)
            above, above_best = cell[first], best
            key, impacts, docs, row = key[keep], impacts[keep], docs[keep], row[keep]
            if not len(key):
                break
        join = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes()
        return {"terms": names.tobytes(), "term_rows": rows.astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes(),
                "depth": depth, "masks": join(masks, np.uint8), "drops": join(drops, np.int32),
                "point_docs": join(point_doc, np.int32), "point_rows": join(point_row, np.int32)}

    @staticmethod
    def load(row: dict) -> Shard:
        read = lambda name, kind: np.frombuffer(row[name], kind)
        return Shard(read("terms", np.uint64), read("term_rows", np.int32).astype(np.int64), read("counts", np.int32), row["depth"],
                     read("masks", np.uint8), read("drops", np.int32), read("point_docs", np.int32), read("point_rows", np.int32))

    def halved(self, cells: np.ndarray, level: np.ndarray, start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the left and the right half of document ranges, -1 where empty; ``cells`` is ranges x terms."""
        size = (1 << (self.depth - level - 1))[:, None]
        inside, one = cells >= 0, self.row[cells] >= 0
        bit = np.where(level[:, None] < BAND_BITS, rows[None, :] >> np.maximum(BAND_BITS - 1 - level, 0)[:, None] & 1, 0)
        mask, child = self.mask[cells].astype(np.int64), self.child[cells]
        here = inside & one & (self.row[cells] == rows)
        out = []
        for half in (0, 1):
            slot = bit << 1 | half
            below = np.where(inside & ~one & (mask >> slot & 1 > 0), child + _ONES[mask & ((1 << slot) - 1)], -1)
            middle = start[:, None] + half * size
            doc = self.doc[cells]
            out.append(np.where(here & (doc >= middle) & (doc < middle + size), cells, below))
        return out[0], out[1]

    def bounds(self, cells: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Greatest possible score in the range that each line of cells stands for."""
        row = self.row[cells]
        fits = (cells >= 0) & ((row < 0) | (row == rows))
        return np.where(fits, self.best[cells], 0) @ weights

    def search(self, hashes: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: list, k: int) -> None:
        """Merge this shard's documents into ``best``, a heap of at most k (score, order of id descending, id).

        ``ids`` are the ids that are not null, ascending; documents without an id come after those.
        """
        at = np.searchsorted(self.terms, hashes)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == hashes[known]
        rows, weights = self.rows[at[known]], weights[known]

        def useful(bound: np.ndarray, start: np.ndarray) -> np.ndarray:
            if len(best) < k:
                return bound > 0
            floor, has, late = best[0]
            return (bound > floor) | (bound == floor) & (start < (np.searchsorted(ids, -late) if has else len(ids)))

        cells = (rows // BAND)[None, :]
        bound, start, level = self.bounds(cells, rows, weights), np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            keep = np.flatnonzero(useful(bound, start))
            if not len(keep):
                return
            if len(keep) > STEP:
                keep = keep[np.argpartition(-bound[keep], STEP)]
            taken, rest = keep[:STEP], keep[STEP:]
            halves = self.halved(cells[taken], level[taken], start[taken], rows)
            middle = start[taken] + (1 << (self.depth - level[taken] - 1))
            parts = [(self.bounds(c, rows, weights), s, level[taken] + 1, c) for c, s in zip(halves, (start[taken], middle), strict=True)]
            new_bound, new_start, new_level, new_cells = (np.concatenate(c) for c in zip(*parts, strict=True))
            new = useful(new_bound, new_start)
            single = np.flatnonzero(new & (new_level == self.depth))
            for i in single[np.lexsort((new_start[single], -new_bound[single]))][:k].tolist():
                doc = int(new_start[i])
                found = (int(new_bound[i]), *_late(int(ids[doc]) if doc < len(ids) else None))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            new &= new_level < self.depth
            bound = np.concatenate([bound[rest], new_bound[new]])
            start, level = np.concatenate([start[rest], new_start[new]]), np.concatenate([level[rest], new_level[new]])
            cells = np.concatenate([cells[rest], new_cells[new]])


def _late(doc_id) -> tuple[bool, int]:
    """Greater for smaller ids; a missing id comes after all others."""
    return (False, 0) if doc_id is None else (True, -doc_id)


SHARDS = ("n_docs long, doc_ids array<bigint>, terms binary, term_rows binary, counts binary, depth int, masks binary, drops binary, "
          "point_docs binary, point_rows binary")
_KINDS = {"n_docs": pa.int64(), "doc_ids": pa.list_(pa.int64()), "depth": pa.int32()}


def _index(docs: int, terms: int, most: int):
    def shard(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda h: (h[0] is None, h[0] or 0))
        sizes = [len(h[1]) for h in held]
        number = np.repeat(np.arange(len(held)), sizes)
        row = Shard.build(np.concatenate([h[1] for h in held]), number, np.concatenate([h[2] for h in held]), len(held))
        row |= {"n_docs": len(held), "doc_ids": [h[0] for h in held]}
        names = [c.split()[0] for c in SHARDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([row[n]], _KINDS.get(n, pa.binary())) for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, points = [], 0
        for batch in batches:
            for part in pieces(batch, 1):
                hashes, before = term_hashes(part.column(1).fill_null(""))
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    n = int(before[i + 1] - before[i])
                    if not n:
                        continue
                    found, tf = np.unique(hashes[before[i]:before[i + 1]], return_counts=True)
                    length = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * docs // terms
                    held.append((doc_id, found, IMPACT * tf // (1000 * tf + SATURATION * length)))
                    points += len(found)
                    if points >= most:
                        yield shard(held)
                        held, points = [], 0
        if held:
            yield shard(held)
    return run


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                points: int = SHARD_POINTS) -> str:
    """Index all terms of all whole texts and return the folder that the table of shards is written to.

    Texts are not shuffled: a task packs the documents it reads into shards of about ``points`` points, so memory is
    bounded by that and the longest document. Rows without terms (null texts too) are in no shard. Repeated rows and equal
    ids are documents of their own; null ids are indexed too. An empty table gives an empty index. Other columns are
    ignored. Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = (source.select("text").mapInArrow(_count, "docs long, terms long")
             .agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first())
    path = path or fresh_path(spark, "index")
    source.mapInArrow(_index(total.docs, total.terms, points), SHARDS).write.option("compression", "zstd").parquet(path)
    return path


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of an index, read and handed to Python one at a time, as each is large for a row.

    The batch sizes are settings, so they are set in a session of this reader's own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    own.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1")
    return own.read.schema(SHARDS).parquet(path)


# Search

def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1):
            hashes, before = term_hashes(part.column(1).fill_null(""))
            own = [np.unique(hashes[a:b]).tobytes() for a, b in zip(before[:-1], before[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["item_id", "terms"])


def _frequencies(asked: np.ndarray):
    """(place in ``asked``, documents with that term), summed over the shards of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                terms, counts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int32)
                at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
                total += np.where(terms[at] == asked, counts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])
    return run


def _search(queries: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {item: [] for item, _, _ in queries}
        for batch in batches:
            for i in range(len(batch)):
                [row] = batch.slice(i, 1).to_pylist()
                shard = Shard.load(row)
                ids = np.array([i for i in row["doc_ids"] if i is not None], np.int64)
                for item, hashes, weights in queries:
                    shard.search(hashes, weights, ids, best[item], k)
        rows = [(item, -late if has else None, score) for item, found in best.items() for score, has, late in found]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (item, doc, score)], ["item", "doc_id", "score"])
    return run


def _passes(items: DataFrame) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Queries (item id, term hashes) in lists of about ``PASS_TERMS`` terms, one query at least."""
    held, size = [], 0
    for row in items.toLocalIterator():
        terms = np.frombuffer(row.terms, np.uint64)
        if held and size + len(terms) > PASS_TERMS:
            yield held
            held, size = [], 0
        held.append((row.item_id, terms))
        size += len(terms)
    if held:
        yield held


def search(spark: SparkSession, path: str, items: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of an index with a score above 0, all if fewer.

    Equal scores go by ascending doc_id, null ids last. Every row of ``items`` is a query of its own, so repeated rows give
    repeated results and a null ``item_id`` is kept; a text that is null or without terms finds nothing. An empty index or
    table of items gives an empty table. Other columns are ignored.

    Queries are searched in passes of about ``PASS_TERMS`` terms over the whole index, so one pass's terms and weights are
    all that a task holds besides one shard. A task keeps k documents per query over all its shards, and those k bound its
    later shards; they are written, and the best k of all tasks are ranked.
    """
    source = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = source.schema["item_id"]
    asked = saved(source.mapInArrow(_item_terms, T.StructType([kind]).add("terms", "binary")), "items")
    shards = _shards(spark, path)
    n_docs = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    out = None
    for block in _passes(asked):
        terms = np.unique(np.concatenate([t for _, t in block]))
        df = np.zeros(len(terms), np.int64)
        found = shards.select("terms", "counts").mapInArrow(_frequencies(terms), "term long, df long")
        for row in found.groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row.term] = row.df
        weight = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        queries = [(i, t, weight[np.searchsorted(terms, t)]) for i, (_, t) in enumerate(block)]
        target = fresh_path(spark, "found")
        (shards.withColumn("counts", F.lit(b"")).mapInArrow(_search(queries, k), "item long, doc_id long, score long")
         .write.parquet(target))
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = (spark.read.schema("item long, doc_id long, score long").parquet(target)
                  .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], T.StructType().add("item", "long").add(kind))
        ranked = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionAll(ranked)
    schema = T.StructType([kind]).add("rank", "integer").add("doc_id", "long").add("score", "long")
    return spark.createDataFrame([], schema) if out is None else out
