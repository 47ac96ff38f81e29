"""Token ids as files: encode, pack every shard with Re-Pair, write, and read back.

A token file is a Parquet file whose rows are shards: consecutive documents in the order of their ids, or of a column
that says their place, with their ids, the grammar and the packed symbols as binary columns. Spark writes and reads it, so it can lie in any store.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm import repair
from fleetlens.llm.common import fresh_path, small
from fleetlens.llm.shingles import pieces
from fleetlens.session import checkpoint_dir, shuffle_partitions

END_ID = 2
#: Ids after which a shard is closed, and words and marks that an encoder remembers.
SHARD_IDS, MEMORY = 2_000_000, 600_000
#: Bytes of text encoded at once.
PIECE = 4_000_000
SHARDS = ("part int, shard int, doc_ids array<bigint>, lengths array<bigint>, packed_lengths array<bigint>, "
          "n_ids bigint, terminals binary, rules binary, width int, symbols binary")
DECODED = "part int, shard int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"


class Encoder(dict):
    """Ids of words and of parts of words, as little-endian 32-bit numbers; a part is encoded when it is first asked for.

    The tokenizer splits at blanks before anything else, so a text's ids are those of its blank-separated words. Words of
    Latin letters are put in lower case and parted before trailing marks first, as the tokenizer itself does, so that
    their variants share one entry. Of a run of lower-case Latin letters the tokenizer makes one piece, which goes to its
    vocabulary model directly. Everything else, special tokens too, is encoded as it is.
    """

    MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Letters that the normalizer changes alone, and the lower-case ones as the pre-tokenizer hands them to the model.
        letters, self.handed = [], {}
        for c in map(chr, range(0x41, 0x250)):
            lower = c.lower()
            if c.isalpha() and len(lower) == 1 and self.tokenizer.normalizer.normalize_str(c) == lower:
                letters.append(c)
                [(self.handed[ord(lower)], _)] = self.tokenizer.pre_tokenizer.pre_tokenize_str(lower)
        self.latin = "^[" + "".join(letters) + "]+$"
        self.lower = re.compile("[" + "".join(map(chr, self.handed)) + r"]+\Z")

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part.isalpha() and part.islower():
            ids = [t.id for t in self.model.tokenize(part)]
        elif self.lower.match(part):
            ids = [t.id for t in self.model.tokenize(part.translate(self.handed))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        if len(self) >= MEMORY:
            self.clear()
        got = self[part] = array("I", ids).tobytes()
        return got

    def _parts(self, words: pa.Array) -> pa.Array:
        """Of every word two parts: its letters and the marks behind them, or all of it and nothing."""
        core = pc.ascii_rtrim(words, characters=self.MARKS)
        plain = pc.match_substring_regex(core, self.latin)
        start = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
        cut = start[:-1] + pc.if_else(plain, pc.binary_length(core), pc.binary_length(words)).to_numpy()
        at = np.r_[np.stack([start[:-1], cut], 1).ravel(), start[-1:]].astype(np.int32)
        parts = pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(at), words.buffers()[2])
        return pc.if_else(pa.array(np.repeat(plain.to_numpy(zero_copy_only=False), 2)), pc.utf8_lower(parts), parts)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; a null text has none.

        Arrow splits at ASCII blanks and numbers the different words and parts, so each is looked up once per call.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
        if not len(split):
            return []
        words = split.flatten().dictionary_encode()
        parts = self._parts(words.dictionary).dictionary_encode()
        known = pa.array([self[p] for p in parts.dictionary.to_pylist()], pa.large_binary())
        found = known.take(pa.array(parts.indices.to_numpy().reshape(-1, 2)[words.indices.to_numpy()].ravel()))
        _, offsets, data = found.buffers()
        ids = np.frombuffer(data, "<u4") if data else np.zeros(0, "<u4")
        ends = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)]
        ends = np.frombuffer(offsets, np.int64)[found.offset + 2 * ends] // 4
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that later tasks find its words again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _forget() -> None:
    """Python workers serve one stage after the other: those of a stage that encodes nothing give the words back."""
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()


@contextmanager
def _short_batches(spark: SparkSession):
    """Tables written inside exchange at most two pieces of text at a time with Python; a longer row goes alone."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(2 * PIECE))
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def _shard(part: int, number: int, doc_ids: list, lengths: list[int], data: list) -> pa.RecordBatch:
    """A shard's row. Its different ids are numbered first (``terminals``), so symbols need few bytes, and rules follow."""
    size = np.array(lengths, np.int64)
    ids = np.frombuffer(b"".join(data), "<u4")
    used = np.zeros(int(ids.max()) + 1, bool)
    used[ids] = True
    symbols, packed, rules, first = repair.compress((np.cumsum(used, dtype=np.uint32) - np.uint32(1))[ids], size)
    width = next(w for w in (2, 3, 4) if first + len(rules) <= 1 << 8 * w)
    row = [part, number, doc_ids, lengths, packed.tolist(), len(ids), np.flatnonzero(used).astype("<u4").tobytes(),
           rules.astype("<u4").tobytes(), width, symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()]
    ints, longs = pa.int32(), pa.list_(pa.int64())
    kinds = [ints, ints, longs, longs, longs, pa.int64(), pa.binary(), pa.binary(), ints, pa.binary()]
    names = [c.split()[0] for c in SHARDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


def _unpacked(row, start: int = 0, n: int | None = None) -> np.ndarray:
    """The ids of a shard, or of ``n`` of its symbols from ``start``."""
    terminals = np.frombuffer(row["terminals"], "<u4")
    grammar = repair.Grammar(np.frombuffer(row["rules"], "<u4").reshape(-1, 2), len(terminals))
    raw = np.frombuffer(row["symbols"], np.uint8).reshape(-1, row["width"])[start:None if n is None else start + n]
    symbols = np.zeros((len(raw), 4), np.uint8)
    symbols[:, :row["width"]] = raw
    return terminals[grammar.expand(symbols.reshape(-1).view("<u4"))]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4")
        doc_ids, lengths, data, total = [], [], [], 0
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                for i, ids in zip(piece.column(0).to_pylist(), coder.encode(piece.column(1)), strict=True):
                    doc_ids.append(i)
                    lengths.append(len(ids) + 1)
                    data += (ids, end)
                    total += lengths[-1]
                    if total >= SHARD_IDS:
                        yield _shard(part, number, doc_ids, lengths, data)
                        number, doc_ids, lengths, data, total = number + 1, [], [], [], 0
        if doc_ids:
            yield _shard(part, number, doc_ids, lengths, data)
    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", order_col: str | None = None) -> str:
    """Encode whole texts, end each with ``END_ID``, and write them in ascending order of ``order_col``, or of the id
    without it; returns the folder.

    ``tokenizer`` is a file that every executor can read. Null and empty texts are just ``END_ID``. Null ids come
    first. Repeated rows and equal ids are documents of their own, equal ids in text order. Rows without a place in
    ``order_col`` come last, equal places in id order. An empty table writes an empty folder. Other columns are ignored.
    Ids or places are cut into ranges, so no task gets more than its range, and a shard is closed at ``SHARD_IDS`` ids,
    so memory is bounded by that and the longest document.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/fleetlens-tokens-{uuid.uuid4().hex}"
    place = [F.col(order_col).alias("place")] if order_col else []
    order = [F.col("place").asc_nulls_last()] if order_col else []
    order += [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    shards = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *place)
              .repartitionByRange(shuffle_partitions(spark), *order[:-1])
              .sortWithinPartitions(*order)
              .mapInArrow(_encode(tokenizer), SHARDS))
    with _short_batches(spark):
        shards.write.parquet(path)
    return path


def _packed(path: str):
    """(doc_id, text_key, text) to (doc_id, text_key, ids): a byte with the width of an id, then the ids with the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        for batch in batches:
            for part in pieces(batch, 2, PIECE):
                ids = [bytes([width]) + np.append(got, END_ID).astype(f"<u{width}").tobytes() for got in coder.encode(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], ["doc_id", "text_key", "ids"])
    return run


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, ids) of every row, where it lies: packed ids take less to shuffle than texts.

    ``text_key`` is the hash of the text. A null or empty text is just ``END_ID``. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packed(tokenizer), "doc_id bigint, text_key bigint, ids binary")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _forget()
    part, number = TaskContext.get().partitionId(), 0
    doc_ids, lengths, data, total = [], [], [], 0
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = ids.as_py()
            doc_ids.append(doc_id)
            data.append(np.frombuffer(ids, f"<u{ids[0]}", offset=1).astype("<u4").tobytes())
            lengths.append(len(data[-1]) // 4)
            total += lengths[-1]
            if total >= SHARD_IDS:
                yield _shard(part, number, doc_ids, lengths, data)
                number, doc_ids, lengths, data, total = number + 1, [], [], [], 0
    if doc_ids:
        yield _shard(part, number, doc_ids, lengths, data)


def write_encoded(rows: DataFrame, order_col: str, path: str | None = None) -> str:
    """Token files of rows from ``encode_texts`` in ascending order of ``order_col``; returns the folder.

    Rows without a place come last, equal places in the order of id (null first) and text key. As in ``write_tokens``
    places are cut into ranges and shards are closed at ``SHARD_IDS`` ids. No rows write an empty folder.
    """
    spark = rows.sparkSession
    path = path or fresh_path(spark, "tokens")
    order = [F.col(order_col).asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("text_key")]
    shards = (rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
              .select("doc_id", "ids").mapInArrow(_shards, SHARDS))
    with _short_batches(spark):
        shards.write.parquet(path)
    return path


def _decode(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for batch in batches:
            for row in batch.to_pylist():
                ids = _unpacked(row)
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                view = memoryview(ids.tobytes())
                n = len(ends)
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                none = pa.nulls(n, pa.list_(pa.int64()))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int64))) if with_ids else none
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(row["lengths"], pa.int64()),
                     pa.array(crc, pa.int64()), lists],
                    [c.split()[0] for c in DECODED.split(", ")])
    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in token files; ids are null without ``with_ids``.

    ``start`` counts the ids of all documents before: those before it in its shard, of the shards before in its part
    (one window per part), and of the parts before (one row per part).
    """
    files = spark.read.schema(SHARDS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(earlier.orderBy("part")), F.lit(0)).alias("part_start"))
    inside = earlier.partitionBy("part").orderBy("shard")
    starts = (files.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("shard_start"))
              .join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("from")))
    return (files.mapInArrow(_decode(with_ids), DECODED).join(small(starts), ["part", "shard"])
            .select("doc_id", (F.col("from") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids"))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document, decoded alone: its packed symbols are cut out of the shard and only they are expanded."""
    found = spark.read.schema(SHARDS).parquet(path).where(F.array_contains("doc_ids", doc_id)).first()
    if found is None:
        return None
    k = found["doc_ids"].index(doc_id)
    start = sum(found["packed_lengths"][:k])
    return _unpacked(found, start, found["packed_lengths"][k]).tolist()
