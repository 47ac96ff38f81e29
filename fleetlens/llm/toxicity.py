"""Toxicity: cumulative-link ordinal regression on sparse text features.

A document has a severity grade 0 to 3. One weight per feature is shared by all grades, and ordered thresholds part
them: P(grade > k) = sigmoid(w.x - t_k). The output is the expected grade, the sum of those probabilities.

Labels only say toxic or not. A toxic training document's grade is read from how many different marked words it has:
words that the sample shows (nearly) only in toxic documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import subwords
from fleetlens.llm.common import free_name, saved
from fleetlens.llm.quality import sample_ids
from fleetlens.llm.shingles import BASE, mix

#: Most labelled documents that a model is fitted on. All documents are scored.
TRAIN_ROWS = 8000
#: Words with this share of toxic documents, and so many at least, are marked; so many marked words make a grade.
MARKED_SHARE, MARKED_DOCS, GRADE_WORDS = 0.9, 4, (0, 3, 6)
#: Documents that a feature needs, the share of clean documents that it may be in, steps and their size, and strength of the
#: absolute and the square penalty.
LEAST_DOCS, MOST_SHARE, STEPS, STEP, SPARSE, RIDGE = 3, 0.2, 200, 8.0, 1e-4, 1e-5
#: Bytes of the start of a word that are a feature too.
START = 5
#: Words of more bytes are hashed one by one.
STEPWISE = 64
THRESHOLD = 0.4


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, table row) of every whole word without marks at its ends, in lower case, of the start of every longer one, and
    of the pairs of characters of scripts with three bytes a character."""
    data, offsets = subwords.text_bytes(texts)
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = letter[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    owner = (np.searchsorted(offsets, starts, "right") - 1).astype(np.int32)
    stop = np.flatnonzero(~letter)
    ends = np.minimum(np.r_[stop, len(data)][np.searchsorted(stop, starts)], offsets[owner + 1])
    size = ends - starts
    full = np.zeros(len(starts), np.uint64)
    head = np.zeros(len(starts), np.uint64)
    live = np.arange(len(starts))
    for j in range(min(int(size.max()), STEPWISE)):
        live = live[size[live] > j]
        full[live] = full[live] * np.uint64(BASE) + data[starts[live] + j] + np.uint64(1)
        if j == START - 1:
            head[live] = full[live]
    for w in np.flatnonzero(size > STEPWISE):  # the same number for long words, each in one go
        word = data[starts[w]:ends[w]].astype(np.uint64) + np.uint64(1)
        power = np.full(len(word), BASE, np.uint64)
        power[0] = 1
        full[w] = (word * np.cumprod(power)[::-1]).sum(dtype=np.uint64)
    long = size > START
    # Scripts of three bytes a character often have no blanks between words: their pairs of characters count too.
    inner = np.flatnonzero((data[:-5] >= 0xE0) & (data[3:-2] >= 0xE0)) if len(data) > 5 else np.zeros(0, np.int64)
    of = np.searchsorted(starts, inner, "right") - 1
    inner, of = inner[inner + 6 <= ends[of]], of[inner + 6 <= ends[of]]
    pair = np.zeros(len(inner), np.uint64)
    for j in range(6):
        pair = pair * np.uint64(BASE) + data[inner + j] + np.uint64(1)
    return (np.concatenate([owner, owner[long], owner[of]]),
            subwords.slot(np.concatenate([mix(full), mix(head[long] ^ np.uint64(1 << 63)), mix(pair ^ np.uint64(1 << 62))])))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for first, texts in subwords.parts(batch.column(0)):
            owner, slots = features(texts)
            used = [np.unique(slots[owner == i]).astype(np.int32).tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(labels[first:first + len(texts)], pa.int32()), pa.array(used, pa.binary())],
                                             ["label", "used"])


def grades(labels: np.ndarray, used: list[np.ndarray]) -> np.ndarray:
    """Severity of the sample: 0 if not toxic, else 1 and one more for each further step of marked words."""
    each = np.repeat(labels, [len(u) for u in used])
    flat = np.concatenate(used)
    docs, toxic = np.bincount(flat, minlength=subwords.BUCKETS), np.bincount(flat, each, subwords.BUCKETS)
    marked = (toxic >= MARKED_DOCS) & (toxic >= MARKED_SHARE * docs)
    number = np.array([int(marked[u].sum()) for u in used])
    return np.where(labels == 1, np.searchsorted(GRADE_WORDS, number, "right"), 0).clip(0, len(GRADE_WORDS))


def fit(labels: np.ndarray, used: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(weight per table row, thresholds) by accelerated proximal gradient; most weights are 0.

    Without rows or with no toxic ones all documents get grade 0 nearly surely.
    """
    levels = len(GRADE_WORDS)
    weight = np.zeros(subwords.BUCKETS)
    if not len(labels) or not labels.any():
        return weight.astype(np.float32), np.arange(levels) + 10.0
    grade = grades(labels, used)
    flat = np.concatenate(used)
    number = np.bincount(flat, minlength=subwords.BUCKETS)
    clean = np.bincount(flat, np.repeat(labels == 0, [len(u) for u in used]), subwords.BUCKETS)
    telling = (number >= LEAST_DOCS) & (clean <= MOST_SHARE * max((labels == 0).sum(), 1))
    used = [u[telling[u]] for u in used]
    flat, owner = np.concatenate(used), np.repeat(np.arange(len(used)), [len(u) for u in used])
    above = np.stack([grade > k for k in range(levels)], 1).astype(float)
    # Start from the thresholds of the grades' shares; keep a least distance between them.
    t = np.log((len(grade) - above.sum(0) + 1) / (above.sum(0) + 1))
    ahead, pace = weight.copy(), 1.0
    for _ in range(STEPS):
        s = np.bincount(owner, ahead[flat], len(used))
        gap = 1 / (1 + np.exp(-(s[:, None] - t))) - above
        grad = np.bincount(flat, (gap.mean(1) / len(used))[owner], subwords.BUCKETS) + RIDGE * ahead
        new = ahead - STEP * grad
        new = np.sign(new) * np.maximum(np.abs(new) - STEP * SPARSE, 0)
        t = np.maximum.accumulate(t + 2.0 * gap.mean(0) + np.arange(levels) * 1e-6)
        pace, before = (1 + np.sqrt(1 + 4 * pace * pace)) / 2, pace
        ahead = new + (before - 1) / pace * (new - weight)
        weight = new
    return weight.astype(np.float32), t


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, used = [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        used += [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
    order = sorted(range(len(labels)), key=lambda i: (labels[i], used[i].tobytes()))
    weight, t = fit(np.array([labels[i] for i in order], np.int64), [used[i] for i in order])
    yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([t.tolist()], pa.list_(pa.float64()))],
                                     ["weight", "thresholds"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``TRAIN_ROWS`` labelled documents, in one task; rows with a null id, label or text are left out."""
    ids = saved(sample_ids(labels, id_col, label_col, TRAIN_ROWS), "labels")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    model = (texts.join(F.broadcast(ids), F.col("id") == F.col("_key")).select("text", "_label").mapInArrow(_extract, "label int, used binary")
             .repartition(1).mapInArrow(_fit, "weight binary, thresholds array<double>").first())
    return np.frombuffer(model["weight"], np.float32), np.array(model["thresholds"])


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         label_col: str = "toxic") -> DataFrame:
    """Rows of ``docs`` with ``_severity`` (expected grade), ``_grade`` (the likeliest), ``_score`` (P(grade > 0)), ``_toxic``.

    One row per input row; equal texts are rated alike. A null or empty text has no features and is rated by the
    thresholds alone. An empty table gives an empty table; clashing names in ``labels`` are ignored. Columns of ``docs``
    named as one of the four new ones are replaced, all others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    @F.arrow_udf("double")
    def total(texts: pa.Array) -> pa.Array:
        weight, _ = shared.value
        out = np.zeros(len(texts))
        for first, part in subwords.parts(texts):
            owner, slots = features(part)
            there = weight[slots] != 0
            pair = np.unique(owner[there].astype(np.int64) * subwords.BUCKETS + slots[there])
            out[first:first + len(part)] = np.bincount(pair // subwords.BUCKETS, weight[pair % subwords.BUCKETS], len(part))
        return pa.array(out)

    name = free_name(docs, "_total")
    over = [1 / (1 + F.exp(F.lit(float(t)) - F.col(name))) for t in shared.value[1]]
    rated = docs.withColumn(name, total(F.col(text_col)))
    shares = [1 - over[0], *[a - b for a, b in zip(over[:-1], over[1:], strict=True)], over[-1]]
    return (rated.withColumn("_severity", sum(over[1:], over[0])).withColumn("_score", over[0])
            .withColumn("_grade", (F.array_position(F.array(*shares), F.greatest(*shares)) - 1).cast("int"))
            .withColumn("_toxic", F.col("_score") >= THRESHOLD).drop(name))
