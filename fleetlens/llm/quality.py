"""Quality classifier: supervised subword embeddings.

Every word, pair of words and character n-gram has a learned vector in a hashed table. A document is the mean of its
vectors; a softmax layer on it gives the class. Table and layer are trained together by stochastic gradient descent. As
both are linear, a trained model is one number per table row, and scoring is the mean of those numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import subwords
from fleetlens.llm.common import saved

#: Most labelled documents that a model is fitted on, those with the least hash of their id; the fit's cost and memory
#: are bounded by it. All documents are scored.
TRAIN_ROWS = 6000
#: Character n-grams, size of a vector, passes over the sample, documents of a step, step size.
GRAMS, SIZE, EPOCHS, BATCH, RATE = (3, 4), 8, 6, 64, 0.3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training; a null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, table row) of every feature."""
    owner, words, pairs = subwords.word_grams(texts, fold=False)
    later = pairs != 0
    chars, grams = subwords.char_grams(texts, GRAMS)
    return np.concatenate([owner, owner[later], chars]), subwords.slot(np.concatenate([words, pairs[later], grams]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to table rows with their shares."""
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for first, texts in subwords.parts(batch.column(0)):
            owner, slots = features(texts)
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(texts) + 1))
            rows = []
            for i in range(len(texts)):
                used, count = np.unique(slots[order[ends[i]:ends[i + 1]]], return_counts=True)
                rows.append((labels[first + i], used.astype(np.int32).tobytes(),
                             (count / max(count.sum(), 1)).astype(np.float32).tobytes()))
            label, used, share = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(used, pa.binary()), pa.array(share, pa.binary())],
                                             ["label", "used", "share"])


def fit(labels: np.ndarray, used: list[np.ndarray], share: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """(a number per table row, bias): the log odds of label 1 are their mean over a text plus the bias.

    With one class only, or no rows, every text gets the odds of the labels seen, with one of each added.
    """
    ones = int(labels.sum())
    bias = np.array([0.0, np.log((ones + 1) / (len(labels) - ones + 1))])
    if ones in (0, len(labels)):
        return np.zeros(subwords.BUCKETS, np.float32), float(bias[1])
    rng = np.random.default_rng(0)
    table = rng.normal(0, 0.1, (subwords.BUCKETS, SIZE)).astype(np.float32)
    layer = rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32)
    seen_table, seen_layer, seen_bias = np.full(subwords.BUCKETS, 1e-8), np.full(layer.shape, 1e-8), np.full(2, 1e-8)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            some = order[k:k + BATCH]
            rows, weight = np.concatenate([used[i] for i in some]), np.concatenate([share[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(used[i]) for i in some])
            mean = np.stack([np.bincount(owner, table[rows, d] * weight, len(some)) for d in range(SIZE)], 1)
            odds = mean @ layer + bias
            p = np.exp(odds - odds.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            back = p @ layer.T  # what each document's vector should lose
            slots, place = np.unique(rows, return_inverse=True)
            down = np.stack([np.bincount(place, back[owner, d] * weight, len(slots)) for d in range(SIZE)], 1)
            seen_table[slots] += (down * down).mean(1)
            table[slots] -= (rate * down / np.sqrt(seen_table[slots])[:, None]).astype(np.float32)
            for value, grad, seen in ((layer, mean.T @ p / len(some), seen_layer), (bias, p.mean(0), seen_bias)):
                seen += grad * grad
                value -= rate * grad / np.sqrt(seen)
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, used, share = [], [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        used += [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
        share += [np.frombuffer(x, np.float32) for x in batch.column(2).to_pylist()]
    order = sorted(range(len(labels)), key=lambda i: (labels[i], used[i].tobytes()))  # the same however rows arrive
    table, bias = fit(np.array([labels[i] for i in order], np.int64), [used[i] for i in order], [share[i] for i in order])
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias])], ["table", "bias"])


def sample_ids(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """(key, label) of at most ``rows`` labelled documents that are not held out, those with the least hash of the id."""
    return (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
            .groupBy(F.col(id_col).alias("_key")).agg(F.min(label_col).cast("int").alias("_label"))
            .orderBy(F.xxhash64("_key"), "_key").limit(rows))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Fit on at most ``TRAIN_ROWS`` labelled documents, in one task; only the fitted numbers come to the driver.

    Rows with a null id, label or text, and held-out ids, are not learned from. Of several labels of an id the least
    counts; repeated documents count each time.
    """
    ids = saved(sample_ids(labels, id_col, label_col, TRAIN_ROWS), "labels")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    model = (texts.join(F.broadcast(ids), F.col("id") == F.col("_key")).select("text", "_label")
             .mapInArrow(_extract, "label int, used binary, share binary").repartition(1)
             .mapInArrow(_fit, "table binary, bias double").first())
    return np.frombuffer(model["table"], np.float32), model["bias"]


def scorer(model: tuple[np.ndarray, float], spark):
    """A column function: the probability of label 1 of a whole text; null and empty texts get the bias's."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        table, bias = shared.value
        out = np.empty(len(texts))
        for first, part in subwords.parts(texts):
            owner, slots = features(part)
            total = np.bincount(owner, table[slots], len(part))
            count = np.maximum(np.bincount(owner, minlength=len(part)), 1)
            out[first:first + len(part)] = 1 / (1 + np.exp(-(total / count + bias)))
        return pa.array(out)
    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with ``_score`` (0 to 1, higher is better), ``_good`` and ``_held_out``, one per input row.

    Scores depend on the text alone, so repeated rows and equal texts get equal scores. Null and empty texts, and all
    texts if nothing could be learned, get the odds of the labels. An empty table gives an empty table. Columns of
    ``docs`` are kept whatever their names, but for those named as the three new ones, which are replaced; those of
    ``labels`` are not looked at but for the id and the label.
    """
    score = scorer(train(docs, labels, id_col, text_col, label_col), docs.sparkSession)
    return (docs.withColumn("_score", score(F.col(text_col))).withColumn("_good", F.col("_score") >= threshold)
            .withColumn("_held_out", held_out(F.col(id_col))))
