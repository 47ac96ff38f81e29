"""Line dedup by winnowing: repeated runs of words are found wherever they lie in the lines, and cut out.

Lines of real texts hold up to thousands of words, so the units that are hashed lie inside lines too: every run of
``UNIT`` words, over line ends, is a unit. Of every window of ``WINDOW`` units the least hash is kept with its position;
two texts that share ``LEAST_WORDS`` words share a whole window and so a kept hash. Kept hashes are joined with their
first place. Each hit is then extended both ways, word by word, by the words around the first place, and what agrees over
``LEAST_WORDS`` words or more is deleted from the later text. No pair of two later places is made.

A hash is compared with its first place only, where a run may end earlier than at a later one. Runs of whole lines are
therefore looked up exactly as well: a window is a shortest run of lines with at least ``LEAST_WORDS`` words that starts, or
ends, at some line, and equal windows have one first place. What either way finds is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import free_name, saved, small
from fleetlens.llm.shingles import BASE, mix, pieces, word_hashes

LEAST_WORDS = 50
#: Words of a unit, and units of a window: a window is ``LEAST_WORDS`` words.
UNIT = 32
WINDOW = LEAST_WORDS - UNIT + 1
#: Words on each side of a hit that are compared: any run that holds the hit shows its least length within them, and
#: the next hit of a longer run lies nearer.
MARGIN = LEAST_WORDS + WINDOW
#: Hits on one diagonal are compared together within so many words.
BLOCK = 1024
#: Hits on one earlier text that one task compares.
HITS = 5000
#: A line that stays loses only stretches of so many words or more, so that chance neighbours of a run do not go with it.
CUT_WORDS = 8
PRINTS = "id bigint, text_key bigint, doc bigint, prints array<bigint>, places array<int>, words binary"
_SOLID = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by doubling: two overlapping halves make a window."""
    size = 1
    while 2 * size <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[:len(values) - (width - size)], values[width - size:]) if width > size else values


def _rolled(hashes: np.ndarray) -> np.ndarray:
    """Hash of the ``UNIT`` words from every word on (a power of two)."""
    size, power = 1, BASE
    while size < UNIT:
        hashes = hashes[:-size] * np.uint64(power) + hashes[size:]
        size, power = 2 * size, power * power % (1 << 64)
    return mix(hashes)


def _thinned(prints: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indexes without most of a text's own periodic repeats: of equal hashes within a window of each other, one in every
    window, the first and the last stay."""
    order = np.lexsort((at, prints))
    h, p = prints[order], at[order]
    starts = np.r_[True, (h[1:] != h[:-1]) | (np.diff(p) >= WINDOW)]
    step = (p - p[np.maximum.accumulate(np.where(starts, np.arange(len(p)), 0))]) // WINDOW
    keep = starts | np.r_[starts[1:], True] | np.r_[True, step[1:] != step[:-1]]
    return np.sort(order[keep])


def winnow(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept hash, its word) for word hashes of several texts one behind the other; no window spans two texts."""
    ends = np.cumsum(counts)
    if len(hashes) < LEAST_WORDS:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    units = _rolled(hashes)
    least = _sliding(units, WINDOW, np.minimum)
    left = np.repeat(ends, counts)[:len(least)] - np.arange(len(least))  # words from here to the text's end
    least = np.where(left >= LEAST_WORDS, least, np.uint64(0))
    # A unit is kept if it is the least of a window that it lies in; no window's least is above it.
    edge = np.zeros(WINDOW - 1, np.uint64)
    most = _sliding(np.r_[edge, least, edge], WINDOW, np.maximum)
    at = np.flatnonzero(most == units)
    keep = _thinned(units[at] ^ mix(np.searchsorted(ends, at, "right").astype(np.uint64)), at)
    return units[at[keep]], at[keep]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PRINTS.split(", ")]
    for batch in batches:
        for part in pieces(batch, 3):
            hashes, counts = word_hashes(part.column(3), fold=False)
            prints, at = winnow(hashes, counts)
            ends = np.cumsum(counts)
            cuts = np.searchsorted(at, np.r_[0, ends])
            starts = ends - counts
            own = (at - np.repeat(starts, np.diff(cuts))).astype(np.int32)
            some = np.flatnonzero(np.diff(cuts))
            if not len(some):
                continue
            rows = part.take(pa.array(some))
            short = (hashes >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2),
                 pa.array([prints[cuts[i]:cuts[i + 1]].view(np.int64) for i in some], pa.list_(pa.int64())),
                 pa.array([own[cuts[i]:cuts[i + 1]] for i in some], pa.list_(pa.int32())),
                 pa.array([short[starts[i]:ends[i]].tobytes() for i in some], pa.binary())], names)


def _runs(flags: np.ndarray) -> np.ndarray:
    """(first, end) of every run of true values."""
    framed = np.zeros(len(flags) + 2, bool)
    framed[1:-1] = flags
    return np.flatnonzero(framed[1:] != framed[:-1]).reshape(-1, 2)


def repeated_words(short: np.ndarray, spans: list[tuple[int, bytes]]) -> np.ndarray:
    """Which words agree with earlier texts: each span is (first word, the earlier text's words from there on)."""
    covered = np.zeros(len(short) + 1, np.int32)
    for low, other in spans:
        theirs = np.frombuffer(other, "<u2")
        mine = short[low:low + len(theirs)]
        for a, b in _runs(mine == theirs[:len(mine)]).tolist():
            if b - a >= LEAST_WORDS:
                covered[low + a] += 1
                covered[low + b] -= 1
    return np.cumsum(covered[:-1]) > 0


def cut(text: str, gone: np.ndarray, lines: set[int]) -> tuple[list[int], int, str]:
    """(indexes of removed lines, words cut out of the others, the text that stays) without some words and whole lines."""
    removed, inside, kept, word, pending = [], 0, [], 0, []
    for i, line in enumerate(text.encode().split(b"\n")):
        words = len(line.split())  # bytes are split at the same blanks
        mine = gone[word:word + words]
        word += words
        if not words:
            pending.append((i, line))
            continue
        lost = np.count_nonzero(mine)
        whole = i in lines or lost == words
        # Blank lines between two removed lines go with them.
        if whole and removed and pending and removed[-1] == pending[0][0] - 1:
            removed += [j for j, _ in pending]
        else:
            kept += [x for _, x in pending]
        pending = []
        if whole:
            removed.append(i)
            continue
        # Where words lie is looked up only in lines that may lose some.
        if lost >= CUT_WORDS:
            spots = _runs(_SOLID[np.frombuffer(line, np.uint8)])
            for a, b in _runs(mine)[::-1].tolist():
                if b - a >= CUT_WORDS:
                    inside += b - a
                    line = line[:spots[a, 0]] + line[spots[b, 0] if b < words else spots[b - 1, 1]:]
        kept.append(line)
    return removed, inside, b"\n".join(kept + [x for _, x in pending]).decode()


WINDOWS = "id bigint, text_key bigint, print bigint, content bigint, start int, stop int"


def windows(text: str) -> list[tuple[int, int, int, int]]:
    """(least line hash, hash of the content, first line, last line) of every window of whole lines; blank lines are passed over.

    Lines are compared without blanks at their ends.
    """
    place, hashes, words = [], [], [0]
    for i, line in enumerate(text.split("\n")):
        line = line.strip()
        if line:
            place.append(i)
            hashes.append(xxhash.xxh64_intdigest(line.encode()))
            words.append(words[-1] + len(line.split()))
    total, n = np.array(words), len(place)
    if total[-1] < LEAST_WORDS:
        return []
    raw = np.array(hashes, "<u8")
    data = raw.tobytes()
    # Shortest windows that start at a line, and that end at one.
    last = np.searchsorted(total, total[:-1] + LEAST_WORDS).tolist()
    first = (np.searchsorted(total, total[1:] - LEAST_WORDS, "right") - 1).tolist()
    pairs = {(i, j) for i, j in enumerate(last) if j <= n} | {(i, j + 1) for j, i in enumerate(first) if i >= 0}
    signed = raw.view("<i8").tolist()
    # The least is that of the unsigned hashes.
    least = lambda i, j: signed[i] if j == i + 1 else signed[min(range(i, j), key=hashes.__getitem__)]
    return [(least(i, j), xxhash.xxh64_intdigest(data[8 * i:8 * j]) - (1 << 63), place[i], place[j - 1])
            for i, j in sorted(pairs)]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    for batch in batches:
        rows = []
        for i, key, text in zip(*(batch.column(c) for c in range(3)), strict=True):
            i, key = i.as_py(), key.as_py()
            rows += [(i, key, *w) for w in windows(text.as_py())]
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


CUT = "struct<removed: array<int>, inside: int, kept: string>"


def _cut_texts(texts: pa.Array, spans: pa.Array, lines: pa.Array) -> pa.Array:
    """``cut`` of texts with spans; a null text gives null."""
    out = []
    for part in pieces(pa.RecordBatch.from_arrays([texts, spans, lines], ["text", "spans", "lines"]), 0, 3_000_000):
        text = part.column(0)
        hashes, counts = word_hashes(pc.fill_null(text, ""), fold=False)
        short = (hashes >> np.uint64(48)).astype("<u2")
        # Rows' parts of the flat arrays: words, spans and lines.
        cuts = [np.r_[0, np.cumsum(n)].tolist() for n in (counts, *(pc.fill_null(pc.list_value_length(part.column(c)), 0) for c in (1, 2)))]
        low, theirs = (x.to_pylist() for x in part.column(1).flatten().flatten())
        whole = part.column(2).flatten().to_pylist()
        for i, valid in enumerate(text.is_valid().to_pylist()):
            if not valid:
                out.append(None)
                continue
            w, f, g = (slice(c[i], c[i + 1]) for c in cuts)
            gone = repeated_words(short[w], list(zip(low[f], theirs[f], strict=True)))
            out.append(dict(zip(("removed", "inside", "kept"), cut(text[i].as_py(), gone, set(whole[g])), strict=True)))
    return pa.array(out, pa.struct([("removed", pa.list_(pa.int32())), ("inside", pa.int32()), ("kept", pa.string())]))


def repeated_lines(rows: DataFrame) -> DataFrame:
    """(doc, line) of every line in a window of whole lines that stands earlier, for rows (id, text_key, doc, text)."""
    found = saved(rows.select("id", "text_key", "text").mapInArrow(_windows, WINDOWS), "windows")
    place = ["print", "content"]
    repeated = saved(found.groupBy(*place).agg(F.count("*").alias("places")).where("places > 1"), "repeated")
    hits = saved(found.join(repeated.drop("places"), place), "whole")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "start", "stop")
    firsts = saved(hits.groupBy(*place).agg(F.min(order).alias("first")), "first")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))
    return (hits.join(firsts, place).where(~same | (F.col("start") > F.col("first.stop")))
            .select(F.xxhash64("id", "text_key").alias("doc"), F.explode(F.sequence("start", "stop")).alias("line")).distinct())


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc, span): the words around the first place of every hit, laid beside the document's own, for rows as above."""
    found = saved(rows.mapInArrow(_prints, PRINTS), "prints")
    marks = found.select("id", "text_key", "doc", F.explode(F.arrays_zip("prints", "places")).alias("m")).select(
        "id", "text_key", "doc", F.col("m.prints").alias("print"), F.col("m.places").alias("place"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "place", "doc")
    # The first place of every hash that has two; repeated rows are one document.
    firsts = saved(marks.groupBy("print").agg(F.min(order).alias("f"), F.max(order).alias("last")).where("f <> last")
                   .select("print", F.col("f.doc").alias("first_doc"), F.col("f.place").alias("first_place")), "firsts")
    later = (F.col("doc") != F.col("first_doc")) | (F.col("place") >= F.col("first_place") + LEAST_WORDS)
    hits = (marks.join(firsts, "print").where(later)
            .withColumns({"shift": F.col("place") - F.col("first_place"), "block": F.floor(F.col("place") / BLOCK)})
            .groupBy("doc", "first_doc", "shift", "block").agg(F.min("place").alias("a"), F.max("place").alias("b")))
    # Words from ``low`` on in the later text, from ``low - shift`` on in the first one.
    low = F.greatest(F.col("a") - MARGIN, F.col("shift"), F.lit(0))
    hits = saved(hits.select("doc", "first_doc", "shift", low.alias("low"), (F.col("b") + UNIT + MARGIN).alias("high")), "hits")
    # A first place with very many hits is dealt over several tasks, each with a copy of its words.
    hot = small(saved(hits.groupBy("first_doc").agg(F.count("*").alias("n")).where(F.col("n") > HITS)
                      .select("first_doc", F.ceil(F.col("n") / HITS).alias("tasks")), "hot"))
    tasks = F.coalesce("tasks", F.lit(1))
    hits = hits.join(hot, "first_doc", "left").withColumn("task", F.pmod(F.xxhash64("doc", "shift", "low"), tasks)).drop("tasks")
    sources = (found.select(F.col("doc").alias("first_doc"), "words").join(hits.select("first_doc").distinct(), "first_doc", "left_semi")
               .groupBy("first_doc").agg(F.min("words").alias("words")).join(hot, "first_doc", "left")
               .select("first_doc", "words", F.explode(F.sequence(F.lit(0).cast("bigint"), tasks - 1)).alias("task")))
    part = F.expr("substring(words, cast(2 * (low - shift) + 1 AS int), cast(2 * (high - low) AS int))")
    return (hits.join(sources, ["first_doc", "task"]).select("doc", F.struct(F.col("low").cast("int").alias("low"), part.alias("words")).alias("span")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``_lines`` (number of lines), ``_removed`` (indexes of the removed ones, ascending),
    ``_cut_words`` (words cut out of lines that stay) and ``_kept_text``.

    A run of ``LEAST_WORDS`` words or more (between ASCII blanks, over line ends) goes if it agrees with an earlier
    place. Earlier means a lower id (nulls last), then a lower text hash, then further up the text; a place less than
    ``LEAST_WORDS`` words further up does not count. Runs of whole lines are found wherever they stood before; inside lines a
    run, or up to ``WINDOW`` words at its ends, stays if its hashes stand first in another, shorter repeat. A line of which all words go is removed, with blank lines between two such;
    other lines lose stretches of ``CUT_WORDS`` words or more. One row per input row. A null text has no lines and stays
    null; an empty one has one empty line. Rows repeated with id and text are one document: all keep the same lines. An
    empty table gives an empty table; columns of ``docs`` keep their names, but those named as the four new ones are replaced.
    """
    docs = docs.drop("_lines", "_removed", "_cut_words", "_kept_text")
    its_doc, its_spans, its_lines, its_cut = (free_name(docs, n) for n in ("_doc", "_spans", "_whole", "_cut"))
    text, key = F.col(text_col), F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col))
    rows = docs.where(text.isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"),
                                               key.alias("doc"), text.alias("text"))
    words = repeated_spans(rows)
    found = words.withColumn("line", F.lit(None).cast("int")).unionByName(
        repeated_lines(rows).withColumn("span", F.lit(None).cast(words.schema["span"].dataType)))
    found = saved(found.groupBy("doc").agg(F.collect_list("span"), F.collect_list("line")).toDF(its_doc, its_spans, its_lines), "found")
    # Both sides are shuffled at every size: there are as many of these rows as documents with repeats.
    joined = docs.join(found.hint("merge"), key == F.col(its_doc), "left")
    own = F.when(F.col(its_doc).isNotNull(), text)
    joined = joined.withColumn(its_cut, F.arrow_udf(_cut_texts, CUT)(own, F.col(its_spans), F.col(its_lines)))
    done = F.col(its_cut)
    return (joined.withColumn("_lines", F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))))
            .withColumn("_removed", F.coalesce(done["removed"], F.array().cast("array<int>")))
            .withColumn("_cut_words", F.coalesce(done["inside"], F.lit(0)))
            .withColumn("_kept_text", F.coalesce(done["kept"], text)).drop(its_doc, its_spans, its_lines, its_cut))
