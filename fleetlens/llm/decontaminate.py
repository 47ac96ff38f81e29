"""Benchmark decontamination by winnowing.

Both sides keep, of every run of 13 words, the least hash of the 6-word grams in it. A span of 13 words or more that a
document shares with a benchmark item therefore keeps the same gram on both sides; joining the kept grams finds every
such span, and each hit is then extended word by word over the whole item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import BROADCAST_ROWS, ascii_lower, let, saved, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words. Spark splits a text several times faster than it extracts all matches from it.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and of the grams that are hashed.
WINDOW, GRAM = 13, 6
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Most items that are sent whole to every executor, as these rows are longer; more are shuffled.
BROADCAST_ITEMS = 10_000


def words_of(text: Column) -> Column:
    """The matches of ``WORD`` in a text, lower-cased from A to Z; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def doubled(values: Column, width: int, best, step: int) -> Column:
    """``best`` of every element and the ``width`` - 1 ones behind it (``step`` 1) or before it (-1), by doubling: two
    overlapping halves make a run. Runs end with the array; nulls do not count."""
    def halves(by: int):
        return lambda v: F.transform(v, lambda x, i: best(x, F.get(v, i + step * by)))

    size = 1
    while size < width:
        by = min(size, width - size)
        values = let(values, halves(by))
        size += by
    return values


def winnowed(rows: DataFrame, length: int, into: str) -> DataFrame:
    """Adds ``into``: array of (hash, pos) of the grams that windows of ``length`` words keep; of ties, all.

    ``rows`` has the word hashes as ``h``. Each step is a projection, or ``let``, of its own that is used more than once,
    so that Spark evaluates it once per row. Elements are got one by one, as a slice of an array costs far more.
    """
    gram = min(GRAM, length)
    width = length - gram + 1
    grams = F.transform(F.sequence(F.lit(0), F.size("h") - gram),
                        lambda i: F.xxhash64(F.lit(length), *[F.get("h", i + k if k else i) for k in range(gram)]))
    rows = rows.withColumn("g", F.when(F.size("h") >= length, grams).otherwise(F.array().cast("array<bigint>")))
    whole = lambda v: F.transform(v, lambda x, i: F.when(i + width <= F.size("g"), x))
    # A gram is kept if it is the least of some window that it lies in; no window's least is above it.
    most = doubled(whole(doubled(F.col("g"), width, F.least, 1)), width, F.greatest, -1) if width > 1 else F.col("g")
    at = let(most, lambda m: F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.get("g", i) == F.get(m, i)))
    kept = F.transform(at, lambda i: F.struct(F.get("g", i).alias("hash"), i.alias("pos")))
    return rows.withColumn(into, F.when(F.size("g") > 0, kept).otherwise(
        F.array().cast("array<struct<hash: bigint, pos: int>>"))).drop("g")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, text_key, n_words, n_hit, n_items, items_sha256, contaminated): one row per row of ``docs``.

    A window is 13 consecutive words of an item, or all words of one that has fewer; words of a document inside any
    occurrence of a window are hit. Null and wordless texts have no words: as documents they are clean, as items they
    have no window. Repeated documents are judged alike, each in its own row. Items of one text are compared once and
    all counted; repeated item ids count once, a null id as an empty one. A null document id is kept. Empty tables
    give an empty result or clean documents; other columns are ignored. ``text_key`` is the hash of the text, which
    with the id names a document.
    """
    items = saved(benchmark.select(F.col(item_text_col).alias("text")).distinct()
                  .select(F.xxhash64("text").alias("item"), word_hashes(F.col("text")).alias("h"))
                  .withColumn("length", F.least(F.size("h"), F.lit(WINDOW))).where("length > 0"), "items")
    names = saved(benchmark.select(F.xxhash64(F.col(item_text_col)).alias("item"),
                                   F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name")).distinct(), "names")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # 13 values at most
    marks = None
    for n in lengths:
        of = winnowed(items.where(F.col("length") == n), n, "kept").select("item", F.size("h").alias("words"), F.inline_outer("kept"))
        marks = of if marks is None else marks.unionAll(of)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    if marks is None:
        marks = items.select("item", F.size("h").alias("words"), F.lit(0).cast("bigint").alias("hash"), F.lit(0).alias("pos"))
    marks = saved(marks, "marks")

    rows = texts.withColumn("h", word_hashes(F.col("text")))
    rows = rows.withColumn("n", F.size("h"))
    for n in lengths:
        rows = winnowed(rows, n, f"kept{n}")
    # The last entry of every document has no hash, and its number of words.
    own = F.array(F.struct(F.lit(None).cast("bigint").alias("hash"), F.col("n").alias("pos")))
    spread = rows.select("id", "text_key", F.inline_outer(F.concat(*[F.col(f"kept{n}") for n in lengths], own)))
    known = saved(marks.select(F.col("hash").alias("known")).distinct(), "known")
    met = saved(spread.join(small(known), F.col("hash") == F.col("known"), "left")
                .where("hash is null or known is not null").select("id", "text_key", "hash", "pos"), "met")

    # Where a gram of an item lies in a document fixes where the whole item would lie.
    lines = saved(met.where("hash is not null").join(small(marks.withColumnRenamed("pos", "at")), "hash")
                  .select("id", "text_key", "item", "words", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "lines")
    per_doc = (lines.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key"))
               .agg(F.collect_list(F.struct("item", "shift", "words")).alias("lines")))
    few = lines.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = texts.join(F.broadcast(per_doc) if few else per_doc,
                       F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    # Only the words beside an item are kept of a document before its lines are spread.
    part = lambda x, h: F.slice(h, F.greatest(x["shift"], F.lit(0)) + 1, x["words"] + F.least(x["shift"], F.lit(0)))
    beside = let(word_hashes(F.col("text")), lambda h: F.transform("lines", lambda x: F.struct(
        x["item"].alias("item"), x["shift"].alias("shift"), part(x, h).alias("d"))))
    spans = found.select("id", "text_key", F.inline_outer(beside)).withColumn("from", F.greatest("shift", F.lit(0)))
    spans = (spans.join(small(items.withColumnRenamed("h", "i"), BROADCAST_ITEMS), "item")
             .withColumn("i", F.slice("i", F.col("from") - F.col("shift") + 1, F.size("d"))))
    begins = lambda same: F.when(F.size(same) >= F.col("length"), F.filter(
        F.sequence(F.lit(1), F.size(same) - F.col("length") + 1),
        lambda at: ~F.array_contains(F.slice(same, at, F.col("length")), False))).otherwise(F.array().cast("array<int>"))
    covered = lambda same: F.array_distinct(F.flatten(F.transform(begins(same), lambda at: F.sequence(
        F.col("from") + at - 1, F.col("from") + at + F.col("length") - 2))))
    hit = saved(spans.select("id", "text_key", "item", let(F.zip_with("d", "i", lambda x, y: x == y), covered).alias("places")),
                "hit").where("size(places) > 0")

    words_hit = (hit.select("id", "text_key", F.explode("places").alias("place")).distinct()
                 .groupBy("id", "text_key").agg(F.count("*").alias("n_hit")))
    of_items = (hit.select("id", "text_key", "item").distinct().join(small(names), "item")
                .groupBy("id", "text_key").agg(F.array_sort(F.collect_set("name")).alias("names")))
    result = met.where("hash is null").select("id", "text_key", F.col("pos").cast("bigint").alias("n_words")).alias("d")
    for side, name in ((words_hit, "w"), (of_items, "i")):
        result = result.join(side.alias(name), F.col("d.id").eqNullSafe(F.col(f"{name}.id"))
                             & (F.col("d.text_key") == F.col(f"{name}.text_key")), "left")
    result = result.select("d.id", "d.text_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                           F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    return result.select("id", "text_key", "n_words", "n_hit", F.size("names").cast("bigint").alias("n_items"),
                         F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
                         ((F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
