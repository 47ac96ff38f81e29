"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has a few cells; every digest is added to three of them, one in each third: a count, the digests xored, and
check values of the digests xored. Subtracting the sketches of two versions leaves the digests that only one of them
has; cells with one digest are peeled until all are known. Large documents are compared in strata by digest, so that a
sketch stays small, and a stratum that does not peel is retried with a larger sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import let
from fleetlens.session import shuffle_partitions

#: Words of a paragraph's pieces: a longer paragraph counts as several digests.
PIECE_WORDS = 32
#: Cells of the fingerprint that is returned, digests of a stratum on average, and cells of a stratum's sketches: each is
#: tried if the one before does not peel. Digests that none peels are compared as sets. Up to 63 cells fit a bit mask.
FINGERPRINT_CELLS, STRATUM, CELLS = 12, 12, (24, 42, 60)
#: Rounds of peeling; each takes all single cells at once.
ROUNDS = 8
#: Ranges of ids per shuffle partition.
RANGES = 4


def digests(text: Column) -> Column:
    """Distinct digests of the pieces of a text's paragraphs (lines)."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?:[^ \n]++ ?+){{1,{PIECE_WORDS}}}+"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1))


def _bit(key: Column, third: int, cells: int) -> Column:
    cell = F.pmod(F.xxhash64(key, F.lit(2 + third), F.lit(cells)), F.lit(cells // 3)) + third * (cells // 3)
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), cell.cast("int"))


def _placed(key: Column, sign: Column, cells: int) -> Column:
    """A digest with its sign, its check value and the bits of its cells."""
    at = _bit(key, 0, cells).bitwiseOR(_bit(key, 1, cells)).bitwiseOR(_bit(key, 2, cells))
    return F.struct(key.alias("k"), sign.cast("int").alias("s"), _check(key).alias("h"), at.alias("at"))


def _with(cell: Column, index: Column, entries: Column, sign: int) -> Column:
    """A cell with the entries that lie in it added or (sign -1) taken out."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), index)
    own = let(bit, lambda b: F.filter(entries, lambda e: e["at"].bitwiseAND(b) != 0))
    return F.aggregate(own, cell, lambda z, e: F.struct((z["n"] + sign * e["s"]).alias("n"), z["x"].bitwiseXOR(e["k"]).alias("x"),
                                                        z["h"].bitwiseXOR(e["h"]).alias("h")))


def _empty() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("h"))


def sketch(entries: Column, cells: int) -> Column:
    """The cells (n, x, h) over entries made by ``_placed``."""
    return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: _with(_empty(), i, entries, 1))


def peel(cells: Column, size: int) -> Column:
    """The number of digests left in a subtracted sketch, or null if it does not peel."""
    def single(state):
        pure = F.filter(state["cells"], lambda z: (F.abs(z["n"]) == 1) & (_check(z["x"]) == z["h"]))
        return F.array_distinct(F.transform(pure, lambda z: _placed(z["x"], z["n"], size)))

    def step(state, pure):
        less = F.transform(state["cells"], lambda z, i: _with(z, i, pure, -1))
        return F.when(F.size(pure) == 0, state).otherwise(
            F.struct(less.alias("cells"), (state["found"] + F.size(pure)).alias("found")))

    def finish(state):
        done = ~F.exists(state["cells"], lambda z: (z["n"] != 0) | (z["x"] != 0) | (z["h"] != 0))
        return F.when(done, state["found"])
    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: let(single(s), lambda p: step(s, p)), finish)


def _split(items: Column, groups: Column, number) -> Column:
    return F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.filter(items, lambda x: number(x) == g))


def differing(a: Column, b: Column) -> Column:
    """How many digests only one of two distinct digest arrays has.

    Strata are cut in two steps of about the square root of their number, so that the work stays near linear.
    """
    both = F.concat(F.transform(a, lambda k: F.struct(k.alias("k"), F.lit(1).alias("s"))),
                    F.transform(b, lambda k: F.struct(k.alias("k"), F.lit(-1).alias("s"))))

    def stratum(items):
        exact = F.size(F.filter(F.transform(items, lambda x: F.size(F.filter(items, lambda y: y["k"] == x["k"]))), lambda n: n == 1))
        def attempt(m):
            return let(F.transform(items, lambda x: _placed(x["k"], x["s"], m)), lambda e: peel(sketch(e, m), m))
        return F.coalesce(*[attempt(m) for m in CELLS], exact)

    def strata(items, root):
        low = lambda x: F.pmod(x["k"], root).cast("int")
        high = lambda x: F.pmod(F.shiftrightunsigned(x["k"], 32), root).cast("int")
        parts = F.flatten(F.transform(_split(items, root, low), lambda part: _split(part, root, high)))
        return F.aggregate(F.filter(parts, lambda p: F.size(p) > 0), F.lit(0), lambda n, p: n + stratum(p))
    root = F.greatest(F.ceil(F.sqrt((F.size(a) + F.size(b)) / STRATUM)).cast("int"), F.lit(1))
    return let(both, lambda items: let(root, lambda r: strata(items, r)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two digest arrays from their difference; two empty ones are alike."""
    total = F.size(a) + F.size(b)
    return let(differing(a, b), lambda d: F.when(total == 0, F.lit(1.0)).otherwise((total - d) / (total + d)))


def fingerprint(keys: Column) -> Column:
    """The cells of a document's own sketch as text."""
    entries = F.transform(keys, lambda k: _placed(k, F.lit(1), FINGERPRINT_CELLS))
    return let(entries, lambda e: F.array_join(F.transform(sketch(e, FINGERPRINT_CELLS), lambda z: F.concat_ws(
        ":", z["n"].cast("string"), F.hex(z["x"]), F.hex(z["h"]))), ","))


def ordered_ranges(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``range``: in descending order of a whole-number column, rows of a higher range come first.

    The bounds are quantiles, so ranges have about the same number of rows, and there is a fixed number of them for each
    shuffle partition. Nulls are range 0, the last.
    """
    count = RANGES * shuffle_partitions(rows.sparkSession)
    quantiles = F.percentile_approx(order, F.array(*[F.lit(i / count) for i in range(1, count)]), F.lit(10 * count))
    bounds = F.lit(sorted(set(rows.agg(quantiles.alias("q")).first()["q"] or [0])))
    # The number of bounds below a value, found by halving the place where it may be.
    steps = F.sequence(F.lit(1), F.lit(count.bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def halve(z):
        mid = F.floor((z["lo"] + z["hi"]) / 2).cast("int")
        right = F.element_at(bounds, mid + 1) < F.col(order)
        return F.when(z["lo"] == z["hi"], z).when(right, F.struct((mid + 1).alias("lo"), z["hi"].alias("hi"))).otherwise(
            F.struct(z["lo"].alias("lo"), mid.alias("hi")))
    place = F.aggregate(steps, start, lambda z, _: halve(z), lambda z: z["lo"])
    return rows.withColumn("range", F.when(F.col(order).isNull(), 0).otherwise(place + 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per input row.

    The next document is that of the next lower id, and after the last that of the highest; the edited text has its
    last half replaced by the first half of the next one. A null text is an empty one. Null ids come last. Repeated ids
    are ordered by text; repeated rows are documents of their own. A single document is its own next. An empty table gives an empty
    table; other columns are ignored. Two texts without paragraphs are alike (1.0). Texts are taken whole.

    Texts are shuffled once, by ranges of ids. The first row of a range also goes to the range before it as a guest, so
    the last row of every range finds its next document there.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = ordered_ranges(rows, "id")
    tops = rows.groupBy("range").agg(F.max("id").alias("top"))  # as many rows as there are ranges
    around = Window.orderBy(F.desc("range"))
    tops = tops.withColumn("to", F.coalesce(F.lag("range").over(around), F.min("range").over(Window.partitionBy())))
    guests = (rows.alias("r").join(F.broadcast(tops).alias("t"), (F.col("r.range") == F.col("t.range")) & F.col("id").eqNullSafe(F.col("top")))
              .groupBy("to", "id").agg(F.max("text").alias("text")))
    everyone = rows.select("range", "id", "text", F.lit(0).alias("guest")).unionAll(
        guests.select(F.col("to").alias("range"), "id", "text", F.lit(1).alias("guest")))
    down = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("id"), F.desc("text"))
    paired = (everyone.withColumn("next", F.lead("text").over(down)).withColumn("keys", digests(F.col("text")))
              .withColumn("next_keys", F.lead("keys").over(down)).where("guest = 0"))
    edited = F.expr("concat(substring(text, 1, char_length(text) - char_length(text) div 2), substring(next, 1, char_length(text) div 2))")
    both = paired.select("id", "keys", "next_keys", F.char_length("text").cast("bigint").alias("n_chars"), edited.alias("edited"))
    both = both.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", "next_keys",
                       digests(F.col("edited")).alias("edited_keys"))
    return both.select("id", "n_chars", "edited_sha256", fingerprint(F.col("keys")).alias("fingerprint"),
                       fingerprint(F.col("edited_keys")).alias("edited_fingerprint"),
                       likeness(F.col("keys"), F.col("edited_keys")).alias("near_edited"),
                       likeness(F.col("keys"), F.col("next_keys")).alias("near_next"))
