"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words and a schedule that says how its share changes over training time 0..1.
The schedule is integrated, and the inverse of that cumulative demand turns a document's place among the words of its
source into a training position; sorting by position gives the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import BLANK_WORD, saved

#: Weights of the sources in code point order, repeating, and the slope of each one's schedule: the source's share at
#: time t is in proportion to 1 + slope * (2t - 1), so a negative slope comes early in training.
WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
#: Words of the mix per word of the input, and the most often that a source is repeated.
SHARE, MOST = 1.5, 2
#: Hex digits of the shuffling key by which a source is cut into pieces, so that no task gets a whole source.
PIECE_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def _cycle(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` and ``slope`` to a table of (source, source_size), one row per source.

    Targets share ``SHARE`` of all words by weight; one stops at ``MOST`` times its source's size, and what is left is
    shared again by weight. That fixed point is a level: a source gets the smaller of its stop and weight * level, and
    the sources that stop are those with the least stop per weight.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = (ranked.withColumn("weight", _cycle(WEIGHTS, F.col("rank")))
              .withColumn("slope", _cycle(SLOPES, F.col("rank")))
              .withColumn("stop", F.col("source_size") * MOST)
              .withColumn("stop_level", F.col("stop") / F.col("weight")))
    before = Window.orderBy("stop_level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("stop").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("stops", left / weight_left > F.col("stop_level"))
    free = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    level = ((F.sum("source_size").over(everything) * SHARE
              - F.coalesce(F.sum(F.when(F.col("stops"), F.col("stop"))).over(everything), F.lit(0))) / free)
    return ranked.select("source", "source_size", "slope", F.when(F.col("stops"), F.col("stop").cast("double"))
                         .otherwise(F.col("weight") * level).alias("target"))


def demand_time(share: Column, slope: Column) -> Column:
    """The time by which a source has given ``share`` (0..1) of its words: the inverse of t + slope * (t*t - t)."""
    return F.when(share <= 0, 0.0).otherwise(2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Training positions of every document.

    Returns one row per input row: id, source, text_key (hash of the text), size (words), source_size, target and
    positions (an array with the time of every pass over the document that the mix takes; empty if it takes none).

    A source's documents are taken in the order of the MD5 of their id; a pass over a document is taken if its middle
    lies within the target. Null and empty texts have no words: they cost nothing and are taken like others. Null
    sources are one source, the last. A null id is ordered first. Repeated rows are documents of their own; equal keys
    are ordered by text hash and identical rows are interchangeable. An empty table gives an empty table. Other
    columns, whatever their names, are ignored.
    """
    rows = saved(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("text_key"),
        words(F.col(text_col)).alias("size"), F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("")).alias("key"),
    ).withColumn("piece", F.substring("key", 1, PIECE_DIGITS)), "mix")
    pieces = rows.groupBy("source", "piece").agg(F.sum("size").alias("piece_size"))
    plan = targets(pieces.groupBy("source").agg(F.sum("piece_size").alias("source_size")))
    up_to = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (pieces.withColumn("piece_start", F.coalesce(F.sum("piece_size").over(up_to), F.lit(0)))
              .alias("a").join(plan.alias("p"), F.col("a.source").eqNullSafe(F.col("p.source")))
              .select("a.source", "a.piece", "piece_start", "source_size", "target", "slope"))
    inside = (Window.partitionBy("source", "piece").orderBy("key", "id", "text_key", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("in_piece", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r")
              .join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))
                    & F.col("r.piece").eqNullSafe(F.col("s.piece"))))
    middle = F.col("piece_start") + F.col("in_piece") + F.col("size") / 2
    passes = F.filter(F.array(*[middle + n * F.col("source_size") for n in range(MOST)]), lambda m: m <= F.col("target"))
    share = lambda m: F.when(F.col("target") > 0, m / F.col("target")).otherwise(0.0)
    return placed.select(F.col("r.id").alias("id"), F.col("r.source").alias("source"), "text_key", "size", "source_size",
                         "target", F.transform(passes, lambda m: demand_time(share(m), F.col("slope"))).alias("positions"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        plan: DataFrame | None = None, in_order: bool = True) -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated or left out as ``assign`` says, range-sorted by training position.

    The columns are those of ``docs`` and ``_position``. ``plan``: what ``assign`` gave for the same rows, if it is
    there already. Without ``in_order`` the rows are not sorted, as for a table whose order is lost when it is written.
    Cases are as in ``assign``.
    """
    keys = ["_mix_id", "_mix_source", "_mix_text"]
    placed = ((assign(docs, id_col, text_col, source_col) if plan is None else plan)
              .groupBy(F.col("id").alias(keys[0]), F.col("source").alias(keys[1]), F.col("text_key").alias(keys[2]))
              .agg(F.collect_list("positions").alias("_mix_passes")))
    kept = list(docs.columns)
    # Repeated rows share one key; the n-th of them takes the n-th list of positions.
    nth = Window.partitionBy(*keys).orderBy(F.lit(1))
    rows = (docs.withColumns({keys[0]: F.col(id_col), keys[1]: F.col(source_col), keys[2]: F.xxhash64(F.col(text_col))})
            .withColumn("_mix_nth", F.row_number().over(nth)).alias("d"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    joined = rows.join(placed.alias("p"), same[0] & same[1] & same[2])
    out = joined.select(*[F.col(f"d.`{c}`") for c in kept],
                        F.explode(F.element_at("_mix_passes", F.col("_mix_nth"))).alias("_position"))
    return out.orderBy("_position", id_col) if in_order else out


def placed(mixed: DataFrame, plan: DataFrame, id_col: str = "doc_id", key_col: str = "text_key") -> DataFrame:
    """Rows of a mix that lost its positions, with ``_position`` from the plan (id, text_key, positions) it was made by.

    ``key_col`` is the hash of a row's text, so rows may carry what was made of the text in its place.

    Rows of equal id and text are interchangeable: the n-th takes the n-th of their positions. A row that the plan does
    not have gets null. Nulls and repeated rows are as in ``assign``; other columns are kept.
    """
    # Explicit keys without nulls, so that the window's shuffle serves the join too.
    keys = ["_mix_nameless", "_mix_id", "_mix_text"]
    known = lambda i: (F.isnull(i), F.coalesce(F.col(i).cast("string"), F.lit("")))
    lists = (plan.where("size(positions) > 0")
             .select(*[c.alias(k) for k, c in zip(keys, (*known("id"), F.col("text_key")), strict=True)], "positions")
             .groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("_mix_positions")))
    nth = Window.partitionBy(*keys).orderBy(F.lit(1))
    rows = (mixed.withColumns(dict(zip(keys, (*known(id_col), F.col(key_col)), strict=True)))
            .withColumn("_mix_nth", F.row_number().over(nth)))
    # get() counts from 0 and gives null beyond the end.
    return rows.join(lists, keys, "left").select(
        *[F.col(f"`{c}`") for c in mixed.columns], F.get("_mix_positions", F.col("_mix_nth") - 1).alias("_position"))
