"""Unit ranges: hash search, coverage audit, carving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import HIGH_WORD_MUL, U32, with_pcg_rounds
from fleetlens.operators.ordered import EXPAND_BLOCK, Carve, expand, running, scan


def search_candidates(spec: DataFrame, rounds: int, partitions: int | None = None,
                      block: int = EXPAND_BLOCK) -> DataFrame:
    """(search_id, lo, h, match inputs) for each candidate of each range.

    Ranges are cut into blocks that are spread over the cluster before they
    are expanded, so one long range is not one task's work."""
    cand = expand(spec.select("search_id", "start_lo", "base_hi", "seed", "target", "mask", "unit_count"),
                  F.lit(0), F.col("unit_count") - 1, "i", block, partitions)
    # The high word times a 32-bit constant, mod 2^32, in 16-bit halves: no overflow.
    hi = F.col("base_hi").bitwiseAND(F.lit(U32))
    low_part = hi * F.lit(HIGH_WORD_MUL & 0xFFFF)
    high_part = (hi * F.lit(HIGH_WORD_MUL >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    mixed_hi = (low_part + high_part).bitwiseAND(F.lit(U32))
    cand = cand.select("search_id", "target", "mask", "seed", mixed_hi.alias("hi"),
                       (F.col("start_lo") + F.col("i")).bitwiseAND(F.lit(U32)).alias("lo"))
    cand = cand.select("search_id", "target", "mask", "lo",
                       F.col("lo").bitwiseXOR(F.col("seed")).bitwiseXOR(F.col("hi"))
                       .bitwiseAND(F.lit(U32)).alias("h"))
    return with_pcg_rounds(cand, "h", rounds)


def range_search(spec: DataFrame, rounds: int = 8, partitions: int | None = None) -> DataFrame:
    """(search_id, found_count, min_match, match_xor) per range. All three
    reductions are associative, so they combine before the shuffle and the cut
    into blocks cannot change them. A range without a match keeps the identities."""
    hit = F.col("h").bitwiseAND(F.col("mask")) == F.col("target")
    found = search_candidates(spec, rounds, partitions).groupBy("search_id").agg(
        F.count_if(hit).alias("found_count"),
        F.coalesce(F.min(F.when(hit, F.col("lo"))), F.lit(U32)).alias("min_match"),
        F.coalesce(F.bit_xor(F.when(hit, F.col("lo"))), F.lit(0).cast("long")).alias("match_xor"))
    empty = spec.where("unit_count <= 0").select(
        "search_id", F.lit(0).cast("long").alias("found_count"), F.lit(U32).cast("long").alias("min_match"),
        F.lit(0).cast("long").alias("match_xor"))
    return found.unionByName(empty)


def range_gaps(tasks: DataFrame) -> DataFrame:
    """Non-replica ranges with the end of the range before them."""
    originals = tasks.where(F.col("replica_of").isNull()).select("job_id", "task_id", "start_unit", "unit_count")
    end = F.col("start_unit") + F.col("unit_count")
    prev = running(originals, ["job_id"], ["start_unit", "task_id"], {"expected": ("last", end)}, inclusive=False)
    return prev.withColumn("expected", F.coalesce("expected", F.lit(0).cast("long")))


def coverage_audit(tasks: DataFrame) -> DataFrame:
    """Per job: ranges, covered (end of the last range) and breaks in the
    sequence; an overlap is a break too."""
    g = range_gaps(tasks)
    return g.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("ranges"),
        F.max_by(F.col("start_unit") + F.col("unit_count"), F.struct("start_unit", "task_id")).alias("covered"),
        F.count_if(F.col("start_unit") != F.col("expected")).alias("gaps"))


def carve_ranges(requests: DataFrame, jobs: DataFrame, order: list[str]) -> DataFrame:
    """Ranges for requests (job_id, size, order columns) in order. Without
    groups the start is a running sum cut at the total; with
    ``units_per_group`` a range ends at the boundary and the rest of the
    request is dropped, which is a fold."""
    j = requests.join(jobs.select("job_id", "total_units", "units_per_group"), "job_id")
    grouped = j.where("units_per_group > 0")
    plain = j.where("units_per_group = 0")
    asked = running(plain, ["job_id"], order, {"asked": ("sum", F.col("size"))}, inclusive=False)
    start = F.least("asked", "total_units")
    a = asked.withColumn("start_unit", start).withColumn(
        "granted", F.least("size", F.col("total_units") - F.col("start_unit"))).drop("asked")
    b = scan(grouped, ["job_id"], order, ["size", "total_units", "units_per_group"],
             Carve("size", "total_units", "units_per_group"))
    return a.unionByName(b).where("granted > 0")
