import pytest
from pyspark.sql import functions as F

from fleetlens.operators import joins as J
from fleetlens.operators import ranges as R

# Published search vectors.
GOLDEN = [
    (1, 0, 1_000_000, 0, 42, 0x234, 0xFFF, 277, 0x8007, 0x4E0),
    (2, 500_000, 250_000, 0, 7, 0x0, 0xFFFF, 1, 0x801FA, 0x801FA),
    (3, 0, 1_048_576, 1, 99, 0x2BCD, 0x3FFFF, 6, 0xB115, 0x15F25),
    (4, 4_000_000_000, 100_000, 0, 3, 0x555, 0x7FF, 45, 0xEE6B7631, 0xEE6B2A01),
]
SPEC = "search_id long, start_lo long, unit_count long, base_hi long, seed long, target long, mask long"


def spec(spark, rows):
    return spark.createDataFrame([r[:7] for r in rows], SPEC)


def test_goldens(spark):
    got = {r.search_id: (r.found_count, r.match_xor, r.min_match) for r in R.range_search(spec(spark, GOLDEN)).collect()}
    assert got == {g[0]: (g[7], g[8], g[9]) for g in GOLDEN}


def test_cutting_a_range_does_not_change_the_answer(spark):
    g = GOLDEN[3]
    cuts = [0, 1, 777, 32_768, 99_999, 100_000]
    parts = [(i, g[1] + a, b - a, *g[3:7]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    r = R.range_search(spec(spark, parts), partitions=3).agg(
        F.sum("found_count"), F.bit_xor("match_xor"), F.min("min_match")).first()
    assert tuple(r) == (g[7], g[8], g[9])


def test_wrap_past_32_bits_and_empty_range(spark):
    rows = [(1, 0xFFFFFFF0, 32, 0, 5, 0, 0x3), (2, 7, 0, 0, 5, 0, 0x3), (3, 0xFFFFFFF0, 16, 0, 5, 0, 0x3), (4, 0, 16, 0, 5, 0, 0x3)]
    got = {r.search_id: r for r in R.range_search(spec(spark, rows)).collect()}
    assert (got[2].found_count, got[2].min_match, got[2].match_xor) == (0, 0xFFFFFFFF, 0)
    assert got[1].found_count == got[3].found_count + got[4].found_count
    assert got[1].match_xor == got[3].match_xor ^ got[4].match_xor
    assert got[1].min_match == min(got[3].min_match, got[4].min_match)


def test_high_word_constant_does_not_overflow(spark):
    hi = 0xFFFFFFFF
    c = R.search_candidates(spec(spark, [(1, 0, 4, hi, 0, 0, 1)]), 0).collect()
    assert {r.lo: r.h for r in c} == {i: i ^ (hi * 2654435769 & 0xFFFFFFFF) for i in range(4)}


def test_coverage_audit(spark):
    t = spark.createDataFrame([
        (1, 1, 0, 10, None), (1, 2, 10, 5, None), (1, 3, 20, 5, None),   # one hole
        (2, 4, 0, 10, None), (2, 5, 8, 10, None), (2, 6, 0, 10, 4),      # overlap; replica ignored
        (3, 7, 5, 1, None)], "job_id long, task_id long, start_unit long, unit_count long, replica_of long")
    got = {r.job_id: (r.ranges, r.covered, r.gaps) for r in R.coverage_audit(t).collect()}
    assert got == {1: (3, 25, 1), 2: (2, 18, 1), 3: (1, 6, 1)}


def test_carve_never_crosses_a_group(spark):
    rq = spark.createDataFrame([(1, i, 30) for i in range(12)] + [(2, i, 30) for i in range(5)], "job_id long, i long, size long")
    jobs = spark.createDataFrame([(1, 200, 64), (2, 100, 0)], "job_id long, total_units long, units_per_group long")
    rows = R.carve_ranges(rq, jobs, ["i"]).orderBy("job_id", "start_unit").collect()
    one = [(r.start_unit, r.granted) for r in rows if r.job_id == 1]
    assert one == [(0, 30), (30, 30), (60, 4), (64, 30), (94, 30), (124, 4), (128, 30), (158, 30), (188, 4), (192, 8)]
    assert [(r.start_unit, r.granted) for r in rows if r.job_id == 2] == [(0, 30), (30, 30), (60, 30), (90, 10)]


def test_range_lookup_with_overlaps_and_long_ranges(spark):
    ranges = [(1, 10, 0, 5), (1, 11, 3, 1_000_000_007), (1, 12, 5, 1), (2, 13, 0, 64), (1, 14, 9, 0)]
    units = [(1, u) for u in (0, 2, 3, 4, 5, 6, 1_000_000_009, 1_000_000_010)] + [(2, 63), (2, 64)]
    r = spark.createDataFrame(ranges, "job_id long, range_id long, start_unit long, unit_count long")
    u = spark.createDataFrame(units, "job_id long, unit long")
    got = {(x.job_id, x.unit, x.range_id) for x in J.range_lookup(u, r, ["job_id"]).collect()}
    assert got == {(j, v, i) for j, v in units for k, i, s, n in ranges if j == k and s <= v < s + n}
    assert J.range_lookup(u, r, ["job_id"]).count() == len(got)


@pytest.mark.parametrize("size", [3, 1000])
def test_search_blocks(spark, size):
    s = spec(spark, [(1, 0, 1001, 0, 9, 0, 0x7)])
    c = R.search_candidates(s, 1, block=size)
    assert c.agg(F.count("lo"), F.min("lo"), F.max("lo"), F.count_distinct("lo")).first()[:] == (1001, 0, 1000, 1001)
