"""Range search, comparison, quorum and tiles over the test tables."""

from pyspark.sql import functions as F

from fleetlens.operators import compare as C
from fleetlens.operators import joins as J
from fleetlens.operators import kernels as K
from fleetlens.operators import feedback, ranges as R, tiles as T
from fleetlens.operators import quorum as Q
from fleetlens.operators.reputation import ReputationConfig
from fleetlens.plans import bindings as B
from fleetlens.plans.catalog import query
from fleetlens.plans.queries_exprs import PCG_WORD, _x


def _rounds_sql(inner: str, keep: str, n: int = 8) -> str:
    for _ in range(n):
        inner = (f"SELECT {keep}, {_x('(w >> 22)', 'w')} AS h FROM (SELECT {keep}, {PCG_WORD} AS w FROM ("
                 f"SELECT {keep}, (h * 747796405 + 2891336453) & 4294967295 AS s FROM ({inner})))")
    return inner


SEARCH = f"""
cand AS ({_rounds_sql("SELECT o_orderkey AS id, o_orderkey * 100 + i AS lo, " + _x("o_orderkey * 100 + i", "o_custkey")
                      + " AS h FROM (SELECT o_orderkey, o_custkey, unnest(range(0, 100)) AS i FROM orders)", "id, lo")}),
found AS (SELECT id AS search_id, count(*) FILTER ((h & 31) = 20) AS found_count,
  coalesce(min(lo) FILTER ((h & 31) = 20), 4294967295) AS min_match,
  coalesce(bit_xor(lo) FILTER ((h & 31) = 20), 0) AS match_xor FROM cand GROUP BY id)"""


@query("range_search", [], f"WITH {SEARCH} SELECT * FROM found")
def range_search(spark, sf):
    return R.range_search(B.search_spec(spark, sf))


# Submitted answers: the recomputed ones, each of the three fields wrong in some lines.
ANSWERS = """
answers AS (SELECT l_orderkey AS search_id, l_linestatus = 'F' AS accepted, found_count + CAST(l_linenumber = 1 AS BIGINT) AS found_count,
  min_match + CAST(l_linenumber = 2 AS BIGINT) AS min_match, match_xor + CAST(l_linenumber = 3 AS BIGINT) AS match_xor
FROM lineitem JOIN found ON l_orderkey = search_id)"""


@query("reference_check", [], f"""
WITH {SEARCH}, {ANSWERS}, w AS (SELECT s.*, f.search_id IS NOT NULL AS known,
  s.found_count = f.found_count AND s.min_match = f.min_match AND s.match_xor = f.match_xor AS same
  FROM answers s LEFT JOIN (SELECT * FROM found WHERE search_id % 11 <> 0) f ON s.search_id = f.search_id)
SELECT count(*) FILTER (known) AS checked, count(*) FILTER (known AND same) AS matched, count(*) FILTER (known AND NOT same) AS mismatched,
  count(*) FILTER (NOT known) AS unsupported, count(*) FILTER (accepted) AS accepted_checked,
  count(*) FILTER (accepted AND known AND NOT same) AS accepted_wrong FROM w""")
def reference_check(spark, sf):
    found = R.range_search(B.search_spec(spark, sf))
    wrong = lambda c, n: (F.col(c) + (F.col("l_linenumber") == n).cast("long")).alias(c)
    subs = B.table(spark, sf, "lineitem").join(found, F.col("l_orderkey") == F.col("search_id")).select(
        "search_id", wrong("found_count", 1), wrong("min_match", 2), wrong("match_xor", 3),
        (F.col("l_linestatus") == "F").alias("accepted"))
    return J.reference_check(subs, found.where("search_id % 11 <> 0"), ["search_id"])


@query("coverage_audit", ["tg"], """
SELECT job_id, count(*) AS ranges, arg_max(start_unit + unit_count, start_unit) AS covered,
  count(*) FILTER (start_unit <> expected) AS gaps FROM (
  SELECT *, coalesce(lag(start_unit + unit_count) OVER (PARTITION BY job_id ORDER BY start_unit, task_id), 0) AS expected
  FROM tg WHERE replica_of IS NULL) GROUP BY job_id""")
def coverage_audit(spark, sf):
    return R.coverage_audit(B.tasks_with_gaps(spark, sf))


@query("coverage_loss", ["tg", "jb"], """
WITH a AS (SELECT job_id, max(start_unit + unit_count) AS covered, count(*) FILTER (start_unit <> expected) AS gaps FROM (
  SELECT *, coalesce(lag(start_unit + unit_count) OVER (PARTITION BY job_id ORDER BY start_unit, task_id), 0) AS expected
  FROM tg WHERE replica_of IS NULL) GROUP BY job_id)
SELECT job_id, total_units, coalesce(covered, 0) AS units_covered, total_units - coalesce(covered, 0) AS units_lost,
  coalesce(gaps, 0) AS gaps FROM jb LEFT JOIN a USING (job_id)""")
def coverage_loss(spark, sf):
    from fleetlens.operators.summary import coverage_loss as loss
    return loss(R.coverage_audit(B.tasks_with_gaps(spark, sf)), B.jobs(spark, sf))


@query("carve_ranges", ["allr", "jb"], """
WITH RECURSIVE rq AS (SELECT job_id, task_id, unit_count AS size, total_units * 3 // 4 AS total,
    CASE WHEN job_id % 2 = 0 THEN 0 ELSE 700 END AS grp,
    row_number() OVER (PARTITION BY job_id ORDER BY t_ms, task_id) AS i FROM allr JOIN jb USING (job_id)),
 f AS (SELECT job_id, 0::BIGINT AS i, 0::BIGINT AS task_id, 0::BIGINT AS start_unit, 0::BIGINT AS granted, 0::BIGINT AS cur
   FROM jb UNION ALL
   SELECT job_id, i, task_id, cur, take, cur + take FROM (SELECT f.job_id, rq.i, rq.task_id, f.cur,
     least(rq.size, rq.total - f.cur, CASE WHEN grp > 0 THEN grp - f.cur % grp ELSE rq.size END) AS take
     FROM f JOIN rq ON rq.job_id = f.job_id AND rq.i = f.i + 1))
SELECT job_id, task_id, start_unit, granted FROM f WHERE i > 0 AND granted > 0""")
def carve_ranges(spark, sf):
    jobs = B.jobs(spark, sf).select(
        "job_id", F.floor(F.col("total_units") * 3 / 4).cast("long").alias("total_units"),
        F.when(F.col("job_id") % 2 == 0, 0).otherwise(700).cast("long").alias("units_per_group"))
    rq = B.all_ranges(spark, sf).select("job_id", "task_id", "t_ms", F.col("unit_count").alias("size"))
    return R.carve_ranges(rq, jobs, ["t_ms", "task_id"]).select("job_id", "task_id", "start_unit", "granted")


@query("range_lookup", ["allr", "tg"], """
SELECT u.job_id, u.unit_id, u.unit, t.task_id AS range_id, t.start_unit, t.start_unit + t.unit_count AS end_unit
FROM (SELECT job_id, task_id AS unit_id, start_unit + unit_count // 2 AS unit FROM allr) u
JOIN tg t ON u.job_id = t.job_id AND u.unit >= t.start_unit AND u.unit < t.start_unit + t.unit_count""")
def range_lookup(spark, sf):
    units = B.all_ranges(spark, sf).select(
        "job_id", F.col("task_id").alias("unit_id"), (F.col("start_unit") + F.floor(F.col("unit_count") / 2)).alias("unit"))
    ranges = B.tasks_with_gaps(spark, sf).select("job_id", F.col("task_id").alias("range_id"), "start_unit", "unit_count")
    return J.range_lookup(units, ranges, ["job_id"])


@query("kernel_map", [], f"""
SELECT 'smoke_hash' AS kernel, o_orderkey AS id, CAST({_x('(w >> 22)', 'w')} AS DOUBLE) AS value FROM (
  SELECT o_orderkey, {PCG_WORD} AS w FROM (SELECT o_orderkey, (o_orderkey * 747796405 + 2891336453) & 4294967295 AS s FROM orders))
UNION ALL SELECT 'smoke_double', o_orderkey, o_orderkey * 2.0::DOUBLE FROM orders""")
def kernel_map(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("value"))
    out = [K.kernel_map(o, n).select(F.lit(n).alias("kernel"), "id", F.col("value").cast("double").alias("value"))
           for n in ("smoke_hash", "smoke_double")]
    return J.pooled_runs(*out)


VERDICT = """
SELECT label, pair, CASE WHEN na = nb THEN nbad ELSE greatest(na, nb) END AS differing, greatest(na, nb) AS elements,
  CASE WHEN na = nb THEN coalesce(first, greatest(na, nb)) ELSE 0 END AS first_diff,
  CASE WHEN (CASE WHEN na = nb THEN nbad ELSE greatest(na, nb) END) = 0 THEN 'Match' ELSE 'Mismatch' END AS verdict{extra} FROM (
SELECT label, pair, count(*) FILTER (in_a) AS na, count(*) FILTER (in_b) AS nb, count(*) FILTER ({bad}) AS nbad,
  min(pos) FILTER ({bad}) AS first{cols} FROM {src} GROUP BY ALL)"""


@query("compare_exact", ["pr"], VERDICT.format(extra="", cols="", src="(SELECT *, floor(va * 10) AS qa, floor(vb * 10) AS qb FROM pr)", bad="qa <> qb"))
def compare_exact(spark, sf):
    a, b = (s.withColumn("value", F.transform("value", lambda v: F.floor(v.cast("double") * 10)))
            for s in B.vector_sides(spark, sf))
    return C.compare_exact(a, b, ["label", "pair"])


@query("compare_tolerant", ["pr", "flt"], VERDICT.format(
    extra=", max_abs, max_rel, max_ulp",
    cols=", coalesce(max(abs_diff), 0) AS max_abs, coalesce(max(rel_diff), 0) AS max_rel, coalesce(max(ulp), 0) AS max_ulp",
    src="(SELECT p.*, f.abs_diff, f.rel_diff, f.ulp FROM pr p LEFT JOIN flt f USING (label, pair, pos))",
    bad="abs_diff > 0.01::DOUBLE + 0.5::DOUBLE * abs(vb)"))
def compare_tolerant(spark, sf):
    a, b = B.vector_sides(spark, sf)
    return C.compare_tolerant(a, b, ["label", "pair"], 0.01, 0.5)


@query("compare_statistical", ["vec"], """
WITH q AS (SELECT label, pair, odd, i AS pixel, CAST(embedding[i*4+1] AS DOUBLE) AS r, CAST(embedding[i*4+2] AS DOUBLE) AS g,
    CAST(embedding[i*4+3] AS DOUBLE) AS b, abs(CAST(embedding[i*4+4] AS DOUBLE)) + 1.0::DOUBLE AS n
    FROM (SELECT *, unnest(range(0, len(embedding) // 4)) AS i FROM vec) WHERE NOT (odd = 1 AND label = 9 AND pair % 2 = 0 AND i = 15)),
 sizes AS (SELECT label, pair, count(*) FILTER (odd = 1) AS n_a, count(*) FILTER (odd = 0) AS n_b FROM q GROUP BY ALL),
 c AS (SELECT label, pair, pixel, k, 1.0 / x.n + 1.0 / y.n AS pooled_sq, [x.r, x.g, x.b][k] / x.n AS ma, [y.r, y.g, y.b][k] / y.n AS mb
    FROM (SELECT * FROM q WHERE odd = 1) x JOIN (SELECT * FROM q WHERE odd = 0) y USING (label, pair, pixel), (SELECT unnest([1,2,3]) AS k)),
 d AS (SELECT *, abs((ma - mb) / sqrt(pooled_sq)) AS d FROM c),
 s AS (SELECT label, pair, count(*) AS m, list_sort(list(d)) AS ds, list_sort(list(abs(mb))) AS ms,
    sum(ma - mb) AS sd, sum(pooled_sq) FILTER (k = 1) AS pooled FROM d GROUP BY ALL),
 sc AS (SELECT *, greatest(ds[CAST(floor(0.99::DOUBLE * (m - 1)) AS BIGINT) + 1] / 2.5758,
    0.001::DOUBLE * greatest(ms[CAST(floor(0.5::DOUBLE * (m - 1)) AS BIGINT) + 1], 1e-9::DOUBLE)) AS scale FROM s),
 z AS (SELECT label, pair, m, list_max(ds) / scale AS worst, len(list_filter(ds, lambda x: x / scale > 6.0)) AS outliers,
    abs(sd / m) / (scale * sqrt(pooled / m) / sqrt(m)) AS za FROM sc)
SELECT label, pair, greatest(n_a, n_b) * 3 AS elements,
  CASE WHEN n_a <> n_b OR outliers / m::DOUBLE > 0.03 OR za > 12 THEN 'Mismatch' ELSE 'Match' END AS verdict,
  CASE WHEN n_a = n_b THEN outliers ELSE 0 END AS outliers, CASE WHEN n_a = n_b THEN round(worst, 6) END AS worst,
  CASE WHEN n_a = n_b THEN round(za, 6) END AS z_aggregate, -1::BIGINT AS bad_channel FROM sizes LEFT JOIN z USING (label, pair)""")
def compare_statistical(spark, sf):
    a, b = B.pixel_sides(spark, sf)
    # Some tiles lack a pixel on one side, and the last vector of a label may have no partner.
    a = a.where(~((F.col("label") == 9) & (F.col("pair") % 2 == 0) & (F.col("pixel") == 15)))
    got = C.compare_statistical(a, b, ["label", "pair"])
    return got.withColumn("worst", F.round("worst", 6)).withColumn("z_aggregate", F.round("z_aggregate", 6))


def _bit_pairs(spark, sf):
    """Positions of vector pairs with their distance, as ulp tools see them."""
    a, b = B.vector_sides(spark, sf)
    p = C.tolerant_columns(C.pair_up(a, b, ["label", "pair"]).where("in_a and in_b"), 0.0, 0.0)
    return p.select("label", "ulp", "rel_diff")


@query("ulp_summary", ["flt"], """
SELECT label, count(ulp) AS compared, count(*) FILTER (ulp IS NULL) AS nan_skipped, count(*) FILTER (ulp = 0) AS identical,
  max(ulp) AS max_ulp, sum(ulp)::DOUBLE / count(*) AS mean_ulp, 100.0::DOUBLE * count(*) FILTER (ulp = 0) / count(*) AS identical_pct
FROM flt GROUP BY label""")
def ulp_summary(spark, sf):
    return C.ulp_summary(_bit_pairs(spark, sf), ["label"])


@query("ulp_histogram", ["flt"], """
WITH b AS (SELECT label, CAST(floor(log2(ulp + 1)) AS BIGINT) AS ulp, rel_diff FROM flt),
 s AS (SELECT label, count(*) AS n, max(rel_diff) AS max_rel, list_sort(list(ulp)) AS l FROM b GROUP BY label)
SELECT label, ulp, count, 100.0::DOUBLE * sum(count) OVER (PARTITION BY label ORDER BY ulp) / n AS cumulative_pct,
  l[CAST(least(n - 1, floor(0.99::DOUBLE * n)) AS BIGINT) + 1] AS p99, max_rel, 1e-6::DOUBLE / max_rel AS headroom
FROM (SELECT label, ulp, count(*) AS count FROM b GROUP BY ALL) JOIN s USING (label)""")
def ulp_histogram(spark, sf):
    # The test vectors differ everywhere, so distances are binned by powers of two.
    p = _bit_pairs(spark, sf).withColumn("ulp", F.floor(F.log2(F.col("ulp") + 1)))
    return C.ulp_histogram(p, ["label"])


# Each arrival is counted against the same answers before it; the first with a second one settles its round.
QUORUM = """
r AS (SELECT *, (seq - 1) // 4 AS round, (seq - 1) % 4 + 1 AS slot FROM sb),
c AS (SELECT a.task_id, a.round, a.slot, a.answer, count(*) AS same FROM r a JOIN r b
  ON a.task_id = b.task_id AND a.round = b.round AND b.slot <= a.slot AND a.answer = b.answer GROUP BY ALL),
d AS (SELECT task_id, round, min(slot) FILTER (same >= 2) AS settled, count(*) AS received FROM c GROUP BY ALL),
e AS (SELECT *, coalesce(settled, received) AS n, CASE WHEN settled IS NOT NULL THEN 'Accept' WHEN received < 4 THEN 'NeedMoreReplicas'
  ELSE 'Inconclusive' END AS action FROM d),
g AS (SELECT e.task_id, e.round, e.n, e.action, e.received, count(DISTINCT c.answer) AS clusters,
  max(c.same) AS best, max(c.answer) FILTER (c.slot = e.settled) AS top
  FROM e JOIN c ON e.task_id = c.task_id AND e.round = c.round AND c.slot <= e.n GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN action = 'Accept' THEN 0 ELSE 1 END,
  CASE WHEN action = 'Accept' THEN round ELSE -round END) AS pick, sum(received) OVER (PARTITION BY task_id) AS submissions FROM g)"""


@query("quorum_exact", ["sb"], f"""
WITH {QUORUM}
SELECT task_id, CAST(submissions AS BIGINT) AS submissions, round, n, clusters, action, CASE WHEN action = 'Accept' THEN top END AS answer,
  CASE WHEN action = 'Accept' THEN best ELSE 0 END AS agreeing, CASE WHEN action = 'Accept' THEN n - best ELSE 0 END AS dissenting,
  CASE WHEN action = 'Accept' AND n > best THEN 4294967295 ELSE 0 END AS dissent_max_ulp,
  CASE WHEN action = 'Accept' AND n > best THEN 1.0 ELSE 0.0 END::DOUBLE AS dissent_max_rel FROM v WHERE pick = 1""")
def quorum_exact(spark, sf):
    return Q.settle(Q.decide_exact(B.submissions(spark, sf)))


@query("quorum_credits", ["sb"], f"""
WITH {QUORUM} SELECT r.task_id, r.worker_id, r.seq, r.answer = v.top AS accepted,
  CASE WHEN r.answer = v.top THEN 0.0 ELSE 4.0 END::DOUBLE AS severity
FROM r JOIN v ON r.task_id = v.task_id AND r.round = v.round WHERE v.pick = 1 AND v.action = 'Accept' AND r.slot <= v.n""")
def quorum_credits(spark, sf):
    subs = B.submissions(spark, sf)
    return Q.quorum_credits(subs, Q.settle(Q.decide_exact(subs)))


TEST_REPUTATION = ReputationConfig(cooldown_ms=5 * B.DAY_MS)


@query("quorum_adaptive")
def quorum_adaptive(spark, sf):
    """Every arrival with the agreement that its worker's record asked for, and its task's verdict."""
    subs = feedback.adaptive_requirements(B.timed_submissions(spark, sf), TEST_REPUTATION)
    verdicts = Q.settle(Q.decide_exact(subs, F.col("need")))
    return subs.select("sub_id", "task_id", "worker_id", "need").join(
        verdicts.select("task_id", "round", "n", "action", "agreeing", "dissenting"), "task_id")


def _ag(i: int, j: int) -> str:
    return f"(abs(v{i} - v{j}) <= 0.3::DOUBLE * abs(v{j}))"


def _cluster_sql(ag) -> str:
    """Clusters and verdict of rounds ``w`` of up to four answers; ``ag(i, j)`` says whether answer i agrees with j."""
    return f"""
c2 AS (SELECT *, CASE WHEN n < 2 THEN 0 WHEN {ag(2, 1)} THEN 1 ELSE 2 END AS c2 FROM w),
c3 AS (SELECT *, CASE WHEN n < 3 THEN 0 WHEN {ag(3, 1)} AND (c2 <> 1 OR {ag(3, 2)}) THEN 1
  WHEN c2 = 2 AND {ag(3, 2)} THEN 2 ELSE greatest(1, c2) + 1 END AS c3 FROM c2),
c4 AS (SELECT *, CASE WHEN n < 4 THEN 0
  WHEN {ag(4, 1)} AND (c2 <> 1 OR {ag(4, 2)}) AND (c3 <> 1 OR {ag(4, 3)}) THEN 1
  WHEN (c2 = 2 OR c3 = 2) AND (c2 <> 2 OR {ag(4, 2)}) AND (c3 <> 2 OR {ag(4, 3)}) THEN 2
  WHEN c3 = 3 AND {ag(4, 3)} THEN 3 ELSE greatest(1, c2, c3) + 1 END AS c4 FROM c3),
k AS (SELECT *, CASE WHEN c2 = 1 THEN 2 WHEN n >= 3 AND c3 <= 2 THEN 3 WHEN n >= 4 AND c4 <= 3 THEN 4 ELSE n END AS k FROM c4),
u AS (SELECT * EXCLUDE (n, c3, c4, k), k AS n, n AS received, CASE WHEN k >= 3 THEN c3 ELSE 0 END AS c3, CASE WHEN k >= 4 THEN c4 ELSE 0 END AS c4 FROM k),
z AS (SELECT *, greatest(1, c2, c3, c4) AS clusters,
  [list_count(list_filter([1, c2, c3, c4], lambda x: x = 1)), list_count(list_filter([1, c2, c3, c4], lambda x: x = 2)),
   list_count(list_filter([1, c2, c3, c4], lambda x: x = 3)), list_count(list_filter([1, c2, c3, c4], lambda x: x = 4))] AS sz FROM u),
b AS (SELECT *, list_max(sz) AS best, list_position(sz, list_max(sz)) AS top FROM z),
a AS (SELECT *, list_position([1, c2, c3, c4], top) AS ws, CASE WHEN best >= 2 THEN 'Accept' WHEN n < 4 THEN 'NeedMoreReplicas'
  WHEN best * 2 > n THEN 'Accept' ELSE 'Inconclusive' END AS action FROM b),
"""


@query("quorum_tolerant", ["sb"], f"""
WITH r AS (SELECT task_id, (seq - 1) // 4 AS round, seq, value, (seq - 1) % 4 + 1 AS slot FROM sb),
w AS (SELECT task_id, round, count(*) AS n, min(seq) AS s0, max(value) FILTER (slot = 1) AS v1, max(value) FILTER (slot = 2) AS v2,
  max(value) FILTER (slot = 3) AS v3, max(value) FILTER (slot = 4) AS v4 FROM r GROUP BY ALL),
{_cluster_sql(_ag)}o AS (SELECT *, [v1, v2, v3, v4][ws] AS wv FROM a),
x AS (SELECT *, greatest(CASE WHEN top <> 1 THEN abs(v1 - wv) / wv ELSE 0 END, CASE WHEN n >= 2 AND c2 <> top THEN abs(v2 - wv) / wv ELSE 0 END,
  CASE WHEN n >= 3 AND c3 <> top THEN abs(v3 - wv) / wv ELSE 0 END, CASE WHEN n >= 4 AND c4 <> top THEN abs(v4 - wv) / wv ELSE 0 END) AS dr FROM o)
SELECT task_id, round, n, received, clusters::BIGINT AS clusters, action, CASE WHEN action = 'Accept' THEN s0 + ws - 1 ELSE -1 END AS winner_seq,
  CASE WHEN action = 'Accept' THEN best ELSE 0 END AS agreeing, CASE WHEN action = 'Accept' THEN n - best ELSE 0 END AS dissenting,
  CASE WHEN action = 'Accept' THEN dr ELSE 0 END AS dissent_max_rel FROM x""")
def quorum_tolerant(spark, sf):
    d = Q.decide_tolerant(B.submissions(spark, sf), 2, 4, 0.0, 0.3)
    return d.drop("agreeing_workers", "dissent_max_ulp")


# Every third vector answers with shifted radiance, some lack their last pixel, some have a pixel without samples.
@query("quorum_statistical", ["vec"], f"""
WITH p AS (SELECT task_id, (seq - 1) // 4 AS round, (seq - 1) % 4 + 1 AS slot, i, CASE WHEN vec_id % 13 = 0 AND i = 0 THEN 0 ELSE n END AS n, ch FROM (
  SELECT label * 1000000 + (pair - 1) // 4 AS task_id, (pair - 1) % 4 * 2 + 2 - odd AS seq, vec_id, i,
    abs(CAST(embedding[i*4+4] AS DOUBLE)) + 1.0::DOUBLE AS n,
    list_transform([1, 2, 3], lambda k: CAST(embedding[i*4+k] AS DOUBLE) + CASE WHEN vec_id % 3 = 0 THEN 5.0::DOUBLE ELSE 0 END) AS ch
  FROM (SELECT *, unnest(range(0, len(embedding) // 4 - CASE WHEN vec_id % 11 = 0 THEN 1 ELSE 0 END)) AS i FROM vec))),
size AS (SELECT task_id, round, slot, count(*) AS pixels, min(n) > 0 AS sound FROM p GROUP BY ALL),
c AS (SELECT a.task_id, a.round, a.slot AS i, b.slot AS j, k, 1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n AS sq, a.ch[k] / a.n AS ma, b.ch[k] / b.n AS mb
  FROM p a JOIN p b ON a.task_id = b.task_id AND a.round = b.round AND a.slot <> b.slot AND a.i = b.i, (SELECT unnest([1, 2, 3]) AS k)
  WHERE a.n > 0 AND b.n > 0),
s AS (SELECT task_id, round, i, j, count(*) AS m, list_sort(list(abs((ma - mb) / sqrt(sq)))) AS ds, list_sort(list(abs(mb))) AS ms,
  sum(ma - mb) AS sd, sum(sq) FILTER (k = 1) AS pooled FROM c GROUP BY ALL),
sc AS (SELECT *, greatest(ds[CAST(floor(0.99::DOUBLE * (m - 1)) AS BIGINT) + 1] / 2.5758,
  0.001::DOUBLE * greatest(ms[CAST(floor(0.5::DOUBLE * (m - 1)) AS BIGINT) + 1], 1e-9::DOUBLE)) AS scale FROM s),
za AS (SELECT *, len(list_filter(ds, lambda x: x / scale > 6.0)) / m::DOUBLE AS tail, abs(sd / m) / (scale * sqrt(pooled / m) / sqrt(m)) AS z FROM sc),
ok AS (SELECT a.task_id, a.round, a.slot AS i, b.slot AS j, a.pixels = b.pixels AND a.sound AND b.sound AS fit,
  a.pixels = b.pixels AND a.sound AND b.sound AND tail <= 0.03 AND z <= 12 AS ag, z FROM size a JOIN size b
  ON a.task_id = b.task_id AND a.round = b.round AND a.slot <> b.slot LEFT JOIN za
  ON za.task_id = a.task_id AND za.round = a.round AND za.i = a.slot AND za.j = b.slot),
w AS (SELECT r.task_id, r.round, r.n, r.round * 4 + 1 AS s0, {", ".join(f"g.g{i}{j}" for i in (2, 3, 4) for j in range(1, i))}
  FROM (SELECT task_id, round, count(*) AS n FROM size GROUP BY ALL) r LEFT JOIN (SELECT task_id, round,
  {", ".join(f"bool_or(ag) FILTER (i = {i} AND j = {j}) AS g{i}{j}" for i in (2, 3, 4) for j in range(1, i))} FROM ok GROUP BY ALL) g USING (task_id, round)),
{_cluster_sql(lambda i, j: f"g{i}{j}")}
far AS (SELECT a.task_id, a.round, max(CASE WHEN ok.fit THEN ok.z ELSE 0 END) AS z FROM a JOIN ok ON a.task_id = ok.task_id AND a.round = ok.round
  AND ok.j = a.ws AND ok.i <= a.n AND [1, c2, c3, c4][ok.i] <> a.top GROUP BY ALL)
SELECT task_id, round, n, received, clusters::BIGINT AS clusters, action, CASE WHEN action = 'Accept' THEN s0 + ws - 1 ELSE -1 END AS winner_seq,
  CASE WHEN action = 'Accept' THEN best ELSE 0 END AS agreeing, CASE WHEN action = 'Accept' THEN n - best ELSE 0 END AS dissenting,
  CASE WHEN action = 'Accept' THEN round(coalesce(far.z, 0), 6) ELSE 0 END AS dissent_max_rel FROM a LEFT JOIN far USING (task_id, round)""")
def quorum_statistical(spark, sf):
    v = K.kernel_map(B.vectors(spark, sf), "smoke_pixels", "embedding", "payload")

    def altered(p, i):
        shift = F.when(F.col("vec_id") % 3 == 0, F.lit(5.0)).otherwise(F.lit(0.0))
        counts = F.when((F.col("vec_id") % 13 == 0) & (i == 0), F.lit(0.0)).otherwise(p["samples"])
        return F.struct(*[(p[c] + shift).alias(c) for c in ("r", "g", "b")], counts.alias("samples"))
    kept = F.size("payload") - F.when(F.col("vec_id") % 11 == 0, F.lit(1)).otherwise(F.lit(0))
    subs = v.select(
        (F.col("label") * 1_000_000 + F.floor((F.col("pair") - 1) / 4)).alias("task_id"),
        ((F.col("pair") - 1) % 4 * 2 + 2 - F.col("odd")).alias("seq"), F.col("vec_id").alias("worker_id"),
        F.slice(F.transform("payload", altered), F.lit(1), kept).alias("payload"))
    d = K.decide_kernel("smoke_pixels", subs, 2, 4, "payload")
    return d.drop("agreeing_workers", "dissent_max_ulp").withColumn("dissent_max_rel", F.round("dissent_max_rel", 6))


@query("replica_pairs", ["sb"], """
SELECT task_id, CAST(sum(c) * (sum(c) - 1) // 2 AS BIGINT) AS pairs, CAST(sum(c * (c - 1) // 2) AS BIGINT) AS agreeing FROM (
  SELECT task_id, answer, count(*) AS c FROM sb GROUP BY ALL) GROUP BY task_id""")
def replica_pairs(spark, sf):
    return J.replica_pairs(B.submissions(spark, sf), ["task_id"], "answer")


@query("round_pairs", ["sb"], """
WITH r AS (SELECT *, (seq - 1) // 4 AS round FROM sb)
SELECT a.task_id, a.round, a.seq AS seq_a, b.seq AS seq_b, abs(a.value - b.value) <= 0.3::DOUBLE * abs(b.value) AS agree
FROM r a JOIN r b ON a.task_id = b.task_id AND a.round = b.round AND a.seq > b.seq""")
def round_pairs(spark, sf):
    return J.round_pairs(Q.with_rounds(B.submissions(spark, sf)), ["task_id", "round"], "value", 0.0, 0.3)


@query("known_pool", ["pool"], "SELECT * FROM pool")
def known_pool(spark, sf):
    return Q.known_pool(B.range_verdicts(spark, sf))


def _grid(spark, sf):
    top = B.table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]  # one number: the image size
    rows = (top // 2 + 16) // 16
    return T.Grid(64, rows * 4, 4, 4)


@query("tile_samples", ["nu", "grid"], """
SELECT min(s) AS min_samples, max(s) AS max_samples, count(samples) AS tiles_with_data, count(*) AS tiles,
  (SELECT min(g.tile) FROM grid g LEFT JOIN nu ON g.tile = nu.tile WHERE coalesce(samples, 0) = min(a.s)) AS least_sampled
FROM (SELECT samples, coalesce(samples, 0.0) AS s FROM grid LEFT JOIN nu USING (tile)) a""".replace(
    "= min(a.s)", "= (SELECT min(coalesce(n2.samples, 0)) FROM grid g2 LEFT JOIN nu n2 ON g2.tile = n2.tile)"))
def tile_samples(spark, sf):
    return T.tile_samples(B.uploads(spark, sf), _grid(spark, sf))


def _shade(c: str) -> str:
    return (f"CAST(CASE WHEN {c} * (1.0::DOUBLE / n) <= 0 THEN 0 ELSE floor(pow(least({c} * (1.0::DOUBLE / n), 1.0), 1.0::DOUBLE / 2.2)"
            " * 255.0 + 0.5) END AS BIGINT)")


@query("mosaic", ["nu", "up", "grid"], f"""
WITH l AS (SELECT nu.x + pixel % 4 AS x, nu.y + pixel // 4 AS y, {_shade('r')} AS red, {_shade('g')} AS green, {_shade('b')} AS blue
  FROM up JOIN (SELECT tile, upload, samples AS n, x, y FROM nu) nu USING (tile, upload))
SELECT c.x, c.y, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue, 255::BIGINT AS alpha
FROM (SELECT x + p % 4 AS x, y + p // 4 AS y FROM grid, (SELECT unnest(range(0, 16)) AS p)) c LEFT JOIN l USING (x, y)""")
def mosaic(spark, sf):
    return T.mosaic(B.uploads(spark, sf), _grid(spark, sf))


@query("accumulate", ["up"], """
SELECT tile, pixel, round(sum(r), 6) AS r, round(sum(g), 6) AS g, round(sum(b), 6) AS b, round(sum(samples), 6) AS samples FROM up GROUP BY tile, pixel""")
def accumulate(spark, sf):
    a = T.accumulate(B.uploads(spark, sf).drop("upload"))
    return a.select("tile", "pixel", *[F.round(c, 6).alias(c) for c in ("r", "g", "b", "samples")])
