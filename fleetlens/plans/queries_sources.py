"""Sources and sinks over the test tables."""

from pyspark.sql import functions as F

from fleetlens.operators import joins as J
from fleetlens.operators import quality as Y
from fleetlens.plans import bindings as B
from fleetlens.plans.catalog import query
from fleetlens.sources import blobs as L
from fleetlens.sources import tables as S


@query("event_log", ["ev"], """
SELECT event_id, t_ms, event, task_id, worker_id, unit_count, duration_ms, predicted_ms, correction, CAST(speculative AS BIGINT) AS speculative, run FROM ev""")
def event_log(spark, sf):
    return B.event_log(spark, sf).select(
        "event_id", "t_ms", "event", "task_id", "worker_id", "unit_count", "duration_ms", "predicted_ms", "correction",
        F.col("speculative").cast("long").alias("speculative"), "run")


@query("kernel_dim", ["tk"], """
WITH d(kernel_id, determinism, flop_per_unit, r5_min_units) AS (VALUES ('brute_search_v1', 'exact', 80, 400000),
  ('pathtrace_tile_v1', 'statistical', 20480000, 7143), ('calibrate_v1', 'tolerant', 2, 0))
SELECT kernel_id, determinism, count(*) AS tasks, CAST(sum(unit_count * flop_per_unit) AS BIGINT) AS flop,
  count(*) FILTER (unit_count < r5_min_units) AS below_floor
FROM (SELECT unit_count, ['brute_search_v1', 'pathtrace_tile_v1', 'calibrate_v1'][job_id % 3 + 1] AS kernel_id FROM tk) JOIN d USING (kernel_id) GROUP BY ALL""")
def kernel_dim(spark, sf):
    names = F.array(*[F.lit(k[0]) for k in S.KERNELS])
    t = B.tasks(spark, sf).withColumn("kernel_id", F.element_at(names, (F.col("job_id") % 3 + 1).cast("int")))
    return S.with_kernel(t).groupBy("kernel_id", "determinism").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum(F.col("unit_count") * F.col("flop_per_unit")).alias("flop"),
        F.count_if(F.col("unit_count") < F.col("r5_min_units")).alias("below_floor"))


@query("snapshot_fleet", ["hw"], """
SELECT timestamp_ms, worker_id, tasks_completed, ice_gathered, flags & 1 <> 0 AS ice_host, flags & 2 <> 0 AS ice_srflx,
  flags & 4 <> 0 AS ice_relay FROM hw""")
def snapshot_fleet(spark, sf):
    return S.explode_fleet(B.snapshots(spark, sf))


@query("snapshot_states", ["ev"], """
SELECT timestamp_ms, state, count(*) FILTER (event = state) AS count FROM (SELECT t_ms // 3600000 * 3600000 AS timestamp_ms, event FROM ev),
  (SELECT unnest(['grant', 'accept', 'expire', 'cancel', 'worker_join']) AS state) GROUP BY timestamp_ms, state""")
def snapshot_states(spark, sf):
    return S.explode_states(B.snapshots(spark, sf))


def _reports(spark, sf, shift: int):
    """Part keys as a probe dump: a header line, then little-endian words, per
    brand. ``shift`` changes the words of large parts, so two reports differ."""
    p = B.table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    word = F.col("p_partkey") + F.when(F.col("p_size") > 45, F.lit(shift)).otherwise(F.lit(0))
    big = F.lpad(F.lower(F.hex(word)), 8, "0")
    little = F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", little.alias("w")))), lambda x: x["w"]), "\n")
    k = p.groupBy(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("k")).agg(body.alias("body"))
    text = F.concat(F.lit("kernel="), "k", F.lit(" fnv1a="), F.substring(F.md5(F.col("body").cast("binary")), 1, 16),
                    F.lit(" match=yes\n"), "body", F.lit("\n"))
    return k.select(F.lit(f"report-{shift}").alias("report"), text.alias("text"))


@query("probe_elements", [], """
SELECT 'report-1' AS report, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS kernel,
  row_number() OVER (PARTITION BY regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') ORDER BY p_partkey) - 1 AS pos,
  p_partkey + CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS bits FROM part""")
def probe_elements(spark, sf):
    return S.parse_probe_reports(_reports(spark, sf, 1)).select("report", "kernel", "pos", "bits")


@query("report_diff", [], """
WITH p AS (SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS kernel, p_size,
  row_number() OVER (PARTITION BY regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') ORDER BY p_partkey) - 1 AS pos FROM part)
SELECT kernel, CASE WHEN count(*) FILTER (p_size > 45) = 0 THEN 'MATCH' ELSE 'MISMATCH' END AS status, count(*) AS words,
  count(*) FILTER (p_size > 45) AS differing, coalesce(min(pos) FILTER (p_size > 45), -1) AS first_diff FROM p GROUP BY kernel""")
def report_diff(spark, sf):
    a, b = (S.parse_probe_reports(_reports(spark, sf, s)) for s in (0, 1))
    return J.report_diff(a, b)


@query("content_dedup", [], """
SELECT sha256(text) AS address, max(strlen(text)) AS bytes, count(*) AS copies, min(doc_id) AS stored_id FROM documents GROUP BY 1""")
def content_dedup(spark, sf):
    return L.content_put(B.table(spark, sf, "documents"), "text", "doc_id")


@query("blob_chunks", ["chunks"], "SELECT address, index, total, md5(part) AS digest, length(part) AS n FROM chunks")
def blob_chunks(spark, sf):
    blobs = L.stored_blobs(B.table(spark, sf, "documents"), "text")
    c = L.split_chunks(blobs, "text", size=1000)
    return c.select("address", "index", "total", F.md5(F.col("part").cast("binary")).alias("digest"), F.length("part").cast("long").alias("n"))


@query("blob_reassembly", [], """
WITH d AS (SELECT doc_id, sha256(text) AS address, text, lang, length(text) AS n, CAST(ceil(length(text) / 1000.0) AS BIGINT) AS total FROM documents),
 m AS (SELECT DISTINCT address, n AS expected, total FROM d),
 c AS (SELECT address, doc_id * 1000 + i AS seq, i AS index, total, n,
   CASE WHEN lang = 'fr' AND i = 0 THEN reverse(substr(text, 1, 1000)) WHEN lang = 'es' AND i = 0 AND total > 1 THEN substr(text, 1, 900)
     ELSE substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000) END AS part
   FROM (SELECT *, unnest(range(0, total)) AS i FROM d) WHERE NOT (lang = 'de' AND i = total - 1 AND total > 1)),
 j AS (SELECT *, CASE WHEN length(part) < 1000 AND index + 1 <> total THEN 'short piece before the end' END AS reason FROM c),
 f AS (SELECT address, index, min(seq) AS seq, arg_min(part, seq) AS part FROM j WHERE reason IS NULL GROUP BY ALL),
 b AS (SELECT address, count(*) AS have, max(seq) AS done_seq, string_agg(part, '' ORDER BY index) AS content FROM f GROUP BY address),
 x AS (SELECT address, min(seq) AS bad_seq FROM j WHERE reason IS NOT NULL GROUP BY address)
SELECT m.address, CASE WHEN bad_seq IS NOT NULL AND (coalesce(have, 0) <> m.total OR bad_seq < done_seq) THEN 'short piece before the end'
   WHEN coalesce(have, 0) <> m.total THEN 'incomplete' WHEN sha256(content) <> m.address THEN 'digest mismatch' ELSE 'verified' END AS status,
  coalesce(have, 0) AS have, m.total AS want_total FROM m LEFT JOIN b USING (address) LEFT JOIN x USING (address)""")
def blob_reassembly(spark, sf):
    d = B.table(spark, sf, "documents").withColumn("address", F.sha2(F.col("text").cast("binary"), 256))
    manifest = d.select("address", F.length("text").cast("long").alias("expected")).dropDuplicates()
    c = L.split_chunks(d.select(F.struct("address", "doc_id", "lang").alias("key"), "text"), "text", "key", 1000)
    c = c.select("key.*", "index", "total", "part").where(
        ~((F.col("lang") == "de") & (F.col("index") == F.col("total") - 1) & (F.col("total") > 1)))
    first = F.col("index") == 0
    part = (F.when((F.col("lang") == "fr") & first, F.reverse("part"))
            .when((F.col("lang") == "es") & first & (F.col("total") > 1), F.substring("part", 1, 900)).otherwise(F.col("part")))
    sent = c.select("address", (F.col("doc_id") * 1000 + F.col("index")).alias("seq"), "index", "total", part.alias("part"))
    return L.reassemble(sent, manifest, 1000).select("address", "status", "have", "want_total")


def _rule(name: str, cond: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) FILTER ({cond}) AS violations, coalesce(min(doc_id) FILTER ({cond}), -1) AS sample FROM m"


@query("quality_report", [], "WITH m AS (SELECT *, strlen(text) AS n, CAST(ceil(strlen(text) / 16384.0) AS BIGINT) AS ct, "
       "CAST(ceil(n_chars / 16384.0) AS BIGINT) AS ec FROM documents) " + " UNION ALL ".join([
           _rule("params_size", "n > 4096"), _rule("output_size", "n * 300 > 8388608"), _rule("envelope_size", "n * 8 > 65536"),
           _rule("single_in_flight", "false"), _rule("lease_held", "source = 'src1'"), _rule("replica_worker_new", "lang = 'de'"),
           _rule("upload_interval", "n_chars % 1000 <> 0 AND n_chars % 1000 < 500"), _rule("checksum", "trim(text) <> text"),
           _rule("payload_length", "n_chars <> n"), _rule("chunk_total", "ct <> ec"), _rule("chunk_index", "ct - 1 >= ct"),
           _rule("chunk_size", "n % 20000 > 16384"), _rule("chunk_short", "false")]))
def quality_report(spark, sf):
    m = B.messages(spark, sf)
    return Y.quality_report(m, Y.usable_rules(m), "doc_id")


@query("quarantine", [], """
SELECT doc_id, CAST(CASE WHEN source = 'src1' THEN 1 ELSE 0 END + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS BIGINT) AS broken
FROM documents WHERE source = 'src1' OR lang = 'de'""")
def quarantine(spark, sf):
    m = B.messages(spark, sf).select("doc_id", "lease_held", "worker_is_prior")
    return Y.quarantine(m, Y.usable_rules(m)).select("doc_id", F.size("broken_rules").cast("long").alias("broken"))
