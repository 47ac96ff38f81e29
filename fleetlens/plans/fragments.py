"""The bindings of ``bindings.py`` as DuckDB common table expressions."""

from __future__ import annotations

UNITS = "(CAST(floor(o_totalprice) AS BIGINT) % 900 + 100)"
HOUR = "(t_ms // 3600000 * 3600000)"

CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], """
SELECT event_id, epoch_us(ts) // 1000 AS t_ms,
  CASE event_type WHEN 'view' THEN 'grant' WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'expire'
       WHEN 'click' THEN 'cancel' WHEN 'signup' THEN 'worker_join' END AS event,
  (user_id * 7 + event_id) % 4000 AS task_id, user_id AS worker_id,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 AS unit_count, value AS duration_ms,
  2.0::DOUBLE * (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1) AS predicted_ms,
  1.0::DOUBLE AS correction, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS speculative,
  strftime(ts, '%Y-%m-%d') AS run, user_id % 2 AS condition,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events"""),
    "allr": ([], f"""
SELECT o_custkey AS job_id, o_orderkey AS task_id, {UNITS} AS unit_count,
  CASE o_orderstatus WHEN 'F' THEN 'Accepted' WHEN 'O' THEN 'Leased' WHEN 'P' THEN 'Queued' END AS state,
  o_custkey % 97 AS holder, epoch_us(o_orderdate) // 1000 AS t_ms,
  CAST(coalesce(sum({UNITS}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_unit,
  CASE WHEN o_orderkey % 11 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END
    AS replica_of,
  epoch_us(o_orderdate) // 1000 + 2592000000 AS lease_expires_at_ms
FROM orders"""),
    "tk": (["allr"], "SELECT * FROM allr"),
    "tg": (["allr"], "SELECT * FROM allr WHERE task_id % 13 <> 0"),
    "jb": ([], f"""
SELECT o_custkey AS job_id, CAST(sum({UNITS}) AS BIGINT) AS total_units,
  CAST(CASE WHEN o_custkey % 3 = 0 THEN sum({UNITS}) - 100 ELSE sum({UNITS}) END AS BIGINT) AS next_unit
FROM orders GROUP BY o_custkey"""),
    "sb": ([], """
SELECT l_orderkey AS task_id, l_suppkey AS worker_id, l_linestatus || l_returnflag AS answer, l_quantity AS value,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice) AS seq FROM lineitem"""),
    "pt": ([], """
SELECT l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS sequence, CAST(l_quantity AS BIGINT) AS units_done,
  l_suppkey AS worker_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey,
    l_suppkey, l_quantity, l_extendedprice) AS arrival FROM lineitem"""),
    "vec": ([], """
SELECT CAST(label AS BIGINT) AS label, (r + 1) // 2 AS pair, r % 2 AS odd, vec_id, embedding FROM (
  SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings)"""),
    "el": (["vec"], """
SELECT label, pair, odd, CAST(unnest(embedding) AS DOUBLE) AS v,
  CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos FROM vec"""),
    "pr": (["el"], """
SELECT coalesce(a.label, b.label) AS label, coalesce(a.pair, b.pair) AS pair, coalesce(a.pos, b.pos) AS pos,
  a.v AS va, b.v AS vb, a.v IS NOT NULL AS in_a, b.v IS NOT NULL AS in_b
FROM (SELECT * FROM el WHERE odd = 1) a FULL JOIN (SELECT * FROM el WHERE odd = 0) b
  ON a.label = b.label AND a.pair = b.pair AND a.pos = b.pos"""),
    "flt": (["pr"], """
SELECT *, abs(va - vb) AS abs_diff, CASE WHEN abs(vb) > 0 THEN abs(va - vb) / abs(vb) ELSE 0.0 END AS rel_diff,
  least(abs(ra - rb), 4294967295) AS ulp FROM (
  SELECT *, CAST(CASE WHEN va = 0 THEN 0 WHEN va < 0 THEN -((ea+126)*8388608.0::DOUBLE + abs(va)*pow(2.0::DOUBLE, 23-ea))
      ELSE (ea+126)*8388608.0::DOUBLE + abs(va)*pow(2.0::DOUBLE, 23-ea) END AS BIGINT) AS ra,
    CAST(CASE WHEN vb = 0 THEN 0 WHEN vb < 0 THEN -((eb+126)*8388608.0::DOUBLE + abs(vb)*pow(2.0::DOUBLE, 23-eb))
      ELSE (eb+126)*8388608.0::DOUBLE + abs(vb)*pow(2.0::DOUBLE, 23-eb) END AS BIGINT) AS rb FROM (
    SELECT *, greatest(CASE WHEN pow(2.0::DOUBLE, ga) > abs(va) THEN ga - 1
                 WHEN pow(2.0::DOUBLE, ga + 1) <= abs(va) THEN ga + 1 ELSE ga END, -126) AS ea,
      greatest(CASE WHEN pow(2.0::DOUBLE, gb) > abs(vb) THEN gb - 1
                 WHEN pow(2.0::DOUBLE, gb + 1) <= abs(vb) THEN gb + 1 ELSE gb END, -126) AS eb FROM (
      SELECT *, CAST(floor(log2(CASE WHEN abs(va) > 0 THEN abs(va) ELSE 1 END)) AS INTEGER) AS ga,
        CAST(floor(log2(CASE WHEN abs(vb) > 0 THEN abs(vb) ELSE 1 END)) AS INTEGER) AS gb
      FROM pr WHERE in_a AND in_b)))"""),
    "px": ([], """
SELECT vec_id, label, i AS pixel, CAST(embedding[i*4+1] AS DOUBLE) AS r, CAST(embedding[i*4+2] AS DOUBLE) AS g,
  CAST(embedding[i*4+3] AS DOUBLE) AS b, abs(CAST(embedding[i*4+4] AS DOUBLE)) + 1.0::DOUBLE AS samples
FROM (SELECT vec_id, label, embedding, unnest(range(0, len(embedding) // 4)) AS i FROM embeddings)"""),
    "up": (["px"], """
SELECT vec_id // 2 AS tile, vec_id AS upload, pixel, r, g, b, samples FROM px WHERE NOT (label = 9 AND pixel = 15)"""),
    "grid": ([], """
SELECT t AS tile, t % 16 * 4 AS x, t // 16 * 4 AS y FROM (
  SELECT unnest(range(0, ((SELECT max(vec_id) FROM embeddings) // 2 + 16) // 16 * 16)) AS t)"""),
    "nu": (["up", "grid"], """
SELECT tile, arg_max(upload, upload) AS upload, arg_max(n0, upload) AS samples, any_value(x) AS x, any_value(y) AS y
FROM (SELECT tile, upload, count(*) AS pixels, max(CASE WHEN pixel = 0 THEN samples END) AS n0 FROM up GROUP BY ALL)
JOIN grid USING (tile) WHERE pixels = 16 GROUP BY tile"""),
    "vd": (["ev"], """
SELECT worker_id, t_ms, event_id AS verdict_id, event IN ('grant', 'accept', 'worker_join') AS accepted,
  CASE k % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 4.0 END::DOUBLE AS severity,
  speculative = 1 AS spot FROM ev"""),
    "rep": (["vd"], """
SELECT *, 2.0::DOUBLE + sum(CASE WHEN accepted THEN 1.0 ELSE 0.0 END::DOUBLE) OVER w AS alpha,
  2.0::DOUBLE + sum(CASE WHEN accepted THEN 0.0 ELSE least(severity * CASE WHEN spot THEN 2 ELSE 1 END, 4.0) END::DOUBLE)
    OVER w AS beta,
  CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER w AS BIGINT) AS accepted_count,
  CAST(sum(CASE WHEN accepted THEN 0 ELSE 1 END) OVER w AS BIGINT) AS rejected_count,
  CAST(sum(CASE WHEN spot AND NOT accepted THEN 1 ELSE 0 END) OVER w AS BIGINT) AS spot_failures
FROM vd WINDOW w AS (PARTITION BY worker_id ORDER BY t_ms, verdict_id)"""),
    "cur": (["vd"], """
SELECT worker_id, 2.0::DOUBLE + sum(CASE WHEN accepted THEN 1.0 ELSE 0.0 END::DOUBLE) AS alpha,
  2.0::DOUBLE + sum(CASE WHEN accepted THEN 0.0 ELSE least(severity * CASE WHEN spot THEN 2 ELSE 1 END, 4.0) END::DOUBLE)
    AS beta FROM vd GROUP BY worker_id"""),
    "rv": ([], """
SELECT o_custkey * 1000 AS start_unit, CAST(floor(o_totalprice) AS BIGINT) % 50 AS unit_count, o_orderkey AS arrival,
  o_orderkey % 3 + 1 AS agreeing, o_orderkey AS checksum FROM orders"""),
    "pool": (["rv"], """
SELECT start_unit, unit_count, min(arrival) AS arrival, arg_min(checksum, arrival) AS checksum FROM rv
WHERE unit_count > 0 AND agreeing >= 2 GROUP BY ALL ORDER BY arrival DESC LIMIT 256"""),
    "ft": (["ev"], """
SELECT event_id, worker_id, condition, CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'cached' WHEN 2 THEN 'peer'
  ELSE 'origin' END AS source, k % 4 <> 0 AS has_input, event = 'expire' AS requeued, k % 4 = 1 AS cached_hit,
  k % 8 AS mask, k % 3 AS attempts, event = 'accept' AS connected, k % 8 >= 4 AS relay FROM ev"""),
    "hold": (["ev"], "SELECT DISTINCT worker_id, k AS asset FROM ev"),
    "tr": ([], """
SELECT source AS arm, toxic = 1 AS wrong, quality = 1 AS accepted, doc_id FROM labels JOIN documents USING (doc_id)"""),
    "hw": (["ev"], f"""
SELECT {HOUR} AS timestamp_ms, worker_id, count(*) FILTER (event = 'accept') AS tasks_completed,
  max(k) AS ice_gathered, bit_or(k) AS flags FROM ev GROUP BY 1, 2"""),
    "jt": (["ev"], """
SELECT *, CASE WHEN first_result_ms <> 0 THEN first_result_ms - joined_ms ELSE -1 END AS ready_ms,
  CASE WHEN first_grant_ms <> 0 THEN first_grant_ms - joined_ms ELSE -1 END AS grant_ms, worker_id % 2 AS condition
FROM (SELECT run, worker_id, min(t_ms) AS joined_ms,
  coalesce(min(t_ms) FILTER (event = 'grant'), 0) AS first_grant_ms,
  coalesce(min(t_ms) FILTER (event = 'accept'), 0) AS first_result_ms,
  CAST(coalesce(sum(unit_count) FILTER (event = 'accept'), 0) AS BIGINT) AS units_completed,
  coalesce(sum(predicted_ms) FILTER (event = 'accept'), 0) AS observed_ms_total,
  max(unit_count) AS unit_count FROM ev GROUP BY run, worker_id)"""),
    "chunks": ([], """
SELECT DISTINCT sha256(text) AS address, i AS index, CAST(ceil(length(text) / 1000.0) AS BIGINT) AS total,
  substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000) AS part
FROM (SELECT text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents)"""),
}


def sql(needs: list[str], body: str) -> str:
    """``body`` under the fragments it needs, dependencies first."""
    seen: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in seen:
            seen.append(name)
    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in seen)
    body = body.strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
