"""DuckDB twins of the corpus queries."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {}

ORACLE["op10_curriculum_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
stops AS (
  SELECT *, coalesce(sum(2 * source_size) OVER b, 0) AS taken_before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left,
         sum(source_size) OVER () * 1.5 AS all_words
  FROM sources WINDOW b AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (
  SELECT *, CAST(all_words - taken_before AS DOUBLE) / weight_left > CAST(2 * source_size AS DOUBLE) / weight AS stopped FROM stops),
targets AS (
  SELECT source, source_size,
         CASE WHEN stopped THEN CAST(2 * source_size AS DOUBLE)
              ELSE weight * (CAST(all_words - coalesce(sum(CASE WHEN stopped THEN 2 * source_size END) OVER (), 0) AS DOUBLE)
                             / sum(CASE WHEN NOT stopped THEN weight END) OVER ()) END AS target
  FROM flagged),
placed AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         + size / 2.0 AS middle
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (CAST(middle <= target AS INTEGER) + CAST(middle + source_size <= target AS INTEGER)) AS BIGINT) AS taken
FROM placed
"""


def _url_sql() -> str:
    facts = rf"""
facts AS (
  SELECT page_id, html, {LOWER.format(r"regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS rule_verdict
  FROM facts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
seeds AS (
  SELECT host, count(*) FILTER (rule_verdict = 'allow') * 1000000000 // count(*) AS a,
         count(*) FILTER (rule_verdict = 'block') * 1000000000 // count(*) AS b
  FROM facts LEFT JOIN fits USING (page_id) WHERE host <> '' GROUP BY host),
links AS (
  SELECT DISTINCT host AS src, {LOWER.format("dst")} AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)) AS dst
        FROM facts WHERE html IS NOT NULL) WHERE host <> '' AND host <> {LOWER.format("dst")}),
hops AS (
  SELECT src AS at_host, dst AS to_host, 'a' AS kind FROM links UNION ALL SELECT dst, src, 'b' FROM links),
degrees AS (SELECT src, count(*) AS degree FROM links GROUP BY src),
start AS (
  SELECT host, 'a' AS kind, a * 15 // 100 AS mass FROM seeds WHERE a * 15 // 100 > 0
  UNION ALL SELECT host, 'b', b * 15 // 100 FROM seeds WHERE b * 15 // 100 > 0),
r0 AS (SELECT * FROM start)"""
    rounds = ""
    for n in range(1, 11):
        rounds += f""",
r{n} AS (
  SELECT host, kind, CAST(sum(mass) AS BIGINT) AS mass FROM (
    SELECT * FROM start UNION ALL
    SELECT to_host, r.kind, mass * 85 // (100 * degree) FROM r{n - 1} r
    JOIN hops h ON r.host = h.at_host AND r.kind = h.kind JOIN degrees d ON d.src = CASE h.kind WHEN 'a' THEN h.at_host ELSE h.to_host END)
  GROUP BY host, kind)"""
    return f"""WITH {facts.strip()}{rounds},
scores AS (
  SELECT host, CAST(coalesce(sum(mass) FILTER (kind = 'a'), 0) AS BIGINT) AS trust,
         CAST(coalesce(sum(mass) FILTER (kind = 'b'), 0) AS BIGINT) AS distrust FROM r10 GROUP BY host)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN distrust >= 50000000 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM facts LEFT JOIN fits USING (page_id) LEFT JOIN scores USING (host)
"""


ORACLE["op2_url_filters"] = _url_sql()

ORACLE["op4_ngram_jaccard_join"] = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b USING (s)
           WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * i >= 75 * (p.n + q.n - i)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM ends UNION SELECT r.x, b.y FROM reach r JOIN ends b ON r.y = b.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) AS component_id
FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON t.doc_id = least.x
"""

ORACLE["op1_benchmark_decontamination"] = rf"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[pos:pos+n-1], ' ') AS s
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS pos
        FROM (SELECT *, least(len(w), 13) AS n FROM item_words WHERE len(w) > 0))),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, w
  FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (
  SELECT doc_id, p.n, pos, item_id FROM places p JOIN windows v ON v.n = p.n AND v.s = array_to_string(w[pos:pos+p.n-1], ' ')),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM (SELECT DISTINCT doc_id, n, pos FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op11_lexical_search"] = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
spread AS (SELECT doc_id, 100 - 90 + ((90 * n * docs) // terms) AS m FROM lengths, totals),
rare AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
         FROM counted, totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN rare USING (term) JOIN spread USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
           FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLE["op12_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
draws AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS UBIGINT) % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 100
              THEN 'plain' WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT *, array_to_string(u[1:CAST(least(x, y) AS BIGINT)], '') AS p,
         array_to_string(u[CAST(least(x, y) AS BIGINT) + 1:CAST(greatest(x, y) AS BIGINT)], '') AS m,
         array_to_string(u[CAST(greatest(x, y) AS BIGINT) + 1:], '') AS s FROM draws)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
