"""DuckDB twins of the registered queries, built from shared CTEs."""

from __future__ import annotations

from checks import tables as t
from tideline.functions.labels import LEAP_TABLE

AS_OF_MS = t.AS_OF_MS
DAY = 86_400_000


def leap(ms: str) -> str:
    whens = " ".join(
        f"WHEN {ms} > epoch_ms(TIMESTAMP '{day}') THEN {off}" for day, off in reversed(LEAP_TABLE)
    )
    return f"(CASE {whens} ELSE 0 END)"


def encode(ms: str, offset: str = "35") -> str:
    shifted = f"({ms} + {offset} * 1000)"
    return (
        f"format('{{:016x}}{{:08x}}', {shifted} // 1000 + 4611686018427387904, "
        f"({shifted} % 1000) * 1000000)"
    )


def shifted_ms(label: str) -> str:
    return (
        f"((CAST(concat('0x', substr({label}, 1, 16)) AS BIGINT) - 4611686018427387904) * 1000 "
        f"+ CAST(concat('0x', substr({label}, 17, 8)) AS BIGINT) // 1000000)"
    )


def decode(label: str, offset: str = "35") -> str:
    return f"({shifted_ms(label)} - {offset} * 1000)"


def day_of(ms: str) -> str:
    return f"CAST(make_timestamp(({ms}) * 1000) AS DATE)"


def iso(day: str) -> str:
    return f"strftime({day}, '%Y-%m-%d')"


ROTATED = f"""
raw_files AS (
  SELECT event_type AS service, 'main' AS category, 'h' || (user_id % 4) AS host,
         max((epoch_us(ts) // 1000)) AS label_ms,
         CAST(sum(length(props) + length(event_type) + 20) AS BIGINT) AS size_bytes
  FROM events GROUP BY event_type, user_id % 4, event_id // {t.EVENTS_PER_FILE}),
files AS (
  SELECT *, {encode('label_ms')} AS label, '@' || {encode('label_ms')} || '.s' AS file_name,
         {day_of('label_ms')} AS day
  FROM raw_files)"""

ARCHIVE = f"""{ROTATED},
listing AS (
  SELECT CASE WHEN service = 'view' AND host = 'h0' AND day <= DATE '2024-01-05'
              THEN DATE '2024-01-31' ELSE CAST(day + 1 AS DATE) END AS dir_date,
         strftime(day, '%Y,%m,%d') || ',' || service || ',' || host || ',' || label || '.seq'
           AS file_name,
         service, host, label AS taistamp, day AS name_date
  FROM files
  WHERE service <> 'signup' AND NOT (service = 'purchase' AND host = 'h3')
    AND day <= DATE '2024-01-30' - CASE service WHEN 'error' THEN 2 WHEN 'click' THEN 0 ELSE 1 END),
archive AS (
  SELECT * FROM listing
  WHERE NOT (service = 'view' AND host = 'h0' AND dir_date = DATE '2024-01-31'))"""

PLAN = f"""{ARCHIVE},
state AS (
  SELECT service, category, host, CAST(sum(size_bytes) AS BIGINT) AS ready_bytes,
         count(*) AS n_files,
         greatest(min(label_ms), {AS_OF_MS - 3 * DAY}) AS lookback_ms
  FROM files GROUP BY ALL),
seen AS (
  SELECT s.service, s.category, s.host, a.dir_date, a.taistamp,
         rank() OVER (PARTITION BY s.service, s.category, s.host ORDER BY a.dir_date DESC) AS r
  FROM state s JOIN archive a ON a.service = s.service AND a.host = s.host
  WHERE a.dir_date = DATE '2024-01-31'
     OR (a.dir_date >= {day_of('s.lookback_ms')} AND a.dir_date < DATE '2024-01-31')),
marks AS (
  SELECT service, category, host, max(taistamp) AS last_taistamp FROM seen WHERE r = 1 GROUP BY ALL),
size_limit AS (SELECT sum(ready_bytes) // count(*) AS max_ready FROM state),
decided AS (
  SELECT s.*, m.last_taistamp,
         CASE WHEN m.last_taistamp IS NULL THEN 'first'
              WHEN {decode('m.last_taistamp')} > {AS_OF_MS} THEN 'throttled'
              WHEN ({AS_OF_MS} - {decode('m.last_taistamp')}) // 1000 >= {t.SHIP_INTERVAL}
                THEN 'interval'
              WHEN s.ready_bytes > (SELECT max_ready FROM size_limit) THEN 'size'
              ELSE 'throttled' END AS decision
  FROM state s LEFT JOIN marks m USING (service, category, host)),
plan AS (SELECT *, decision <> 'throttled' AS ships FROM decided),
outstanding AS (
  SELECT f.* FROM files f JOIN plan p USING (service, category, host)
  WHERE p.ships AND (p.last_taistamp IS NULL OR f.label > p.last_taistamp)
    AND f.label_ms >= {AS_OF_MS - 4 * DAY})"""

DOCS = f"""
docs AS (
  SELECT source AS service, lang AS category, 'h' || (doc_id % 4) AS host, doc_id,
         doc_id + {t.DOC_BASE_MS} AS label_ms,
         {encode(f'(doc_id + {t.DOC_BASE_MS})')} AS label,
         '@' || {encode(f'(doc_id + {t.DOC_BASE_MS})')} || '.s' AS file_name,
         strlen(text) AS size_bytes,
         regexp_replace(text, '(\\r\\n|\\r|\\n)$', '') AS text
  FROM documents WHERE text <> ''),
doc_lines AS (
  SELECT * EXCLUDE (line_no), line_no - 1 AS line_no FROM (
    SELECT service, category, host, doc_id, label, file_name,
           unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS line_no
    FROM docs))"""

SPOILED_FILES = """spoiled_files AS (
  SELECT *, service = 'error' AS bad_dir, substr(file_name, 17, 1) = '7' AS bad_name,
         CASE WHEN service = 'error' THEN service || '@' || host
              ELSE service || '@' || category || '@' || host END AS dir_name
  FROM files)"""

ALL_DOCS = f"""
all_docs AS (
  SELECT source AS service, lang AS category, 'h' || (doc_id % 4) AS host, doc_id,
         '@' || {encode(f'(doc_id + {t.DOC_BASE_MS})')} || '.s' AS file_name,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS size_bytes
  FROM documents)"""

DOC_UNITS = f"""{DOCS},
doc_marks AS (
  SELECT service, host, max(label) AS last_taistamp FROM docs
  WHERE doc_id < {t.SHIPPED_DOCS} GROUP BY ALL),
doc_out AS (
  SELECT d.* FROM docs d LEFT JOIN doc_marks m USING (service, host)
  WHERE m.last_taistamp IS NULL OR d.label > m.last_taistamp),
units AS (
  SELECT service, category, host, min(label) AS first_label, max(label) AS last_label,
         count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS bytes,
         strftime({day_of('max(label_ms)')}, '%Y,%m,%d') || ',' || service || ',' || host || ','
           || max(label) || '.seq' AS archive_name
  FROM doc_out GROUP BY service, category, host)"""

KEY_CASE = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in t.TELEMETRY_KEYS.items()
) + " ELSE event_type END"

TELEMETRY = f"""
telemetry AS (
  SELECT {t.TELEMETRY_BASE_MS} + (event_id // {t.RECORDS_PER_HOUR}) * 3600000 + (event_id % 240) * 1000
           + (event_id // 240) % 1000 AS ms,
         event_id AS seq, {KEY_CASE} AS key,
         CASE WHEN event_id % 101 = 0 THEN 'many' ELSE CAST(event_id % 7 AS VARCHAR) END AS word,
         event_id % 103 = 0 AS short
  FROM events),
records AS (
  SELECT ms, seq, key, CAST(word AS BIGINT) AS amount, ms - ms % 30000 AS window_ms
  FROM telemetry WHERE NOT short AND word <> 'many')"""

ROLLED = f"""{TELEMETRY},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY window_ms ORDER BY ms DESC, seq DESC) AS r,
         count(*) OVER (PARTITION BY window_ms) AS n
  FROM records),
defaults AS (
  SELECT * FROM (VALUES ('files_to_ship', 4), ('failed_to_get_sync_list', 3),
                        ('rotated_during_ship', 2), ('lost_during_ship', 1)) d(key, age)),
entries AS (
  SELECT window_ms, key, amount FROM ranked
  UNION ALL
  SELECT w.window_ms, d.key, 0 FROM (SELECT DISTINCT window_ms FROM ranked) w, defaults d),
rolled AS (
  SELECT window_ms, key, CAST(sum(amount) AS BIGINT) AS total FROM entries GROUP BY ALL)"""

LISTING = f"""
named AS (
  SELECT event_id, 'h' || (user_id % 4) AS agent,
         '@' || {encode('(epoch_us(ts) // 1000)')} || '.s' AS file_name,
         '@' || {encode('(epoch_us(ts) // 1000)')} || '.u' AS part_name
  FROM events),
local AS (
  SELECT agent, file_name, event_id FROM named
  UNION ALL
  SELECT agent, CASE WHEN event_id % 194 = 0 THEN 'lock~' ELSE part_name END, event_id
  FROM named WHERE event_id % 97 = 0),
newest AS (SELECT agent, max(event_id) AS newest FROM named GROUP BY agent),
missing AS (
  SELECT n.agent, n.file_name FROM named n JOIN newest USING (agent)
  WHERE n.event_id % 5 = 0 OR n.event_id >= newest - 40),
clean AS (
  SELECT agent, file_name FROM local
  WHERE file_name NOT IN ('config', 'current', 'lock')
    AND NOT (file_name LIKE '%.u' OR file_name LIKE '%~')),
held AS (
  SELECT * FROM clean c
  WHERE NOT EXISTS (SELECT 1 FROM missing m
                    WHERE m.agent = c.agent AND m.file_name = c.file_name)),
high AS (SELECT agent, max(file_name) AS high_mark FROM held GROUP BY agent),
candidates AS (
  SELECT m.agent, m.file_name FROM missing m LEFT JOIN high h USING (agent)
  WHERE h.high_mark IS NULL OR m.file_name > h.high_mark)"""

ATTEMPTS = f"""
attempts AS (
  SELECT 'h' || (user_id % 4) AS agent, event_id // 200 AS cycle, event_id,
         '@' || {encode('(epoch_us(ts) // 1000)')} || '.s' AS file_name, event_id % 11 <> 0 AS ok
  FROM events),
flagged AS (
  SELECT *, NOT ((ok AND event_id % 13 <> 0) OR event_id % 1001 = 0) AS gone FROM attempts)"""

RETENTION = f"""{ARCHIVE},
totals AS (
  SELECT service, category, host, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
  FROM files GROUP BY ALL),
flags AS (
  SELECT f.*,
         sum(f.size_bytes) OVER later > t.total_bytes // 2
           AND f.label_ms < LIMIT_MS
           AND f.label <> max(f.label) OVER (PARTITION BY f.service, f.category, f.host)
           AS to_delete
  FROM files f JOIN totals t USING (service, category, host)
  WINDOW later AS (PARTITION BY f.service, f.category, f.host ORDER BY f.label
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

CHANNEL = """
ev AS (
  SELECT 'h' || (user_id % 4) AS agent, epoch_us(ts) // 1000000 AS second, epoch_us(ts) AS us,
         (1000000000 - event_id) * 2 AS seq, 'poll' AS kind FROM events
  UNION ALL
  SELECT 'h' || (user_id % 4), epoch_us(ts) // 1000000, epoch_us(ts),
         (1000000000 - event_id) * 2 + 1, 'heartbeat' FROM events
  WHERE event_type IN ('click', 'view')),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY agent ORDER BY us, seq) AS n FROM ev),
walk AS (
  SELECT agent, n, second, kind, true AS ok, second AS clock, false AS switched
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT e.agent, e.n, e.second, e.kind,
         CASE WHEN e.kind = 'poll' AND e.second - w.clock >= 600 THEN NOT w.ok ELSE w.ok END,
         CASE WHEN e.kind = 'poll' AND e.second - w.clock >= 600 THEN e.second
              WHEN e.kind = 'heartbeat' AND w.ok THEN e.second ELSE w.clock END,
         e.kind = 'poll' AND e.second - w.clock >= 600
  FROM walk w JOIN numbered e ON e.agent = w.agent AND e.n = w.n + 1)"""

EVENT_LINES = """
event_lines AS (
  SELECT 'shop' AS service, 'h' || (user_id % 4) AS host, event_id,
         CASE WHEN event_id % 50 = 0 THEN ''
              ELSE upper(event_type) || ' ' || event_id || ' ' || props END AS line
  FROM events),
routed AS (
  SELECT service || '.' || CASE WHEN starts_with(line, 'ERROR') THEN 'errors' ELSE 'main' END
           || '.' || host AS topic, line
  FROM event_lines WHERE line <> '')"""

SPOILED = f"""{ARCHIVE},
spoiled AS (
  SELECT dir_date,
         CASE WHEN substr(file_name, length(file_name) - 12, 1) = '7'
              THEN replace(file_name, ',', ';') ELSE file_name END AS file_name,
         substr(file_name, length(file_name) - 12, 1) <> '7' AS name_ok,
         service, host, taistamp, name_date
  FROM listing)"""

MERGED_COLUMNS = "l.service, l.category, l.host, u.archive_name, l.label, l.line_no, l.line"
MERGED = f"""
  SELECT {MERGED_COLUMNS}
  FROM doc_lines l JOIN units u USING (service, category, host)
  WHERE l.label BETWEEN u.first_label AND u.last_label"""

ORDER_MS = "(epoch_us(o_orderdate) // 1000)"
ORDER_LABEL = encode(ORDER_MS, leap(ORDER_MS))


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select}"


def oracle_sql() -> dict[str, str]:
    size_bound = RETENTION.replace("LIMIT_MS", "1706313600000")
    dir_cols = "service, category, host"
    sql = {
        "src1_inventory": _with(
            ALL_DOCS, f"SELECT {dir_cols}, file_name, size_bytes FROM all_docs UNION ALL "
                      f"SELECT {dir_cols}, file_name || '.done', 0 FROM all_docs WHERE doc_id % 5 = 0"),
        "src2_service_dirs": _with(
            ALL_DOCS, f"SELECT DISTINCT service || '@' || category || '@' || host AS dir_name, "
                      f"{dir_cols} FROM all_docs UNION ALL "
                      "SELECT DISTINCT '_idle' || c_nationkey || CASE WHEN c_nationkey % 7 = 0 THEN '-' "
                      "ELSE '@' END || lower(c_mktsegment) || '@h0', "
                      "CASE WHEN c_nationkey % 7 <> 0 THEN '_idle' || c_nationkey END, "
                      "CASE WHEN c_nationkey % 7 <> 0 THEN lower(c_mktsegment) END, "
                      "CASE WHEN c_nationkey % 7 <> 0 THEN 'h0' END FROM customer"),
        "src3_archive_listing": _with(
            ARCHIVE, f"SELECT {iso('dir_date')} AS dir_date, file_name FROM listing "
                     "WHERE dir_date BETWEEN DATE '2024-01-28' AND DATE '2024-01-31'"),
        "src4_log_lines": _with(
            DOCS + "", f"SELECT {dir_cols}, file_name, line_no, line FROM doc_lines"),
        "src5_telemetry": _with(
            TELEMETRY, "SELECT ms, key, amount FROM records"),
        "src6_topic_lines": _with(EVENT_LINES, "SELECT topic, line FROM routed"),
        "snk1_sequencefile": _with(
            DOCS, f"SELECT CAST({AS_OF_MS} AS BIGINT) AS ship_ms, line FROM doc_lines"),
        "snk2_publish": _with(
            DOC_UNITS,
            f"SELECT {MERGED_COLUMNS.replace('l.line_no, ', '')}, '2024-01-31' AS dir_date "
            "FROM doc_lines l JOIN units u USING (service, category, host) "
            "WHERE l.label BETWEEN u.first_label AND u.last_label"),
        "snk3_delete": _with(
            DOCS + """,
sums AS (
  SELECT *, sum(size_bytes) OVER (PARTITION BY service, category, host ORDER BY label
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_bytes,
         max(label) OVER (PARTITION BY service, category, host) AS newest
  FROM docs)""",
            f"SELECT {dir_cols}, file_name FROM sums "
            "WHERE NOT (left_bytes > 2000 AND label <> newest)"),
        "snk4_metrics": _with(ROLLED, "SELECT window_ms, key, total FROM rolled"),
        "prj1_label": _with(ROTATED, f"SELECT {dir_cols}, file_name, label FROM files"),
        "prj2_label_time": f"""
WITH x AS (SELECT o_orderkey, {ORDER_LABEL} AS label FROM orders),
y AS (SELECT *, {shifted_ms('label')} AS shifted FROM x)
SELECT o_orderkey, label, shifted - {leap('shifted')} * 1000 AS label_ms FROM y""",
        "prj3_time_label": f"""
SELECT 'events' AS origin, event_id AS id, {encode('(epoch_us(ts) // 1000)')} AS label FROM events
UNION ALL SELECT 'orders', o_orderkey, {ORDER_LABEL} FROM orders""",
        "jn4_leap_asof": f"""
SELECT o_orderkey, CAST({leap(ORDER_MS)} AS BIGINT) AS leap_seconds FROM orders""",
        "prj4_service_dir": _with(
            DOCS, f"SELECT doc_id, {dir_cols}, true AS dir_ok FROM docs WHERE doc_id % 10 <> 3 "
                  "UNION ALL SELECT doc_id, NULL, NULL, NULL, false FROM docs "
                  "WHERE doc_id % 10 = 3"),
        "prj5_destination": _with(
            DOCS, "SELECT doc_id, service || '@' || category || '@' || host AS target FROM docs"),
        "prj6_archive_parse": _with(
            SPOILED,
            f"SELECT {iso('dir_date')} AS dir_date, file_name, name_ok, "
            f"CASE WHEN name_ok THEN {iso('name_date')} END AS name_date, "
            "CASE WHEN name_ok THEN service END AS service, "
            "CASE WHEN name_ok THEN host END AS host, "
            "CASE WHEN name_ok THEN taistamp END AS taistamp FROM spoiled"),
        "prj7_archive_name": _with(
            ROTATED, "SELECT service, host, label, strftime(day, '%Y,%m,%d') || ',' || service "
                     "|| ',' || host || ',' || label || '.seq' AS archive_name FROM files"),
        "prj8_day_path": """
SELECT event_id, strftime(CAST(ts AS DATE) - 3, '%Y-%m-%d') AS bucket,
       strftime(CAST(ts AS DATE) - 3, '%Y/%m-%d') AS path FROM events""",
        "prj9_utf8_repair": """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '?' || text || '?A' END AS line
FROM documents""",
        "prj10_telemetry_parse": _with(
            TELEMETRY,
            "SELECT seq, 'svc' AS service, 'main' AS category, CASE WHEN short THEN NULL "
            "ELSE key END AS key, CASE WHEN short OR word = 'many' THEN '-' ELSE word END AS "
            "amount, NOT (short OR word = 'many') AS report_ok FROM telemetry"),
        "prj12_key_value": _with(TELEMETRY, "SELECT key, amount FROM records"),
        "prj13_tag_lines": """
WITH x AS (SELECT doc_id, source || '.' || lang AS topic,
                  unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT * FROM x WHERE line <> ''""",
        "flt1_exclude": _with(
            DOCS, "SELECT doc_id, file_name FROM docs WHERE doc_id % 7 <> 0 "
                  "AND doc_id % 11 <> 0"),
        "flt2_agent_exclude": _with(LISTING, "SELECT agent, file_name FROM clean"),
        "flt3_rotated_names": _with(
            LISTING, "SELECT agent, file_name FROM local WHERE starts_with(file_name, '@')"),
        "flt4_service_match": _with(
            ARCHIVE, f"SELECT s.service, s.category, s.host, {iso('a.dir_date')} AS dir_date, "
                     "a.file_name FROM (SELECT DISTINCT service, category, host FROM files) s "
                     "JOIN archive a USING (service, host)"),
        "flt5_outstanding": _with(PLAN, f"SELECT {dir_cols}, file_name FROM outstanding"),
        "flt6_lookback": _with(
            ARCHIVE, f"SELECT {iso('dir_date')} AS dir_date, file_name FROM listing "
                     "WHERE dir_date BETWEEN DATE '2024-01-28' AND DATE '2024-01-31'"),
        "flt7_elapsed": f"""
SELECT event_id, ({AS_OF_MS} - (epoch_us(ts) // 1000)) // 1000 >= {t.SHIP_INTERVAL} AS due FROM events""",
        "flt8_decision": _with(PLAN, f"SELECT {dir_cols}, decision, ships FROM plan"),
        "flt9_tail": _with(
            EVENT_LINES, "SELECT topic, line FROM routed WHERE starts_with(topic, 'shop.errors') "
                         "OR starts_with(topic, 'shop.main.h2')"),
        "flt10_nonblank": _with(
            EVENT_LINES, "SELECT event_id, line FROM event_lines WHERE line <> ''"),
        "flt11_route": _with(
            EVENT_LINES, "SELECT event_id, CASE WHEN starts_with(line, 'ERROR') THEN 'errors' "
                         "ELSE 'main' END AS stream FROM event_lines"),
        "jn1_service_watermark": _with(
            PLAN, f"SELECT {dir_cols}, last_taistamp FROM plan"),
        "jn2_files_watermark": _with(
            PLAN, "SELECT f.service, f.category, f.host, f.file_name FROM files f JOIN plan p "
                  "USING (service, category, host) WHERE f.label > p.last_taistamp"),
        "jn3_missing": _with(
            ATTEMPTS, "SELECT agent, cycle, file_name FROM flagged WHERE gone"),
        "jn5_on_server": _with(LISTING, "SELECT agent, file_name FROM held"),
        "agg1_ready_bytes": _with(PLAN, f"SELECT {dir_cols}, ready_bytes FROM state"),
        "agg2_watermark": _with(
            ARCHIVE, f"""
SELECT service, host, {iso('max(dir_date)')} AS newest_dir,
       arg_max(taistamp, strftime(dir_date, '%Y%m%d') || taistamp) AS last_taistamp
FROM listing GROUP BY service, host"""),
        "agg3_lookback": _with(PLAN, f"SELECT {dir_cols}, lookback_ms FROM state"),
        "agg4_high_mark": _with(LISTING, "SELECT agent, high_mark FROM high"),
        "agg5_sum_by_key": _with(
            TELEMETRY, "SELECT key, CAST(sum(amount) AS BIGINT) AS total FROM records GROUP BY key"),
        "agg6_zero_fill": _with(
            ROLLED, "SELECT window_ms, key FROM (SELECT DISTINCT window_ms, n FROM ranked) w, "
                    "defaults d WHERE least(w.n, 1000) + d.age <= 1000"),
        "agg8_collapse": _with(
            SPOILED, f"""
, bad_days AS (SELECT DISTINCT dir_date FROM spoiled WHERE NOT name_ok)
SELECT {iso('dir_date')} AS dir_date, file_name, name_ok FROM spoiled
WHERE NOT name_ok OR dir_date NOT IN (SELECT dir_date FROM bad_days)"""),
        "agg9_retention_summary": _with(
            size_bound,
            f"SELECT {dir_cols}, count(*) FILTER (to_delete) AS n_deleted, "
            "CAST(sum(CASE WHEN to_delete THEN 0 ELSE size_bytes END) // 1024 AS BIGINT) AS "
            "kb_left FROM flags GROUP BY ALL"),
        "agg10_runlog": """
WITH runs AS (SELECT event_type AS phase, CAST(floor(value * 100 + 0.5) AS BIGINT) AS duration_ms
              FROM events)
SELECT phase, count(*) AS n_runs, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
       CAST(sum(duration_ms) AS BIGINT) AS total_ms,
       quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms
FROM runs GROUP BY phase""",
        "w1_retention": _with(
            size_bound, f"SELECT {dir_cols}, file_name, size_bytes, to_delete FROM flags"),
        "w2_newest_dir": _with(
            ARCHIVE, f"""
SELECT service, host, {iso('dir_date')} AS dir_date, file_name FROM (
  SELECT *, dense_rank() OVER (PARTITION BY service, host ORDER BY dir_date DESC) AS r
  FROM listing) WHERE r = 1"""),
        "w3_newest_records": _with(
            ROLLED, "SELECT window_ms, seq, key, amount FROM ranked WHERE r <= 1000"),
        "w4_first_last": _with(
            ROTATED, f"SELECT {dir_cols}, min(file_name) AS first_name, max(file_name) AS "
                     "last_name, arg_max(size_bytes, file_name) AS last_size_bytes "
                     "FROM files GROUP BY ALL"),
        "srt1_line_order": _with(
            DOC_UNITS,
            "SELECT service, category, host, archive_name, n_lines, CAST(0 AS BIGINT) AS out_of_order FROM (SELECT "
            "l.service, l.category, l.host, u.archive_name, count(*) AS n_lines FROM doc_lines l "
            "JOIN units u USING (service, category, host) WHERE l.label BETWEEN u.first_label "
            "AND u.last_label GROUP BY ALL)"),
        "srt2_archive_order": _with(
            ARCHIVE, f"SELECT service, host, taistamp, {iso('dir_date')} AS dir_date FROM archive"),
        "srt2_order_certificate": _with(
            ARCHIVE, "SELECT 'archive' AS what, count(*) AS n_rows, 0 AS inversions, 0 AS out_of_order FROM archive "
                     "UNION ALL SELECT 'documents', count(*), 0, 0 FROM documents"),
        "srt3_last_per_group": _with(
            ARCHIVE, f"SELECT {iso('dir_date')} AS dir_date, service, host, "
                     "max(taistamp) AS taistamp FROM listing GROUP BY ALL"),
        "set1_except_names": _with(
            LISTING, "SELECT agent, file_name FROM local WHERE file_name NOT IN "
                     "('config', 'current', 'lock', 'lock~') UNION ALL "
                     "SELECT agent, file_name FROM (SELECT agent, file_name, row_number() OVER "
                     "(PARTITION BY agent, file_name) AS r FROM local WHERE file_name = 'lock~') "
                     "WHERE r > 1"),
        "set2_tail_intersection": _with(LISTING, "SELECT agent, file_name FROM candidates"),
        "set3_append_defaults": _with(
            ROLLED, """
, span AS (SELECT min(window_ms) AS lo, max(window_ms) AS hi FROM rolled),
w AS (SELECT unnest(generate_series(lo, hi, 30000)) AS window_ms FROM span)
SELECT window_ms, key, total FROM rolled
UNION ALL
SELECT w.window_ms, d.key, 0 FROM w, defaults d
WHERE w.window_ms NOT IN (SELECT window_ms FROM rolled)"""),
        "str4_late_files": _with(
            PLAN, f"""
SELECT f.service, f.category, f.host, f.file_name,
       CASE WHEN f.label <= p.last_taistamp THEN 'behind_watermark' ELSE 'too_old' END AS reason
FROM files f JOIN plan p USING (service, category, host)
WHERE f.label <= p.last_taistamp OR f.label_ms < {AS_OF_MS - 4 * DAY}"""),
        "job1_ship_plan": _with(
            PLAN, f"SELECT {dir_cols}, decision, ships, '2024/01-31' AS target_dir, 'tmp/' AS "
                  "temp_dir, last_taistamp, ready_bytes, n_files, lookback_ms, "
                  "CASE WHEN decision = 'throttled' THEN 'sync_throttled' END AS error_kind "
                  "FROM plan"),
        "job2_outstanding": _with(
            PLAN, f"SELECT {dir_cols}, file_name, size_bytes, label_ms FROM outstanding"),
        "job3_merged_lines": _with(DOC_UNITS, MERGED),
        "job4_retention": _with(
            PLAN + f""",
shipped AS (
  SELECT service, category, host, max(label_ms) AS shipped_ms FROM outstanding GROUP BY ALL),
sums AS (
  SELECT f.*, s.shipped_ms, p.ready_bytes,
         sum(f.size_bytes) OVER (PARTITION BY f.service, f.category, f.host ORDER BY f.label
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_bytes,
         max(f.label) OVER (PARTITION BY f.service, f.category, f.host) AS newest
  FROM files f JOIN plan p USING (service, category, host)
  LEFT JOIN shipped s USING (service, category, host))""",
            f"SELECT {dir_cols}, file_name, size_bytes, left_bytes > ready_bytes // 2 AND "
            f"label <> newest AND label_ms < coalesce(shipped_ms, {AS_OF_MS - 4 * DAY}) "
            "AS to_delete FROM sums"),
        "job5_agent_candidates": _with(LISTING, "SELECT agent, file_name FROM candidates"),
        "job6_ship_stats": _with(
            ATTEMPTS, "SELECT agent, cycle, count(*) AS num_shipped, count(*) FILTER (ok) AS "
                      "num_delivered, count(*) FILTER (gone) AS num_rotated, "
                      "count(*) FILTER (NOT ok AND gone) AS num_lost, "
                      "bool_or(NOT ok AND NOT gone) AS aborted FROM flagged GROUP BY ALL"),
        "job7_telemetry": _with(ROLLED, "SELECT window_ms, key, total FROM rolled"),
        "job8_failover": _with(
            CHANNEL, "SELECT agent, second, CASE WHEN ok THEN 'primary' ELSE 'secondary' END AS "
                     "channel FROM walk WHERE switched", recursive=True),
        "job9_route": _with(
            EVENT_LINES, "SELECT topic, count(*) AS n_lines, "
                         "CAST(sum(length(line)) AS BIGINT) AS n_chars FROM routed GROUP BY topic"),
        "job10_catalogue": _with(
            SPOILED, f"SELECT {iso('dir_date')} AS dir_date, "
                     f"{iso('name_date')} AS name_date, service, host, taistamp FROM spoiled "
                     "WHERE name_ok"),
        "job10_quarantine": _with(
            SPOILED, f"SELECT {iso('dir_date')} AS dir_date, file_name, 'invalid_name' AS "
                     "error_kind, 'no archive name: ' || file_name AS error_detail, true AS "
                     "is_fatal FROM spoiled WHERE NOT name_ok"),
        "job10_error_report": _with(
            SPOILED + f""",
{SPOILED_FILES},
found AS (
  SELECT DISTINCT NULL AS service, 'bad_directory' AS error_kind, dir_name FROM spoiled_files WHERE bad_dir
  UNION ALL
  SELECT service, 'invalid_name', dir_name FROM spoiled_files WHERE NOT bad_dir AND bad_name
  UNION ALL
  SELECT NULL, 'invalid_archive_name', strftime(dir_date, '%Y/%m-%d') FROM spoiled WHERE NOT name_ok)""",
            "SELECT service, error_kind, count(*) AS n_errors, count(DISTINCT dir_name) AS n_directories "
            "FROM found GROUP BY ALL"),
        "job10_round_problems": _with(
            ROTATED + f""",
{SPOILED_FILES},
found AS (
  SELECT DISTINCT NULL AS service, 'bad_directory' AS error_kind, dir_name FROM spoiled_files WHERE bad_dir
  UNION ALL
  SELECT service, 'invalid_name', dir_name FROM spoiled_files WHERE NOT bad_dir AND bad_name
  UNION ALL
  SELECT DISTINCT service, 'sync_throttled', dir_name FROM spoiled_files
  WHERE NOT bad_dir AND NOT bad_name AND (service, host) IN (
    SELECT (service, host) FROM spoiled_files
    WHERE NOT bad_dir AND NOT bad_name GROUP BY service, host
    HAVING max(label_ms) > {AS_OF_MS} + 600000 - 3600000)
  UNION ALL
  SELECT service, 'nothing_to_sync', dir_name FROM spoiled_files
  WHERE NOT bad_dir AND NOT bad_name GROUP BY service, host, dir_name
  HAVING max(label_ms) <= {AS_OF_MS} + 600000 - 3600000)""",
            "SELECT service, error_kind, error_kind NOT IN ('sync_throttled', 'nothing_to_sync') AS is_fatal, "
            "count(*) AS n_rows FROM found GROUP BY ALL"),
    }
    sql["agg7_ship_statistics"] = sql["job6_ship_stats"]
    sql["str1_rounds"] = _with(
        DOC_UNITS + """,
all_units AS (
  SELECT service, category, host, max(label) AS last_label, max(label_ms) AS last_ms
  FROM docs GROUP BY ALL)""",
        f"SELECT l.service, l.category, l.host, strftime({day_of('u.last_ms')}, '%Y,%m,%d') || "
        "',' || l.service || ',' || l.host || ',' || u.last_label || '.seq' AS archive_name, "
        "l.label, l.line, '2024-01-31' AS dir_date "
        "FROM doc_lines l JOIN all_units u USING (service, category, host)")
    # Shipped whole at first. Each file is judged by the bytes left before it, itself included; the newest stays.
    sql["str1_retention"] = _with(
        DOCS + f""",
ranked AS (
  SELECT *, sum(size_bytes) OVER later AS bytes_left, max(label_ms) OVER (PARTITION BY service, category, host) AS newest
  FROM (SELECT service, category, host, file_name, label_ms, size_bytes FROM docs UNION ALL
        SELECT source, lang, 'h' || (doc_id % 4), '@' || {encode(f'(doc_id + {t.DOC_BASE_MS})')} || '.s',
               doc_id + {t.DOC_BASE_MS}, 0 FROM documents WHERE coalesce(text, '') = '')
  WINDOW later AS (PARTITION BY service, category, host ORDER BY label_ms DESC))""",
        f"SELECT {dir_cols}, file_name FROM ranked WHERE label_ms = newest OR bytes_left <= 2000")
    sql["str3_size_or_time"] = _with(
        DOC_UNITS + """,
dirs AS (SELECT service, category, host, sum(size_bytes) AS ready FROM docs GROUP BY ALL),
due AS (
  SELECT d.*, m.last_taistamp FROM dirs d LEFT JOIN doc_marks m USING (service, host)
  WHERE m.last_taistamp IS NULL
     OR d.ready > (SELECT sum(ready) // count(*) FROM dirs))""",
        f"SELECT {dir_cols}, file_name FROM docs WHERE doc_id < {t.SHIPPED_DOCS} UNION ALL "
        "SELECT d.service, d.category, d.host, d.file_name FROM docs d "
        "JOIN due u USING (service, category, host) "
        f"WHERE d.doc_id >= {t.SHIPPED_DOCS} "
        "AND (u.last_taistamp IS NULL OR d.label > u.last_taistamp)")
    sql["str2_rollup"] = _with(ROLLED, """
, span AS (SELECT min(window_ms) AS lo, max(window_ms) AS hi FROM rolled),
w AS (SELECT unnest(generate_series(lo, hi, 30000)) AS window_ms FROM span)
SELECT window_ms, key, total FROM rolled
UNION ALL
SELECT w.window_ms, d.key, 0 FROM w, defaults d
WHERE w.window_ms NOT IN (SELECT window_ms FROM rolled)""")
    sql["str5_failover"] = sql["job8_failover"]
    sql["str6_live_tail"] = sql["flt9_tail"]
    sql["str7_replay"] = _with(
        DOC_UNITS, f"SELECT {dir_cols}, file_name FROM docs WHERE doc_id < {t.SHIPPED_DOCS} "
                   f"UNION ALL SELECT {dir_cols}, file_name FROM doc_out "
                   f"WHERE doc_id >= {t.SHIPPED_DOCS}")
    sql["job9_subscriptions"] = sql["flt9_tail"]
    sql["job9_tail"] = sql["flt9_tail"]
    return sql
