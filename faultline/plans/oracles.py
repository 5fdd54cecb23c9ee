"""DuckDB SQL for each query, in the naive row-by-row form, to check the Spark results."""

from __future__ import annotations

from faultline.plans import queries as q
from faultline.plans.landed import DATADOG_STATUS, GOOGLE_SEVERITY

W = q.WINDOW_MS * 1000
WIDE = (q.WINDOW_MS + q.TOLERANCE_MS) * 1000
A, H = q.ANOMALY_US, q.HOUR_US
B = q.SILENCE_US

LOG = """
raw AS (
  SELECT *, epoch_us(ts) AS t, regexp_extract(props, '[0-9]+')::INT AS k,
    'svc-' || (user_id % 8) AS service, event_type || ' ' || value::VARCHAR AS message,
    CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3
      WHEN 'click' THEN 2 ELSE 1 END AS severity,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning'
      WHEN 'signup' THEN 'info' WHEN 'click' THEN 'debug' ELSE 'trace' END AS word
  FROM events),
log AS (
  SELECT event_id AS s, t, 'src-' || (event_id % 3) AS source, service, severity, message, k,
    CASE WHEN k % 2 = 1 THEN k || '-' || strftime(ts, '%Y-%m-%d') END AS trace_id, ts,
    row_number() OVER (ORDER BY t, event_id) AS p
  FROM raw)"""

SEVERITY_NAME = (
    "CASE severity WHEN 1 THEN 'TRACE' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFO' "
    "WHEN 4 THEN 'WARN' WHEN 5 THEN 'ERROR' WHEN 6 THEN 'FATAL' ELSE 'UNKNOWN' END"
)


def cascade_ctes(w: int, tag: str = "") -> str:
    return f"""
err{tag} AS (SELECT * FROM log WHERE severity >= 5),
gap{tag} AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY service ORDER BY p) <= {w}
  THEN 0 ELSE 1 END AS starts FROM err{tag}),
num{tag} AS (SELECT *, sum(starts) OVER (PARTITION BY service ORDER BY p) AS b FROM gap{tag}),
bur{tag} AS (SELECT service, b, min(t) AS on_t, min(p) AS on_p, max(t) AS la_t, count(*) AS n
  FROM num{tag} GROUP BY ALL),
brs{tag} AS (SELECT u.*, (SELECT min(x.p) FROM log x WHERE x.service = u.service
  AND x.t > u.la_t + {w}) AS cl_p FROM bur{tag} u),
one{tag} AS (SELECT n.s, n.t, n.p, n.service, n.trace_id, m.on_t FROM num{tag} n
  JOIN brs{tag} m ON m.service = n.service AND m.b = n.b),
fst{tag} AS (SELECT trace_id, service, min(p) AS fp, min(t) AS ft FROM err{tag}
  WHERE trace_id IS NOT NULL GROUP BY ALL),
trc{tag} AS (SELECT o.s, o.t, o.p, o.service, o.on_t, arg_min(f.service, f.fp) AS origin, min(f.ft) AS ft
  FROM one{tag} o JOIN fst{tag} f ON f.trace_id = o.trace_id AND f.service <> o.service AND f.fp < o.p
  GROUP BY ALL),
org{tag} AS (
  SELECT s, t, p, service, origin AS cascade_from, 1 AS by_trace FROM trc{tag}
    WHERE on_t - ft BETWEEN 0 AND {w}
  UNION ALL
  SELECT o.s, o.t, o.p, o.service, arg_min(m.service, m.on_p), 0 FROM one{tag} o
    JOIN brs{tag} m ON m.service <> o.service AND o.on_t - m.on_t BETWEEN 0 AND {w}
      AND m.on_p < o.p AND (m.cl_p IS NULL OR m.cl_p > o.p)
    WHERE o.trace_id IS NULL GROUP BY ALL)"""


EDGES = """
edg AS (SELECT cascade_from, service, min(p) AS fp, count(*) AS errors FROM org GROUP BY ALL)"""

ANOMALY = f"""
cnt AS (SELECT a.service, a.s, count(*) FILTER (WHERE b.t < a.t - {A // 2}) AS older,
    count(*) FILTER (WHERE b.t >= a.t - {A // 2}) AS recent
  FROM log a JOIN log b ON a.service = b.service AND b.p <= a.p AND b.t > a.t - {A}
  WHERE a.severity >= 5 AND b.severity >= 5 GROUP BY ALL),
ano AS (SELECT * FROM cnt WHERE older + recent >= 10 AND older >= 5
  AND recent >= older * {q.ANOMALY_MULTIPLIER})"""


def silence_ctes(checks: str) -> str:
    """`checks` selects p, t, s of each look; a look sees the events up to place p."""
    hm = B / 60e6 / 2
    return f"""
look AS ({checks}),
seen AS (SELECT c.p, c.t, c.s, e.service, max(e.p) AS gap,
    count(*) FILTER (WHERE e.t < c.t - {B // 2}) AS older,
    count(*) FILTER (WHERE e.t >= c.t - {B // 2}) AS recent
  FROM look c JOIN log e ON e.p <= c.p AND e.t >= c.t - {B}
  WHERE c.t >= (SELECT min(t) FROM log) + {B} GROUP BY ALL),
low AS (SELECT *, (1 - (recent / {hm}) / (older / {hm})) * 100 AS drop_pct FROM seen WHERE older >= 5),
sil AS (SELECT * FROM low WHERE drop_pct >= {q.SILENCE_PCT}
  QUALIFY row_number() OVER (PARTITION BY service, gap ORDER BY p, t) = 1)"""


SIL_EVENTS = silence_ctes("SELECT p, t, s FROM log")
SIL_TICKS = silence_ctes(
    f"""SELECT (SELECT max(p) FROM log WHERE t <= x) AS p, x AS t, NULL::BIGINT AS s
  FROM (SELECT unnest(generate_series((SELECT min(t) FROM log) // {H} * {H},
    (SELECT max(t) FROM log), {H})) AS x) WHERE x >= (SELECT min(t) FROM log)"""
)

SIGNALS = f"""
{cascade_ctes(W)}, {EDGES}, {ANOMALY},
sig AS (SELECT l.*, o.cascade_from,
    CASE WHEN o.s IS NOT NULL THEN 'cascade' WHEN a.s IS NOT NULL THEN 'anomaly' END AS signal_type,
    CASE WHEN g.fp = l.p THEN 1 ELSE 0 END AS new_cascade
  FROM log l LEFT JOIN org o ON o.s = l.s LEFT JOIN ano a ON a.s = l.s
  LEFT JOIN edg g ON g.cascade_from = o.cascade_from AND g.service = o.service)"""

# Expected events of the raw lines, by the form each line was written in.
LINES = """
lin AS (SELECT *, event_id % 6 AS f FROM raw WHERE NOT (event_id % 6 = 5 AND event_id % 5 = 0)),
exp AS (SELECT event_id, 'app' AS source, CASE WHEN f = 5 THEN 1 ELSE 0 END AS ts_missing,
    CASE f WHEN 1 THEN t // 1000 * 1000 ELSE t END AS ts_us,
    CASE WHEN f <= 2 THEN service END AS service,
    CASE WHEN f IN (0, 1, 3) THEN severity
      WHEN f > 3 AND event_type = 'error' THEN 5 ELSE 0 END::BIGINT AS severity,
    CASE f WHEN 4 THEN CASE WHEN event_type = 'error' THEN value::VARCHAR
        ELSE '<' || service || '> ' || word || ': ' || message END
      WHEN 5 THEN CASE WHEN event_type = 'error' THEN value::VARCHAR
        ELSE CASE WHEN event_id % 5 = 1 THEN '{"broken":"x"} ' ELSE '{"broken": ' END || message END
      ELSE message END AS message,
    CASE WHEN f <= 2 AND k % 2 = 1 THEN 't-' || k END AS trace_id,
    CASE f WHEN 0 THEN 'k="' || k || '"' WHEN 1 THEN 'value="' || value::VARCHAR || '"'
      WHEN 2 THEN 'time="no time"' ELSE '' END AS fields_text, f
  FROM lin)"""
LINE_COLUMNS = "event_id, source, ts_missing, ts_us, service, severity, message, trace_id, fields_text"


def word_case(words: tuple[str, ...], levels: tuple[int, ...]) -> str:
    return " ".join(f"WHEN {i} THEN {lv}" for i, (_, lv) in enumerate(zip(words, levels)))


def with_log(*parts: str, select: str) -> str:
    return f"WITH {', '.join([LOG, *parts])} {select}"


def result_json_sql() -> str:
    # The object is put together by hand: members in order, absent ones left out.
    return with_log(
        SIGNALS,
        SIL_EVENTS,
        """tol AS (SELECT p, string_agg(service, ',' ORDER BY service) AS names, round(sum(drop_pct), 6) AS drops
    FROM sil GROUP BY p)""",
        select=f"""SELECT '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
      || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') || 'Z","service":"' || service
      || '","source":"' || source || '","severity":"' || {SEVERITY_NAME}
      || '","message":"' || message || '"'
      || CASE WHEN trace_id IS NULL THEN '' ELSE ',"trace_id":"' || trace_id || '"' END
      || ',"is_signal":' || CASE WHEN signal_type IS NULL THEN 'false' ELSE 'true' END
      || coalesce(',"signal_type":"' || signal_type || '"', '')
      || coalesce(',"cascade_from":"' || cascade_from || '"', '')
      || ',"fields":{{"k":"' || k || '"}}}}' AS value, names AS silent_services, drops AS drop_pct_sum
    FROM sig LEFT JOIN tol ON tol.p = sig.p""",
    )


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    offset = "CASE WHEN source = 'src-0' THEN -200000 WHEN source = 'src-2' THEN 1500000 ELSE 0 END"
    since, until = (int(x.timestamp()) * 1_000_000 for x in (q.SINCE, q.UNTIL))

    sql["scan_lines"] = with_log(
        select="""SELECT event_id, is_object, n_chars FROM (
  SELECT event_id, event_id % 6 AS f, CASE WHEN event_id % 6 <= 2 THEN 1 ELSE 0 END AS is_object,
    length(CASE event_id % 6
      WHEN 0 THEN '{"timestamp":"2024-01-01T00:00:00.000000Z","level":"' || word || '","service":"'
        || service || '","message":"' || message || '"'
        || CASE WHEN k % 2 = 1 THEN ',"trace_id":"t-' || k || '"' ELSE '' END || ',"k":' || k || '}'
      WHEN 1 THEN '{"ts":' || t // 1000 || ',"lvl":"' || word || '","app":"' || service || '","msg":"'
        || message || '"' || CASE WHEN k % 2 = 1 THEN ',"requestId":"t-' || k || '"' ELSE '' END
        || ',"value":' || value::VARCHAR || '}'
      WHEN 2 THEN '{"time":"no time","@timestamp":"2024-01-01 00:00:00.000000","severity":"' || word
        || '","component":"' || service || '","text":"' || message || '"'
        || CASE WHEN k % 2 = 1 THEN ',"x-trace-id":"t-' || k || '"' ELSE '' END || '}'
      WHEN 3 THEN '2024-01-01T00:00:00.000000Z [' || word || ']  ' || message
      WHEN 4 THEN '2024-01-01 00:00:00.000000 <' || service || '> ' || word || ': ' || message
      ELSE CASE WHEN event_id % 5 = 1 THEN '{"broken":"x"} ' ELSE '{"broken": ' END || message END)::BIGINT AS n_chars
  FROM raw WHERE NOT (event_id % 6 = 5 AND event_id % 5 = 0))"""
    )
    for key, where in (
        ("normalize_json", "f <= 2"),
        ("normalize_text", "f > 2"),
        ("normalize_lines", "TRUE"),
    ):
        sql[key] = with_log(LINES, select=f"SELECT {LINE_COLUMNS} FROM exp WHERE {where}")
    sql["normalize_loki"] = with_log(
        select="""SELECT t * 1000 + event_id % 1000 AS ts_ns, t AS ts_us, service,
    (CASE WHEN event_id % 3 = 1 THEN 0 ELSE severity END)::BIGINT AS severity,
    CASE event_id % 3 WHEN 0 THEN message WHEN 1 THEN word || ': ' || message
      ELSE '{"level":"' || upper(word) || '","detail":"' || message || '"}' END AS message,
    CASE WHEN event_id % 3 = 0 AND k % 2 = 1 THEN 't-' || k END AS trace_id,
    CASE WHEN event_id // 8 % 2 = 0 THEN 'env="prod"' ELSE 'zone="z1"' END AS fields_text
  FROM raw WHERE event_id % 11 <> 0"""
    )
    sql["normalize_es"] = with_log(
        select="""SELECT t AS ts_us, service, severity::BIGINT AS severity, message,
    CASE WHEN k % 2 = 1 THEN 't-' || k END AS trace_id,
    CASE WHEN event_id % 3 = 0 THEN 'host.name="h1" ' ELSE '' END || 'k="' || k || '"' AS fields_text
  FROM raw"""
    )
    sql["normalize_cloudwatch"] = with_log(
        select="""SELECT event_id, t // 1000 * 1000 AS ts_us, service,
    (CASE WHEN event_id % 3 = 0 THEN severity ELSE 0 END)::BIGINT AS severity,
    CASE event_id % 3 WHEN 0 THEN message WHEN 1 THEN 'INFO ' || message
      ELSE '{not json ' || message END AS message,
    CASE WHEN event_id % 3 = 0 AND k % 2 = 1 THEN 't-' || k END AS trace_id,
    'log_group="' || CASE WHEN event_id % 2 = 0 THEN '/ecs/' ELSE '' END || service || '"'
      || CASE WHEN event_id % 5 <> 0 THEN ' log_stream="stream-' || event_id % 4 || '"' ELSE '' END
      AS fields_text
  FROM raw"""
    )
    sql["normalize_datadog"] = with_log(
        select=f"""SELECT t AS ts_us, service,
    (CASE event_id % 5 {word_case(DATADOG_STATUS, (5, 4, 3, 2, 3))} END)::BIGINT AS severity, message,
    CASE WHEN k % 2 = 1 THEN 't-' || k END AS trace_id, '' AS fields_text FROM raw"""
    )
    sql["normalize_gcl"] = with_log(
        select=f"""SELECT t AS ts_us,
    CASE event_id % 4 WHEN 0 THEN 'label-' || service WHEN 1 THEN service
      ELSE service || '/http' END AS service,
    (CASE event_id % 5 {word_case(GOOGLE_SEVERITY, (5, 4, 3, 2, 3))} END)::BIGINT AS severity, message,
    CASE WHEN event_id % 2 = 1 AND k % 2 = 1 THEN 't-' || k ELSE 'top-' || k END AS trace_id,
    '' AS fields_text FROM raw"""
    )
    sql["error_events"] = with_log(
        select=f"""SELECT service, severity, count(*) AS events, max(t) AS last_us FROM (
    SELECT service, (CASE event_id % 5 {word_case(DATADOG_STATUS, (5, 4, 3, 2, 3))} END)::BIGINT
      AS severity, t FROM raw WHERE event_id // 8 % 5 <> 0
    UNION ALL
    SELECT 'dd', 5, max(t) FROM raw WHERE event_id // 8 % 5 = 0 GROUP BY event_id // 8) GROUP BY ALL"""
    )
    parts = []
    for name, more, by in (("loki", " AND event_id % 11 <> 0", ", service"), ("elasticsearch", "", ""), ("datadog", "", ""), ("googlecloud", "", "")):
        parts.append(f"SELECT '{name}' AS source, FALSE AS failed, t FROM raw WHERE event_id // 8 % 5 IN (1, 3, 4){more}")
        parts.append(f"SELECT '{name}', TRUE, max(t) FROM raw WHERE event_id // 8 % 5 < 3 GROUP BY event_id // 8{by}")
    sql["damaged_responses"] = with_log(
        select=f"SELECT source, failed, count(*) AS events, max(t) AS last_us FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"
    )
    sql["merge_sources"] = with_log(
        select="SELECT p AS place, t AS ts_us, s AS event_id, source FROM log"
    )
    sql["result_json"] = result_json_sql()

    sql["clock_offset"] = with_log(
        select=f"SELECT s AS event_id, t + {offset} AS ts_us, t AS raw_us FROM log"
    )
    sql["choose_anchor"] = with_log(select="SELECT s AS event_id, t + s % 7 * 1000 AS ts_us FROM log")
    sql["time_range"] = with_log(
        select=f"""SELECT s AS event_id, t + {offset} AS ts_us FROM log
    WHERE t + {offset} BETWEEN {since} AND {until}"""
    )
    sql["since_argument"] = with_log(
        select=f"SELECT s AS event_id, t AS ts_us FROM log WHERE t >= (SELECT max(t) FROM log) - {72 * H}"
    )
    sql["parse_timestamp"] = with_log(
        select="""SELECT event_id, CASE event_id % 8 WHEN 0 THEN t
      WHEN 1 THEN t // 1000000 * 1000000 - 7200000000 WHEN 2 THEN t // 1000 * 1000
      WHEN 3 THEN t // 1000000 * 1000000 WHEN 4 THEN t // 1000000 * 1000000 + 25200000000
      WHEN 5 THEN t // 1000000 * 1000000 WHEN 6 THEN t // 1000 * 1000 END AS ts_us FROM raw"""
    )
    sql["severity_counts"] = """SELECT CASE event_id % 7 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'ERROR'
      WHEN 3 THEN 'WARN' WHEN 4 THEN 'INFO' WHEN 5 THEN 'FATAL' ELSE 'UNKNOWN' END AS severity,
    count(*) AS events FROM events GROUP BY ALL"""
    sql["render_time"] = with_log(
        select="""SELECT s AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS absolute,
    (t // 1000)::VARCHAR AS unix, strftime(ts, '%H:%M:%S.%g') AS clock,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') || 'Z' AS rfc3339,
    'k="' || k || '"' AS fields_text, service AS name FROM log"""
    )
    sql["label_filter"] = with_log(
        select="SELECT s AS event_id, source, service FROM log WHERE k = 7 AND severity >= 3"
    )
    sql["errors_only"] = "SELECT event_id FROM events WHERE event_type = 'error'"
    sql["signal_only"] = with_log(
        SIGNALS,
        select="""SELECT s AS event_id, service, signal_type, cascade_from FROM sig
    WHERE signal_type IS NOT NULL""",
    )
    sql["services_filter"] = with_log(
        cascade_ctes(W),
        select="""SELECT s AS event_id, service, cascade_from FROM org
    WHERE service IN ('svc-1', 'svc-2')""",
    )

    sql["error_bursts"] = with_log(
        cascade_ctes(W),
        select="""SELECT b.service, on_t AS onset_us, la_t AS last_us, n AS errors, l.t AS closed_us
    FROM brs b LEFT JOIN log l ON l.p = b.cl_p""",
    )
    sql["trace_first_error"] = with_log(
        select="""SELECT trace_id, service, min(t) AS first_us FROM log
    WHERE severity >= 5 AND trace_id IS NOT NULL GROUP BY ALL"""
    )
    for key, flag in (("cascade_trace", 1), ("cascade_temporal", 0)):
        sql[key] = with_log(
            cascade_ctes(W),
            select=f"SELECT s AS event_id, service, cascade_from FROM org WHERE by_trace = {flag}",
        )
    sql["cascades"] = with_log(
        cascade_ctes(W),
        EDGES,
        select="""SELECT o.s AS event_id, o.t AS ts_us, o.service, o.cascade_from,
    CASE WHEN e.fp = o.p THEN 1 ELSE 0 END AS new_cascade
    FROM org o JOIN edg e ON e.cascade_from = o.cascade_from AND e.service = o.service""",
    )
    sql["cascade_edges"] = with_log(
        cascade_ctes(W),
        EDGES,
        select="""SELECT cascade_from, e.service, l.t AS first_us, errors
    FROM edg e JOIN log l ON l.p = e.fp""",
    )
    sql["cascade_chains"] = with_log(
        cascade_ctes(W),
        EDGES,
        """sta AS (SELECT *, CASE WHEN lag(service) OVER (ORDER BY fp) = cascade_from THEN 0 ELSE 1 END
      AS starts FROM edg),
    seg AS (SELECT *, sum(starts) OVER (ORDER BY fp)::BIGINT AS chain_id FROM sta)""",
        select="""SELECT l.s AS event_id, chain_id,
      row_number() OVER (PARTITION BY chain_id ORDER BY fp) AS hop,
      first_value(cascade_from) OVER (PARTITION BY chain_id ORDER BY fp) || ' > '
        || string_agg(seg.service, ' > ') OVER (PARTITION BY chain_id ORDER BY fp) AS chain
    FROM seg JOIN log l ON l.p = seg.fp""",
    )
    sql["drift_warnings"] = with_log(
        cascade_ctes(W),
        cascade_ctes(WIDE, "_w"),
        select="""SELECT s AS event_id, service, cascade_from FROM org_w
    WHERE s NOT IN (SELECT s FROM org)""",
    )

    sql["error_rates"] = with_log(
        ANOMALY, select="SELECT service, s AS event_id, older, recent FROM cnt"
    )
    sql["volume_rates"] = with_log(
        select=f"""SELECT a.service, a.s AS event_id, count(*) FILTER (WHERE b.t < a.t - {B // 2}) AS older,
      count(*) FILTER (WHERE b.t >= a.t - {B // 2}) AS recent
    FROM log a JOIN log b ON a.service = b.service AND b.p <= a.p AND b.t >= a.t - {B} GROUP BY ALL"""
    )
    sql["trailing_count"] = with_log(
        select=f"""SELECT a.source, a.s AS event_id, count(*) AS n
    FROM log a JOIN log b ON a.source = b.source AND b.p <= a.p AND b.t > a.t - {H} GROUP BY ALL"""
    )
    sql["anomaly"] = with_log(ANOMALY, select="SELECT service, s AS event_id, older, recent FROM ano")
    hm = B / 60e6 / 2
    sql["silence"] = with_log(
        SIL_EVENTS,
        select=f"""SELECT service, s AS event_id, older, recent, round(drop_pct, 6) AS drop_pct,
      round(older / {hm}, 9) AS baseline_rate, round(recent / {hm}, 9) AS current_rate FROM sil""",
    )
    sql["silence_ticks"] = with_log(
        SIL_TICKS, select="SELECT service, t AS tick_us, older, recent FROM sil"
    )

    sql["correlate"] = with_log(
        SIGNALS,
        SIL_EVENTS,
        """tol AS (SELECT p, string_agg(service, ',' ORDER BY service) AS names FROM sil GROUP BY p)""",
        select=f"""SELECT sig.s AS event_id, t AS ts_us, source, service, {SEVERITY_NAME} AS severity, message,
      CASE WHEN signal_type IS NULL THEN 0 ELSE 1 END AS is_signal, signal_type, cascade_from,
      new_cascade, names AS silent_services FROM sig LEFT JOIN tol ON tol.p = sig.p""",
    )
    sql["run_summary"] = with_log(
        SIGNALS,
        SIL_EVENTS,
        select="""SELECT count(signal_type) AS signals, count(*) - count(signal_type) AS noise,
      count(DISTINCT source) AS sources, count(*) AS events,
      (SELECT count(*) FROM sil) AS silence_signals FROM sig""",
    )
    sql["signal_history"] = with_log(
        SIGNALS,
        SIL_EVENTS,
        select="""SELECT t AS ts_us, signal_type, service, cascade_from FROM sig
      WHERE signal_type IS NOT NULL
    UNION ALL SELECT t, 'silence', service, NULL FROM sil""",
    )
    sql["suppress"] = with_log(
        SIGNALS,
        select=f"""SELECT s AS event_id, service, signal_type FROM sig WHERE signal_type IS NOT NULL
      AND service <> 'svc-3' AND NOT (service = 'svc-4' AND t BETWEEN {since} AND {until})""",
    )
    sql["suggest_offsets"] = with_log(
        """fir AS (SELECT trace_id, source, min(t) AS f FROM log WHERE trace_id IS NOT NULL GROUP BY ALL)""",
        select="""SELECT a.source, round(median((b.f - a.f) / 1000), 3) AS offset_ms, count(*) AS traces
      FROM fir a JOIN fir b ON a.trace_id = b.trace_id AND b.source = 'src-0'
      WHERE a.source <> 'src-0' GROUP BY ALL""",
    )
    sql["source_health"] = with_log(
        select="""SELECT source, count(*) AS events, count(*) FILTER (WHERE severity >= 5) AS errors,
      max(t) AS last_us, round(count(*) / greatest((max(t) - min(t)) / 60e6, 1.0), 6) AS per_minute,
      CASE WHEN (SELECT max(t) FROM log) - max(t) > 600000000 THEN 'silent'
        WHEN count(*) FILTER (WHERE severity >= 5) >= count(*) * 0.2 THEN 'degraded'
        ELSE 'connected' END AS state FROM log GROUP BY source"""
    )
    return sql
