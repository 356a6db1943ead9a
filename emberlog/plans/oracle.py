"""SQL twins of the registered queries, for DuckDB.

Each twin is a SELECT over named common table expressions; ``sql`` puts the needed ones in front.
The gate's layers are recursive here: one row after the other per key, as the rules are stated.
"""

from __future__ import annotations

from emberlog import fixed_values as V
from emberlog.plans.testbed import NOW_US, SECRET, SINCE_US, START_US, WRONG_SECRET

S = 1_000_000
DAY = 86_400 * S


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def table_of(mapping: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v) if isinstance(v, str) else v}" for k, v in mapping.items()) + "}"


def rewrite(expr: str, steps) -> str:
    for pattern, replacement in steps:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(replacement)}, 'g')"
    return expr


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


I = "(?i)"  # noqa: E741


def body_level(m: str) -> str:
    head = f"substr({m}, 1, 200)"
    word = (
        f"lower(coalesce(nullif(regexp_extract({head}, {q(I + V.LEVEL_TAG)}, 1), ''), "
        f"nullif(regexp_extract({head}, {q(I + V.LEVEL_AFTER_CLOCK)}, 1), '')))"
    )
    return f"({table_of(V.LEVEL_ALIAS)})[{word}]"


def rank(level: str) -> str:
    return f"coalesce(({table_of(V.LEVEL_RANK)})[{level}], 3)"


def fault(m: str) -> str:
    return f"regexp_matches({m}, {q(I + V.FAULT_WORD)})"


def false_error(label: str, m: str) -> str:
    return (
        f"({label} = 'error' AND regexp_matches({m}, {q(I + V.INFO_TAG)}) "
        f"AND regexp_matches({m}, {q(I + V.ZERO_COUNTER)}) AND NOT {fault(m)})"
    )


def stable_file(p: str) -> str:
    return rewrite(p, [(V.FILE_DATE, "<date>"), (V.FILE_NUMBER, "<n>")])


def stable_source(s: str) -> str:
    value = stable_file("substr(x, position('log_file=' IN x) + 9)")
    return (
        f"array_to_string(list_transform(string_split({s}, ';'), lambda x: CASE WHEN contains(x, 'log_file=') "
        f"THEN substr(x, 1, position('log_file=' IN x) + 8) || {value} ELSE x END), ';')"
    )


def gate_message(m: str) -> str:
    return collapse(rewrite(f"lower(substr({m}, 1, 4096))", [
        (I + V.UUID, "<uuid>"), (I + V.HEX, "<hex>"), (V.TIMESTAMP, "<ts>"), (V.CLOCK, "<clock>"),
        (V.LONG_DIGITS, "<n>"),
    ]))


def class_head(m: str) -> str:
    text = collapse(rewrite(f"lower(substr({m}, 1, 4096))", [
        (V.BRACKETED, " "), (V.TIMESTAMP, "<ts>"), (V.CLOCK, "<clock>"), (I + V.UUID, "<uuid>"),
        (I + V.HEX, "<hex>"), (V.URL, "<url>"), (V.LONG_DIGITS, "<n>"), (V.SKELETON_OTHER, " "),
    ]))
    return f"array_to_string(string_split({text}, ' ')[1:4], ' ')"


def class_component(m: str, head: str) -> str:
    return (
        f"coalesce(list_filter(list_transform(regexp_extract_all(substr({m}, 1, 400), {q(V.LOGGER_TAG)}, 1), "
        f"lambda t: lower(t)), lambda t: t NOT IN {words(V.BARE_LEVEL_WORDS)} AND (contains(t, '.') OR length(t) >= 12))[1], "
        f"substr({head}, 1, 60))"
    )


def joined(*parts: str) -> str:
    return "sha256(" + " || chr(31) || ".join(parts) + ")"


def template(m: str) -> str:
    return collapse(rewrite(f"lower(substr({m}, 1, 4096))", [
        (I + V.UUID, "<uuid>"), (I + V.HEX, "<hex>"), (V.ANY_DIGITS, "<n>")]))


def redact(m: str) -> str:
    return rewrite(m, [
        (I + V.SECRET_FIELD, r"\1=<redacted>"), (I + V.BEARER, "Bearer <redacted>"),
        (I + V.URL_PASSWORD, r"\1<redacted>\2"), (V.LONG_TOKEN, "<redacted-long>")])


def sample_text(m: str) -> str:
    return "substr(" + redact(f"replace(trim({m}), chr(10), ' ')") + ", 1, 180)"


def source_field(s: str, group: int) -> str:
    value = f"trim(regexp_extract({s}, {q(V.SOURCE_FIELDS)}, {group}))"
    return f"(CASE WHEN {value} = 'unknown' THEN '' ELSE {value} END)"


def component_of(m: str) -> str:
    return (
        f"coalesce(substr(list_filter(list_transform(regexp_extract_all({m}, {q(V.BRACKET_TEXT)}, 1), lambda t: trim(t)), "
        f"lambda t: t <> '' AND NOT regexp_matches(t, {q(V.BRACKET_TIMESTAMP)}) AND lower(t) NOT IN {words(V.COMPONENT_SKIP)} "
        f"AND regexp_matches(t, '[A-Za-z]') AND (contains(t, '.') OR regexp_matches(t, '(?s)^..*[A-Z]')))[1], 1, 80), '')"
    )


def log_file_of(m: str) -> str:
    return (
        f"substr(coalesce(nullif(regexp_extract({m}, {q(I + V.LOG_PATH)}), ''), "
        f"nullif(regexp_extract({m}, {q(I + V.LOG_NAME)}), ''), ''), 1, 120)"
    )


def collector_severity(m: str) -> str:
    any_of = lambda ws: " OR ".join(f"contains(upper({m}), {q(w)})" for w in ws)
    return (
        f"CASE WHEN {any_of(V.CRITICAL_WORDS)} THEN 'critical' WHEN {any_of(V.ERROR_WORDS)} THEN 'error' "
        f"WHEN {any_of(V.WARNING_WORDS)} THEN 'warning' ELSE 'unknown' END"
    )


def gateway_message(m: str) -> str:
    return rewrite(f"lower({m})", [
        (I + V.GATEWAY_UUID, "<uuid>"), (V.GATEWAY_TIMESTAMP, "<timestamp>"),
        (I + V.GATEWAY_VOLATILE, r"\1<value>"), (V.GATEWAY_DIGITS, "<n>")])


def reporting(eff: str = "effective_severity", sev: str = "severity") -> str:
    return f"(CASE WHEN coalesce({eff}, '') IN ('', 'unknown') THEN lower({sev}) ELSE lower({eff}) END)"


def hmac(secret: bytes, message: str) -> str:
    key = secret.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return (
        f"to_base64(unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))))"
    )


def local(us: str) -> str:
    return f"(strftime(timezone('{V.LOCAL_ZONE}', make_timestamptz({us})), '%m-%d %H:%M') || ' NZ')"


def rfc3339(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%SZ')"


def clean_program(p: str) -> str:
    parts = f"list_filter(string_split({p}, '/'), lambda s: s NOT IN ('', '.'))"
    clean = (
        f"list_reduce(list_transform({parts}, lambda s: [s]), lambda a, b: CASE WHEN b[1] = '..' "
        f"THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, b) END, []::VARCHAR[])"
    )
    return (
        f"(CASE WHEN {p}[1] = '/' AND len({clean}) >= 3 AND ({clean})[1] = 'logs' THEN ({clean})[2] ELSE 'unknown' END)"
    )


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


def sql(select: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name):
        for need in CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    body = ",\n".join(
        f"{n}{'' if n in RECURSIVE else ' '} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n][1]})" for n in ordered
    )
    return f"WITH RECURSIVE {body}\n{select}" if ordered else select


RECURSIVE = {"storm", "class_fold", "gateway_fold"}

cte("log", [], f"""
SELECT id, received_us, gateway_us, 'evt-' || id AS incident_id, host,
  CASE WHEN id % 37 = 0 THEN 'host-logs' ELSE 'project=' || project || '; program=' || program || '; log_file=' || path || '; dll=unknown' END AS source,
  CASE WHEN id % 53 = 0 THEN upper(label) ELSE label END AS severity, message,
  {rfc3339("received_us")} AS "timestamp", project, program, path, event_type, k, user_id
FROM (SELECT *,
  day_start + in_day // 288 AS received_us, day_start + in_day // 24 AS gateway_us,
  '/logs/' || program || '/' || lower(program) || '_2024' || strftime(ts, '%m%d') || '.log' AS path,
  CASE WHEN event_type = 'error' AND k % 4 = 0 THEN '[2024-01-02 03:04:05.678] [ERROR] [Acme.Core.Client] request id=' || (id + 1000) || ' failed with timeout' || CASE WHEN id % 9 = 0 THEN ' in Acme.Core.dll' ELSE '' END
       WHEN event_type = 'error' AND k % 4 = 1 THEN '[2024-01-02 03:04:05.678] [INFO] [Acme.Core.Client] batch done rows=' || k
       WHEN event_type = 'error' AND k % 4 = 2 THEN '[ INFO ] totals rows=' || k || ' errors: 0'
       WHEN event_type = 'error' THEN '2024-01-02 03:04:05 FATAL store closed code=' || k
       WHEN event_type = 'view' THEN '[WARN] [Acme.Cache] slow read ' || k || ' ms token=abc' || id
       WHEN event_type = 'click' THEN '[ERROR] [Acme.Queue.Pump] lag on one shard ' || CASE WHEN k % 10 < 7 THEN 0 ELSE k % 3 END
       WHEN event_type = 'signup' THEN 'disk almost full on volume' || (k % 4) || ' part ' || (k % 5)
       ELSE 'job ' || id || ' finished' || CASE WHEN k % 10 = 0 THEN ' password: s3cr3t' || k || ', log=/var/log/jobs/run.log' ELSE '' END END AS message,
  CASE WHEN event_type = 'error' AND k % 4 = 3 THEN 'critical' WHEN event_type = 'error' THEN 'error'
       WHEN event_type IN ('view', 'click') THEN 'warning' WHEN event_type = 'signup' THEN 'unknown' ELSE 'info' END AS label
FROM (SELECT *, {START_US} + (us // {DAY}) * {DAY} AS day_start, us % {DAY} AS in_day,
  ['Feed1m', 'Feed5m', 'Ledger', 'Mailer', 'Stray'][user_id % 5 + 1] AS program,
  CASE WHEN user_id % 5 < 2 THEN 'Feeds' WHEN user_id % 5 < 4 THEN 'Office' ELSE '' END AS project,
  'host-' || ((user_id % 5) % 2) AS host
FROM (SELECT event_id AS id, user_id, event_type, ts, epoch_us(ts) - {START_US} AS us,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))""")

cte("levels", ["log"], f"""
SELECT *, lower(trim(severity)) AS label, {body_level("message")} AS body FROM log""")

cte("graded", ["levels"], f"""
SELECT *, CASE WHEN downgraded OR escalated THEN body WHEN label <> '' THEN label ELSE 'unknown' END AS effective,
  (CASE WHEN downgraded OR escalated THEN body WHEN label <> '' THEN label ELSE 'unknown' END) IN {words(V.COLLECTED_SEVERITIES)} AND NOT escalated AS collect_only,
  CASE WHEN downgraded THEN 'body_level_suppressed' WHEN {false_error("label", "message")} THEN 'info_counter_suppressed' END AS exit_status
FROM (SELECT *,
  coalesce(body IN {words(V.COLLECTABLE_BODY_LEVELS)} AND {rank("label")} > {rank("body")} AND NOT {fault("message")}, false) AS downgraded,
  coalesce(body IN {words(V.ESCALATING_BODY_LEVELS)} AND {rank("label")} < {rank("body")}, false) AS escalated
FROM levels)""")

cte("keyed", ["graded"], f"""
SELECT *, {joined("host", stable_source("source"), "effective", gate_message("message"))} AS fp,
  {joined("host", stable_source("source"), "effective", class_component("message", "head"), "substr(head, 1, 120)")} AS ck
FROM (SELECT *, {class_head("message")} AS head FROM graded)""")

cte("storm_seq", ["keyed"], """
SELECT fp, id, received_us AS us, row_number() OVER (PARTITION BY fp ORDER BY received_us, id) AS rn
FROM keyed WHERE exit_status IS NULL""")

cte("storm", ["storm_seq"], f"""
SELECT fp, rn, id, us, us AS opened, id AS opened_id, CAST(1 AS BIGINT) AS cnt, us AS sent, CAST(NULL AS BIGINT) AS last_storm,
  'first_seen' AS status, true AS send
FROM storm_seq WHERE rn = 1
UNION ALL
SELECT fp, rn, id, us, CASE WHEN fresh OR NOT same THEN us ELSE opened END, CASE WHEN fresh OR NOT same THEN id ELSE opened_id END, cnt,
  CASE WHEN send THEN us ELSE sent END, CASE WHEN send AND cnt >= 5 AND NOT fresh THEN us ELSE last_storm END,
  CASE WHEN fresh THEN 'first_seen' WHEN cnt >= 5 THEN (CASE WHEN send THEN 'storm_summary' ELSE 'storm_suppressed' END)
       WHEN send THEN 'repeat_summary' ELSE 'duplicate_suppressed' END, send
FROM (SELECT *, CASE WHEN fresh THEN true WHEN cnt >= 5 THEN last_storm IS NULL OR us - last_storm >= {120 * S} ELSE us - sent >= {300 * S} END AS send
FROM (SELECT n.fp, n.rn, n.id, n.us, p.opened, p.opened_id, p.sent, n.us - p.us > {DAY} AS fresh, n.us - p.us <= {60 * S} AS same,
  CASE WHEN n.us - p.us <= {60 * S} THEN p.cnt + 1 ELSE 1 END AS cnt,
  CASE WHEN n.us - p.us <= {60 * S} THEN p.last_storm END AS last_storm
FROM storm p JOIN storm_seq n ON n.fp = p.fp AND n.rn = p.rn + 1))""")

cte("class_seq", ["storm", "keyed"], """
SELECT k.ck, s.id, s.us, row_number() OVER (PARTITION BY k.ck ORDER BY s.us, s.id) AS rn
FROM storm s JOIN keyed k ON k.id = s.id
WHERE s.send AND NOT k.collect_only AND k.effective IN ('error', 'unknown')""")

cte("class_fold", ["class_seq"], f"""
SELECT ck, rn, id, us, us AS opened, CAST(1 AS BIGINT) AS cnt, CAST(1 AS BIGINT) AS total, us AS sent, CAST(NULL AS BIGINT) AS last_storm,
  'class_new' AS note, true AS paged
FROM class_seq WHERE rn = 1
UNION ALL
SELECT ck, rn, id, us, opened, cnt, total, CASE WHEN fresh OR burst OR expired THEN us ELSE sent END,
  CASE WHEN fresh THEN NULL WHEN burst THEN us ELSE last_storm END,
  CASE WHEN fresh THEN 'class_new' WHEN burst THEN 'class_storm_summary' WHEN expired THEN 'class_cooldown_expired' ELSE 'class_cooldown' END,
  fresh OR burst OR expired
FROM (SELECT *, NOT fresh AND cnt >= 5 AND (last_storm IS NULL OR us - last_storm >= {120 * S}) AS burst, us - sent >= {3600 * S} AS expired
FROM (SELECT n.ck, n.rn, n.id, n.us, n.us - p.us > {DAY} AS fresh, p.sent, p.last_storm,
  CASE WHEN n.us - p.us > {DAY} OR n.us - p.opened > {300 * S} THEN n.us ELSE p.opened END AS opened,
  CASE WHEN n.us - p.us > {DAY} OR n.us - p.opened > {300 * S} THEN 1 ELSE p.cnt + 1 END AS cnt,
  CASE WHEN n.us - p.us > {DAY} THEN 1 ELSE p.total + 1 END AS total
FROM class_fold p JOIN class_seq n ON n.ck = p.ck AND n.rn = p.rn + 1))""")

cte("audit", ["keyed", "storm", "class_fold"], f"""
SELECT k.id, k.received_us, k.incident_id, k.host, k.source, k.severity, k."timestamp" AS event_timestamp, k.message,
  k.fp AS fingerprint, coalesce(s.cnt, 1) AS storm_count, 60 AS storm_window_seconds,
  coalesce(k.exit_status, s.status) AS storm_status,
  CAST(k.exit_status IS NULL AND s.send AND NOT k.collect_only AND coalesce(c.paged, true) AS INTEGER) AS llm_dispatched,
  CASE WHEN k.exit_status = 'info_counter_suppressed' THEN 'warning' ELSE k.effective END AS effective_severity,
  CASE WHEN k.exit_status = 'body_level_suppressed' THEN 'body_tag_' || k.body || '_collector_' || CASE WHEN k.label = '' THEN 'unknown' ELSE k.label END
       WHEN k.exit_status IS NOT NULL THEN '{V.COUNTER_REASON}'
       WHEN k.collect_only THEN '{V.COLLECTED_REASON}'
       WHEN c.note IS NOT NULL THEN c.note || ':' || substr(k.ck, 1, 12) ELSE '' END AS suppression_reason
FROM keyed k LEFT JOIN storm s ON s.id = k.id LEFT JOIN class_fold c ON c.id = k.id""")

cte("recent", ["audit"], f"SELECT * FROM audit WHERE received_us >= {SINCE_US}")

cte("cluster_rows", ["recent"], f"""
SELECT *, CASE WHEN host = '' THEN '?' ELSE host END AS c_host, {source_field("source", 1)} AS c_project, {source_field("source", 2)} AS c_program,
  {source_field("source", 3)} AS log_file, {stable_file(source_field("source", 3))} AS c_file, {template("message")} AS c_template
FROM recent WHERE {reporting()} IN {words(V.COLLECTED_SEVERITIES)}""")

cte("clusters", ["cluster_rows"], f"""
SELECT c_host AS host, c_project AS project, c_program AS program, c_file AS stable_file, c_template AS template, count(*) AS n,
  min(received_us) AS first_us, max(received_us) AS last_us, arg_min(id, (received_us, id)) AS first_id, max(storm_count) AS max_count,
  {sample_text("arg_min(message, (received_us, id))")} AS sample, arg_min(log_file, (received_us, id)) AS log_file,
  CASE WHEN c_project = '' AND c_program = '' THEN substr(arg_min(source, (received_us, id)), 1, 60) ELSE '' END AS raw_source
FROM cluster_rows GROUP BY c_host, c_project, c_program, c_file, c_template""")

cte("top", ["clusters"], """
SELECT *, row_number() OVER (ORDER BY n DESC, first_us, first_id) AS rank FROM clusters
QUALIFY rank <= 20""")

cte("named", ["top"], f"""SELECT *, {component_of("sample")} AS comp FROM top""")

cte("lines", ["named"], f"""
SELECT *, concat_ws(' | ', '[' || rank || '] ' || n || ' 条',
  '程序=' || coalesce(nullif(program, ''), nullif(comp, ''), '{V.UNLABELLED}'),
  CASE WHEN project <> '' THEN '项目=' || project END,
  CASE WHEN comp <> '' AND comp <> coalesce(nullif(program, ''), nullif(comp, ''), '{V.UNLABELLED}') THEN '分量=' || comp END,
  CASE WHEN coalesce(nullif(log_file, ''), {log_file_of("sample")}) <> '' THEN '文件=' || coalesce(nullif(log_file, ''), {log_file_of("sample")}) END,
  'host=' || host, CASE WHEN raw_source <> '' THEN '来源=' || raw_source END,
  {local("first_us")} || ' → ' || {local("last_us")}) AS header,
  '    样例: ' || sample AS sample_line, '    (日志模板: ' || substr(template, 1, 120) || ')' AS template_line
FROM named""")

cte("fitted", ["lines"], """
SELECT * FROM (SELECT *, sum(length(header) + length(sample_line) + length(template_line) + 3) OVER (ORDER BY rank) AS spent FROM lines)
WHERE spent <= 9000""")

# what follows the object makes some bodies no JSON
_TRAILING = "CASE WHEN id % 43 = 0 THEN '}' WHEN id % 47 = 0 THEN ' } {}' ELSE '' END"

cte("raw", ["log"], f"""
SELECT id, gateway_us AS received_us, host, CASE WHEN id % 11 = 0 THEN message
  WHEN id % 13 = 0 THEN CAST(json_object('source', path, 'message', '  ') AS VARCHAR)
  ELSE CAST(json_object('source', path, 'message', message) AS VARCHAR) || {_TRAILING} END AS raw FROM log""")

cte("parsed", ["raw"], """
SELECT *, trim(CASE WHEN json_valid(raw) THEN coalesce(json_extract_string(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END, '$.source'), '') ELSE '' END) AS source,
  trim(CASE WHEN json_valid(raw) THEN coalesce(json_extract_string(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END, '$.message'), '') ELSE raw END) AS message FROM raw""")

cte("allow", ["log"], """
SELECT DISTINCT project, program, program <> 'Mailer' AS enabled FROM log WHERE project <> ''""")

cte("placed", ["parsed", "allow"], f"""
SELECT p.*, coalesce(a.project, '') AS project, coalesce(a.enabled, false) AS enabled,
  regexp_extract(p.message, {q(I + V.DLL_NAME)}) AS dll,
  octet_length(encode(p.raw)) <= 65536 AND p.message <> '' AS ok
FROM (SELECT *, {clean_program("source")} AS program FROM parsed) p LEFT JOIN allow a ON a.program = p.program""")

cte("gw", ["placed"], f"""
SELECT *, sha256(source || chr(0) || severity || chr(0) || {gateway_message("message")}) AS fp, received_us // {S} * {S} AS us
FROM (SELECT *, {collector_severity("message")} AS severity FROM placed WHERE ok AND enabled)""")

cte("gw_seq", ["gw"], f"""
SELECT id, us, fp, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN {1800 * S} ELSE {900 * S} END AS cooldown,
  row_number() OVER (PARTITION BY fp ORDER BY us, id) AS rn FROM gw""")

cte("gateway_fold", ["gw_seq"], """
SELECT fp, rn, id, us, us AS acc_us, id AS acc_id, true AS accepted FROM gw_seq WHERE rn = 1
UNION ALL
SELECT n.fp, n.rn, n.id, n.us, CASE WHEN n.us - p.acc_us >= n.cooldown THEN n.us ELSE p.acc_us END,
  CASE WHEN n.us - p.acc_us >= n.cooldown THEN n.id ELSE p.acc_id END, n.us - p.acc_us >= n.cooldown
FROM gateway_fold p JOIN gw_seq n ON n.fp = p.fp AND n.rn = p.rn + 1""")

cte("accepted", ["gw", "gateway_fold"], """
SELECT g.id, md5(g.source || '|' || g.us || '|' || g.id) AS incident_id, g.us AS created_us, g.source, g.severity, g.message,
  g.fp AS fingerprint, c.occurrences, g.project, g.program, g.dll, g.enabled, g.host
FROM gw g JOIN (SELECT acc_id, count(*) AS occurrences FROM gateway_fold GROUP BY acc_id) c ON c.acc_id = g.id""")

cte("signed0", ["log"], f"""
SELECT id AS seq, received_us, 'evt-' || (id - CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END) AS svix_id,
  received_us // 1000000 - CASE WHEN id % 17 = 0 THEN 301 WHEN id % 17 = 1 THEN 300 ELSE 2 END AS svix_timestamp,
  CASE WHEN id % 29 = 0 THEN '[1,2]' WHEN id % 31 = 0 THEN 'not json'
    ELSE CAST(json_object('incident_id', incident_id, 'host', host, 'source', source, 'severity', severity, 'message', message, 'timestamp', "timestamp") AS VARCHAR) || {_TRAILING} END AS raw_body
FROM log""")

_CONTENT = "svix_id || '.' || svix_timestamp || '.' || raw_body"
cte("signed", ["signed0"], f"""
SELECT *, CASE WHEN seq % 23 = 0 THEN NULL WHEN seq % 19 = 0 THEN 'v1,' || {hmac(WRONG_SECRET, _CONTENT)} ELSE 'v1,' || {hmac(SECRET, _CONTENT)} END AS svix_signature
FROM signed0""")

cte("verified", ["signed"], f"""
SELECT *, coalesce(svix_signature = 'v1,' || {hmac(SECRET, _CONTENT)}, false) AS signature_ok,
  abs(received_us // 1000000 - svix_timestamp) <= 300 AS fresh_ok,
  json_valid(raw_body) AND coalesce(json_type(CASE WHEN json_valid(raw_body) THEN raw_body ELSE 'null' END) = 'OBJECT', false) AS payload_ok FROM signed""")

cte("crumbs", ["log"], """
SELECT seq, value, string_split(value, chr(9)) AS parts FROM (
SELECT id AS seq, CASE WHEN id % 7 = 0 THEN 'no tabs in line ' || id
  WHEN id % 5 = 0 THEN (received_us // 1000000) || chr(9) || CASE WHEN id % 2 = 0 THEN 'state-store' ELSE 'open' END
  ELSE (received_us // 1000000) || chr(9) || CASE WHEN id % 2 = 0 THEN 'state-store' ELSE 'open' END || chr(9) || 'OperationalError: database is locked ' || id END AS value
FROM log WHERE event_type = 'error')""")

cte("crumb_rows", ["crumbs"], """
SELECT seq, value, len(parts) AS fields, CASE WHEN regexp_full_match(replace(parts[1], '.', ''), '[0-9]+') THEN TRY_CAST(parts[1] AS DOUBLE) END AS at_s,
  parts[2] AS stage, parts[3] AS detail FROM crumbs""")

cte("usage", ["log"], """
SELECT ['webhook:alerts', 'Profile-WebHook', 'cli'][user_id % 3 + 1] AS source,
  CASE WHEN id % 41 = 0 THEN 'n/a' ELSE CAST(received_us // 1000000 AS VARCHAR) END AS started_at,
  CAST(1000 + k * 37 AS BIGINT) AS input_tokens, CAST(k * 11 AS BIGINT) AS output_tokens, CAST(user_id * 13 AS BIGINT) AS cache_read_tokens
FROM log WHERE event_type = 'purchase'""")

cte("usage_rows", ["usage"], f"""
SELECT * FROM usage WHERE lower(source) LIKE '%webhook%' AND TRY_CAST(started_at AS DOUBLE) >= {SINCE_US / S}""")

cte("cost", ["usage_rows"], """
SELECT *, input_tokens / 1e6 * 0.15 + output_tokens / 1e6 * 0.60 + cache_read_tokens / 1e6 * 0.003 AS cost FROM (
SELECT count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens FROM usage_rows)""")

cte("attempts", ["accepted"], f"""
SELECT id, CAST(seq AS BIGINT) AS seq, created_us + seq * {30 * S} AS attempt_us, seq = 1 + id % 3 AND id % 4 <> 0 AS ok,
  CASE WHEN NOT (seq = 1 + id % 3 AND id % 4 <> 0) THEN 'unexpected response' END AS error
FROM (SELECT id, created_us, unnest(generate_series(1, 1 + id % 3)) AS seq FROM accepted)""")

cte("ledger", ["accepted", "attempts"], """
SELECT a.id, a.created_us, coalesce(t.attempts, 0) AS attempts, t.delivered_us, t.last_error FROM accepted a LEFT JOIN (
SELECT id, count(*) AS attempts, min(CASE WHEN ok THEN attempt_us END) AS delivered_us,
  arg_max(struct_pack(v := error), (attempt_us, seq)).v AS last_error FROM attempts GROUP BY id) t ON t.id = a.id""")
