"""Queries of the audit table, the digest and the review."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.clock import DAY, SECOND, utc_date
from emberlog.operators import audit as A
from emberlog.operators import digest, gate, gateway, partials, review
from emberlog.plans import oracle as O
from emberlog.plans import testbed as tb
from emberlog.plans.registry import query
from emberlog.session import cut, work_path
from emberlog.sources import audit_store, files, partial_store


def _recent(spark, sf):
    return A.since(tb.audit(spark, sf), tb.SINCE_US)


def _crumbs(spark, sf):
    return files.parse_breadcrumbs(tb.breadcrumb_lines(spark, sf))


@query("audit_sink", f"SELECT CAST(make_timestamp(received_us) AS DATE) AS received_date, count(*) AS n, CAST(sum(llm_dispatched) AS BIGINT) AS dispatched FROM audit GROUP BY 1", "audit")
def audit_sink(spark, sf):
    path = work_path(spark, "sink")
    rows = gate.decide(tb.gate_input(spark, sf))
    audit_store.write_batch(rows, 0, path)
    return audit_store.read_audit(spark, path).groupBy("received_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("llm_dispatched").alias("dispatched")
    )


@query("scan_breadcrumbs", "SELECT seq, at_s, stage, detail, CAST(fields AS INTEGER) AS fields FROM crumb_rows WHERE at_s IS NOT NULL", "crumb_rows")
def scan_breadcrumbs(spark, sf):
    return _crumbs(spark, sf).filter("at_s IS NOT NULL").select("seq", "at_s", "stage", "detail", "fields")


@query("scan_usage_sessions", "SELECT * FROM usage", "usage")
def scan_usage_sessions(spark, sf):
    path = work_path(spark, "usage")
    tb.usage_sessions(spark, sf).write.parquet(path)
    return files.scan_usage(spark, path)


@query("usage_filter", "SELECT source, started_at, input_tokens FROM usage_rows", "usage_rows")
def usage_filter(spark, sf):
    rows = tb.usage_sessions(spark, sf)
    return rows.filter(
        F.lower("source").contains("webhook") & (F.col("started_at").try_cast("double") >= tb.SINCE_US / SECOND)
    ).select("source", "started_at", "input_tokens")


@query(
    "usage_cost",
    "SELECT calls, input_tokens, output_tokens, cache_read_tokens, cost, (input_tokens + output_tokens + cache_read_tokens) / nullif(calls, 0) AS tokens_per_call, "
    "cost / nullif(calls, 0) AS cost_per_call, calls * 24 / 24.0::DOUBLE AS calls_per_day, cost * 24 / 24.0::DOUBLE AS cost_per_day FROM cost", "cost",
)
def usage_cost(spark, sf):
    return A.usage_cost(tb.usage_sessions(spark, sf), tb.SINCE_US)


_CUT = tb.START_US + 15 * DAY


@query(
    "audit_schema_evolution",
    f"""SELECT {O.reporting()} AS severity, suppression_reason = '' AS no_reason, count(*) AS n FROM (
      SELECT severity, CASE WHEN received_us < {_CUT} THEN 'unknown' ELSE effective_severity END AS effective_severity,
        CASE WHEN received_us < {_CUT} THEN '' ELSE suppression_reason END AS suppression_reason FROM audit) GROUP BY ALL""", "audit",
)
def audit_schema_evolution(spark, sf):
    path = work_path(spark, "evolving")
    rows = tb.audit(spark, sf)
    audit_store.write_audit(rows.filter(F.col("received_us") < _CUT).drop("effective_severity", "suppression_reason"), path)
    audit_store.write_audit(rows.filter(F.col("received_us") >= _CUT), path)
    return (
        audit_store.read_audit(spark, path)
        .groupBy(A.reporting_severity().alias("severity"), (F.col("suppression_reason") == "").alias("no_reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("window_since", "SELECT id, received_us FROM recent", "recent")
def window_since(spark, sf):
    return _recent(spark, sf).select("id", "received_us")


@query("collected_rows", f"SELECT id, received_us, storm_status FROM recent WHERE {O.reporting()} IN {O.words(V.COLLECTED_SEVERITIES)}", "recent")
def collected_rows(spark, sf):
    return A.collected(_recent(spark, sf)).select("id", "received_us", "storm_status")


@query("effective_or_label", f"SELECT id, {O.reporting()} AS severity FROM audit", "audit")
def effective_or_label(spark, sf):
    return tb.audit(spark, sf).select("id", A.reporting_severity().alias("severity"))


@query(
    "retention_prune",
    f"""SELECT 'audit' AS store, id FROM audit WHERE received_us >= {tb.START_US + 2 * DAY}
      UNION ALL SELECT 'gateway', id FROM accepted WHERE created_us >= {tb.START_US + 23 * DAY}""", "audit", "accepted",
)
def retention_prune(spark, sf):
    audit_rows = audit_store.drop_expired(tb.audit(spark, sf), tb.START_US + 32 * DAY)
    events = gateway.prune(tb.accepted(spark, sf), "created_us", tb.START_US + 30 * DAY, V.GATEWAY_RETENTION_S)
    return audit_rows.select(F.lit("audit").alias("store"), "id").unionByName(events.select(F.lit("gateway").alias("store"), "id"))


@query("severity_tally", f"SELECT {O.reporting()} AS severity, count(*) AS n FROM recent GROUP BY 1", "recent")
def severity_tally(spark, sf):
    return A.severity_tally(_recent(spark, sf))


_MIS = (
    "count(*) FILTER (suppression_reason LIKE 'body_tag_info_collector_%') AS info_as_error, "
    "count(*) FILTER (suppression_reason LIKE 'body_tag_warning_collector_%') AS warning_as_error, "
    f"count(*) FILTER (suppression_reason = '{V.COUNTER_REASON}') AS zero_counter, "
    f"count(*) FILTER (lower(severity) IN {O.words(V.COLLECTED_SEVERITIES)} AND lower(effective_severity) IN ('error', 'critical')) AS escalated"
)
_CLS = ", ".join(
    f"count(*) FILTER (starts_with(suppression_reason, '{p}:')) AS {n}"
    for n, p in (("class_new", "class_new"), ("cooldown_expired", "class_cooldown_expired"),
                 ("storm_summary", "class_storm_summary"), ("cooled", "class_cooldown"))
)


@query("mislabel_counts", f"SELECT {_MIS} FROM recent", "recent")
def mislabel_counts(spark, sf):
    return A.mislabel_counts(_recent(spark, sf))


@query("class_decision_counts", f"SELECT {_CLS} FROM recent", "recent")
def class_decision_counts(spark, sf):
    return A.class_decision_counts(_recent(spark, sf))


_HOURS = (tb.NOW_US - tb.SINCE_US) / SECOND / 3600.0


_DISPATCH = (
    f"SELECT dispatched, events, dispatched * 24 / {_HOURS}::DOUBLE AS per_day, 1700 AS baseline_per_day, 365 AS target_per_day "
    "FROM (SELECT CAST(coalesce(sum(llm_dispatched), 0) AS BIGINT) AS dispatched, count(*) AS events FROM recent)"
)


@query("dispatch_totals", _DISPATCH, "recent")
def dispatch_totals(spark, sf):
    return A.dispatch_totals(_recent(spark, sf), tb.SINCE_US, tb.NOW_US)


_PROFILE = "SELECT strftime(make_timestamp(received_us), '%m-%d %H:00') AS hour, count(*) AS events, CAST(sum(llm_dispatched) AS BIGINT) AS dispatched FROM recent GROUP BY 1 ORDER BY 1 LIMIT 12"


@query("hourly_profile", _PROFILE, "recent")
def hourly_profile(spark, sf):
    return A.hourly_profile(_recent(spark, sf))


_COOLED = "SELECT suppression_reason, count(*) AS n FROM recent WHERE starts_with(suppression_reason, 'class_cooldown:') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"


@query("top_cooled_classes", _COOLED, "recent")
def top_cooled_classes(spark, sf):
    return A.top_cooled(_recent(spark, sf))


@query(
    "cooled_sample",
    f"SELECT t.suppression_reason, t.n, (SELECT substr(arg_min(a.message, (a.received_us, a.id)), 1, 120) FROM recent a WHERE a.suppression_reason = t.suppression_reason) AS sample FROM ({_COOLED}) t",
    "recent",
)
def cooled_sample(spark, sf):
    return A.cooled_samples(_recent(spark, sf))


_CLUSTER_COLUMNS = ["host", "project", "program", "stable_file", "template", "n", "first_us", "last_us", "first_id",
                    "max_count", "sample", "log_file", "raw_source"]


@query("digest_clusters", f"SELECT {', '.join(_CLUSTER_COLUMNS)} FROM clusters", "clusters")
def digest_clusters(spark, sf):
    return digest.clusters(_recent(spark, sf)).select(_CLUSTER_COLUMNS)


@query(
    "cluster_status_hist",
    "SELECT c_host AS host, c_project AS project, c_program AS program, c_file AS stable_file, c_template AS template, storm_status, count(*) AS n FROM cluster_rows GROUP BY ALL",
    "cluster_rows",
)
def cluster_status_hist(spark, sf):
    rows = digest.cluster_statuses(_recent(spark, sf))
    return rows.select(*digest.CLUSTER_KEY, F.explode("statuses").alias("storm_status", "n"))


@query("digest_totals", "SELECT CAST(sum(n) AS BIGINT) AS warnings, count(*) AS clusters FROM clusters", "clusters")
def digest_totals(spark, sf):
    return digest.totals(digest.counted(digest.keyed_rows(_recent(spark, sf))))


@query("digest_top20", "SELECT host, program, template, n FROM top", "top")
def digest_top20(spark, sf):
    return digest.top_clusters(_recent(spark, sf))[1].select("host", "program", "template", "n")


@query("cluster_rank", "SELECT rank, host, program, template, n, first_us FROM top", "top")
def cluster_rank(spark, sf):
    return digest.top_clusters(_recent(spark, sf))[1].select(
        F.col("rank").cast("bigint").alias("rank"), "host", "program", "template", "n", "first_us"
    )


@query("cluster_line", "SELECT rank, header, sample_line, template_line FROM fitted", "fitted")
def cluster_line(spark, sf):
    lines = digest.blocks(digest.top_clusters(_recent(spark, sf))[1])
    return lines.select(F.col("rank").cast("bigint").alias("rank"), "header", "sample_line", "template_line")


@query(
    "budget_prefix",
    "SELECT rank, CAST(spent AS BIGINT) AS spent FROM (SELECT *, sum(length(header) + length(sample_line) + length(template_line) + 3) OVER (ORDER BY rank) AS spent FROM lines) "
    f"WHERE spent <= {V.CLUSTER_BUDGET}", "lines",
)
def budget_prefix(spark, sf):
    rows = digest.blocks(digest.top_clusters(_recent(spark, sf))[1])
    return rows.select(F.col("rank").cast("bigint").alias("rank"), "spent")


_FAILURES = f"SELECT *, 'guard ' || stage || ' during ' || substr(detail, 1, 160) AS text FROM crumb_rows WHERE at_s >= {tb.SINCE_US / SECOND} AND fields >= 3"


@query(
    "breadcrumb_summary",
    f"SELECT count(*) AS failures, substr(arg_max(value, (at_s, value)), 1, 150) AS last FROM crumb_rows WHERE at_s >= {tb.SINCE_US / SECOND}", "crumb_rows",
)
def breadcrumb_summary(spark, sf):
    return review.breadcrumb_summary(_crumbs(spark, sf), tb.SINCE_US)


@query(
    "digest_silent",
    f"SELECT warnings, failures, warnings = 0 AND failures = 0 AS silent FROM (SELECT (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM clusters) AS warnings, (SELECT count(*) FROM ({_FAILURES})) AS failures)",
    "clusters", "crumb_rows",
)
def digest_silent(spark, sf):
    return digest.is_silent(
        digest.totals(digest.counted(digest.keyed_rows(_recent(spark, sf)))), digest.failures_since(_crumbs(spark, sf), tb.SINCE_US)
    )


def _fill(text: str, **values: str) -> str:
    parts, rest = [], text
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [O.q(before), f"({values[name]})"]
    return " || ".join([*parts, O.q(rest)])


_REPORT = f"""
SELECT row_number() OVER (ORDER BY section, part) AS line_no, text FROM (
SELECT 1 AS section, 0 AS part, 'DAILY_DIGEST' AS text
UNION ALL SELECT 2, 0, {_fill(V.D_WINDOW, since=O.local(str(tb.SINCE_US)), now=O.local(str(tb.NOW_US)),
    tally=f"SELECT coalesce(string_agg(s || '=' || n, ', ' ORDER BY n DESC, s), '0') FROM (SELECT {O.reporting()} AS s, count(*) AS n FROM recent GROUP BY 1)")}
UNION ALL SELECT 3, 0, {_fill(V.D_TOTALS, warnings="SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM clusters", clusters="SELECT count(*) FROM clusters")}
UNION ALL SELECT 4, 0, {_fill(V.D_MISLABEL, info="info_as_error", warn="warning_as_error", zero="zero_counter")} FROM (SELECT {_MIS} FROM recent) WHERE info_as_error + warning_as_error + zero_counter + escalated > 0
UNION ALL SELECT 5, 0, {_fill(V.D_ESCALATED, escalated="escalated")} FROM (SELECT {_MIS} FROM recent) WHERE escalated > 0
UNION ALL SELECT 6, 0, {_fill(V.D_CLASSES, new="class_new", expired="cooldown_expired", burst="storm_summary", cooled="cooled")} FROM (SELECT {_CLS} FROM recent) WHERE class_new + cooldown_expired + storm_summary + cooled > 0
UNION ALL SELECT 7, 0, {_fill(V.D_USAGE, calls="calls", input="format('{:,}', input_tokens)", cache="format('{:,}', cache_read_tokens)", output="format('{:,}', output_tokens)", cost="format('{:.3f}', cost)")} FROM cost
UNION ALL SELECT 7, 1, {_fill(V.D_USAGE_RATE, tokens="format('{:.0f}', (input_tokens + output_tokens + cache_read_tokens) / calls)", each="format('{:.5f}', cost / calls)", daily="calls", daily_cost="format('{:.2f}', cost)")} FROM cost WHERE calls > 0
UNION ALL SELECT 8, 0, '{V.D_WATCHDOG_HEAD}' WHERE EXISTS ({_FAILURES})
UNION ALL (SELECT 8, row_number() OVER (ORDER BY at_s, value), '{V.D_WATCHDOG_MARK}' || text FROM ({_FAILURES}) ORDER BY at_s, value LIMIT 10)
UNION ALL SELECT 9, 0, '{V.D_WATCHDOG_TAIL}' WHERE EXISTS ({_FAILURES})
UNION ALL SELECT 10, 0, '{V.D_NOTES}'
UNION ALL SELECT 11, 0, ''
UNION ALL SELECT 12, rank * 3, header FROM fitted UNION ALL SELECT 12, rank * 3 + 1, sample_line FROM fitted UNION ALL SELECT 12, rank * 3 + 2, template_line FROM fitted
UNION ALL SELECT 13, 0, {_fill(V.D_UNLISTED, rest="total - listed", listed="listed")} FROM (SELECT (SELECT count(*) FROM clusters) AS total, (SELECT count(*) FROM fitted) AS listed) WHERE listed < total)"""


@query("digest_report", _REPORT, "recent", "clusters", "fitted", "cost", "crumb_rows")
def digest_report(spark, sf):
    return digest.report(
        tb.audit(spark, sf), tb.SINCE_US, tb.NOW_US, tb.usage_sessions(spark, sf), _crumbs(spark, sf)
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def _partials(spark, audit):
    """Partials of the finished days, made in two goes, as two days' runs would."""
    path = work_path(spark, "partials")
    for before_us in (tb.START_US + 15 * DAY, tb.NOW_US):
        partial_store.finish_days(spark, audit, path, before_us)
    return path


@query("digest_from_partials", _REPORT, "recent", "clusters", "fitted", "cost", "crumb_rows")
def digest_from_partials(spark, sf):
    """The digest of a long window from finished days' partials and the rows of the open day."""
    audit = tb.audit(spark, sf)
    figures = partials.figures(partial_store.window(spark, audit, _partials(spark, audit), tb.SINCE_US))
    cost = A.usage_cost(tb.usage_sessions(spark, sf), tb.SINCE_US)
    failures = digest.first_failures(digest.failures_since(_crumbs(spark, sf), tb.SINCE_US))
    lines = digest.report_lines(audit, tb.SINCE_US, tb.NOW_US, cost, failures, figures=figures)
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    "digest_watermark",
    f"SELECT {tb.SINCE_US} AS since_us, greatest(max(received_us), {tb.NOW_US - 60 * SECOND}) AS mark_us FROM recent WHERE {O.reporting()} IN {O.words(V.COLLECTED_SEVERITIES)}",
    "recent",
)
def digest_watermark(spark, sf):
    path = work_path(spark, "mark")
    audit_store.write_mark(spark, path, tb.SINCE_US)
    since_us = audit_store.read_mark(spark, path, tb.NOW_US)
    mark = digest.next_mark(tb.audit(spark, sf), since_us, tb.NOW_US)
    audit_store.write_mark(spark, path, mark.first()["mark_us"])
    return spark.read.parquet(path).agg(F.min("mark_us").alias("since_us"), F.max("mark_us").alias("mark_us"))


_MARK = f"(SELECT greatest(max(received_us), {tb.NOW_US - 60 * SECOND}) FROM recent WHERE {O.reporting()} IN {O.words(V.COLLECTED_SEVERITIES)})"
_RUN = "count(*) AS warnings, count(DISTINCT (c_host, c_project, c_program, c_file, c_template)) AS clusters"


@query(
    "incremental_digest",
    f"""SELECT 1 AS run, true AS moved, {_MARK} AS mark_us, {_RUN} FROM cluster_rows
    UNION ALL SELECT 2, true, {_MARK}, {_RUN} FROM cluster_rows WHERE received_us >= {_MARK}""", "recent", "cluster_rows",
)
def incremental_digest(spark, sf):
    """Two runs: from the mark to now, then again at once; the second covers one minute at most."""
    audit_path, mark_path = work_path(spark, "audit"), work_path(spark, "mark")
    audit_store.write_audit(tb.audit(spark, sf).drop("received_date"), audit_path)
    audit_store.write_mark(spark, mark_path, tb.SINCE_US)
    partial_path = _partials(spark, audit_store.read_audit(spark, audit_path))
    runs = []
    for run in (1, 2):
        out = work_path(spark, "digest")
        moved = audit_store.run_digest(spark, audit_path, mark_path, tb.NOW_US, out, partial_path=partial_path)
        figure = lambda name: F.regexp_extract("value", rf"{name}=(\d+)", 1).cast("bigint").alias(name.lower())
        runs.append(spark.read.text(out).filter(F.col("value").startswith("WARNINGS=")).select(
            F.lit(run).alias("run"), F.lit(moved).alias("moved"),
            F.lit(audit_store.read_mark(spark, mark_path, tb.NOW_US)).alias("mark_us"), figure("WARNINGS"), figure("CLUSTERS")))
    return runs[0].unionByName(runs[1])


_WATCHDOG = ["DAILY_DIGEST", *[line.replace("{error}", "AnalysisException: UNRESOLVED_COLUMN.WITH_SUGGESTION") for line in V.D_UNREADABLE]]


@query(
    "store_watchdog",
    f"SELECT text, false AS mark_moved, {tb.SINCE_US} AS mark_us FROM (VALUES {', '.join(f'({O.q(line)})' for line in _WATCHDOG)}) AS lines(text), (SELECT count(*) FROM audit)", "audit",
)
def store_watchdog(spark, sf):
    """The audit table written without its time column cannot be read: fixed lines, mark kept."""
    audit_path, mark_path, out = work_path(spark, "audit"), work_path(spark, "mark"), work_path(spark, "digest")
    tb.audit(spark, sf).drop("received_us").write.parquet(audit_path)
    audit_store.write_mark(spark, mark_path, tb.SINCE_US)
    moved = audit_store.run_digest(spark, audit_path, mark_path, tb.NOW_US, out)
    mark = audit_store.read_mark(spark, mark_path, tb.NOW_US)
    return spark.read.text(out).select(
        F.col("value").alias("text"), F.lit(moved).alias("mark_moved"), F.lit(mark).alias("mark_us")
    )


def _figures(section: str, names: list[str], frame: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}', '{n}', CAST({n} AS DOUBLE) FROM ({frame})" for n in names)


_FIGURES = f"""
SELECT 'severity' AS section, {O.reporting()} AS item, CAST(count(*) AS DOUBLE) AS value FROM recent GROUP BY 2
UNION ALL {_figures("dispatch", ["dispatched", "events", "per_day", "baseline_per_day", "target_per_day"], _DISPATCH)}
UNION ALL {_figures("class", ["class_new", "cooldown_expired", "storm_summary", "cooled"], f"SELECT {_CLS} FROM recent")}
UNION ALL {_figures("mislabel", ["info_as_error", "warning_as_error", "zero_counter", "escalated"], f"SELECT {_MIS} FROM recent")}
UNION ALL SELECT 'cooled', suppression_reason, CAST(n AS DOUBLE) FROM ({_COOLED})
UNION ALL SELECT 'hour_events', hour, CAST(events AS DOUBLE) FROM ({_PROFILE})
UNION ALL SELECT 'hour_dispatched', hour, CAST(dispatched AS DOUBLE) FROM ({_PROFILE})"""


@query("review_figures", _FIGURES, "recent")
def review_figures(spark, sf):
    return review.review(tb.audit(spark, sf), tb.SINCE_US, tb.NOW_US)


_H = f"{(tb.NOW_US - tb.SINCE_US) / SECOND / 3600.0}::DOUBLE"
_REVIEW = f"""
SELECT row_number() OVER (ORDER BY section, part) AS line_no, text FROM (
SELECT 1 AS section, 0 AS part, 'TRIAL_REVIEW' AS text
UNION ALL SELECT 2, 0, {_fill(V.R_WINDOW, since=O.local(str(tb.SINCE_US)), now=O.local(str(tb.NOW_US)), hours=f"format('{{:.1f}}', {_H})")}
UNION ALL SELECT 3, 0, {_fill(V.R_TALLY, tally=f"SELECT string_agg(s || '=' || n, ', ' ORDER BY n DESC, s) FROM (SELECT {O.reporting()} AS s, count(*) AS n FROM recent GROUP BY 1)")}
UNION ALL SELECT 4, 0, {_fill(V.R_DISPATCH, dispatched="dispatched", events="events", per_day=f"format('{{:.0f}}', dispatched * 24 / {_H})", baseline=str(V.BASELINE_CALLS), target=str(V.TARGET_CALLS))} FROM ({_DISPATCH})
UNION ALL SELECT 4, 1, {_fill(V.R_CLASSES, new="class_new", expired="cooldown_expired", burst="storm_summary", cooled="cooled")} FROM (SELECT {_CLS} FROM recent)
UNION ALL SELECT 4, 2, {_fill(V.R_MISLABEL, info="info_as_error", warn="warning_as_error", zero="zero_counter", escalated="escalated")} FROM (SELECT {_MIS} FROM recent)
UNION ALL SELECT 4, 3, '' UNION ALL SELECT 4, 4, '{V.R_COOLED_HEAD}'
UNION ALL SELECT 5, row_number() OVER (ORDER BY n DESC, suppression_reason), {_fill(V.R_COOLED, n="n", reason="t.suppression_reason", sample="SELECT replace(substr(arg_min(a.message, (a.received_us, a.id)), 1, 120), chr(10), ' ') FROM recent a WHERE a.suppression_reason = t.suppression_reason")} FROM ({_COOLED}) t
UNION ALL SELECT 6, 0, '' UNION ALL SELECT 7, 0, '{V.R_HOURS_HEAD}'
UNION ALL SELECT 8, row_number() OVER (ORDER BY hour), {_fill(V.R_HOUR, hour="hour", events="format('{:3d}', events)", dispatched="format('{:3d}', dispatched)")} FROM ({_PROFILE})
UNION ALL SELECT 9, 0, ''
UNION ALL SELECT 9, 1, {_fill(V.R_USAGE, calls="calls", input="format('{:,}', input_tokens)", cache="format('{:,}', cache_read_tokens)", output="format('{:,}', output_tokens)", cost="format('{:.3f}', cost)")} FROM cost
UNION ALL SELECT 9, 2, {_fill(V.R_USAGE_RATE, daily=f"CAST(floor(calls * 24 / {_H}) AS BIGINT)", daily_cost=f"format('{{:.2f}}', cost * 24 / {_H})", baseline=f"'{V.BASELINE_COST:.2f}'", target=f"'{V.TARGET_COST:.2f}'")} FROM cost
UNION ALL SELECT 10, 0, ''
UNION ALL SELECT 10, 1, {_fill(V.R_BREADCRUMBS, n="failures", last=f"CASE WHEN failures > 0 THEN {_fill(V.R_LAST, last='last')} ELSE '' END")} FROM (
  SELECT count(*) AS failures, substr(arg_max(value, (at_s, value)), 1, 150) AS last FROM crumb_rows WHERE at_s >= {tb.SINCE_US / SECOND}))"""


@query("review_report", _REVIEW, "recent", "cost", "crumb_rows")
def review_report(spark, sf):
    """Every line of the review."""
    lines = review.report(tb.audit(spark, sf), tb.SINCE_US, tb.NOW_US, tb.usage_sessions(spark, sf), _crumbs(spark, sf))
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))
