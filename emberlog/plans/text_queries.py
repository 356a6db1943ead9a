"""Queries of the text, severity, key and signing functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions import clock, keys, severity, signing, source, text
from emberlog.operators import alerts, gate
from emberlog.plans import oracle as O
from emberlog.plans import testbed as tb
from emberlog.plans.registry import query


def _texts(spark, sf):
    """Every log message and every document, whole.

    The documents are laid out once: however few splits a given file has, the expressions run in all tasks."""
    docs = tb.stored(spark, sf, "documents", lambda: tb.spread(spark, sf, "documents").select(
        (F.col("doc_id") + 10**12).alias("id"), F.col("text").alias("message")
    ))
    return tb.log_events(spark, sf).select("id", "message").unionByName(docs)


O.cte("texts", ["log"], f"SELECT id, message FROM log UNION ALL SELECT doc_id + {10**12} AS id, text AS message FROM documents")


def _on_texts(name, column, expression):
    @query(name, f"SELECT id, {expression('message')} AS {name} FROM texts", "texts")
    def run(spark, sf):
        return _texts(spark, sf).select("id", column(F.col("message")).alias(name))


_on_texts("collector_severity", severity.collector_severity, O.collector_severity)
_on_texts("body_level", severity.body_level, O.body_level)
_on_texts("fault_word", severity.fault_word, O.fault)
_on_texts("gate_message_norm", keys.gate_message, O.gate_message)
_on_texts("class_skeleton", keys.class_head, O.class_head)
_on_texts("template_key", text.template_key, O.template)
_on_texts("redact", text.redact, O.redact)
_on_texts("component_of", source.component_of, O.component_of)
_on_texts("log_file_of", source.log_file_of, O.log_file_of)
_on_texts("detect_dll", source.detect_dll, lambda m: f"regexp_extract({m}, {O.q(O.I + V.DLL_NAME)})")


@query("level_rank", f"SELECT id, {O.rank('label')} AS label_rank, {O.rank('body')} AS body_rank FROM levels", "levels")
def level_rank(spark, sf):
    rows = severity.grade(tb.gate_input(spark, sf))
    return rows.select(
        "id", severity.level_rank(F.col("label")).alias("label_rank"), severity.level_rank(F.col("body")).alias("body_rank")
    )


@query("effective_severity", "SELECT id, label, body, downgraded, escalated, effective FROM graded", "graded")
def effective_severity(spark, sf):
    return severity.grade(tb.gate_input(spark, sf)).select("id", "label", "body", "downgraded", "escalated", "effective")


@query("collect_only", "SELECT id, effective, collect_only FROM graded", "graded")
def collect_only(spark, sf):
    return severity.grade(tb.gate_input(spark, sf)).select("id", "effective", "collect_only")


@query("false_error_info", f"SELECT id FROM levels WHERE {O.false_error('label', 'message')}", "levels")
def false_error_info(spark, sf):
    rows = tb.gate_input(spark, sf)
    return rows.filter(severity.false_error_info(F.col("severity"), F.col("message"))).select("id")


@query("gate_fingerprint", "SELECT id, fp AS fingerprint FROM keyed", "keyed")
def gate_fingerprint(spark, sf):
    return gate.fingerprinted(tb.gate_input(spark, sf)).select("id", "fingerprint")


@query("class_component", f"SELECT id, {O.class_component('message', 'head')} AS component FROM keyed", "keyed")
def class_component(spark, sf):
    rows = tb.gate_input(spark, sf).withColumn("head", keys.class_head(F.col("message")))
    return rows.select("id", source.class_component(F.col("message"), F.col("head")).alias("component"))


@query("class_key", "SELECT id, ck AS class_key FROM keyed", "keyed")
def class_key(spark, sf):
    rows = gate.fingerprinted(tb.gate_input(spark, sf)).withColumn("head", keys.class_head(F.col("message")))
    return rows.select(
        "id", keys.class_key(*[F.col(c) for c in ("host", "stable", "effective", "message", "head")]).alias("class_key")
    )


@query("stable_source", f"SELECT id, {O.stable_source('source')} AS stable_source FROM log", "log")
def stable_source(spark, sf):
    return tb.log_events(spark, sf).select("id", source.stable_source(F.col("source")).alias("stable_source"))


@query("stable_file", f"SELECT id, {O.stable_file('path')} AS stable_file FROM log", "log")
def stable_file(spark, sf):
    return tb.log_events(spark, sf).select("id", source.stable_file(F.col("path")).alias("stable_file"))


@query(
    "parse_source",
    f"SELECT id, {O.source_field('source', 1)} AS project, {O.source_field('source', 2)} AS program, "
    f"{O.source_field('source', 3)} AS log_file FROM log", "log",
)
def parse_source(spark, sf):
    rows = tb.log_events(spark, sf)
    return rows.select("id", *[source.source_field(F.col("source"), n).alias(n) for n in ("project", "program", "log_file")])


@query(
    "format_source",
    "SELECT id, 'project=' || project || '; program=' || program || '; log_file=' || path || '; dll=' || "
    f"CASE WHEN dll = '' THEN 'unknown' ELSE dll END AS source FROM (SELECT *, regexp_extract(message, {O.q(O.I + V.DLL_NAME)}) AS dll FROM log)", "log",
)
def format_source(spark, sf):
    rows = tb.log_events(spark, sf)
    built = source.format_source(F.col("project"), F.col("program"), F.col("path"), source.detect_dll(F.col("message")))
    return rows.select("id", built.alias("source"))


_PATH_SQL = (
    "CASE id % 7 WHEN 0 THEN path WHEN 1 THEN '/logs//' || program || '/./x.log' WHEN 2 THEN '/logs/a/../' || program || '/x.log' "
    "WHEN 3 THEN '/logs/' || program || '.log' WHEN 4 THEN 'logs/' || program || '/x.log' WHEN 5 THEN '/var/../logs/' || program || '/sub/x.log/' "
    "ELSE '/../logs/' || program || '/..' END"
)


@query("program_from_source", f"SELECT id, {O.clean_program('p')} AS program FROM (SELECT id, {_PATH_SQL} AS p FROM log)", "log")
def program_from_source(spark, sf):
    rows = tb.log_events(spark, sf).select("id", F.expr(_PATH_SQL).alias("p"))
    return rows.select("id", source.program_from_source(F.col("p")).alias("program"))


@query(
    "gateway_fingerprint",
    f"SELECT id, sha256(path || chr(0) || sev || chr(0) || {O.gateway_message('message')}) AS fingerprint "
    f"FROM (SELECT *, {O.collector_severity('message')} AS sev FROM log)", "log",
)
def gateway_fingerprint(spark, sf):
    rows = tb.log_events(spark, sf).withColumn("sev", severity.collector_severity(F.col("message")))
    return rows.select("id", keys.gateway_fingerprint(F.col("path"), F.col("sev"), F.col("message")).alias("fingerprint"))


@query(
    "cut_text",
    "SELECT doc_id, substr(text, 1, 1200) AS forwarded, octet_length(encode(substr(text, 1, 16000))) AS stored_bytes, "
    "least(octet_length(encode(text)), 4096) AS gateway_bytes FROM documents",
)
def cut_text(spark, sf):
    docs = tb.table(spark, sf, "documents")
    # a character split at the byte limit is replaced, so the cut is compared by its valid bytes
    return docs.select(
        "doc_id",
        text.cut(F.col("text"), V.MAX_FORWARDED_MESSAGE).alias("forwarded"),
        F.octet_length(text.cut(F.col("text"), V.MAX_STORED_MESSAGE)).cast("bigint").alias("stored_bytes"),
        F.octet_length(F.substring(F.encode("text", "UTF-8"), 1, V.MAX_GATEWAY_MESSAGE_BYTES)).cast("bigint").alias("gateway_bytes"),
    )


@query("local_time_label", f"SELECT id, {O.local('received_us')} AS label FROM log", "log")
def local_time_label(spark, sf):
    return tb.log_events(spark, sf).select("id", clock.local_label(F.col("received_us"), V.LOCAL_ZONE).alias("label"))


@query("rfc3339_time", f"SELECT id, {O.rfc3339('gateway_us')} AS at_utc FROM log", "log")
def rfc3339_time(spark, sf):
    return tb.log_events(spark, sf).select("id", clock.rfc3339(F.col("gateway_us")).alias("at_utc"))


@query(
    "short_key",
    "SELECT id, substr(fp, 1, 12) AS short_fingerprint, 'class_new:' || substr(ck, 1, 12) AS reason FROM keyed", "keyed",
)
def short_key(spark, sf):
    rows = gate.fingerprinted(tb.gate_input(spark, sf)).withColumn("head", keys.class_head(F.col("message")))
    key = keys.class_key(*[F.col(c) for c in ("host", "stable", "effective", "message", "head")])
    return rows.select(
        "id", keys.short_key(F.col("fingerprint")).alias("short_fingerprint"),
        F.concat(F.lit("class_new:"), keys.short_key(key)).alias("reason"),
    )


@query("incident_id", "SELECT id, md5(source || '|' || gateway_us || '|' || id) AS incident_id FROM log", "log")
def incident_id(spark, sf):
    rows = tb.log_events(spark, sf)
    return rows.select("id", signing.incident_id(F.col("source"), F.col("gateway_us"), F.col("id")).alias("incident_id"))


@query(
    "hmac_sign",
    f"SELECT id, 'v1,' || {O.hmac(tb.SECRET, O.q('') + ' || body')} AS signature FROM "
    "(SELECT id, incident_id || '.' || (received_us // 1000000) || '.' || message AS body FROM log "
    f"UNION ALL SELECT doc_id + {10**12}, 'doc-' || doc_id || '.' || n_chars || '.' || text FROM documents)", "log",
)
def hmac_sign(spark, sf):
    logs = tb.log_events(spark, sf).select(
        "id", "incident_id", clock.seconds(F.col("received_us")).alias("at"), F.col("message").alias("body")
    )
    docs = tb.table(spark, sf, "documents").select(
        (F.col("doc_id") + 10**12).alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("incident_id"),
        F.col("n_chars").alias("at"), F.col("text").alias("body"),
    )
    return logs.unionByName(docs).select(
        "id", signing.signature(tb.SECRET, F.col("incident_id"), F.col("at"), F.col("body")).alias("signature")
    )


_OR = lambda e: f"coalesce(nullif({e}, ''), '{V.UNLABELLED}')"


@query(
    "alert_fields",
    f"""SELECT id, concat_ws(chr(10),
      CASE effective_severity WHEN 'critical' THEN '{V.ALERT_TITLE["critical"]}' WHEN 'warning' THEN '{V.ALERT_TITLE["warning"]}' ELSE '{V.ALERT_TITLE["error"]}' END,
      '主机：' || host, '项目：' || {_OR(O.source_field("source", 1))},
      '程序：' || {_OR(O.source_field("source", 2))} || CASE WHEN {O.component_of("message")} <> '' THEN '｜分量：' || {O.component_of("message")} ELSE '' END,
      '文件：' || {_OR(O.source_field("source", 3))},
      CASE WHEN storm_count > 1 THEN '风暴：' || storm_window_seconds || ' 秒内同类日志 ' || storm_count || ' 条' END,
      '摘要：' || substr({O.redact("replace(trim(message), chr(10), ' ')")}, 1, 300), '事件 ID：' || incident_id) AS alert
    FROM audit WHERE llm_dispatched = 1""", "audit",
)
def alert_fields(spark, sf):
    return alerts.alert_fields(tb.audit(spark, sf).filter("llm_dispatched = 1"))
