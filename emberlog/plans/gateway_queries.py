"""Queries of the collector side and of the receiver's checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.clock import SECOND
from emberlog.operators import gateway, inbox
from emberlog.plans import oracle as O
from emberlog.plans import testbed as tb
from emberlog.plans.registry import query
from emberlog.session import work_path
from emberlog.sources import audit_store, files


@query("scan_log_files", "SELECT program, message AS value, count(*) AS n FROM log GROUP BY ALL", "log")
def scan_log_files(spark, sf):
    root = work_path(spark, "logs")
    tb.log_events(spark, sf).select("program", F.col("message").alias("value")).write.partitionBy("program").text(root)
    lines = files.scan_log_files(spark, root, suffix=".txt")
    program = F.regexp_extract("path", "/program=([^/]+)/", 1)
    return lines.groupBy(program.alias("program"), "value").agg(F.count(F.lit(1)).alias("n"))


@query("parse_envelope", "SELECT id, source, message FROM parsed", "parsed")
def parse_envelope(spark, sf):
    return gateway.parse_envelope(tb.raw_bodies(spark, sf)).select("id", "source", "message")


@query("load_allowlist", "SELECT project, program, enabled FROM allow", "allow")
def load_allowlist(spark, sf):
    return tb.allowlist(spark, sf)


_HITS = ", ".join(
    f"CASE WHEN contains(m, {O.q(word.lower())})" + (f" AND NOT contains(m, {O.q(benign.lower())})" if benign else "") + f" THEN {O.q(name)} END"
    for name, word, benign in V.ROUTERS
)


@query("route_match", f"SELECT id, concat_ws(',', {_HITS}) AS routers FROM (SELECT *, lower(message) AS m FROM log) WHERE concat_ws(',', {_HITS}) <> ''", "log")
def route_match(spark, sf):
    return gateway.route(tb.log_events(spark, sf)).select("id", F.array_join("routers", ",").alias("routers"))


@query("route_fanout", f"SELECT * FROM (SELECT id, unnest([{_HITS}]) AS router FROM (SELECT *, lower(message) AS m FROM log)) WHERE router IS NOT NULL", "log")
def route_fanout(spark, sf):
    return gateway.fan_out(gateway.route(tb.log_events(spark, sf))).select("id", "router")


@query("reject_invalid", "SELECT id FROM placed WHERE NOT ok", "placed")
def reject_invalid(spark, sf):
    rows = gateway.parse_envelope(tb.raw_bodies(spark, sf))
    return rows.filter(~gateway.acceptable(F.col("raw"), F.col("message"))).select("id")


@query("allowlist_join", "SELECT id, program, project, enabled, dll FROM placed", "placed")
def allowlist_join(spark, sf):
    rows = gateway.parse_envelope(tb.raw_bodies(spark, sf))
    return gateway.with_context(rows, tb.allowlist(spark, sf)).select("id", "program", "project", "enabled", "dll")


@query("allowlist_filter", "SELECT id, program FROM placed WHERE ok AND enabled", "placed")
def allowlist_filter(spark, sf):
    rows = tb.received(spark, sf)
    return rows.filter("ok AND enabled").select("id", "program")


@query("gateway_throttle", "SELECT id, fp AS fingerprint, accepted, acc_id AS accepted_id FROM gateway_fold", "gateway_fold")
def gateway_throttle(spark, sf):
    judged = gateway.gateway_throttle(gateway.receipts(tb.received(spark, sf)))
    return judged.select("id", "fingerprint", "accepted", "accepted_id")


@query(
    "throttle_lookup",
    "SELECT f.id, f.acc_id AS accepted_id, f.us - f.acc_us AS age_us FROM gateway_fold f WHERE NOT f.accepted", "gateway_fold",
)
def throttle_lookup(spark, sf):
    judged = gateway.gateway_throttle(gateway.receipts(tb.received(spark, sf)))
    return judged.filter(~F.col("accepted")).select("id", "accepted_id", (F.col("us") - F.col("accepted_us")).alias("age_us"))


@query(
    "ingest_verdict",
    """SELECT p.id, CASE WHEN NOT p.ok THEN 'rejected' WHEN NOT p.enabled THEN 'disabled' WHEN f.accepted THEN 'accepted' ELSE 'duplicate' END AS verdict,
      f.acc_id AS accepted_id FROM placed p LEFT JOIN gateway_fold f ON f.id = p.id""", "placed", "gateway_fold",
)
def ingest_verdict(spark, sf):
    return gateway.ingest(tb.raw_bodies(spark, sf), tb.allowlist(spark, sf))


@query("occurrence_counts", "SELECT id, occurrences FROM accepted", "accepted")
def occurrence_counts(spark, sf):
    return tb.accepted(spark, sf).select("id", "occurrences")


_BODY = (
    "CAST(json_object('incident_id', incident_id, 'host', host, 'source', 'project=' || project || '; program=' || program || '; log_file=' || source || '; dll=' || "
    f"CASE WHEN dll = '' THEN 'unknown' ELSE dll END, 'severity', severity, 'message', message, 'timestamp', {O.rfc3339('created_us')}) AS VARCHAR)"
)


@query(
    "emit_signed_events",
    "SELECT svix_id, svix_timestamp, 'v1,' || " + O.hmac(tb.SECRET, "svix_id || '.' || svix_timestamp || '.' || raw_body")
    + f" AS svix_signature, raw_body FROM (SELECT incident_id AS svix_id, created_us // 1000000 + 2 AS svix_timestamp, {_BODY} AS raw_body FROM accepted)",
    "accepted",
)
def emit_signed_events(spark, sf):
    rows = tb.accepted(spark, sf)
    return gateway.signed_events(rows, F.col("host"), tb.SECRET, F.col("created_us") + 2 * SECOND)


@query("signature_valid", "SELECT seq, signature_ok FROM verified", "verified")
def signature_valid(spark, sf):
    return inbox.verify(tb.signed(spark, sf), tb.SECRET).select("seq", "signature_ok")


@query("fresh_event", "SELECT seq, fresh_ok FROM verified", "verified")
def fresh_event(spark, sf):
    return inbox.verify(tb.signed(spark, sf), tb.SECRET).select("seq", "fresh_ok")


@query("valid_payload", "SELECT seq, payload_ok FROM verified", "verified")
def valid_payload(spark, sf):
    return inbox.verify(tb.signed(spark, sf), tb.SECRET).select("seq", "payload_ok")


_VALID = "signature_ok AND fresh_ok AND payload_ok"


@query(
    "scan_signed_events",
    f"SELECT seq, json_extract_string(raw_body, '$.incident_id') AS incident_id, json_extract_string(raw_body, '$.host') AS host, "
    "json_extract_string(raw_body, '$.source') AS source, json_extract_string(raw_body, '$.severity') AS severity, "
    f"json_extract_string(raw_body, '$.message') AS message, json_extract_string(raw_body, '$.timestamp') AS \"timestamp\" FROM verified WHERE {_VALID}",
    "verified",
)
def scan_signed_events(spark, sf):
    rows = inbox.verify(tb.signed(spark, sf), tb.SECRET).filter(_VALID)
    return inbox.payload(rows).select("seq", "incident_id", "host", "source", "severity", "message", "timestamp")


@query(
    "dedupe_incident",
    f"SELECT seq, svix_id FROM verified WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY svix_id ORDER BY received_us, seq) = 1", "verified",
)
def dedupe_incident(spark, sf):
    rows = inbox.verify(tb.signed(spark, sf), tb.SECRET).filter(_VALID)
    return inbox.first_deliveries(rows).select("seq", "svix_id")


@query(
    "quarantine_sink",
    "SELECT (received_us + 500000) // 1000000 || chr(9) || 'payload' || chr(9) || substr('ValueError: not an object: ' || raw_body, 1, 400) AS value, raw_body AS body FROM verified WHERE NOT payload_ok",
    "verified",
)
def quarantine_sink(spark, sf):
    rows = inbox.verify(tb.signed(spark, sf), tb.SECRET).filter(~F.col("payload_ok"))
    path = work_path(spark, "quarantine")
    reason = F.concat(F.lit("ValueError: not an object: "), F.col("raw_body"))
    audit_store.quarantine(rows, "payload", reason, F.col("raw_body")).write.parquet(path)
    return spark.read.parquet(path).select("value", "body")


@query("delivery_ledger", "SELECT id, attempts, delivered_us, last_error FROM ledger", "ledger")
def delivery_ledger(spark, sf):
    ledger = gateway.delivery_ledger(tb.accepted(spark, sf), tb.attempts(spark, sf))
    return ledger.select("id", "attempts", "delivered_us", "last_error")


@query(
    "delivery_recheck",
    f"""SELECT l.id, CASE WHEN a.program <> 'Ledger' THEN 'deliver' ELSE 'close' END AS action,
      CASE WHEN a.program = 'Ledger' THEN '{V.DISABLED_REASON}' END AS last_error
    FROM ledger l JOIN accepted a ON a.id = l.id WHERE l.delivered_us IS NULL""", "ledger", "accepted",
)
def delivery_recheck(spark, sf):
    edited = tb.allowlist(spark, sf).withColumn("enabled", F.col("enabled") & (F.col("program") != "Ledger"))
    ledger = gateway.delivery_ledger(tb.accepted(spark, sf), tb.attempts(spark, sf))
    waiting = ledger.filter(F.col("delivered_us").isNull()).drop("last_error")
    return gateway.recheck(waiting, edited).select("id", "action", "last_error")


@query(
    "pending_delivery",
    "SELECT l.id, l.created_us FROM ledger l JOIN accepted a ON a.id = l.id WHERE l.delivered_us IS NULL AND a.program <> 'Ledger' ORDER BY l.created_us, l.id LIMIT 50",
    "ledger", "accepted",
)
def pending_delivery(spark, sf):
    """One retry batch after a recheck has closed the rows of a program that was disabled meanwhile."""
    edited = tb.allowlist(spark, sf).withColumn("enabled", F.col("enabled") & (F.col("program") != "Ledger"))
    events, tries = tb.accepted(spark, sf), tb.attempts(spark, sf)
    waiting = gateway.delivery_ledger(events, tries).filter(F.col("delivered_us").isNull()).drop("last_error")
    closed = gateway.closures(gateway.recheck(waiting, edited), tb.NOW_US)
    return gateway.pending(gateway.delivery_ledger(events, tries, closed)).select("id", "created_us")
