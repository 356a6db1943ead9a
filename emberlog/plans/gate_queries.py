"""Queries of the real-time gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.clock import DAY, SECOND
from emberlog.functions.severity import triage_class as triage
from emberlog.operators import audit as A
from emberlog.operators import gate, slices
from emberlog.plans import oracle as O
from emberlog.plans import testbed as tb
from emberlog.plans.registry import query
from emberlog.session import cut

AUDIT = ", ".join(gate.AUDIT_COLUMNS)


def _marked(spark, sf):
    return gate.laid_out(cut(gate.verdict_rows(tb.gate_input(spark, sf))))


@query("gate_decisions", f"SELECT {AUDIT} FROM audit", "audit")
def gate_decisions(spark, sf):
    return gate.decide(tb.gate_input(spark, sf))


@query("storm_sessions", "SELECT id, cnt AS position FROM storm", "storm")
def storm_sessions(spark, sf):
    return gate.storm_runs(_marked(spark, sf)).select("id", "position")


@query("storm_gate", "SELECT id, cnt AS storm_count, status AS storm_status, send AS survives FROM storm", "storm")
def storm_gate(spark, sf):
    return gate.storm_gate(_marked(spark, sf)).select("id", "storm_count", "storm_status", "survives")


@query("class_gate", "SELECT id, note, paged, cnt AS events_window, total AS events_total FROM class_fold", "class_fold")
def class_gate(spark, sf):
    _, classes = gate.gate_layers(_marked(spark, sf))
    return classes.select("id", "note", "paged", "events_window", "events_total")


@query("audit_union", "SELECT storm_status, count(*) AS n, CAST(sum(llm_dispatched) AS BIGINT) AS dispatched FROM audit GROUP BY storm_status", "audit")
def audit_union(spark, sf):
    """The early exits and the stateful rows in one table."""
    rows = gate.decide(tb.gate_input(spark, sf))
    return rows.groupBy("storm_status").agg(F.count(F.lit(1)).alias("n"), F.sum("llm_dispatched").alias("dispatched"))


_LAST = f"(SELECT max(received_us) FROM log) - {DAY}"


def _now(spark, sf) -> int:
    return tb.log_events(spark, sf).agg(F.max("received_us")).first()[0]


@query(
    "state_ttl",
    f"""SELECT id, row_number() OVER (PARTITION BY fp ORDER BY us, id) = 1 AS first_ever, status = 'first_seen' AS first_seen FROM storm""", "storm",
)
def state_ttl(spark, sf):
    runs = gate.storm_runs(_marked(spark, sf))
    forgotten = F.col("gap").isNull() | (F.col("gap") > V.STATE_RETENTION_S * SECOND)
    return runs.select("id", F.col("gap").isNull().alias("first_ever"), forgotten.alias("first_seen"))


SNAPSHOT = f"""SELECT 'fingerprint' AS layer, s.fp AS key, s.opened AS window_started_us, s.us AS last_seen_us, s.cnt AS events_in_window, s.cnt * 0 AS events_total,
      s.sent AS last_agent_sent_us, s.last_storm AS last_storm_sent_us, l.message AS sample_message
    FROM storm s JOIN log l ON l.id = s.opened_id WHERE s.us >= {_LAST} QUALIFY row_number() OVER (PARTITION BY s.fp ORDER BY s.rn DESC) = 1
    UNION ALL SELECT 'class', s.ck, s.opened, s.us, s.cnt, s.total, s.sent, s.last_storm, l.message
    FROM class_fold s JOIN log l ON l.id = s.id WHERE s.us >= {_LAST} QUALIFY row_number() OVER (PARTITION BY s.ck ORDER BY s.rn DESC) = 1"""


@query("state_snapshot", SNAPSHOT, "log", "storm", "class_fold")
def state_snapshot(spark, sf):
    events = tb.gate_input(spark, sf)
    storm, classes = gate.gate_layers(_marked(spark, sf))
    now = _now(spark, sf)
    fine = gate.storm_state(events, storm, now).select(
        F.lit("fingerprint").alias("layer"), F.col("fingerprint").alias("key"), "window_started_us", "last_seen_us",
        "events_in_window", F.lit(0).cast("bigint").alias("events_total"), "last_agent_sent_us", "last_storm_sent_us", "sample_message",
    )
    coarse = gate.class_state(events, classes, now).select(
        F.lit("class").alias("layer"), F.col("class_key").alias("key"), "window_started_us", "last_seen_us",
        F.col("events_window").alias("events_in_window"), "events_total", "last_agent_sent_us", "last_storm_sent_us", "sample_message",
    )
    return fine.unionByName(coarse)


@query(
    "state_lookup",
    f"""SELECT k.id, s.last_seen_us, s.events_in_window, s.last_agent_sent_us FROM keyed k JOIN (
      SELECT fp, us AS last_seen_us, cnt AS events_in_window, sent AS last_agent_sent_us FROM storm WHERE us >= {_LAST}
      QUALIFY row_number() OVER (PARTITION BY fp ORDER BY rn DESC) = 1) s ON s.fp = k.fp WHERE k.exit_status IS NULL""",
    "keyed", "storm", "log",
)
def state_lookup(spark, sf):
    """Every stateful event meets the state of its key: one row per key, so a skewed key is split
    by Spark's skew join on the event side."""
    events = tb.gate_input(spark, sf)
    storm = cut(gate.storm_gate(_marked(spark, sf)))
    state = gate.storm_state(events, storm, _now(spark, sf))
    rows = storm.select("id", F.lower(F.hex("fingerprint")).alias("fingerprint"))
    return rows.join(state, "fingerprint").select("id", "last_seen_us", "events_in_window", "last_agent_sent_us")


@query(
    "replay_regression",
    """SELECT count(DISTINCT q.ck) AS paged_before, count(DISTINCT CASE WHEN c.paged THEN c.ck END) AS paged_now,
      count(DISTINCT q.ck) - count(DISTINCT CASE WHEN c.paged THEN c.ck END) AS lost FROM class_seq q LEFT JOIN class_fold c ON c.id = q.id""",
    "class_seq", "class_fold",
)
def replay_regression(spark, sf):
    """Every class the older gate paged must still be paged; lost must be 0."""
    storm, classes = gate.gate_layers(_marked(spark, sf))
    old = storm.filter(F.col("survives") & ~F.col("collect_only") & F.col("class_key").isNotNull()).select(
        "class_key", F.lit(1).alias("llm_dispatched")
    )
    new = cut(classes).select("class_key", F.col("paged").cast("int").alias("llm_dispatched"))
    lost = A.lost_classes(old, new).select(F.lit("lost").alias("side"))
    sides = (
        old.select("class_key").distinct().select(F.lit("before").alias("side"))
        .unionByName(new.filter("llm_dispatched = 1").select("class_key").distinct().select(F.lit("now").alias("side")))
        .unionByName(lost)
    )
    return sides.agg(
        F.count_if(F.col("side") == "before").alias("paged_before"),
        F.count_if(F.col("side") == "now").alias("paged_now"),
        F.count_if(F.col("side") == "lost").alias("lost"),
    )


@query(
    "custom_gate",
    f"""SELECT {", ".join(c for c in gate.AUDIT_COLUMNS if c not in ("llm_dispatched", "suppression_reason"))},
      CASE WHEN quiet THEN 0 ELSE llm_dispatched END AS llm_dispatched, CASE WHEN quiet THEN 'own_gate' ELSE suppression_reason END AS suppression_reason
    FROM (SELECT *, llm_dispatched = 1 AND source = 'host-logs' AS quiet FROM audit)""", "audit",
)
def custom_gate(spark, sf):
    """A caller's own gate after the built-in one: a function from a frame to a frame, put in by ``transform``."""

    def quiet_hosts(audit):
        quiet = (F.col("llm_dispatched") == 1) & (F.col("source") == "host-logs")
        return audit.withColumns({
            "llm_dispatched": F.when(quiet, 0).otherwise(F.col("llm_dispatched")),
            "suppression_reason": F.when(quiet, "own_gate").otherwise(F.col("suppression_reason")),
        })

    return tb.gate_input(spark, sf).transform(gate.decide).transform(quiet_hosts)


@query(
    "replay_variants",
    """SELECT a.id, 'classes' AS variant, a.storm_status, a.llm_dispatched, a.suppression_reason FROM audit a
    UNION ALL SELECT a.id, 'older', a.storm_status, CAST(coalesce(s.send AND NOT k.collect_only, false) AS INTEGER),
      CASE WHEN k.exit_status IS NULL AND NOT k.collect_only THEN '' ELSE a.suppression_reason END
    FROM audit a JOIN keyed k ON k.id = a.id LEFT JOIN storm s ON s.id = a.id""",
    "audit", "keyed", "storm",
)
def replay_variants(spark, sf):
    """The gate with and without its class layer over the same events, from one layout."""
    rows = gate.replay(tb.gate_input(spark, sf), {"classes": gate.GateRules(), "older": gate.GateRules(class_layer=False)})
    return rows.select("id", "variant", "storm_status", "llm_dispatched", "suppression_reason")


@query(
    "emit_enriched_payload",
    """SELECT a.id, CAST(json_object('incident_id', l.incident_id, 'host', l.host, 'source', l.source, 'severity', l.severity, 'timestamp', l.timestamp,
      'extra', repeat('x', 600), 'message', substr(a.message, 1, 1200), 'storm_status', storm_status, 'storm_count', storm_count,
      'storm_window_seconds', storm_window_seconds, 'storm_fingerprint', substr(a.fingerprint, 1, 12)) AS VARCHAR) AS payload
    FROM audit a JOIN log l ON l.id = a.id WHERE llm_dispatched = 1""", "audit", "log",
)
def emit_enriched_payload(spark, sf):
    """The bodies have a field that the gate does not know, longer than any limit on known ones."""
    fields = ["incident_id", "host", "source", "severity", "message", "timestamp", F.repeat(F.lit("x"), 600).alias("extra")]
    bodies = tb.gate_input(spark, sf).select("id", F.to_json(F.struct(*fields)).alias("raw_body"))
    return gate.enriched_payload(tb.audit(spark, sf), bodies)


@query(
    "triage_class",
    "SELECT id, CASE effective_severity WHEN 'critical' THEN 'must_send' WHEN 'error' THEN 'candidate' ELSE 'silent' END AS triage FROM audit WHERE llm_dispatched = 1",
    "audit",
)
def triage_class(spark, sf):
    return tb.audit(spark, sf).filter("llm_dispatched = 1").select("id", triage(F.col("effective_severity")).alias("triage"))
