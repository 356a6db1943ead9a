"""The real-time gate: page now, or record only.

The gate is a chain of keyed, order-dependent rules.  Written as relations they are: runs of rows
(split at gaps), positions in a run, and leading-edge throttles with forced rows.  Each of these
is spread over time slices, so no key has to fit in one task.

Input rows: id (unique, arrival order), received_us, incident_id, host, source, severity,
message, timestamp.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.clock import SECOND
from emberlog.functions.keys import class_head, class_key, gate_fingerprint, short_key
from emberlog.functions.severity import false_error_info, grade
from emberlog.functions.source import stable_source
from emberlog.functions.text import cut as cut_text
from emberlog.operators.slices import Heat, Laid, lay_out, mark_gaps, run_positions, stored
from emberlog.operators.throttle import throttle
from emberlog.session import cut


@dataclass(frozen=True)
class GateRules:
    """Switches of the gate; the defaults reproduce the contract as it stands."""

    collapse_iso_t: bool = False   # also collapse 2024-01-02T03:04:05Z, which lower-casing hides
    class_layer: bool = True       # False: the older gate, without per-class cooldowns
    heat: Heat = Heat()            # rows of one key that a task holds


def normalise(events: DataFrame) -> DataFrame:
    """Apply the field limits and defaults to incoming rows; a null field counts as missing."""
    text = lambda name, n: cut_text(F.coalesce(F.col(name), F.lit("")), n).alias(name)
    return events.select(
        "id",
        "received_us",
        text("incident_id", V.MAX_INCIDENT_ID),
        text("host", V.MAX_HOST),
        text("source", V.MAX_SOURCE),
        cut_text(F.coalesce("severity", F.lit("unknown")), V.MAX_SEVERITY).alias("severity"),
        text("timestamp", V.MAX_EVENT_TIMESTAMP),
        text("message", V.MAX_STORED_MESSAGE),
    )


def graded_events(events: DataFrame) -> DataFrame:
    """Normalised rows with the severity verdict and the early exit, if any."""
    rows = grade(normalise(events))
    return rows.withColumn(
        "exit",
        F.when(F.col("downgraded"), V.BODY_LEVEL_EXIT).when(
            false_error_info(F.col("severity"), F.col("message")), V.COUNTER_EXIT
        ),
    )


def fingerprinted(events: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    rows = graded_events(events).withColumn("stable", stable_source(F.col("source")))
    return rows.withColumn(
        "fingerprint",
        gate_fingerprint(
            F.col("host"), F.col("stable"), F.col("effective"), F.col("message"), rules.collapse_iso_t
        ),
    )


AUDIT_INPUT = ["id", "received_us", "incident_id", "host", "source", "severity", "timestamp", "message"]

AUDIT_COLUMNS = [
    "id", "received_us", "incident_id", "host", "source", "severity", "event_timestamp", "message",
    "fingerprint", "storm_count", "storm_window_seconds", "storm_status", "llm_dispatched",
    "effective_severity", "suppression_reason",
]


NARROW = ["id", "us", "fingerprint", "class_key", "collect_only", "effective", "exit", "exit_reason"]


def judged_rows(events: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """Normalised events with what the gate needs of them: keys as 32 bytes, severity, and the early exit."""
    return classed(fingerprinted(events, rules), rules).select(
        *AUDIT_INPUT,
        F.col("received_us").alias("us"),
        F.unhex("fingerprint").alias("fingerprint"),
        F.unhex("class_key").alias("class_key"),
        *_graded(),
    )


def classed(rows: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """Graded rows with the key of their class, if the class layer is for them."""
    in_class_layer = (
        F.col("exit").isNull() & ~F.col("collect_only") & F.col("effective").isin(V.CLASS_LAYER_SEVERITIES)
    )
    return rows.withColumn(
        "head", F.when(in_class_layer, class_head(F.col("message"), rules.collapse_iso_t))
    ).withColumn(
        "class_key",
        F.when(
            F.col("head").isNotNull(),
            class_key(F.col("host"), F.col("stable"), F.col("effective"), F.col("message"), F.col("head")),
        ),
    )


def _graded() -> list:
    """What grading found, as the layers want it."""
    label = F.when(F.col("label") == "", "unknown").otherwise(F.col("label"))
    return [
        "collect_only",
        F.when(F.col("exit") == V.COUNTER_EXIT, "warning").otherwise(F.col("effective")).alias("effective"),
        "exit",
        F.when(
            F.col("exit") == V.BODY_LEVEL_EXIT,
            F.concat(F.lit("body_tag_"), F.col("body"), F.lit("_collector_"), label),
        )
        .when(F.col("exit").isNotNull(), V.COUNTER_REASON)
        .alias("exit_reason"),
    ]


def verdict_rows(events: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """What the gate needs of every event, without its text.

    Cut them before anything filters on these columns: the filter would be pushed below the
    projections and evaluate the regular expressions again.
    """
    return judged_rows(events, rules).select(NARROW)


def laid_out(verdicts: DataFrame, heat: Heat = Heat()) -> Laid:
    """Stored verdict rows without early exit: spread by fingerprint and time slice, with the gaps known."""
    rows = verdicts.filter(F.col("exit").isNull()).drop("exit", "exit_reason")
    return stored(mark_gaps(lay_out(rows, "fingerprint", heat), V.STORM_GAP_S * SECOND))


def early_exits(verdicts: DataFrame, *more: str) -> DataFrame:
    """Rows that touch no state: the line's own level or a zero counter says it is no fault."""
    return verdicts.filter(F.col("exit").isNotNull()).select(
        "id",
        *more,
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lit(1).cast("bigint").alias("storm_count"),
        F.col("exit").alias("storm_status"),
        F.lit(0).alias("llm_dispatched"),
        F.col("effective").alias("effective_severity"),
        F.col("exit_reason").alias("suppression_reason"),
    )


def storm_runs(marked: Laid) -> DataFrame:
    """Position of each row in its run of gaps up to 60 s, and the gap before it."""
    return run_positions(marked, V.STORM_GAP_S * SECOND)


def storm_gate(marked: Laid) -> DataFrame:
    """Fingerprint layer: storm_status, storm_count and whether the event would be sent.

    In a run, the fifth row is always sent and from there on the 120 s rule applies; the first
    four rows follow the 300 s rule.  Both measure from the last event sent, so the layer is one
    throttle whose cooldown depends on the position, with the fifth row of a run forced.
    """
    runs = storm_runs(marked).withColumnRenamed("position", "storm_count")
    in_storm = F.col("storm_count") >= V.STORM_THRESHOLD
    fresh = F.col("gap").isNull() | (F.col("gap") > V.STATE_RETENTION_S * SECOND)
    judged = throttle(
        marked.over(runs),
        F.when(in_storm, V.STORM_SUMMARY_S * SECOND).otherwise(V.REPEAT_SUMMARY_S * SECOND),
        forced=fresh | (F.col("storm_count") == V.STORM_THRESHOLD),
    )
    sent = F.col("accepted")
    return judged.withColumn(
        "storm_status",
        F.when(fresh, V.FIRST_SEEN)
        .when(in_storm, F.when(sent, V.STORM).otherwise(V.STORM_HELD))
        .when(sent, V.REPEAT)
        .otherwise(V.DUPLICATE),
    ).select(
        "id", "us", "fingerprint", "class_key", "collect_only", "effective", "storm_count",
        "storm_status", sent.alias("survives"), F.col("anchor_us").alias("sent_us"),
    )


def class_gate(rows: DataFrame, heat: Heat = Heat()) -> DataFrame:
    """Class layer over rows (id, us, class_key): what each event does to its class.

    Three throttles in a row: anchored windows of 300 s number the events; from the fifth of a
    window on, bursts at least 120 s apart are sent; the first four of a window are sent when
    3600 s have passed since the last page.  A burst counts as a page, so it is forced there.
    A class forgotten after 24 h needs no reset: every one of these waits is shorter.
    """
    forget = V.STATE_RETENTION_S * SECOND
    marked = stored(mark_gaps(lay_out(rows, "class_key", heat), forget))
    lives = run_positions(marked, forget).withColumnRenamed("position", "events_total")

    # a window holds 300 s inclusive, so the next one can start one microsecond later
    windows = stored(marked.over(
        throttle(marked.over(lives), V.CLASS_STORM_WINDOW_S * SECOND + 1)
        .withColumnRenamed("position", "events_window")
        .withColumnRenamed("anchor_us", "window_us")
    ))
    crowded = F.col("events_window") >= V.CLASS_STORM_N
    bursts = stored(marked.over(
        throttle(windows, V.CLASS_STORM_COOLDOWN_S * SECOND, inert=~crowded)
        .withColumnRenamed("accepted", "burst")
        .withColumnRenamed("anchor_us", "storm_us")
    ))
    pages = throttle(
        bursts,
        V.CLASS_COOLDOWN_S * SECOND,
        forced=F.col("burst"),
        inert=crowded & ~F.col("burst"),
    )
    note = (
        F.when(F.col("events_total") == 1, "class_new")
        .when(F.col("burst"), "class_storm_summary")
        .when(F.col("accepted"), "class_cooldown_expired")
        .otherwise("class_cooldown")
    )
    return pages.select(
        "id", "us", "class_key", note.alias("note"), F.col("accepted").alias("paged"),
        "window_us", "events_window", "events_total", F.col("anchor_us").alias("sent_us"), "storm_us",
    )


def gate_layers(marked: Laid, rules: GateRules = GateRules()) -> tuple[DataFrame, DataFrame | None]:
    """Verdicts of the fingerprint layer (cut) and of the class layer, both narrow."""
    storm = cut(storm_gate(marked))
    if not rules.class_layer:
        return storm, None
    reaching = storm.filter(
        F.col("survives") & ~F.col("collect_only") & F.col("class_key").isNotNull()
    )
    return storm, class_gate(reaching.select("id", "us", "class_key"), rules.heat)


def outcome() -> list:
    """llm_dispatched, effective_severity and suppression_reason of rows that passed both layers."""
    sent = F.col("survives") & ~F.col("collect_only") & F.coalesce("paged", F.lit(True))
    note = F.concat("note", F.lit(":"), short_key(F.lower(F.hex("class_key"))))
    reason = F.when(F.col("collect_only"), V.COLLECTED_REASON).when(F.col("note").isNotNull(), note).otherwise("")
    return [
        sent.cast("int").alias("llm_dispatched"), F.col("effective").alias("effective_severity"), reason.alias("suppression_reason"),
    ]


def decide(events: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """One audit row per event, dispatched or not.

    The verdicts stay narrow all the way; the text of an event is shuffled once, to meet them.
    """
    verdicts = cut(verdict_rows(events, rules))
    storm, classes = gate_layers(laid_out(verdicts, rules.heat), rules)
    if classes is None:
        layered = storm.withColumn("note", F.lit(None).cast("string")).withColumn("paged", F.lit(True))
    else:
        layered = storm.join(classes.select("id", "note", "paged"), "id", "left")
    stateful = layered.select(
        "id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "storm_count", "storm_status", *outcome()
    )
    return (
        normalise(events)
        .join(stateful.unionByName(early_exits(verdicts)), "id")
        .withColumnRenamed("timestamp", "event_timestamp")
        .withColumn("storm_window_seconds", F.lit(V.STORM_GAP_S))
        .select(AUDIT_COLUMNS)
    )


def replay(events: DataFrame, variants: dict[str, GateRules], heat: Heat = Heat()) -> DataFrame:
    """The same events under several sets of rules, in one pass: one row (variant, id, fingerprint, storm_count, storm_status,
    llm_dispatched, effective_severity, suppression_reason) per event and variant.

    Every event is read and graded once and becomes one narrow row per variant, whose keys begin with the variant's
    number; so all variants share one layout, one shuffle and one run of each layer.
    """
    names = list(variants)
    rows = graded_events(events).withColumn("stable", stable_source(F.col("source")))
    keys = []
    for number, rules in enumerate(variants.values()):
        print_of = gate_fingerprint(F.col("host"), F.col("stable"), F.col("effective"), F.col("message"), rules.collapse_iso_t)
        rows = classed(rows, rules).drop("head").withColumnRenamed("class_key", f"__class{number}").withColumn(f"__print{number}", print_of)
        mark = F.lit(bytearray([number]))
        coarse = F.concat(mark, F.unhex(f"__class{number}")) if rules.class_layer else F.lit(None).cast("binary")
        keys.append(F.struct(F.concat(mark, F.unhex(f"__print{number}")).alias("fingerprint"), coarse.alias("class_key")))
    graded = rows.select("id", F.col("received_us").alias("us"), F.explode(F.array(*keys)).alias("key"), *_graded())
    verdicts = cut(graded.select("id", "us", "key.fingerprint", "key.class_key", "collect_only", "effective", "exit", "exit_reason"))
    storm, classes = gate_layers(laid_out(verdicts, heat), GateRules(heat=heat))
    number = lambda key: F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("int").alias("variant")
    bare = lambda key: F.substring(key, 2, 32).alias(key)
    layered = storm.select("*", number("fingerprint")).join(classes.select("id", number("class_key"), "note", "paged"), ["id", "variant"], "left")
    layered = layered.withColumns({"fingerprint": bare("fingerprint"), "class_key": bare("class_key")})
    stateful = layered.select("id", "variant", F.lower(F.hex("fingerprint")).alias("fingerprint"), "storm_count", "storm_status", *outcome())
    early = verdicts.withColumn("variant", number("fingerprint")).withColumn("fingerprint", bare("fingerprint"))
    both = stateful.unionByName(early_exits(early, "variant"))
    return both.withColumn("variant", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("variant") + 1))


def _sample(events: DataFrame, state: DataFrame) -> DataFrame:
    """The forwarded part of each state's sample message: only these events are read for their text."""
    text = events.select(F.col("id").alias("sample_id"), cut_text(F.col("message"), V.MAX_FORWARDED_MESSAGE).alias("sample_message"))
    return state.join(text, "sample_id").drop("sample_id")


def storm_state(events: DataFrame, storm: DataFrame, now_us: int) -> DataFrame:
    """Latest state per fingerprint seen in the 24 h before ``now_us``."""
    opened = F.col("storm_count") == 1
    order = F.struct("us", "id")
    latest = storm.groupBy("fingerprint").agg(
        F.max("us").alias("last_seen_us"),
        F.max(F.when(opened, F.col("us"))).alias("window_started_us"),
        F.max_by("storm_count", order).alias("events_in_window"),
        F.max_by("sent_us", order).alias("last_agent_sent_us"),
        F.max_by("id", F.when(opened, order)).alias("sample_id"),
    )
    recent = latest.filter(F.col("last_seen_us") >= now_us - V.STATE_RETENTION_S * SECOND)
    return _sample(events, recent).select(
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        "window_started_us",
        "last_seen_us",
        "events_in_window",
        "last_agent_sent_us",
        F.when(F.col("events_in_window") >= V.STORM_THRESHOLD, F.col("last_agent_sent_us")).alias(
            "last_storm_sent_us"
        ),
        "sample_message",
    )


def class_state(events: DataFrame, classes: DataFrame, now_us: int) -> DataFrame:
    """Latest state per class seen in the 24 h before ``now_us``."""
    order = F.struct("us", "id")
    latest = classes.groupBy("class_key").agg(
        F.max("us").alias("last_seen_us"),
        F.max(F.when(F.col("events_total") == 1, F.col("us"))).alias("born_us"),
        *[F.max_by(c, order).alias(c) for c in ("window_us", "events_window", "events_total", "sent_us", "storm_us")],
        F.max_by("id", order).alias("sample_id"),
    )
    recent = latest.filter(F.col("last_seen_us") >= now_us - V.STATE_RETENTION_S * SECOND)
    return _sample(events, recent).select(
        F.lower(F.hex("class_key")).alias("class_key"),
        F.col("window_us").alias("window_started_us"),
        "last_seen_us",
        "events_window",
        "events_total",
        F.col("sent_us").alias("last_agent_sent_us"),
        F.when(F.col("storm_us") >= F.col("born_us"), F.col("storm_us")).alias("last_storm_sent_us"),
        "sample_message",
    )


def enriched_payload(audit: DataFrame, bodies: DataFrame) -> DataFrame:
    """JSON handed on for every dispatched event: its original body (``bodies``: id, raw_body) with five fields overwritten.

    The message is cut to what is forwarded; all other fields, known or not, pass as they came, whole.  Only
    dispatched bodies are parsed.
    """
    sent = audit.filter(F.col("llm_dispatched") == 1)
    ours = {
        "message": cut_text(F.col("message"), V.MAX_FORWARDED_MESSAGE), "storm_status": F.col("storm_status"),
        "storm_count": F.col("storm_count"), "storm_window_seconds": F.col("storm_window_seconds"),
        "storm_fingerprint": short_key(F.col("fingerprint")),
    }
    known = F.create_map(*[x for name, c in ours.items() for x in (F.lit(name), c.cast("variant"))])
    body = F.from_json("raw_body", "map<string, variant>")
    others = F.map_filter(body, lambda name, _: ~name.isin(list(ours)))
    return sent.join(bodies.select("id", "raw_body"), "id").select(
        "id", F.to_json(F.map_concat(others, known)).alias("payload")
    )
