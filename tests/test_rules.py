"""Literal rows for every rule, expected values worked out by hand from the contract."""

import pytest
from pyspark.sql import functions as F

from emberlog.functions import clock, keys, severity, signing, source, text
from emberlog.operators import gate, gateway, inbox
from tests.events import SECOND, START, gate_rows


def one(spark, expr, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(expr).first()[0]


SEVERITY_CASES = [
    ("error", "[INFO] started", "info", "body_level_suppressed"),
    ("error", "[INFO] call failed", "error", None),
    ("error", "[WARN] slow", "warning", "body_level_suppressed"),
    ("warning", "[ERROR] broken", "error", None),
    ("error", "12:00:01 FATAL gone", "critical", None),
    ("unknown", "[WARN] slow", "unknown", None),
    ("unknown", "[INFO] ok", "info", "body_level_suppressed"),
    ("critical", "[ERROR] broken", "critical", None),
    (None, "plain", "unknown", None),
    ("", "plain", "unknown", None),
    ("error", "[ INFO ] done errors=0", "error", "info_counter_suppressed"),
    ("error", "[INFO] fail", "info", "body_level_suppressed"),
    ("error", "x" * 210 + " [INFO]", "error", None),
    (" ERROR ", "plain", "error", None),
]


def test_severity(spark):
    rows = gate_rows(spark, [(0, label, message) for label, message, *_ in SEVERITY_CASES])
    got = gate.graded_events(rows).orderBy("id").collect()
    assert [(r.effective, r.exit) for r in got] == [(e, x) for *_, e, x in SEVERITY_CASES]
    audit = gate.decide(rows).orderBy("id").collect()
    assert audit[10].effective_severity == "warning"
    assert audit[10].suppression_reason == "collector_error_label_with_zero_counter"
    assert audit[2].suppression_reason == "body_tag_warning_collector_error"


F1, DUP, REP, STORM, HELD = (
    "first_seen", "duplicate_suppressed", "repeat_summary", "storm_summary", "storm_suppressed")

FINGERPRINT_CASES = [
    ([0, 60, 120, 180, 240], [F1, DUP, DUP, DUP, STORM]),
    ([0, 61], [F1, DUP]),
    ([0, 299], [F1, DUP]),
    ([0, 300], [F1, REP]),
    ([0, 1, 2, 3, 4, 5, 63, 123, 124], [F1, DUP, DUP, DUP, STORM, HELD, HELD, HELD, STORM]),
    ([0, 86400], [F1, REP]),
    ([0, 86400.000001], [F1, F1]),
    ([0, 86401], [F1, F1]),
]

NEW, COOL, BURST, EXPIRED = "class_new", "class_cooldown", "class_storm_summary", "class_cooldown_expired"

CLASS_CASES = [
    ([0, 10, 20, 30, 40, 50], [NEW, COOL, COOL, COOL, BURST, COOL]),
    ([0, 3600], [NEW, EXPIRED]),
    ([0, 3599], [NEW, COOL]),
    ([0, 300, 301], [NEW, COOL, COOL]),
    ([0, 1, 2, 300, 300.5], [NEW, COOL, COOL, COOL, COOL]),      # a window ends after 300 s, inclusive
    ([0, 1, 2, 3, 300], [NEW, COOL, COOL, COOL, BURST]),
    ([0, 10, 20, 30, 40, 50, 159, 160], [NEW, COOL, COOL, COOL, BURST, COOL, COOL, BURST]),
    ([0, 86400], [NEW, EXPIRED]),
    ([0, 86400.000001], [NEW, NEW]),
]


def by_source(rows):
    out = {}
    for row in sorted(rows, key=lambda r: r.id):
        out.setdefault(row.source, []).append(row)
    return out


def test_fingerprint_layer(spark):
    rows = [(t, "error", "broken", f"case {n}") for n, (times, _) in enumerate(FINGERPRINT_CASES) for t in times]
    got = by_source(gate.decide(gate_rows(spark, rows)).collect())
    for n, (_, expected) in enumerate(FINGERPRINT_CASES):
        assert [r.storm_status for r in got[f"case {n}"]] == expected


def test_class_layer(spark):
    # the last word differs, so every row is a new fingerprint of one class
    rows = [
        (t, "error", f"same four words here {chr(97 + i)}", f"case {n}")
        for n, (times, _) in enumerate(CLASS_CASES) for i, t in enumerate(times)
    ]
    got = by_source(gate.decide(gate_rows(spark, rows)).collect())
    for n, (times, expected) in enumerate(CLASS_CASES):
        case = got[f"case {n}"]
        assert [r.suppression_reason.split(":")[0] for r in case] == expected
        assert [r.storm_status for r in case] == [F1] * len(times)
        assert [r.llm_dispatched for r in case] == [int(e != COOL) for e in expected]


def test_critical_has_no_class_layer(spark):
    rows = [(i, "critical", f"same four words here {chr(97 + i)}") for i in range(4)]
    got = gate.decide(gate_rows(spark, rows)).collect()
    assert all(r.llm_dispatched == 1 and r.suppression_reason == "" for r in got)


def test_last_sent_moves_even_when_a_later_step_silences(spark):
    """The class cooldown silences the repeat at 300, yet the next repeat is due at 600."""
    rows = gate.decide(gate_rows(spark, [(t, "error", "broken") for t in (0, 300, 599, 600)])).orderBy("id").collect()
    assert [r.storm_status for r in rows] == [F1, REP, DUP, REP]
    assert [r.suppression_reason.split(":")[0] for r in rows] == [NEW, COOL, "", COOL]
    assert [r.llm_dispatched for r in rows] == [1, 0, 0, 0]


def test_rotated_file_keeps_its_class(spark):
    src = "project=P; program=Sync15m; log_file=/logs/Sync15m/a_{}.log; dll=unknown"
    got = gate.decide(
        gate_rows(spark, [(0, "error", "broken", src.format(20240101)), (30, "error", "broken", src.format(20240102))])
    ).orderBy("id").collect()
    assert got[0].fingerprint == got[1].fingerprint and got[1].storm_status == DUP


def test_iso_timestamps_and_the_switch(spark):
    rows = gate_rows(spark, [(0, "error", "2024-01-02T03:04:05Z broken"), (1, "error", "2024-01-02T03:04:06Z broken")])
    assert [r.storm_status for r in gate.decide(rows).orderBy("id").collect()] == [F1, F1]
    fixed = gate.decide(rows, gate.GateRules(collapse_iso_t=True)).orderBy("id").collect()
    assert [r.storm_status for r in fixed] == [F1, DUP]


def test_properties_of_the_gate(spark, sf):
    from emberlog.plans import testbed as tb

    events = tb.gate_input(spark, sf)
    audit = tb.audit(spark, sf)
    assert audit.count() == events.count()
    assert audit.select("id").distinct().count() == events.count()
    first = audit.filter("storm_status = 'first_seen' AND suppression_reason LIKE 'class_new:%'")
    assert first.filter("llm_dispatched = 0").isEmpty()
    critical = audit.filter("effective_severity = 'critical' AND storm_status IN ('first_seen', 'repeat_summary', 'storm_summary')")
    assert critical.filter("llm_dispatched = 0").isEmpty()
    assert audit.filter("effective_severity IN ('warning', 'info') AND llm_dispatched = 1").isEmpty()


def test_gateway_throttle(spark):
    rows = [
        (0, 0, "a", "error"), (1, 899, "a", "error"), (2, 900, "a", "error"), (3, 1799, "a", "error"),
        (4, 0, "b", "warning"), (5, 1799, "b", "warning"), (6, 1800, "b", "warning"),
        (7, 0, "c", "critical"), (8, 0, "c", "critical"), (9, 1, "c", "critical"),
    ]
    df = spark.createDataFrame(rows, "id long, s long, fp string, severity string").select(
        "id", (F.col("s") * SECOND + START).alias("us"), F.sha2("fp", 256).alias("h"), "severity"
    ).select("id", "us", F.unhex("h").alias("fingerprint"), "severity", F.lit(True).alias("ok"), F.lit(True).alias("enabled"))
    got = {r.id: (r.accepted, r.accepted_id) for r in gateway.gateway_throttle(df).collect()}
    assert got == {
        0: (True, 0), 1: (False, 0), 2: (True, 2), 3: (False, 2), 4: (True, 4), 5: (False, 4), 6: (True, 6),
        7: (True, 7), 8: (True, 8), 9: (True, 9),
    }


def test_envelopes(spark):
    bodies = [
        '{"source": " /logs/A/x.log ", "message": " hi\\u00a0"}', "plain text", "[1, 2]", '"text"', "null",
        '{"message": 5}', '{"source": "s"}', '{"message": ""}', "  ", "x" * 65_537,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, raw string")
    got = {r.id: r for r in gateway.parse_envelope(df).withColumn("ok", gateway.acceptable(F.col("raw"), F.col("message"))).collect()}
    assert (got[0].source, got[0].message) == ("/logs/A/x.log", "hi")
    assert [got[i].message for i in (1, 2, 3, 5)] == ["plain text", "[1, 2]", '"text"', '{"message": 5}']
    assert [got[i].ok for i in range(10)] == [True, True, True, True, False, True, False, False, False, False]


def test_routers(spark):
    lines = ["a FATAL b", "Panic!", "outofmemory", "Out Of Memory", "error KnownBenignError", "Exception error",
             "WARNING knownbenignwarning", "nothing", "warn"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(lines)], "id long, message string")
    got = {r.id: r.routers for r in gateway.route(df).collect()}
    assert got == {0: ["fatal"], 1: ["panic"], 2: ["out-of-memory"], 3: ["out-of-memory-spaced"],
                   5: ["error", "exception"], 8: ["warning"]}
    assert gateway.fan_out(gateway.route(df)).count() == 7


@pytest.mark.parametrize(
    "path, program",
    [
        ("/logs/A/x.log", "A"), ("/logs/x.log", "unknown"), ("/logs/a/../B/x.log", "B"), ("/logs//C/./x.log", "C"),
        ("logs/A/x.log", "unknown"), ("/var/log/x", "unknown"), ("/logs/a/../b.log", "unknown"), ("", "unknown"),
        ("/../logs/A/b/c.log", "A"), ("/logs/A/..", "unknown"), ("/logs/..A/x", "..A"),
    ],
)
def test_program(spark, path, program):
    assert one(spark, source.program_from_source(F.col("p")), p=path) == program


def test_allowlist_takes_the_least_project(spark):
    events = spark.createDataFrame([(1, "/logs/A/x.log", "m"), (2, "/logs/Z/x.log", "m")], "id long, source string, message string")
    allow = spark.createDataFrame([("P2", "A", True), ("P1", "A", False)], "project string, program string, enabled boolean")
    got = {r.id: (r.project, r.enabled) for r in gateway.with_context(events, allow).collect()}
    assert got == {1: ("P1", False), 2: ("", False)}


def test_many_log_file_segments(spark):
    given = "log_file=a_20240101; x=20240102; log_file=b12345.log;log_file=c-2024-01-02-99999"
    assert one(spark, source.stable_source(F.col("s")), s=given) == (
        "log_file=a_<date>; x=20240102; log_file=b12345.log;log_file=c-<date>-<n>")


@pytest.mark.parametrize(
    "given, expected",
    [
        ("token=abc; x", "token=<redacted>; x"),
        ("Authorization: Bearer abcdefghijkl", "Authorization=<redacted> abcdefghijkl"),
        ("bearer abcdefgh.1", "Bearer <redacted>"),
        ("see postgres://u:pw@host/db", "see postgres://u:<redacted>@host/db"),
        ("k " + "A" * 40, "k <redacted-long>"),
        ("api_key=1 session-id : zz", "api_key=<redacted> session-id=<redacted>"),
    ],
)
def test_redact(spark, given, expected):
    assert one(spark, text.redact(F.col("m")), m=given) == expected


def test_unicode_text(spark):
    assert one(spark, text.collapse_spaces(F.col("m")), m="a  b\x1cc") == "a b c"
    assert one(spark, keys.gate_message(F.col("m")), m="编号 １２３４ failed") == "编号 <n> failed"
    assert one(spark, severity.fault_word(F.col("m")), m="éfailed") is False
    assert one(spark, keys.class_head(F.col("m")), m="连接 数据库 [X] é 失败 再试") == "连接 数据库 失败 再试"


@pytest.mark.parametrize(
    "message, head, component",
    [
        ("[2024-01-02 03:04:05] [ERROR] [Acme.Core] boom", "h", "acme.core"),
        ("[ERROR] [LongerThanTwelve] boom", "h", "longerthantwelve"),
        ("[WARNING] [Short] boom", "the head", "the head"),
        ("[a.b] x", "h", "h"),
        ("[a.bc] x", "h", "a.bc"),
    ],
)
def test_class_component(spark, message, head, component):
    assert one(spark, source.class_component(F.col("m"), F.col("h")), m=message, h=head) == component


def test_byte_cut(spark):
    assert one(spark, text.cut_bytes(F.col("m"), 4096), m="é" * 2048) == "é" * 2048
    got = one(spark, text.cut_bytes(F.col("m"), 4096), m="a" + "é" * 2048)
    assert got.startswith("a" + "é" * 2047) and len(got) == 2049


def test_signing_equals_the_standard_library(spark):
    import base64
    import hashlib
    import hmac

    for secret in (b"k", b"s" * 64, b"long" * 30):
        body = '{"m": "größe 中"}'
        want = "v1," + base64.b64encode(hmac.new(secret, f"id.17.{body}".encode(), hashlib.sha256).digest()).decode()
        df = spark.createDataFrame([("id", 17, body)], "i string, t long, b string")
        assert df.select(signing.signature(secret, F.col("i"), F.col("t"), F.col("b"))).first()[0] == want


def test_receiver_checks(spark):
    body = '{"incident_id": "a", "host": "h", "source": "s", "severity": null, "message": "m", "timestamp": "t"}'
    now = 1000
    rows = [("a", now, body, "ok"), ("b", now - 300, body, "ok"), ("c", now - 301, body, "ok"), ("d", now, body, "bad"),
            ("e", now, body, None), ("a", now, body, "ok"), ("f", now, "[1]", "ok"), ("g", now, "nope", "ok"), (None, now, body, "ok")]
    df = spark.createDataFrame([(i, now * SECOND + i, *r) for i, r in enumerate(rows)],
                               "seq long, received_us long, svix_id string, svix_timestamp long, raw_body string, kind string")
    sign = lambda s: signing.signature(s, F.col("svix_id"), F.col("svix_timestamp"), F.col("raw_body"))
    df = df.withColumn("svix_signature", F.when(F.col("kind") == "ok", sign(b"k")).when(F.col("kind") == "bad", sign(b"x")))
    got = {r.seq: r for r in inbox.verify(df, b"k").collect()}
    assert [got[i].signature_ok for i in range(9)] == [True, True, True, False, False, True, True, True, False]
    assert [got[i].fresh_ok for i in (0, 1, 2)] == [True, True, False]
    assert [got[i].payload_ok for i in (0, 6, 7)] == [True, False, False]
    assert [r.seq for r in inbox.first_deliveries(df.filter("svix_id = 'a'")).collect()] == [0]
    assert inbox.payload(df.filter("seq = 0")).first().severity is None


def test_times(spark):
    us = START + 86_399_999_999
    df = spark.createDataFrame([(us,)], "us long")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            row = df.select(
                clock.rfc3339(F.col("us")), clock.local_label(F.col("us"), "Pacific/Auckland"),
                clock.hour_label(F.col("us")), clock.utc_date(F.col("us")).cast("string"),
            ).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert tuple(row) == ("2024-01-01T23:59:59Z", "01-02 12:59 NZ", "01-01 23:00", "2024-01-01")


def test_unknown_body_fields_are_passed_on(spark):
    import json

    audit = gate.decide(gate_rows(spark, [(0, "error", "broken " + "x" * 2000)]))
    body = '{"incident_id": "old", "message": "m", "extra": {"a": [1, true]}, "n": 5}'
    bodies = spark.createDataFrame([(0, body)], "id long, raw_body string")
    got = json.loads(gate.enriched_payload(audit, bodies).first().payload)
    assert got["extra"] == {"a": [1, True]} and got["n"] == 5 and got["incident_id"] == "old"
    assert len(got["message"]) == 1200 and got["storm_count"] == 1 and "host" not in got
    long = '{"source": "' + "s" * 600 + '", "host": "' + "h" * 250 + '", "message": "m"}'
    got = json.loads(gate.enriched_payload(audit, spark.createDataFrame([(0, long)], "id long, raw_body string")).first().payload)
    assert len(got["source"]) == 600 and len(got["host"]) == 250


@pytest.mark.parametrize(
    "raw, source_, message",
    [
        ('{"Source": "/logs/A/x.log", "MESSAGE": "m"}', "/logs/A/x.log", "m"),
        ('{"message": "a", "message": "b", "source": "s"}', "s", "b"),
        ('{"source": "/logs/A/x.log", "message": 5}', "/logs/A/x.log", '{"source": "/logs/A/x.log", "message": 5}'),
        ('{"source": 5, "message": "m"}', "", '{"source": 5, "message": "m"}'),
        ('{"source": null, "message": "m"}', "", "m"),
        ('{"message": "m"} x', "", '{"message": "m"} x'),
        ('[1]', "", "[1]"),
        ("null", "", ""),
        ("plain", "", "plain"),
    ],
)
def test_envelope_edges(spark, raw, source_, message):
    row = gateway.parse_envelope(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (row.source, row.message) == (source_, message)


@pytest.mark.parametrize("body, expected", [
    ('{"a":1,"a":2}', True), ("[1]", False), ('{"a":1} x', False), ('{"a":1,"a":2} {"b":1}', False), ("", False), ('{"a":{"x":1,"x":2}}', True), ("{", False),
])
def test_json_objects(spark, body, expected):
    assert one(spark, inbox.is_object(F.col("b")), b=body) is expected


def test_library_is_looked_for_in_the_stored_message(spark):
    allow = spark.createDataFrame([("P", "A", True)], "project string, program string, enabled boolean")
    raw = spark.createDataFrame([(0, START, "x" * 5000 + " in Acme.Core.dll"), (1, START, "in Acme.Core.dll")], "id long, received_us long, raw string")
    got = {r.id: r.dll for r in gateway.receive(raw, allow).collect()}
    assert got[0] == "" and got[1] != ""


def test_closed_events_are_not_offered_again(spark):
    events = spark.createDataFrame([(i, i) for i in range(4)], "id long, created_us long")
    tries = spark.createDataFrame([(0, 1, 5, True, None), (1, 1, 6, False, "e")], "id long, seq long, attempt_us long, ok boolean, error string")
    closed = spark.createDataFrame([(0, 9, "off"), (1, 9, "off"), (2, 9, "off")], "id long, closed_us long, reason string")
    ledger = gateway.delivery_ledger(events, tries, closed)
    assert {r.id: (r.delivered_us, r.last_error) for r in ledger.collect()} == {0: (5, None), 1: (9, "off"), 2: (9, "off"), 3: (None, None)}
    assert [r.id for r in gateway.pending(ledger).collect()] == [3]


def test_exclusive_bound(spark):
    from emberlog.operators import audit as A

    rows = spark.createDataFrame([(1, START), (2, START + 1)], "id long, received_us long")
    assert A.since(rows, START).count() == 2
    assert A.since(rows, START, exclusive=True).count() == 1


@pytest.mark.parametrize("body, want", [
    ('{"a":1}', True), (' {"a":{"b":[1]}} \n', True), ('{"a":1,"a":2}', True), ("{}", True), ('{"a":1}}', False), ('{"a":1} } {}', False), ('{"a":1}] [{}', False),
    ('{"a":1},{"b":2}', False), ('{"a":1} {}', False), ('{"a":1}],"y":[{}', False), ('{"a":1},"y":{}', False), ("[1,2]", False), ("not json", False), ("", False), (None, False), ('{"a":"}}"}', True)])
def test_one_json_object(spark, body, want):
    from emberlog.functions.text import is_json_object

    assert spark.createDataFrame([(body,)], "b string").select(is_json_object(F.col("b"))).first()[0] is want


def test_replay_of_several_rule_sets(spark):
    """One pass over all variants gives what each gives alone, times with a T collapsed or not, hot keys split or not."""
    from emberlog.operators.slices import Heat

    says = ["at 2024-01-02T03:04:05Z broken", "at 2024-01-02T03:04:06Z broken", "[INFO] started", "broken"]
    rows = gate_rows(spark, [(t * 37 % 4000, ("error", "warning")[t % 3 == 0], says[t * 7 % 4]) for t in range(60)])
    rules = {"now": gate.GateRules(), "older": gate.GateRules(class_layer=False), "iso": gate.GateRules(collapse_iso_t=True)}
    columns = ["id", "fingerprint", "storm_count", "storm_status", "llm_dispatched", "effective_severity", "suppression_reason"]
    for heat in (Heat(), Heat(5)):
        got = gate.replay(rows, rules, heat)
        for name, one in rules.items():
            assert sorted(got.filter(F.col("variant") == name).select(columns).collect()) == sorted(gate.decide(rows, one).select(columns).collect())
