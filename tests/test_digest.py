"""Digest, review, stores and marks."""

import os

import pytest
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.operators import audit as A
from emberlog.operators import digest, gate, partials, review
from emberlog.session import work_path
from emberlog.sources import audit_store, files, partial_store
from tests.events import SECOND, START

SCHEMA = (
    "id long, received_us long, incident_id string, host string, source string, severity string, event_timestamp string, "
    "message string, fingerprint string, storm_count long, storm_window_seconds int, storm_status string, "
    "llm_dispatched int, effective_severity string, suppression_reason string"
)
SOURCE = "project=P; program={}; log_file=/logs/x/a_2024010{}.log; dll=unknown"


def audit_rows(spark, rows):
    """rows: (seconds, source, severity, message)."""
    return spark.createDataFrame(
        [(i, START + int(t * SECOND), f"e{i}", "h", src, sev, "t", msg, "f", 1, 60, "first_seen", 0, sev, "")
         for i, (t, src, sev, msg) in enumerate(rows)], SCHEMA)


def test_clusters_rank_and_rotation(spark):
    rows = [(10, SOURCE.format("B", 1), "warning", "slow 5 ms"), (11, SOURCE.format("A", 1), "warning", "\nslow 7 ms token=abc"),
            (12, SOURCE.format("A", 2), "warning", "slow 8 ms token=abc"), (13, SOURCE.format("B", 2), "warning", "slow 77 ms"),
            (14, "bare", "info", "[Acme.Core] x"), (15, "bare", "error", "[Acme.Core] x")]
    ranked = digest.top_clusters(audit_rows(spark, rows))[1].orderBy("rank").collect()
    assert [(r.rank, r.n, r.program) for r in ranked] == [(1, 2, "B"), (2, 2, "A"), (3, 1, "")]
    assert ranked[1].sample == "slow 7 ms token=<redacted>"
    assert ranked[2].raw_source == "bare"
    lines = digest.blocks(digest.top_clusters(audit_rows(spark, rows))[1]).orderBy("rank").collect()
    assert lines[2].header == "[3] 1 条 | 程序=Acme.Core | host=h | 来源=bare | 01-01 13:00 NZ → 01-01 13:00 NZ"
    assert lines[0].header.startswith("[1] 2 条 | 程序=B | 项目=P | 文件=/logs/x/a_20240101.log | host=h | ")


def test_budget_and_limit(spark):
    rows = [(i, "bare", "warning", "w" * 150 + " " + "q" * (i + 1)) for i in range(26) for _ in range(2)]
    audit = audit_rows(spark, rows)
    clustered = digest.clusters(audit)
    assert digest.totals(clustered).first().asDict() == {"warnings": 52, "clusters": 26}
    assert digest.blocks(digest.ranked(clustered), budget=10**9).count() == 20
    listed = digest.blocks(digest.ranked(clustered), budget=1500).collect()
    costs = [len(r.header) + len(r.sample_line) + len(r.template_line) + 3 for r in listed]
    assert sum(costs) <= 1500 < sum(costs) + max(costs)
    text = [r.text for r in digest.report(audit, START, START + 100 * SECOND).orderBy("line_no").collect()]
    assert text[-1] == V.D_UNLISTED.replace("{rest}", "6").replace("{listed}", "20")


def test_empty_window_is_silent_unless_a_failure_is_known(spark):
    none = audit_rows(spark, [(0, "s", "error", "m")])
    crumbs = files.parse_breadcrumbs(
        spark.createDataFrame([(1, f"{START // SECOND}\topen\tError: x"), (2, "nonsense"), (3, "12\topen"), (4, "1.2.3\ta\tb")], "seq long, value string"))
    quiet = digest.failures_since(crumbs, START + SECOND)
    loud = digest.failures_since(crumbs, START)
    totals = digest.totals(digest.clusters(none))
    assert digest.is_silent(totals, quiet).first().silent is True
    assert digest.is_silent(totals, loud).first().asDict() == {"warnings": 0, "failures": 1, "silent": False}
    text = [r.text for r in digest.report(none, START, START + SECOND, breadcrumbs=crumbs).orderBy("line_no").collect()]
    assert V.D_WATCHDOG_HEAD in text and V.D_WATCHDOG_MARK + "guard open during Error: x" in text
    assert review.breadcrumb_summary(crumbs, 0).first().asDict() == {"failures": 2, "last": f"{START // SECOND}\topen\tError: x"}


def test_mark_moves_once_and_stays_when_unreadable(spark):
    audit_path, mark_path, out = (work_path(spark, n) for n in ("a", "m", "o"))
    now = START + 1000 * SECOND
    assert audit_store.read_mark(spark, mark_path, now) == now - 86_400 * SECOND
    assert audit_store.run_digest(spark, audit_path, mark_path, now, out) is False
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines[1] == "WATCHDOG=STATE_DB_UNREADABLE" and lines[-1] == "WARNINGS=0"
    assert audit_store.read_mark(spark, mark_path, now) == now - 86_400 * SECOND
    audit_store.write_audit(audit_rows(spark, [(990, "s", "warning", "m"), (5, "s", "warning", "m")]), audit_path)
    assert audit_store.run_digest(spark, audit_path, mark_path, now, out) is True
    assert audit_store.read_mark(spark, mark_path, now) == START + 990 * SECOND
    assert any("WARNINGS=2" in r.value for r in spark.read.text(out).collect())
    assert audit_store.run_digest(spark, audit_path, mark_path, now, out) is True
    # the bound is inclusive, so only the newest row is seen again
    assert any("WARNINGS=1" in r.value for r in spark.read.text(out).collect())


def test_window_prunes_whole_days(spark):
    path = work_path(spark, "days")
    audit_store.write_audit(audit_rows(spark, [(d * 86_400 + 5, "s", "warning", "m") for d in range(5)]), path)
    recent = A.since(spark.read.parquet(path), START + 3 * 86_400 * SECOND)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(received_date" in plan and recent.count() == 2


def test_older_files_get_defaults(spark):
    path = work_path(spark, "old")
    rows = audit_rows(spark, [(0, "s", "Warning", "m")])
    audit_store.write_audit(rows.drop("effective_severity", "suppression_reason"), path)
    row = audit_store.read_audit(spark, path).first()
    assert (row.effective_severity, row.suppression_reason) == ("unknown", "")
    assert A.severity_tally(audit_store.read_audit(spark, path)).first().severity == "warning"


def test_repeated_batch_is_not_doubled(spark):
    path = work_path(spark, "batches")
    rows = audit_rows(spark, [(0, "s", "warning", "m")])
    for batch in (0, 1, 1):
        audit_store.write_batch(rows, batch, path)
    assert audit_store.read_audit(spark, path).count() == 2


def test_usage_cost_without_calls(spark):
    sessions = spark.createDataFrame([("cli", "1", 1, 1, 1), ("webhook", "n/a", 1, 1, 1)],
                                     "source string, started_at string, input_tokens long, output_tokens long, cache_read_tokens long")
    row = A.usage_cost(sessions, 0).first()
    assert (row.calls, row.cost, row.cost_per_call) == (0, 0.0, None)


def test_allowlist_file(spark, tmp_path):
    good, empty = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text('{\n "projects": {"P": {"programs": {"A": true, "B": false}}}\n}')
    empty.write_text('{"projects": {}}')
    assert {tuple(r) for r in files.load_allowlist(spark, str(good)).collect()} == {("P", "A", True), ("P", "B", False)}
    with pytest.raises(ValueError):
        files.load_allowlist(spark, str(empty))


def test_scan_log_files(spark, tmp_path):
    for name, text in (("A/x.log", "one\ntwo\n"), ("A/deep/y.log", "three\n"), ("A/z.txt", "no\n")):
        target = tmp_path / name
        os.makedirs(target.parent, exist_ok=True)
        target.write_text(text)
    rows = files.scan_log_files(spark, str(tmp_path)).collect()
    assert sorted(r.value for r in rows) == ["one", "three", "two"]
    assert {os.path.basename(r.path) for r in rows} == {"x.log", "y.log"}


def test_quarantine_lines(spark):
    df = spark.createDataFrame([(START, "bad\nbody " + "x" * 500)], "received_us long, raw_body string")
    row = audit_store.quarantine(df, "payload", F.col("raw_body")).first()
    assert row.body == "bad\nbody " + "x" * 500
    at, stage, text = row.value.split("\t")
    assert (at, stage, len(text)) == (str(START // SECOND), "payload", 400) and text.startswith("bad body x")


def test_class_layer_off_pages_every_survivor(spark):
    from tests.events import gate_rows

    rows = gate_rows(spark, [(i, "error", f"same four words here {chr(97 + i)}") for i in range(3)])
    old = gate.decide(rows, gate.GateRules(class_layer=False))
    assert old.agg(F.sum("llm_dispatched")).first()[0] == 3


def stored_audit(spark, seconds=(990, 5)):
    path = work_path(spark, "a")
    audit_store.write_audit(audit_rows(spark, [(t, "s", "warning", "m") for t in seconds]), path)
    return path


def test_a_corrupt_table_gives_the_fixed_lines(spark, tmp_path):
    (tmp_path / "received_date=2024-01-01").mkdir()
    (tmp_path / "received_date=2024-01-01" / "part-0.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    out, mark, now = work_path(spark, "o"), work_path(spark, "m"), START + 1000 * SECOND
    assert audit_store.run_digest(spark, str(tmp_path), mark, now, out) is False
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines[1] == "WATCHDOG=STATE_DB_UNREADABLE" and lines[-1] == "WARNINGS=0" and len(lines) == 5
    assert audit_store.read_mark(spark, mark, now) == now - 86_400 * SECOND
    audit_store.run_review(spark, str(tmp_path), START, now, out)
    assert any(r.value.startswith(V.R_STORE_FAILED.split("{")[0]) for r in spark.read.text(out).collect())


def test_other_sources_fail_alone(spark):
    audit, mark, out, now = stored_audit(spark), work_path(spark, "m"), work_path(spark, "o"), START + 1000 * SECOND
    broken = spark.createDataFrame([("webhook", "1")], "source string, started_at string")
    nothing = spark.createDataFrame([("x",)], "value string")
    assert audit_store.run_digest(spark, audit, mark, now, out, usage=broken, breadcrumbs=nothing) is True
    lines = [r.value for r in spark.read.text(out).collect()]
    assert any("WARNINGS=2" in line for line in lines) and V.D_WATCHDOG_HEAD in lines
    assert any(V.D_BREADCRUMBS_FAILED.split("{")[0] in line for line in lines)
    audit_store.run_review(spark, audit, START, now, out, usage=broken, breadcrumbs=nothing)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert any(line.startswith(V.R_USAGE_FAILED.split("{")[0]) for line in lines) and any("warning=2" in line for line in lines)


def test_the_engines_own_failure_log_reaches_the_digest(spark):
    audit, mark, out, crumbs, now = stored_audit(spark), work_path(spark, "m"), work_path(spark, "o"), work_path(spark, "c"), START + 1000 * SECOND
    rows = spark.createDataFrame([(START + 2 * SECOND, "second"), (START + SECOND, "first")], "received_us long, why string")
    audit_store.quarantine(rows, "payload", F.col("why")).select("value").write.text(crumbs)
    assert audit_store.write_mark(spark, mark, START) is None
    assert audit_store.run_digest(spark, audit, mark, now, out, breadcrumbs=files.parse_breadcrumbs(spark.read.text(crumbs))) is True
    lines = [r.value for r in spark.read.text(out).collect()]
    at = lines.index(V.D_WATCHDOG_HEAD)
    assert [line.rsplit(" ", 1)[1] for line in lines[at + 1:at + 3]] == ["first", "second"]


def test_a_mark_that_cannot_be_written_adds_a_line(spark, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    out = work_path(spark, "o")
    assert audit_store.run_digest(spark, stored_audit(spark), str(blocked / "mark"), START + 1000 * SECOND, out) is False
    assert any(r.value.startswith(V.D_MARK_FAILED.split("{")[0]) for r in spark.read.text(out).collect())


def test_a_failed_batch_leaves_a_breadcrumb(spark):
    crumbs, path = work_path(spark, "c"), work_path(spark, "a")
    bad = lambda: audit_rows(spark, [(1, "s", "error", "m")]).withColumn("host", F.raise_error(F.lit("no store")).cast("string"))
    assert audit_store.run_gate(spark, bad, path, crumbs) is False
    (row,) = files.parse_breadcrumbs(spark.read.text(crumbs)).collect()
    assert row.stage == "state-store" and row.fields >= 3
    assert audit_store.run_gate(spark, lambda: audit_rows(spark, [(1, "s", "error", "m")]), path, crumbs) is True


def test_retention_reads_and_deletes_whole_days(spark):
    path = work_path(spark, "days")
    audit_store.write_audit(audit_rows(spark, [(d * 86_400 + 5, "s", "warning", "m") for d in range(5)]), path)
    now = START + 3 * 86_400 * SECOND + V.AUDIT_RETENTION_S * SECOND
    kept = audit_store.drop_expired(spark.read.parquet(path), now)
    assert "PartitionFilters: [isnotnull(received_date" in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 2
    assert audit_store.delete_expired(spark, path, now) == [f"received_date=2024-01-0{d}" for d in (1, 2, 3)]
    assert spark.read.parquet(path).count() == 2 and audit_store.delete_expired(spark, path, now) == []


def test_batches_are_compacted_by_day(spark):
    path, out = work_path(spark, "batches"), work_path(spark, "days")
    for batch in range(3):
        audit_store.write_batch(audit_rows(spark, [(batch, "s", "warning", "m"), (86_400 + batch, "s", "warning", "m")]), batch, path)
    audit_store.compact(spark, path, out, START + 86_400 * SECOND)
    table = audit_store.read_audit(spark, out)
    assert table.count() == 3 and len(table.inputFiles()) == 1


def _partial_setup(spark, days=4):
    rows = []
    for day in range(days):
        for k in range(6):
            at = day * 86_400 + 3600 * k
            rows += [(at, SOURCE.format("AB"[k % 2], 1 + day), "warning", f"slow {k} ms" if k else " \n"), (at, "bare", "error", "gone"),
                     (at + 1, "s", "info", "fine")]
    rows += [(86_400 * 2, SOURCE.format("B", 3), "Warning", "only here")]
    audit = audit_rows(spark, rows)
    path = work_path(spark, "audit")
    audit_store.write_audit(audit, path)
    return audit, path


@pytest.mark.parametrize("since_s,exclusive", [(0, False), (0, True), (5 * 3600, False), (86_400, False), (86_400, True), (3 * 86_400 + 7200, False)])
def test_digest_from_partials(spark, since_s, exclusive):
    """Whatever the mark, the digest read from finished days' partials is the digest of the rows."""
    audit, path = _partial_setup(spark)
    stored, now = work_path(spark, "partials"), START + 4 * 86_400 * SECOND
    new = partial_store.finish_days(spark, audit_store.read_audit(spark, path), stored, START + (3 * 86_400 + 5) * SECOND)
    assert [str(d) for d in new] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    since = START + since_s * SECOND
    figures = partials.figures(partial_store.window(spark, audit_store.read_audit(spark, path), stored, since, exclusive))
    lines = lambda **more: [r.text for r in digest.report_lines(audit, since, now, exclusive_since=exclusive, **more).orderBy("line_no").collect()]
    assert lines(figures=figures) == lines()
    assert digest.mark_after(figures[0], since, now).first() == digest.next_mark(audit, since, now).first()


def test_partials_are_made_once_and_finished_days_are_not_scanned(spark):
    audit, path = _partial_setup(spark)
    stored = work_path(spark, "partials")
    read = audit_store.read_audit(spark, path)
    end = START + 3 * 86_400 * SECOND
    assert partial_store.finished_days(spark, stored) == []
    assert len(partial_store.finish_days(spark, read, stored, START + 86_400 * SECOND)) == 1
    assert len(partial_store.finish_days(spark, read, stored, end)) == 2
    assert partial_store.finish_days(spark, read, stored, end) == []
    before = [spark.read.parquet(f"{stored}/{n}").count() for n in partials.NAMES]
    assert len(partial_store.finish_days(spark, read, stored, end, again=True)) == 3
    assert [spark.read.parquet(f"{stored}/{n}").count() for n in partials.NAMES] == before
    path, outs = work_path(spark, "open-day"), [work_path(spark, "out") for _ in range(2)]
    audit_store.write_audit(audit.filter(F.col("received_us") >= end), path)      # finished days' rows are not even there
    whole = work_path(spark, "whole")
    audit_store.write_audit(audit, whole)
    for source, out, more in ((path, outs[0], {"partial_path": stored}), (whole, outs[1], {})):
        mark = work_path(spark, "mark")
        audit_store.write_mark(spark, mark, START)
        assert audit_store.run_digest(spark, source, mark, START + 4 * 86_400 * SECOND, out, **more)
    assert [r.value for r in spark.read.text(outs[0]).collect()] == [r.value for r in spark.read.text(outs[1]).collect()]


def test_a_repeated_append_doubles_nothing(spark):
    """The same batch again, a batch that overlaps, and one whose first half is already there."""
    path, crumbs = work_path(spark, "audit"), work_path(spark, "crumbs")
    rows = audit_rows(spark, [(d * 40_000, "s", "warning", f"m{d}") for d in range(6)])
    for part in ("id < 3", "id < 3", "id between 2 and 4", "true", "id < 0"):
        assert audit_store.run_gate(spark, lambda: rows.filter(part), path, crumbs)
        wanted = {"id < 3": 3, "id between 2 and 4": 5}.get(part, 6)
        assert audit_store.read_audit(spark, path).count() == wanted
    got = audit_store.read_audit(spark, path).select("id", "message", "received_date").orderBy("id").collect()
    assert [(r.id, r.message) for r in got] == [(i, f"m{i}") for i in range(6)] and len({r.received_date for r in got}) == 3
