"""Streams give the batch verdicts, also over many micro-batches and after a restart."""

from pyspark.sql import functions as F

from emberlog.functions.clock import utc_timestamp
from emberlog.operators import gate
from emberlog.plans import testbed as tb
from emberlog.session import work_path
from emberlog.streaming import gate as SG
from emberlog.streaming.run import read_segments, run_to_end, write_in_order
from tests.events import SECOND, START, gate_rows


def test_restart_from_checkpoint(spark):
    """The second half arrives after the first query has ended; state goes on where it was."""
    times = [0, 1, 2, 3, 4, 5, 63, 123, 124, 500, 4000, 90_500, 90_501]
    rows = gate_rows(spark, [(t, "error", "broken") for t in times])
    path, progress, out = (work_path(spark, n) for n in ("in", "progress", "out"))
    for low, high in ((0, 60), (60, 10**6)):
        part = rows.filter((F.col("received_us") >= START + low * SECOND) & (F.col("received_us") < START + high * SECOND))
        write_in_order(part, "received_us", [START + 3 * SECOND], path)
        run_to_end(SG.stream_gate(read_segments(spark, path, rows.schema)), "gate", progress, out)
    got = {r.id: (r.storm_status, r.storm_count, r.llm_dispatched) for r in spark.read.parquet(out).collect()}
    want = {r.id: (r.storm_status, r.storm_count, r.llm_dispatched) for r in gate.decide(rows).collect()}
    assert got == want


def test_session_window_gap_of_exactly_sixty_seconds(spark):
    rows = [(START, "a"), (START + 60 * SECOND, "a"), (START, "b"), (START + 60 * SECOND + 1, "b"), (START + 9000 * SECOND, "z")]
    df = spark.createDataFrame(rows, "us long, fingerprint string")
    path = work_path(spark, "in")
    df.coalesce(1).write.parquet(path)
    runs = run_to_end(SG.stream_sessions(read_segments(spark, path, df.schema)), "sessions")
    got = sorted((r.fingerprint, r.n) for r in runs.collect() if r.fingerprint != "z")
    assert got == [("a", 2), ("b", 1), ("b", 1)]


def test_state_is_freed_by_event_time(spark):
    """The watermark passes 24 h after the first keys: their state is gone from the store."""
    keys = [(i, START, f"k{i}") for i in range(5)] + [(5, START + 3 * 86_400 * SECOND, "late")] + [(6, START + 4 * 86_400 * SECOND, "later")]
    rows = gate_rows(spark, [((us - START) / SECOND, "error", f"broken {k}" + "x" * i) for i, us, k in keys])
    path, progress = work_path(spark, "in"), work_path(spark, "progress")
    write_in_order(rows, "received_us", [START + d * 86_400 * SECOND for d in (1, 3, 4)], path)
    run_to_end(SG.stream_storms(read_segments(spark, path, rows.schema)).select("id"), "storms", progress)
    left = spark.read.format("statestore").option("stateVarName", "state").load(progress)
    assert left.count() <= 2


def test_dedupe_keeps_one_row_per_id(spark, sf):
    signed = tb.signed(spark, sf)
    path = work_path(spark, "in")
    write_in_order(signed, "received_us", tb_bounds(), path)
    rows = run_to_end(SG.stream_dedupe(read_segments(spark, path, signed.schema)).select("svix_id"), "ids")
    assert rows.count() == signed.select("svix_id").distinct().count()


def tb_bounds():
    return [tb.START_US + d * 86_400 * SECOND for d in (10, 20)]


def test_watermark_column_is_utc(spark):
    assert str(spark.range(1).select(utc_timestamp(F.lit(START)).cast("string")).first()[0]) == "2024-01-01 00:00:00"


def test_a_failed_stream_leaves_a_breadcrumb(spark):
    import time

    import pytest
    from pyspark.errors import StreamingQueryException

    from emberlog.sources.files import parse_breadcrumbs
    from emberlog.streaming.run import FailureBreadcrumbs

    rows = gate_rows(spark, [(0, "error", "broken")])
    path, crumbs = work_path(spark, "in"), work_path(spark, "crumbs")
    rows.coalesce(1).write.parquet(path)
    listener = FailureBreadcrumbs(spark, crumbs, "state-store")
    spark.streams.addListener(listener)
    try:
        failing = read_segments(spark, path, rows.schema).select(F.raise_error(F.lit("no store")).cast("string").alias("x"))
        with pytest.raises(StreamingQueryException):
            run_to_end(failing, "failing")
        for _ in range(50):
            try:
                got = parse_breadcrumbs(spark.read.text(crumbs)).collect()
                if got:
                    break
            except Exception:
                pass
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert len(got) == 1 and got[0].stage == "state-store" and got[0].fields >= 3 and len(got[0].detail) <= 400


def test_late_rows_come_out_whole_and_change_no_state(spark):
    """Rows two hours behind an earlier segment go to quarantine; the verdicts of the others are as if they had not come."""
    from emberlog.sources import audit_store
    from emberlog.streaming.run import run_batches

    first = [(t, "error", "broken") for t in (0, 1, 7200, 7201)]
    second = [(t, "error", "broken " + "x" * 3000) for t in (2, 7100)] + [(7202, "error", "broken"), (3, "error", "[INFO] started")]
    rows = gate_rows(spark, first + second)
    path, audit, late = (work_path(spark, n) for n in ("in", "audit", "late"))
    for low, high in ((0, 4), (4, 8)):
        rows.filter(F.col("id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    stream = SG.stream_gate(read_segments(spark, path, rows.schema))

    def twice(batch, batch_id):
        for _ in range(2):      # a repeated batch replaces what it wrote
            audit_store.write_judged(batch, batch_id, audit, late)

    run_batches(stream, twice, "gate")
    behind = {r.id: r for r in spark.read.parquet(late).collect()}
    judged = {r.id: (r.storm_status, r.storm_count, r.llm_dispatched) for r in audit_store.read_audit(spark, audit).collect()}
    assert sorted(behind) == [4] and behind[4].body == "broken " + "x" * 3000 and behind[4].received_us == START + 2 * SECOND
    assert behind[4].value.split("\t")[1:] == ["late", "behind the watermark: 4"]
    assert sorted([*judged, *behind]) == list(range(8))
    want = {r.id: (r.storm_status, r.storm_count, r.llm_dispatched) for r in gate.decide(rows.filter("id <> 4")).collect()}
    assert judged == want


def test_state_as_a_table(spark):
    """What a stream holds of each key after its last micro-batch."""
    from emberlog.streaming.state import keys_of

    rows = gate_rows(spark, [(t, "error", "broken") for t in (0, 30, 100)])
    path, progress = work_path(spark, "in"), work_path(spark, "progress")
    rows.coalesce(1).write.parquet(path)
    run_to_end(SG.stream_storms(read_segments(spark, path, rows.schema)).select("id"), "storms", progress)
    got = keys_of(spark, progress, SG.StormRule, 0).collect()
    assert [(r.seen, r["count"], r.opened, r.sample_id) for r in got] == [(START + 100 * SECOND, 1, START + 100 * SECOND, 2)]
    assert len(got[0].fingerprint) == 32
