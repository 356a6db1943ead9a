"""Queries that run as streams; each has the SQL twin of its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.clock import DAY
from emberlog.operators import gate, gateway, inbox
from emberlog.plans import oracle as O
from emberlog.plans import testbed as tb
from emberlog.plans.gate_queries import SNAPSHOT
from emberlog.plans.registry import query
from emberlog.session import work_path
from emberlog.sources import audit_store
from emberlog.sources.tail import tail_log_files
from emberlog.streaming import gate as SG
from emberlog.streaming import state
from emberlog.streaming.run import read_segments, run_batches, run_to_end, write_in_order

SEGMENTS, SEGMENT_ROWS, SPAN = 4, 1 << 20, 30 * DAY


def _segments(spark, rows, time, name, held=None):
    """A stream of ``rows`` in segments of equal time, more of them for more rows; one segment is one micro-batch.

    Rows that are ``held`` come with the segment after their own."""
    SG.use_rocksdb(spark)
    path = work_path(spark, name)
    count = rows.count()
    parts = max(SEGMENTS, -(-count // SEGMENT_ROWS))
    files = max(1, min(spark.sparkContext.defaultParallelism, count // (100 * parts)))
    if held is not None:
        rows, time = rows.withColumn("arrives_us", F.col(time) + F.when(held, SPAN // parts).otherwise(0)), "arrives_us"
    write_in_order(rows, time, [tb.START_US - (-SPAN * k // parts) for k in range(1, parts)], path, files)
    return read_segments(spark, path, rows.schema, files).drop("arrives_us")


@query("stream_gate", f"SELECT {', '.join(gate.AUDIT_COLUMNS)} FROM audit", "audit")
def stream_gate(spark, sf):
    """The whole audit table, written by the stream's sink batch by batch and read back."""
    stream = _segments(spark, tb.gate_input(spark, sf), "received_us", "gate-input")
    path, _, _ = _gated(spark, stream)
    return audit_store.read_audit(spark, path).select(gate.AUDIT_COLUMNS)


def _gated(spark, stream):
    """The streaming gate run to its end: (audit table, quarantine of late rows, checkpoint)."""
    path, late, progress = (work_path(spark, n) for n in ("stream-audit", "stream-late", "gate-progress"))
    run_batches(SG.stream_gate(stream), lambda batch, batch_id: audit_store.write_judged(batch, batch_id, path, late), "gate", progress)
    return path, late, progress


@query("stream_state", SNAPSHOT, "log", "storm", "class_fold")
def stream_state(spark, sf):
    """The stream's own state after its last micro-batch, read as a table: equal to the batch snapshot."""
    path, _, progress = _gated(spark, _segments(spark, tb.gate_input(spark, sf), "received_us", "gate-input"))
    now_us = tb.log_events(spark, sf).agg(F.max("received_us")).first()[0]
    return state.gate_state(spark, progress, audit_store.read_audit(spark, path), now_us)


HELD = "id % 7 = 3"

O.cte("arrived", ["log"], f"""
SELECT id, received_us, message, CAST(least(parts - 1, (received_us - {tb.START_US} + CASE WHEN {HELD} THEN {SPAN} // parts ELSE 0 END) * parts // {SPAN}) AS BIGINT) AS segment
FROM log, (SELECT greatest({SEGMENTS}, (count(*) + {SEGMENT_ROWS - 1}) // {SEGMENT_ROWS}) AS parts FROM log)""")


@query(
    "stream_late_rows",
    f"""SELECT id, late, CASE WHEN late THEN message END AS body FROM (
      SELECT a.id, a.message, coalesce(k.exit_status IS NULL AND a.received_us < t.top // 1000 * 1000 - 600000000, false) AS late
      FROM arrived a JOIN keyed k ON k.id = a.id LEFT JOIN (
        SELECT segment, max(top) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
        FROM (SELECT segment, max(received_us) AS top FROM arrived GROUP BY segment)) t ON t.segment = a.segment)""",
    "arrived", "keyed",
)
def stream_late_rows(spark, sf):
    """Some rows come a segment too late: judged and late rows together are all rows, late ones with their body."""
    rows = tb.gate_input(spark, sf)
    stream = _segments(spark, rows, "received_us", "gate-input", F.expr(HELD))
    path, late, _ = _gated(spark, stream)
    judged = audit_store.read_audit(spark, path).select("id", F.lit(False).alias("late"), F.lit(None).cast("string").alias("body"))
    return judged.unionByName(spark.read.parquet(late).select("id", F.lit(True).alias("late"), "body"))


@query("stream_throttle", "SELECT id, accepted, acc_id AS accepted_id FROM gateway_fold", "gateway_fold")
def stream_throttle(spark, sf):
    stream = _segments(spark, tb.raw_bodies(spark, sf), "received_us", "bodies")
    return run_to_end(SG.stream_throttle(gateway.receive(stream, tb.allowlist(spark, sf))), "throttled").drop("late")


_VALID = "signature_ok AND fresh_ok AND payload_ok"


@query(
    "stream_dedupe",
    f"SELECT svix_id FROM verified WHERE {_VALID} GROUP BY svix_id", "verified",
)
def stream_dedupe(spark, sf):
    """Which of two rows of one micro-batch is kept is open, so only the ids are compared."""
    stream = _segments(spark, tb.signed(spark, sf), "received_us", "signed-input")
    rows = inbox.verify(stream, tb.SECRET).filter(_VALID)
    return run_to_end(SG.stream_dedupe(rows).select("svix_id"), "deduped")


@query(
    "stream_ttl",
    "SELECT id, status = 'first_seen' AS first_seen FROM storm", "storm",
)
def stream_ttl(spark, sf):
    """State forgotten after 24 h of silence is first_seen again, on event time."""
    stream = _segments(spark, tb.gate_input(spark, sf), "received_us", "gate-input")
    storms = SG.stream_storms(stream).filter("exit IS NULL")
    rows = run_to_end(storms.select("id", "storm_status"), "ttl-output")
    return rows.select("id", (F.col("storm_status") == "first_seen").alias("first_seen"))


@query(
    "stream_sessions",
    """SELECT fp AS fingerprint, count(*) AS n, opened AS first_us, max(us) AS last_us FROM storm GROUP BY fp, opened
    HAVING max(us) + 60000000 <= ((SELECT max(us) FROM storm) - 600000000) // 1000 * 1000""", "storm",
)
def stream_sessions(spark, sf):
    """Closed runs only: those the watermark has not passed at the end stay open."""
    stream = _segments(spark, tb.gate_input(spark, sf), "received_us", "gate-input")
    keys = gate.verdict_rows(stream).filter("exit IS NULL").select(
        F.lower(F.hex("fingerprint")).alias("fingerprint"), "us"
    )
    return run_to_end(SG.stream_sessions(keys), "sessions")


TAILERS = 4


def _tailed(spark, sf, bound):
    """Log files that appear while streams follow them: one row (id, message, tailer, batch, size) per line.

    The files are dealt over a few folders, each with a tailer of its own, and all tailers run side by side."""
    log = tb.log_events(spark, sf).select(
        "received_us", F.concat_ws("\t", F.col("id").cast("string"), "message").alias("value"), F.pmod(F.xxhash64("id"), F.lit(TAILERS)).alias("tailer")
    )
    root, out = work_path(spark, "tail"), work_path(spark, "tailed")

    def follow(tailer):
        def keep(batch, batch_id):
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/tailer={tailer}/batch_id={batch_id}")

        lines = tail_log_files(spark, f"{root}/tailer={tailer}", suffix=".txt", bytes_per_batch=bound, from_end=False)
        return lines.writeStream.foreachBatch(keep).option("checkpointLocation", work_path(spark, "tail-progress")).start()

    followers = []
    try:
        for tailer in range(TAILERS):
            followers.append(follow(tailer))
        for k in range(SEGMENTS):
            low, high = (tb.START_US + SPAN * (k + j) // SEGMENTS for j in (0, 1))
            part = log.filter(F.col("received_us") < high) if k == 0 else log.filter(F.col("received_us") >= low)
            part = part if k in (0, SEGMENTS - 1) else part.filter(F.col("received_us") < high)
            part.select("value", "tailer").write.mode("append").partitionBy("tailer").text(root)
            for follower in followers:
                follower.processAllAvailable()
    finally:
        for follower in followers:
            follower.stop()
    parts = F.split("value", "\t", 2)
    return spark.read.parquet(out).select(
        parts[0].cast("bigint").alias("id"), parts[1].alias("message"), "tailer", "batch", (F.octet_length("value") + 1).alias("size")
    )


BOUND = 1 << 19


@query("tail_log_files", "SELECT id, message FROM log", "log")
def tail_lines(spark, sf):
    """Every line of the files once, whatever micro-batch took it."""
    return _tailed(spark, sf, BOUND).select("id", "message")


@query("ingest_rate_limit", "SELECT count(*) AS rows, true AS within_bound FROM log", "log")
def ingest_rate_limit(spark, sf):
    """The intake of every tailer is bounded in bytes, whatever has piled up."""
    batches = _tailed(spark, sf, BOUND).groupBy("tailer", "batch").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    return batches.agg(F.sum("rows").alias("rows"), (F.max("bytes") <= BOUND).alias("within_bound"))
