"""Inputs derived from the given tables, by expressions that the SQL twins repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.clock import DAY, SECOND, rfc3339, seconds, whole
from emberlog.functions.signing import signature
from emberlog.operators import gate, gateway
from emberlog.session import work_path
from emberlog.sources.files import load_allowlist

START_US = 1_704_067_200 * SECOND       # 2024-01-01
SINCE_US = START_US + 9 * DAY           # mark used by the windowed queries
NOW_US = START_US + 29 * DAY + 310 * SECOND
SECRET = b"testbed-signing-key"
WRONG_SECRET = b"another-key"

TASK_ROWS = 1 << 17                     # rows that one task works on, about

_stored: dict[tuple, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tasks(spark: SparkSession, rows: DataFrame) -> int:
    """How many tasks the rows are for: a few by the cluster, more by their number, so that no task grows with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def spread(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, whose file may be a single split, dealt over tasks by all its columns before anything is derived from it."""
    given = table(spark, sf, name)
    return given.repartition(tasks(spark, given), *given.columns)


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application and data folder, as it is dealt, and read back from there."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        path = work_path(spark, name)
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def log_events(spark: SparkSession, sf: str) -> DataFrame:
    """Log events, as a stored table."""
    return stored(spark, sf, "log", lambda: derive_log_events(spark, sf))


def derive_log_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as log events; see FIXTURES.md, part B.

    ``received_us`` squeezes each day into its first five minutes, ``gateway_us`` into its first
    hour, so that storms and cooldowns occur.
    """
    e = spread(spark, sf, "events")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(
        F.col("event_id").alias("id"), "user_id", "event_type", "ts", us.alias("us"), k.alias("k")
    )
    day_start = F.lit(START_US) + whole(F.col("us"), DAY) * F.lit(DAY)
    in_day = F.pmod(F.col("us"), F.lit(DAY))
    lane = F.col("user_id") % 5
    program = F.element_at(
        F.array(*[F.lit(p) for p in ("Feed1m", "Feed5m", "Ledger", "Mailer", "Stray")]),
        (lane + 1).cast("int"),
    )
    e = e.select(
        "*",
        (day_start + whole(in_day, 288)).alias("received_us"),
        (day_start + whole(in_day, 24)).alias("gateway_us"),
        program.alias("program"),
        F.when(lane < 2, "Feeds").when(lane < 4, "Office").otherwise("").alias("project"),
        F.concat(F.lit("host-"), (lane % 2).cast("string")).alias("host"),
    )
    e = e.withColumn(
        "path",
        F.concat(
            F.lit("/logs/"), "program", F.lit("/"), F.lower("program"), F.lit("_2024"),
            F.date_format("ts", "MMdd"), F.lit(".log"),
        ),
    )
    n = lambda c: c.cast("string")
    eid, kk = F.col("id"), F.col("k")
    kind = F.col("event_type")
    message = (
        F.when(
            (kind == "error") & (kk % 4 == 0),
            F.concat(
                F.lit("[2024-01-02 03:04:05.678] [ERROR] [Acme.Core.Client] request id="), n(eid + 1000),
                F.lit(" failed with timeout"), F.when(eid % 9 == 0, " in Acme.Core.dll").otherwise(""),
            ),
        )
        .when(
            (kind == "error") & (kk % 4 == 1),
            F.concat(F.lit("[2024-01-02 03:04:05.678] [INFO] [Acme.Core.Client] batch done rows="), n(kk)),
        )
        .when((kind == "error") & (kk % 4 == 2), F.concat(F.lit("[ INFO ] totals rows="), n(kk), F.lit(" errors: 0")))
        .when(kind == "error", F.concat(F.lit("2024-01-02 03:04:05 FATAL store closed code="), n(kk)))
        .when(
            kind == "view",
            F.concat(F.lit("[WARN] [Acme.Cache] slow read "), n(kk), F.lit(" ms token=abc"), n(eid)),
        )
        .when(
            kind == "click",
            F.concat(
                F.lit("[ERROR] [Acme.Queue.Pump] lag on one shard "),
                n(F.when(kk % 10 < 7, 0).otherwise(kk % 3)),
            ),
        )
        .when(kind == "signup", F.concat(F.lit("disk almost full on volume"), n(kk % 4), F.lit(" part "), n(kk % 5)))
        .otherwise(
            F.concat(
                F.lit("job "), n(eid), F.lit(" finished"),
                F.when(kk % 10 == 0, F.concat(F.lit(" password: s3cr3t"), n(kk), F.lit(", log=/var/log/jobs/run.log")))
                .otherwise(""),
            )
        )
    )
    label = (
        F.when((kind == "error") & (kk % 4 == 3), "critical")
        .when(kind == "error", "error")
        .when(kind.isin("view", "click"), "warning")
        .when(kind == "signup", "unknown")
        .otherwise("info")
    )
    return e.select(
        "id",
        "received_us",
        "gateway_us",
        F.concat(F.lit("evt-"), n(eid)).alias("incident_id"),
        "host",
        F.when(eid % 37 == 0, "host-logs")
        .otherwise(
            F.concat(
                F.lit("project="), "project", F.lit("; program="), "program", F.lit("; log_file="), "path",
                F.lit("; dll=unknown"),
            )
        )
        .alias("source"),
        F.when(eid % 53 == 0, F.upper(label)).otherwise(label).alias("severity"),
        message.alias("message"),
        rfc3339(F.col("received_us")).alias("timestamp"),
        "project", "program", "path", "event_type", "k", "user_id",
    )


def gate_input(spark: SparkSession, sf: str) -> DataFrame:
    return log_events(spark, sf).select(*gate.AUDIT_INPUT)


def _trailing():
    """What makes some bodies no JSON although they begin with an object."""
    return F.when(F.col("id") % 43 == 0, "}").when(F.col("id") % 47 == 0, " } {}").otherwise("")


def raw_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies as they reach the gateway: JSON envelopes, some with text after them, plain text, and empty messages."""
    e = log_events(spark, sf)
    envelope = F.to_json(F.struct(F.col("path").alias("source"), "message"))
    empty = F.to_json(F.struct(F.col("path").alias("source"), F.lit("  ").alias("message")))
    return e.select(
        "id",
        F.col("gateway_us").alias("received_us"),
        F.when(F.col("id") % 11 == 0, F.col("message"))
        .when(F.col("id") % 13 == 0, empty)
        .otherwise(F.concat(envelope, _trailing()))
        .alias("raw"),
        "host",
    )


def allowlist(spark: SparkSession, sf: str) -> DataFrame:
    """The allow-list as a JSON file made from the programs that occur; Mailer is switched off,
    programs without a project are not listed."""

    def build() -> DataFrame:
        programs = log_events(spark, sf).filter("project != ''").groupBy("project", "program").agg(
            F.first(F.col("program") != "Mailer").alias("enabled")
        )
        per_project = programs.groupBy("project").agg(
            F.struct(F.map_from_entries(F.collect_list(F.struct("program", "enabled"))).alias("programs")).alias("s")
        )
        return per_project.agg(
            F.to_json(
                F.struct(F.map_from_entries(F.collect_list(F.struct("project", "s"))).alias("projects"))
            ).alias("value")
        )

    key = (spark.sparkContext.applicationId, sf, "allowlist")
    if key not in _stored:
        path = work_path(spark, "allowlist")
        build().coalesce(1).write.text(path)
        _stored[key] = path
    return load_allowlist(spark, _stored[key])


def received(spark: SparkSession, sf: str) -> DataFrame:
    """Every body parsed, placed, graded and keyed."""
    return gateway.receive(raw_bodies(spark, sf), allowlist(spark, sf))


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    """The gateway's stored events."""

    def build() -> DataFrame:
        judged = gateway.gateway_throttle(gateway.receipts(received(spark, sf)))
        events = gateway.accepted_events(raw_bodies(spark, sf), allowlist(spark, sf), judged)
        return events.repartition(tasks(spark, log_events(spark, sf)))

    return stored(spark, sf, "accepted", build)


def audit(spark: SparkSession, sf: str) -> DataFrame:
    """The gate's audit table, stored by day as the gate's sink stores it."""
    key = (spark.sparkContext.applicationId, sf, "audit")
    if key not in _stored:
        from emberlog.sources.audit_store import write_audit

        path = work_path(spark, "audit")
        write_audit(gate.decide(gate_input(spark, sf)), path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def signed(spark: SparkSession, sf: str) -> DataFrame:
    """Signed events as received, as a stored table."""
    return stored(spark, sf, "signed", lambda: derive_signed(spark, sf))


def derive_signed(spark: SparkSession, sf: str) -> DataFrame:
    """Signed events as received, with the faults the receiver has to find."""
    e = log_events(spark, sf)
    svix_id = F.concat(F.lit("evt-"), (F.col("id") - F.when(F.col("id") % 10 == 3, 1).otherwise(0)).cast("string"))
    age = F.when(F.col("id") % 17 == 0, 301).when(F.col("id") % 17 == 1, 300).otherwise(2)
    body = F.to_json(F.struct("incident_id", "host", "source", "severity", "message", "timestamp"))
    e = e.select(
        F.col("id").alias("seq"),
        "received_us",
        svix_id.alias("svix_id"),
        (seconds(F.col("received_us")) - age).alias("svix_timestamp"),
        F.when(F.col("id") % 29 == 0, "[1,2]").when(F.col("id") % 31 == 0, "not json").otherwise(F.concat(body, _trailing())).alias("raw_body"),
    )
    parts = [F.col(c) for c in ("svix_id", "svix_timestamp", "raw_body")]
    return e.withColumn(
        "svix_signature",
        F.when(F.col("seq") % 23 == 0, F.lit(None))
        .when(F.col("seq") % 19 == 0, signature(WRONG_SECRET, *parts))
        .otherwise(signature(SECRET, *parts)),
    )


def breadcrumb_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One failure line per error event, some of them malformed."""
    e = log_events(spark, sf).filter("event_type = 'error'")
    at = seconds(F.col("received_us")).cast("string")
    stage = F.when(F.col("id") % 2 == 0, "state-store").otherwise("open")
    return e.select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 7 == 0, F.concat(F.lit("no tabs in line "), F.col("id").cast("string")))
        .when(F.col("id") % 5 == 0, F.concat_ws("\t", at, stage))
        .otherwise(F.concat_ws("\t", at, stage, F.concat(F.lit("OperationalError: database is locked "), F.col("id").cast("string"))))
        .alias("value"),
    )


def usage_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = log_events(spark, sf).filter("event_type = 'purchase'")
    return e.select(
        F.element_at(
            F.array(F.lit("webhook:alerts"), F.lit("Profile-WebHook"), F.lit("cli")),
            (F.col("user_id") % 3 + 1).cast("int"),
        ).alias("source"),
        F.when(F.col("id") % 41 == 0, "n/a").otherwise(seconds(F.col("received_us")).cast("string")).alias("started_at"),
        (F.lit(1000) + F.col("k") * 37).cast("bigint").alias("input_tokens"),
        (F.col("k") * 11).cast("bigint").alias("output_tokens"),
        (F.col("user_id") * 13).cast("bigint").alias("cache_read_tokens"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery attempts of accepted events: up to three each, the last of some succeeds."""
    a = accepted(spark, sf)
    tries = F.sequence(F.lit(1), (F.lit(1) + F.col("id") % 3).cast("int"))
    return a.select("id", "created_us", F.explode(tries).alias("seq")).select(
        "id",
        F.col("seq").cast("bigint").alias("seq"),
        (F.col("created_us") + F.col("seq") * (30 * SECOND)).alias("attempt_us"),
        ((F.col("seq") == F.lit(1) + F.col("id") % 3) & (F.col("id") % 4 != 0)).alias("ok"),
    ).withColumn("error", F.when(~F.col("ok"), "unexpected response"))
