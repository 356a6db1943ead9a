"""The audit table, the quarantine table and the digest mark."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog import fixed_values as V
from emberlog.functions.clock import SECOND, utc_date, utc_timestamp
from emberlog.operators import audit as audit_ops
from emberlog.operators import digest, partials, review
from emberlog.session import cut
from emberlog.sources import partial_store


ENGINE_ERRORS = (PySparkException, Py4JJavaError)
_TEXT, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
_FIRST_VERSION = {
    "id": _LONG, "received_us": _LONG, "incident_id": _TEXT, "host": _TEXT, "source": _TEXT, "severity": _TEXT,
    "event_timestamp": _TEXT, "message": _TEXT, "fingerprint": _TEXT, "storm_count": _LONG, "storm_window_seconds": _INT,
    "storm_status": _TEXT, "llm_dispatched": _INT,
}
_LATER = {"effective_severity": _TEXT, "suppression_reason": _TEXT, "received_date": T.DateType()}
AUDIT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in {**_FIRST_VERSION, **_LATER}.items()])


def dated(audit: DataFrame) -> DataFrame:
    return audit.withColumn("received_date", utc_date(F.col("received_us")))


def write_audit(audit: DataFrame, path: str, mode: str = "append") -> None:
    """Append audit rows, stored by UTC day so that a time bound skips whole days.

    Rows of a day are brought together first; Spark's rebalancing splits a large day over several tasks and files.
    """
    rows = dated(audit).hint("rebalance", "received_date")
    rows.write.mode(mode).partitionBy("received_date").option("maxRecordsPerFile", 5_000_000).parquet(path)


def append_once(audit: DataFrame, path: str) -> None:
    """Append the audit rows whose ids their day does not hold yet, so a batch that is repeated, whole or after a failure
    half way, doubles nothing.

    The rows are computed once.  Of the table only the ids of the same days are read.
    """
    spark, rows = audit.sparkSession, cut(dated(audit))
    days = [r["received_date"] for r in rows.select("received_date").distinct().collect()]      # bounded by the calendar
    try:
        known = spark.read.schema("id bigint, received_date date").parquet(path)
    except AnalysisException:      # no table yet
        known = None
    if known is not None:
        held = known.filter(F.col("received_date").isin(days)).select("received_date", "id").distinct()
        rows = rows.join(held, ["received_date", "id"], "left_anti")
    write_audit(rows.drop("received_date"), path)


def write_batch(audit: DataFrame, batch_id: int, path: str) -> None:
    """Sink of one micro-batch: a repeated batch replaces its own folder, so nothing is doubled."""
    rows = dated(audit).hint("rebalance", "received_date")
    rows.write.mode("overwrite").partitionBy("received_date").parquet(f"{path}/batch_id={batch_id}")


def write_judged(rows: DataFrame, batch_id: int, path: str, late_path: str) -> None:
    """Sink of one micro-batch of the streaming gate: verdicts to the audit table, late rows to quarantine with their whole body.

    A repeated batch replaces its own folders in both.  The batch is judged once: both writes read the held rows.
    """
    rows = rows.persist()
    try:
        write_batch(rows.filter(~F.col("late")).drop("late"), batch_id, path)
        kept = rows.filter("late").select("*", F.concat(F.lit("behind the watermark: "), F.col("id").cast("string")).alias("reason"))
        behind = quarantine(kept, "late", F.col("reason"), F.col("message"), "id")
        behind.write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
    finally:
        rows.unpersist()


def compact(spark: SparkSession, path: str, out: str, before_us: int) -> None:
    """Append the finished days of a table of micro-batches to a table by day."""
    done = read_audit(spark, path).filter(F.col("received_date") < utc_date(F.lit(before_us)))
    write_audit(done.drop("received_date", "batch_id"), out)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows of any age, with the declared columns: no file is opened to find out its own.

    Files without the newest columns get their defaults.  A table that lacks a column of the first version cannot
    be read: it fails here, not with empty values later.
    """
    found = spark.read.parquet(path)
    found.select(*_FIRST_VERSION).schema  # raises for a missing column
    extra = [f for f in found.schema.fields if f.name == "batch_id"]
    return audit_ops.with_defaults(spark.read.schema(T.StructType([*AUDIT_SCHEMA.fields, *extra])).parquet(path))


def _first_kept(now_us: int) -> int:
    return now_us - V.AUDIT_RETENTION_S * SECOND


def drop_expired(audit: DataFrame, now_us: int) -> DataFrame:
    """Rows within the retention; whole days before it are not read."""
    return audit_ops.since(audit, _first_kept(now_us))


def delete_expired(spark: SparkSession, path: str, now_us: int) -> list[str]:
    """Delete the folders of days that lie wholly before the retention; returns their names."""
    first = spark.range(1).select(utc_date(F.lit(_first_kept(now_us))).cast("string").alias("d")).first()["d"]
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in store.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("received_date=") and name.removeprefix("received_date=") < first:
            store.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def quarantine(rows: DataFrame, stage: str, reason, body=None, *more: str) -> DataFrame:
    """Rows that cannot be judged: time, the breadcrumb line with at most 400 characters, the whole body, and ``more`` columns."""
    text = F.replace(F.substring(reason, 1, 400), F.lit("\n"), F.lit(" "))
    return rows.select(
        F.col("received_us"),
        F.concat_ws(
            "\t", F.round(F.col("received_us") / SECOND).cast("bigint").cast("string"), F.lit(stage), text
        ).alias("value"),
        (reason if body is None else body).alias("body"),
        *more,
    )


def leave_breadcrumb(spark: SparkSession, path: str, stage: str, problem: BaseException) -> None:
    """Append one line of a failure to the breadcrumbs."""
    rows = spark.createDataFrame([(int(time.time() * SECOND), error_text(problem))], "received_us long, reason string")
    quarantine(rows, stage, F.col("reason")).select("value").coalesce(1).write.mode("append").text(path)


def run_gate(spark: SparkSession, decide: Callable[[], DataFrame], path: str, breadcrumbs: str, stage: str = "state-store") -> bool:
    """Judge a batch and store its audit rows, each once however often the batch is run.  A failure leaves a breadcrumb, nothing
    is sent and nothing raises."""
    try:
        append_once(decide(), path)
    except ENGINE_ERRORS as problem:
        leave_breadcrumb(spark, breadcrumbs, stage, problem)
        return False
    return True


def error_text(problem: BaseException) -> str:
    """An engine error by its name and condition, which do not vary from run to run; the text is cut, as the report wants it."""
    if isinstance(problem, Py4JJavaError):
        kind, text = problem.java_exception.getClass().getSimpleName(), "engine failure"
    else:
        kind, text = type(problem).__name__, (problem.getCondition() if isinstance(problem, PySparkException) else None) or str(problem)
    return f"{kind}: {text[:200]}".replace("\n", " ")


def read_mark(spark: SparkSession, path: str, now_us: int) -> int:
    """Newest mark if it lies in (0, now], else 24 hours before now.

    Marks are only ever appended; a one-row result comes back.
    """
    try:
        row = spark.read.parquet(path).agg(F.max_by("mark_us", "run_us").alias("m")).first()
    except AnalysisException:  # no mark written yet
        row = None
    if row and row["m"] is not None and 0 < row["m"] <= now_us:
        return row["m"]
    return now_us - V.DIGEST_HOURS * 3600 * SECOND


def write_mark(spark: SparkSession, path: str, mark_us: int) -> None:
    """Append a mark, after the digest has been written."""
    run_us = int(time.time() * SECOND)
    spark.range(1).select(
        F.lit(mark_us).cast("bigint").alias("mark_us"),
        F.lit(run_us).cast("bigint").alias("run_us"),
        utc_timestamp(F.lit(run_us)).alias("run_at"),
    ).coalesce(1).write.mode("append").parquet(path)


def _small(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A result of a few rows, evaluated now."""
    return spark.createDataFrame(rows.collect(), rows.schema)


def _write_lines(spark: SparkSession, lines: list[str], path: str, mode: str = "overwrite") -> None:
    spark.createDataFrame([(line,) for line in lines], "text string").coalesce(1).write.mode(mode).text(path)


def run_digest(
    spark: SparkSession, audit_path: str, mark_path: str, now_us: int, out_path: str,
    usage: DataFrame | None = None, breadcrumbs: DataFrame | None = None, title: str = "DAILY_DIGEST",
    exclusive_since: bool = False, partial_path: str | None = None,
) -> bool:
    """Incremental digest from the last mark to now.  Returns whether the mark moved.

    With ``partial_path``, finished days that lie wholly in the window are read from their partials (``partial_store``)
    and not from their rows.

    Each source fails alone.  An audit table that cannot be read gives the fixed watchdog lines and leaves the
    mark; usage that cannot be read leaves its lines out; breadcrumbs that cannot be read are a failure
    line themselves; a mark that cannot be written adds a line.
    """
    since_us = read_mark(spark, mark_path, now_us)
    cost = failures = None
    if usage is not None:
        try:
            cost = _small(spark, audit_ops.usage_cost(usage, since_us))
        except ENGINE_ERRORS:
            cost = None
    if breadcrumbs is not None:
        try:
            failures = _small(spark, digest.first_failures(digest.failures_since(breadcrumbs, since_us)))
        except ENGINE_ERRORS as problem:
            failures = digest.unreadable_breadcrumbs(spark, error_text(problem))
    try:
        audit = read_audit(spark, audit_path)
        figures = None
        if partial_path is not None:
            figures = partials.figures(partial_store.window(spark, audit, partial_path, since_us, exclusive_since))
        lines = digest.report_lines(audit, since_us, now_us, cost, failures, title, exclusive_since, figures)
        lines.orderBy("line_no").select("text").coalesce(1).write.mode("overwrite").text(out_path)
        mark = digest.next_mark(audit, since_us, now_us) if figures is None else digest.mark_after(figures[0], since_us, now_us)
        mark_us = mark.first()["mark_us"]
    except ENGINE_ERRORS as problem:
        _write_lines(spark, digest.unreadable_report(error_text(problem), title), out_path)
        return False
    try:
        write_mark(spark, mark_path, mark_us)
    except ENGINE_ERRORS as problem:
        _write_lines(spark, [V.D_MARK_FAILED.replace("{error}", error_text(problem))], out_path, "append")
        return False
    return True


def run_review(
    spark: SparkSession, audit_path: str, since_us: int, now_us: int, out_path: str,
    usage: DataFrame | None = None, breadcrumbs: DataFrame | None = None, title: str = "TRIAL_REVIEW",
) -> None:
    """The review of a window as text.  Each source fails alone, with a line of its own; breadcrumbs fail silently."""
    sections = [review.head_lines(spark, since_us, now_us, title)]
    try:
        sections.append(_small(spark, review.store_lines(read_audit(spark, audit_path), since_us, now_us)))
    except ENGINE_ERRORS as problem:
        sections.append(review.failed_line(spark, 3, V.R_STORE_FAILED, error_text(problem)))
    if usage is not None:
        try:
            cost = audit_ops.usage_cost(usage, since_us, review.hours_between(since_us, now_us))
            sections.append(_small(spark, review.usage_lines(cost)))
        except ENGINE_ERRORS as problem:
            sections.append(review.failed_line(spark, 9, V.R_USAGE_FAILED, error_text(problem)))
    if breadcrumbs is not None:
        try:
            sections.append(_small(spark, review.breadcrumb_lines(review.breadcrumb_summary(breadcrumbs, since_us))))
        except ENGINE_ERRORS:
            pass
    lines = review.numbered(sections).orderBy("line_no").select("text")
    lines.coalesce(1).write.mode("overwrite").text(out_path)
