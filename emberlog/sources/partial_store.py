"""Digest partials by finished day: three tables of partials, and the list of the days that are complete.

Every table is stored by ``received_date``, as the audit table is, so ``audit_store.delete_expired`` frees them too.
"""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.clock import DAY, utc_date
from emberlog.operators.audit import since
from emberlog.operators.partials import NAMES, Partials, of_rows

EPOCH = datetime.date(1970, 1, 1)
BY = "received_date"


def finished_days(spark: SparkSession, path: str) -> list[datetime.date]:
    """The days that have partials; as many as the calendar has within the retention."""
    try:
        return sorted(r[BY] for r in spark.read.schema(f"n bigint, {BY} date").parquet(f"{path}/days").select(BY).distinct().collect())
    except AnalysisException:  # nothing written yet
        return []


def finish_days(spark: SparkSession, audit: DataFrame, path: str, before_us: int, again: bool = False) -> list[datetime.date]:
    """Make partials of the days before that of ``before_us`` that have none yet (or of all, ``again``); returns those days.

    Call it when no more rows of those days can come: at a time that the stream's watermark has passed.  A day that is
    made twice replaces itself, and it counts only when all of its tables are written, so a failure in between is
    mended by the next call.
    """
    done = [] if again else finished_days(spark, path)
    rows = audit.filter((F.col(BY) < utc_date(F.lit(before_us))) & ~F.col(BY).isin(done))
    made = of_rows(rows, [BY])
    for name, table in zip(NAMES, made.tables()):
        _replace(table, f"{path}/{name}")
    days = spark.read.parquet(f"{path}/tallies").filter(~F.col(BY).isin(done)).groupBy(BY).agg(F.sum("n").alias("n"))
    new = sorted(r[BY] for r in days.select(BY).collect())
    _replace(days, f"{path}/days")
    return new


def _replace(rows: DataFrame, path: str) -> None:
    """Write whole days, each in place of what it had."""
    (rows.hint("rebalance", BY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BY).parquet(path))


def window(spark: SparkSession, audit: DataFrame, path: str, since_us: int, exclusive: bool = False) -> Partials:
    """Partials of all rows from ``since_us`` on: finished days that lie wholly in the window as they are stored, and the rows of
    the other days.  Finished days are left out of the scan of the audit table by their folders."""
    start = lambda day: (day - EPOCH).days * DAY
    days = [d for d in finished_days(spark, path) if (start(d) > since_us if exclusive else start(d) >= since_us)]
    open_rows = of_rows(since(audit, since_us, exclusive).filter(~F.col(BY).isin(days)).drop(BY))
    if not days:
        return open_rows
    stored = [spark.read.parquet(f"{path}/{name}").filter(F.col(BY).isin(days)).drop(BY) for name in NAMES]
    return Partials(*stored).union(open_rows)
