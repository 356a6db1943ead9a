"""Whole-number time arithmetic on epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND


def whole(us: Column, unit: int) -> Column:
    """How many whole units; exact, without going through fractions."""
    return ((us - F.pmod(us, F.lit(unit))) / F.lit(unit)).cast("bigint")


def seconds(us: Column) -> Column:
    return whole(us, SECOND)


def utc_timestamp(us: Column) -> Column:
    """Wall-clock time in UTC, whatever the session time zone is."""
    return F.to_utc_timestamp(F.timestamp_micros(us), F.current_timezone())


def utc_date(us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), whole(us, DAY).cast("int"))


def rfc3339(us: Column) -> Column:
    return F.date_format(utc_timestamp(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hour_label(us: Column) -> Column:
    return F.date_format(utc_timestamp(us), "MM-dd HH:00")


def local_label(us: Column, zone: str) -> Column:
    """MM-dd HH:mm in the given zone, marked NZ as in the reports."""
    return F.concat(
        F.date_format(F.from_utc_timestamp(utc_timestamp(us), zone), "MM-dd HH:mm"), F.lit(" NZ")
    )
