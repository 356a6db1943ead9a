"""Severity: the collector's label, the level written in the line, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.text import UNI, UNI_I, cut, first_match, lookup, strip


def _has_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def collector_severity(message: Column) -> Column:
    """Keyword grade given where the line is collected."""
    upper = F.upper(message)
    return (
        F.when(_has_any(upper, V.CRITICAL_WORDS), "critical")
        .when(_has_any(upper, V.ERROR_WORDS), "error")
        .when(_has_any(upper, V.WARNING_WORDS), "warning")
        .otherwise("unknown")
    )


def body_level(message: Column) -> Column:
    """Level written at the head of the line: a bracketed tag, else a word after a clock time."""
    head = cut(message, V.LEVEL_HEAD)
    word = F.coalesce(
        first_match(head, UNI_I + V.LEVEL_TAG, 1),
        first_match(head, UNI_I + V.LEVEL_AFTER_CLOCK, 1),
    )
    return lookup(F.lower(word), V.LEVEL_ALIAS)


def level_rank(level: Column) -> Column:
    return F.coalesce(lookup(level, V.LEVEL_RANK), F.lit(V.DEFAULT_RANK))


def fault_word(message: Column) -> Column:
    """The look-ahead, the first letters of all the words, keeps the slower word boundary off other positions."""
    return message.rlike(UNI_I + "(?=[cdefprtu])" + V.FAULT_WORD)


def label_of(severity: Column) -> Column:
    """The label as compared: 32 characters, trimmed, lower case; a missing one is unknown."""
    return F.lower(strip(cut(F.coalesce(severity, F.lit("unknown")), V.MAX_SEVERITY)))


def false_error_info(severity: Column, message: Column) -> Column:
    """An INFO line with a zero error counter that was labelled error."""
    head = cut(message, V.MAX_KEY_MESSAGE)
    label = F.lower(strip(F.coalesce(severity, F.lit("unknown"))))
    return (
        (label == "error")
        & head.rlike(UNI_I + V.INFO_TAG)
        & head.rlike(UNI_I + V.ZERO_COUNTER)
        & ~fault_word(head)
    )


def grade(df: DataFrame) -> DataFrame:
    """Add label, body, downgraded, escalated, effective and collect_only.

    Expects ``severity`` and ``message``.  The regular expressions are evaluated once per row:
    each step is its own projection, which Catalyst keeps apart where a result is reused.
    """
    levels = df.withColumn("label", label_of(F.col("severity"))).withColumn(
        "body", body_level(F.col("message"))
    )
    rank, body_rank = level_rank(F.col("label")), level_rank(F.col("body"))
    routes = levels.withColumn(
        "downgraded",
        F.col("body").isNotNull()
        & F.col("body").isin(V.COLLECTABLE_BODY_LEVELS)
        & (rank > body_rank)
        & ~fault_word(cut(F.col("message"), V.MAX_STORED_MESSAGE)),
    ).withColumn(
        "escalated",
        F.col("body").isNotNull()
        & F.col("body").isin(V.ESCALATING_BODY_LEVELS)
        & (rank < body_rank),
    )
    graded = routes.withColumn(
        "effective",
        F.when(F.col("downgraded") | F.col("escalated"), F.col("body"))
        .when(F.col("label") != "", F.col("label"))
        .otherwise("unknown"),
    )
    return graded.withColumn(
        "collect_only", F.col("effective").isin(V.COLLECTED_SEVERITIES) & ~F.col("escalated")
    )


def effective_or_label(effective: Column, severity: Column) -> Column:
    """Reporting severity: the effective one if set and known, else the label."""
    return F.when(
        F.coalesce(effective, F.lit("")).isin("", "unknown"), F.lower(severity)
    ).otherwise(F.lower(effective))


def triage_class(severity: Column) -> Column:
    """Routing hint for a page: critical must go out, error may, the rest stays silent."""
    return (
        F.when(severity == "critical", "must_send")
        .when(severity == "error", "candidate")
        .otherwise("silent")
    )
