"""Reports over the audit table: tallies, decision counts, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.clock import SECOND, hour_label, utc_date
from emberlog.functions.severity import effective_or_label
from emberlog.functions.text import cut as cut_text


def since(audit: DataFrame, since_us: int, exclusive: bool = False) -> DataFrame:
    """Rows from ``since_us`` on; that very microsecond belongs to them unless ``exclusive``.

    A table stored by date also gets the date bound, so whole partitions are skipped.
    """
    at = F.col("received_us")
    rows = audit.filter(at > since_us if exclusive else at >= since_us)
    if "received_date" in audit.columns:
        rows = rows.filter(F.col("received_date") >= utc_date(F.lit(since_us)))
    return rows


def reporting_severity() -> Column:
    return effective_or_label(F.col("effective_severity"), F.col("severity"))


def collected(audit: DataFrame) -> DataFrame:
    """Rows whose reporting severity belongs to the digest."""
    return audit.filter(reporting_severity().isin(V.COLLECTED_SEVERITIES))


def severity_tally(audit: DataFrame) -> DataFrame:
    return (
        audit.groupBy(reporting_severity().alias("severity"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "severity")
    )


def _mislabels() -> list[Column]:
    reason, label = F.col("suppression_reason"), F.lower("severity")
    raised = F.lower(F.coalesce("effective_severity", F.lit(""))).isin(V.ESCALATING_BODY_LEVELS)
    return [
        F.count_if(reason.startswith("body_tag_info_collector_")).alias("info_as_error"),
        F.count_if(reason.startswith("body_tag_warning_collector_")).alias("warning_as_error"),
        F.count_if(reason == V.COUNTER_REASON).alias("zero_counter"),
        F.count_if(label.isin(V.COLLECTED_SEVERITIES) & raised).alias("escalated"),
    ]


def _class_decisions() -> list[Column]:
    reason = F.col("suppression_reason")
    return [
        F.count_if(reason.startswith(prefix + ":")).alias(name)
        for name, prefix in (
            ("class_new", "class_new"),
            ("cooldown_expired", "class_cooldown_expired"),
            ("storm_summary", "class_storm_summary"),
            ("cooled", "class_cooldown"),
        )
    ]


def mislabel_counts(audit: DataFrame) -> DataFrame:
    return audit.agg(*_mislabels())


def class_decision_counts(audit: DataFrame) -> DataFrame:
    return audit.agg(*_class_decisions())


def window_counts(audit: DataFrame, more: list[str] = [], *figures: Column) -> DataFrame:
    """Tally, mislabels and class decisions in one pass, one row per severity (and ``more`` columns), with ``figures`` besides."""
    return audit.groupBy(reporting_severity().alias("severity"), *more).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("llm_dispatched").alias("dispatched"),
        *_mislabels(),
        *_class_decisions(),
        *figures,
    )


def dispatch_totals(audit: DataFrame, since_us: int, now_us: int) -> DataFrame:
    """Pages sent, events seen and pages per day, beside the baseline and the target."""
    hours = max((now_us - since_us) / SECOND / 3600.0, 0.1)
    return audit.agg(
        F.coalesce(F.sum("llm_dispatched"), F.lit(0)).alias("dispatched"),
        F.count(F.lit(1)).alias("events"),
    ).select(
        "dispatched",
        "events",
        (F.col("dispatched") * 24 / F.lit(hours)).alias("per_day"),
        F.lit(V.BASELINE_CALLS).alias("baseline_per_day"),
        F.lit(V.TARGET_CALLS).alias("target_per_day"),
    )


def hourly_profile(audit: DataFrame, hours: int = V.REVIEW_HOURS) -> DataFrame:
    return (
        audit.groupBy(hour_label(F.col("received_us")).alias("hour"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("llm_dispatched").alias("dispatched"))
        .orderBy("hour")
        .limit(hours)
    )


def cooled_samples(window: DataFrame, top: int = V.REVIEW_TOP_REASONS) -> DataFrame:
    """The reasons that silenced most events in ``window``, each with the message of its earliest row there.

    Counts, first time and first id come from numbers alone; only the few reasons kept fetch a message.
    """
    rows = window.filter(F.col("suppression_reason").startswith("class_cooldown:"))
    leaders = (
        rows.groupBy("suppression_reason")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("received_us", "id")).alias("first"))
        .orderBy(F.desc("n"), "suppression_reason")
        .limit(top)
    )
    first = leaders.select("suppression_reason", "n", F.col("first.id").alias("id"))
    return rows.select("id", "message").join(F.broadcast(first), "id").select(
        "suppression_reason", "n", F.replace(cut_text(F.col("message"), 120), F.lit("\n"), F.lit(" ")).alias("sample")
    )


def top_cooled(audit: DataFrame, top: int = V.REVIEW_TOP_REASONS) -> DataFrame:
    return (
        audit.filter(F.col("suppression_reason").startswith("class_cooldown:"))
        .groupBy("suppression_reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "suppression_reason")
        .limit(top)
    )


def usage_cost(sessions: DataFrame, since_us: int, hours: float = V.DIGEST_HOURS) -> DataFrame:
    """Calls, tokens and cost of webhook sessions since the mark, per call and per day."""
    rows = sessions.filter(
        F.lower("source").contains("webhook")
        & (F.col("started_at").try_cast("double") >= F.lit(since_us / SECOND))
    )
    totals = rows.agg(
        F.count(F.lit(1)).alias("calls"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("input_tokens", "output_tokens", "cache_read_tokens")
        ],
    )
    million = F.lit(1e6)
    cost = (
        F.col("input_tokens") / million * V.PRICE_INPUT
        + F.col("output_tokens") / million * V.PRICE_OUTPUT
        + F.col("cache_read_tokens") / million * V.PRICE_CACHE
    )
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens")
    per_call = F.nullif("calls", F.lit(0))
    return totals.withColumn("cost", cost).select(
        "calls", "input_tokens", "output_tokens", "cache_read_tokens", "cost",
        (tokens / per_call).alias("tokens_per_call"),
        (F.col("cost") / per_call).alias("cost_per_call"),
        (F.col("calls") * 24 / F.lit(float(hours))).alias("calls_per_day"),
        (F.col("cost") * 24 / F.lit(float(hours))).alias("cost_per_day"),
    )


def lost_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replay check: classes the old gate paged that the new one never pages; must be empty."""
    return (
        old.filter(F.col("llm_dispatched") == 1)
        .select("class_key")
        .distinct()
        .join(new.filter(F.col("llm_dispatched") == 1).select("class_key").distinct(), "class_key", "left_anti")
    )


def with_defaults(audit: DataFrame) -> DataFrame:
    """An older audit file lacks the last two columns: unknown severity, empty reason."""
    for name, default in (("effective_severity", "unknown"), ("suppression_reason", "")):
        value = F.coalesce(F.col(name), F.lit(default)) if name in audit.columns else F.lit(default)
        audit = audit.withColumn(name, value)
    return audit
