"""The observation review: one report over a fixed window, as figures and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.clock import SECOND, local_label
from emberlog.operators import audit as A
from emberlog.operators.digest import fill
from emberlog.session import cut


def breadcrumb_summary(breadcrumbs: DataFrame, since_us: int) -> DataFrame:
    """Number of failures since the mark and the text of the last one."""
    rows = breadcrumbs.filter(F.col("at_s") >= since_us / SECOND)
    return rows.agg(
        F.count(F.lit(1)).alias("failures"),
        F.substring(F.max_by("value", F.struct("at_s", "value")), 1, 150).alias("last"),
    )


def review(audit: DataFrame, since_us: int, now_us: int) -> DataFrame:
    """The review's figures as (section, item, value) rows.

    Every section is a small aggregate of the window; nothing but aggregates leaves the scan.
    """
    window = A.since(audit, since_us)

    def figures(section: str, row: DataFrame) -> DataFrame:
        names = row.columns
        return row.select(
            F.lit(section).alias("section"),
            F.explode(
                F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in names])
            ).alias("l"),
        ).select("section", "l.item", "l.value")

    tally = A.severity_tally(window).select(
        F.lit("severity").alias("section"), F.col("severity").alias("item"),
        F.col("n").cast("double").alias("value"),
    )
    hours = A.hourly_profile(window)
    cooled = A.top_cooled(window)
    return (
        tally.unionByName(figures("dispatch", A.dispatch_totals(window, since_us, now_us)))
        .unionByName(figures("class", A.class_decision_counts(window)))
        .unionByName(figures("mislabel", A.mislabel_counts(window)))
        .unionByName(
            cooled.select(
                F.lit("cooled").alias("section"), F.col("suppression_reason").alias("item"),
                F.col("n").cast("double").alias("value"),
            )
        )
        .unionByName(
            hours.select(
                F.lit("hour_events").alias("section"), F.col("hour").alias("item"),
                F.col("events").cast("double").alias("value"),
            )
        )
        .unionByName(
            hours.select(
                F.lit("hour_dispatched").alias("section"), F.col("hour").alias("item"),
                F.col("dispatched").cast("double").alias("value"),
            )
        )
    )


def hours_between(since_us: int, now_us: int) -> float:
    return max((now_us - since_us) / SECOND / 3600.0, 0.1)


def _section(section: int, rows: DataFrame, text: Column, part=None) -> DataFrame:
    part = F.lit(0) if part is None else part
    return rows.select(F.lit(section).alias("section"), part.cast("int").alias("part"), text.alias("text"))


def _whole(number: Column) -> Column:
    return F.bround(number).cast("bigint")


def head_lines(spark, since_us: int, now_us: int, title: str) -> DataFrame:
    hours = f"{hours_between(since_us, now_us):.1f}"
    label = lambda us: local_label(F.lit(us), V.LOCAL_ZONE)
    one = spark.range(1)
    window = fill(V.R_WINDOW, since=label(since_us), now=label(now_us), hours=F.lit(hours))
    return _section(1, one, F.lit(title)).unionByName(_section(2, one, window))


def store_lines(audit: DataFrame, since_us: int, now_us: int) -> DataFrame:
    """The lines that the audit table gives.  One pass makes the tally and all counts."""
    window = A.since(audit, since_us)
    counts = cut(A.window_counts(window))
    c = F.col
    tally = counts.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-c("n")).alias("o"), "severity", "n"))),
        lambda s: F.concat_ws("=", s["severity"], s["n"].cast("string"))), ", ").alias("tally"))
    names = ["n", "dispatched", "info_as_error", "warning_as_error", "zero_counter", "escalated",
             "class_new", "cooldown_expired", "storm_summary", "cooled"]
    sums = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    per_day = _whole(c("dispatched") * 24 / F.lit(hours_between(since_us, now_us)))
    fixed = F.array(
        fill(V.R_DISPATCH, dispatched=c("dispatched"), events=c("n"), per_day=per_day, baseline=F.lit(V.BASELINE_CALLS), target=F.lit(V.TARGET_CALLS)),
        fill(V.R_CLASSES, new=c("class_new"), expired=c("cooldown_expired"), burst=c("storm_summary"), cooled=c("cooled")),
        fill(V.R_MISLABEL, info=c("info_as_error"), warn=c("warning_as_error"), zero=c("zero_counter"), escalated=c("escalated")),
        F.lit(""), F.lit(V.R_COOLED_HEAD),
    )
    cooled = A.cooled_samples(window)
    order = Window.orderBy(F.desc("n"), "suppression_reason")
    hours = A.hourly_profile(window)
    number = lambda n: F.lpad(c(n).cast("string"), F.greatest(F.lit(3), F.length(c(n).cast("string"))), F.lit(" "))
    spark = audit.sparkSession
    return (
        _section(3, tally, fill(V.R_TALLY, tally=c("tally")))
        .unionByName(sums.select(F.posexplode(fixed).alias("part", "text")).select(F.lit(4).alias("section"), "part", "text"))
        .unionByName(_section(5, cooled, fill(V.R_COOLED, n=c("n"), reason=c("suppression_reason"), sample=c("sample")), F.row_number().over(order)))
        .unionByName(_section(6, spark.range(1), F.lit("")))
        .unionByName(_section(7, spark.range(1), F.lit(V.R_HOURS_HEAD)))
        .unionByName(_section(8, hours, fill(V.R_HOUR, hour=c("hour"), events=number("events"), dispatched=number("dispatched")), F.row_number().over(Window.orderBy("hour"))))
    )


def usage_lines(cost: DataFrame) -> DataFrame:
    """Calls, tokens and cost, and their rates a day beside baseline and target."""
    c = F.col
    lines = F.array(
        F.lit(""),
        fill(V.R_USAGE, calls=c("calls"), input=F.format_number("input_tokens", 0), cache=F.format_number("cache_read_tokens", 0),
             output=F.format_number("output_tokens", 0), cost=F.format_string("%.3f", c("cost"))),
        fill(V.R_USAGE_RATE, daily=c("calls_per_day").cast("bigint"), daily_cost=F.format_string("%.2f", c("cost_per_day")),
             baseline=F.lit(f"{V.BASELINE_COST:.2f}"), target=F.lit(f"{V.TARGET_COST:.2f}")),
    )
    return cost.select(F.posexplode(lines).alias("part", "text")).select(F.lit(9).alias("section"), "part", "text")


def breadcrumb_lines(summary: DataFrame) -> DataFrame:
    last = F.when(F.col("failures") > 0, fill(V.R_LAST, last=F.col("last"))).otherwise("")
    lines = F.array(F.lit(""), fill(V.R_BREADCRUMBS, n=F.col("failures"), last=last))
    return summary.select(F.posexplode(lines).alias("part", "text")).select(F.lit(10).alias("section"), "part", "text")


def failed_line(spark, section: int, text: str, error: str) -> DataFrame:
    """What stands for a section whose source cannot be read."""
    return _section(section, spark.range(1), F.lit(text.replace("{error}", error)))


def numbered(sections: list[DataFrame]) -> DataFrame:
    """Sections as (line_no, text) rows; some thirty lines are left by now."""
    lines = sections[0]
    for section in sections[1:]:
        lines = lines.unionByName(section)
    return lines.select(F.row_number().over(Window.orderBy("section", "part")).alias("line_no"), "text")


def report(audit: DataFrame, since_us: int, now_us: int, usage: DataFrame | None = None, breadcrumbs: DataFrame | None = None, title: str = "TRIAL_REVIEW") -> DataFrame:
    """The review as text.  ``audit_store.run_review`` makes the same with a guard for each source."""
    sections = [head_lines(audit.sparkSession, since_us, now_us, title), store_lines(audit, since_us, now_us)]
    if usage is not None:
        sections.append(usage_lines(A.usage_cost(usage, since_us, hours_between(since_us, now_us))))
    if breadcrumbs is not None:
        sections.append(breadcrumb_lines(breadcrumb_summary(breadcrumbs, since_us)))
    return numbered(sections)
