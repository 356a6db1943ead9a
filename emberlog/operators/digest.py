"""The daily digest: clusters of collected events, ranked and fitted to a text budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.clock import local_label
from emberlog.functions.source import component_of, log_file_of, source_field, stable_file
from emberlog.functions.text import cut as cut_text
from emberlog.functions.text import sample_text, strip, template_key
from emberlog.operators.audit import collected, since, usage_cost, window_counts
from emberlog.session import cut

CLUSTER_KEY = ["host", "project", "program", "stable_file", "template"]


def cluster_rows(audit: DataFrame) -> DataFrame:
    """Collected rows with the parts a cluster is keyed by, and their digest."""
    rows = collected(audit)
    fields = {name: source_field(F.col("source"), name) for name in ("project", "program", "log_file")}
    return (
        rows.withColumns(fields)
        .withColumn("host", F.coalesce(F.nullif("host", F.lit("")), F.lit("?")))
        .withColumn("stable_file", stable_file(F.col("log_file")))
        .withColumn("template", template_key(F.coalesce("message", F.lit(""))))
    )


def keyed_rows(audit: DataFrame, more: list[str] = []) -> DataFrame:
    """What a cluster's figures need, without text: the key as two hashes, time, id, and ``more`` columns."""
    parts = [F.col(c) for c in CLUSTER_KEY]
    return cut(cluster_rows(audit).select(
        F.xxhash64(*parts).alias("k1"), F.xxhash64(*reversed(parts)).alias("k2"), *more, "received_us", "id",
        F.coalesce("storm_count", F.lit(0)).cast("bigint").alias("storm_count"),
        (strip(F.col("message")) != "").alias("said"),
    ))


def counted(keyed: DataFrame, key: list[str] = ["k1", "k2"]) -> DataFrame:
    """One narrow row per cluster: counts, times, and the ids and times of its first row and of its first row with text.

    Group keys and buffers are numbers of fixed width, so this is a hash aggregate whatever the messages hold.
    The least (time, id) is the least time first and then the least id at that time.
    """
    grouped = keyed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("received_us").alias("first_us"), F.max("received_us").alias("last_us"),
        F.max("storm_count").alias("max_count"), F.min(F.when(F.col("said"), F.col("received_us"))).alias("said_us"),
    )
    at_start = (F.col("received_us") == F.col("first_us"))
    at_text = F.col("said") & (F.col("received_us") == F.col("said_us"))
    ids = keyed.join(grouped.select(*key, "first_us", "said_us"), key).filter(at_start | at_text).groupBy(*key).agg(
        F.min(F.when(at_start, F.col("id"))).alias("first_id"), F.min(F.when(at_text, F.col("id"))).alias("sample_id"))
    return grouped.join(ids, key)


def with_text(counts: DataFrame, audit: DataFrame) -> DataFrame:
    """Clusters with their key, first source and masked sample: two rows of the audit table for each."""
    wanted = counts.select("k1", "k2", F.explode(F.array_compact(F.array_distinct(F.array("first_id", "sample_id")))).alias("id"))
    rows = cluster_rows(audit.join(wanted, "id")).groupBy("k1", "k2")
    rows = rows.agg(F.collect_list(F.struct("id", *CLUSTER_KEY, "log_file", "source", "message")).alias("rows"))
    row = lambda name: F.get(F.filter("rows", lambda r: r["id"] == F.col(name)), F.lit(0))
    shown = counts.join(rows, ["k1", "k2"]).withColumns({"first": row("first_id"), "told": row("sample_id")})
    return shown.select(
        *[F.col(f"first.{c}").alias(c) for c in CLUSTER_KEY], "n", "first_us", "last_us", "first_id", "max_count",
        sample_text(F.coalesce("told.message", F.lit(""))).alias("sample"), F.col("first.log_file").alias("log_file"),
        raw_source("first.").alias("raw_source"),
    )


def raw_source(row: str = "") -> Column:
    """The source as it came, cut, where it names neither project nor program."""
    bare = (F.col(f"{row}project") == "") & (F.col(f"{row}program") == "")
    return F.when(bare, cut_text(F.coalesce(f"{row}source", F.lit("")), 60)).otherwise("")


def clusters(audit: DataFrame) -> DataFrame:
    """One row per cluster, with its text."""
    return with_text(counted(keyed_rows(audit)), audit)


def top_clusters(audit: DataFrame, top: int = V.MAX_CLUSTERS) -> tuple[DataFrame, DataFrame]:
    """(all clusters in numbers, the largest ones ranked with their text): only those fetch and mask a sample."""
    counts = cut(counted(keyed_rows(audit)))
    few = cut(ranked(counts, top))
    return counts, with_text(few, audit).join(few.select("first_id", "rank"), "first_id")


def cluster_statuses(audit: DataFrame) -> DataFrame:
    """How often each storm status occurs in a cluster; at most seven entries per cluster."""
    counts = (
        cluster_rows(audit).groupBy(*CLUSTER_KEY, "storm_status").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy(*CLUSTER_KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("storm_status", "n")))).alias("statuses")
    )


def totals(clustered: DataFrame) -> DataFrame:
    return clustered.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("warnings"), F.count(F.lit(1)).alias("clusters")
    )


def ranked(clustered: DataFrame, top: int = V.MAX_CLUSTERS) -> DataFrame:
    """The largest clusters with their rank; ties by first appearance.

    The limit comes first, so the ranking window sees only the rows kept.
    """
    order = [F.desc("n"), F.asc("first_us"), F.asc("first_id")]
    return clustered.orderBy(*order).limit(top).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order))
    )


def header_line() -> Column:
    component = component_of(F.col("sample"))
    program = F.coalesce(
        F.nullif(F.col("program"), F.lit("")), F.nullif(component, F.lit("")), F.lit(V.UNLABELLED)
    )
    path = F.coalesce(F.nullif(F.col("log_file"), F.lit("")), log_file_of(F.col("sample")))

    def field(name: str, value: Column, shown: Column | None = None) -> Column:
        return F.when((value != "") & (F.lit(True) if shown is None else shown), F.concat(F.lit(name + "="), value))

    return F.concat_ws(
        " | ",
        F.format_string("[%d] %d 条", F.col("rank"), F.col("n")),
        F.concat(F.lit("程序="), program),
        field("项目", F.col("project")),
        field("分量", component, component != program),
        field("文件", path),
        F.concat(F.lit("host="), F.col("host")),
        field("来源", F.col("raw_source")),
        F.concat(local_label(F.col("first_us"), V.LOCAL_ZONE), F.lit(" → "), local_label(F.col("last_us"), V.LOCAL_ZONE)),
    )


def blocks(top: DataFrame, budget: int = V.CLUSTER_BUDGET) -> DataFrame:
    """Three text lines per cluster, as many clusters as fit the budget in rank order.

    Every block costs its length plus one per line; the running cost only grows, so keeping the
    rows within the budget is the same as stopping at the first that does not fit.
    """
    lines = (
        top.withColumn("header", header_line())
        .withColumn("sample_line", F.concat(F.lit("    样例: "), F.col("sample")))
        .withColumn(
            "template_line",
            F.concat(F.lit("    (日志模板: "), cut_text(F.col("template"), V.MAX_TEMPLATE), F.lit(")")),
        )
    )
    cost = F.length("header") + F.length("sample_line") + F.length("template_line") + 3
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        lines.withColumn("cost", cost)
        .withColumn("spent", F.sum("cost").over(running))
        .filter(F.col("spent") <= budget)
    )


def fill(text: str, **values: Column) -> Column:
    """A fixed line with named places filled in by columns."""
    parts, rest = [], text
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def failures_since(breadcrumbs: DataFrame, since_us: int) -> DataFrame:
    """Breadcrumbs from the mark on, with the text shown for each."""
    return breadcrumbs.filter(
        F.col("at_s").isNotNull() & (F.col("fields") >= 3) & (F.col("at_s") >= since_us / 1_000_000)
    ).withColumn(
        "text", F.concat(F.lit("guard "), F.col("stage"), F.lit(" during "), cut_text(F.col("detail"), 160))
    )


def first_failures(failures: DataFrame, top: int = V.MAX_WATCHDOG_LINES) -> DataFrame:
    """The texts of the first failures, by time and then by line: (nth, text)."""
    order = [F.asc("at_s"), F.asc("value")]
    return failures.orderBy(*order).limit(top).select(F.row_number().over(Window.orderBy(*order)).alias("nth"), "text")


def unreadable_breadcrumbs(spark, error: str) -> DataFrame:
    text = V.D_BREADCRUMBS_FAILED.replace("{error}", error)
    return spark.range(1).select(F.lit(1).alias("nth"), F.lit(text).alias("text"))


def report(
    audit: DataFrame,
    since_us: int,
    now_us: int,
    usage: DataFrame | None = None,
    breadcrumbs: DataFrame | None = None,
    title: str = "DAILY_DIGEST",
    exclusive_since: bool = False,
) -> DataFrame:
    """The digest as (line_no, text) rows, from the audit table, usage sessions and parsed breadcrumbs."""
    cost = None if usage is None else usage_cost(usage, since_us)
    failures = None if breadcrumbs is None else first_failures(failures_since(breadcrumbs, since_us))
    return report_lines(audit, since_us, now_us, cost, failures, title, exclusive_since)


def window_figures(window: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a digest is made of: tallies by severity, all clusters in numbers, the largest ones with their text."""
    counts = cut(window_counts(window))
    return counts, *top_clusters(window)


def report_lines(
    audit: DataFrame,
    since_us: int,
    now_us: int,
    cost: DataFrame | None = None,
    failures: DataFrame | None = None,
    title: str = "DAILY_DIGEST",
    exclusive_since: bool = False,
    figures: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The digest as (line_no, text) rows; ``cost`` and ``failures`` are small results.

    ``figures`` are those of ``window_figures``, where they were found in another way than from the window's rows.

    The mark is the time of the newest row reported, and the bound includes it, so that row is
    reported twice; ``exclusive_since`` leaves it out.

    Every line is made from its own small aggregate; the sections are put together by union and
    numbered at the end, when at most about a hundred rows are left.
    """
    counts, clustered, few = figures or window_figures(since(audit, since_us, exclusive_since))
    top = cut(blocks(few))
    parts = [
        _one(audit.sparkSession, 1, title),
        counts.agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "severity", "n"))),
                    lambda s: F.concat_ws("=", s["severity"], s["n"].cast("string")),
                ),
                ", ",
            ).alias("tally")
        ).select(
            F.lit(2).alias("section"), F.lit(0).alias("part"),
            fill(
                V.D_WINDOW,
                since=local_label(F.lit(since_us), V.LOCAL_ZONE),
                now=local_label(F.lit(now_us), V.LOCAL_ZONE),
                tally=F.when(F.col("tally") == "", "0").otherwise(F.col("tally")),
            ).alias("text"),
        ),
        totals(clustered).select(
            F.lit(3).alias("section"), F.lit(0).alias("part"),
            fill(V.D_TOTALS, warnings=F.col("warnings"), clusters=F.col("clusters")).alias("text"),
        ),
    ]
    names = ["info_as_error", "warning_as_error", "zero_counter", "escalated",
             "class_new", "cooldown_expired", "storm_summary", "cooled"]
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    c = {n: F.col(n) for n in names}
    optional = F.array(
        F.struct(
            F.lit(4).alias("section"),
            (c["info_as_error"] + c["warning_as_error"] + c["zero_counter"] + c["escalated"] > 0).alias("shown"),
            fill(V.D_MISLABEL, info=c["info_as_error"], warn=c["warning_as_error"], zero=c["zero_counter"]).alias("text"),
        ),
        F.struct(
            F.lit(5).alias("section"),
            (c["escalated"] > 0).alias("shown"),
            fill(V.D_ESCALATED, escalated=c["escalated"]).alias("text"),
        ),
        F.struct(
            F.lit(6).alias("section"),
            (c["class_new"] + c["cooldown_expired"] + c["storm_summary"] + c["cooled"] > 0).alias("shown"),
            fill(
                V.D_CLASSES, new=c["class_new"], expired=c["cooldown_expired"],
                burst=c["storm_summary"], cooled=c["cooled"],
            ).alias("text"),
        ),
    )
    parts.append(
        sums.select(F.explode(optional).alias("l")).filter("l.shown").select(
            F.col("l.section").alias("section"), F.lit(0).alias("part"), F.col("l.text").alias("text")
        )
    )
    if cost is not None:
        parts.append(_usage_lines(cost))
    if failures is not None:
        parts.append(_watchdog_lines(failures))
    parts.append(_one(audit.sparkSession, 10, V.D_NOTES))
    parts.append(_one(audit.sparkSession, 11, ""))
    parts.append(
        top.select(
            F.lit(12).alias("section"), "rank",
            F.posexplode(F.array("header", "sample_line", "template_line")).alias("part", "text"),
        ).select("section", (F.col("rank") * 3 + F.col("part")).alias("part"), "text")
    )
    rest = (
        clustered.agg(F.count(F.lit(1)).alias("all"), F.lit(0).cast("bigint").alias("listed"))
        .union(top.agg(F.lit(0).cast("bigint").alias("all"), F.count(F.lit(1)).alias("listed")))
        .agg(F.sum("all").alias("all"), F.sum("listed").alias("listed"))
    )
    parts.append(
        rest.filter(F.col("listed") < F.col("all")).select(
            F.lit(13).alias("section"), F.lit(0).alias("part"),
            fill(V.D_UNLISTED, rest=F.col("all") - F.col("listed"), listed=F.col("listed")).alias("text"),
        )
    )
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines.select(
        F.row_number().over(Window.orderBy("section", "part")).alias("line_no"), "text"
    )


def _one(spark, section: int, text: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(section).alias("section"), F.lit(0).alias("part"), F.lit(text).alias("text")
    )


def _usage_lines(cost: DataFrame) -> DataFrame:
    lines = F.array(
        F.struct(
            F.lit(True).alias("shown"),
            fill(
                V.D_USAGE, calls=F.col("calls"), input=F.format_number("input_tokens", 0),
                cache=F.format_number("cache_read_tokens", 0), output=F.format_number("output_tokens", 0),
                cost=F.format_string("%.3f", F.col("cost")),
            ).alias("text"),
        ),
        F.struct(
            (F.col("calls") > 0).alias("shown"),
            fill(
                V.D_USAGE_RATE,
                tokens=F.bround(F.col("tokens_per_call")).cast("bigint"),
                each=F.format_string("%.5f", F.col("cost_per_call")),
                daily=F.col("calls_per_day").cast("bigint"),
                daily_cost=F.format_string("%.2f", F.col("cost_per_day")),
            ).alias("text"),
        ),
    )
    return cost.select(F.posexplode(lines).alias("part", "l")).filter("l.shown").select(
        F.lit(7).alias("section"), "part", F.col("l.text").alias("text")
    )


def _watchdog_lines(first: DataFrame) -> DataFrame:
    shown = first.select(
        F.lit(8).alias("section"), F.col("nth").alias("part"), F.concat(F.lit(V.D_WATCHDOG_MARK), F.col("text")).alias("text")
    )
    frame = first.limit(1).select(
        F.explode(
            F.array(
                F.struct(F.lit(8).alias("section"), F.lit(0).alias("part"), F.lit(V.D_WATCHDOG_HEAD).alias("text")),
                F.struct(F.lit(9).alias("section"), F.lit(0).alias("part"), F.lit(V.D_WATCHDOG_TAIL).alias("text")),
            )
        ).alias("l")
    ).select("l.*")
    return shown.unionByName(frame)


def is_silent(totals_row: DataFrame, failures: DataFrame) -> DataFrame:
    """One row with silent = no collected rows and no failure; nothing is sent then."""
    return (
        totals_row.select("warnings", F.lit(0).cast("bigint").alias("failures"))
        .unionByName(failures.agg(F.lit(0).cast("bigint").alias("warnings"), F.count(F.lit(1)).alias("failures")))
        .agg(F.sum("warnings").alias("warnings"), F.sum("failures").alias("failures"))
        .withColumn("silent", (F.col("warnings") == 0) & (F.col("failures") == 0))
    )


def next_mark(audit: DataFrame, since_us: int, now_us: int) -> DataFrame:
    """The mark after a run: the newest collected row, or one minute before now if later."""
    return mark_after(collected(since(audit, since_us)).agg(F.max("received_us").alias("newest_us")), since_us, now_us)


def mark_after(newest: DataFrame, since_us: int, now_us: int) -> DataFrame:
    """The same from the time of the newest collected row: (newest_us), in one row or several."""
    return newest.agg(F.greatest(F.coalesce(F.max("newest_us"), F.lit(since_us)), F.lit(now_us - 60_000_000)).alias("mark_us"))


def unreadable_report(error: str, title: str = "DAILY_DIGEST") -> list[str]:
    """Fixed lines for an audit table that cannot be read; the mark stays where it is."""
    return [title, *[line.replace("{error}", error) for line in V.D_UNREADABLE]]
