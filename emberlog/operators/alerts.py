"""Text of an alert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.source import component_of, source_field
from emberlog.functions.text import cut, redact, strip


def alert_fields(pages: DataFrame) -> DataFrame:
    """Fixed lines of an alert: everything but the model's own sentence."""
    source = F.col("source")
    severity = F.col("effective_severity")
    or_unlabelled = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(V.UNLABELLED))
    title = F.when(severity == "critical", V.ALERT_TITLE["critical"]).when(
        severity == "warning", V.ALERT_TITLE["warning"]
    ).otherwise(V.ALERT_TITLE["error"])
    component = component_of(F.col("message"))
    return pages.select(
        "id",
        F.concat_ws(
            "\n",
            title,
            F.concat(F.lit("主机："), F.col("host")),
            F.concat(F.lit("项目："), or_unlabelled(source_field(source, "project"))),
            F.concat(
                F.lit("程序："), or_unlabelled(source_field(source, "program")),
                F.when(component != "", F.concat(F.lit("｜分量："), component)).otherwise(""),
            ),
            F.concat(F.lit("文件："), or_unlabelled(source_field(source, "log_file"))),
            F.when(
                F.col("storm_count") > 1,
                F.concat(
                    F.lit("风暴："), F.col("storm_window_seconds").cast("string"), F.lit(" 秒内同类日志 "),
                    F.col("storm_count").cast("string"), F.lit(" 条"),
                ),
            ),
            F.concat(F.lit("摘要："), cut(redact(F.replace(strip(F.col("message")), F.lit("\n"), F.lit(" "))), 300)),
            F.concat(F.lit("事件 ID："), F.col("incident_id")),
        ).alias("alert"),
    )
