"""Log files, breadcrumbs, the allow-list and usage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_log_files(
    spark: SparkSession, root: str, suffix: str = ".log", stream: bool = False,
    modified_after: str | None = None, max_files: int | None = None,
) -> DataFrame:
    """Lines of every file below ``root`` that ends in ``suffix``: (value, path).

    A file source reads whole closed files, so a stream takes rolled segments; ``modified_after``
    stands for "start at the end" and ``max_files`` bounds one micro-batch.
    """
    reader = (spark.readStream if stream else spark.read).format("text")
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    if modified_after and not stream:
        reader = reader.option("modifiedAfter", modified_after)
    if max_files and stream:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    lines = reader.load(root).select("value", F.col("_metadata.file_path").alias("path"),
                                     F.col("_metadata.file_modification_time").alias("modified"))
    if modified_after and stream:
        lines = lines.filter(F.col("modified") > F.lit(modified_after).cast("timestamp"))
    return lines.drop("modified")


def load_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """(project, program, enabled) rows; an empty list of projects is an error.

    Read it again in every micro-batch: an edit then holds from the next batch on.
    """
    schema = "projects map<string, struct<programs: map<string, boolean>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    rows = (
        doc.select(F.explode("projects").alias("project", "settings"))
        .select("project", F.explode("settings.programs").alias("program", "enabled"))
    )
    if doc.filter(F.size("projects") > 0).isEmpty():
        raise ValueError("projects must not be empty")
    return rows


def parse_breadcrumbs(lines: DataFrame) -> DataFrame:
    """Add at_s (epoch seconds, null if the line does not start with a number), stage, detail, fields."""
    parts = F.split("value", "\t")
    return (
        lines.withColumn("parts", parts)
        .withColumn("fields", F.size("parts"))
        .withColumn(
            "at_s",
            F.when(
                F.replace(F.get("parts", F.lit(0)), F.lit("."), F.lit("")).rlike(r"\A[0-9]+\z"),
                F.get("parts", F.lit(0)).try_cast("double"),
            ),
        )
        .withColumn("stage", F.get("parts", F.lit(1)))
        .withColumn("detail", F.get("parts", F.lit(2)))
        .drop("parts")
    )


def scan_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage sessions: source, started_at, input_tokens, output_tokens, cache_read_tokens."""
    return spark.read.parquet(path).select(
        "source", "started_at", "input_tokens", "output_tokens", "cache_read_tokens"
    )


def scan_usage_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """The same table in another database, read over JDBC."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
