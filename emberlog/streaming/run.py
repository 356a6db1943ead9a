"""Running streams over files to their end."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import IntegerType, StructField, StructType

from emberlog.session import work_path
from emberlog.sources.audit_store import quarantine


def write_in_order(rows: DataFrame, time: str, bounds: list[int], path: str, files: int = 1) -> None:
    """Store rows as segments in time order, one write per segment, as rolled log files arrive.

    One pass deals all rows to their segments; then every segment is read alone and dealt evenly over ``files`` files, written in
    parallel.  A stream that takes so many at once gets whole segments.  Where there are bounds, rows without a time are in no segment."""
    dealt = work_path(rows.sparkSession, "dealt")
    number = F.lit(sum((F.col(time) >= bound).cast("int") for bound in bounds))
    rows.withColumn("__segment", number).filter(F.col("__segment").isNotNull()).write.partitionBy("__segment").parquet(dealt)
    stored = rows.sparkSession.read.schema(StructType([*rows.schema, StructField("__segment", IntegerType())])).parquet(dealt)
    for k in range(len(bounds) + 1):
        stored.filter(F.col("__segment") == k).drop("__segment").repartition(files).write.mode("append").parquet(path)


def read_segments(spark: SparkSession, path: str, schema, files_per_batch: int = 1, bytes_per_batch: int | None = None) -> DataFrame:
    """Stream of stored segments; their number, or their bytes, bound a micro-batch."""
    bound = ("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else ("maxBytesPerTrigger", bytes_per_batch)
    return spark.readStream.schema(schema).option(bound[0], str(bound[1])).parquet(path)


def run_to_end(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Process everything that is there, append it to a table, and read the table."""
    spark = stream.sparkSession
    out = out or work_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or work_path(spark, name + "-progress"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str, checkpoint: str | None = None) -> None:
    """Process everything that is there, one call per micro-batch."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or work_path(stream.sparkSession, name + "-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class FailureBreadcrumbs(StreamingQueryListener):
    """Appends a breadcrumb line when a stream ends with an error, or when rows come behind the watermark, so that silence is noticed."""

    def __init__(self, spark: SparkSession, path: str, stage: str = "stream"):
        self.spark, self.path, self.stage = spark, path, stage

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)
        if late:
            self._leave(f"{late} rows behind the watermark were dropped")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._leave(event.exception)

    def _leave(self, reason: str) -> None:
        rows = self.spark.createDataFrame([(int(time.time() * 1_000_000), reason)], "received_us long, reason string")
        lines = quarantine(rows, self.stage, F.col("reason"))
        lines.select("value").coalesce(1).write.mode("append").text(self.path)
