"""The keyed state of a stream as a table, read from its checkpoint by Spark's state readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.clock import SECOND
from emberlog.functions.text import cut as cut_text
from emberlog.operators.throttle import NONE
from emberlog.streaming.gate import BucketRule, ClassRule, StormRule, unpack


def keys_of(spark: SparkSession, progress: str, rule: type[BucketRule], operator: int) -> DataFrame:
    """One row per key that the rule holds after the last finished micro-batch: its key as bytes, and its numbers.

    ``progress`` is the checkpoint of the stream, ``operator`` the place of the rule in it.  A stream without state
    gives no rows.  Buckets are read in parallel, one at a time by a task.
    """
    fields = rule.fields

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stored in frame.itertuples(index=False):
                keys, numbers, _ = unpack(tuple(stored), len(fields))
                held = {name: pd.array(np.where(column == NONE, 0, column), "Int64") for name, column in zip(fields, numbers.T)}
                for name, column in zip(fields, numbers.T):
                    held[name][column == NONE] = pd.NA
                yield pd.DataFrame({rule.key: keys, **held})

    buckets = (
        spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "state").load(progress)
        .select("value.keys", "value.sizes", "value.numbers", "value.due")
    )
    schema = f"{rule.key} binary, " + ", ".join(f"`{name}` bigint" for name in fields)
    return buckets.mapInPandas(spread, schema)


def gate_state(spark: SparkSession, progress: str, audit: DataFrame, now_us: int, class_operator: int = 0, storm_operator: int = 1) -> DataFrame:
    """What the streaming gate knows of every fingerprint and class seen in the 24 h before ``now_us``.

    The columns are those of the batch snapshot.  State holds ids and no text; ``audit`` (id, message) gives the samples,
    and only their rows are met.
    """
    since = now_us - V.STATE_RETENTION_S * SECOND
    fine = keys_of(spark, progress, StormRule, storm_operator).select(
        F.lit("fingerprint").alias("layer"), F.lower(F.hex("fingerprint")).alias("key"), F.col("opened").alias("window_started_us"),
        F.col("seen").alias("last_seen_us"), F.col("count").alias("events_in_window"), F.lit(0).cast("bigint").alias("events_total"),
        F.col("sent").alias("last_agent_sent_us"),
        F.when(F.col("count") >= V.STORM_THRESHOLD, F.col("sent")).alias("last_storm_sent_us"), "sample_id",
    )
    coarse = keys_of(spark, progress, ClassRule, class_operator).select(
        F.lit("class").alias("layer"), F.lower(F.hex("class_key")).alias("key"), F.col("window").alias("window_started_us"),
        F.col("seen").alias("last_seen_us"), F.col("count").alias("events_in_window"), F.col("total").alias("events_total"),
        F.col("sent").alias("last_agent_sent_us"), F.col("storm").alias("last_storm_sent_us"), "sample_id",
    )
    held = fine.unionByName(coarse).filter(F.col("last_seen_us") >= since)
    text = audit.select(F.col("id").alias("sample_id"), cut_text(F.col("message"), V.MAX_FORWARDED_MESSAGE).alias("sample_message"))
    return held.join(text, "sample_id").drop("sample_id")
