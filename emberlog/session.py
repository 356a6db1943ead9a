"""Session helpers: settings, the shared folder, and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "emberlog", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings this package is written for; the caller's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    }
    for name, value in {**defaults, **settings}.items():
        builder = builder.config(name, str(value))
    return builder.getOrCreate()


_own: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master without that setting, as in tests, gets a folder of its own, which goes when the program ends.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own.append(tempfile.TemporaryDirectory(prefix="emberlog-", ignore_cleanup_errors=True))
        sc.setCheckpointDir(_own[-1].name)
    return sc.getCheckpointDir()


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = 8000       # of a method's code; a longer one the JVM leaves to its interpreter


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """What runs in here is compiled by the JVM: a stage whose generated method would be too long for that, which Spark's own
    limit allows, runs operator by operator instead.  The session's setting comes back afterwards."""
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    A frame that is read several times is computed once, and a lost executor costs a re-read,
    not a recomputation.
    """
    shared_folder(df.sparkSession)
    with compiled(df.sparkSession):
        return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
