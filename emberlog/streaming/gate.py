"""The gate and the throttle on streams: keyed state in ``transformWithStateInPandas``.

State is forgotten on event time, so a replay of the same rows gives the same verdicts: the rule
compares times itself, and a timer on the watermark only frees the state of quiet keys.  State and rows go by
buckets of keys, judged by the array operations of the batch form; bound the micro-batch by bytes or files.
The state store has to be RocksDB, as ``build_session`` sets it.

No row is lost behind the watermark: the marked time column does not go into the operator, so Spark has nothing to
drop by, and the rule itself tells late rows, which come out with ``late`` set and without a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog import fixed_values as V
from emberlog.functions.clock import utc_timestamp
from emberlog.operators import gate, gateway
from emberlog.operators.throttle import NONE, Stretch
from emberlog.session import ROCKSDB

SECOND = 1_000_000
FORGET = V.STATE_RETENTION_S * SECOND

BUCKETS = 64         # of keys; a few for each task of the cluster, and the same for the life of a checkpoint


def use_rocksdb(spark: SparkSession) -> None:
    """For a session that was not made by ``build_session``: keep keyed state on disk, with incremental checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class BucketRule(StatefulProcessor):
    """Runs one rule over the times of all keys of a bucket in (us, id) order; all other columns pass untouched.

    The state of a bucket is one value: its keys' bytes, and a row of numbers for each key.  A micro-batch reads it once, judges
    all rows of the bucket by array operations, and writes it once.  One timer per bucket is due when its quietest key
    is to be forgotten.  Rows of a lane (a bucket below 0) do not reach the rule: no state, no order.

    Where ``tells_late`` is set, rows behind the watermark of the micro-batch come out first, marked as late; they change no state."""

    key = ""
    fields: list[str] = []     # of a key's state; the first is the time that forgetting goes by
    added: list[str] = []
    forget_us = FORGET
    tells_late = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            for frame in rows:
                yield self.unjudged(frame, False)
            return
        frame = pd.concat(list(rows), ignore_index=True)
        if self.tells_late:
            late = frame["us"].to_numpy(np.int64) < timerValues.getCurrentWatermarkInMs() * 1000
            if late.any():
                yield self.unjudged(frame[late], True)
                frame = frame[~late].reset_index(drop=True)
            if frame.empty:
                return
        code, names = pd.factorize(frame[self.key])
        order = np.lexsort((frame["id"].to_numpy(), frame["us"].to_numpy(), code))
        frame, code = frame.iloc[order].reset_index(drop=True), code[order]
        names = [n.encode() if isinstance(n, str) else bytes(n) for n in names]
        known, numbers, due = unpack(self.state.get(), len(self.fields))
        place = pd.Index(known, dtype=object).get_indexer(pd.Index(names, dtype=object)) if known else np.full(len(names), -1)
        before = np.full((len(names), len(self.fields)), NONE)
        before[place >= 0] = numbers[place[place >= 0]]
        starts = np.append(True, code[1:] != code[:-1])
        columns, after = self.judge(frame, starts, before)
        if self.tells_late:
            frame = frame.assign(late=False)
        yield frame.assign(**dict(zip(self.added, columns)))
        numbers[place[place >= 0]] = after[place >= 0]
        new = np.flatnonzero(place < 0)
        self.keep(known + [names[i] for i in new], np.concatenate([numbers, after[new]]), timerValues, due)

    def unjudged(self, frame: pd.DataFrame, late: bool) -> pd.DataFrame:
        """Rows as they came, with nothing in the added columns."""
        if self.tells_late:
            frame = frame.assign(late=late)
        return frame.assign(**{c: None for c in self.added})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, numbers, due = unpack(self.state.get(), len(self.fields))
        if due <= expiredTimerInfo.getExpiryTimeInMs():
            due = 0
        self.keep(known, numbers, timerValues, due)
        return iter([])

    def keep(self, names: list[bytes], numbers: np.ndarray, timerValues, due: int) -> None:
        """Store the state of the keys that are not to be forgotten yet, with a timer if none is set."""
        alive = numbers[:, 0] + self.forget_us >= timerValues.getCurrentWatermarkInMs() * 1000
        if not alive.any():
            self.state.clear()
            return
        names, numbers = [n for n, a in zip(names, alive) if a], numbers[alive]
        if not due:
            due = int(numbers[:, 0].min() + self.forget_us) // 1000 + 1
            self.handle.registerTimer(due)
        sizes = np.array([len(n) for n in names], np.int32)
        self.state.update((b"".join(names), sizes.tobytes(), numbers.tobytes(), due))

    def judge(self, frame: pd.DataFrame, starts: np.ndarray, before: np.ndarray) -> tuple[list, np.ndarray]:
        """The added columns, and the state of each key after its rows.  ``before`` is ``NONE`` for new keys."""
        raise NotImplementedError

    def close(self) -> None:
        pass


STATE = "keys binary, sizes binary, numbers binary, due bigint"


def unpack(stored, fields: int) -> tuple[list[bytes], np.ndarray, int]:
    """Keys, their numbers, and when the bucket's timer is due."""
    if stored is None:
        return [], np.zeros((0, fields), np.int64), 0
    data, sizes, numbers, due = bytes(stored[0]), np.frombuffer(stored[1], np.int32), np.frombuffer(stored[2], np.int64), int(stored[3])
    ends = np.cumsum(sizes)
    return [data[e - n:e] for e, n in zip(ends, sizes)], numbers.reshape(-1, fields).copy(), due


def _since(us: np.ndarray, starts: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time since the key's row before, and which rows begin anew: the first of a key, or of one that is forgotten."""
    group = np.cumsum(starts) - 1
    last = np.append(0, us[:-1])
    first = np.flatnonzero(starts)
    last[first] = np.where(seen == NONE, us[first], seen)
    fresh = us - last > FORGET
    fresh[first] |= seen[group[first]] == NONE
    return us - last, fresh


def _counted(begins: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """1, 2, ... from each row of ``begins`` on; a key whose first row does not begin goes on from ``before``."""
    rows = np.arange(len(starts))
    at = np.maximum.accumulate(np.where(begins | starts, rows, 0))
    return rows - at + 1 + np.where(begins[at], 0, before[np.cumsum(starts) - 1])


def _last(values: np.ndarray, which: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For every row, ``values`` at the key's last row so far in ``which``, or ``before``."""
    rows = np.arange(len(starts))
    at = np.maximum.accumulate(np.where(which | starts, rows, 0))
    return np.where(which[at], values[at], before[np.cumsum(starts) - 1])


def _accept(us, cooldown, forced, inert, starts, last) -> np.ndarray:
    return Stretch(us, np.broadcast_to(np.asarray(cooldown, np.int64), us.shape), forced, inert, starts).run(last)


class StormRule(BucketRule):
    key = "fingerprint"
    fields = ["seen", "count", "sent", "opened", "sample_id"]
    added = ["storm_count", "storm_status", "survives"]
    tells_late = True

    def judge(self, frame, starts, before):
        us, ids, (seen, count0, sent0, opened0, sample0) = frame["us"].to_numpy(np.int64), frame["id"].to_numpy(np.int64), before.T
        gap, fresh = _since(us, starts, seen)
        opens = fresh | (gap > V.STORM_GAP_S * SECOND)
        count = _counted(opens, starts, count0)
        storm = count >= V.STORM_THRESHOLD
        cooldown = np.where(storm, V.STORM_SUMMARY_S, V.REPEAT_SUMMARY_S) * SECOND
        send = _accept(us, cooldown, fresh | (count == V.STORM_THRESHOLD), np.zeros(len(us), bool), starts, sent0)
        status = np.where(fresh, V.FIRST_SEEN, np.where(storm, np.where(send, V.STORM, V.STORM_HELD), np.where(send, V.REPEAT, V.DUPLICATE)))
        ends = np.append(np.flatnonzero(starts)[1:], len(us)) - 1
        after = [us, count, _last(us, send, starts, sent0), _last(us, opens, starts, opened0), _last(ids, opens, starts, sample0)]
        return [count, status, send], np.stack(after, 1)[ends]


class ClassRule(BucketRule):
    key = "class_key"
    fields = ["seen", "window", "count", "total", "sent", "storm", "sample_id"]
    added = ["note", "paged"]

    def judge(self, frame, starts, before):
        us, (seen, window0, count0, total0, sent0, storm0, _) = frame["us"].to_numpy(np.int64), before.T
        none = np.zeros(len(us), bool)
        _, fresh = _since(us, starts, seen)
        opens = _accept(us, V.CLASS_STORM_WINDOW_S * SECOND + 1, fresh, none, starts, window0)
        count = _counted(opens, starts, count0)
        burst = _accept(us, V.CLASS_STORM_COOLDOWN_S * SECOND, none, (count < V.CLASS_STORM_N) | fresh, starts, storm0)
        paged = _accept(us, V.CLASS_COOLDOWN_S * SECOND, fresh | burst, none, starts, sent0)
        note = np.where(fresh, "class_new", np.where(burst, "class_storm_summary", np.where(paged, "class_cooldown_expired", "class_cooldown")))
        ends = np.append(np.flatnonzero(starts)[1:], len(us)) - 1
        storm = np.where(_last(us, burst | fresh, starts, storm0) == _last(us, burst, starts, storm0), _last(us, burst, starts, storm0), NONE)
        after = [us, _last(us, opens, starts, window0), count, _counted(fresh, starts, total0), _last(us, paged, starts, sent0), storm, frame["id"].to_numpy(np.int64)]
        return [note, paged], np.stack(after, 1)[ends]


class ThrottleRule(BucketRule):
    key = "fingerprint"
    fields = ["us", "id"]
    forget_us = V.GATEWAY_RETENTION_S * 1_000_000
    added = ["accepted", "accepted_id"]
    tells_late = True

    def judge(self, frame, starts, before):
        us, ids, none = frame["us"].to_numpy(np.int64), frame["id"].to_numpy(np.int64), np.zeros(len(frame), bool)
        cooldown = frame["cooldown"].to_numpy(np.int64)
        accepted = _accept(us, cooldown, cooldown == 0, none, starts, before[:, 0])
        accepted_id = _last(ids, accepted, starts, before[:, 1])
        ends = np.append(np.flatnonzero(starts)[1:], len(us)) - 1
        return [accepted, accepted_id], np.stack([_last(us, accepted, starts, before[:, 0]), accepted_id], 1)[ends]


ROWS = (
    "id bigint, received_us bigint, incident_id string, host string, source string, severity string, timestamp string, message string, "
    "us bigint, fingerprint binary, class_key binary, collect_only boolean, effective string, exit string, exit_reason string, "
    "bucket int"
)
STORM_OUT = ROWS + ", late boolean, storm_count bigint, storm_status string, survives boolean"


def _bucketed(rows: DataFrame, reaches, key, buckets: int) -> DataFrame:
    """Rows that reach a rule go by the hash of its key; the others are spread evenly, a lane for each partition of the shuffle."""
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.when(reaches, F.pmod(F.xxhash64(key), F.lit(buckets))).otherwise(-1 - F.pmod(F.col("id"), F.lit(lanes)))
    return rows.withColumn("bucket", bucket.cast("int"))


def _clocked(rows: DataFrame, delay: str) -> DataFrame:
    """Rows whose times move the watermark; without the marked column, so that late ones are not dropped."""
    return rows.withColumn("__at", utc_timestamp(F.col("us"))).withWatermark("__at", delay).drop("__at")


def stream_storms(events: DataFrame, delay: str = "10 minutes", rules: gate.GateRules = gate.GateRules(), buckets: int = BUCKETS) -> DataFrame:
    """Fingerprint layer on a stream of gate input, text included; rows with an early exit pass without a verdict.

    ``delay`` should cover the disorder of the source: rows behind the watermark come out as ``late``, without a verdict.
    """
    rows = _clocked(gate.judged_rows(events, rules), delay)
    return _bucketed(rows, F.col("exit").isNull(), "fingerprint", buckets).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=StormRule(),
        outputStructType=STORM_OUT,
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_gate(events: DataFrame, delay: str = "10 minutes", rules: gate.GateRules = gate.GateRules(), buckets: int = BUCKETS) -> DataFrame:
    """The audit rows of a stream of gate input, those of early exits included, and ``late``.

    A late row has no verdict: it is for quarantine and not for the audit table, as ``audit_store.write_judged`` stores them.
    """
    storm = stream_storms(events, delay, rules, buckets)
    reaches = F.col("survives") & ~F.col("collect_only") & F.col("class_key").isNotNull()
    layered = _bucketed(storm, F.coalesce(reaches, F.lit(False)), "class_key", buckets).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=ClassRule(),
        outputStructType=STORM_OUT + ", note string, paged boolean",
        outputMode="Append",
        timeMode="EventTime",
    )
    dispatched, effective, reason = gate.outcome()
    early = F.col("exit").isNotNull()
    return layered.select(
        "id", "received_us", "incident_id", "host", "source", "severity", F.col("timestamp").alias("event_timestamp"), "message",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.coalesce("storm_count", F.lit(1)).cast("bigint").alias("storm_count"),
        F.lit(V.STORM_GAP_S).alias("storm_window_seconds"),
        F.coalesce("storm_status", "exit").alias("storm_status"),
        F.when(early | F.col("late"), 0).otherwise(dispatched).alias("llm_dispatched"),
        effective, F.when(early, F.col("exit_reason")).otherwise(reason).alias("suppression_reason"), "late",
    )


def stream_throttle(received: DataFrame, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Gateway throttle on a stream of received bodies: id, accepted, accepted_id; both null and ``late`` set behind the watermark."""
    rows = _clocked(
        received.filter(F.col("ok") & F.col("enabled"))
        .select("id", "us", "fingerprint", gateway.cooldown_us(F.col("severity")).alias("cooldown"),
                F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int").alias("bucket")),
        delay,
    )
    judged = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=ThrottleRule(),
        outputStructType="id bigint, us bigint, fingerprint string, cooldown bigint, bucket int, late boolean, accepted boolean, accepted_id bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return judged.select("id", "accepted", "accepted_id", "late")


def stream_dedupe(signed: DataFrame, horizon: str = "24 hours") -> DataFrame:
    """Drop repeats of a signed event id that arrive within the horizon."""
    return (
        signed.withColumn("received_at", utc_timestamp(F.col("received_us")))
        .withWatermark("received_at", horizon)
        .dropDuplicatesWithinWatermark(["svix_id"])
    )


def stream_sessions(keys: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Closed storm runs: rows of a key with gaps up to 60 s, with their start and size.

    A row exactly 60 s after the last one still joins a session window, as the rule wants.
    """
    rows = keys.withColumn("received_at", utc_timestamp(F.col("us"))).withWatermark("received_at", delay)
    gap = f"{V.STORM_GAP_S} seconds"
    return (
        rows.groupBy("fingerprint", F.session_window("received_at", gap).alias("run"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
        .drop("run")
    )
