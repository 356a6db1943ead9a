"""The sliced operators against one-row-at-a-time folds, over random keys with hot ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.operators import gate
from emberlog.operators.slices import Heat, lay_out
from emberlog.operators.throttle import NONE, Steps, Stretch, throttle
from tests import steps as rules

GAPS = [0, 1, 1000, 10**6, 5 * 10**6, 40 * 10**6, 60 * 10**6, 60 * 10**6 + 1, 120 * 10**6, 200 * 10**6, 300 * 10**6]


def random_rows(seed, keys=8, hot=1500):
    rnd = random.Random(seed)
    rows = []
    for k in range(keys):
        t = rnd.randrange(10**9)
        for _ in range(hot if k == 0 else rnd.randrange(1, 200)):
            t += rnd.choice(GAPS)
            if rnd.random() < 0.01:
                t += rnd.choice([3600 * 10**6, 86_400 * 10**6, 86_400 * 10**6 + 1])
            rows.append((len(rows), t, f"k{k}", rnd.random() < 0.02, rnd.random() < 0.1, rnd.choice([120, 300]) * 10**6))
    rnd.shuffle(rows)  # arrival order in the table must not matter
    return rows


HEATS = [Heat(), Heat(rows=3), Heat(rows=20), Heat(rows=100), Heat(rows=0)]


@pytest.mark.parametrize("heat", HEATS, ids=str)
def test_throttle_equals_fold(spark, heat):
    rows = random_rows(heat.rows)
    df = spark.createDataFrame(rows, "id long, us long, key string, forced boolean, inert boolean, cooldown long")
    laid = lay_out(df, "key", heat)
    assert (laid.rows.filter("slice <> -1").count() > 0) == (heat.rows < 1500)
    judged = throttle(laid, F.col("cooldown"), F.col("forced"), F.col("inert"))
    got = {r.id: r for r in judged.collect()}
    assert len(got) == len(rows)
    last = {}
    for row_id, us, key, forced, inert, cooldown in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        anchor = last.get(key)
        accept = not inert and (forced or anchor is None or us - anchor[0] >= cooldown)
        if accept:
            last[key] = (us, row_id, 1)
        elif anchor:
            last[key] = (anchor[0], anchor[1], anchor[2] + 1)
        row = got[row_id]
        assert row.accepted == accept
        if key in last:
            assert (row.anchor_us, row.anchor_id, row.position) == last[key]
        else:
            assert row.anchor_us is None


@pytest.mark.parametrize("heat", HEATS[:4], ids=str)
@pytest.mark.parametrize("batch", [23, 10_000])
def test_layers_equal_single_steps(spark, heat, batch):
    rows = random_rows(heat.rows + batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame([r[:3] for r in rows], "id long, us long, key string")
        keys = df.select(
            "id", "us", F.col("key").alias("fingerprint"), F.col("key").alias("class_key"),
            F.lit(False).alias("collect_only"), F.lit("error").alias("effective"),
            F.lit(None).cast("string").alias("exit"), F.lit(None).cast("string").alias("exit_reason"),
        )
        storms = {r.id: r for r in gate.storm_gate(gate.laid_out(keys, heat)).collect()}
        classes = {r.id: r for r in gate.class_gate(keys.select("id", "us", "class_key"), heat).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    storm, klass = {}, {}
    for row_id, us, key, *_ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        storm[key], status, send = rules.storm_step(storm.get(key), us)
        got = storms[row_id]
        assert (got.storm_status, got.survives, got.storm_count, got.sent_us) == (
            status, send, storm[key]["count"], storm[key]["sent"])
        klass[key], note, paged = rules.class_step(klass.get(key), us)
        got = classes[row_id]
        assert (got.note, got.paged, got.events_window, got.events_total, got.sent_us, got.window_us) == (
            note, paged, klass[key]["count"], klass[key]["total"], klass[key]["sent"], klass[key]["window"])


def test_summaries_compose():
    """Applying the summaries of two halves equals applying the summary of the whole."""
    rnd = np.random.default_rng(4)
    for _ in range(200):
        n = int(rnd.integers(2, 40))
        us = np.cumsum(rnd.integers(0, 50, n)).astype(np.int64)
        ids = np.arange(n, dtype=np.int64)
        cooldown = rnd.choice([30, 70], n).astype(np.int64)
        forced = rnd.random(n) < 0.1
        inert = ~forced & (rnd.random(n) < 0.2)

        def summary(a, b):
            starts = np.arange(b - a) == 0
            return Stretch(us[a:b], cooldown[a:b], forced[a:b], inert[a:b], starts).summaries(ids[a:b])[0]

        k = int(rnd.integers(1, n))
        whole, parts = summary(0, n), summary(0, k).then(summary(k, n))
        for last in [NONE, *range(int(us[0]) - 100, int(us[0]) + 1)]:
            state = (int(last), -1, 5)
            assert whole.apply(state) == parts.apply(state)
            assert whole.apply(state) == summary(k, n).apply(summary(0, k).apply(state))


def test_summary_is_small_for_a_dense_key():
    """What a slice hands on is bounded by the rows of one cooldown, not by the rows of the slice."""
    us = np.arange(0, 3600 * 10**6, 20_000, dtype=np.int64)  # 180,000 rows in one hour
    n = len(us)
    flags = np.zeros(n, dtype=bool)
    stretch = Stretch(us, np.full(n, 120 * 10**6, dtype=np.int64), flags, flags, np.arange(n) == 0)
    (steps,) = stretch.summaries(np.arange(n, dtype=np.int64))
    assert isinstance(steps, Steps)
    assert len(steps.upto) <= 6001
    assert pa.array(steps.upto).nbytes < 100_000
