"""Files that grow under a running stream: no line twice, none lost, bounded micro-batches."""

import os

import numpy as np
import pandas as pd
import pytest

from emberlog.session import work_path
from emberlog.sources import tail
from emberlog.streaming import gate as SG
from tests.steps import class_step, storm_step, throttle_step


def append(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as file:
        file.write(data)


def take(stream, out, progress):
    query = stream.writeStream.format("parquet").option("checkpointLocation", progress).start(out)
    query.processAllAvailable()
    batches = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    return batches


def local(path):
    return path.removeprefix("file:")


def test_growing_files(spark):
    root, out, progress, notes = (local(work_path(spark, n)) for n in ("logs", "out", "progress", "notes"))
    append(f"{root}/a/old.log", b"before the start\nstill writ")
    append(f"{root}/other.txt", b"not a log\n")
    stream = lambda: tail.tail_log_files(spark, root, bytes_per_batch=60, progress=notes)
    assert take(stream(), out, progress) == []
    append(f"{root}/a/old.log", b"ten\nnext\r\nhalf")
    append(f"{root}/b/new.log", "é first\n\nthird\n".encode() + b"x" * 500 + b"\nlast\n")
    assert len(take(stream(), out, progress)) >= 2
    append(f"{root}/a/old.log", b" a line\n")
    take(stream(), out, progress)                      # after a restart
    with open(f"{root}/b/new.log", "wb") as file:
        file.write(b"rotated\n")
    take(stream(), out, progress)
    got = sorted((os.path.basename(r.path), r.value) for r in spark.read.parquet(out).collect())
    assert got == sorted([("old.log", "still written"), ("old.log", "next"), ("old.log", "half a line"), ("new.log", "é first"), ("new.log", ""), ("new.log", "third"),
                          ("new.log", "x" * 500), ("new.log", "last"), ("new.log", "rotated")])


def test_whole_files_and_no_files(spark):
    root, out, progress = (local(work_path(spark, n)) for n in ("logs", "out", "progress"))
    stream = lambda: tail.tail_log_files(spark, root, from_end=False)
    assert take(stream(), out, progress) == []
    append(f"{root}/a.log", b"one\ntwo\n")
    take(stream(), out, progress)
    assert sorted((r.value, r.at) for r in spark.read.parquet(out).collect()) == [("one", 0), ("two", 4)]


def test_stretches_split_at_line_ends(tmp_path, monkeypatch):
    data = b"".join(b"line %d " % i + b"y" * (i * 7 % 50) + b"\n" for i in range(200))
    append(str(tmp_path / "a.log"), data)
    reader = tail.TailReader({"root": str(tmp_path), "fromend": "false"})
    for split in (1, 10, 64, 1000, 10**6):
        monkeypatch.setattr(tail, "SPLIT", split)
        parts = reader.partitions({}, reader.latestOffset())
        got = [x for p in parts for b in reader.read(p) for x in zip(b["at"].to_pylist(), b["value"].to_pylist())]
        assert [v for _, v in got] == data.decode().split("\n")[:-1]
        assert all(data[a:a + len(v)].decode() == v for a, v in got)


# --- rules on buckets of keys against one row at a time


class Timers:
    def getCurrentWatermarkInMs(self):
        return 0


def judged(rule, frames):
    """The rule's rows over micro-batches, its state carried as the processor stores it."""
    stored, out = [None], []

    class Value:
        get = staticmethod(lambda: stored[0])
        update = staticmethod(lambda v: stored.__setitem__(0, v))
        clear = staticmethod(lambda: stored.__setitem__(0, None))

    class Handle:
        getValueState = staticmethod(lambda *a: Value)
        registerTimer = staticmethod(lambda due: None)

    rule.init(Handle)
    for frame in frames:
        out += [f for f in rule.handleInputRows((0,), iter([frame]), Timers())]
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("seed", range(12))
def test_bucket_rules_equal_steps(seed):
    rng = np.random.default_rng(seed)
    n, second = 600, 1_000_000
    gaps = rng.choice([0, 1, 20, 59, 60, 61, 119, 120, 299, 300, 301, 899, 3600, 86_400, 90_000], n, p=[0.2, 0.2, 0.2] + [0.4 / 12] * 12)
    frame = pd.DataFrame({"id": rng.permutation(n), "us": 1_704_067_200 * second + np.cumsum(gaps) * second // 2, "key": rng.choice(["a", "bb", "c\x00", "dd\n"], n, p=[0.7, 0.1, 0.1, 0.1])})
    frame["fingerprint"] = frame["class_key"] = [k.encode() for k in frame["key"]]
    frame["cooldown"] = rng.choice([0, 900, 1800], n) * second
    cuts = sorted(rng.integers(0, n, 5))
    frames = [frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, n]) if b > a]

    def slow(step, *columns):
        state, out = {}, {}
        for row in frame.sort_values(["us", "id"]).itertuples():
            state[row.key], *verdict = step(state.get(row.key), row.us, *[getattr(row, c) for c in columns])
            out[row.id] = (state[row.key], *verdict)
        return out

    # rows of equal time go by id within a micro-batch, so a cut between them is not compared
    frames = [frame] if frame["us"].duplicated().any() and seed % 2 else frames
    if len(frames) > 1:
        frame["us"] = frame["us"] + np.arange(n)
        frames = [frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, n]) if b > a]
    want = slow(storm_step)
    for r in judged(SG.StormRule(), frames).itertuples():
        assert (r.storm_count, r.storm_status, r.survives) == (want[r.id][0]["count"], want[r.id][1], want[r.id][2])
    want = slow(class_step)
    for r in judged(SG.ClassRule(), frames).itertuples():
        assert (r.note, r.paged) == want[r.id][1:]
    want = slow(throttle_step, "id", "cooldown")
    for r in judged(SG.ThrottleRule(), frames).itertuples():
        assert (r.accepted, r.accepted_id) == (want[r.id][1], want[r.id][0]["id"])
