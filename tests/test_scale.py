"""Work that must not be done twice a row, and tasks that must not grow with a table."""

import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions import keys
from emberlog.functions.severity import fault_word
from emberlog.functions.source import detect_dll, program_from_source
from emberlog.functions.text import SPACES, UNI, UNI_I, strip
from emberlog.llm import pieces
from emberlog.llm.common import utf8
from emberlog.operators import gate, gateway
from emberlog.plans import testbed as tb
from emberlog.session import COMPILED_BYTES, METHOD_LIMIT, cut, work_path
from emberlog.sources import tail
from emberlog.streaming.run import write_in_order


def given_events(spark, rows):
    folder = work_path(spark, "given")
    start = datetime.datetime(2024, 1, 1)
    data = [(i, start + datetime.timedelta(minutes=i), i % 7, "error", 1.0, '{"k": %d}' % i) for i in range(rows)]
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(data, kind).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_filters_leave_the_parse_alone(spark):
    """A filter on parsed columns was pushed below the parse and took copies of it along."""
    raw = spark.createDataFrame([(0, 0, '{"source": "/logs/A/x.log", "message": "m"}'), (1, 0, None), (2, 0, "plain")], "id long, received_us long, raw string")
    allow = spark.createDataFrame([("p", "A", True), ("p", "B", False)], "project string, program string, enabled boolean")
    kept = gateway.receive(raw, allow).filter("ok AND enabled").select("id", "program")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapType(StringType,VariantType") == 1
    assert [tuple(r) for r in kept.collect()] == [(0, "A")]
    assert sorted(r.id for r in gateway.receive(raw, allow).collect()) == [0, 1, 2]


def test_events_are_derived_in_many_tasks(spark, monkeypatch):
    """All events of a file that is a single split were derived in one task."""
    monkeypatch.setattr(tb, "TASK_ROWS", 10)
    log = tb.derive_log_events(spark, given_events(spark, 300))
    sizes = [r["count"] for r in log.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 25 and sum(sizes) == 300 and max(sizes) <= 40


def test_segments_are_dealt_in_one_pass(spark):
    """Every segment was filtered out of all rows again, so that the rows were worked out once for each."""
    seen = spark.sparkContext.accumulator(0)

    def at(number):
        seen.add(1)
        return None if number == 7 else number

    rows = spark.range(100).select("id", F.udf(at, "long").asNondeterministic()("id").alias("at"))
    path = work_path(spark, "in-order")
    write_in_order(rows, "at", [25, 50, 75], path, 2)
    assert seen.value == 100
    stored = spark.read.parquet(path)
    assert sorted(r.id for r in stored.collect()) == [i for i in range(100) if i != 7]
    spans = stored.groupBy(F.input_file_name().alias("file")).agg(F.min(F.floor(F.col("at") / 25)).alias("a"), F.max(F.floor(F.col("at") / 25)).alias("b")).collect()
    assert len(spans) == 8 and all(r.a == r.b for r in spans)


def test_short_stretches_share_a_task(spark, tmp_path):
    """Every file of a micro-batch had a task of its own, however little was taken from it."""
    for k in range(40):
        (tmp_path / f"{k:02}.log").write_bytes(b"line %d\n" % k * (k + 1))
    reader = tail.TailReader({"root": str(tmp_path), "fromend": "false"})
    shares = reader.partitions({}, reader.latestOffset())
    assert 1 < len(shares) < 5
    lines = [line for share in shares for batch in reader.read(share) for line in batch.column(0).to_pylist()]
    assert sorted(lines) == sorted(f"line {k}" for k in range(40) for _ in range(k + 1))


def test_only_pieces_that_overlap_themselves_are_sorted():
    """The places of every piece were sorted in every batch; only a piece that ends as it begins needs that."""
    from sentencepiece import SentencePieceProcessor

    vocabulary = pieces.Vocabulary.load()
    encoder = pieces.Encoder(vocabulary)
    texts = [vocabulary.data[vocabulary.first[i]:vocabulary.first[i + 1]].tobytes() for i in vocabulary.merges]
    assert encoder.overlaps.tolist() == [any(t[k:] == t[:-k] for k in range(1, len(t))) for t in texts]
    assert 0 < encoder.overlaps.sum() < len(texts) // 10
    lines = ["a" * 23, "=" * 41 + " " + "=" * 7, "-=-=-=-=-", "0" * 9 + "1" + "0" * 8, "ananananas lalalala", "hahaha " * 5, " " * 17 + "x", "......,,,,,,......"]
    ids, first = encoder.texts(*utf8(pa.array(lines)))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == SentencePieceProcessor(model_file=pieces.MODEL).encode(lines)


def test_verdicts_run_as_compiled_code(spark, monkeypatch):
    """The gate's verdicts were one generated method, too long for the JVM to compile, so every row went through its interpreter."""
    rows = gate.verdict_rows(tb.gate_input(spark, given_events(spark, 40)))
    limits, checkpoint = [], type(rows).checkpoint

    def watched(df, *args, **kwargs):
        limits.append(int(spark.conf.get(METHOD_LIMIT)))
        return checkpoint(df, *args, **kwargs)

    monkeypatch.setattr(type(rows), "checkpoint", watched)
    before = spark.conf.get(METHOD_LIMIT)
    assert cut(rows).count() == 40
    assert limits == [COMPILED_BYTES] and spark.conf.get(METHOD_LIMIT) == before


def test_places_and_names_are_looked_for_once(spark):
    """A path was resolved in a condition and again for its result; every message was searched for whole library names, every text for
    white space at all its positions."""
    marks = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in marks] + [(None,), (" 　\t",)], "t string")
    by_pattern = F.regexp_replace("t", UNI + r"\A" + SPACES + "|" + SPACES + r"\z", "")
    assert rows.filter(~strip(F.col("t")).eqNullSafe(by_pattern)).count() == 0
    data = [("/logs/A/x", "in q.DLL"), ("/x/../logs//B/./y/", "a.dllx b"), ("logs/A/x", "c.dll_"), (None, None), ("/logs/A/..", ".dll"), ("/logs/..", "é.dll")]
    given = spark.createDataFrame(data, "p string, m string")
    found = given.select(program_from_source(F.col("p")).alias("p"), detect_dll(F.col("m")).alias("m"))
    assert [tuple(r) for r in found.collect()] == [
        ("A", "q.DLL"), ("B", ""), ("unknown", ""), ("unknown", None), ("unknown", ""), ("unknown", ""),
    ]
    plan = given.select(program_from_source(F.col("p")).alias("a"), strip(F.col("p")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and "regexp_replace" not in plan


def test_symbols_are_listed(spark):
    """The set of symbols that a class's words are cleaned of was written in ranges, which Java asks one after the other."""
    assert "a-z" not in keys._SKELETON_OTHER and "0-9" not in keys._SKELETON_OTHER
    marks = spark.createDataFrame([(chr(c),) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000], "t string")
    listed, ranges = (F.regexp_replace("t", p, "#") for p in (keys._SKELETON_OTHER, V.SKELETON_OTHER))
    assert marks.filter(listed != ranges).count() == 0
    lines = ["it Failed", "timed out", "refusedx", "x-crashed.", "TRACEBACK", "Unhealthy", "ok", "", "denied_", "exception", "panic!", "fatal"]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(fault_word(F.col("t")), F.col("t").rlike(UNI_I + V.FAULT_WORD))
    assert all(a == b for a, b in got.collect())
