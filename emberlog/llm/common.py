"""Helpers that the operators share: tables, row names, word hashes over Arrow text, components."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import session
from emberlog.session import shared_folder, work_path  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 4 << 20                      # bytes of text that array code handles at once
HASHED = 1 << 18                     # bytes whose running sums are held at once
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession, wait: bool = False) -> None:
    """Let go of what finished steps left on the executors' disks.

    Spark removes shuffle files once the driver has collected the frames that made them; on its own that may
    take until the next half hour, while a job of many steps fills the disks.  With ``wait``, a second at most is spent until
    the JVM knows which frames Python has dropped: before a step that needs much disk itself.
    """
    gc.collect()
    dropped = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    end = time.monotonic() + 1.5 * wait
    while dropped and time.monotonic() < end:
        time.sleep(0.05)
    spark.sparkContext._jvm.java.lang.System.gc()


def cut(df: DataFrame, wait: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder, go on from there, and free the shuffles that led to it."""
    done, spark = session.cut(df), df.sparkSession
    del df
    release(spark, wait)
    return done


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder.  Its size is known then, so Spark decides by that whether a join broadcasts it."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    """A-Z to lower case, other letters as they are."""
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def bare(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; others, whatever they are called, stay out of the operator's way."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as set it apart from the columns of ``df``."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
        used.add(name.lower())
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow text column; a null text has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind, step = (np.int64, 8) if wide else (np.int32, 4)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * step).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of rows with up to ``size`` bytes of text, or one longer row."""
    for batch in batches:
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def byte_table(inside) -> np.ndarray:
    """256 flags: which bytes belong to a word."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Lower-case A-Z, all else unchanged.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words are runs without space and the controls 9 to 13.
SPACED = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
#: Words are runs of a-z, 0-9 and bytes of other alphabets (after folding).
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULT
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if n not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for b in (_BASE, inverse):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _powers[n] = (both[0], both[1])
    return _powers[n]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that follow each other, from running sums of bytes times powers."""
    out = np.empty(len(start), np.uint64)
    low = 0
    while low < len(out):
        base = start[low]
        high = max(low + 1, int(np.searchsorted(end, base + HASHED, "right")))
        size = int(end[high - 1] - base)
        up, down = _power(HASHED + 1) if size <= HASHED else _power(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((raw[base:base + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        s, e = start[low:high] - base, end[low:high] - base
        out[low:high] = mix((sums[e] - sums[s]) * down[s])
        low = high
    return out


class Words:
    """The words of some rows: ``start``/``end`` bytes, ``row``, ``hash`` (64 bit), ``first`` word of each row."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, inside: np.ndarray):
        raw = FOLD[raw]
        self.raw, self.at = raw, at
        flags = inside[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        before = np.empty(len(raw), bool)
        before[:1] = True
        before[1:] = ~flags[:-1]
        self.start = np.flatnonzero(flags & (before | edge[:-1]))
        after = np.empty(len(raw), bool)
        after[-1:] = True
        after[:-1] = ~flags[1:]
        self.end = np.flatnonzero(flags & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.hash = span_hashes(raw, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(batch: pa.RecordBatch, column: str, inside: np.ndarray) -> Words:
    return Words(*utf8(batch.column(batch.schema.get_field_index(column))), inside)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): the least node reachable.

    Alternates large and small stars.  Minima are partial aggregates and come back by a join, so that a
    node with very many neighbours is never gathered in one task; each round is cut in the shared folder.
    """
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u <> v").distinct()
        )
        links = cut(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
