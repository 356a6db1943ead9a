"""Vector code compression: product codes whose distances are sums over per-dimension value dictionaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import bare, cut, stored, table

LIMIT = 1 << 26      # scaled components are held within plus and minus this, so that squares add up in 64 bits
ROWS = 2048          # rows whose distances are held at once


@dataclass(frozen=True)
class Code:
    """Parts of a vector, entries of each part's codebook (256 at most), rounds of its refinement, integers per unit."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


def scaled(vectors: DataFrame, code: Code = Code()) -> DataFrame:
    """vec_id, label and the integers ``floor(scale * x)`` of every usable vector.

    A vector that is null or holds a null, NaN or infinite component is left out."""
    rows = bare(vectors, "vec_id", "label", "embedding").withColumn("x", F.col("embedding").cast("array<double>"))
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("x", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * code.scale))).cast("int"))
    return rows.filter(F.col("x").isNotNull()).filter(usable).select("vec_id", "label", whole.alias("ints"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _nearest(ints: np.ndarray, books: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For some rows at a time: each part's nearest entry (the lower of equals) and its squared distance.

    Each dimension has a dictionary of its distinct integers and a table of their squared differences to all
    entries; a part's distances are rows gathered from these tables, by the integers' codes, and added up."""
    parts, entries, width = books.shape
    codes, tables = [], []
    low, high = (min(ints.min(initial=0), books.min(initial=0)), max(ints.max(initial=0), books.max(initial=0)))
    narrow = np.int32 if int(high - low) ** 2 * max(width, 1) < 1 << 31 else np.int64
    for j in range(parts * width):
        values, inverse = np.unique(ints[:, j], return_inverse=True)
        codes.append(inverse)
        tables.append(((values[:, None] - books[j // width, :, j % width][None, :]) ** 2).astype(narrow))
    for start in range(0, len(ints), ROWS):
        some = slice(start, min(start + ROWS, len(ints)))
        best = np.zeros((some.stop - start, parts), np.int64)
        far = np.zeros_like(best)
        for p in range(parts):
            total = np.zeros((some.stop - start, entries), narrow)
            for j in range(p * width, (p + 1) * width):
                total += tables[j][codes[j][some]]
            best[:, p] = total.argmin(axis=1)
            far[:, p] = total[np.arange(len(total)), best[:, p]]
        yield some, best, far


def _refine(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry moved to the floor of the mean of the parts nearest to it.

    A task adds up its own parts; what it sends is as large as the codebooks, whatever its rows."""
    parts, entries, width = books.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums, times = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            ints = _matrix(batch.column(0), parts * width)
            for some, best, _ in _nearest(ints, books):
                rows = ints[some]
                for p in range(parts):
                    times[p] += np.bincount(best[:, p], minlength=entries)
                    for j in range(width):  # at most 2**11 rows of 2**26: exact as doubles
                        sums[p, :, j] += np.bincount(best[:, p], rows[:, p * width + j], entries).astype(np.int64)
        both = np.concatenate([sums.ravel(), times.ravel()])
        some = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[some])], names=["slot", "total"])

    both = np.zeros(books.size + parts * entries, np.int64)
    for slot, total in kept.select("ints").mapInArrow(work, "slot long, total long").groupBy("slot").agg(F.sum("total")).collect():
        both[slot] = total
    sums, times = both[:books.size].reshape(books.shape), both[books.size:].reshape(parts, entries)
    return np.where(times[:, :, None] > 0, sums // np.maximum(times, 1)[:, :, None], books)


def compress(vectors: DataFrame, code: Code = Code()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every usable row of ``vectors`` (vec_id, label, embedding), and the codebooks.

    ``code`` names the nearest entry of each part, two hex digits each; ``error`` is the sum of the squared distances,
    in scaled units.  Codebooks (parts x entries x components) begin as the parts of the vectors with the least
    ids, at most ``entries`` of them; with fewer vectors they have fewer entries.

    Null, NaN or infinite components or no vector: no row.  Vectors whose length is not a multiple of the number of parts, or
    that are shorter than the longest, count as filled up with zeros.  Scaled components beyond 2**26 count as 2**26.
    Repeated ids are rows of their own, equal ids ordered by their integers; null ids come last.  No vector: no entries.
    """
    kept = cut(scaled(vectors, code))
    size = kept.agg(F.max(F.size("ints"))).first()[0] or 0
    width = -(-size // code.parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(code.entries).select("ints").collect()
    begin = np.zeros((len(first), code.parts * width), np.int64)
    for i, (ints,) in enumerate(first):
        begin[i, :len(ints)] = ints
    books = begin.reshape(len(first), code.parts, width).transpose(1, 0, 2).copy()
    if first:
        for _ in range(code.rounds):
            books = _refine(kept, books)
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def work(batches):
        for batch in batches:
            for some, best, far in _nearest(_matrix(batch.column(2), code.parts * width), shared.value):
                rows = batch.slice(some.start, len(best))
                said = pa.array([r.tobytes().hex() for r in best.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), said, pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books


def decode(coded: DataFrame, books: np.ndarray, code: Code = Code()) -> DataFrame:
    """``coded`` with ``vector``: the entries that its code names, in the units of the input."""
    shared = coded.sparkSession.sparkContext.broadcast(books)

    def work(batches):
        for batch in batches:
            books = shared.value
            names = np.array([list(bytes.fromhex(c)) for c in batch.column("code").to_pylist()], np.int64).reshape(-1, len(books))
            flat = books[np.arange(len(books))[None, :], names].reshape(batch.num_rows, -1) / code.scale
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * flat.shape[1]
            yield batch.append_column("vector", pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel())))

    schema = ", ".join(f"`{n}` {t}" for n, t in coded.dtypes)
    return coded.mapInArrow(work, f"{schema}, vector array<double>")


def fingerprint(books: np.ndarray) -> str:
    """Digest of all components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = cut(coded)
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
