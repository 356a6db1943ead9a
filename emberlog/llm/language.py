"""Language identification with bit-sliced Bloom filters of byte n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import FOLD, bare, byte_table, cut, held_out, pieces, table, utf8

#: An n-gram is in a language's filter if it makes up this share of the language's training n-grams, so a
#: language has at most 1 / MIN_SHARE of them, whatever the size of the corpus.
MIN_SHARE = 5e-5
SLOTS_PER_GRAM = 16
UNKNOWN = "und"
BLOCK = 1 << 20       # bytes of text whose n-grams are looked up together
_HELD = 1 << 20       # distinct n-grams that a training task holds before it hands them on
_HASHES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))
_LETTERS = byte_table(lambda b: 97 <= b <= 122 or b >= 128)


@dataclass
class Filters:
    """``slots`` holds at each place the bit mask of the languages with an n-gram hashed there."""

    languages: list[str]
    slots: np.ndarray            # (2**bits, words of 64 languages)
    false_positive: np.ndarray   # by language
    weight: np.ndarray           # training n-grams by language; decides ties

    @property
    def bits(self) -> int:
        return len(self.slots).bit_length() - 1

    def places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        for h in _HASHES:
            yield (grams * h) >> np.uint32(32 - self.bits)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it."""
        one, two = self.places(grams)
        return self.slots[one] & self.slots[two]


def _grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte n-grams of each text, and where each row's begin.  All but letters is blank; a text has
    two blanks on either side; n-grams with a blank middle don't count."""
    raw, at = utf8(batch.column(batch.schema.get_field_index("text")))
    data = raw.tobytes()
    padded = np.frombuffer(b"  " + b"    ".join(data[a:b] for a, b in zip(at, at[1:])) + b"  ", np.uint8)
    b = FOLD[padded]
    b = np.where(_LETTERS[b], b, np.uint8(32)).astype(np.uint32)
    keys = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
    keep = np.flatnonzero((b[1:-2] != 32) | (b[2:-1] != 32))
    begins = at[:-1] + 4 * np.arange(len(at) - 1)
    return keys[keep], np.searchsorted(keep, np.append(begins, len(padded)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out():
        for lang, (grams, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in pieces(batches, "text", BLOCK):
        grams, first = _grams(batch)
        langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
        for lang in sorted(set(langs)):
            mine = np.concatenate([grams[first[i]:first[i + 1]] for i in np.flatnonzero(langs == lang)])
            keys, n = np.unique(mine, return_counts=True)
            if lang in held:
                old, m = held[lang]
                keys, at = np.unique(np.concatenate([old, keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([m, n]), len(keys)).astype(np.int64)
            held[lang] = (keys, n.astype(np.int64))
        if sum(len(x[0]) for x in held.values()) > _HELD:
            yield from out()
    yield from out()


def learn(docs: DataFrame, min_share: float = MIN_SHARE) -> Filters:
    """Filters from all rows of ``docs`` that have a text and a language.

    Counts are summed by Spark; the driver gets the n-grams above ``min_share`` only, at most 1 / min_share
    per language.  The filters have one size whatever the data, so their broadcast is bounded too.
    """
    rows = bare(docs, "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = cut(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").filter(F.col("n") >= min_share * F.col("total")).select("lang", "gram", "total").toPandas()
    languages = sorted(kept["lang"].unique())
    bits = min(31, math.ceil(math.log2(SLOTS_PER_GRAM / min_share)))
    slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
    filters = Filters(languages, slots, np.zeros(len(languages)), np.zeros(len(languages)))
    for i, lang in enumerate(languages):
        mine = kept[kept["lang"] == lang]
        filters.weight[i] = mine["total"].iloc[0]
        bit, rates = np.uint64(1 << (i % 64)), []
        for at in filters.places(mine["gram"].to_numpy().astype(np.uint32)):
            slots[at, i // 64] |= bit
        for _ in _HASHES:
            rates.append(np.count_nonzero(slots[:, i // 64] & bit) / len(slots))
        filters.false_positive[i] = math.prod(rates)
    return filters


def identify(docs: DataFrame, filters: Filters, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; columns of these two names are replaced.

    The score is the share of the text's n-grams that the language's filter contains, less the share that it
    would contain by false positives alone: (share - fp) / (1 - fp), from 0 to 1.  The highest wins, then the
    language with more training text, then the lesser name.  A text that is null or has no letter is ``und``
    with score 0, as is every text if no language was learned.  Every row is judged on its own whole text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    names = [c for c in docs.columns if c not in (pred, score)]
    # positional names keep columns that differ in case, or hold dots, apart
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("`text`").alias("text"),
                        F.coalesce(F.col("`text`").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))

    def judge(batches):
        f = shared.value
        order = np.lexsort((np.arange(len(f.languages)), -f.weight))
        choice = np.array([f.languages[i] for i in order] + [UNKNOWN], object)
        for batch in pieces(batches, "text", BLOCK):
            grams, first = _grams(batch)
            count = np.maximum(np.diff(first), 1)
            masks = f.masks(grams)
            shares = np.zeros((batch.num_rows, len(order)))
            for k, i in enumerate(order):
                hit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                shares[:, k] = np.diff(sums[first]) / count
                shares[:, k] = np.clip((shares[:, k] - f.false_positive[i]) / (1 - f.false_positive[i]), 0, 1)
            letters = np.asarray(batch.column(batch.num_columns - 1).to_pylist(), bool)
            if len(order):
                best = np.where(letters, shares.argmax(1), len(order))
                value = np.where(letters, shares.max(1), 0.0)
            else:
                best, value = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(choice[best], pa.string()), pa.array(value)],
                                             names=[*batch.schema.names[:-2], "pred", "score"])

    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    out = plain.mapInArrow(judge, ", ".join([*kinds, "pred string", "score double"]))
    return out.toDF(*names, pred, score)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction for every document by filters learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    filters = learn(docs.filter(~out))
    return identify(bare(docs, "doc_id", "text"), filters).select("doc_id", out.alias("held_out"), "lang_pred", "score")
