"""Phrase collocations: word prefixes dealt into groups by a memory budget, one depth-truncated suffix subtree for each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import bare, byte_table, cut, mix, pieces, span_hashes, stored, table, utf8, words_of

UNKNOWN = "und"
DEPTH = 4            # words of the longest phrase
BUDGET = 1 << 20     # suffixes of one group, about: what one subtree is built from
SHARE, LEAST_HEAVY = 16, 1000  # a prefix with more than a group's suffixes divided by this is dealt out over several groups
HELD = 1 << 20       # suffixes that a scanning task holds before it sends them
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # of a bitmap that scanning tasks filter by: 32 MB at most
PATH = ["a", "b", "c", "d"]

_ENDS = byte_table(lambda b: b in b".,;:!?\n\x0b\x0c\r")
_INSIDE = byte_table(lambda b: b not in b" \t.,;:!?\n\x0b\x0c\r")


@dataclass(frozen=True)
class Rule:
    """Least occurrences of a phrase, phrases reported for each language, units of the score, percent that covers a phrase."""

    least: int = 30
    top: int = 2000
    unit: int = 2_000_000
    cover: int = 80


class Tokens:
    """Words of some rows: ``name`` (64 bits, of the language and the word), ``linked``: the next word is in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = w = words_of(batch, "text", _INSIDE)
        self.lang = batch.column(batch.schema.get_field_index("lang")).fill_null(UNKNOWN)
        raw, at = utf8(self.lang)
        name = mix(w.hash ^ mix(span_hashes(raw, at[:-1], at[1:]) + np.uint64(1))[w.row])
        self.name = np.where(name == 0, np.uint64(1), name)  # 0 stands for no word
        ends = np.zeros(len(w.raw) + 1, np.int32)
        np.cumsum(_ENDS[w.raw], out=ends[1:])
        self.linked = (w.row[1:] == w.row[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1]])

    def texts(self, some: np.ndarray) -> pa.Array:
        start, size = self.words.start[some], (self.words.end - self.words.start)[some]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = self.words.raw[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        wide = pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        return wide.cast(pa.string())


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, name, n) of every word, and a row without word for all words of a language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            t = Tokens(batch)
            _, first, times = np.unique(t.name, return_index=True, return_counts=True)
            lang = t.lang.take(pa.array(t.words.row[first]))
            yield pa.RecordBatch.from_arrays([lang, t.texts(first), pa.array(t.name[first].view(np.int64)), pa.array(times)], names=["lang", "word", "name", "n"])
            every = pa.table({"lang": t.lang, "n": t.words.counts()}).group_by("lang").aggregate([("n", "sum")])
            none = pa.nulls(every.num_rows)
            yield pa.RecordBatch.from_arrays([every["lang"].combine_chunks(), none.cast(pa.string()), none.cast(pa.int64()), every["n_sum"].combine_chunks()], names=["lang", "word", "name", "n"])

    return docs.mapInArrow(work, "lang string, word string, name long, n long").groupBy("lang", "word", "name").agg(F.sum("n").alias("n"))


def _bits(count: int) -> int:
    """Places of a bitmap for ``count`` names: 16 each, as long as that is within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count - 1).bit_length()))


def _bitmap(names: DataFrame, bits: int) -> np.ndarray:
    """The low bits of ``name`` as marked places; of bounded size, whatever the number of names."""
    place = F.col("name").bitwiseAND(F.lit(bits - 1)) + 1
    found = names.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("part")).collect()
    out = np.zeros(bits >> 3, np.uint8)
    for k, part in found:
        out[(k - 1) * 4096:k * 4096] = np.frombuffer(part, np.uint8)[:len(out)]
    return out


def _marked(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = names & np.uint64((len(bitmap) << 3) - 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pair_name(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(F.shiftleft(b, 17)).bitwiseXOR(F.shiftrightunsigned(b, 47))


def _pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b << np.uint64(17)) ^ (b >> np.uint64(47))


def _pair_counts(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(a, b, n) of neighbouring words that may both be frequent: the prefixes by which suffixes are dealt out."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches):
        for batch in pieces(batches, "text"):
            t = Tokens(batch)
            good = _marked(shared.value, t.name)
            at = np.flatnonzero(t.linked & good[:-1] & good[1:])
            names, code = np.unique(t.name, return_inverse=True)
            key, times = np.unique(code[at] * max(1, len(names)) + code[at + 1], return_counts=True)
            a, b = names[key // max(1, len(names))], names[key % max(1, len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(times)], names=["a", "b", "n"])

    return docs.mapInArrow(work, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _merged(paths: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal paths (columns) once, with their times added up; sorted."""
    order = np.lexsort(paths[::-1])
    paths, times = paths[:, order], times[order]
    new = np.ones(len(times), bool)
    new[1:] = (paths[:, 1:] != paths[:, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    return paths[:, at], np.add.reduceat(times, at) if len(at) else times


def _suffixes(docs: DataFrame, pairs: np.ndarray, heavy: np.ndarray, groups: int) -> DataFrame:
    """(g, split, a, b, c, d, n): suffixes of three or four words, cut off where neighbours cannot be a frequent pair.

    The first two words are the prefix; all suffixes of a prefix go to one group ``g``.  Those of a heavy
    prefix (``split``) are dealt out by all their words."""
    shared = docs.sparkSession.sparkContext.broadcast((pairs, heavy))

    def send(paths, times):
        pairs, heavy = shared.value
        split = _marked(heavy, _pair_names(paths[0], paths[1]))
        by = mix(_pair_names(paths[0], paths[1]))
        by = np.where(split, mix(by ^ _pair_names(paths[2], mix(paths[3]))), by)
        g = (by % np.uint64(groups)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(split), *[pa.array(p.view(np.int64)) for p in paths], pa.array(times)], names=["g", "split", *PATH, "n"])

    def work(batches):
        held, rows = [], 0
        for batch in pieces(batches, "text"):
            t = Tokens(batch)
            size = len(t.name)
            on = np.zeros(size + DEPTH, bool)
            on[:max(0, size - 1)] = t.linked & _marked(shared.value[0], _pair_names(t.name[:-1], t.name[1:]))
            at = np.flatnonzero(on[:size] & on[1:size + 1])
            name = np.concatenate([t.name, np.zeros(DEPTH, np.uint64)])
            last = np.where(on[at + 2], name[at + 3], np.uint64(0))
            held.append(_merged(np.stack([name[at], name[at + 1], name[at + 2], last]), np.ones(len(at), np.int64)))
            rows += len(held[-1][1])
            if rows > HELD:
                held = [_merged(np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held]))]
                rows = len(held[0][1])
                if rows > HELD // 2:
                    yield send(*held[0])
                    held, rows = [], 0
        if held:
            yield send(*_merged(np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held])))

    return docs.mapInArrow(work, "g int, split boolean, a long, b long, c long, d long, n long")


def _subtree(least: int):
    """The nodes of depth three and four of one group's subtree; a node counts what its leaves hold.

    Rare nodes go at once, but for those of a split prefix, whose counts are added up later."""

    def work(table: pa.Table) -> pa.Table:
        paths = np.stack([table[k].to_numpy().view(np.uint64) for k in PATH])
        split = np.unique(_pair_names(*paths[:2, table["split"].to_numpy()]))
        leaves, totals = _merged(paths, table["n"].to_numpy())
        nodes, counts = [], []
        for depth in (3, 4):
            new = np.ones(len(totals), bool)
            new[1:] = (leaves[:depth, 1:] != leaves[:depth, :-1]).any(axis=0)
            at = np.flatnonzero(new)
            node, count = leaves[:, at].copy(), np.add.reduceat(totals, at)
            node[depth:] = 0
            keep = ((count >= least) | np.isin(_pair_names(*node[:2]), split)) & (node[depth - 1] != 0)
            nodes.append(node[:, keep])
            counts.append(count[keep])
        both = np.concatenate(nodes, axis=1)
        return pa.table([*[pa.array(p.view(np.int64)) for p in both], pa.array(np.concatenate(counts))], names=[*PATH, "n"])

    return work


def frequent(docs: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, name, n) and phrases (a, b, c, d, n; 0 for no word) that occur at least ``rule.least`` times.

    A row of words without a word has all words of its language.  Three scans: words; pairs of frequent words, which are
    the prefixes; then suffixes of frequent pairs, dealt into groups by prefix.  A group is as large as the budget,
    so the number of groups follows from the pairs' counts.  Bitmaps only keep out what cannot be frequent.
    """
    spark = docs.sparkSession
    rows = bare(docs, "lang", "text").select(F.col("lang").cast("string").alias("lang"), "text")
    words = cut(_word_counts(rows).filter(F.col("word").isNull() | (F.col("n") >= rule.least)))
    names = words.filter(F.col("word").isNotNull()).select("name")
    pairs = cut(_pair_counts(rows, _bitmap(names, _bits(names.count()))).filter(F.col("n") >= rule.least))
    number, total = pairs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUDGET))
    named = pairs.select(_pair_name(F.col("a"), F.col("b")).alias("name"), "n")
    heavy = named.filter(F.col("n") > max(LEAST_HEAVY, total // (groups * SHARE)))
    suffixes = _suffixes(rows, _bitmap(named, _bits(number)), _bitmap(heavy, _bits(SHARE * groups)), groups)
    nodes = suffixes.groupBy("g").applyInArrow(_subtree(rule.least), "a long, b long, c long, d long, n long")
    deep = nodes.groupBy(*PATH).agg(F.sum("n").alias("n")).filter(F.col("n") >= rule.least)
    none = F.lit(0).cast("long")
    return words, cut(deep.unionByName(pairs.select("a", "b", none.alias("c"), none.alias("d"), "n")))


def _part(path: Column, low: int, size: int) -> Column:
    """``size`` words of ``path`` from ``low`` on, filled up with zeros."""
    return F.array(*[path[low + k] if k < size else F.lit(0).cast("long") for k in range(DEPTH)])


def _scored(words: DataFrame, phrases: DataFrame, rule: Rule) -> DataFrame:
    """(path, a, l, r, score) of every phrase that no longer one covers."""
    none = F.lit(0).cast("long")
    singles = words.filter(F.col("word").isNotNull()).select(F.array("name", none, none, none).alias("path"), "n")
    grams = phrases.select(F.array(*PATH).alias("path"), "n")
    size = F.when(F.col("path")[2] == 0, 2).when(F.col("path")[3] == 0, 3).otherwise(4)
    spans = [(n, low, k) for n in range(2, DEPTH + 1) for k in range(1, n) for low in range(n - k + 1)]
    inside = F.filter(
        F.array(*[F.when(F.col("size") == n, F.struct(F.lit(low).alias("low"), F.lit(k).alias("k"), _part(F.col("path"), low, k).alias("part"))) for n, low, k in spans]),
        lambda s: s.isNotNull())
    parts = cut(
        grams.withColumn("size", size).withColumn("s", F.explode(inside)).select("path", F.col("n").alias("a"), "size", "s.low", "s.k", "s.part")
        .join(singles.unionAll(grams).withColumnRenamed("path", "part"), "part")
    )
    covered = parts.filter("k > 1").groupBy(F.col("part").alias("path")).agg(F.max("a").alias("longer"))
    cuts = []
    for k in range(1, DEPTH):
        cuts += [F.max(F.when((F.col("low") == 0) & (F.col("k") == k), F.col("n"))).alias(f"l{k}"),
                 F.max(F.when((F.col("low") == k) & (F.col("low") + F.col("k") == F.col("size")), F.col("n"))).alias(f"r{k}")]
    sides = parts.groupBy("path", "a").agg(*cuts)
    least = F.least(*[
        F.when(F.col(f"r{k}").isNotNull(), F.struct(
            F.expr(f"cast(cast(a AS decimal(20, 0)) * {rule.unit} div cast(l{k} + r{k} AS decimal(20, 0)) AS long)").alias("score"),
            F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, DEPTH)])
    kept = sides.join(covered, "path", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < rule.cover * F.col("a")))
    return kept.select("path", "a", least.alias("cut")).select("path", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the highest-scoring phrases of each language of ``docs`` (lang, text).

    A-Z are lowered; ``.,;:!?`` and line ends part a text into pieces, spaces and tabs a piece into words.  A phrase of two to
    four words within a piece is a candidate with ``rule.least`` occurrences, overlaps included; it is left out if a longer
    candidate around it has ``rule.cover`` percent of its occurrences.  Its score is that of its worst cut in two.

    Null text has no words, null language is ``und``; repeated rows all count; equal scores and counts go by the
    phrase's bytes; no text, no rows.  Words are known by 64-bit names.  Ranking is by parts first, so
    that no task gets a language's phrases together.
    """
    words, phrases = frequent(docs, rule)
    scored = _scored(words, phrases, rule)
    known = words.filter(F.col("word").isNotNull())
    salt = F.pmod(F.xxhash64("path"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranked = scored.join(known.select(F.col("name").alias("first"), "lang", F.col("word").alias("w0")), F.col("path")[0] == F.col("first"))
    ranked = ranked.withColumn("salt", salt).withColumn("k", F.rank().over(W.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))))
    best = cut(ranked.filter(F.col("k") <= rule.top))
    for i in range(1, DEPTH):
        best = best.join(known.select(F.col("name").alias(f"name{i}"), F.col("word").alias(f"w{i}")), F.col("path")[i] == F.col(f"name{i}"), "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(DEPTH)]))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("k", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("k") <= rule.top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= rule.top)
    every = stored(words.filter(F.col("word").isNull()).select("lang", "n"), "language-words")
    return best.join(every, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
