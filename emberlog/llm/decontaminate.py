"""Benchmark decontamination by suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import ALNUM, CHUNK, Words, bare, cut, fresh, pieces, table, utf8, words_of

WINDOW = 13
BLOCK = 4 << 20      # bytes of benchmark text that one pass over the documents looks for
FOUND = (
    "doc_id long, text_hash long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>, "
    "matches array<struct<item_id:string,start:long,n_words:long,item_start:long>>"
)


class Suffixes:
    """The suffix array of a shard, in the order of the first ``depth`` words of each suffix.

    ``levels[k]`` ranks the runs of 2**k words.  Two runs of n words are equal, and ordered, as the pairs of
    ranks of their first and last 2**k words are, with 2**k the largest power up to n.
    """

    def __init__(self, words: np.ndarray, depth: int):
        self.size, self.depth = len(words), depth
        vocabulary, rank = np.unique(words, return_inverse=True)
        self.keys, self.levels = [vocabulary], [rank.astype(np.int64)]
        while 2 << (len(self.levels) - 1) <= depth:
            pair = self._pairs(self.levels[-1], 1 << (len(self.levels) - 1))
            key, rank = np.unique(pair, return_inverse=True)
            self.keys.append(key)
            self.levels.append(rank.astype(np.int64))
        self.order = np.argsort(self._runs(self.levels, depth), kind="stable")

    @staticmethod
    def _pairs(rank: np.ndarray, gap: int) -> np.ndarray:
        """Rank of the run at i and of the one ``gap`` later; nothing (0) beyond the end."""
        late = np.zeros(len(rank), np.int64)
        if gap < len(rank):
            late[:len(rank) - gap] = rank[gap:] + 1
        return (rank << 31) | late

    def _runs(self, levels: list[np.ndarray], n: int) -> np.ndarray:
        k = n.bit_length() - 1
        return self._pairs(levels[k], n - (1 << k))

    def ranks(self, words: np.ndarray) -> list[np.ndarray]:
        """The ranks that runs of other words have here, -1 where this shard does not hold them."""
        out: list[np.ndarray] = []
        for k, key in enumerate(self.keys):
            if k:
                gap = 1 << (k - 1)
                late = np.full(len(words), -1, np.int64)
                if gap < len(words):
                    late[:len(words) - gap] = out[-1][gap:]
                want = np.where((out[-1] < 0) | (late < 0), -1, (out[-1] << 31) | (late + 1))
            else:
                want = words
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            out.append(np.where(key[at] == want, at, -1))
        return out

    def find(self, ranks: list[np.ndarray], at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Binary search for the runs of ``n`` words that start at ``at``: (index into at, position here) of each occurrence."""
        k = n.bit_length() - 1
        head, tail = ranks[k][at], ranks[k][at + n - (1 << k)]
        known = np.flatnonzero((head >= 0) & (tail >= 0))
        if not len(known):
            return known, known
        want = (head[known] << 31) | ((tail[known] + 1) if n > (1 << k) else (head[known] + 1))
        if n == 1 << k:
            here, want = self.levels[k][self.order], head[known]
        else:
            here = self._runs(self.levels, n)[self.order]
        low, high = np.searchsorted(here, want, "left"), np.searchsorted(here, want, "right")
        times = high - low
        which = np.repeat(known, times)
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return which, self.order[np.repeat(low, times) + inside]


class Wanted:
    """The words of a block of items and the windows to look for, by length."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        words = Words(*utf8(pa.array(texts, pa.string())), ALNUM)
        counts = words.counts()
        self.ids, self.words, self.item, self.first = np.array(ids, object), words.hash, words.row, words.first
        self.by_length: dict[int, np.ndarray] = {}
        for n in np.unique(np.minimum(counts, window)):
            if n:
                rows = np.flatnonzero(counts >= window if n == window else counts == n)
                self.by_length[int(n)] = np.concatenate([np.arange(words.first[r], words.first[r + 1] - n + 1) for r in rows])


def _chunk(batch: pa.RecordBatch, wanted: Wanted, window: int) -> pa.RecordBatch:
    words = words_of(batch, "text", ALNUM)
    rows, counts = batch.num_rows, words.counts()
    spans: list = [[] for _ in range(rows)]
    items: list = [[] for _ in range(rows)]
    matches: list = [[] for _ in range(rows)]
    if len(words.hash) and wanted.by_length:
        # one separator after each row keeps suffixes from running into the next row
        place = np.arange(len(words.hash)) + words.row
        text = np.zeros(len(words.hash) + rows, np.uint64)
        text[place] = words.hash
        begins = words.first[:-1] + np.arange(rows)
        index = Suffixes(text, window)
        ranks = index.ranks(wanted.words)
        hits = []
        for n, at in wanted.by_length.items():
            which, here = index.find(ranks, at, n)
            hits.append((at[which], here, np.full(len(here), n)))
        source, here, size = (np.concatenate(x) for x in zip(*hits))
        if len(here):
            row = np.searchsorted(begins, here, "right") - 1
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, here, 1)
            np.add.at(cover, here + size, -1)
            hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
            low, high = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
            for a, b, r in zip(low, high, np.searchsorted(begins, low, "right") - 1):
                spans[r].append((int(a - begins[r]), int(b - begins[r])))
            # windows that follow each other in document and item are one longer match
            item = wanted.item[source]
            order = np.lexsort((here, here - source, item))
            i, s, h, z = item[order], source[order], here[order], size[order]
            new = np.ones(len(h), bool)
            new[1:] = (i[1:] != i[:-1]) | (h[1:] - s[1:] != h[:-1] - s[:-1]) | (h[1:] != h[:-1] + 1)
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], len(h)) - 1
            for b, e in zip(begin, stop):
                r = row[order[b]]
                matches[r].append((wanted.ids[i[b]], int(h[b] - begins[r]), int(h[e] + z[e] - h[b]), int(s[b] - wanted.first[i[b]])))
            for r in np.unique(row):
                items[r] = sorted({m[0] for m in matches[r]})
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    match = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("item_start", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
         pa.array([[dict(zip(("start", "stop"), x)) for x in y] for y in spans], span),
         pa.array(items, pa.list_(pa.string())),
         pa.array([[dict(zip(("item_id", "start", "n_words", "item_start"), x)) for x in y] for y in matches], match)],
        names=["doc_id", "text_hash", "n_words", "spans", "items", "matches"],
    )


def _blocks(benchmark: DataFrame, size: int) -> Iterator[tuple[list[str], list[str]]]:
    """The benchmark's items, by up to ``size`` bytes of text."""
    ids, texts, held = [], [], 0
    for row in bare(benchmark, "item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        if ids and held + len(row.text) > size:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append("" if row.item_id is None else str(row.item_id))
        texts.append(row.text)
        held += len(row.text)
    yield ids, texts


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document and text: doc_id, text_hash, copies, n_words, spans, n_hit, items, matches.

    Each task sorts the suffixes of its documents, in shards of a few MB, and binary-searches every suffix of
    the items there.  ``spans`` are the word ranges inside any occurrence of a window (``window`` words, or a
    whole shorter item), ``matches`` the longest verbatim matches with their places.  The items are the query
    set: they pass in blocks of ``block`` bytes, one pass over the documents for each, so nothing that is sent
    to the tasks grows with the benchmark.  Texts are cut in words of a-z, 0-9 and non-ASCII characters, A-Z
    in lower case.

    A null or empty text has no words and no hits; an item without words matches nothing; an item with a null
    id is called "".  Equal rows are one row here with ``copies`` counting them.
    """
    narrow = bare(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text")
    passes, n = None, 0
    for ids, texts in _blocks(benchmark, block):
        def search(batches, ids=ids, texts=texts):
            wanted = Wanted(ids, texts, window)
            for part in pieces(batches, "text", CHUNK):
                yield _chunk(part, wanted, window)

        found = cut(narrow.mapInArrow(search, FOUND))
        passes = found if passes is None else passes.unionAll(found)
        n += 1
    merged = passes.groupBy("doc_id", "text_hash").agg(
        (F.count("*") / n).cast("long").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"),
    )
    # spans of one pass are apart, those of several may overlap: count each word once
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], s["stop"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    return merged.withColumn("n_hit", covered)


def contaminated(n_hit, n_words):
    """At least one word in twenty lies inside a benchmark window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = find_matches(docs, benchmark, window).filter(contaminated(F.col("n_hit"), F.col("n_words")))
    id_, hash_ = fresh(docs, "of", "hash")
    bad = bad.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    same = F.col("`doc_id`").cast("long").eqNullSafe(F.col(id_)) & (F.coalesce(F.xxhash64(F.col("`text`")), F.lit(0)) == F.col(hash_))
    return docs.join(bad, same, "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``find_matches`` over all documents."""
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")
