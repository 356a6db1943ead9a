"""SentencePiece encoding and decoding by matching a batch's suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import pieces as batches_of
from emberlog.llm.common import span_hashes, table, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH = 1 << 20          # bytes of text whose distinct words are indexed together
DISTINCT = 1 << 20       # bytes of distinct words that one suffix array holds, about
TOKENS = 1 << 18         # ids that are decoded at once
META = "▁".encode()  # stands for a blank inside pieces
_BLANK = 32


@dataclass
class Vocabulary:
    """Pieces as bytes, with a blank for the meta symbol.  Byte pieces are the single bytes they stand for."""

    data: np.ndarray       # all pieces' bytes
    first: np.ndarray      # where each id's begin
    merges: np.ndarray     # ids of pieces of several characters, best score first
    single: dict           # character's bytes -> id
    byte_ids: np.ndarray   # id of each byte's piece

    @classmethod
    def load(cls, path: str = MODEL) -> "Vocabulary":
        """Read a BPE model with byte fallback.  Its rules must let words be cut before blanks that follow another character."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        texts, scores, single, byte_ids = [], [], {}, np.full(256, -1)
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                byte_ids[value] = i
                texts.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                texts.append(b"")
            else:
                texts.append(piece.encode().replace(META, b" "))
                if len(piece) == 1:
                    single[texts[-1]] = i
                else:
                    scores.append((-model.get_score(i), i))
        characters = {c.encode().replace(META, b" ") for _, i in scores for c in model.id_to_piece(i)}
        if (byte_ids < 0).any() or characters - set(single) or any(b" " in texts[i].lstrip(b" ") for _, i in scores):
            raise ValueError(f"{path}: not a BPE model with byte fallback whose pieces have blanks in front only")
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.array([i for _, i in sorted(scores)], np.int64), single, byte_ids)


class ByteSuffixes:
    """The suffix array of some bytes, ordered by up to ``depth`` bytes; eight bytes are compared as one number."""

    def __init__(self, data: np.ndarray, depth: int):
        size = len(data)
        padded = np.zeros(size + 8, np.uint8)
        padded[:size] = data
        self.eight = np.zeros(size, np.uint64)
        for k in range(8):
            self.eight |= padded[k:k + size].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.keys, self.ranks = [], []
        run = self.eight
        gap = 8
        while True:
            # as np.unique with its inverse; the last sort's order is kept
            order = np.argsort(run)
            ordered = run[order]
            new = np.append(True, ordered[1:] != ordered[:-1])
            rank = np.empty(size, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32) - 1
            self.keys.append(ordered[new])
            self.ranks.append(rank)
            if gap >= depth:
                break
            run = self._pair(rank, gap)
            gap *= 2
        self.order = order.astype(np.int32)
        self.sorted = self.eight[order]

    @staticmethod
    def _pair(rank: np.ndarray, gap: int) -> np.ndarray:
        pair = rank.astype(np.int64) << 31
        if gap < len(rank):
            pair[:len(rank) - gap] |= rank[gap:].astype(np.int64) + 1
        return pair

    def find(self, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Binary search: for each row of ``texts`` (of ``n`` bytes) its range in ``order``."""
        if n <= 8:
            want = np.zeros(len(texts), np.uint64)
            for k in range(n):
                want |= texts[:, k].astype(np.uint64) << np.uint64(56 - 8 * k)
            shift = np.uint64(64 - 8 * n)
            here, want = self.sorted >> shift, want >> shift
        else:
            # equal runs of n bytes: equal first and last 8 * 2**k bytes
            k = (n // 8).bit_length() - 1
            gap = n - (8 << k)
            heads, tails = self._rank(texts[:, :8 << k], k), self._rank(texts[:, gap:gap + (8 << k)], k)
            here = self._pair(self.ranks[k], gap)[self.order]
            want = np.where((heads < 0) | (tails < 0), -1, (heads << 31) | (tails + 1))
        low, high = np.searchsorted(here, want, "left"), np.searchsorted(here, want, "right")
        return low, high

    def _rank(self, texts: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            want = np.zeros(len(texts), np.uint64)
            for i in range(8):
                want |= texts[:, i].astype(np.uint64) << np.uint64(56 - 8 * i)
        else:
            half = 4 << k
            one, two = self._rank(texts[:, :half], k - 1), self._rank(texts[:, half:], k - 1)
            want = np.where((one < 0) | (two < 0), -1, (one << 31) | (two + 1))
        at = np.minimum(np.searchsorted(self.keys[k], want), len(self.keys[k]) - 1)
        return np.where(self.keys[k][at] == want, at, -1)


class Encoder:
    """Encodes the distinct words of a batch together."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        lengths = np.diff(v.first)[v.merges]
        self.by_length = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        self.rows = {n: np.stack([v.data[v.first[i]:v.first[i] + n] for i in v.merges[at]]) for n, at in self.by_length.items()}
        # only pieces that end as they begin can overlap themselves
        self.overlaps = np.zeros(len(v.merges), bool)
        for n, rows in self.rows.items():
            self.overlaps[self.by_length[n]] = np.any([(rows[:, k:] == rows[:, :n - k]).all(1) for k in range(1, n)], axis=0)
        self.depth = max([8, *self.by_length])
        ascii_ids = np.full(128, -1)
        for text, i in v.single.items():
            if len(text) == 1:
                ascii_ids[text[0]] = i
        self.ascii_ids = ascii_ids

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of ``data`` (words with a zero byte after each) and the byte at which each begins.

        Every piece of several characters is searched in the suffix array.  Pieces are applied from the best score on,
        each at its occurrences in order of position, wherever two tokens there make up the piece: exactly the
        order in which byte-pair merges happen.  What then is no piece falls back to bytes.
        """
        index = ByteSuffixes(data, self.depth)
        low, high = np.zeros(len(self.v.merges), np.int64), np.zeros(len(self.v.merges), np.int64)
        for n, at in self.by_length.items():
            low[at], high[at] = index.find(self.rows[n], n)
        # at first every character is a token
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        stops = np.append(starts[1:], len(data))
        end = np.zeros(len(data) + 1, np.int32)
        end[starts] = stops
        token = np.full(len(data), -1, np.int32)
        plain = starts[data[starts] < 128]
        token[plain] = self.ascii_ids[data[plain]]
        wide = data[starts] >= 128
        cache: dict[bytes, int] = {}
        raw = data.tobytes()
        for s, e in zip(starts[wide].tolist(), stops[wide].tolist()):
            c = raw[s:e]
            if c not in cache:
                cache[c] = self.v.single.get(c, -1)
            token[s] = cache[c]
        lengths = np.diff(self.v.first)[self.v.merges]
        order = index.order
        del index
        for k in np.flatnonzero(high > low):
            at = order[low[k]:high[k]].astype(np.int64)
            stop = at + lengths[k]
            middle = end[at]
            ok = np.flatnonzero((middle > 0) & (middle < stop) & (end[middle] == stop))
            if not len(ok):
                continue
            at, middle, stop = at[ok], middle[ok], stop[ok]
            if len(at) > 1 and self.overlaps[k]:
                sort = np.argsort(at)
                at, middle, stop = at[sort], middle[sort], stop[sort]
                chained = np.flatnonzero(at[1:] == middle[:-1])
                if len(chained):
                    # of pairs that share a token the first is taken, then the third, and so on
                    fresh = np.ones(len(at), bool)
                    fresh[chained + 1] = False
                    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                    keep = (np.arange(len(at)) - begin) % 2 == 0
                    at, middle, stop = at[keep], middle[keep], stop[keep]
            end[middle] = 0
            end[at] = stop
            token[at] = self.v.merges[k]
        at = np.flatnonzero(end[:-1])
        at = at[data[at] != 0]
        ids, size = token[at], end[at] - at
        times = np.where(ids < 0, size, 1)
        which = np.repeat(np.arange(len(at)), times)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        begin = at[which] + inside
        return np.where(ids[which] < 0, self.v.byte_ids[data[begin]], ids[which]), begin

    def texts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and where each text's begin."""
        rows = len(at) - 1
        data = raw.tobytes()
        parts = [b" " + data[a:b].replace(META, b" ") if b > a else b"" for a, b in zip(at, at[1:])]
        sizes = np.cumsum([0, *map(len, parts)])
        data = np.frombuffer(b"".join(parts), np.uint8)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
        # a word is a run of blanks and what follows up to the next blank
        blank = data == _BLANK
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        new[sizes[:-1][np.diff(sizes) > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(data))
        # a zero byte in a text is a character of its own kind: keep it apart from the byte between words
        key = span_hashes(data, start, end)
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        size = end[one] - start[one]
        first = np.concatenate([[0], np.cumsum(size + 1)])
        words = np.zeros(first[-1], np.uint8)
        source = np.repeat(start[one] - first[:-1], size + 1) + np.arange(first[-1])
        inner = np.ones(first[-1], bool)
        inner[first[1:] - 1] = False
        words[inner] = data[source[inner]]
        zeros = inner & (words == 0)
        words[zeros] = 255               # no byte of any text; falls back to a byte piece below
        # the suffix array is of some words at a time, so that a batch of rare words takes no more memory than others
        ids, bounds, low = [], [np.zeros(1, np.int64)], 0
        while low < len(one):
            high = max(low + 1, int(np.searchsorted(first, first[low] + DISTINCT, "right")) - 1)
            part = words[first[low]:first[high]]
            some, begin = self.words(part)
            some[part[begin] == 255] = self.v.byte_ids[0]
            bounds.append(bounds[-1][-1] + np.searchsorted(begin, first[low + 1:high + 1] - first[low]))
            ids.append(some.astype(np.int32))
            low = high
        ids, bounds = np.concatenate(ids), np.concatenate(bounds)
        count = np.diff(bounds)
        n = count[which]
        total = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(bounds[:-1][which] - total[:-1], n) + np.arange(total[-1])]
        return out, total[np.searchsorted(start, sizes)] if len(start) else np.zeros(rows + 1, np.int64)


def decode_ids(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """Texts of token ids, some rows at a time."""
    texts, low = [], 0
    while low < len(first) - 1:
        high = max(low + 1, int(np.searchsorted(first, first[low] + TOKENS, "right")) - 1)
        texts += _decode_some(v, ids[first[low]:first[high]], first[low:high + 1] - first[low])
        low = high
    return texts


def _decode_some(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """The pieces' bytes in a row, less the blank that encoding puts in front."""
    size = np.diff(v.first)[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(v.first[:-1][ids] - total[:-1], size) + np.arange(total[-1])
    raw, at = v.data[source].tobytes(), total[first]
    return [raw[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip(at, at[1:])]


def _bounds(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))])


def _short(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with up to ``TOKENS`` ids, or one longer row."""
    for batch in batches:
        first, low = _bounds(batch.column(batch.schema.get_field_index(column))), 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(first, first[low] + TOKENS, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def _plain(docs: DataFrame, *drop: str | None) -> tuple[DataFrame, list[str], str]:
    """Positional names, so that columns that differ in case or hold dots stay apart; existing result columns go."""
    names = [c for c in docs.columns if c not in drop]
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), names, kinds


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", back: str | None = None) -> DataFrame:
    """``docs`` with the token ids of its text.  An empty text has none, a null text null.  Equal to the model's own encoder.

    ``back`` names a column for the text that the ids decode to, made in the same pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    plain, names, kinds = _plain(docs, ids, back)
    column = f"c{names.index(text)}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches_of(batches, column, BATCH):
            texts = batch.column(batch.schema.get_field_index(column))
            tokens, first = encoder.texts(*utf8(texts))
            null = np.asarray(texts.is_null())
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.astype(np.int32)), mask=pa.array(null))
            more = [] if back is None else [pa.array(decode_ids(shared.value, tokens, first), pa.string(), mask=null)]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *more], names=[*batch.schema.names, "ids", "back"][:len(names) + 1 + len(more)])

    kinds += ", ids array<int>" + (", back string" if back else "")
    return plain.mapInArrow(work, kinds).toDF(*names, ids, *([back] if back else []))


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids; null for null.  Gives back what was encoded, but for meta symbols, which become blanks."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    plain, names, kinds = _plain(tokens, text)
    column = f"c{names.index(ids)}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short(batches, column):
            lists = batch.column(batch.schema.get_field_index(column))
            first = _bounds(lists)
            texts = decode_ids(shared.value, np.asarray(lists.flatten(), np.int64), first)
            mask = np.asarray(lists.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=mask)], names=[*batch.schema.names, "text"])

    return plain.mapInArrow(work, f"{kinds}, text string").toDF(*names, text)


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document encoded and decoded: number and digest of its ids, and whether the text came back."""
    vocabulary = Vocabulary.load(model)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, vocabulary, back="decoded")
    return both.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
