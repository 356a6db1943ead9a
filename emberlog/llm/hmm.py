"""A hidden Markov language model: Baum-Welch on Spark, exact sequence likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import SPACED, Words, bare, cut, held_out, mix, pieces, release, table, words_of

STATES = 8
LOOKUP = 1 << 18     # most frequent words whose counts and emissions every task holds; the rest meet theirs by bucket
BUCKET = 1 << 16     # words of a bucket, about
ASKS = 1 << 20       # words that blocks ask a bucket for in one task, about
TASK = 1 << 26       # bytes of text of a task, about, in blocks of up to ``BATCH`` bytes
SLICE = 512          # emission rows that are summed as one array
ROUNDS = 4           # of Baum-Welch
SEGMENT = 256        # tokens of a training sequence; likelihoods are over whole texts
BATCH = 1 << 20      # bytes of text whose sequences are worked on side by side
SMOOTH = 0.5
_HELD = 1 << 20


@dataclass
class Counts:
    """Token counts of the training texts.  ``rows`` (h long, n long) has all words; the arrays the most frequent."""

    rows: DataFrame
    total: int           # N: words and ends
    distinct: int        # V: words, and the end
    ends: int
    hashes: np.ndarray   # sorted
    counts: np.ndarray
    symbol: np.ndarray   # by place in hashes: the emission row, ``symbols`` if in the common class
    symbols: int
    class_total: int     # tokens and words of the common class; none if every word has its own emissions
    class_distinct: int
    every: bool

    @property
    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, emission rows and counts of the words in ``Model.emit``."""
        own = self.symbol < self.symbols
        return self.hashes[own], self.symbol[own], self.counts[own]

    @property
    def others(self) -> int:
        """Words that are not in ``Model.emit``."""
        return self.distinct - (self.ends > 0) - self.symbols

    @property
    def bits(self) -> int:
        """Of a hash that name its bucket."""
        return max(0, self.others // BUCKET).bit_length()


@dataclass
class Model:
    """``start`` has two rows: for the first token of a text and for one that goes on.

    ``rest`` has the words that ``emit`` doesn't: a row (bucket, hashes, n, weights) for each bucket.  Their emissions are the
    weights by ``scale``; a word without weights is emitted as its share of the class."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray     # (symbols + 2, states): words, the class (of unknown words, if every word has its own), the end
    rest: DataFrame | None = None
    scale: np.ndarray | None = None


def _find(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in the sorted hashes, -1 for others."""
    if not len(sorted_hashes):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == hashes, at, -1)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "n"])
    for batch in pieces(batches, "text"):
        new, m = np.unique(words_of(batch, "text", SPACED).hash, return_counts=True)
        merged, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        keys, n = merged, np.bincount(at, np.concatenate([n, m]), len(merged)).astype(np.int64)
        if len(keys) > _HELD:
            yield rows()
            keys, n = keys[:0], n[:0]
    yield rows()


def count_words(train: DataFrame, symbols: int | None = None, lookup: int = LOOKUP) -> Counts:
    """Counts over all training texts, by 64-bit word hash; the driver gets the ``lookup`` most frequent only.

    With ``symbols``, only so many words get emissions of their own, and the others are one class."""
    texts = bare(train, "text")
    rows = cut(texts.mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    ends = texts.count()
    words, distinct = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lookup = max(lookup, symbols or 0)
    # the frequency class with the last of the ``lookup`` words; none below it need be ordered
    level = F.floor(F.log2("n") * 16)
    sizes = rows.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    floor, held = 0, 0
    for size in sizes:
        held, floor = held + size["words"], size["level"]
        if held >= lookup:
            break
    # cut, so that the driver gets these rows only and not so many from every partition
    top = cut(rows.filter(level >= floor).orderBy(F.desc("n"), "h").limit(lookup).select("h", "n")).toPandas().sort_values(["n", "h"], ascending=[False, True])
    hashes, counts = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    every, symbols = symbols is None, len(hashes) if symbols is None else min(symbols, len(hashes))
    symbol = np.minimum(np.arange(len(hashes)), symbols)
    order = np.argsort(hashes)
    rest = (0, 0) if every else (int(words - counts[:symbols].sum()), int(distinct) - symbols)
    return Counts(rows, int(words) + ends, int(distinct) + (ends > 0), ends, hashes[order], counts[order], symbol[order], symbols, *rest, every)


class Sequences:
    """Token sequences side by side: longest first, all first tokens, then all second ones, and so on."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray):
        length = np.diff(first)
        self.order = np.argsort(-length, kind="stable")
        length = length[self.order]
        steps = int(length[0]) if len(length) else 0
        self.width = np.searchsorted(-length, -np.arange(steps), "left")
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        step = np.repeat(np.arange(steps), self.width)
        lane = np.arange(len(step)) - self.at[step]
        self.tokens = tokens[first[:-1][self.order][lane] + step]
        self.before = self.at[np.maximum(step - 1, 0)] + lane
        self.length = length


def forward(model: Model, seq: Sequences, kind: np.ndarray, keep: bool = False):
    """Scaled forward recursion: the log likelihood of each sequence (in ``seq.order``), and with ``keep``
    the scaled forward variables, emissions and scales of every token."""
    emit = model.emit[seq.tokens]
    logs = np.zeros(len(seq.length))
    alpha, scale = (np.empty_like(emit), np.empty(len(emit))) if keep else (None, None)
    now = None
    for t, n in enumerate(seq.width):
        a, b = seq.at[t], seq.at[t] + n
        now = (model.start[kind] if t == 0 else now[:n] @ model.step) * emit[a:b]
        sums = now.sum(1)
        now /= sums[:, None]
        logs[:n] += np.log(sums)
        if keep:
            alpha[a:b], scale[a:b] = now, sums
    return (logs, alpha, emit, scale) if keep else logs


def expect(model: Model, seq: Sequences, kind: np.ndarray) -> Model:
    """Expected counts of starts, steps and emissions, given the sequences."""
    _, alpha, emit, scale = forward(model, seq, kind, keep=True)
    beta = np.ones_like(alpha)
    for t in range(len(seq.width) - 2, -1, -1):
        n, a, b = seq.width[t + 1], seq.at[t], seq.at[t + 1]
        later = emit[b:b + n] * beta[b:b + n] / scale[b:b + n, None]
        beta[a:a + n] = later @ model.step.T
    gamma = alpha * beta
    starts = np.zeros((2, gamma.shape[1]))
    np.add.at(starts, kind, gamma[:len(kind)])
    rest = slice(int(seq.at[1]) if len(seq.at) > 1 else 0, None)
    later = emit[rest] * beta[rest] / scale[rest, None]
    steps = model.step * (alpha[seq.before[rest]].T @ later)
    emitted = np.stack([np.bincount(seq.tokens, gamma[:, k], len(model.emit)) for k in range(gamma.shape[1])], 1)
    return Model(starts, steps, emitted)


def _segments(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of up to ``size`` tokens, and whether each goes on within a text (1) or starts one (0)."""
    length = np.diff(first)
    n = -(-length // size)
    row = np.repeat(np.arange(len(length)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.append(first[:-1][row] + k * size, first[-1]), (k > 0).astype(np.int64)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int32)


def _runs(bucket: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin, and the end."""
    return np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))


TOKENS = "block long, bucket int, data binary, first binary, held binary, ids array<long>"


def _blocks(docs: DataFrame, counts: Counts, ask: bool) -> tuple[DataFrame, DataFrame, int]:
    """Texts as tokens, a row per block; what the blocks ask for, a row (bucket, block, data) of hashes each; tasks to work in.

    A block's tokens are numbered by its own distinct ones: first those in ``Model.emit``, whose bits are set in ``held``, then
    the others, by hash.  Without ``ask``, the others are the class."""
    hashes, ids, _ = counts.held
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((hashes, ids))
    symbols, bits = counts.symbols, counts.bits
    kinds = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("first", pa.binary()), ("held", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def work(batches):
        hashes, ids = shared.value
        block = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "text", BATCH):
            words = words_of(batch, "text", SPACED)
            rows = batch.num_rows
            at = _find(hashes, words.hash)
            known = at >= 0
            code = np.full(len(at), symbols)
            code[known] = ids[at[known]]
            rest = np.zeros(0, np.uint64)
            if ask:
                rest, place = np.unique(words.hash[~known], return_inverse=True)
                code[~known] = symbols + 2 + place
            tokens = np.full(len(at) + rows, symbols + 1)
            tokens[np.arange(len(at)) + words.row] = code
            met = np.zeros(symbols + 2 + len(rest), bool)
            met[tokens] = True
            tokens = (np.cumsum(met) - 1)[tokens]
            runs = _runs(_bucket(rest, bits))
            asked = [rest[a:b] for a, b in zip(runs, runs[1:])]
            none = [None] * len(asked)
            named = batch.column(0).to_pylist() if batch.num_columns > 1 else []
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * (1 + len(asked)), pa.int64()), pa.array([-1, *_bucket(rest[runs[:-1]], bits).tolist()], pa.int32()),
                pa.array([tokens.astype(np.uint16 if met.sum() <= 1 << 16 else np.uint32).tobytes(), *[h.tobytes() for h in asked]], pa.binary()),
                pa.array([(words.first + np.arange(rows + 1)).astype(np.int64).tobytes(), *none], pa.binary()),
                pa.array([np.packbits(met[:symbols + 2]).tobytes(), *none], pa.binary()),
                pa.array([named, *none], pa.list_(pa.int64()))], schema=kinds)
            block += 1

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(sc.defaultParallelism, -(-size // TASK))
    both = cut(docs.mapInArrow(work, TOKENS))
    return both.filter("bucket < 0").drop("bucket"), both.filter("bucket >= 0").select("bucket", "block", "data"), tasks


def _matrix(column, kind: type, width: int = 1) -> np.ndarray:
    flat = np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind)
    return flat.reshape(-1, width) if width > 1 else flat


WORDS = "bucket int, hashes binary, n binary, weights binary"


def _lean(hashes: np.ndarray, states: int) -> np.ndarray:
    """0.2 to 1.8 by a fixed rule, for each word and state."""
    odd = np.arange(1, 2 * states, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return 0.2 + 1.6 * (mix(hashes[:, None] ^ odd) >> np.uint64(11)) / 2**53


def _others(counts: Counts, states: int) -> DataFrame:
    """The words that are not in ``Model.emit``, by bucket, with first weights if they have their own emissions."""
    bits, every = counts.bits, counts.every
    shared = counts.rows.sparkSession.sparkContext.broadcast(counts.held[0])

    def place(batches):
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            out = np.flatnonzero(_find(shared.value, h) < 0)
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(h[out], bits)), *batch.take(pa.array(out)).columns], names=["bucket", "h", "n"])

    def pack(rows: pa.Table) -> pa.Table:
        h, n = np.asarray(rows["h"]).view(np.uint64), np.asarray(rows["n"])
        order = np.argsort(h)
        h, n = h[order], n[order]
        weights = ((n[:, None] + SMOOTH) * _lean(h, states)).astype(np.float32).tobytes() if every else None
        return pa.table({"bucket": rows["bucket"][:1], "hashes": pa.array([h.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()),
                         "weights": pa.array([weights], pa.binary())})

    return cut(counts.rows.select("h", "n").mapInArrow(place, "bucket int, h long, n long").groupBy("bucket").applyInArrow(pack, WORDS))


def _total(words: DataFrame, states: int) -> np.ndarray:
    """Sums of all weights."""
    names = [f"s{k}" for k in range(states)]

    def work(batches):
        total = np.zeros(states)
        for batch in batches:
            total += _matrix(batch.column(0), np.float32, states).sum(0, dtype=float)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

    sums = words.select("weights").mapInArrow(work, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n) for n in names]).first()
    return np.array([x or 0.0 for x in sums])


ANSWERS = "block long, bucket int, data binary, n binary"


def _deals(wants: DataFrame, counts: Counts) -> int:
    """Tasks over which each bucket's asks are dealt."""
    asked = wants.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0] // 8
    return max(1, -(-asked // (ASKS << counts.bits)))


def _dealt(rows: DataFrame, deals: int) -> DataFrame:
    """Blocks in turn; what a block asks a bucket for stays together."""
    return rows.withColumn("deal", F.pmod("block", F.lit(deals)).cast("int"))


def _answers(wants: DataFrame, words: DataFrame, states: int, deals: int, counted: bool = False) -> DataFrame:
    """The weights, and if ``counted`` the counts, of what each block asks for, in its order; zeros for unknown words.

    A bucket's words go to each of its ``deals`` tasks."""

    def work(asked: pa.Table, known: pa.Table) -> pa.Table:
        hashes = _matrix(known["hashes"], np.uint64)
        weights = _matrix(known["weights"], np.float32, states)
        n = _matrix(known["n"], np.int64)
        out, times = [], []
        for data in asked["data"].to_pylist():
            at = _find(hashes, np.frombuffer(data, np.uint64))
            hit = at >= 0
            some = np.zeros((len(at), states), np.float32)
            if len(weights):
                some[hit] = weights[at[hit]]
            out.append(some.tobytes())
            if counted:
                known_times = np.zeros(len(at), np.int64)
                if len(n):
                    known_times[hit] = n[at[hit]]
                times.append(known_times.tobytes())
        return pa.table({"block": asked["block"], "bucket": asked["bucket"], "data": pa.array(out, pa.binary()),
                         "n": pa.array(times, pa.binary()) if counted else pa.nulls(len(asked), pa.binary())})

    copies = words.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return _dealt(wants, deals).groupBy("bucket", "deal").cogroup(copies.groupBy("bucket", "deal")).applyInArrow(work, ANSWERS)


def _met(tokens: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """Every block's tokens beside the answers it got."""
    got = answers.repartition(tasks, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", F.col("data").alias("weights"), "n"))).alias("got"))
    return tokens.repartition(tasks, "block").join(got, "block", "left")


def _gathered(batches: Iterator[pa.RecordBatch], states: int):
    """Block by block: its number, tokens, where rows begin, rows of ``Model.emit``, ids, the buckets of its other words with
    their sizes, and the words' weights and counts."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            block, data, first, held, ids, got = (batch.column(names.index(c))[i].as_py() for c in ("block", "data", "first", "held", "ids", "got"))
            first, got = np.frombuffer(first, np.int64), got or []
            tokens = np.frombuffer(data, np.uint16 if len(data) == 2 * first[-1] else np.uint32).astype(np.int64)
            held = np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8)))
            weights = np.frombuffer(b"".join(x["weights"] for x in got), np.float32).reshape(-1, states).astype(float)
            n = np.frombuffer(b"".join(x["n"] for x in got if x["n"] is not None), np.int64)
            yield block, tokens, first, held, ids, ([x["bucket"] for x in got], [len(x["weights"]) // (4 * states) for x in got]), weights, n


def _initial(counts: Counts, states: int) -> Model:
    """States that keep to themselves and each lean to some of the words, by a fixed rule."""
    hashes, ids, n = counts.held
    weight, lean = np.zeros(counts.symbols + 2), np.ones((counts.symbols + 2, states))
    weight[ids], lean[ids] = n, _lean(hashes, states)
    weight[-2:] = counts.class_total, counts.ends
    lean[-2] = _lean(np.zeros(1, np.uint64), states)
    emit = (weight[:, None] + SMOOTH) * lean
    step = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    rest = _others(counts, states)
    scale = emit.sum(0) + _total(rest, states)
    return Model(np.full((2, states), 1.0 / states), step, emit / scale, rest, scale)


def _normal(x: np.ndarray, extra: float) -> np.ndarray:
    x = x + extra
    return x / x.sum(-1, keepdims=True)


SUMS = "bucket int, hashes binary, n binary, weights binary, totals binary"


def _summed(wants: DataFrame, expected: DataFrame, states: int, deals: int) -> DataFrame:
    """Expected counts added up: a row of words and new weights for each bucket, and the tasks' own totals (buckets below 0).

    ``expected`` (bucket, block, data) has what blocks expect of the words that they asked for, in that order.  Parts
    of a bucket are added up by deal, then together."""

    def part(asked: pa.Table, got: pa.Table) -> pa.Table:
        number = (got if got.num_rows else asked)["bucket"][:1]
        if number[0].as_py() < 0:
            total = 0.0
            for data in got["data"].to_pylist():
                total = total + np.frombuffer(data, np.float32).astype(float)
            return pa.table({"bucket": number, "hashes": pa.nulls(1, pa.binary()), "n": pa.nulls(1, pa.binary()), "weights": pa.nulls(1, pa.binary()),
                             "totals": pa.array([total.tobytes()], pa.binary())})
        words, at = np.unique(_matrix(asked.sort_by("block")["data"], np.uint64), return_inverse=True)
        values = _matrix(got.sort_by("block")["data"], np.float32, states)
        sums = np.stack([np.bincount(at, values[:, k], len(words)) for k in range(states)], 1)
        return pa.table({"bucket": number, "hashes": pa.array([words.tobytes()], pa.binary()), "n": pa.nulls(1, pa.binary()),
                         "weights": pa.array([sums.astype(np.float32).tobytes()], pa.binary()), "totals": pa.nulls(1, pa.binary())})

    def whole(parts: pa.Table) -> pa.Table:
        number = parts["bucket"][:1]
        if number[0].as_py() < 0:
            total = sum(np.frombuffer(t) for t in parts["totals"].to_pylist())
            return pa.table({"bucket": number, "hashes": pa.nulls(1, pa.binary()), "n": pa.nulls(1, pa.binary()), "weights": pa.nulls(1, pa.binary()),
                             "totals": pa.array([total.tobytes()], pa.binary())})
        words, at = np.unique(_matrix(parts["hashes"], np.uint64), return_inverse=True)
        values = _matrix(parts["weights"], np.float32, states)
        sums = np.stack([np.bincount(at, values[:, k], len(words)) for k in range(states)], 1)
        return pa.table({"bucket": number, "hashes": pa.array([words.tobytes()], pa.binary()), "n": pa.nulls(1, pa.binary()),
                         "weights": pa.array([(sums + SMOOTH / states).astype(np.float32).tobytes()], pa.binary()), "totals": pa.nulls(1, pa.binary())})

    parts = _dealt(wants, deals).groupBy("bucket", "deal").cogroup(expected.groupBy("bucket", "deal")).applyInArrow(part, SUMS)
    return parts.groupBy("bucket").applyInArrow(whole, SUMS)


def train_model(train: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS, segment: int = SEGMENT) -> Model:
    """Baum-Welch over all training texts, with emissions of every word.

    In a round each block of texts asks the buckets of its rarer words for their emissions, and gives back what it expects
    of each; a bucket sums that.  What is expected of the ``lookup`` most frequent words is summed by symbol for the
    driver, which gets (symbols + 2 * states + 2) rows of ``states`` numbers.  Long texts are cut into segments for
    training; one that goes on has its own start distribution.
    """
    sc = train.sparkSession.sparkContext
    model = _initial(counts, states)
    tokens, wants, tasks = _blocks(bare(train, "text"), counts, counts.every)
    symbols = counts.symbols
    deals = _deals(wants, counts)
    kinds = pa.schema([("bucket", pa.int32()), ("deal", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
    slices = [(part, a) for part, size in enumerate((2, states, symbols + 2)) for a in range(0, size, SLICE)]
    packed = lambda parts: pa.array([x.astype(np.float32).tobytes() for x in parts], pa.binary())

    for _ in range(rounds):
        shared = sc.broadcast((model.start, model.step, model.emit, model.scale))

        def work(batches, shared=shared):
            start, step, emit, scale = shared.value
            sums = [np.zeros_like(x) for x in (start, step, emit)]
            for block, local, first, held, _, (buckets, sizes), weights, _ in _gathered(batches, states):
                bounds, kind = _segments(first, segment)
                seq = Sequences(local, bounds)
                got = expect(Model(start, step, np.concatenate([emit[held], weights / scale])), seq, kind[seq.order])
                sums[0] += got.start
                sums[1] += got.step
                sums[2][held] += got.emit[:len(held)]
                other = got.emit[len(held):]
                sums[2][symbols] += other.sum(0)
                ends = np.cumsum([0, *sizes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets, pa.int32()), pa.array([block % deals] * len(sizes), pa.int32()), pa.array([block] * len(sizes), pa.int64()),
                     packed(other[a:b] for a, b in zip(ends, ends[1:]))], schema=kinds)
            some = [(-1 - k, sums[part][a:a + SLICE]) for k, (part, a) in enumerate(slices)]
            some = [(k, x) for k, x in some if x.any()]
            deal = TaskContext.get().partitionId() // 256   # so many tasks' totals are added up at once
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in some], pa.int32()), pa.array([deal] * len(some), pa.int32()), pa.nulls(len(some), pa.int64()), packed(x for _, x in some)], schema=kinds)

        # written, so that the answers' shuffles and what they came from are gone before the sums are dealt
        out = cut(_met(tokens, _answers(wants, model.rest, states, deals), tasks).mapInArrow(work, "bucket int, deal int, block long, data binary"), wait=True)
        if counts.every:
            model.rest = None
            release(train.sparkSession, wait=True)
        out = cut(_summed(wants, out, states, deals), wait=True)
        got = out.filter("bucket < 0").select("bucket", "totals").toArrow()
        sums = [np.zeros_like(x) for x in (model.start, model.step, model.emit)]
        for bucket, data in zip(*[got[c].to_pylist() for c in ("bucket", "totals")]):
            part, i = slices[-1 - bucket]
            sums[part][i:i + SLICE] = np.frombuffer(data).reshape(-1, states)
        rest, scale = model.rest, 0.0
        if counts.every:
            rest = out.filter("bucket >= 0").drop("totals")
            scale = sums[2][symbols] + counts.others * SMOOTH / states
            sums[2][symbols] = 0.0
        emit = sums[2] + SMOOTH / states
        scale = scale + emit.sum(0)
        model = Model(_normal(sums[0], 1e-3), _normal(sums[1], 1e-3), emit / scale, rest, scale)
        shared.destroy()
        out = rest = None
        release(train.sparkSession, wait=True)
    if counts.every and rounds:
        model.rest = cut(model.rest.drop("n").join(_others(counts, states).select("bucket", "n"), "bucket").select("bucket", "hashes", "n", "weights"))
    return model


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row's whole text.

    The model emits every training word as itself, and all others as one unknown word; so each text's score is the exact
    logarithm of its probability.  If only some words have emissions of their own, the others are emitted as the class, times
    the word's share (c + 0.5) / (tokens + 0.5 * (words + 1)) of it.  Words beyond the lookup meet their counts and emissions
    by bucket, block by block; a block asks for a word once, so no word is a hot key.

    A null or empty text is its end alone.  Every row gives a row, repeated ones too.
    """
    rows = bare(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    release(docs.sparkSession)   # the blocks of the training go first
    tokens, wants, tasks = _blocks(rows, counts, True)
    _, ids, n = counts.held
    counted = np.zeros(counts.symbols + 2, np.int64)
    counted[ids], counted[-1] = n, counts.ends
    shared = docs.sparkSession.sparkContext.broadcast((counted, model.start, model.step, model.emit, model.scale))
    states, symbols = len(model.step), counts.symbols
    total, distinct, class_total, class_distinct = counts.total, counts.distinct, counts.class_total, counts.class_distinct

    def work(batches):
        counted, start, step, emit, scale = shared.value
        share = lambda n, total, distinct: (n + SMOOTH) / (total + SMOOTH * (distinct + 1))
        for _, local, first, held, ids, _, weights, n in _gathered(batches, states):
            times = np.concatenate([counted[held], n])
            own = weights.any(1)[:, None]
            other = np.where(own, weights / scale, emit[symbols] * share(n, class_total, class_distinct)[:, None])
            rows = len(ids)
            seq = Sequences(local, first)
            logs = np.empty(rows)
            logs[seq.order] = forward(Model(start, step, np.concatenate([emit[held], other])), seq, np.zeros(rows, np.int64)) / np.log(10)
            row = np.repeat(np.arange(rows), np.diff(first))
            known = np.bincount(row, (times > 0)[local], rows).astype(np.int64)
            base = np.bincount(row, np.log10(share(times, total, distinct))[local], rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(logs)],
                                             names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return _met(tokens, _answers(wants, model.rest, states, _deals(wants, counts), True), tasks).mapInArrow(work, SCORED)


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by counts and a model learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 1)
    train = docs.filter(~out)
    counts = count_words(train)
    scored = score(docs, counts, train_model(train, counts))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(counts.total).cast("long").alias("train_tokens"), "base_score", "score")
