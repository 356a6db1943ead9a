"""Leading-edge throttle: the one sequential rule behind every gate, split over time slices.

A row of a key is *accepted* when it is forced, or when nothing of that key was accepted before,
or when at least ``cooldown`` microseconds have passed since the last accepted row.  Inert rows
are never accepted.  Each verdict depends on the one before, so a plain fold puts a whole key in one
task.  Here every key is one or more time slices:

1. every slice of a key with several is summarised, in parallel, as a step function from "time of the
   last accepted row before the slice" to "last accepted row at its end";
2. the step functions of neighbouring slices are composed, in parallel, to one per group of slices;
3. the groups of a key are applied in time order, which gives the state each group starts from, and
   then, in parallel again, the slices of each group;
4. every slice is run, in parallel, from its known state; the first of a key starts from nothing.

A step function has at most as many steps as there are rows within one cooldown of its start, and equal
steps are merged; so a group, however many slices it spans, hands on no more than that.  Forced rows
make the function constant from there on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.operators.slices import WHOLE, Laid

GROUP = 64                      # neighbouring slices whose step functions are composed in one task
NEVER = np.iinfo(np.int64).max  # a step that applies whatever the state is
NONE = np.iinfo(np.int64).min   # no accepted row yet


@dataclass
class Steps:
    """State change of one stretch of rows: the first ``upto`` not below the last accepted time
    names the new last accepted row; past the end the state stays."""

    rows: int
    upto: np.ndarray
    us: np.ndarray
    id: np.ndarray
    pos: np.ndarray

    def apply(self, state: tuple[int, int, int]) -> tuple[int, int, int]:
        last, last_id, pos = state
        k = int(np.searchsorted(self.upto, last, side="left"))
        if k < len(self.upto):
            return int(self.us[k]), int(self.id[k]), int(self.pos[k])
        return last, last_id, pos + self.rows

    def then(self, later: Steps) -> Steps:
        k = np.searchsorted(later.upto, self.us, side="left")
        hit = k < len(later.upto)
        k = np.where(hit, k, 0)
        pick = lambda new, old: np.where(hit, new[k], old) if len(new) else old
        tail = later.upto > (self.upto[-1] if len(self.upto) else NONE)
        upto = np.concatenate([self.upto, later.upto[tail]])
        us = np.concatenate([pick(later.us, self.us), later.us[tail]])
        ids = np.concatenate([pick(later.id, self.id), later.id[tail]])
        pos = np.concatenate([pick(later.pos, self.pos + later.rows), later.pos[tail]])
        keep = np.append(ids[1:] != ids[:-1], True) if len(ids) else np.zeros(0, bool)
        return Steps(self.rows + later.rows, upto[keep], us[keep], ids[keep], pos[keep])


class Stretch:
    """The groups of one Arrow batch, all handled by the same array operations.

    Times are taken relative to the start of their group and shifted by the group number, so one
    sorted array answers "first row that may follow" for every group at once.
    """

    def __init__(self, us, cooldown, forced, inert, starts):
        n = len(us)
        self.n, self.us = n, us
        firsts = np.flatnonzero(starts)
        if not len(firsts) or firsts[0] != 0:
            firsts = np.concatenate([[0], firsts])
        self.firsts = firsts
        self.ends = np.append(firsts[1:], n)
        self.group = np.repeat(np.arange(len(firsts)), self.ends - firsts)
        self.base = us[firsts]
        since = us - self.base[self.group]
        free = ~(forced | inert)
        self.shift = int(cooldown[free].max()) + 1 if free.any() else 1
        self.span = int(since.max()) + self.shift + 1
        floor = self.group * self.span
        self.floor = floor
        self.release = floor + np.where(free, since - cooldown + self.shift, 0)
        self.reach = np.maximum.accumulate(self.release)
        self.due = floor + since + self.shift
        self.forced = np.flatnonzero(forced)
        after = np.append(self.forced, n)
        rows = np.arange(n)
        self.stop = np.minimum(
            after[np.searchsorted(self.forced, rows, side="right")], self.ends[self.group]
        )
        self.first_forced = np.minimum(
            after[np.searchsorted(self.forced, firsts, side="left")], self.ends
        )

    def following(self, rows):
        """First free row that the given accepted rows let through; may lie past ``stop``."""
        return np.searchsorted(self.reach, self.due[rows], side="left")

    def run(self, last):
        """Accepted flags, given the last accepted time of each group before this batch."""
        accepted = np.zeros(self.n, dtype=bool)
        known = last != NONE
        target = np.where(known, np.where(known, last, 0) - self.base + self.shift, 1)
        entry = np.searchsorted(
            self.reach, np.arange(len(self.firsts)) * self.span + np.maximum(target, 1), side="left"
        )
        current = np.concatenate([entry[entry < self.first_forced], self.forced])
        while len(current):
            accepted[current] = True
            following = self.following(current)
            current = following[following < self.stop[current]]
        return accepted

    def summaries(self, ids) -> list[Steps]:
        """One step function per group."""
        rows = np.arange(self.n)
        following = self.following(rows)
        jump = np.where(
            following < self.stop,
            following,
            np.where(self.stop < self.ends[self.group], self.stop, rows),
        )
        while True:  # follow the chains to their ends, doubling the stride
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        is_first = np.zeros(self.n, dtype=bool)
        is_first[self.firsts] = True
        before = np.where(is_first, self.floor, np.concatenate([[0], self.reach[:-1]]))
        limit = self.first_forced[self.group]
        is_forced = np.zeros(self.n, dtype=bool)
        is_forced[self.forced] = True
        entry = np.flatnonzero(
            (rows <= limit)
            & (is_forced | (self.release > before))
            & (before < self.floor + self.shift)
        )
        group = self.group[entry]
        last = jump[entry]
        upto = np.where(is_forced[entry], NEVER, self.base[group] + (self.release - self.floor)[entry] - self.shift)
        keep = np.append((last[1:] != last[:-1]) | (group[1:] != group[:-1]), True) if len(entry) else np.zeros(0, bool)
        group, last, upto = group[keep], last[keep], upto[keep]
        us, pos, found = self.us[last], self.ends[group] - last, ids[last]
        cuts = np.searchsorted(group, np.arange(len(self.firsts) + 1))
        return [
            Steps(int(self.ends[g] - self.firsts[g]), upto[a:b], us[a:b], found[a:b], pos[a:b])
            for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
        ]


def _ints(batch, name):
    column = batch.column(name).cast(pa.int64())
    return column.fill_null(int(NONE)).to_numpy(zero_copy_only=False)


def _flags(batch, name):
    return batch.column(name).fill_null(False).to_numpy(zero_copy_only=False).astype(bool, copy=False)


def _stretch(batch) -> Stretch:
    return Stretch(
        _ints(batch, "us"), _ints(batch, "th_cooldown"), _flags(batch, "th_forced"),
        _flags(batch, "th_inert"), _ints(batch, "slice_row") == 1,
    )


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches short enough for the shifted times of all their groups to fit in 62 bits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        us = _ints(batch, "us")
        span = int(us.max() - us.min()) + int(_ints(batch, "th_cooldown").max()) + 2
        step = max(1, min(batch.num_rows, (2**62 - 1) // span))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _summarise(key: str, key_type: pa.DataType):
    names = [key, "slice", "rows", "upto", "last_us", "last_id", "last_pos"]

    def emit(keys, slices, steps: list[Steps]):
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, type=key_type), pa.array(slices, type=pa.int64()), *_lists(steps)], names=names
        )

    def run(batches):
        open_key = open_slice = open_steps = None
        for batch in _small(batches):
            stretch = _stretch(batch)
            steps = stretch.summaries(_ints(batch, "id"))
            firsts = pa.array(stretch.firsts)
            keys = batch.column(key).take(firsts).to_pylist()
            slices = batch.column("slice").take(firsts).to_pylist()
            if open_steps is not None:
                if batch.column("slice_row")[0].as_py() != 1:
                    steps[0] = open_steps.then(steps[0])
                else:
                    yield emit([open_key], [open_slice], [open_steps])
            if len(steps) > 1:
                yield emit(keys[:-1], slices[:-1], steps[:-1])
            open_key, open_slice, open_steps = keys[-1], slices[-1], steps[-1]
        if open_steps is not None:
            yield emit([open_key], [open_slice], [open_steps])

    return run


def _steps(batch) -> list[Steps]:
    counts, arrays = batch.column("rows").to_pylist(), []
    for name in ("upto", "last_us", "last_id", "last_pos"):
        column = batch.column(name)
        arrays.append((column.offsets.to_numpy(), column.values.to_numpy()))
    return [Steps(n, *[values[o[i]:o[i + 1]] for o, values in arrays]) for i, n in enumerate(counts)]


def _lists(steps: list[Steps]) -> list[pa.Array]:
    offsets = np.concatenate([[0], np.cumsum([len(s.upto) for s in steps])]).astype(np.int32)

    def lists(field):
        flat = np.concatenate([getattr(s, field) for s in steps]).astype(np.int64) if steps else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return [pa.array([s.rows for s in steps], type=pa.int64()), lists("upto"), lists("us"), lists("id"), lists("pos")]


def _compose(key: str, key_type: pa.DataType):
    """One step function per (key, bunch): those of its slices, one after the other."""

    def emit(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], type=key_type), pa.array([d[1] for d in done], type=pa.int64()), *_lists([d[2] for d in done])],
            names=[key, "bunch", "rows", "upto", "last_us", "last_id", "last_pos"],
        )

    def run(batches):
        current = None
        for batch in batches:
            done = []
            keys, bunches = batch.column(key).to_pylist(), batch.column("bunch").to_pylist()
            starts = batch.column("nth").to_pylist()
            for k, b, first, steps in zip(keys, bunches, starts, _steps(batch)):
                if first == 1:
                    if current is not None:
                        done.append(current)
                    current = (k, b, steps)
                else:
                    current = (k, b, current[2].then(steps))
            if done:
                yield emit(done)
        if current is not None:
            yield emit([current])

    return run


def _carry(key: str, key_type: pa.DataType, part: str, begun: bool):
    """Apply step functions in order; gives the state before each.

    The first of a group starts from nothing or, if ``begun``, from the state its rows bring along."""
    states = ("carry_us", "carry_id", "carry_pos")

    def run(batches):
        state = (NONE, NONE, 0)
        for batch in batches:
            out = ([], [], [], [], [])
            keys, parts = batch.column(key).to_pylist(), batch.column(part).to_pylist()
            starts = batch.column("nth").to_pylist()
            given = [_ints(batch, name) for name in states] if begun else None
            for i, steps in enumerate(_steps(batch)):
                if starts[i] == 1:
                    state = (NONE, NONE, 0)
                    if begun and given[0][i] != NONE:
                        state = tuple(int(column[i]) for column in given)
                for values, value in zip(out, (keys[i], parts[i], *state)):
                    values.append(value)
                state = steps.apply(state)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], type=key_type),
                    *[pa.array([None if v == NONE else v for v in c], type=pa.int64()) for c in out[1:]],
                ],
                names=[key, part, *states],
            )

    return run


def _judge(out_names: list[str]):
    def run(batches):
        state = (NONE, NONE, 0)
        for batch in _small(batches):
            stretch = _stretch(batch)
            ids = _ints(batch, "id")
            firsts = stretch.firsts
            last, last_id, pos = (
                _ints(batch, name)[firsts].copy() for name in ("carry_us", "carry_id", "carry_pos")
            )
            pos[pos == NONE] = 0
            if batch.column("slice_row")[0].as_py() != 1:
                last[0], last_id[0], pos[0] = state
            accepted = stretch.run(last)
            rows, group = np.arange(stretch.n), stretch.group
            newest = np.maximum.accumulate(np.where(accepted, rows, -1))
            own = newest >= firsts[group]
            at = np.where(own, newest, 0)
            anchor_us = np.where(own, stretch.us[at], last[group])
            anchor_id = np.where(own, ids[at], last_id[group])
            position = np.where(own, rows - newest + 1, pos[group] + rows - firsts[group] + 1)
            state = (int(anchor_us[-1]), int(anchor_id[-1]), int(position[-1]))
            extra = {
                "accepted": pa.array(accepted),
                "anchor_us": pa.array(anchor_us, mask=anchor_us == NONE),
                "anchor_id": pa.array(anchor_id, mask=anchor_us == NONE),
                "position": pa.array(position.astype(np.int64)),
            }
            yield pa.RecordBatch.from_arrays(
                [extra[n] if n in extra else batch.column(n) for n in out_names], names=out_names
            )

    return run


def throttle(laid: Laid, cooldown_us, forced=None, inert=None) -> DataFrame:
    """Add accepted, anchor_us, anchor_id and position to laid-out rows with a unique ``id``.

    ``anchor`` is the newest accepted row up to and including the row itself, ``position`` counts
    rows from that anchor, starting at 1.  The rows of keys with several slices are read twice, so
    the rows should be cut.
    """
    rows, key = laid.rows, laid.key
    cooldown = cooldown_us if not isinstance(cooldown_us, int) else F.lit(cooldown_us)
    forced = F.lit(False) if forced is None else forced
    inert = F.lit(False) if inert is None else inert
    # The window states the distribution the Python step relies on, so neither a skew join nor
    # a coalesced shuffle can split a group between tasks.
    in_order = F.row_number().over(laid.order())
    marked = rows.withColumns(
        {"th_cooldown": cooldown.cast("bigint"), "th_inert": F.coalesce(inert, F.lit(False))}
    ).withColumn(
        "th_forced",
        ~F.col("th_inert") & (F.coalesce(forced, F.lit(False)) | (F.col("th_cooldown") <= 0)),
    )
    added = ("accepted", "anchor_us", "anchor_id", "position")
    kept = [f for f in rows.schema.fields if f.name not in (*added, "slice_row")]
    schema = T.StructType([*kept]).add("accepted", T.BooleanType())
    for name in added[1:]:
        schema = schema.add(name, T.LongType())
    marked = marked.select(*[f.name for f in kept], "th_cooldown", "th_forced", "th_inert")
    marked = marked.join(_carried(marked, laid), [key, "slice"], "left")
    return marked.withColumn("slice_row", in_order).mapInArrow(_judge(schema.names), schema)


def _carried(marked: DataFrame, laid: Laid) -> DataFrame:
    """State at the start of every slice of the keys that have several."""
    key = laid.key
    key_type = laid.rows.schema[key].dataType
    arrow_key = {T.BinaryType: pa.binary(), T.LongType: pa.int64()}.get(type(key_type), pa.string())
    named = f"{key} {key_type.simpleString()}"
    lists = "rows bigint, upto array<bigint>, last_us array<bigint>, last_id array<bigint>, last_pos array<bigint>"
    state = "carry_us bigint, carry_id bigint, carry_pos bigint"
    narrow = marked.filter(F.col("slice") != WHOLE).select(
        key, "slice", "us", "id", "th_cooldown", "th_forced", "th_inert"
    )
    summaries = narrow.withColumn("slice_row", F.row_number().over(laid.order())).mapInArrow(
        _summarise(key, arrow_key), f"{named}, slice bigint, {lists}"
    ).withColumn("bunch", F.floor(F.col("slice") / GROUP))
    in_bunch = F.row_number().over(Window.partitionBy(key, "bunch").orderBy("slice"))
    in_key = F.row_number().over(Window.partitionBy(key).orderBy("bunch"))
    bunches = summaries.withColumn("nth", in_bunch).mapInArrow(_compose(key, arrow_key), f"{named}, bunch bigint, {lists}")
    begins = bunches.withColumn("nth", in_key).mapInArrow(_carry(key, arrow_key, "bunch", False), f"{named}, bunch bigint, {state}")
    return (
        summaries.join(begins, [key, "bunch"])
        .withColumn("nth", in_bunch)
        .mapInArrow(_carry(key, arrow_key, "slice", True), f"{named}, slice bigint, {state}")
    )
