"""Following log files as they grow: a streaming source whose offset is a byte position in each file."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, path string, at long"
SPLIT = 8 << 20          # bytes that one task reads, about
OPENING = 1 << 18        # bytes that opening one file counts as
_LOOK = 1 << 16          # bytes that are looked through at once for the end of a line


def _address(path: str) -> str:
    """Spark writes local addresses with one slash."""
    return path if not path.startswith("file:/") else "file:///" + path.removeprefix("file:").lstrip("/")


@dataclass
class Stretch:
    """Lines of a file that begin in ``low`` to ``high``; ``inside``: the byte before ``low`` may be in the middle of one."""

    path: str
    low: int
    high: int
    inside: bool


@dataclass
class Share(InputPartition):
    """What one task reads: a long stretch, or several short ones."""

    stretches: list[Stretch]


class TailReader(DataSourceStreamReader):
    """Offsets are {path: bytes taken}; what is taken ends with a line's end, so a line that is still written waits.

    A micro-batch takes at most ``bytes_per_batch`` bytes, or one longer line.  Files that are there at the first start are taken
    from their ends on (``from_end``) or whole, later ones whole; a file that has become shorter is taken anew.  What
    has been committed is noted below ``progress``, so that the bound also holds after a restart."""

    def __init__(self, options: dict):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(_address(options["root"]))
        self.suffix, self.bound = options.get("suffix", ".log"), int(options.get("bytesperbatch", 64 << 20))
        self.from_end, self.progress = options.get("fromend", "true") == "true", None
        self.taken: dict[str, int] | None = None
        if "progress" in options:
            self.keeper, where = fs.FileSystem.from_uri(_address(options["progress"]))
            self.progress = posixpath.join(where, "taken.json")
            if self.keeper.get_file_info(self.progress).type == fs.FileType.File:
                with self.keeper.open_input_stream(self.progress) as file:
                    self.taken = json.loads(file.read())

    def _sizes(self) -> dict[str, int]:
        """Files with the suffix, in path order; hidden files and folders (``.``, ``_``), such as unfinished writes, are passed over."""
        from pyarrow import fs

        found, folders = {}, [self.root]
        while folders:
            for f in self.files.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True)):
                if f.base_name[:1] in ("", ".", "_"):
                    continue
                if f.type == fs.FileType.Directory:
                    folders.append(f.path)
                elif f.type == fs.FileType.File and f.path.endswith(self.suffix):
                    found[f.path] = f.size
        return dict(sorted(found.items()))

    def _line_end(self, path: str, low: int, high: int) -> int:
        """After the last line end in ``low`` to ``high``; ``low`` if there is none."""
        with self.files.open_input_file(path) as file:
            while high > low:
                begin = max(low, high - _LOOK)
                file.seek(begin)
                at = file.read(high - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                high = begin
        return low

    def _next_line(self, path: str, low: int, size: int) -> int:
        """After the first line end from ``low`` on; ``low`` if there is none."""
        with self.files.open_input_file(path) as file:
            file.seek(low)
            at = low
            while at < size:
                data = file.read(min(_LOOK, size - at))
                if not data:
                    break
                found = data.find(b"\n")
                if found >= 0:
                    return at + found + 1
                at += len(data)
        return low

    def initialOffset(self) -> dict:
        return {p: self._line_end(p, 0, n) for p, n in self._sizes().items()} if self.from_end else {}

    def latestOffset(self) -> dict:
        if self.taken is None:
            self.taken = self.initialOffset()
        left, sizes = self.bound, self._sizes()
        now = {p: n for p, n in self.taken.items() if p in sizes}
        # the shortest rests first, so that a flood in one file does not hold up the others
        rests = sorted((sizes[p] - self._at(now, p, sizes[p]), p) for p in sizes)
        for k, (rest, path) in enumerate(rests):
            low = self._at(now, path, sizes[path])
            if rest <= 0 or left <= 0:
                continue
            share = max(1, left // (len(rests) - k))
            high = self._line_end(path, low, min(sizes[path], low + share))
            if high == low and left == self.bound:      # nothing else is taken: a line longer than its share
                high = self._next_line(path, low, sizes[path])
            if high > low:
                now[path] = high
                left -= high - low
        self.taken = now
        return now

    @staticmethod
    def _at(taken: dict[str, int], path: str, size: int) -> int:
        at = taken.get(path, 0)
        return at if at <= size else 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Short stretches go together, so that a micro-batch has tasks by its bytes and not one for every file."""
        self.taken = dict(end)
        shares, room = [], 0
        for path, high in end.items():
            low = self._at(start, path, high)
            for at in range(low, high, SPLIT):
                stretch = Stretch(path, at, min(high, at + SPLIT), at > low)
                cost = stretch.high - at + OPENING
                if cost > room:
                    shares.append(Share([]))
                    room = SPLIT + OPENING
                shares[-1].stretches.append(stretch)
                room -= cost
        return shares

    def commit(self, end: dict) -> None:
        if self.progress:
            self.keeper.create_dir(posixpath.dirname(self.progress))
            with self.keeper.open_output_stream(self.progress) as file:
                file.write(json.dumps(end).encode())

    def read(self, part: Share) -> Iterator[pa.RecordBatch]:
        for stretch in part.stretches:
            yield from self._lines(stretch)

    def _lines(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(part.path) as file:
            at = part.low
            if part.inside:                             # the line that crosses into this stretch is the one before's
                at = self._next_line(part.path, part.low - 1, part.high)
                if at == part.low - 1:
                    return
            file.seek(at)
            data = file.read(max(0, part.high - at))
            while data and not data.endswith(b"\n"):     # the last line goes on in the next stretch
                more = file.read(_LOOK)
                cut = more.find(b"\n")
                data += more if cut < 0 else more[:cut + 1]
                if not more:
                    break
        lines, places = data.split(b"\n")[:-1], []
        for line in lines:
            places.append(at)
            at += len(line) + 1
        text = [line.removesuffix(b"\r").decode(errors="replace") for line in lines]
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array([part.path] * len(text), pa.string()), pa.array(places, pa.int64())], names=["value", "path", "at"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_log_files(spark: SparkSession, root: str, suffix: str = ".log", bytes_per_batch: int = 64 << 20, from_end: bool = True, progress: str | None = None) -> DataFrame:
    """Lines of every growing file below ``root`` as a stream: (value, path, at), ``at`` being the line's first byte.

    ``root`` and ``progress`` are paths or addresses that all executors reach.  A file that is renamed away before its rest was
    taken stops the stream, so that no line is lost silently."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tail").options(root=root, suffix=suffix, bytesPerBatch=str(bytes_per_batch), fromEnd=str(from_end).lower())
    return (reader.option("progress", progress) if progress else reader).load()
