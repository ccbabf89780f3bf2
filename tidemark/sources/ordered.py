"""A stream of lines in their order of arrival, with admission control and an end of input.

Spark's text stream knows files, not lines: the lines of a batch have no order. This source (a Python data source) counts
in bytes. Files of a folder are taken in the order of their modification time and name, and are complete when they are
there; an offset is a file, a byte in it, and how many bytes were in the files before. So every line has an arrival number,
the bytes before it, whatever the batches and partitions it is read in, and a batch can end after any line.

A batch's bytes are split among tasks; a line belongs to the split it begins in. The driver only lists files, and with
``lines_per_batch`` reads as many lines as a batch may have.

If a file named like ``end_marker`` is in the folder, the input has an end: after the last line comes one control line so
late that it closes every window. The end is part of the offset, so over restarts that line comes once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.parsing import ParsePolicy, parse_lines

FORMAT = "ordered_lines"
SCHEMA = "value string, arrival bigint"

# Time of the control line at the end of input: the last second of the year 9999, in milliseconds.
END_MS = 253_402_300_799_000

# Without it Spark runs a source like this one in a single batch under ``availableNow``, and what that batch's progress closes
# would wait for the next run.
_CLOSING_BATCH = "spark.sql.streaming.triggerAvailableNowWrapper.enabled"

# Bytes of a split, and of what a task reads and passes on at once.
_SPLIT_BYTES, _READ_BYTES = 32 << 20, 1 << 20


@dataclass
class _Split(InputPartition):
    """Lines that begin in bytes ``begin:end`` of a file; ``base`` bytes come before the file."""

    path: str
    begin: int
    end: int
    base: int


@dataclass
class _End(InputPartition):
    """The control line at the end of input."""

    arrival: int


class OrderedLines(DataSource):
    """``spark.readStream.format("ordered_lines").option("path", folder)``; see the module."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.fs, self.folder = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        self.lines = int(options.get("lines_per_batch", 0))
        self.split_bytes = int(options.get("split_bytes", _SPLIT_BYTES))
        self.marker = options.get("end_marker", "")
        self.end_line = f"{END_MS},{options.get('control_key', 'W')}"
        self.at: dict | None = None  # the end of the last batch, as far as it is known here

    def _files(self) -> tuple[list[tuple[int, str, int]], bool]:
        """``modification time, path, size`` in order, and whether the input has ended."""
        found = self.fs.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        files = [f for f in found if f.type == fs.FileType.File]
        ended = bool(self.marker) and any(f.base_name == self.marker for f in files)
        lines = sorted((f.mtime_ns, f.path, f.size) for f in files if f.base_name[:1] not in "._" and f.base_name != self.marker)
        return lines, ended

    def initialOffset(self) -> dict:
        return {"mtime": 0, "path": "", "byte": 0, "base": 0, "ended": False}

    def _rest(self, start: dict, files: list[tuple[int, str, int]]) -> Iterator[tuple[int, str, int, int, int]]:
        """``modification time, path, first byte, size, base`` of the files, or their rest, after ``start``."""
        base = start["base"]
        for mtime, path, size in files:
            if (mtime, path) < (start["mtime"], start["path"]):
                continue
            yield mtime, path, start["byte"] if path == start["path"] else 0, size, base
            base += size

    def latestOffset(self) -> dict:
        files, ended = self._files()
        start = self.at or (self.initialOffset() if self.lines else None)
        if start is not None and start["ended"]:
            return start
        if not self.lines or start is None:
            self.at = self._up_to_now(files, ended)
        else:
            self.at = self._some_lines(start, files, ended)
        return self.at

    def _up_to_now(self, files: list[tuple[int, str, int]], ended: bool) -> dict:
        if not files:
            return self.initialOffset() | {"ended": ended}
        mtime, path, size = files[-1]
        return {"mtime": mtime, "path": path, "byte": size, "base": sum(f[2] for f in files[:-1]), "ended": ended}

    def _some_lines(self, start: dict, files: list[tuple[int, str, int]], ended: bool) -> dict:
        left, at = self.lines, start
        for mtime, path, begin, size, base in self._rest(start, files):
            with self.fs.open_input_file(path) as raw:
                raw.seek(begin)
                byte = begin
                while left and byte < size:
                    byte += _line_bytes(raw, byte, size)
                    left -= 1
            at = {"mtime": mtime, "path": path, "byte": byte, "base": base, "ended": False}
            if not left:
                return at
        return at | {"ended": ended and at == start}  # the end is a batch of its own

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:
            self.at = end  # after a restart the last batch is planned again
        splits: list[InputPartition] = []
        for mtime, path, begin, size, base in self._rest(start, self._files()[0]):
            if (mtime, path) > (end["mtime"], end["path"]):
                break
            stop = end["byte"] if path == end["path"] else size
            splits += [_Split(path, b, min(b + self.split_bytes, stop), base) for b in range(begin, stop, self.split_bytes)]
        if end["ended"] and not start["ended"]:
            splits.append(_End(end["base"] + end["byte"]))
        return splits

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, _End):
            yield _batch([self.end_line.encode()], [partition.arrival])
            return
        with self.fs.open_input_file(partition.path) as raw:
            at, rest = partition.begin, b""
            if at:  # a line that began before belongs to the split before
                raw.seek(at - 1)
                if raw.read(1) != b"\n":
                    at += _line_bytes(raw, at, raw.size())
            while at < partition.end:
                raw.seek(at + len(rest))
                block = raw.read(_READ_BYTES)
                lines = (rest + block).split(b"\n")
                rest = lines.pop() if block else b""
                values, arrivals = [], []
                for line in lines:
                    if at >= partition.end or (not block and not line):
                        break
                    values.append(line.removesuffix(b"\r"))
                    arrivals.append(partition.base + at)
                    at += len(line) + 1
                yield _batch(values, arrivals)
                if not block:
                    return


def _line_bytes(raw: pa.NativeFile, begin: int, size: int) -> int:
    """Length of the line at ``begin`` with its end."""
    at = begin
    while at < size:
        raw.seek(at)
        block = raw.read(min(4096, size - at))
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1 - begin
        at += len(block)
    return size - begin


def _batch(values: list[bytes], arrivals: list[int]) -> pa.RecordBatch:
    text = [v.decode("utf-8", "replace") for v in values]
    return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(arrivals, pa.int64())], ["value", "arrival"])


def stream_ordered_lines(
    spark: SparkSession, folder: str, lines_per_batch: int | None = None, end_marker: str | None = None, control_key: str = "W",
    split_bytes: int = _SPLIT_BYTES,
) -> DataFrame:
    """``value, arrival``: the lines of a folder's files as a stream. The folder is on a store that the driver and all
    executors reach (a path, or an address that pyarrow knows).

    ``lines_per_batch`` bounds a batch (for triggers that go on; ``availableNow`` takes what there is when it starts). With
    ``end_marker`` a file of that name says that no more will come; then one line with ``control_key`` follows the last
    one. ``arrival`` rises from line to line and is unique. Sets a property of the session, with which ``availableNow`` ends
    with a batch without lines that reports what the last ones closed.
    """
    spark.dataSource.register(OrderedLines)
    spark.conf.set(_CLOSING_BATCH, "true")
    options = {"path": folder, "control_key": control_key, "split_bytes": split_bytes}
    options |= {"lines_per_batch": lines_per_batch} if lines_per_batch else {}
    options |= {"end_marker": end_marker} if end_marker else {}
    return spark.readStream.format(FORMAT).options(**options).load()


def stream_ordered_events(
    spark: SparkSession, folder: str, policy: ParsePolicy | str = "spark", lines_per_batch: int | None = None,
    end_marker: str | None = None, control_key: str = "W",
) -> DataFrame:
    """Parsed events with ``arrival``, the order of the lines (see `stream_ordered_lines`). Lines without a usable time are
    dropped."""
    lines = stream_ordered_lines(spark, folder, lines_per_batch, end_marker, control_key)
    return parse_lines(lines, policy, keep=["arrival"]).filter("event_time IS NOT NULL")
