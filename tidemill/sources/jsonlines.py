"""A data source of line-delimited JSON, in batch and as a stream that follows growing files.

Spark's own JSON stream takes a file once, when it appears; this one goes on reading
a file that grows, line by line, as logs do.

Files are opened by ``pyarrow.fs``, so a path is a local one or a URI that it knows
(file, hdfs, s3, gs), and must be the same on driver and executors.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MALFORMED = "malformed"
PARTITION_BYTES = 128 << 20
#: The driver plans each partition, so beyond this number they grow instead.
MOST_PARTITIONS = 1 << 15
#: Rows of an Arrow batch at most, and bytes of lines after which one ends.
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20
_READ = 1 << 20


def _long(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not -(1 << 63) <= value < 1 << 63:
        raise ValueError(value)
    return value


def _double(value: object) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise ValueError(value)
    return float(value)


def _string(value: object) -> str:
    if not isinstance(value, str):
        raise ValueError(value)
    value.encode()  # half of a surrogate pair is no text
    return value


def _boolean(value: object) -> bool:
    if not isinstance(value, bool):
        raise ValueError(value)
    return value


def _time(value: object) -> datetime:
    made = datetime.fromisoformat(_string(value))
    if made.tzinfo:
        raise ValueError(value)
    return made


KINDS = {
    T.LongType(): (pa.int64(), _long),
    T.DoubleType(): (pa.float64(), _double),
    T.StringType(): (pa.string(), _string),
    T.BooleanType(): (pa.bool_(), _boolean),
    T.TimestampNTZType(): (pa.timestamp("us"), _time),
}


def _no_number(name: str) -> None:
    raise ValueError(f"no JSON: {name}")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """The files of a folder, or the one file, by name: path and size. Names that start with _ or . don't count."""
    files, top = opened(path)
    info = files.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {path}")
    if info.type == fs.FileType.File:
        return [(top, info.size)]
    inner = lambda f: f.path[len(top) :].strip("/").split("/")
    found = files.get_file_info(fs.FileSelector(top, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not any(part[0] in "_." for part in inner(f)))


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, start, end) of files; a line belongs to the range that its first byte is in."""

    ranges: tuple[tuple[str, int, int], ...]


def dealt(spans: list[tuple[str, int, int]], size: int) -> list[Ranges]:
    """Ranges cut and put together so that a partition has about size bytes."""
    size = max(1, size, math.ceil(sum(end - start for _, start, end in spans) / MOST_PARTITIONS))
    made: list[Ranges] = []
    now: list[tuple[str, int, int]] = []
    room = size
    for path, start, end in spans:
        while start < end:
            stop = min(end, start + room)
            now.append((path, start, stop))
            room -= stop - start
            start = stop
            if not room:
                made.append(Ranges(tuple(now)))
                now, room = [], size
    return [*made, Ranges(tuple(now))] if now else made


def lines(files: fs.FileSystem, path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines of a range, each with its line end if it has one; no more than one is held."""
    with files.open_input_file(path) as raw:
        raw.seek(max(0, start - 1))
        text = io.BufferedReader(raw, _READ)
        # Of the byte before the range, only this matters: whether a line ends there.
        at = start - 1 + len(text.readline()) if start else 0
        while at < end and (line := text.readline()):
            at += len(line)
            yield line


class Lines:
    """Reads partitions as Arrow batches."""

    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.columns = [(f.name, *KINDS[f.dataType]) for f in schema if f.name != MALFORMED]

    def row(self, line: bytes) -> tuple:
        """The columns' values, then null; or nulls, then the line, if it isn't an object of such values."""
        try:
            found = json.loads(line, parse_constant=_no_number)
            if not isinstance(found, dict):
                raise ValueError(found)
            return (*(None if (v := found.get(name)) is None else make(v) for name, _, make in self.columns), None)
        except (ValueError, OverflowError, RecursionError):
            return (*(None for _ in self.columns), line.rstrip(b"\r\n").decode(errors="replace"))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        rows: list[tuple] = []
        held = 0
        for path, start, end in partition.ranges:
            for line in lines(files, path, start, end):
                if line.strip():
                    rows.append(self.row(line))
                    held += len(line)
                if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = [*(name for name, _, _ in self.columns), MALFORMED]
        kinds = [*(kind for _, kind, _ in self.columns), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class BatchReader(Lines, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        # An empty table still needs a partition.
        return dealt([(path, 0, size) for path, size in listed(self.path)], self.size) or [Ranges(())]


class StreamReader(Lines, DataSourceStreamReader):
    """An offset is the last file by name, the bytes taken of it and the number of files up to it.

    So it stays small, and the same two offsets always stand for the same lines: a
    batch that is run again after a failure is the same batch.
    """

    def initialOffset(self) -> dict:
        return {"file": "", "at": 0, "files": 0}

    def latestOffset(self) -> dict:
        found = listed(self.path)
        return {"file": found[-1][0], "at": self.whole(*found[-1]), "files": len(found)} if found else self.initialOffset()

    def whole(self, path: str, size: int) -> int:
        """Where the last line that has its line end is over; sought from behind."""
        files, _ = opened(self.path)
        with files.open_input_file(path) as f:
            while size:
                start = max(0, size - _READ)
                f.seek(start)
                if (found := f.read(size - start).rfind(b"\n")) >= 0:
                    return start + found + 1
                size = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = listed(self.path)
        for offset in (start, end):
            if sum(path <= offset["file"] for path, _ in found) != offset["files"]:
                raise ValueError(f"files came or went behind the stream, up to {offset['file']}")
        spans = []
        for path, size in found:
            if start["file"] <= path <= end["file"]:
                first = start["at"] if path == start["file"] else 0
                last = end["at"] if path == end["file"] else size
                if size < max(first, last):
                    raise ValueError(f"a file shrank behind the stream: {path}")
                spans.append((path, first, last))
        return dealt(spans, self.size)


class JsonLines(DataSource):
    """Options: path, columns (a schema's JSON), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> T.StructType:
        asked = T.StructType.fromJson(json.loads(self.options["columns"]))
        if MALFORMED in (c.lower() for c in asked.names) or len({c.lower() for c in asked.names}) < len(asked):
            raise ValueError(f"names that clash: {asked.names}")
        if wrong := [f.simpleString() for f in asked if f.dataType not in KINDS]:
            raise ValueError(f"no such types here: {wrong}")
        return asked.add(MALFORMED, T.StringType())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BatchReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return StreamReader(schema, self.options)


def json_lines(spark: SparkSession, path: str, columns: str, stream: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The named columns of line-delimited JSON, and ``malformed``; other keys are not kept.

    ``columns`` is DDL, such as ``id long, text string``; types are long, double, string,
    boolean and timestamp_ntz (ISO text). A missing key or a null is null. A line that
    is no object, or has a value of another type in a named column, is a row of nulls
    with the line in ``malformed``; blank lines are none. Of a key that an object
    repeats, the last value counts. Files are cut into ranges of ``partition_bytes``,
    small ones put together; a line must fit into memory.

    A stream takes lines once they have their line end, or a later file exists. File
    names must ascend in time, and only the last file may grow: a file that comes or
    goes behind the stream stops it with an error, as lines would be lost in silence
    otherwise.
    """
    spark.dataSource.register(JsonLines)
    reader = (spark.readStream if stream else spark.read).format("json_lines")
    return reader.option("path", path).option("columns", T.StructType.fromDDL(columns).json()).option("partitionBytes", partition_bytes).load()
