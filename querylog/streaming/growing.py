"""Following log files that grow in place, as a resolver writes them.

The position in a stream is the number of bytes taken from each file, up to the end of
its last whole line. A half-written line is left until the rest of it is there. A file
that became shorter than what was taken from it was started anew and is read from its
beginning. Ranges of bytes are read inside tasks; lines are parsed by the JVM as
everywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from querylog.sources.tsv import LOG_FILES, parse_tsv_lines

NAME = "querylog_growing"


@dataclass
class _Range(InputPartition):
    """Whole lines of a file, from one byte to another."""

    path: str
    start: int
    end: int


def _opened(directory: str) -> tuple[fs.FileSystem, str]:
    """The file system of a directory, by its URI, and its path there."""
    if "://" in directory or directory.startswith("file:"):
        return fs.FileSystem.from_uri(directory if "://" in directory else directory.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), directory


def last_line_end(files: fs.FileSystem, path: str, start: int, size: int, step: int = 1 << 16) -> int:
    """The byte after the last line end between two places; ``start`` if there is none."""
    with files.open_input_file(path) as file:
        end = size
        while end > start:
            low = max(start, end - step)
            at = file.read_at(end - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            end = low
    return start


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.directory, self.glob = options["path"], options.get("glob", LOG_FILES)
        self.most_bytes = int(options.get("most_bytes", 64 << 20))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = _opened(self.directory)
        now = {}
        for found in files.get_file_info(fs.FileSelector(root)):
            if found.type == fs.FileType.File and fnmatch(found.base_name, self.glob):
                before = self.known.get(found.base_name, 0)
                start = before if before <= found.size else 0
                now[found.base_name] = last_line_end(files, found.path, start, found.size)
        self.known = now
        return now

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        files, root = _opened(self.directory)
        ranges = []
        for name, to in sorted(end.items()):
            at = start.get(name, 0)
            at = at if at <= to else 0  # started anew
            while at < to:
                cut = to if to - at <= self.most_bytes else self._cut(files, f"{root}/{name}", at, to)
                ranges.append(_Range(name, at, cut))
                at = cut
        return ranges

    def _cut(self, files: fs.FileSystem, path: str, start: int, end: int) -> int:
        """A line end about ``most_bytes`` on; one very long line is a range of its own."""
        cut = last_line_end(files, path, start, start + self.most_bytes)
        with files.open_input_file(path) as file:
            at = start + self.most_bytes
            while cut == start and at < end:
                piece = file.read_at(min(1 << 16, end - at), at)
                found = piece.find(b"\n")
                cut = at + found + 1 if found >= 0 else start
                at += len(piece)
        return cut if cut > start else end

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        files, root = _opened(self.directory)
        with files.open_input_file(f"{root}/{partition.path}") as file:
            lines = file.read_at(partition.end - partition.start, partition.start).split(b"\n")[:-1]
        if lines:
            text = [line.decode(errors="replace") for line in lines]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["value"])

    def commit(self, end: dict) -> None:
        """Nothing is kept beside the stream's own checkpoint."""


class GrowingFiles(DataSource):
    """Lines of the files of a directory, as ``value``, including those that grow."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def stream_growing(
    spark: SparkSession, directory: str, glob: str = LOG_FILES, strict_trim: bool = False, time_zone: str = "UTC", most_bytes: int = 64 << 20
) -> DataFrame:
    """Log rows of tab-separated files as lines are appended to them.

    Every whole line is taken once. What a file gains is cut at line ends into tasks of
    about ``most_bytes``. Files are told apart by name, are not listed below the
    directory, and must be reachable by their URI from the driver and all executors.
    Lines that are replaced in place are not seen again.
    """
    spark.dataSource.register(GrowingFiles)
    lines = spark.readStream.format(NAME).option("glob", glob).option("most_bytes", str(most_bytes)).load(directory)
    return parse_tsv_lines(lines, strict_trim=strict_trim, time_zone=time_zone)
