"""A stored log that a stream appends to and that can be queried meanwhile.

Each batch is sorted and laid out like :func:`querylog.sinks.write_table` does, in a
hidden folder, and then moved to its dates under names that carry the batch. A batch that
is run again after a failure first removes what its first run had moved, so that it is
there once. Dates that gather many small files are written anew.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from querylog.schema import DATE_COLUMN
from querylog.sinks.table import write_table

_DATES = f"{DATE_COLUMN}=*"
_STAGED, _COMPACTED, _REPLACED = "_staged", "_compacted", "_replaced"
#: Bytes of a compacted file, about.
_FILE_BYTES = 128 << 20


class _Folder:
    """The files of a table, through the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.root = path.rstrip("/")
        self.files = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, pattern: str) -> list[str]:
        """Matching files, as ``date folder/file`` below the folder that the pattern names."""
        found = self.files.globStatus(self.path(pattern)) or []
        return [f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" for s in found]

    def size(self, name: str) -> int:
        return self.files.getFileStatus(self.path(name)).getLen()

    def move(self, old: str, new: str) -> None:
        target = self.path(new)
        self.files.mkdirs(target.getParent())
        if not self.files.rename(self.path(old), target):
            raise OSError(f"could not move {old} to {new} in {self.root}")

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)

    def write(self, name: str, lines: list[str]) -> None:
        out = self.files.create(self.path(name), True)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()

    def lines(self, name: str) -> list[str]:
        stream = self.files.open(self.path(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text.split("\n")


def append_batch(rows: DataFrame, path: str, batch_id: int, writer: str = "stream") -> None:
    """Add a batch of log rows to a stored table, once however often it is called.

    ``writer`` tells apart several streams that write to one table. Readers may see a
    batch in part while its files are being moved.
    """
    if not re.fullmatch(r"[a-z0-9]+", writer):
        raise ValueError("a writer's name is made of lower-case letters and digits")
    folder = _Folder(rows.sparkSession, path)
    staged, own = f"{_STAGED}/{writer}-{batch_id}", f"{writer}-{batch_id:012d}-"
    write_table(rows, f"{folder.root}/{staged}", mode="overwrite")
    for name in folder.names(f"{_DATES}/{own}*"):
        folder.delete(name)
    for name in folder.names(f"{staged}/{_DATES}/part-*"):
        date, file = name.split("/")
        folder.move(f"{staged}/{name}", f"{date}/{own}{file}")
    folder.delete(staged)


def compact_table(spark: SparkSession, path: str, most_files: int = 32, spare: str | None = None) -> list[str]:
    """Write dates of more than ``most_files`` files anew, sorted; returns those dates.

    ``spare`` is the beginning of file names to leave alone: those of a batch that may
    yet be run again. The new files of a date are complete, and what they replace is
    listed beside them, before anything is removed: a call that was cut short is
    finished by the next one. Between removal and move a reader misses rows of the date.
    """
    folder = _Folder(spark, path)
    for name in folder.names(f"{_COMPACTED}/{_DATES}/{_REPLACED}"):
        _replace(folder, name.split("/")[0])
    by_date: dict[str, list[str]] = {}
    for name in folder.names(f"{_DATES}/*.parquet"):
        date, file = name.split("/")
        if spare is None or not file.startswith(spare):
            by_date.setdefault(date, []).append(name)
    done = []
    for date, names in sorted(by_date.items()):
        if len(names) > most_files:
            rows = spark.read.parquet(*(f"{folder.root}/{name}" for name in names))
            folder.delete(f"{_COMPACTED}/{date}")
            parts = -(-sum(map(folder.size, names)) // _FILE_BYTES)
            rows = (rows.repartitionByRange(parts, "request_ts") if parts > 1 else rows.coalesce(1)).sortWithinPartitions("request_ts")
            rows.write.parquet(f"{folder.root}/{_COMPACTED}/{date}/files")
            folder.write(f"{_COMPACTED}/{date}/{_REPLACED}", names)
            _replace(folder, date)
            done.append(date.split("=")[1])
    return done


def _replace(folder: _Folder, date: str) -> None:
    """Remove the files that a compacted date lists, and move its new ones in."""
    compacted = f"{_COMPACTED}/{date}"
    for name in folder.lines(f"{compacted}/{_REPLACED}"):
        folder.delete(name)
    for name in folder.names(f"{compacted}/files/part-*"):
        file = name.split("/")[1]
        folder.move(f"{compacted}/files/{file}", f"{date}/compact-{uuid.uuid4().hex}-{file}")
    folder.delete(compacted)


def stream_to_table(
    log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, most_files: int = 32, writer: str = "stream"
) -> StreamingQuery:
    """Append a streamed log to a table as :func:`querylog.sinks.write_table` lays it out.

    Files are sorted by time, a batch that is repeated adds nothing, and dates of more
    than ``most_files`` files are compacted. By default takes what is there and stops.
    """

    def store(rows: DataFrame, batch_id: int) -> None:
        append_batch(rows, path, batch_id, writer)
        # earlier batches are committed by now and will not be run again
        compact_table(rows.sparkSession, path, most_files, spare=f"{writer}-{batch_id:012d}-")

    return (
        log.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
