"""A growing log file as a stream: what is appended to it, line by line, across rotation and truncation.

A position in a file is its identity (device and inode) and the byte after the last whole line taken. A line still without
its end waits until it has one. A file of another identity under the same path, or one shorter than the position, is read
from its first byte; what a rotated file had left is read too, if it still lies in the folder under another name. A file
that is not there has no position, so that it is read whole once it appears. Positions are the stream's offsets: Spark
stores them, and a restart goes on where the last committed batch ended. The file itself is the buffer; nothing is refused.

Ranges longer than SPLIT bytes become several tasks. A task reads the lines that begin in its range. All executors must see the
path. Options: path (a file or a pattern of files), start: `end` (the default), `begin`, or a byte.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from hitscope.sources.logs import events, parse

#: Bytes that one task reads, and that are looked at together.
SPLIT, BLOCK = 64_000_000, 1_000_000
LINES = 10_000


def identity(path: str) -> str | None:
    try:
        s = os.stat(path)
    except OSError:
        return None
    return f"{s.st_dev}:{s.st_ino}"


def last_line_end(path: str) -> int:
    """The byte after the last line end of a file; 0 if it has none or is gone."""
    try:
        with open(path, "rb") as f:
            end = f.seek(0, os.SEEK_END)
            while end:
                begin = max(0, end - BLOCK)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
    except OSError:
        pass
    return 0


@dataclass
class Range(InputPartition):
    """Bytes of a file. first: whether `begin` is a line's beginning whatever stands before it."""

    path: str
    file: str
    begin: int
    end: int
    first: bool


def lines_of(part: Range) -> Iterator[list[str]]:
    """The lines that begin in a range, without their ends, in groups; none if the file is another one by now."""
    if identity(part.path) != part.file:
        return
    held: list[str] = []
    with open(part.path, "rb") as f:
        at = part.begin
        if part.first:
            f.seek(at)
        else:  # the line that begins before the range is another task's
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < part.end:
            raw = f.readline()
            if not raw.endswith(b"\n"):
                break
            at += len(raw)
            line = raw[:-1]
            held.append((line[:-1] if line.endswith(b"\r") else line).decode("utf-8", "replace"))
            if len(held) >= LINES:
                yield held
                held = []
    if held:
        yield held


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.start = options.get("start", "end")

    def _files(self) -> list[str]:
        return sorted(glob.glob(self.path)) if glob.has_magic(self.path) else [self.path]

    def initialOffset(self) -> dict:
        out = {}
        for path in self._files():
            file = identity(path)
            if file is not None:
                out[path] = {"file": file, "at": last_line_end(path) if self.start == "end" else 0 if self.start == "begin" else int(self.start)}
        return {"files": json.dumps(out, sort_keys=True)}

    def latestOffset(self) -> dict:
        out = {}
        for path in self._files():
            file = identity(path)
            if file is not None:
                out[path] = {"file": file, "at": last_line_end(path)}
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out: list[Range] = []
        for path, now in after.items():
            was = before.get(path)
            same = was is not None and was["file"] == now["file"] and was["at"] <= now["at"]
            if was is not None and was["file"] != now["file"]:
                out += self._left(path, was)
            out += self._ranges(path, now["file"], was["at"] if same else 0, now["at"])
        return out

    def _left(self, path: str, was: dict) -> list[Range]:
        """What a rotated file had left, if it is still in the folder."""
        for other in sorted(glob.glob(os.path.join(glob.escape(os.path.dirname(path)), "*"))):
            if identity(other) == was["file"]:
                return self._ranges(other, was["file"], was["at"], last_line_end(other))
        return []

    def _ranges(self, path: str, file: str, begin: int, end: int) -> list[Range]:
        return [Range(path, file, at, min(at + SPLIT, end), at == begin) for at in range(begin, end, SPLIT)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for lines in lines_of(partition):
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["line"])


class TailSource(DataSource):
    """format("log_tail")"""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def read_tail(spark: SparkSession, path: str, format: str, site_id: str, field_map: dict[str, str] | None = None, start: str = "end") -> DataFrame:
    """What is appended to a log file as a stream of events."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("log_tail").option("path", path).option("start", start).load()
    return events(parse(lines, format, field_map), site_id)
