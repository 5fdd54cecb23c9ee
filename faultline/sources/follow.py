"""Following log files that grow: a streaming data source whose offsets are files and bytes.

A trigger lists the files and finds the last line end of each; tasks read ranges of bytes. A line is read once its line end
has been written. A file that got shorter, or begins with other bytes than before, is read from its start again. What has
been read is told by the offsets in the stream's checkpoint alone, so a restart neither loses nor repeats lines.

Files are reached through pyarrow's file systems: local paths and URIs of the stores it knows.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from faultline.sources.lines import normalize_lines

#: Bytes that a task reads, and bytes by which a file's beginning is known again.
RANGE_BYTES, HEAD_BYTES = 16 << 20, 256
#: Bytes read at a time in the search for a line end.
_BLOCK = 1 << 16
_SCHEMA = "value string, file string, pos bigint"


class Range(InputPartition):
    """Bytes [low, high) of a file; `begins` tells that a line begins at low, `end` is where the batch ends in the file."""

    def __init__(self, file: str, low: int, high: int, end: int, begins: bool):
        super().__init__(None)
        self.file, self.low, self.high, self.end, self.begins = file, low, high, end, begins


def _line_end(stream, low: int, size: int) -> int:
    """The place behind the last line end in [low, size), or low."""
    high = size
    while high > low:
        at = max(low, high - _BLOCK)
        stream.seek(at)
        found = stream.read(high - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        high = at
    return low


class FollowReader(DataSourceStreamReader):
    """Offsets: {file: [bytes read, length and checksum of the beginning it was read under]}, as one text."""

    def __init__(self, path: str, pattern: str, range_bytes: int, from_end: bool):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.pattern, self.range_bytes, self.from_end = pattern, range_bytes, from_end
        self.ends: dict[str, tuple[int, int]] = {}  # the last size and line end seen, so that what hasn't grown isn't read

    def __getstate__(self):
        return {**self.__dict__, "ends": {}}

    def _files(self) -> dict[str, int]:
        import fnmatch

        info = self.fs.get_file_info(self.root)
        if info.type == pafs.FileType.File:
            return {info.path: info.size}
        if info.type == pafs.FileType.NotFound:
            return {}
        found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True))
        return {f.path: f.size for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)}

    def _head(self, stream, n: int) -> int:
        stream.seek(0)
        return zlib.crc32(stream.read(n))

    def _now(self) -> dict[str, list[int]]:
        now = {}
        for file, size in sorted(self._files().items()):
            with self.fs.open_input_file(file) as stream:
                known_size, known_end = self.ends.get(file, (0, 0))
                end = _line_end(stream, known_end if known_size <= size else 0, size)
                n = min(end, HEAD_BYTES)
                now[file] = [end, n, self._head(stream, n)]
            self.ends[file] = (size, end)
        return now

    def initialOffset(self) -> dict:
        return {"files": json.dumps(self._now() if self.from_end else {})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._now())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        ranges = []
        for file, (high, n, head) in now.items():
            low, known, old_head = before.get(file, (0, 0, 0))
            if low > high or not self._same(file, known, old_head, n, head):
                low = 0
            for at in range(low, high, self.range_bytes):
                ranges.append(Range(file, at, min(at + self.range_bytes, high), high, at == low))
        return ranges or [Range("", 0, 0, 0, True)]

    def _same(self, file: str, known: int, old_head: int, n: int, head: int) -> bool:
        """Whether the file still begins as it did when its first `known` bytes were noted."""
        if known == n:
            return head == old_head
        if known > n:
            return False
        with self.fs.open_input_file(file) as stream:
            return self._head(stream, known) == old_head

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.low >= partition.high:
            return
        with self.fs.open_input_file(partition.file) as stream:
            low, high = partition.low, partition.high
            # A line belongs to the range its first byte is in.
            stream.seek(low if partition.begins else low - 1)
            data = stream.read(high - stream.tell())
            if not partition.begins:
                first = data.find(b"\n")
                if first < 0:
                    return
                low, data = low + first, data[first + 1 :]  # first counts from the byte before low
            parts = [data]
            while low < high and not parts[-1].endswith(b"\n") and stream.tell() < partition.end:
                block = stream.read(min(_BLOCK, partition.end - stream.tell()))
                if not block:
                    raise EOFError(f"{partition.file} got shorter while it was read")
                cut = block.find(b"\n") + 1
                parts.append(block[:cut] if cut else block)
                if cut:
                    break
            data = b"".join(parts)
        if not data:
            return
        lines = data.split(b"\n")[:-1]
        at, places = low, []
        for line in lines:
            places.append(at)
            at += len(line) + 1
        yield pa.record_batch(
            [
                pa.array([line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines], pa.string()),
                pa.array([partition.file] * len(lines), pa.string()),
                pa.array(places, pa.int64()),
            ],
            ["value", "file", "pos"],
        )

    def commit(self, end: dict) -> None:
        pass


class FollowedFiles(DataSource):
    """Format `followed_files`: value, file, pos (the line's first byte). Options: path (a file or folder), pattern of file
    names (`*.log`; all files if not given), range_bytes, from_end (`true`: what is there at the start is passed over)."""

    @classmethod
    def name(cls) -> str:
        return "followed_files"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> FollowReader:
        o = self.options
        return FollowReader(
            o["path"], o.get("pattern", "*"), int(o.get("range_bytes", RANGE_BYTES)), o.get("from_end", "false").lower() == "true"
        )


def follow_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of the files under `path` as they are written: value, file, pos."""
    # Workers need not have this package installed; they get the source by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FollowedFiles)
    return spark.readStream.format("followed_files").options(path=path, **options).load()


def follow_logs(spark: SparkSession, path: str, source: str, options: dict[str, str] | None = None, **parsing) -> DataFrame:
    """Events of growing line logs, with `seq`: the number of the line's first byte, which grows within a file.

    Numbers of different files may be equal; merge more than one file with with_seq, or number by (seq, file).
    """
    lines = follow_lines(spark, path, **(options or {})).withColumn("seq", F.col("pos"))
    return normalize_lines(lines, source, keep=("file", "seq"), **parsing)
