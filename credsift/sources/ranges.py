"""Files of any size, read in ranges that begin and end at line ends."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 128 << 20
#: A task reads ranges of about this many bytes, one after the other, fewer if there are not many.
TASK_BYTES = 16 << 20
TASKS = 64
#: Bytes read at a time while a line end is looked for.
STEP = 1 << 16


@dataclass(frozen=True)
class Range:
    path: str
    part: int
    start: int
    end: int
    size: int


class Ranges(InputPartition):
    """What one task reads: ranges of files, each a row of its own."""

    def __init__(self, ranges: list[Range]) -> None:
        self.ranges = ranges


class LineRanges(DataSource):
    """``path, part, size, before, content, after``: pieces of files, cut at line ends.

    ``content`` is without the line end it was cut at; ``before`` and ``after``
    are the lines next to it, null at the ends of the file.  Options: ``path``,
    a folder of any file system that Arrow can open, and ``range_bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "path string, part int, size long, before binary, content binary, after binary"

    def reader(self, schema: object) -> LineRangeReader:
        return LineRangeReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class LineRangeReader(DataSourceReader):
    def __init__(self, root: str, range_bytes: int) -> None:
        self.root, self.range_bytes = root, max(1, range_bytes)

    def partitions(self) -> list[InputPartition]:
        """Only the listing is looked at.  Ranges bound a row; a task takes several, so their number costs no tasks."""
        files, folder = file_system(self.root)
        listed = files.get_file_info(fs.FileSelector(folder, recursive=True))
        found = sorted((i for i in listed if i.type == fs.FileType.File and not hidden(i.path, folder)), key=lambda i: i.path)
        task_bytes = max(self.range_bytes, min(TASK_BYTES, sum(i.size for i in found) // TASKS))
        tasks, held, size = [], [], 0
        for info in found:
            for k, at in enumerate(range(0, max(1, info.size), self.range_bytes)):
                end = min(at + self.range_bytes, info.size)
                if size + end - at > task_bytes and held:
                    tasks.append(Ranges(held))
                    held, size = [], 0
                held.append(Range(info.path, k, at, end, info.size))
                size += end - at
        return [*tasks, *([Ranges(held)] if held else [])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(self.root)
        for r in partition.ranges:
            with files.open_input_file(r.path) as file:
                found = read_range(file, r)
            if found is not None:
                relative = r.path[len(folder.rstrip("/")) + 1 :]
                columns = [[relative], [r.part], [r.size], *[[x] for x in found]]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "part", "size", "before", "content", "after"]
                )


def hidden(path: str, folder: str) -> bool:
    """Names that begin with a dot or an underscore, as elsewhere in Spark."""
    return any(name[:1] in "._" for name in path[len(folder) :].strip("/").split("/"))


def read_range(file: pa.NativeFile, r: Range) -> tuple[bytes | None, bytes, bytes | None] | None:
    """(line before, lines, line after) of a range; None if no line begins in it."""
    start = 0 if r.start == 0 else line_end(file, r.start - 1, r.size) + 1
    stop = r.size if r.end >= r.size else line_end(file, r.end - 1, r.size) + 1
    if stop >= r.size:
        stop = r.size
    if start >= stop and r.start > 0:
        return None
    content = file.read_at(stop - start, start)
    before = None if start == 0 else line_before(file, start - 1)
    if stop == r.size:
        return before, content, None
    after = file.read_at(line_end(file, stop, r.size) - stop, stop)
    return before, content[:-1], after


def line_end(file: pa.NativeFile, at: int, size: int) -> int:
    """Place of the first line end from ``at`` on; the size if there is none."""
    while at < size:
        found = file.read_at(min(STEP, size - at), at).find(b"\n")
        if found >= 0:
            return at + found
        at += STEP
    return size


def line_before(file: pa.NativeFile, end: int) -> bytes:
    """The line that ends at ``end``."""
    at, parts = end, []
    while at > 0:
        step = min(STEP, at)
        block = file.read_at(step, at - step)
        found = block.rfind(b"\n")
        if found >= 0:
            parts.append(block[found + 1 :])
            break
        parts.append(block)
        at -= step
    return b"".join(reversed(parts))


def parts_from_files(spark: SparkSession, root: str, repo: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All files under ``root`` as parts of entries (see `credsift.operators.parts`), paths relative to it.

    No task reads more than ``range_bytes`` and the lines that cross its ends,
    so files of any size are read, beyond those that fit into a row as well.
    """
    spark.dataSource.register(LineRanges)
    found = spark.read.format("line_ranges").option("path", root).option("range_bytes", range_bytes).load()
    none = F.lit(None).cast("string")
    return found.select(
        F.lit(repo).alias("repo"), F.xxhash64("path").alias("entry_seq"), "path", "part", "before", "content", "after",
        none.alias("commit"), none.alias("commit_message"), none.alias("commit_author"), F.lit(None).cast("timestamp").alias("commit_date"),
    )
