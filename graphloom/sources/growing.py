"""Session files that are still being written, as a stream of lines.

A file source reads a file once; this one remembers how far it has read each file. A micro-batch takes the bytes that have
come since, in splits of bounded size, and a line belongs to the batch and split in which it ends: a last line that isn't
finished waits, and a split reads back to where its first line begins. So every line comes once, whatever the batches,
splits and restarts. A file that has become shorter has been written anew and is read from its beginning.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").option("path", folder).load()  # file, at (byte of the line's beginning), line

The folder may be in any store that Arrow's file systems reach; a plain path or file:// is one that all machines mount.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SPLIT, BACK = 32 << 20, 1 << 16


class Split(InputPartition):
    """Bytes of one file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def splits(start: dict[str, int], end: dict[str, int], size: int = SPLIT) -> list[Split]:
    out = []
    for path, to in sorted(end.items()):
        at = start.get(path, 0)
        at = at if at <= to else 0
        out += [Split(path, a, min(a + size, to)) for a in range(at, to, size)]
    return out


def lines(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(beginning, line) of the lines of an open file whose newline lies in start..end-1."""
    begin, head = start, b""
    while begin > 0:  # back to where the line at `start` begins
        a = max(0, begin - BACK)
        source.seek(a)
        part = source.read(begin - a)
        cut = part.rfind(b"\n")
        head = part[cut + 1 :] + head
        begin = a + cut + 1
        if cut >= 0:
            break
    source.seek(start)
    held, at = [head], start
    while at < end:
        part = source.read(min(BACK, end - at))
        if not part:
            return
        at += len(part)
        first, *rest = part.split(b"\n")
        held.append(first)
        for more in rest:
            line = b"".join(held)
            yield begin, line
            begin += len(line) + 1
            held = [more]


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix, self.size = options["path"], options.get("suffix", ".jsonl"), int(options.get("split", SPLIT))

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = self.store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return splits(start, end, self.size)

    def read(self, partition: Split) -> Iterator[tuple]:
        store, _ = self.store()
        with store.open_input_file(partition.path) as source:
            for at, line in lines(source, partition.start, partition.end):
                yield partition.path, at, line.removesuffix(b"\r").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema: StructType) -> GrowingReader:
        return GrowingReader(self.options)
