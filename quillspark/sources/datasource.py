"""Archive files and snapshot listings as Spark data sources: spark.read.format("archive"), spark.readStream.format("snapshots").

Both plan their own partitions and read where the tasks run, through pyarrow's file systems (local
folders, HDFS, object stores). Stores that only Spark's readers reach are read by ranges.read_ranges()
and envelope.read_envelopes() instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of small files that a partition takes together; a larger file is one of its own.
PARTITION_BYTES = 64 << 20
#: Rows of a listing that a partition takes, and rows of a listing that count at all.
LISTED_ROWS, MOST_ROWS = 5_000, 20_000
_RECORDS = 1_000


def _files(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of a file or of the files right in a folder, by name; hidden ones are left out."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
    named = ((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._")
    return sorted((scheme + p, size) for p, size in named)


def _opened(uri: str):
    """A file that can be read at any place."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return store.open_input_file(at)


@dataclass
class FilesPartition(InputPartition):
    """Files that a task reads one after another."""

    files: tuple[str, ...]

    def __init__(self, files: Sequence[str]):
        super().__init__(0)
        self.files = tuple(files)


class ArchiveReader(DataSourceReader):
    """Elements of the files' arrays; files are packed into partitions by size, so many small ones are few tasks."""

    def __init__(self, path: str, key: str, entry: str, most: int):
        self.path, self.key, self.entry, self.most = path, key, entry, most

    def partitions(self) -> Sequence[InputPartition]:
        out: list[list[str]] = [[]]
        held = 0
        for uri, size in sorted(_files(self.path), key=lambda f: (-f[1], f[0])):
            if out[-1] and held + size > self.most:
                out.append([])
                held = 0
            out[-1].append(uri)
            held += size
        return [FilesPartition(files) for files in out if files]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        from quillspark.sources.envelope import stored_elements

        schema = pa.schema([("path", pa.string()), ("position", pa.int64()), ("record", pa.string()), ("error", pa.string())])
        for uri in partition.files:
            part: list[tuple] = []
            for row in stored_elements(lambda uri=uri: _opened(uri), self.key, self.entry):
                part.append((uri, *row))
                if len(part) == _RECORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
                    part = []
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


class ArchiveSource(DataSource):
    """Options: path (a file or a folder of JSON and ZIP files), key, entry (the ZIP's), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "path string, position long, record string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        return ArchiveReader(o["path"], o.get("key", "tweets"), o.get("entry", "tweets.json"), int(o.get("partitionBytes", PARTITION_BYTES)))


@dataclass
class ListingPartition(InputPartition):
    """Rows first to last (exclusive) of a listing, counted without its header."""

    uri: str
    first: int
    last: int

    def __init__(self, uri: str, first: int, last: int):
        super().__init__(0)
        self.uri, self.first, self.last = uri, first, last


def listed(uri: str, most: int) -> list[list]:
    """Rows of a listing behind its header, `most` at most; a listing that is being written or is none has none."""
    with _opened(uri) as f:
        try:
            rows = json.loads(f.read().decode("utf-8"))
        except ValueError:
            return []
    return [r for r in rows[1:most + 1]] if isinstance(rows, list) else []


class ListingStream(DataSourceStreamReader):
    """Rows of listings that grow: an offset says of each listing how many of its rows were read.

    Listings only append, so rows below an offset never change and a batch that is repeated after a
    failure reads the same ones. A listing that is being rewritten counts as it was last seen; one
    that is shorter than the checkpoint says when the stream starts again is an error, since going
    on would repeat rows.
    """

    def __init__(self, path: str, most: int, each: int):
        self.path, self.most, self.each = path, most, each
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {uri: len(listed(uri, self.most)) for uri, _ in _files(self.path)}
        self.at = {u: max(found.get(u, 0), self.at.get(u, 0)) for u in found.keys() | self.at.keys()}
        return {u: n for u, n in self.at.items() if n}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        shrunk = sorted(u for u, n in start.items() if end.get(u, 0) < n)
        if shrunk:
            raise ValueError(f"listings have become shorter: {shrunk[:5]}")
        return [ListingPartition(u, i, min(i + self.each, n)) for u, n in sorted(end.items()) for i in range(start.get(u, 0), n, self.each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = listed(partition.uri, partition.last)[partition.first:partition.last]
        for i, row in enumerate(rows, partition.first):
            cells = [None if c is None else str(c) for c in (row if isinstance(row, list) else [])][:2]
            yield (partition.uri, i, *cells, *[None] * (2 - len(cells)))

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the stream's own checkpoint."""


class SnapshotSource(DataSource):
    """Options: path (a listing or a folder of them), listingRows that count, partitionRows."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return "path string, position long, timestamp string, original string"

    def _stream(self) -> ListingStream:
        o = self.options
        return ListingStream(o["path"], int(o.get("listingRows", MOST_ROWS)), int(o.get("partitionRows", LISTED_ROWS)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return self._stream()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ListingBatch(self._stream())


class _ListingBatch(DataSourceReader):
    """All rows at once."""

    def __init__(self, stream: ListingStream):
        self.stream = stream

    def partitions(self) -> Sequence[InputPartition]:
        return self.stream.partitions({}, self.stream.latestOffset())

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.stream.read(partition)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(SnapshotSource)
