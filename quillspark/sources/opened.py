"""A set of archive files that is open: files are added and taken out, unreadable ones are told."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import envelope, ranges


@dataclass(frozen=True)
class Opened:
    """Archive files in the order in which they were opened, and (path, reason) of those that could not be.

    It never changes: add() and remove() give a new set, so a caller that fails on the way still has
    the old one. Only names of files are held here; records stay in Spark.
    """

    spark: SparkSession
    key: str = "tweets"
    sources: tuple[str, ...] = ()
    refused: tuple[tuple[str, str], ...] = field(default=())

    def add(self, *paths: str) -> Opened:
        """With these files, too; those that hold no array of records are refused. Empty files are passed over, a file may come twice.

        refused tells of these paths only. If none can be read, the sources stay as they are.
        """
        spark = self.spark
        if not paths:
            return replace(self, refused=())
        sizes = {r["path"]: r["length"] for r in spark.read.format("binaryFile").load(sorted(set(paths))).select("path", "length").collect()}
        named = {p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in paths}
        size = {spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath(): n for p, n in sizes.items()}
        chosen = [p for p in paths if size.get(named[p], 0) > 0]
        if not chosen:
            return replace(self, refused=())
        found = self._read(sorted(set(chosen))).groupBy("path").agg(F.count("record").alias("records"), F.max("error").alias("error")).collect()
        told = {spark._jvm.org.apache.hadoop.fs.Path(r["path"]).toUri().getPath(): r for r in found}
        # A file with an array that is cut, or ends early, is read as far as it goes; one without rows has an empty array.
        bad = {p: told[named[p]]["error"] for p in chosen if named[p] in told and told[named[p]]["records"] == 0 and told[named[p]]["error"] is not None}
        good = tuple(p for p in chosen if p not in bad)
        return replace(self, sources=self.sources + good, refused=tuple((p, bad[p]) for p in dict.fromkeys(chosen) if p in bad))

    def remove(self, index: int) -> Opened:
        """Without the source at an index; an index that none has changes nothing."""
        if not 0 <= index < len(self.sources):
            return self
        return replace(self, sources=self.sources[:index] + self.sources[index + 1:], refused=())

    def records(self) -> DataFrame:
        """(source, position, record, error): elements of all sources, numbered in the order of opening."""
        spark = self.spark
        if not self.sources:
            return spark.createDataFrame([], "source int, position long, record string, error string")
        place = [(spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath(), i) for i, p in enumerate(self.sources)]
        numbers = F.broadcast(spark.createDataFrame(place, "__path string, source int"))  # one row a file that was opened by hand
        read = self._read(sorted(set(self.sources))).withColumn("__path", F.regexp_replace(F.try_url_decode("path"), r"^[a-z0-9]+:(//[^/]*)?", ""))
        return read.join(numbers, "__path").select("source", "position", "record", "error")

    def _read(self, paths: list[str]) -> DataFrame:
        packed = {r["path"] for r in ranges.zips(self.spark, paths).collect()}
        at = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()
        inside = {at(p) for p in packed}
        plain, zipped = [p for p in paths if at(p) not in inside], [p for p in paths if at(p) in inside]
        out = None
        for part, read in ((plain, ranges.read_ranges), (zipped, envelope.read_envelopes)):
            if part:
                rows = read(self.spark, part, self.key)
                out = rows if out is None else out.unionByName(rows)
        return out
