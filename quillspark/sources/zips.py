"""ZIP archives out of tables: every offset by running sums, every byte made by the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.urls import safe_archive_name
from quillspark.operators.timeline import placed_parts, running_sum
from quillspark.scratch import Tables, materialize

#: From these on a number takes the format's 64-bit form: entries, and bytes.
MOST_ENTRIES, MOST_BYTES = (1 << 16) - 1, (1 << 32) - 1
_LOCAL, _CENTRAL, _END, _END_64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_UTF8 = 0x0800


def _little(value: Column | int, size: int) -> Column:
    """A number as so many bytes, the lowest first."""
    n = F.lit(value) if isinstance(value, int) else value
    byte = lambda i: F.lpad(F.hex(F.shiftrightunsigned(n.cast("bigint"), 8 * i).bitwiseAND(255)), 2, "0")
    return F.unhex(F.concat(*[byte(i) for i in range(size)]))


def dos_time(at: Column) -> Column:
    """(date, time) of a timestamp as ZIPs have it, in steps of two seconds; before 1980 and without one the first day of 1980, beyond 2107 the last."""
    year = F.year(at)
    known = F.struct(
        F.when(year > 2107, (127 << 9) | (12 << 5) | 31).otherwise((year - 1980) * 512 + F.month(at) * 32 + F.dayofmonth(at)).cast("int").alias("date"),
        F.when(year > 2107, (23 << 11) | (59 << 5) | 29).otherwise(F.hour(at) * 2048 + F.minute(at) * 32 + F.floor(F.second(at) / 2)).cast("int").alias("time"),
    )
    return F.when(year >= 1980, known).otherwise(F.struct(F.lit((1 << 5) | 1).alias("date"), F.lit(0).alias("time")))


def zip_pieces(entries: DataFrame, modified: str | None = None) -> DataFrame:
    """(at, kind, name, bytes): a ZIP of stored entries(name, blob) by name, cut into pieces by their place in the file.

    kind is entry, directory or end. Names that are not safe and null blobs are skipped; entries of
    one name all come, in the order of a hash. modified is a column of times. Archives of many entries
    or bytes take the 64-bit form; a blob is a value, so it is never too large for the other. The pieces joined in the order of at are the file; no entries give an
    empty archive. Blobs are shuffled once, by name; of all else only sums are gathered.
    """
    held = Tables()
    stamp = dos_time(F.col(modified)) if modified else dos_time(F.lit(None).cast("timestamp"))
    sound = entries.where(safe_archive_name(F.col("name")) & F.col("blob").isNotNull())
    rows = sound.select("name", F.encode("name", "utf-8").alias("raw"), F.col("blob").cast("binary").alias("blob"), stamp.alias("stamp")).withColumn("n", F.lit(1).cast("bigint"))
    rows = rows.withColumn("crc", F.crc32("blob")).withColumn("size", F.octet_length("blob").cast("bigint")).withColumn("named", F.octet_length("raw").cast("bigint"))
    placed = held.keep(placed_parts(rows.withColumn("local", F.col("size") + F.col("named") + 30), [], [F.col("name").asc()]))
    narrow = placed.drop("blob")
    at = running_sum(narrow.select("__at", "named", "local"), [], "local", "__offset", held)
    far = F.col("__offset") >= MOST_BYTES
    at = held.keep(at.withColumn("central", F.col("named") + 46 + F.when(far, 12).otherwise(0)))
    at = held.keep(running_sum(at, [], "central", "__listed", held).select(F.col("__at").alias("__n"), "__offset", "__listed", "central", "local"))
    total = at.agg(F.count("*"), F.coalesce(F.sum("local"), F.lit(0)), F.coalesce(F.sum("central"), F.lit(0))).first()
    count, body, listed = total[0], total[1], total[2]
    if not narrow.where(F.col("named") > MOST_ENTRIES).isEmpty():
        raise ValueError("a name is longer than the format can say")
    common = [_little(F.col("stamp.time"), 2), _little(F.col("stamp.date"), 2), _little(F.col("crc"), 4), _little(F.col("size"), 4), _little(F.col("size"), 4), _little(F.col("named"), 2)]
    head = F.concat(_little(_LOCAL, 4), _little(20, 2), _little(_UTF8, 2), _little(0, 2), *common, _little(0, 2), F.col("raw"), F.col("blob"))
    entry = F.concat(_little(_CENTRAL, 4), _little(20, 2), _little(20, 2), _little(_UTF8, 2), _little(0, 2), *common, _little(F.when(far, 12).otherwise(0), 2), *[_little(0, 2) for _ in range(3)], _little(0, 4),
                     _little(F.least(F.col("__offset"), F.lit(MOST_BYTES)), 4), F.col("raw"), F.when(far, F.concat(_little(1, 2), _little(8, 2), _little(F.col("__offset"), 8))).otherwise(F.lit(b"")))
    both = at.drop("local")
    met = placed.join(both, F.col("__at") == F.col("__n"))
    listing = narrow.join(both, F.col("__at") == F.col("__n")).select((F.col("__listed") + body).alias("at"), F.lit("directory").alias("kind"), "name", entry.alias("bytes"))
    wide = count >= MOST_ENTRIES or body >= MOST_BYTES or listed >= MOST_BYTES
    number = lambda value, size: int(value).to_bytes(size, "little")
    last = b"".join((
        number(_END_64, 4), number(44, 8), number(45, 2), number(45, 2), number(0, 8), number(count, 8), number(count, 8), number(listed, 8), number(body, 8),
        number(_LOCATOR, 4), number(0, 4), number(body + listed, 8), number(1, 4),
    )) if wide else b""
    last += b"".join((number(_END, 4), number(0, 4), *[number(min(count, MOST_ENTRIES), 2)] * 2, number(min(listed, MOST_BYTES), 4), number(min(body, MOST_BYTES), 4), number(0, 2)))
    end = placed.sparkSession.range(1).select(F.lit(body + listed).alias("at"), F.lit("end").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(last).alias("bytes"))
    out = materialize(met.select(F.col("__offset").alias("at"), F.lit("entry").alias("kind"), "name", head.alias("bytes")).union(listing).union(end))
    held.close()
    return out


def write_zip(entries: DataFrame, path: str, modified: str | None = None) -> DataFrame:
    """(bytes): write zip_pieces() as one file of a file system that tasks reach, streamed in order by the task that owns the file.

    The file takes its name once it is whole, so a task that is tried again leaves no half of one.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        part, written = f"{at}.{uuid.uuid4().hex}.part", 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                for piece in batch.column(0):
                    out.write(piece.as_buffer())
                    written += len(piece.as_buffer())
        store.move(part, at)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["bytes"])

    pieces = zip_pieces(entries, modified)
    return materialize(pieces.repartition(1).sortWithinPartitions("at").select("bytes").mapInArrow(each, "bytes long"))
