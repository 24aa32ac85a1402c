"""Archive files: a JSON envelope or a ZIP that holds one, read record by record."""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest central directory of a ZIP, with what follows it.
MOST_DIRECTORY_BYTES = 64 * 1024 * 1024
#: Bytes of an envelope that are read at once, and characters of records in a batch.
CHUNK_BYTES = 1024 * 1024
BATCH_CHARS = 8 * 1024 * 1024
_WHITE = " \t\r\n"
_SOLID, _OUTSIDE, _INSIDE = re.compile(r"[^ \t\r\n]"), re.compile(r'["{}\[\],]'), re.compile(r'["\\]')


def array_elements(text: str, at: int) -> tuple[list[tuple[int, int]], bool, list[str]]:
    """(ranges, closed, problems) of the elements of the JSON array that opens at text[at].

    Strings are skipped as wholes, so brackets in them do not count. Primitives are elements too. A
    bracket that closes nothing is a problem and ends the scan; a text that ends early is not closed.
    """
    ranges, problems, depth, start, i = [], [], 0, None, at + 1
    while i < len(text):
        c = text[i]
        if c == '"':
            start = i if start is None else start
            i += 1
            while i < len(text) and text[i] != '"':
                i += 2 if text[i] == "\\" else 1
        elif c in "{[":
            start = i if start is None else start
            depth += 1
        elif c in "}]":
            if depth == 0:
                if c == "}":
                    problems.append("depth-underflow")
                    return ranges, False, problems
                if start is not None:
                    ranges.append((start, i))
                return ranges, True, problems
            depth -= 1
        elif c == "," and depth == 0:
            if start is not None:
                ranges.append((start, i))
            start = None
        elif start is None and c not in _WHITE:
            start = i
        i += 1
    return ranges, False, problems


def find_array(text: str, key: str) -> int:
    """Where the top-level array of this key opens, -1 if there is none; keys within strings do not count."""
    depth, i, last = 0, 0, None
    while i < len(text):
        c = text[i]
        if c == '"':
            end = i + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            last, i = text[i + 1:end], end
        elif c == "[" and depth == 1 and last == key:
            return i
        elif c in "{[":
            depth, last = depth + 1, None
        elif c in "}]":
            depth -= 1
        elif c == ",":
            last = None
        i += 1
    return -1


def stream_elements(chunks: Iterator[str], key: str) -> Iterator[tuple[str | None, str | None]]:
    """(element, problem) of the top-level array of this key, as find_array and array_elements have it.

    The text comes in chunks, and no more of it is held than the element or string that is read. No
    such array raises ValueError; an array that is not closed ends with the problem 'truncated'.
    """
    text, i, depth, string, start, last, within = "", 0, 0, None, None, None, False
    for chunk in chunks:
        kept = min(len(text), i, *(p for p in (string, start) if p is not None))
        text, i = text[kept:] + chunk, i - kept
        string, start = (None if p is None else p - kept for p in (string, start))
        while i < len(text):
            m = (_OUTSIDE if string is None else _INSIDE).search(text, i)
            at = m.start() if m else len(text)
            if string is not None:
                i = at + 2 if m and text[at] == "\\" else at + 1 if m else at
                if m and text[at] == '"':
                    last, string = None if within else text[string + 1:at], None
                continue
            if within and start is None and (solid := _SOLID.search(text, i, at)):
                start = solid.start()
            i = at + 1 if m else at
            c = text[at] if m else ""
            if c == '"':
                string = at
                start = at if within and start is None else start
            elif not within:
                if c == "[" and depth == 1 and last == key:
                    within, depth = True, 0
                elif c and c in "{[":
                    depth, last = depth + 1, None
                elif c and c in "}]":
                    depth -= 1
                elif c == ",":
                    last = None
            elif c and c in "{[":
                start = at if start is None else start
                depth += 1
            elif c and c in "}]":
                if depth == 0:
                    if c == "}":
                        yield None, "depth-underflow"
                    elif start is not None:
                        yield text[start:at].strip(_WHITE), None
                    return
                depth -= 1
            elif c == "," and depth == 0:
                if start is not None:
                    yield text[start:at].strip(_WHITE), None
                start = None
    if not within:
        raise ValueError(f"no array {key}")
    yield None, "truncated"


@contextmanager
def open_envelope(content: bytes | IO[bytes], entry: str = "tweets.json") -> Iterator[IO[bytes]]:
    """The envelope within a file as a stream: itself, or a ZIP's entry of any size if the file begins with PK.

    content is the file's bytes or the file, open at its start and able to seek. The entry's checksum
    is tested where the stream ends. A checksum that does not match, an unknown method or an oversize
    central directory raises ValueError.
    """
    file = io.BytesIO(content) if isinstance(content, bytes) else content
    zipped = file.read(2) == b"PK"
    file.seek(0)
    if not zipped:
        yield file
        return
    # The end record lies in the last 64 KB and a bit; what it says of the directory is tested before that is read.
    size = file.seek(0, io.SEEK_END)
    file.seek(max(0, size - (1 << 16) - 22))
    tail = file.read()
    end = tail.rfind(b"PK\x05\x06")
    if end >= 0 and size - int.from_bytes(tail[end + 16:end + 20], "little") > MOST_DIRECTORY_BYTES and tail[end + 16:end + 20] != b"\xff" * 4:
        raise ValueError("the central directory is too large")
    file.seek(0)
    try:
        with zipfile.ZipFile(file) as z:
            names = [n for n in z.namelist() if n == entry or n.endswith("/" + entry)]
            if not names:
                raise ValueError(f"no {entry} in the archive")
            with z.open(names[0]) as stream:
                yield stream
    except (zipfile.BadZipFile, zlib.error, NotImplementedError) as e:
        raise ValueError(str(e)) from e


def stored_elements(opened, key: str, entry: str = "tweets.json") -> Iterator[tuple]:
    """(position, record, error) of a file's array; opened() gives the file at its start, twice.

    It is streamed twice: checksum and encoding first, so a damaged file gives no records, then its
    elements. A file that cannot be read gives one row with an error.
    """
    try:
        with opened() as file, open_envelope(file, entry) as stream:
            for _ in _chunks(stream):
                pass
        with opened() as file, open_envelope(file, entry) as stream:
            for i, (record, problem) in enumerate(stream_elements(_chunks(stream), key)):
                yield None if record is None else i, record, problem
    except (ValueError, UnicodeDecodeError) as e:
        yield None, None, str(e)


def envelope_bytes(content: bytes, entry: str = "tweets.json") -> bytes:
    """The whole envelope within a file, see open_envelope."""
    with open_envelope(content, entry) as stream:
        return stream.read()


def _chunks(stream: IO[bytes]) -> Iterator[str]:
    """A stream's text; bytes that are not UTF-8 raise UnicodeDecodeError."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    while data := stream.read(CHUNK_BYTES):
        yield decoder.decode(data)
    yield decoder.decode(b"", final=True)


def read_envelopes(spark: SparkSession, paths: list[str] | str, key: str = "tweets", entry: str = "tweets.json") -> DataFrame:
    """(path, position, record, error): each element of the files' arrays as JSON text.

    Files are read where the tasks run, one file a row; unreadable ones give a single row with an
    error and do not end the job. A truncated array gives the elements before the cut and one row
    with error 'truncated'. An envelope is streamed twice: checksum and encoding first, so a damaged
    file gives no records, then its elements.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def packed(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()),
             pa.array([r[2] for r in part], pa.string()), pa.array([r[3] for r in part], pa.string())],
            names=["path", "position", "record", "error"],
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part, chars = [], 0
                for row in stored_elements(lambda content=content: io.BytesIO(content), key, entry):
                    row = (path, *row)
                    part.append(row)
                    chars += len(row[2] or "")
                    if len(part) == 5000 or chars >= BATCH_CHARS:
                        yield packed(part)
                        part, chars = [], 0
                if part:
                    yield packed(part)

    return files.mapInArrow(each, "path string, position long, record string, error string")


def envelope_heads(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, schema_version, exported_at, stated, offset_minutes): the scalars around the arrays."""
    text = F.decode("content", "utf-8")
    json_files = spark.read.format("binaryFile").load(paths).where(F.substring("content", 1, 2) != F.lit(b"PK")).select("path", text.alias("t"))
    number = lambda name: F.regexp_extract("t", f'"{name}"\\s*:\\s*(-?[0-9]+)', 1).try_cast("bigint")
    return json_files.select(
        "path", number("schemaVersion").alias("schema_version"), F.nullif(F.regexp_extract("t", '"exportedAt"\\s*:\\s*"([^"]*)"', 1), F.lit("")).alias("exported_at"),
        number("count").alias("stated"), number("offsetMinutes").alias("offset_minutes"),
    )


def integrity(records: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, records, unreadable, stated, problems, complete) of each file: what is there against what it says."""
    counted = records.groupBy("path").agg(
        F.count("record").alias("records"), F.count_if(F.col("record").isNotNull() & F.try_parse_json("record").isNull()).alias("unreadable"),
        F.array_sort(F.collect_set("error")).alias("problems"),
    )
    return counted.join(heads.select("path", "stated"), "path", "left").withColumn(
        "complete", (F.size("problems") == 0) & (F.col("unreadable") == 0) & F.coalesce(F.col("stated") == F.col("records"), F.lit(True))
    )


def listing(spark: SparkSession, path: str, most: int = 20_000) -> DataFrame:
    """(timestamp, original) out of a snapshot listing, a JSON array of arrays whose first row is a header."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("rows"))
    pairs = rows.select(F.posexplode("rows").alias("n", "row")).where(F.col("n").between(1, most))
    return pairs.select(F.get("row", F.lit(0)).alias("timestamp"), F.get("row", F.lit(1)).alias("original"))


def dump(head: dict, records: Iterator[str], tail: dict) -> Iterator[str]:
    """An envelope's lines: head fields, one compact record a line, count and the sections that are not empty."""
    yield "{" + ",".join(f"{json.dumps(k)}:{json.dumps(v, ensure_ascii=False, separators=(',', ':'))}" for k, v in head.items()) + ',"tweets":['
    n = 0
    for record in records:
        yield ("," if n else "") + record
        n += 1
    rest = "".join(f",{json.dumps(k)}:{json.dumps(v, ensure_ascii=False, separators=(',', ':'))}" for k, v in tail.items() if v)
    yield f'],"count":{n}{rest}}}'
