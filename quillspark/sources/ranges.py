"""JSON archive files of any size, read by byte ranges in parallel.

Spark's text reader cuts files into ranges of spark.sql.files.maxPartitionBytes and gives what lies
between commas, which no character and no escape crosses, so a range begins behind a comma, inside a
string or not. The first pass scans each range for both cases: how it ends, how deep it goes, where
it may open the wanted array. One row a range is put together in the order of the file, which tells
what each range really begins with; the second pass yields elements, and those that cross ranges are
joined from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.timeline import numbered
from quillspark.scratch import Tables, small

_QUOTE, _BACKSLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_STEP = np.zeros(256, dtype=np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_WHITE = b" \t\r\n"
_MARK = re.compile(rb'["\\]')


def _outside(raw: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """(mask, inside): which bytes lie outside strings, quotes not counted, and whether a string is open at the end.

    Within strings a backslash takes the byte after it along; outside it means nothing.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    quotes, slashes = data == _QUOTE, data == _BACKSLASH
    if slashes.any():
        at = np.flatnonzero(slashes)
        first = np.concatenate(([True], np.diff(at) > 1))
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        odd = at[place % 2 == 0] + 1  # every other one of a run takes what follows it
        quotes[odd[odd < len(data)]] = False
    within = (np.cumsum(quotes) & 1).astype(bool) ^ inside
    if (slashes & ~within).any():
        return _outside_by_steps(raw, inside)
    return ~within & ~quotes, bool(within[-1]) if len(data) else inside


def _outside_by_steps(raw: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """The same for texts with a backslash outside strings."""
    mask, at = np.zeros(len(raw), dtype=bool), 0
    while at < len(raw):
        if not inside:
            end = raw.find(b'"', at)
            mask[at:len(raw) if end < 0 else end] = True
            if end < 0:
                break
            inside, at = True, end + 1
            continue
        m = _MARK.search(raw, at)
        if not m:
            break
        if m.group() == b'"':
            inside, at = False, m.end()
        else:
            at = m.end() + 1
    return mask, inside


@dataclass
class _Scan:
    """A range as it looks if it begins inside a string, or if not."""

    inside: bool
    depth: int = 0
    low: int = 0
    opens: dict[int, list[int]] = field(default_factory=dict)  # depth before the bracket: [offset behind it, depth there, least depth since]

    def add(self, raw: bytes, offset: int, key: re.Pattern) -> None:
        mask, after = _outside(raw, self.inside)
        depths = self.depth + np.cumsum(np.where(mask, _STEP[np.frombuffer(raw, dtype=np.uint8)], 0))
        if len(depths):
            lowest = int(depths.min())
            for found in self.opens.values():
                found[2] = min(found[2], lowest)
            self.low = min(self.low, lowest)
            for m in key.finditer(raw):
                before = int(depths[m.end() - 2])
                opened = mask[m.end() - 1] and (mask[m.start() - 1] if m.start() else not self.inside)
                if opened and before not in self.opens:
                    here = int(depths[m.end() - 1])
                    self.opens[before] = [offset + m.end(), here, int(depths[m.end():].min(initial=here))]
            self.depth = int(depths[-1])
        self.inside = after

    def told(self) -> dict:
        return {
            "inside": self.inside, "depth": self.depth, "low": self.low,
            "opens": [{"before": d, "at": at, "delta": self.depth - here, "low": low - here} for d, (at, here, low) in self.opens.items()],
        }


_OPEN = pa.struct([("before", pa.int64()), ("at", pa.int64()), ("delta", pa.int64()), ("low", pa.int64())])
_END = pa.struct([("inside", pa.bool_()), ("depth", pa.int64()), ("low", pa.int64()), ("opens", pa.list_(_OPEN))])
_LONG = T.LongType()
_ENDS = T.StructType([T.StructField("inside", T.BooleanType()), T.StructField("depth", _LONG), T.StructField("low", _LONG), T.StructField(
    "opens", T.ArrayType(T.StructType([T.StructField(c, _LONG) for c in ("before", "at", "delta", "low")])))])


def _pieces(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, start, size, seq, piece): what lies between commas, in order within each range."""
    at = lambda c: F.col(f"_metadata.{c}")
    return spark.read.option("lineSep", ",").text(paths).select(
        at("file_path").alias("path"), at("file_block_start").alias("start"), at("file_size").alias("size"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("piece")
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of batches that belong to one range, as ((path, start), slice)."""
    for batch in batches:
        keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True))
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                yield keys[first], batch.slice(first, i - first)
                first = i


def _summaries(key: str):
    """One row a range: its bytes, whether they are UTF-8 and begin a ZIP, and how it ends for either beginning."""
    pattern = re.compile(rb'"' + re.escape(key.encode()) + rb'"[^"{}\[\],]*\[')
    names = ["path", "start", "size", "bytes", "sound", "zip", "out", "within"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, scans = None, {}, ()

        def packed() -> pa.RecordBatch:
            values = [now[0], now[1], row["size"], row["bytes"], row["sound"], row["zip"], scans[0].told(), scans[1].told()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), _END, _END]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        for own, part in _runs(batches):
            raw = b"".join(p + b"," for p in part.column("piece").to_pylist())
            if own != now:
                if now is not None:
                    yield packed()
                now, scans = own, (_Scan(False), _Scan(True))
                row = {"size": part.column("size")[0].as_py(), "bytes": 0, "sound": True, "zip": own[1] == 0 and raw[:2] == b"PK"}
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                row["sound"] = False
            for scan in scans:
                scan.add(raw, row["bytes"], pattern)
            row["bytes"] += len(raw)
        if now is not None:
            yield packed()

    return each


_SUMMARY = T.StructType([
    T.StructField("path", T.StringType()), *[T.StructField(c, _LONG) for c in ("start", "size", "bytes")], *[T.StructField(c, T.BooleanType()) for c in ("sound", "zip")],
    T.StructField("out", _ENDS), T.StructField("within", _ENDS),
])
_PLAN = "path string, start long, opens_at long, inside boolean, depth long, cut boolean, error string"


def _planned(key: str):
    """What each range of a file begins with, by its ranges in order; a file that cannot be read is one row with an error."""

    def each(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        path, out = rows[0]["path"], []
        error = "zip" if rows[0]["zip"] else None if all(r["sound"] for r in rows) else "not UTF-8"
        # A comma is put behind every piece; the last of the file has one only if the bytes say so.
        cut = sum(r["bytes"] for r in rows) > rows[0]["size"]
        status, depth, inside = "before", 0, False
        for i, r in enumerate(rows if error is None else ()):
            end = r["within" if inside else "out"]
            plan = {"path": path, "start": r["start"], "opens_at": None, "inside": inside, "depth": depth, "cut": cut and i == len(rows) - 1, "error": None}
            if status == "before":
                found = next((o for o in end["opens"] if depth + o["before"] == 1), None)
                if found:
                    out.append(plan | {"opens_at": found["at"]})
                    status, depth = "within" if found["low"] >= 0 else "after", found["delta"]
                else:
                    depth += end["depth"]
            else:
                out.append(plan)
                status, depth = "within" if depth + end["low"] >= 0 else "after", depth + end["depth"]
            inside = end["inside"]
            if status == "after":
                break
        if error is None and status == "before":
            error = f"no array {key}"
        if error:
            out = [{"path": path, "start": -1, "opens_at": None, "inside": False, "depth": 0, "cut": False, "error": error}]
        kinds = [("path", pa.string()), ("start", pa.int64()), ("opens_at", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("cut", pa.bool_()), ("error", pa.string())]
        return pa.Table.from_pylist(out, schema=pa.schema(kinds))

    return each


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, nth, text, last, end) of ranges whose rows come in order, with what they begin with.

    A slot is what lies between separators of the array: nth counts those of the range, the first
    and last of which may go on in others. end is the bracket that ends the array there.
    """
    columns = [("path", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("text", pa.binary()), ("last", pa.bool_()), ("end", pa.string())]
    schema = pa.schema(columns)
    now, held, nth, depth, inside, ended, seen, skip = None, [], 0, 0, False, False, 0, 0
    out: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(columns)], schema=schema)

    def tail() -> None:
        if now is not None and not ended:
            out.append((*now, nth, b"".join(held), True, None))

    def ahead(runs: Iterator[tuple]) -> Iterator[tuple]:
        """Each run with whether it is the last of its range."""
        before = None
        for run in runs:
            if before is not None:
                yield *before, before[0] != run[0]
            before = run
        if before is not None:
            yield *before, True

    for own, part, closes in ahead(_runs(batches)):
        if own != now:
            tail()
            now, held, nth, ended, seen = own, [], 0, False, 0
            depth, inside = part.column("depth")[0].as_py(), part.column("inside")[0].as_py()
            opens = part.column("opens_at")[0].as_py()
            skip = opens or 0
        raw = b"".join(p + b"," for p in part.column("piece").to_pylist())
        if closes and part.column("cut")[0].as_py():
            raw = raw[:-1]
        if not ended and seen + len(raw) > skip:
            begin = max(0, skip - seen)
            if begin:  # what comes before the array counts for strings only
                inside = _outside(raw[:begin], inside)[1]
                depth = 0
            body = raw[begin:]
            mask, inside = _outside(body, inside)
            data = np.frombuffer(body, dtype=np.uint8)
            depths = depth + np.cumsum(np.where(mask, _STEP[data], 0))
            below = np.flatnonzero(depths < 0)
            stop = int(below[0]) if len(below) else len(body)
            at = 0
            for comma in np.flatnonzero(mask[:stop] & (data[:stop] == _COMMA) & (depths[:stop] == 0)).tolist():
                text = b"".join([*held, body[at:comma]])
                out.append((*now, nth, text, False, None))
                size += len(text)
                held, nth, at = [], nth + 1, comma + 1
            held.append(body[at:stop])
            if len(below):
                out.append((*now, nth, b"".join(held), True, chr(data[stop])))
                ended = True
            depth = int(depths[-1]) if len(depths) else depth
        elif not ended:
            inside = _outside(raw, inside)[1]
        seen += len(raw)
        if size > 4 << 20 or len(out) > 5000:
            yield packed()
            out, size = [], 0
    tail()
    yield packed()


def read_ranges(spark: SparkSession, paths: list[str] | str, key: str = "tweets") -> DataFrame:
    """(path, position, record, error): each element of the files' top-level array of this key, as JSON text.

    As envelope.read_envelopes() has it, for files of any size that are not ZIPs: those that cannot
    be read give one row with an error; a truncated array gives the elements before the cut and one
    row with error 'truncated', a brace that closes nothing one with 'depth-underflow'. Ranges are as
    long as spark.sql.files.maxPartitionBytes says. An element is held in memory as a whole, nothing
    else; what is put together in one task a file is one row a range.
    """
    held = Tables()
    pieces = _pieces(spark, paths)
    sums = held.keep(pieces.select("path", "start", "size", "piece").mapInArrow(_summaries(key), _SUMMARY))
    plans = held.keep(sums.groupBy("path").applyInArrow(_planned(key), _PLAN))
    told = plans.where("error is null").select(F.col("path").alias("__p"), F.col("start").alias("__s"), "opens_at", "inside", "depth", "cut")
    side = small(told, plans)
    met = pieces.join(side, (F.col("path") == F.col("__p")) & (F.col("start") == F.col("__s"))).select("path", "start", "seq", "piece", "opens_at", "inside", "depth", "cut")
    if side is told:  # more ranges than can be broadcast: pieces are put in order again
        met = met.repartition("path", "start").sortWithinPartitions("path", "start", "seq")
    slots = held.keep(met.drop("seq").mapInArrow(_slots, "path string, start long, nth long, text binary, last boolean, end string"))
    each = slots.groupBy("path", "start").agg(F.max("nth").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.keep(each.select(F.col("path").alias("__p"), F.col("start").alias("__s"), before.alias("before")))
    placed = slots.join(small(offsets), (F.col("path") == F.col("__p")) & (F.col("start") == F.col("__s"))).select("path", "start", (F.col("before") + F.col("nth")).alias("slot"), "nth", "text", "last", "end")
    whole = placed.where("nth > 0 and not last").select("path", "slot", "text", F.lit(None).cast("string").alias("end"), F.lit(False).alias("open"))
    parts = placed.where("nth = 0 or last").groupBy("path", "slot").agg(
        F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"), F.max("end").alias("end"), F.bool_and("last").alias("open")
    )
    # A slot is done once a range goes on behind it; the last one of a file only with the array's bracket.
    joined = parts.select("path", "slot", F.aggregate("parts", F.lit("").cast("binary"), lambda acc, p: F.concat(acc, p["text"])).alias("text"), "end", F.col("open") & F.coalesce(F.col("end") != "]", F.lit(True)))
    joined = held.keep(joined.toDF("path", "slot", "text", "end", "open"))
    done = whole.union(joined)
    trimmed = F.decode(F.col("text"), "utf-8")
    trimmed = F.regexp_replace(trimmed, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")
    # Elements lie in one written table only; what is done to them on the way out is not written again.
    found = done.where(~F.col("open")).select("path", "slot", trimmed.alias("record")).where("record <> ''")
    counts = found.groupBy("path").agg((F.count("*") == F.max("slot") + 1).alias("dense"))
    if counts.where("not dense").isEmpty():
        records = found.select("path", F.col("slot").alias("position"), "record", F.lit(None).cast("string").alias("error"))
    else:  # nothing between two commas is no element
        records = numbered(found, ["path"], [F.col("slot").asc()], "position").select("path", "position", "record", F.lit(None).cast("string").alias("error"))
    ends = plans.where("error is null").select("path").distinct().join(placed.where("end is not null").select("path", "end"), "path", "left")
    problem = F.when(F.col("end").isNull(), "truncated").when(F.col("end") == "}", "depth-underflow")
    problems = ends.select("path", problem.alias("error")).union(plans.select("path", "error")).where("error is not null and error <> 'zip'")
    problems = held.keep(problems.select("path", F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("string").alias("record"), "error"))
    held.close(slots, offsets, joined, problems)
    return records.union(problems)


def zips(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path) of the files that begin as ZIPs do; only each file's first bytes are looked at."""
    first = spark.read.format("binaryFile").load(paths).select("path", F.substring("content", 1, 2).alias("head"))
    return first.where(F.col("head") == F.lit(b"PK")).select("path")
