"""An index for searches: three-character pieces and lists as bitmaps of ids, intersected, then verified."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.timeline import all_terms_match
from quillspark.scratch import materialize, small

#: Characters of a piece, and ids of a bitmap as Spark's functions have it.
PIECE, BUCKET = 3, 32_768


def haystack(columns: Sequence[Column], lists: Sequence[Column] = ()) -> Column:
    """What is searched of a record: its texts and what its lists hold, joined by line feeds, in lower case; nulls are left out."""
    return F.lower(F.concat_ws("\n", *columns, *[F.array_join(x, "\n") for x in lists]))


def _bitmap(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def _numbers(text: str) -> np.ndarray:
    """The pieces of a text as numbers, 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:] if len(c) >= PIECE else c[:0]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, bucket, places) of each batch: the ids that hold a piece, as places in their bucket."""
    for batch in batches:
        found = [np.unique(_numbers(t)) for t in batch.column("hay").to_pylist()]
        ids = np.repeat(np.array(batch.column("id").to_pylist(), dtype=np.int64), [len(f) for f in found]) - 1
        if not len(ids):
            continue
        pieces, buckets, places = np.concatenate(found), ids // BUCKET + 1, (ids % BUCKET).astype("<u2")
        order = np.lexsort((places, buckets, pieces))
        pieces, buckets, places = pieces[order], buckets[order], places[order]
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(pieces) != 0) | (np.diff(buckets) != 0))))
        offsets = pa.py_buffer(np.append(starts, len(places)).astype(np.int32) * 2)
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(places.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(pieces[starts]), pa.array(buckets[starts]), packed], names=["piece", "bucket", "places"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings that come sorted, as one bitmap for each piece and bucket; one is built at a time."""
    now, bits, out = None, np.zeros(BUCKET, dtype=bool), []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["piece", "bucket", "bits"])

    for batch in batches:
        for piece, bucket, places in zip(*(batch.column(c).to_pylist() for c in ("piece", "bucket", "places")), strict=True):
            if (piece, bucket) != now:
                if now is not None:
                    out.append((*now, np.packbits(bits, bitorder="little").tobytes()))
                now, bits = (piece, bucket), np.zeros(BUCKET, dtype=bool)
            bits[np.frombuffer(places, dtype="<u2")] = True
            if len(out) == 500:
                yield packed()
                out = []
    if now is not None:
        out.append((*now, np.packbits(bits, bitorder="little").tobytes()))
    yield packed()


def index(rows: DataFrame, key: str, hay: Column) -> DataFrame:
    """(piece, bucket, bits): for each piece of the haystacks the ids that hold it, a bitmap for 32,768 neighbouring ids.

    ids are longs from 1 on; other rows (null ids, null haystacks) are not found by it. Pieces are
    numbers; a batch's ids of one piece are put together before they are shuffled, two bytes each.
    The table is written by ranges of pieces, so a search reads only the row groups of its own.
    """
    known = rows.select(F.col(key).cast("bigint").alias("id"), hay.alias("hay")).where("id > 0 and length(hay) >= 3")
    postings = known.mapInArrow(_postings, "piece long, bucket long, places binary")
    dealt = postings.repartitionByRange("piece", "bucket").sortWithinPartitions("piece", "bucket")
    return materialize(dealt.mapInArrow(_bitmaps, "piece long, bucket long, bits binary"))


def list_bitmaps(rows: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): a list of ids, such as what a tab shows, as bitmaps."""
    return _bitmap(rows.select(F.col(key).cast("bigint").alias("id")).where("id > 0"))


def intersected(bitmaps: Sequence[DataFrame]) -> DataFrame:
    """(bucket, bits) of the ids that are in all of them."""
    every = bitmaps[0].select("bucket", "bits")
    for more in bitmaps[1:]:
        every = every.unionByName(more.select("bucket", "bits"))
    return every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(bitmaps)).drop("n")


def pieces_of(query: str) -> list[int]:
    """The pieces of a query's terms; terms shorter than a piece have none."""
    return sorted({int(n) for t in query.lower().split() for n in _numbers(t)})


def candidates(built: DataFrame, query: str, within: Sequence[DataFrame] = ()) -> DataFrame | None:
    """(bucket, bits) of the ids that hold all pieces of a query and are in all lists; None if neither says anything."""
    wanted = pieces_of(query)
    if not wanted and not within:
        return None
    found = []
    if wanted:
        hits = built.where(F.col("piece").isin(wanted)).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        found.append(hits.where(F.col("n") == len(wanted)).select("bucket", "bits"))
    return intersected([*found, *within]) if len(found) + len(within) > 1 else (found or list(within))[0].select("bucket", "bits")


def holds(bits: Column, position: Column) -> Column:
    """Whether a bitmap has this position."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(position, F.lit(8)))), F.lit(2)) == 1


def search(rows: DataFrame, key: str, hay: Column, built: DataFrame, query: str, within: Sequence[DataFrame] = ()) -> DataFrame:
    """rows whose haystack holds every term of the query, out of the index's candidates; equal to the scan of all.

    Candidates are one bitmap a bucket; texts of others are not looked at. A query without a term of
    PIECE characters scans what the lists leave.
    """
    found = candidates(built, query, within)
    if found is not None:
        found = materialize(found)
        at = F.col(key).cast("bigint")
        rows = rows.join(small(found), (F.bitmap_bucket_number(at) == F.col("bucket")) & (at > 0) & holds(F.col("bits"), F.bitmap_bit_position(at))).select(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.where(all_terms_match([hay], query))
