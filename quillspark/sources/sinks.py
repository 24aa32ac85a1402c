"""Writing archives: envelopes in shards, roster CSV, stored ZIPs and hosted trees."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import csv_cell, safe_name
from quillspark.functions.urls import safe_archive_name
from quillspark.operators import shards
from quillspark.operators.timeline import collated, numbered, with_positions
from quillspark.sources.envelope import dump

#: Columns of a roster file, in order.
ROSTER = (
    "list", "userId", "screenName", "name", "bio", "location", "website", "followers", "following", "posts",
    "firstSeenAt", "lastSeenAt", "profileUrl", "lastSeenBy",
)


def record_json(columns: Sequence[str]) -> Column:
    """A record as compact JSON in the given field order."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def export_profile(profiles: DataFrame) -> DataFrame:
    """The profile that goes with an export: the one seen last, an imported one only if there is no other."""
    return profiles.orderBy(F.col("imported").asc(), F.col("last_seen_at").desc_nulls_last(), F.col("user_id").desc()).limit(1)


def envelope_lines(records: DataFrame, order: Sequence[Column], columns: Sequence[str], head: dict, tail: dict, files: int | None = None) -> DataFrame:
    """(value): the lines of one envelope a partition, each with its own count; records come in order, range by range.

    files is the number of envelopes, by default as many as ranges are dealt to; 1 gives the whole
    archive as one, streamed through one task. A range without records gives no envelope, an empty
    table one that is empty.
    """
    import pyarrow as pa

    rows = records.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order).select(record_json(columns).alias("value"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def texts() -> Iterator[str]:
            yield from first.column(0).to_pylist()
            for batch in batches:
                yield from batch.column(0).to_pylist()

        part: list[str] = []
        size = 0
        for line in dump(head, texts(), tail):
            part.append(line)
            size += len(line)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["value"])
                part, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["value"])

    if records.isEmpty():
        return records.sparkSession.createDataFrame([(line,) for line in dump(head, iter(()), tail)], "value string").coalesce(1)
    return rows.mapInArrow(each, "value string")


def write_envelopes(records: DataFrame, order: Sequence[Column], columns: Sequence[str], path: str, head: dict, tail: dict, files: int | None = None) -> None:
    """An archive as a folder of envelopes, written by the tasks; see envelope_lines()."""
    envelope_lines(records, order, columns, head, tail, files).write.text(path)


def shard_numbers(records: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], budget: int, overhead: int = 6, size: Column | None = None, most: int | None = None) -> DataFrame:
    """records with shard: closed greedily by the bytes of each record's JSON, or else by size, within each group; see shards.greedy()."""
    size = F.octet_length(record_json(columns)) + overhead if size is None else size
    return shards.greedy(records, group, order, size, budget, most)


def write_shards(sharded: DataFrame, columns: Sequence[str], path: str) -> None:
    """Shards as folders of JSON lines, written by the tasks."""
    sharded.select("shard", record_json(columns).alias("value")).write.partitionBy("shard").text(path)


def roster_lines(roster: DataFrame) -> DataFrame:
    """(list, userId, line): CSV lines of the ROSTER columns; lines end with CR LF when written."""
    cells = [csv_cell(F.col(c)) if c in roster.columns else F.lit("") for c in ROSTER]
    return roster.select("list", "userId", F.concat_ws(",", *cells).alias("line"))


def write_roster(roster: DataFrame, path: str) -> None:
    """A roster file as a folder of ranges in order, by list, handle in the order of UNICODE, and id; the first range begins with the header."""
    handle = [collated(F.col("screenName")).asc()] if "screenName" in roster.columns else []
    placed = with_positions(roster, [F.col("list").asc(), *handle, F.col("userId").asc()])
    first = roster.sparkSession.createDataFrame([(-1, ",".join(ROSTER))], "position long, line string")
    cells = [csv_cell(F.col(c)) if c in roster.columns else F.lit("") for c in ROSTER]
    lines = first.union(placed.select("position", F.concat_ws(",", *cells).alias("line")))
    lines.repartitionByRange("position").sortWithinPartitions("position").select("line").write.option("lineSep", "\r\n").text(path)


def write_listings(rows: DataFrame, order: Sequence[Column], path: str) -> None:
    """Snapshot listings of rows(timestamp, original), a file a range: an array of arrays behind a header."""
    import pyarrow as pa

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = False
        for batch in batches:
            lines = ["," + json.dumps(list(r), ensure_ascii=False) for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([] if some else ['[["timestamp","original"]'], pa.string())], names=["value"])
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("timestamp", "original")
    dealt.mapInArrow(each, "value string").write.text(path)


def media_names(media: DataFrame, *more: str) -> DataFrame:
    """(post_id, media_id, name, blob): media/<post>_<media><ext> for rows with a blob and usable ids, with more columns."""
    name = F.concat(F.lit("media/"), F.col("post_id").cast("string"), F.lit("_"), safe_name(F.col("media_id").cast("string")), F.coalesce("ext", F.lit("")))
    return media.where(F.col("blob").isNotNull() & F.col("post_id").cast("string").rlike("^[0-9]{1,25}$")).select("post_id", "media_id", name.alias("name"), "blob", *more)


def media_index_text(entries: DataFrame) -> DataFrame:
    """(line): post, media and file in columns of 18, 18 and 43, with blanks between and longer values uncut, then the kind or a question mark.

    entries has post_id, media_id, name and kind.
    """
    pad = lambda c, n: F.rpad(F.col(c).cast("string"), F.greatest(F.lit(n), F.length(F.col(c).cast("string"))), F.lit(" "))
    kind = F.when(F.coalesce("kind", F.lit("")) == "", "?").otherwise(F.col("kind"))
    return entries.select(F.concat_ws(" ", pad("post_id", 18), pad("media_id", 18), pad("name", 43), kind).alias("line"))


def media_index_json(entries: DataFrame) -> DataFrame:
    """(entry): each file of entries(name, post_id, media_id, kind, content_type, bytes) as JSON; empty answers are null."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    entry = F.struct(
        F.col("name").alias("file"), F.col("post_id").cast("string").alias("tweetId"), F.col("media_id").cast("string").alias("mediaId"),
        some("kind").alias("type"), some("content_type").alias("contentType"), F.col("bytes").cast("bigint").alias("bytes"),
    )
    return entries.select(F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))


def write_media_index(entries: DataFrame, path: str, meta: dict) -> None:
    """The machine-readable index: a head of counts, and the entries as a folder of JSON lines beside it, written by the tasks."""
    media_index_json(entries).write.mode("overwrite").text(f"{path}/files")
    head = {
        "generator": meta.get("generator", "quillspark"), "generatorVersion": meta.get("version") or "unknown", "schemaVersion": meta.get("schemaVersion", 1),
        "generatedAt": meta.get("generatedAt"), "fileCount": entries.count(), "skipped": meta.get("skipped", 0),
    }
    entries.sparkSession.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def hosted_layout(files: DataFrame, budget: int) -> DataFrame:
    """files(post_id, media_id, created_at, ext) with path: media/YYYY/MM/ in UTC, `unknown` without a date.

    Beyond `budget` files a month goes on in directories -2, -3 and so on. Names that collide keep
    the first and mark the others as problems. The outcome does not depend on the order of rows.
    """
    month = F.coalesce(F.date_format("created_at", "yyyy/MM"), F.lit("unknown"))
    name = F.concat(F.col("post_id").cast("string"), F.lit("_"), safe_name(F.col("media_id").cast("string")), F.coalesce("ext", F.lit("")))
    named = files.withColumn("month", month).withColumn("file", name)
    # Files of one name are copies of one key and few; files of a month can be a third of all.
    n = F.row_number().over(Window.partitionBy("month", "file").orderBy("post_id", "media_id"))
    marked = numbered(named.withColumn("problem", n > 1), ["month", "problem"], [F.col("post_id").asc(), F.col("media_id").asc()], "place")
    spill = F.floor(F.col("place") / budget)
    folder = F.concat(F.lit("media/"), F.col("month"), F.when(F.col("spill") > 0, F.concat(F.lit("-"), (F.col("spill") + 1).cast("string"))).otherwise(""))
    return marked.withColumn("spill", spill).withColumn("path", F.when(~F.col("problem"), F.concat(folder, F.lit("/"), F.col("file")))).drop("month", "spill", "file", "place")


def hosted_index_valid(files: DataFrame, most_bytes: int) -> DataFrame:
    """(path, bytes, valid): safe paths and whole sizes within the cap."""
    size = F.col("bytes").try_cast("double")
    return files.withColumn("valid", safe_archive_name(F.col("path")) & ~F.col("path").contains("//") & F.coalesce((size >= 0) & (size <= most_bytes) & (size == F.floor(size)), F.lit(False)))
