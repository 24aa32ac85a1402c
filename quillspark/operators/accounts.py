"""Whose records they are: own authors, chosen sources, batches of messages and what an import brought."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.timeline import numbered, with_positions


def remember(stored: DataFrame, fresh: DataFrame, group: str, value: str, place: str, most: int = 20) -> DataFrame:
    """(group, value, place) of a list a group: what is stored, then what is new in order of place, the last `most` kept.

    Both sides may repeat values, the first place counts; a value that is stored keeps its place.
    Null values are none. Places are ordered within each side only; those that come out tell both
    apart: rows of stored come before all of fresh. The limit is applied within tasks before rows
    are shuffled by group, so a group with most of the rows sends `most` rows a task.
    """
    def side(rows: DataFrame, n: int) -> DataFrame:
        return rows.where(F.col(value).isNotNull()).select(group, value, F.struct(F.lit(n).alias("side"), F.col(place).cast("bigint").alias("at")).alias("__at"))

    firsts = side(stored, 0).unionByName(side(fresh, 1)).groupBy(group, value).agg(F.min("__at").alias("__at"))
    newest = Window.partitionBy(group).orderBy(F.col("__at").desc(), F.col(value).desc())
    kept = firsts.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most)
    # Few rows a group are left, so counting them back from the oldest is cheap.
    oldest = Window.partitionBy(group).orderBy(F.col("__at").asc(), F.col(value).asc())
    return kept.select(group, value, (F.row_number().over(oldest) - 1).cast("bigint").alias(place))


def forget(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stored without the rows that gone names, places left as they are; names that are not there change nothing."""
    return stored.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*stored.columns)


def of_sources(rows: DataFrame, source: str, chosen: Sequence | None, count: int) -> DataFrame:
    """rows of the chosen sources, numbers from 0 up to count (exclusive) or text of such.

    Null and empty choose all. One that is no such number makes the whole choice void, so all rows
    stay. A fraction is a number that no source has.
    """
    wanted = []
    for one in chosen or ():
        try:
            number = float(one)
        except (TypeError, ValueError):
            return rows
        if not 0 <= number < count:  # false for NaN, too
            return rows
        wanted.append(number)
    return rows.where(F.col(source).cast("double").isin(wanted)) if wanted else rows


def batches(rows: DataFrame, batch: Sequence[str], order: Sequence[Column], sound: Column, chars: Column, most_rows: int, most_chars: int) -> DataFrame:
    """(batch..., incoming, taken, dropped, over, chars, refusal) of messages, each a list of records.

    The first `most_rows` records are looked at; unsound ones among them go. `over` counts those
    beyond the limit, `dropped` these and the unsound ones. chars is the length of the list as JSON,
    with brackets and commas. A batch is refused as 'size' if that exceeds most_chars, as 'empty' if
    nothing is taken. Records are numbered by one sort, so a batch with a third of all rows is many
    tasks, and only flags and lengths are shuffled.
    """
    flagged = rows.select(*batch, F.coalesce(sound, F.lit(False)).alias("__sound"), F.coalesce(chars, F.lit(0)).cast("bigint").alias("__chars"), *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    placed = numbered(flagged, batch, [F.col(f"__o{i}").asc() for i in range(len(order))], "__place")
    taken = F.col("__sound") & (F.col("__place") < most_rows)
    out = placed.groupBy(*batch).agg(
        F.count("*").alias("incoming"), F.count_if(taken).alias("taken"), F.count_if(F.col("__place") >= most_rows).alias("over"),
        F.coalesce(F.sum(F.when(taken, F.col("__chars"))), F.lit(0)).alias("__sum"),
    )
    size = F.lit(2) + F.col("__sum") + F.greatest(F.col("taken") - 1, F.lit(0))
    return out.select(
        *batch, "incoming", "taken", (F.col("incoming") - F.col("taken")).alias("dropped"), "over", size.alias("chars"),
        F.when(size > most_chars, "size").when(F.col("taken") == 0, "empty").alias("refusal"),
    )


def failures(records: DataFrame, order: Sequence[str], unreadable: Column, most: int = 20) -> DataFrame:
    """(order..., position, failures): the first `most` records that cannot be read, their place among all and how many there are.

    No row if all can be read. Records are numbered by their order alone, without their bodies.
    """
    marked = records.select(*order, F.coalesce(unreadable, F.lit(True)).alias("__bad"))
    placed = with_positions(marked, [F.col(c).asc() for c in order]).where("__bad")
    count = placed.agg(F.count("*").alias("failures"))
    head = placed.orderBy("position").limit(most)
    return head.join(F.broadcast(count)).select(*order, "position", "failures")


def summary(posts: DataFrame, media: DataFrame) -> DataFrame:
    """One row of what an import brought.

    posts is (id, created_at, reply_to_id, retweeted_id), media (id, bytes) of the posts' files.
    (posts, with_media, media, bytes, replies, retweets, oldest, newest): bytes is null without
    files and where no file has a size; posts without a time count, but for the oldest and newest.
    """
    files = media.groupBy("id").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return posts.join(files, "id", "left").agg(
        F.count("*").alias("posts"), F.count("n").alias("with_media"), F.coalesce(F.sum("n"), F.lit(0)).alias("media"), F.sum("b").alias("bytes"),
        F.count("reply_to_id").alias("replies"), F.count("retweeted_id").alias("retweets"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
    )
