"""Streams with state by key: records merged in any order of arrival, a bounded queue with retries, gauges of sessions.

All state is in Spark's state store and its checkpoint, so a stream that is killed goes on with it.
transformWithState needs the RocksDB store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions.absence import is_absent

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Items that a queue takes by where they come from, and how long it waits before it tries again.
CAPS = {"capture": 50, "import": 500, "restore": 2000}
RETRY_MS = 15_000


def use_rocksdb(spark: SparkSession) -> None:
    """Set the store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# -- records -----------------------------------------------------------------------------------------


class _Records(StatefulProcessor):
    """Per key: each field's newest answer with its time and tie, and the earliest deletion.

    The state is a function of the set of rows that were seen, so it does not depend on their order
    nor on how they fall into batches, and a row that comes twice changes nothing.
    """

    def __init__(self, fields: int):
        self.fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("record", "record string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = json.loads(self.state.get()[0]) if self.state.exists() else {"seen": False, "at": None, "deleted": None, "fields": [None] * self.fields}
        for part in rows:
            for row in part.itertuples(index=False):
                if row.deleted is not None:
                    gone = int(row.deleted)
                    now["deleted"] = gone if now["deleted"] is None else min(now["deleted"], gone)
                    continue
                now["seen"], place = True, [int(row.at), int(row.tie)]
                now["at"] = place[0] if now["at"] is None else max(now["at"], place[0])
                for i in range(self.fields):
                    value = getattr(row, f"f{i}")
                    # Of answers that are equal in time and tie the greatest text counts.
                    if value is not None and (now["fields"][i] is None or [*place, value] > now["fields"][i]):
                        now["fields"][i] = [*place, value]
        self.state.update((json.dumps(now),))
        if now["seen"]:  # a deletion of what is not there yet waits
            fields = {f"f{i}": [None if f is None else f[2]] for i, f in enumerate(now["fields"])}
            yield pd.DataFrame({"key": [key[0]], "at": [str(now["at"])], "deleted": [None if now["deleted"] is None else str(now["deleted"])], **fields})

    def close(self) -> None:
        pass


def keyed_records(stream: DataFrame, columns: Sequence[str], key: str = "id", at: str = "captured_at", deleted: str = "deleted_at", tie: str | None = None) -> DataFrame:
    """(key, columns..., at, deleted): each record as it is after every batch that changes it, in update mode.

    A row whose deleted is not null is a deletion, which stays with its record: the earliest counts,
    and one that comes before its record waits for it. Other rows are captures: each field takes its
    newest answer by at and tie, absent ones erase nothing. Rows may come in any order, late or
    twice; the last row of a key is what the whole stream gives as a batch. Rows without a key are
    left out, null times come first.
    """
    kind = stream.schema
    held = [F.when(~is_absent(F.col(c), kind[c].dataType), F.to_json(F.struct(F.col(c).alias("v")))).alias(f"f{i}") for i, c in enumerate(columns)]
    rows = stream.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), _micros(F.col(at)).alias("at"), (F.col(tie).cast("bigint") if tie else F.lit(0)).cast("string").alias("tie"),
        F.when(F.col(deleted).isNotNull(), _micros(F.col(deleted))).alias("deleted"), *held,
    )
    shape = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "at", "deleted", *[f"f{i}" for i in range(len(columns))])])
    out = rows.groupBy("key").transformWithStateInPandas(_Records(len(columns)), shape, "Update", "None")
    fields = [F.from_json(f"f{i}", T.StructType([T.StructField("v", kind[c].dataType)]))["v"].alias(c) for i, c in enumerate(columns)]
    return out.select(F.col("key").cast(kind[key].dataType).alias(key), *fields, F.timestamp_micros(F.col("at").cast("bigint")).alias(at), F.timestamp_micros(F.col("deleted").cast("bigint")).alias(deleted))


def _micros(time: Column) -> Column:
    return F.coalesce(F.unix_micros(time.cast("timestamp")), F.lit(0)).cast("string")


# -- queue -------------------------------------------------------------------------------------------


class _Queue(StatefulProcessor):
    """A list of waiting items; the head leaves it only when it is said to be done, one way or the other."""

    def __init__(self, caps: dict[str, int], retry: int, events: bool):
        self.caps, self.retry, self.events = caps, retry, events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "item string")
        self.dropped = handle.getValueState("dropped", "n long")

    def _now(self, values) -> int:
        return values.getCurrentWatermarkInMs() if self.events else values.getCurrentProcessingTimeInMs()

    def _told(self, key: tuple, told: list[tuple[str, str]]) -> pd.DataFrame:
        n = self.dropped.get()[0] if self.dropped.exists() else 0
        return pd.DataFrame({"queue": [key[0]] * len(told), "action": [a for a, _ in told], "item": [i for _, i in told], "dropped": [n] * len(told)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        told: list[tuple[str, str]] = []
        dropped = 0
        fetched = None if not items else items[0]
        arrived = sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (int(r.place), r.item))
        for row in arrived:
            if row.kind == "offered":
                if row.item in items:
                    continue
                if len(items) >= self.caps.get(row.origin, min(self.caps.values())):
                    dropped += 1
                    told.append(("dropped", row.item))
                    continue
                items.append(row.item)
            elif items and row.item == items[0]:
                if row.kind == "unavailable":
                    # Nothing was tried, so nothing is lost: the same head once more, later.
                    self.handle.registerTimer(self._now(timerValues) + self.retry)
                    continue
                items.pop(0)  # done or failed: a download that fails must not block the others
                told.append((row.kind, row.item))
                fetched = None
            if items and fetched != items[0]:
                fetched = items[0]
                told.append(("fetch", fetched))
        self.waiting.put([(i,) for i in items]) if items else self.waiting.clear()
        if dropped:
            before = self.dropped.get()[0] if self.dropped.exists() else 0
            self.dropped.update((before + dropped,))
        if told:
            yield self._told(key, told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            yield self._told(key, [("fetch", next(iter(self.waiting.get()))[0])])

    def close(self) -> None:
        pass


def media_queue(stream: DataFrame, caps: dict[str, int] | None = None, retry_ms: int = RETRY_MS, event_time: str | None = None) -> DataFrame:
    """(queue, action, item, dropped): what is to be done after each batch of messages (queue, kind, item, origin, place).

    kind offered puts an item at the end, if the queue is shorter than the cap of its origin; else it
    is dropped and counted. The head is asked for (fetch) and leaves with done or failed, so an item
    whose answer is lost is asked for again by whoever reads the queue after a restart: at least
    once. unavailable asks for the head again after retry_ms, by the clock or, with event_time (a
    column with a watermark), by the watermark. Messages are taken by place, items that wait already
    are not added twice, answers for another item than the head are ignored.
    """
    clock = [F.col(event_time)] if event_time else []
    rows = stream.where(F.col("queue").isNotNull() & F.col("item").isNotNull()).select(
        F.col("queue").cast("string").alias("queue"), "kind", F.col("item").cast("string").alias("item"), "origin", F.coalesce(F.col("place").cast("bigint"), F.lit(0)).cast("string").alias("place"), *clock
    )
    shape = "queue string, action string, item string, dropped long"
    processor = _Queue(dict(CAPS if caps is None else caps), retry_ms, event_time is not None)
    return rows.groupBy("queue").transformWithStateInPandas(processor, shape, "Append", "EventTime" if event_time else "ProcessingTime")


# -- gauges ------------------------------------------------------------------------------------------


def session_gauges(rows: DataFrame, gap: str = "30 minutes", late: str | None = None, at: str = "at", key: str = "key") -> DataFrame:
    """(key, begin, end, gauge, failed, updates) of each session: rows of a key less than gap apart.

    Within a session the gauge is the greatest value and failed stays once it is true; a new session
    begins anew. Rows need value and failed. Over a stream, late is the watermark's delay: a session
    is given once, when no row that is less late can join it, and rows that come later than that
    are left out. Over a table all sessions are given. Rows without key or time are left out.
    """
    known = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    known = known.withWatermark(at, late) if late is not None else known
    return known.groupBy(F.session_window(at, gap).alias("w"), F.col(key).alias("key")).agg(
        F.max("value").alias("gauge"), F.bool_or(F.coalesce("failed", F.lit(False))).alias("failed"), F.count("*").alias("updates")
    ).select("key", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "gauge", "failed", "updates")
