"""Streaming ingestion: keyed merges batch by batch, a bounded queue and a resumable import."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import merge
from quillspark.operators.timeline import with_positions


class SnapshotTable:
    """A table as Parquet parts by hashed key, each with a chain of versions, and a pointer to the newest ones.

    A batch writes new versions of the buckets that it touches and then moves the pointer; the
    pointer holds the batch number, so a batch that is repeated after a failure is not applied
    twice. Buckets that a batch does not touch are neither read nor written. Old versions stay until
    vacuum(). Keys are hashed with xxhash64 over `buckets`, a number that cannot change later.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = (), buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets if keys else 1
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._fs_path(self.path))

    def _pointer(self) -> dict:
        # Between deleting the old pointer and renaming the new one only the latter is there.
        for name in ("current.json", "next.json"):
            if self._fs.exists(self._fs_path(f"{self.path}/{name}")):
                return json.loads(self.spark.read.text(f"{self.path}/{name}").first()[0])
        return {"parts": {}, "batch": -1}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The newest rows, of some buckets or all."""
        parts = self._pointer()["parts"]
        paths = [f"{self.path}/{v}/bucket={b}" for b, v in parts.items() if buckets is None or int(b) in buckets]
        paths = [p for p in paths if self._fs.exists(self._fs_path(p))]  # a version whose bucket has become empty has no files
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, batch: int, buckets: Sequence[int] | None = None) -> bool:
        """Make rows the newest version of these buckets (all, without); False if the batch was applied already."""
        now = self._pointer()
        if batch <= now["batch"]:
            return False
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*self.schema.names, self.bucket().alias("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        parts = now["parts"] | {str(b): version for b in (range(self.buckets) if buckets is None else buckets)}
        out = self._fs.create(self._fs_path(f"{self.path}/next.json"), True)
        out.write(json.dumps({"parts": parts, "batch": batch}).encode())
        out.close()
        self._fs.delete(self._fs_path(f"{self.path}/current.json"), False)
        self._fs.rename(self._fs_path(f"{self.path}/next.json"), self._fs_path(f"{self.path}/current.json"))
        return True

    def vacuum(self) -> None:
        """Delete all versions that no bucket points to."""
        used = set(self._pointer()["parts"].values())
        for status in self._fs.listStatus(self._fs_path(self.path)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in used:
                self._fs.delete(status.getPath(), True)


def upsert_stream(stream: DataFrame, table: SnapshotTable, apply: Callable[[DataFrame, DataFrame], DataFrame], keys: Sequence[str], order: str, checkpoint: str, ties: Sequence[str] = ()):
    """A writer that merges each micro-batch into the table: apply(stored, newest row of each key).

    ties order rows of equal times, the greatest last; rows that are equal in these too are ordered
    by a hash of the whole row, so a repeated batch gives the same. Only buckets that hold a key of
    the batch are read and written anew, if the table has keys.
    """

    def each(batch: DataFrame, number: int) -> None:
        fresh = merge.newest(batch, keys, [*[F.col(c).desc_nulls_last() for c in (order, *ties)], F.xxhash64(*batch.columns)])
        # At most as many numbers as there are buckets.
        touched = [r[0] for r in fresh.select(table.bucket()).distinct().collect()]
        table.replace(apply(table.read(touched), fresh), number, touched)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def responses_to_posts(stream: DataFrame) -> DataFrame:
    """Rows (operation, status, body) of a live source as posts; refused responses and bodies without id go."""
    body = stream.where((F.col("status") >= 200) & (F.col("status") < 300) & F.get_json_object("body", "$.errors[0]").isNull())
    post_id = F.coalesce(F.get_json_object("body", "$.data.result.rest_id"), F.get_json_object("body", "$.data.result.legacy.id_str"))
    return body.select(
        F.when(post_id.rlike("^[0-9]{1,25}$"), post_id).alias("id"), F.get_json_object("body", "$.data.result.legacy.full_text").alias("text"),
        F.get_json_object("body", "$.data.result.legacy.favorite_count").try_cast("bigint").alias("likes"), F.col("seen_at").alias("captured_at"),
    ).where("id is not null")


def enqueue(queue: DataFrame, fresh: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(queue, dropped) after fresh(id, place) joined a queue(id, place): each id once, `most` in order of place."""
    last = queue.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("last"))
    added = fresh.join(queue.select("id"), "id", "left_anti").groupBy("id").agg(F.min("place").alias("place"))
    moved = added.join(F.broadcast(last)).select("id", (F.col("place") + F.col("last") + 1).alias("place"))
    ranked = with_positions(queue.select("id", "place").unionByName(moved), [F.col("place").asc(), F.col("id").asc()])
    return ranked.where(F.col("position") < most).drop("position"), ranked.where(F.col("position") >= most).drop("position")


class ImportJob:
    """A resumable import over listed snapshots, newest first, a bounded number at a time.

    The cursor and counters are saved after every batch, so a job that is killed goes on at the
    batch it was in; merges are idempotent, so a repeated batch changes nothing.
    """

    FIELDS = ("v", "mode", "batch", "cursor", "fetched", "imported", "enriched", "skipped", "failed", "consecutive_failures", "reason")

    def __init__(self, path: str, mode: str = "gaps", batch: int = 100):
        self.path = path
        self.state = {"v": 1, "mode": mode, "batch": batch, "cursor": 0, "fetched": 0, "imported": 0, "enriched": 0, "skipped": 0, "failed": 0, "consecutive_failures": 0, "reason": None}
        for name in (path, path + ".new"):  # between deleting the old state and renaming the new one only the latter is there
            stored = self._load(name)
            if self.valid(stored):
                self.state = stored
                break

    @classmethod
    def valid(cls, state: object) -> bool:
        """Whether a stored state can be gone on with."""
        return (
            isinstance(state, dict) and set(cls.FIELDS) <= set(state) and state["v"] == 1 and state["mode"] in ("gaps", "verify")
            and all(isinstance(state[k], int) and state[k] >= 0 for k in cls.FIELDS[2:10])
        )

    def _files(self):
        """The store that holds the state, any that Spark reaches: a driver that comes up elsewhere goes on with it."""
        spark = SparkSession.getActiveSession()
        at = spark._jvm.org.apache.hadoop.fs.Path
        return spark, at, at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _load(self, name: str) -> object:
        spark, at, files = self._files()
        if not files.exists(at(name)):
            return None
        try:
            return json.loads(spark.read.text(name, wholetext=True).first()[0])
        except (TypeError, ValueError):
            return None

    def save(self) -> None:
        _, at, files = self._files()
        new = at(self.path + ".new")
        out = files.create(new, True)
        out.write(json.dumps(self.state).encode())
        out.close()
        files.delete(at(self.path), False)
        files.rename(new, at(self.path))

    def run(self, snapshots: DataFrame, stored: Callable[[], DataFrame], fetch: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], None], stop: int = 5,
            most: int | None = None, blocked: Callable[[], str | None] = lambda: None, cancelled: Callable[[], bool] = lambda: False) -> str:
        """Work through snapshots(position, id); fetch(batch) gives (id, record, error) and store(rows) keeps records.

        In mode gaps, stored ids are skipped without being fetched. Stops at the end (done), after
        `stop` failures in a row (archive-down), once `most` were fetched in this call (batch), when
        blocked() gives a reason (blocked) or cancelled() is true (cancelled); both are asked before
        each batch. What was done is saved, and the next call goes on there.
        """

        def ended(reason: str) -> str:
            self.state["reason"] = reason
            self.save()
            return reason

        before = self.state["fetched"]
        total = snapshots.agg(F.max("position")).first()[0]
        while total is not None and self.state["cursor"] <= total:
            if cancelled():
                return ended("cancelled")
            if blocked() is not None:
                return ended("blocked")
            if most is not None and self.state["fetched"] - before >= most:
                return ended("batch")
            low = self.state["cursor"]
            part = snapshots.where((F.col("position") >= low) & (F.col("position") < low + self.state["batch"]))
            known = part.join(stored().select("id"), "id", "left_semi").count()
            wanted = part.join(stored().select("id"), "id", "left_anti") if self.state["mode"] == "gaps" else part
            fetched = fetch(wanted).persist()
            errors = [r[0] for r in wanted.join(fetched, "id", "left").orderBy("position").select(F.col("error").isNotNull()).collect()]
            store(fetched.where("error is null"))
            good = errors.count(False)
            self.state["fetched"] += len(errors)
            self.state["failed"] += len(errors) - good
            self.state["skipped" if self.state["mode"] == "gaps" else "enriched"] += known
            self.state["imported"] += good if self.state["mode"] == "gaps" else max(0, good - known)
            for failed in errors:
                self.state["consecutive_failures"] = self.state["consecutive_failures"] + 1 if failed else 0
                if self.state["consecutive_failures"] >= stop:
                    fetched.unpersist()
                    return ended("archive-down")
            self.state["cursor"] = low + self.state["batch"]
            fetched.unpersist()
            self.save()
        return ended("done")
