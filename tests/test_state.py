"""Stateful streams: any order of arrival gives the batch result, killed streams go on."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import merge
from quillspark.plans import views
from quillspark.streaming import state

KIND = "id long, value double, k long, captured_at timestamp, deleted_at timestamp, event_id long"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass"), spark.conf.get("spark.sql.shuffle.partitions")
    state.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before[0])
    spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_records_in_any_order_are_those_of_the_batch(spark, sf_dir, tmp_path):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    captures = views.captures(read).where("id % 3 = 0").select("id", "value", "k", F.col("captured_at").cast("timestamp"), F.lit(None).cast("timestamp").alias("deleted_at"), "event_id")
    gone = views.deletions(read).where("id % 6 = 0").select("id", F.lit(None).cast("double"), F.lit(None).cast("long"), F.lit(None).cast("timestamp"), F.col("deleted_at").cast("timestamp"), F.lit(0).cast("long"))
    only_gone = spark.createDataFrame([(-1, None, None, None, datetime(2020, 1, 1), 0)], KIND)
    rows = captures.union(gone).union(only_gone).collect()
    answers = merge.newest_answers(captures, ["id"], "captured_at", ["value", "k"], ties=["event_id"])
    expected = sorted(tuple(r) for r in answers.join(merge.first_deletions(gone.toDF(*captures.columns).select("id", "deleted_at")), "id", "left").select("id", "value", "k", "captured_at", "deleted_at").collect())
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        source = tmp_path / f"in{seed}"
        for i in range(4):  # the second batch comes again as the last
            part = rows[[0, 1, 2, 1][i]::3]
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(source))
        out = {}

        def keep(batch, number, out=out):
            out.update({r["id"]: tuple(r) for r in batch.collect()})

        stream = state.keyed_records(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(source)), ["value", "k"], tie="event_id")
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"c{seed}")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(out.values()) == expected


def simulated(batches, caps):
    """Actions of one queue, message by message."""
    items, out, dropped, fetched = [], [], 0, None
    for batch in batches:
        for kind, item, origin, _ in sorted(batch, key=lambda m: (m[3], m[1])):
            if kind == "offered":
                if item in items:
                    continue
                if len(items) >= caps[origin]:
                    dropped += 1
                    out.append(("dropped", item))
                    continue
                items.append(item)
            elif items and item == items[0]:
                items.pop(0)
                out.append((kind, item))
                fetched = None
            if items and fetched != items[0]:
                fetched = items[0]
                out.append(("fetch", fetched))
    return out, dropped


def test_queue_is_bounded_and_survives_a_stop(spark, tmp_path):
    caps = {"capture": 3, "import": 5}
    rng, place, batches = random.Random(4), 0, []
    for b in range(4):
        batch = []
        for _ in range(6):
            place += 1
            batch.append(("offered", f"i{place}", rng.choice(list(caps)), place))
        for item in [f"i{i}" for i in range(1, place, 2)][b : b + 5]:
            place += 1
            batch.append((rng.choice(["done", "failed"]), item, None, place))
        batches.append(batch)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        rows = spark.readStream.schema("queue string, kind string, item string, origin string, place long, at timestamp").json(str(source)).withWatermark("at", "1 hour")
        query = state.media_queue(rows, caps, event_time="at").writeStream.outputMode("append").format("json").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()

    for b, batch in enumerate(batches):  # the stream ends after each batch and goes on from its checkpoint
        (source / f"{b}.json").write_text("\n".join(json.dumps({"queue": "q", "kind": k, "item": i, "origin": o, "place": p, "at": "2024-01-01"}) for k, i, o, p in batch))
        run()
    expected, dropped = simulated(batches, caps)
    got = spark.read.json(out)
    assert sorted((r["action"], r["item"]) for r in got.collect()) == sorted(expected)
    assert got.agg(F.max("dropped")).first()[0] == dropped > 0


def test_head_is_asked_for_again_after_a_while(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    kind = "queue string, kind string, item string, origin string, place long, at timestamp"
    out = []

    def run():
        rows = spark.readStream.schema(kind).json(str(source)).withWatermark("at", "0 seconds")
        query = state.media_queue(rows, {"capture": 9}, 15_000, "at").writeStream.outputMode("append").foreachBatch(
            lambda df, n: out.extend((r["queue"], r["action"], r["item"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()

    say = lambda n, *rows: (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(kind.replace(" string", "").replace(" long", "").replace(" timestamp", "").split(", "), r, strict=True))) for r in rows))
    start = datetime(2024, 1, 1)
    at = lambda s: (start + timedelta(seconds=s)).isoformat()
    say(0, ("q", "offered", "a", "capture", 0, at(0)), ("q", "offered", "b", "capture", 1, at(0)))
    run()
    say(1, ("q", "unavailable", "a", None, 2, at(1)))
    run()
    assert out == [("q", "fetch", "a")]
    say(2, ("other", "offered", "x", "capture", 0, at(60)))  # time goes on
    run()
    say(3, ("other", "done", "x", None, 1, at(120)))
    run()
    assert [o for o in out if o[0] == "q"] == [("q", "fetch", "a"), ("q", "fetch", "a")]


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng, start = random.Random(6), datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), start + timedelta(minutes=rng.randrange(0, 2000)), rng.random(), rng.random() < 0.1) for _ in range(60)]
    kind = "key string, at timestamp, value double, failed boolean"
    source = tmp_path / "in"
    for i in range(3):
        part = sorted(rows, key=lambda r: r[1])[20 * i:20 * i + 20]
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(source))
    spark.createDataFrame([("z", start + timedelta(days=9), 0.0, None), (None, start, 1.0, None)], kind).coalesce(1).write.mode("append").parquet(str(source))
    late = spark.createDataFrame([("a", start - timedelta(days=5), 5.0, True), ("z", start + timedelta(days=19), 0.0, None)], kind)
    expected = sorted(tuple(r) for r in state.session_gauges(spark.createDataFrame(rows, kind)).collect())
    out = []

    def run():
        stream = state.session_gauges(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source)), late="10 minutes")
        query = stream.writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()

    run()
    late.coalesce(1).write.mode("append").parquet(str(source))  # a row that is too late is left out
    run()
    assert sorted(r for r in out if r[0] != "z") == expected
