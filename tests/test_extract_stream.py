"""Extraction of nested answers, and streaming ingestion."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators.merge import upsert
from quillspark.plans import extract, nodes
from quillspark.streaming import ingest

LIVE = {
    "rest_id": "100", "core": {"user_results": {"result": {"rest_id": "7", "legacy": {"screen_name": "someone", "name": "Some One"}}}},
    "legacy": {
        "full_text": "short https://t.co/abc", "created_at": "Wed Oct 10 20:19:24 +0000 2018", "favorite_count": 3, "in_reply_to_status_id_str": "99", "favorited": True,
        "extended_entities": {"media": [{"id_str": "12", "type": "video", "url": "https://t.co/abc", "indices": [6, 22], "media_url_https": "https://e.com/t.jpg", "video_info": {"variants": [
            {"url": "u1", "bitrate": 1, "content_type": "video/mp4"}, {"url": "u2", "bitrate": 9, "content_type": "video/mp4"}, {"url": "u3", "content_type": "x"}]}}]},
        "entities": {"urls": [{"url": "a", "expanded_url": "b", "display_url": "c"}], "hashtags": [{"text": "tag"}]},
    },
    "views": {"count": "12"}, "edit_control": {"edit_control_initial": {"edit_tweet_ids": ["98", "100"], "initial_tweet_id": "98"}},
    "card": {"legacy": {"name": "poll2choice_text_only", "binding_values": [{"key": "choice1_label", "value": {"string_value": "yes"}}, {"key": "choice2_label", "value": {"string_value": "no"}}, {"key": "counts_are_final", "value": {"boolean_value": True}}]}},
}


def test_live_posts(spark):
    bodies = spark.createDataFrame([(json.dumps(LIVE),), ("{}",), ("nonsense",), (None,), (json.dumps(LIVE | {"__typename": "TweetTombstone"}),)], "body string")
    got = nodes.live_posts(bodies).collect()
    assert len(got) == 1
    post = got[0]
    assert (post["id"], post["text"], post["is_reply"], post["conversation_id"], post["conversation_inferred"]) == ("100", "short", True, "99", True)
    assert [v["url"] for v in post["media"][0]["variants"]] == ["u1", "u2", "u3"] and post["edit_initial_id"] == "98" and post["entities"]["hashtags"] == ["tag"] and post["poll"]["choices"] == ["yes", "no"] and post["poll"]["final"]
    assert post["metrics"]["views"] == 12 and post["is_edit"] and post["viewer_state"]["liked"] and post["author"]["screen_name"] == "someone"


def test_archived_posts(spark):
    body = {
        "data": {"id": "5", "text": "hi", "author_id": "1", "created_at": "2020-01-02T03:04:05.000Z", "attachments": {"media_keys": ["k1", "k2", "gone"]}, "in_reply_to_user_id": "2",
                 "referenced_tweets": [{"type": "replied_to", "id": "4"}, {"type": "quoted", "id": "3"}], "edit_history_tweet_ids": ["4", "6"], "public_metrics": {"like_count": 2}},
        "includes": {"users": [{"id": "1", "username": "me"}, {"id": "1", "username": "other"}, {"id": "2", "username": "you"}], "tweets": [{"id": "3", "text": "quoted"}],
                     "media": [{"media_key": "k1", "type": "photo", "url": "p"}, {"media_key": "k1", "type": "photo", "url": "last"}, {"media_key": "k2", "type": "video", "variants": [{"url": "v", "bit_rate": 1, "content_type": "video/mp4"}]}]},
    }
    post = extract.archived_posts(spark.createDataFrame([(json.dumps(body),)], "body string")).first()
    assert post["author"]["screen_name"] == "me" and post["reply_to_handle"] == "you" and post["quoted_text"] == "quoted" and post["edit_ids"] is None
    assert [m["url"] for m in post["media"]] == ["last", "v"] and post["metrics"]["likes"] == 2
    people = spark.createDataFrame([(json.dumps(body), "YOU")], "body string, handle string")
    assert extract.archived_profiles(people).first()["user_id"] == "2"


def test_requests(spark):
    url = "https://example.com/i/api/graphql/abc/Timeline?variables=%7B%22a%22%3A1%7D"
    row = extract.requests(spark.createDataFrame([(url,)], "url string")).first()
    assert (row["query_id"], row["operation"], row["variables"]) == ("abc", "Timeline", '{"a":1}')


@pytest.mark.parametrize("keys", [(), ("id",)])
def test_stream_upserts_once(spark, tmp_path, keys):
    source = tmp_path / "in"
    source.mkdir()
    kind = "id string, text string, at int"
    (source / "a.json").write_text('{"id":"1","text":"first","at":1}\n{"id":"1","text":"second","at":2}\n{"id":"2","text":"x","at":1}\n')
    schema = spark.createDataFrame([], kind).schema
    table = ingest.SnapshotTable(spark, str(tmp_path / "table"), schema, keys, 8)

    def run():
        stream = spark.readStream.schema(schema).json(str(source))
        writer = ingest.upsert_stream(stream, table, lambda old, new: upsert(old, new, ["id"]), ["id"], "at", str(tmp_path / "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    (source / "b.json").write_text('{"id":"1","text":"","at":3}\n')
    run()
    assert sorted(tuple(r) for r in table.read().collect()) == [("1", "second", 3), ("2", "x", 1)]
    assert table.replace(table.read(), 0) is False
    table.vacuum()
    assert table.read().count() == 2
    if keys:
        # A batch leaves the buckets that it does not touch as they are.
        before = table._pointer()["parts"]
        (source / "c.json").write_text('{"id":"2","text":"y","at":9}\n')
        run()
        after = table._pointer()["parts"]
        assert sum(before[b] != after[b] for b in before) == (1 if before.keys() == after.keys() else 0)
        assert sorted(tuple(r) for r in table.read().collect()) == [("1", "second", 3), ("2", "y", 9)]


def test_queue(spark):
    queue = spark.createDataFrame([("a", 0), ("b", 1)], "id string, place long")
    fresh = spark.createDataFrame([("b", 0), ("c", 1), ("d", 2), ("c", 3)], "id string, place long")
    kept, dropped = ingest.enqueue(queue, fresh, 3)
    assert [r["id"] for r in kept.orderBy("place").collect()] == ["a", "b", "c"] and [r["id"] for r in dropped.collect()] == ["d"]


def test_import_resumes_and_stops(spark, tmp_path):
    snapshots = spark.createDataFrame([(i, str(i)) for i in range(10)], "position long, id string")
    kept = {"3": "old"}
    state = str(tmp_path / "job.json")
    stored = lambda: spark.createDataFrame(list(kept.items()) or [("", "")], "id string, record string")
    calls = []

    def fetch(batch, broken=()):
        calls.append(batch.count())
        if len(calls) == 2 and not broken:
            raise RuntimeError("killed")
        return batch.select("id", F.concat(F.lit("r"), "id").alias("record"), F.when(F.col("id").isin(*broken), "no").alias("error") if broken else F.lit(None).cast("string").alias("error"))

    store = lambda rows: kept.update({r["id"]: r["record"] for r in rows.collect()})
    try:
        ingest.ImportJob(state, batch=4).run(snapshots, stored, fetch, store)
        raise AssertionError("not killed")
    except RuntimeError:
        pass
    job = ingest.ImportJob(state)
    assert job.state["cursor"] == 4 and job.state["skipped"] == 1
    assert job.run(snapshots, stored, fetch, store) == "done"
    assert sorted(kept) == sorted(map(str, range(10))) and kept["3"] == "old" and job.state["imported"] == 9
    paused = ingest.ImportJob(str(tmp_path / "paused.json"), mode="verify", batch=4)
    assert paused.run(snapshots, stored, lambda b: fetch(b, ("x",)), store, cancelled=lambda: True) == "cancelled" and paused.state["cursor"] == 0
    assert paused.run(snapshots, stored, lambda b: fetch(b, ("x",)), store, blocked=lambda: "offline") == "blocked"
    assert paused.run(snapshots, stored, lambda b: fetch(b, ("x",)), store, most=4) == "batch" and paused.state["cursor"] == 4
    assert paused.run(snapshots, stored, lambda b: fetch(b, ("x",)), store) == "done"
    failing = ingest.ImportJob(str(tmp_path / "other.json"), mode="verify", batch=10)
    assert failing.run(snapshots, stored, lambda b: fetch(b, tuple("01234567")), store) == "archive-down"


def test_results_within_a_timeline(spark):
    entry = lambda i, **more: {"content": {"itemContent": {"tweet_results": {"result": {"rest_id": str(i), **more}}}}}
    quoted = {"quoted_status_result": {"tweet_results": {"result": {"rest_id": "99"}}}}
    body = {"instructions": [{"entries": [entry(1, **quoted), {"module": [entry(2), entry(1)]}, entry(3)]}]}
    rows = spark.createDataFrame([(json.dumps(body),), ("broken",), (None,)], "body string")
    got = extract.collect_results(rows).collect()
    assert [json.loads(r["body"])["rest_id"] for r in sorted(got, key=lambda r: r["position"])] == ["1", "2", "3"]
    deep = json.dumps(entry(7))
    for _ in range(40):
        deep = '{"a":' + deep + "}"
    assert extract.results_within(deep) == []
