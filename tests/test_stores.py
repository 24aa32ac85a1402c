"""Accounts, batches, chains of edits, links, traffic, stores that change together and sets of open files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import accounts, merge, relate
from quillspark.sources.opened import Opened
from quillspark.streaming import ingest, traffic
from quillspark.streaming.stores import Stores


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_own_authors_against_lists(spark):
    """The newest of what is stored and what is new, as a list that is cut from its end."""
    stored = [("g", str(i), i) for i in range(5)] + [("g", "0", 9), ("h", "1", 1), ("h", None, 2)]
    fresh = [("g", v, i) for i, v in enumerate(["3", "7", "8", "7"])] + [("k", "1", 1)]
    expected = set()
    for group in "ghk":
        own = []
        for part in (stored, fresh):
            for g, v, _ in sorted((r for r in part if r[0] == group and r[1] is not None), key=lambda r: r[2]):
                if v not in own:
                    own.append(v)
        expected |= {(group, v, n) for n, v in enumerate(own[-4:])}
    schema = "g string, v string, p int"
    got = accounts.remember(spark.createDataFrame(stored, schema), spark.createDataFrame(fresh, schema), "g", "v", "p", 4)
    assert set(map(tuple, got.collect())) == expected
    assert rows_of(accounts.forget(got, spark.createDataFrame([("7",), ("none",)], "v string"), ["v"])) == sorted((r for r in expected if r[1] != "7"), key=repr)
    empty = spark.createDataFrame([], schema)
    assert accounts.remember(empty, empty, "g", "v", "p").count() == 0


def test_chosen_sources(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (None,)], "s int")
    kept = lambda chosen: sorted(r[0] for r in accounts.of_sources(rows, "s", chosen, 3).collect() if r[0] is not None)
    assert kept([0, "2"]) == [0, 2] and kept([1.5]) == []
    assert all(kept(void) == [0, 1, 2] for void in (None, [], [1, 3], [-1], [float("nan")], ["x"], [None], [float("inf")]))


def test_batches_of_messages(spark):
    rows = spark.createDataFrame([("a", i, "x" * i if i != 3 else None) for i in range(6)] + [("b", 1, None), (None, 1, "zz")], "b string, i int, t string")
    got = {r["b"]: r.asDict() for r in accounts.batches(rows, ["b"], [F.col("i")], F.col("t").isNotNull(), F.length("t"), 5, 9).collect()}
    assert (got["a"]["incoming"], got["a"]["taken"], got["a"]["dropped"], got["a"]["over"], got["a"]["chars"], got["a"]["refusal"]) == (6, 4, 2, 1, 2 + 0 + 1 + 2 + 4 + 3, "size")
    assert (got["b"]["taken"], got["b"]["chars"], got["b"]["refusal"]) == (0, 2, "empty")
    assert (got[None]["taken"], got[None]["chars"], got[None]["refusal"]) == (1, 4, None)


def test_failures_are_placed_and_counted(spark):
    rows = spark.createDataFrame([(i, "{" if i % 3 == 0 else "{}") for i in range(100)] + [(100, None)], "i int, r string")
    got = rows_of(accounts.failures(rows, ["i"], F.try_parse_json("r").isNull(), 5))
    assert got == [(i, i, 35) for i in (0, 12, 3, 6, 9)]
    assert accounts.failures(rows.where("r = '{}'"), ["i"], F.try_parse_json("r").isNull()).count() == 0


def test_summary_without_files(spark):
    posts = spark.createDataFrame([(1, None, None, "2"), (2, None, "1", None)], "id int, created_at timestamp, reply_to_id string, retweeted_id string")
    files = spark.createDataFrame([], "id int, bytes long")
    assert tuple(accounts.summary(posts, files).first()) == (2, 0, 0, None, 1, 1, None, None)
    assert tuple(accounts.summary(posts, spark.createDataFrame([(1, None), (1, 5), (9, 7)], "id int, bytes long")).first())[:4] == (2, 1, 2, 5)


def test_edit_chains_against_walks(spark):
    edges = {"a": None, "x": "y", "y": "x", "z": "y", "q": "gone", "s": "s"} | {f"n{i}": f"n{i - 1}" if i else "a" for i in range(37)} | {f"m{i}": f"m{i - 1}" if i else "n20" for i in range(9)}

    def walk(i):
        seen = [i]
        while edges.get(seen[-1]) is not None:
            if edges[seen[-1]] in seen:
                return None
            seen.append(edges[seen[-1]])
        return seen

    walks = {i: walk(i) for i in edges}
    longest = {}
    for w in filter(None, walks.values()):
        longest[w[-1]] = max(longest.get(w[-1], 0), len(w))
    expected = {i: (w and w[-1], w and len(w), w and longest[w[-1]], i in edges.values()) for i, w in walks.items()}
    posts = spark.createDataFrame([*edges.items(), ("a", None), (None, "a")], "id string, edited_from string")
    assert {r["id"]: tuple(r)[1:] for r in relate.edit_chains(posts).collect()} == expected
    assert relate.edit_chains(posts.where("id = '-'")).count() == 0
    twice = spark.createDataFrame([("b", "z", 1), ("b", "a", 2)], "id string, edited_from string, n int")
    assert relate.edit_chains(twice, order="n").first()["initial_id"] == "a"


def test_media_by_an_index(spark):
    entries = spark.createDataFrame([("p", 0, "gone"), ("p", 1, "f"), ("p", 2, "g"), ("q", 0, None)], "key string, n int, name string")
    files = spark.createDataFrame([("f",), ("g",), ("f",), (None,)], "name string")
    joined, counts = relate.indexed_media(spark.createDataFrame([("p",), ("q",)], "key string"), entries, files, ["key"], [F.col("n").asc()])
    assert {r["key"]: r["name"] for r in joined.collect()} == {"p": "f", "q": None}
    assert tuple(counts.first()) == (4, 2, 2)


def test_links_are_filled_in_gaps_only(spark):
    stored = [("1", None), ("2", "null"), ("3", "[]"), ("4", '{"urls":[],"x":1.5,"mentions":"m"}'), ("5", '{"urls":["a"]}'), ("6", '"t"'), ("7", '{"urls":{}}'), ("8", "{bad"), ("9", '{"q\\"":null}'), ("10", "{}"), ("11", "{}")]
    fresh = [(str(i), '["u/é"]') for i in range(1, 10)] + [("99", '["u"]'), ("10", "[]"), ("11", None)]
    got = {r["id"]: (r["entities"], r["filled"]) for r in merge.fill_links(spark.createDataFrame(stored, "id string, entities string"), spark.createDataFrame(fresh, "id string, urls string")).collect()}
    for i, text in stored:
        now, filled = got[i]
        old = None if text is None or i == "8" else json.loads(text)
        gap = i not in ("8", "10", "11") and (old is None or isinstance(old, dict) and not (isinstance(old.get("urls"), list) and old["urls"]))
        assert filled == gap
        assert json.loads(now) == {"hashtags": [], "mentions": []} | (old or {}) | {"urls": ["u/é"]} if gap else now == text
    assert len(got) == len(stored)


def test_archives_folded_with_rows_without_id(spark):
    copies = spark.createDataFrame([("1", 1, 5, "a"), ("1", 2, 3, "b"), ("1", 4, 9, ""), ("", 3, 1, "c"), ("", 6, 1, "c"), (None, 7, 1, "d"), ("2", 5, None, None)], "id string, place int, t int, x string")
    got = merge.fold_archives(copies, "id", ["place"], "t", ["x"])
    assert rows_of(got.select("id", "place", "t", "x")) == sorted([("1", 1, 9, "a"), ("2", 5, None, None), ("", 3, 1, "c"), ("", 6, 1, "c"), (None, 7, 1, "d")], key=repr)


def test_deletions_and_files_are_stored_once(spark):
    stored = spark.createDataFrame([("1", "2020", "a"), ("2", "", "b"), ("3", None, "c")], "id string, deleted_at string, by string")
    fresh = spark.createDataFrame([("1", "2021"), ("2", "2022"), ("2", "2021"), ("4", "2023"), ("5", ""), (None, "2020")], "id string, deleted_at string")
    assert rows_of(merge.record_deletions(stored, fresh)) == sorted([("1", "2020", "a"), ("2", "2021", None), ("3", None, "c"), ("4", "2023", None)], key=repr)
    files = spark.createDataFrame([("k", "old"), ("l", "old")], "key string, blob string")
    new = spark.createDataFrame([("k", "new"), ("m", "new")], "key string, blob string")
    assert rows_of(merge.put(files, new, ["key"])) == [("k", "new"), ("l", "old"), ("m", "new")]
    assert rows_of(merge.put(files, new, ["key"], skip_known=True)) == [("k", "old"), ("l", "old"), ("m", "new")]


TRAFFIC = "n int, url string, method string, status int, body string"


def traffic_rows():
    api = "https://api.x.com/i/api/graphql/q1/"
    made = {"data": {"create_tweet": {"tweet_results": {"result": {"rest_id": "77"}}}}}
    return [
        (0, api + "CreateTweet", "post", 200, json.dumps(made)),
        (1, api + "CreateTweet", "GET", 200, json.dumps(made)),
        (2, api + "CreateTweet", "POST", 404, json.dumps(made)),
        (3, api + "createnotetweet/more", "POST", 201, json.dumps({"data": {"notetweet_create": {"rest_id": "5", "errors": {"a": 1}}}})),
        (4, "https://notx.com/graphql/q/CreateTweet", "POST", 200, json.dumps(made)),
        (5, api + "Following?variables=" + "%7B%22userId%22%3A%2212%22%7D", "GET", 200, "{}"),
        (6, api + "followers", "GET", 299, "{}"),
        (7, api + "UserOriginalsTimeline", "GET", 200, "{}"),
        (8, api + "UserRepliesTimeline", "GET", 200, "{}"),
        (9, api + "DeleteTweet", "POST", 200, "{}"),
        (10, "https://x.com/graphql/q", "POST", 200, "{}"),
        (11, "ftp://x.com/graphql/q/CreateTweet", "POST", 200, "{}"),
        (12, None, "POST", 200, "{}"), (13, api + "CreateTweet", None, 200, "{}"), (14, api + "CreateTweet", "POST", None, "{}"),
        (15, api + "CreateTweet", "POST", 200, "[]"), (16, api + "CreateTweet", "POST", 200, None), (17, api + "CreateTweet", "POST", 200, '{"data":'),
        (18, api + "CreateTweet", "POST", 200, '{"data":{}}'), (19, api + "CreateTweet", "POST", 200, '{"errors":["e"]}'),
        (20, api + "CreateTweet", "POST", 200, json.dumps(made | {"errors": [{"message": "m" * 300}, {}]})), (21, api + "UserByRestId", "GET", 200, "{}"), (22, api + "TweetResultByRestId", "GET", 200, "{}"),
        (23, api + "CreateTweet", "POST", 200, '{"errors":{},"data":{"tweet_result":{"result":{"legacy":{"id_str":"8"}}}}}'),
    ]


def test_traffic_is_selected_and_refused(spark):
    rows = spark.createDataFrame(traffic_rows(), TRAFFIC)
    kinds = {r["n"]: (r["kind"], r["list"], r["owner_id"]) for r in traffic.selected(rows).collect()}
    creates = (0, 3, 15, 16, 17, 18, 19, 20, 23)
    assert kinds == {n: ("create", None, None) for n in creates} | {7: ("timeline", None, None), 9: ("delete", None, None), 21: ("profile", None, None), 22: ("detail", None, None)}
    more = {r["n"]: (r["kind"], r["list"], r["owner_id"]) for r in traffic.selected(rows, replies=True, connections=True).collect()}
    assert more == kinds | {5: ("connections", "following", "12"), 6: ("connections", "followers", None), 8: ("replies", None, None)}
    told = {r["n"]: (r["refusal"], r["post_id"]) for r in traffic.answered(traffic.selected(rows)).collect()}
    note = "; NOTE a valid tweet result was also present"
    assert told == {
        0: (None, "77"), 3: ("graphql errors: present (unstructured)" + note, None), 15: ("response body is not an object", None), 16: ("response body is not an object", None),
        17: ("response body is not an object", None), 18: ("no tweet result candidate (data keys: (empty object))", None), 19: ("graphql errors: present (non-object entry)", None),
        20: ("graphql errors: " + "m" * 200 + note, None), 23: (None, "8"),
    }


def test_traffic_as_a_stream_equals_the_batch(spark, tmp_path):
    rows = spark.createDataFrame(traffic_rows(), TRAFFIC)
    rows.repartition(5).write.json(str(tmp_path / "in"))
    stream = traffic.answered(traffic.selected(spark.readStream.schema(TRAFFIC).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), connections=True))
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    writer.start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("n", "refusal", "post_id")
    assert rows_of(got) == rows_of(traffic.answered(traffic.selected(rows)).select("n", "refusal", "post_id"))


def test_stores_change_together(spark, tmp_path):
    kinds = {n: T.StructType([T.StructField("id", T.LongType())]) for n in ("posts", "media", "deletions", "people", "settings")}
    stores = Stores(spark, str(tmp_path / "stores"), kinds)
    assert stores.number == -1 and stores.read("posts").count() == 0
    assert stores.commit({n: spark.range(i + 1) for i, n in enumerate(kinds)})
    assert [stores.read(n).count() for n in kinds] == [1, 2, 3, 4, 5]
    held = stores.read("people")
    # A commit that fails on the way leaves all tables as they are.
    bad = spark.range(3).select((F.col("id") / 0).cast("long").alias("id")) if spark.conf.get("spark.sql.ansi.enabled") == "true" else None
    if bad is not None:
        with pytest.raises(Exception):
            stores.commit({"posts": spark.range(9), "media": bad})
        assert [stores.read(n).count() for n in kinds] == [1, 2, 3, 4, 5] and stores.number == 0
    assert stores.commit({"posts": stores.read("posts").union(spark.range(5))}, number=7) and not stores.commit({"posts": spark.range(1)}, number=7)
    assert stores.read("posts").count() == 6 and stores.number == 7
    assert not stores.clear(7) and stores.clear()
    assert [stores.read(n).count() for n in kinds] == [0] * 5 and held.count() == 4
    stores.vacuum()
    assert Stores(spark, str(tmp_path / "stores"), kinds).number == 8 and [stores.read(n).count() for n in kinds] == [0] * 5


def test_open_files_are_added_and_taken_out(spark, tmp_path):
    def envelope(name, *ids):
        path = tmp_path / name
        path.write_text(json.dumps({"tweets": [{"id": i} for i in ids]}))
        return str(path)

    a, b = envelope("a b.json", "1", "2"), envelope("b.json", "3")
    none, empty, bare = tmp_path / "none.json", tmp_path / "empty.json", envelope("bare.json")
    none.write_text('{"other":[]}')
    empty.write_text("")
    packed = tmp_path / "c.zip"
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("tweets.json", json.dumps({"tweets": [{"id": "4"}]}))
    opened = Opened(spark).add(a, str(none), str(empty))
    assert opened.sources == (a,) and [p for p, _ in opened.refused] == [str(none)] and opened.refused[0][1]
    more = opened.add(b, str(packed), bare)
    ids = lambda o: sorted((r["source"], json.loads(r["record"])["id"]) for r in o.records().where("record is not null").collect())
    assert more.sources == (a, b, str(packed), bare) and more.refused == ()
    assert ids(more) == [(0, "1"), (0, "2"), (1, "3"), (2, "4")]
    assert opened.sources == (a,) and ids(opened) == [(0, "1"), (0, "2")]
    assert ids(more.remove(0)) == [(0, "3"), (1, "4")] and more.remove(9) is more and more.remove(-1) is more
    assert more.add(str(none)).sources == more.sources and Opened(spark).records().count() == 0
    assert ids(opened.add(a)) == [(0, "1"), (0, "2"), (1, "1"), (1, "2")]


def test_an_import_goes_on_from_what_a_killed_save_left(spark, tmp_path):
    path = str(tmp_path / "state.json")
    job = ingest.ImportJob(path)
    job.state["cursor"] = 40
    job.save()
    (tmp_path / "state.json").rename(tmp_path / "state.json.new")
    assert ingest.ImportJob(path).state["cursor"] == 40
    (tmp_path / ".state.json.crc").unlink()  # of the file that was moved
    (tmp_path / "state.json").write_text("{broken")
    assert ingest.ImportJob(path).state["cursor"] == 40
