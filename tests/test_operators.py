"""Operators on small tables, each against what its rule says."""

import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.absence import is_absent
from quillspark.operators import merge, relate, timeline


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_keyset_pages_walk_everything_once(spark):
    data = [(datetime(2020, 1, 1 + i % 5), i) for i in range(23)]
    table = spark.createDataFrame(data, "at timestamp, id long")
    after, seen = None, []
    while True:
        page = rows(timeline.keyset_page(table, ["at", "id"], 4, after))
        seen += page
        if len(page) < 4:
            break
        after = list(page[-1])
    assert seen == sorted(data, reverse=True)


def test_positions_and_samples(spark):
    table = spark.range(100).select((F.col("id") * 37 % 101).alias("v"))
    placed = rows(timeline.with_positions(table, [F.col("v").asc()]).select("v", "position"))
    assert [v for v, _ in sorted(placed, key=lambda r: r[1])] == sorted(v for v, _ in placed)
    assert sorted(p for _, p in placed) == list(range(100))
    for count, expected in ((1, [0]), (3, [0, 49, 99]), (200, list(range(100)))):
        assert sorted(r[1] for r in rows(timeline.spread_sample(table, [F.col("v").asc()], count).select("v", "position"))) == expected
    assert rows(timeline.spread_sample(table.limit(0), [F.col("v").asc()], 3)) == []


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_of_many_wide_rows(spark, adaptive):
    """Every position once and every row kept, however partitions are merged between what is counted and what is numbered."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 400_000
        table = spark.range(n).select((F.col("id") * 7919 % 1000).alias("v"), "id", F.repeat(F.lit("x"), F.lit(60)).alias("payload"))
        placed = timeline.with_positions(table, [F.col("v").desc()]).cache()
        assert placed.agg(F.count("*"), F.count_distinct("position"), F.min("position"), F.max("position")).first() == (n, n, 0, n - 1)
        ordered = placed.select("position", "v", F.lag("v").over(Window.partitionBy(F.floor(F.col("position") / 5000)).orderBy("position")).alias("before"))
        assert ordered.where("v > before").isEmpty()
        sampled = rows(timeline.spread_sample(table, [F.col("v").asc()], 5).select("position"))
        assert sorted(sampled) == [((n - 1) * k // 4,) for k in range(5)]
        placed.unpersist()
        grouped = timeline.numbered(table.where("id < 50000"), ["v"], [F.col("id").asc()])
        assert grouped.agg(F.count("*"), F.count_distinct("v", "place"), F.max("place")).first() == (50000, 50000, 49)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_running_max(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(50)])) for i in range(500)]
    expected = {}
    seen = {}
    for g, i, v in data:
        expected[i] = seen.get(g)
        if v is not None:
            seen[g] = v if seen.get(g) is None else max(seen[g], v)
    table = spark.createDataFrame(data, "g string, i int, v int").repartition(5)
    assert dict(rows(timeline.running_max(table, ["g"], [F.col("i").asc()], "v", "m").select("i", "m"))) == expected


def test_fold_depends_on_scan_order(spark):
    copies = [("p", 0, 1, "p"), ("p", 1, 5, None), ("p", 2, 3, "q")]
    table = spark.createDataFrame(copies, "id string, place int, at int, v string")
    assert rows(merge.fold_copies(table, ["id"], ["place"], "at", ["v"])) == [("p", 5, "p")]
    assert rows(merge.newest_answers(table, ["id"], "at", ["v"])) == [("p", "q", 5)]


def test_fold_equals_pairwise_merging(spark):
    rng, data = random.Random(3), []
    for key in range(40):
        data += [(key, i, rng.randrange(5), rng.choice([None, "", "a", "b"]), rng.choice([None, 0, 1])) for i in range(rng.randrange(1, 5))]
    table = spark.createDataFrame(data, "id int, place int, at int, s string, n int")
    expected = {}
    for key, _, at, s, n in data:
        if key not in expected:
            expected[key] = (at, s, n)
            continue
        o = expected[key]
        old, new = ((at, s, n), o) if at < o[0] else (o, (at, s, n))
        pick = lambda a, b: a if b in (None, "") and not (a is None) else (b if b not in (None, "") or a is None else a)
        expected[key] = (max(o[0], at), pick(old[1], new[1]), pick(old[2], new[2]))
    got = {r[0]: (r[1], r[2], r[3]) for r in rows(merge.fold_copies(table, ["id"], ["place"], "at", ["s", "n"]))}
    assert got == expected


def test_upsert_posts(spark):
    kind = "id string, text string, reply_to_id string, is_reply boolean, conversation_id string, conversation_inferred boolean, first_captured_at int, captured_at int, updated_at int"
    stored = spark.createDataFrame([("1", "old", "9", False, "c", False, 1, 1, 1), ("2", "kept", None, False, None, None, 2, 2, 2)], kind)
    fresh = spark.createDataFrame([("1", "", None, False, "guess", True, 7, 7, 7), ("3", "new", None, False, "g", True, 7, 7, 7)], kind)
    got = {r["id"]: r for r in merge.upsert_posts(stored, fresh).collect()}
    assert set(got) == {"1", "2", "3"}
    one = got["1"]
    assert (one["text"], one["is_reply"], one["conversation_id"], one["conversation_inferred"]) == ("old", True, "c", False)
    assert (one["first_captured_at"], one["captured_at"], one["updated_at"]) == (1, 1, 7)


def test_flags_follow_merged_content(spark):
    kind = "id string, reply_to_id string, is_reply boolean, poll struct<is_poll:boolean,choices:array<string>>, is_poll boolean, edited_from string, is_edit boolean"
    stored = spark.createDataFrame([("1", "9", True, (True, ["x"]), True, None, False), ("2", None, True, (False, []), True, None, True)], kind)
    fresh = spark.createDataFrame([("1", None, False, None, False, "0", False), ("2", None, True, None, True, None, False), ("3", None, True, None, True, None, True)], kind)
    got = {r["id"]: (r["is_reply"], r["is_poll"], r["is_edit"]) for r in merge.upsert_posts(stored, fresh).collect()}
    assert got == {"1": (True, True, True), "2": (False, False, False), "3": (True, True, True)}


def test_protected_merge_modes(spark):
    kind = "id string, text string, metrics struct<likes:int>, source struct<captured_via:string,backfilled:boolean,name:string>, captured_at int, updated_at int"
    stored = spark.createDataFrame([("1", "now", (7,), ("xhr", True, "op"), 1, 1)], kind)
    fresh = spark.createDataFrame([("1", "then", (3,), ("y", True, "z"), 9, 9), ("2", "x", (1,), ("y", True, "z"), 9, 9)], kind)
    got = {r["id"]: r for r in merge.protected(stored, fresh, "intended").collect()}
    assert (got["1"]["text"], got["1"]["metrics"], tuple(got["1"]["source"]), got["1"]["captured_at"]) == ("then", (7,), ("xhr", True, "op"), 1)
    assert got["2"]["metrics"] is None and got["2"]["source"] is None
    got = {r["id"]: r for r in merge.protected(stored, fresh).collect()}
    assert tuple(got["1"]["source"]) == ("fetch", False, "op") and got["1"]["metrics"] == (7,)
    with pytest.raises(ValueError):
        merge.protected(stored, fresh, "other")


def test_archives_merge_in_two_modes(spark):
    copies = spark.createDataFrame([("1", 5, 0, "a", None), ("1", 9, 1, None, None), ("1", 3, 2, "old", None), ("2", 4, 0, "b", "1")], "id string, captured_at int, place int, text string, edited_from string")
    gone = spark.createDataFrame([("2", "2020")], "id string, deleted_at string")
    reader = {r["id"]: (r["captured_at"], r["text"]) for r in merge.merge_archives(copies, gone, ["place"], ["text", "edited_from"]).collect()}
    assert reader == {"1": (9, "a"), "2": (4, "b")}
    documented = {r["id"]: (r["captured_at"], r["text"], r["superseded_by"], r["deleted_at"]) for r in merge.merge_archives(copies, gone, ["place"], ["text", "edited_from"], "documented").collect()}
    assert documented == {"1": (3, "a", "2", None), "2": (4, "b", None, "2020")}


def test_deletion_marks_keep_their_type(spark):
    posts = spark.createDataFrame([("1",), ("2",)], "id string")
    texts = merge.mark_deleted(posts, spark.createDataFrame([("1", "no time"), ("2", "2020-01-01")], "id string, deleted_at string"))
    assert sorted(rows(texts)) == [("1", "no time"), ("2", "2020-01-01")]
    times = merge.mark_deleted(posts, spark.createDataFrame([("1", datetime(2020, 1, 1))], "id string, deleted_at timestamp"))
    assert sorted(rows(times)) == [("1", datetime(2020, 1, 1)), ("2", None)]


def test_posts_are_merged_by_one_join(spark):
    kind = "id string, text string, reply_to_id string, is_reply boolean, conversation_id string, conversation_inferred boolean, first_captured_at int, captured_at int, updated_at int"
    stored, fresh = (spark.createDataFrame([], kind) for _ in range(2))
    plan = merge.upsert_posts(stored.hint("merge"), fresh)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("Join") == 1


def test_last_of_repeated_ids_is_the_parent(spark):
    edges = spark.createDataFrame([(2, 9, 0), (2, 1, 1), (3, 2, 2), (4, 7, 3), (4, None, 4)], "id long, parent long, place int")
    starts = spark.createDataFrame([(3,), (4,)], "start long")
    assert sorted(rows(relate.ancestors(edges, starts, order="place"))) == [(3, 1, 2), (3, 2, 1)]


def test_marks_stay_and_ties_are_settled(spark):
    posts = spark.createDataFrame([(1, None, 5, 9), (2, None, 5, None), (3, 2, 8, None), (4, 2, 7, None)], "id int, edited_from int, updated_at int, superseded_by int")
    got = {r["id"]: (r["superseded_by"], r["updated_at"]) for r in merge.mark_superseded(posts).collect()}
    assert got == {1: (9, 5), 2: (3, 8), 3: (None, 8), 4: (None, 7)}
    copies = spark.createDataFrame([(1, 5, 2, "b"), (1, 5, 1, "c"), (1, 5, 2, "a"), (1, 4, 9, "z")], "id int, at int, scan int, v string")
    assert rows(merge.newest_answers(copies, ["id"], "at", ["v"], ties=["scan"])) == [(1, "b", 5)]
    gone = spark.createDataFrame([(1, "2020", 0), (1, "2019", 1), (2, "", 0), (2, "2018", 1)], "id int, deleted_at string, arrival int")
    assert sorted(rows(merge.first_deletions(gone, "arrival"))) == [(1, "2020"), (2, "2018")]
    assert rows(spark.createDataFrame([({},)], "m map<string,int>").select(is_absent(F.col("m"), T.MapType(T.StringType(), T.IntegerType())))) == [(False,)]


def test_people_keep_what_is_absent(spark):
    kind = "id int, bio string, followers int, first int, last int, owners array<string>"
    stored = spark.createDataFrame([(1, "bio", 5, 1, 1, ["a"])], kind)
    fresh = spark.createDataFrame([(1, "", 0, 9, 9, ["b", "a"]), (2, None, None, 9, 9, [])], kind)
    got = sorted(rows(merge.merge_people(stored, fresh, ["id"], "first", "last", "owners")))
    assert got == [(1, "bio", 0, 1, 9, ["a", "b"]), (2, None, None, 9, 9, [])]


def test_backfill_gaps_and_deletion(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "")], "id int, v string")
    fresh = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string")
    assert sorted(rows(merge.insert_if_absent(stored, fresh, ["id"]))) == [(1, "a"), (2, ""), (3, "z")]
    assert sorted(rows(merge.fill_gaps(stored, fresh, ["id"], ["v"]))) == [(1, "a"), (2, "y")]
    gone = spark.createDataFrame([(1, "2020"), (1, "2019"), (7, "2018")], "id int, deleted_at string")
    marked = merge.mark_deleted(stored.withColumn("deleted_at", F.lit(None).cast("string")), gone)
    assert sorted(rows(marked.select("id", "deleted_at")), key=str) == [(1, "2019"), (2, None)]
    assert rows(merge.purge(marked, "deleted").select("id")) == [(2,)]
    assert merge.purge(marked, "nothing").count() == 2
    posts, media, left = merge.delete_cascade(stored, spark.createDataFrame([(1, "m")], "post_id int, m string"), gone, stored.where("id = 1"))
    assert (posts.count(), media.count(), left.count()) == (1, 0, 1)


def test_graph(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (11, 12), (12, 11)], "id long, parent long")
    starts = spark.createDataFrame([(4,), (11,), (1,)], "start long")
    assert sorted(rows(relate.ancestors(edges, starts))) == [(4, 1, 3), (4, 2, 2), (4, 3, 1), (11, 12, 1)]
    assert sorted(rows(relate.ancestors(edges, starts, most=2))) == [(4, 2, 2), (4, 3, 1), (11, 12, 1)]
    assert rows(relate.missing_parents(edges.where("id = 4"))) == [(4, 3)]


def test_shards_and_budgets(spark):
    one = spark.range(1)
    sizes = F.array(*[F.lit(x).cast("bigint") for x in (4, 4, 4, 20, 1)])
    assert one.select(relate.greedy_shards(sizes, 10)).first()[0] == [0, 0, 1, 2, 3]
    files = spark.createDataFrame([(g, i, n) for g in ("a", None) for i, n in enumerate((4, 4, 20, 4, 1, None))], "g string, i int, size int")
    taken = relate.within_budget(files, ["g"], [F.col("i").asc()], "size", 9, 10)
    assert [r["taken"] for r in taken.where("g is null").orderBy("i").collect()] == [True, True, False, False, False, False] and taken.columns == ["g", "i", "size", "taken"]
    names = spark.createDataFrame([("media/12_a_b.jpg",), ("media/12.jpg",), ("other/12_a.jpg",)], "n string")
    assert [r[0] and tuple(r[0]) for r in names.select(relate.media_name_key(F.col("n"))).collect()] == [("12", "a_b"), None, None]


def test_account_keys(spark):
    files = spark.createDataFrame([("1", "A", 0), (None, "Bob", 1), ("", "bOB", 2), (None, None, 3)], "id string, handle string, src int")
    key = relate.account_key(F.col("id"), F.col("handle"), F.col("src"))
    assert sorted(rows(relate.account_groups(files, key, "src", "src"))) == [("file:3", 1, 3), ("id:1", 1, 0), ("name:bob", 2, 2)]


def test_ancestors_beyond_one_hop_a_round(spark):
    line = spark.range(1, 31).selectExpr("id", "id - 1 as parent")
    starts = spark.createDataFrame([(30,), (7,)], "start long")
    assert sorted(rows(relate.ancestors(line, starts))) == sorted([(30, 30 - h, h) for h in range(1, 21)] + [(7, 7 - h, h) for h in range(1, 8)])
    tail = spark.createDataFrame([(9, 1), (1, 2), (2, 3), (3, 1)], "id long, parent long")
    assert sorted(rows(relate.ancestors(tail, tail.selectExpr("id as start").where("id in (9, 2)")))) == [(2, 1, 2), (2, 3, 1), (9, 1, 1), (9, 2, 2), (9, 3, 3)]


def test_collated_order(spark):
    names = spark.createDataFrame([("1a",), ("_a",), ("B",), ("a",), ("ä",), ("z",), ("A",), ("a",)], "n string")
    got = timeline.with_positions(names, [timeline.collated(F.col("n")).asc()]).orderBy("position").collect()
    assert [r["n"] for r in got] == ["_a", "1a", "a", "a", "A", "ä", "B", "z"] and [r["position"] for r in got] == list(range(8))
