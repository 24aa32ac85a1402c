"""Every query that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark import scratch
from quillspark.plans import nodes, registry


def normal(rows):
    def cell(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if isinstance(v, str):
            return v
        return round(float(v), 6)

    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    expected = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert normal([[r[i] for i in order] for r in expected.fetchall()]) == normal(map(tuple, got.select(*columns).collect()))


def test_entry(spark):
    assert entry.entry(spark).count() == 30


def test_ancestors_of_all_posts(spark, sf_dir, duck):
    got = {r["start"] for r in entry.queries()["ancestor_chain_all"](spark, sf_dir).select("start").collect()}
    assert got == {r[0] for r in duck.execute("SELECT conv_id * 1000 + turn FROM conversations WHERE turn > 0").fetchall()}


def test_all_ids_in_order(spark, sf_dir, duck):
    got = [r["id"] for r in entry.queries()["numeric_id_order_all"](spark, sf_dir).orderBy("position").collect()]
    assert got == [str(r[0]) for r in duck.execute("SELECT o_orderkey FROM orders ORDER BY o_orderkey").fetchall()] and len(got) > 100


def test_sanitised_texts_are_whole(spark, sf_dir, duck):
    got = {r["doc_id"]: r["chars"] for r in entry.queries()["sanitised_ids_all"](spark, sf_dir).collect()}
    assert got == dict(duck.execute("SELECT doc_id, nullif(length(text), 0) FROM documents").fetchall()) and max(filter(None, got.values())) > 20


def test_media_of_all_posts(spark, sf_dir, duck):
    got = {r["id"] for r in entry.queries()["media_join_all"](spark, sf_dir).select("id").collect()}
    assert got == {r[0] for r in duck.execute("SELECT o_orderkey FROM orders").fetchall()}


def test_greedy_shards_collect_no_group(spark, sf_dir):
    plan = entry.queries()["greedy_shards"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_times_within_the_second_after_now(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-15 12:00:00.4'), (2, TIMESTAMP '2024-01-15 12:00:00'), (3, TIMESTAMP '2024-01-15 11:59:59.6'), (4, TIMESTAMP '2024-01-15 11:58:59.6'), (5, NULL)) t(event_id, ts)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = entry.queries()["relative_times"](spark, str(tmp_path)).select("event_id", "label").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLES["relative_times"]).fetchall())


@pytest.mark.parametrize("name, paths", [("live_profiles", 8), ("user_nodes", 12)])
def test_user_nodes_are_dealt_out_and_read_for_what_is_asked(spark, sf_dir, name, paths):
    got = entry.queries()[name](spark, sf_dir)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("get_json_object(") <= paths
    assert got.groupBy(F.spark_partition_id()).count().count() > 1


def test_odd_user_nodes(spark):
    bodies = ['{"rest_id":"1"}', '{"rest_id":"x"}', "[]", None, "{", '{"rest_id":5,"core":"text","privacy":{"protected":"false"},"pinned_items":{"tweet_ids_str":{}},"action_counts":{"favorites_count":-1}}',
              '{"rest_id":"6","core":{"screen_name":"A"},"profile_bio":{"entities":{"description":{"mentions":[null,{"username":""},{"username":"b"}]}}},"privacy":{"protected":1},"pinned_items":{"tweet_ids_str":["7"]}}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    found = nodes.profiles(rows).orderBy("n").select("n", "user.user_id", "user.screen_name_lower", "bio_mentions", "protected", "pinned_id", "like_count")
    assert [tuple(r) for r in found.collect()] == [(0, "1", "", [], None, None, None), (5, "5", "", [], False, None, None), (6, "6", "a", ["b"], None, "7", None)]
    assert [tuple(r) for r in nodes.users(rows).orderBy("n").select("n", "screen_name").collect()] == [(0, None), (5, None), (6, "A")]


def test_files_are_grouped_once_in_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    plan = lambda: entry.queries()["merged_media"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan() and "RepartitionByExpression [post_id" in plan()
    parts = lambda rows: scratch.dealt(spark.range(rows), "id").rdd.getNumPartitions()
    monkeypatch.setattr(scratch, "TASK_ROWS", 10)
    monkeypatch.setattr(scratch, "MOST_TASK_ROWS", 40)
    assert [parts(rows) for rows in (0, 40, 41, 2_000, 2_010, 8_000, 8_001)] == [4, 4, 5, 200, 200, 200, 201]


def test_merged_media_of_odd_files(spark, tmp_path):
    con = duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT *, 0 AS l_partkey, 0 AS l_suppkey, TIMESTAMP '2024-01-01' AS l_shipdate FROM (VALUES (1, 1, 4.0, 'A'), (1, 1, 3.0, 'R'), (1, 2, 3.0, 'R'), (1, 3, 5.0, NULL), (101, 1, 7.0, 'N'), (101, 1, 6.0, 'N'),
        (NULL, 1, 2.0, 'A'), (NULL, NULL, 2.0, 'A'), (2, NULL, 2.0, 'A'), (2, 1, NULL, 'A'), (10, 1, 2.0, 'A'), (110, 1, 2.0, 'A'), (-5, 1, 2.0, 'A')) t(l_orderkey, l_linenumber, l_quantity, l_returnflag)""")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    expected = con.execute(registry.ORACLES["merged_media"])
    names = [d[0] for d in expected.description]
    assert normal(expected.fetchall()) == normal(map(tuple, entry.queries()["merged_media"](spark, str(tmp_path)).select(*names).collect()))
