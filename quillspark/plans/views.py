"""The archive's tables as views of the test tables.

posts are orders, media are line items, people are customers, the roster is suppliers by nation,
captures are events, threads are conversations, bodies are documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posts(read) -> DataFrame:
    return read("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("likes"),
    )


def authors(read) -> DataFrame:
    return read("customer").select(
        F.col("c_custkey").alias("author_id"), F.col("c_name").alias("handle"), F.col("c_mktsegment").alias("bio"), F.col("c_acctbal").alias("followers"),
        F.col("c_nationkey").alias("nation"),
    )


def media(read) -> DataFrame:
    return read("lineitem").select(
        F.col("l_orderkey").alias("post_id"), F.col("l_linenumber").alias("media_id"), F.col("l_quantity").cast("bigint").alias("size"),
        F.col("l_shipdate").alias("cached_at"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("source"),
    )


def roster(read) -> DataFrame:
    return read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("list"), F.col("s_suppkey").alias("user_id"), F.lower("s_name").alias("handle"), F.col("s_acctbal").alias("followers")
    )


def captures(read) -> DataFrame:
    """Versions of records by user; an error event says nothing."""
    return read("events").select(
        F.col("user_id").alias("id"), F.col("ts").alias("captured_at"), F.col("event_type").alias("kind"), "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("bigint")).alias("k"),
    )


def deletions(read) -> DataFrame:
    return read("events").where("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("ts").alias("deleted_at"))


def thread(read) -> DataFrame:
    """Turns as posts that answer the turn before."""
    return read("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"),
        "conv_id", "turn", "role", "text",
    )


#: The same views in SQL, to go before a query.
SQL = {
    "posts": "posts AS (SELECT o_orderkey AS id, o_custkey AS author_id, o_orderdate AS created_at, o_orderpriority AS text, o_orderstatus AS status, o_totalprice AS likes FROM orders)",
    "authors": "authors AS (SELECT c_custkey AS author_id, c_name AS handle, c_mktsegment AS bio, c_acctbal AS followers, c_nationkey AS nation FROM customer)",
    "media": "media AS (SELECT l_orderkey AS post_id, l_linenumber AS media_id, l_quantity::BIGINT AS size, l_shipdate AS cached_at, l_returnflag AS type, l_partkey AS part, l_suppkey AS source FROM lineitem)",
    "roster": "roster AS (SELECT n_name AS list, s_suppkey AS user_id, lower(s_name) AS handle, s_acctbal AS followers FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "captures": "captures AS (SELECT user_id AS id, ts AS captured_at, event_type AS kind, event_id, CASE WHEN event_type <> 'error' THEN value END AS value, CASE WHEN event_type <> 'error' THEN (props->>'$.k')::BIGINT END AS k FROM events)",
    "deletions": "deletions AS (SELECT user_id AS id, ts AS deleted_at FROM events WHERE event_type = 'error')",
    "thread": "thread AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, conv_id, turn, role, text FROM conversations)",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(SQL[n] for n in names.split()) + (", " + body if body.lstrip().split(" ")[1].upper() == "AS" else " " + body)
